"""Filling fixed-capacity containers with documents, under control of the mixture.

Deficit round-robin over source queues. Every partition holds one queue for each
source, ordered by size. A container opens a window: each source is credited its
share of the capacity, and the sources take turns, the one with the largest
deficit first, each giving its largest item that still fits. What a source gave
beyond its credit or less is carried to the next container. So the containers
follow the target proportions for as long as the queues last, and the largest
item that fits is always taken, which leaves little room: a container is closed
only when nothing left in the partition fits it.

The number of partitions follows from the data: each holds ``TASK`` containers'
worth of tokens, so no task grows with the corpus. Containers that a partition could
not fill to ``full`` are opened again in the next round, on as many partitions as what is left
needs, with the deficits of the partitions that meet there added up. When a round
leaves more than half of what came in (as with sizes of which no two fit together), or
one partition is enough, the round after it closes all its containers.

The target proportions are those of the whole corpus, or ``target``.

Defined results: an item larger than the capacity is split into whole containers
and a rest, which is packed like any item; no other item is split. Items of size
null, zero or less are left out. Sources may be null. Repeated ids are items of
their own. An empty input gives no containers. A source without a share in ``target`` is placed in the room
that the others leave. The result is the same on every run over the same rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermaloom.session import materialize

CAPACITY = 2048
#: Containers filled to this share are closed for good before the last round.
FULL = 0.995
#: Containers' worth of tokens that one task packs.
TASK = 4096

_ITEM = "doc_id bigint, piece int, source string, start bigint, size int"
_ROW = "kind int, container bigint, place int, " + _ITEM + ", deficit double"
_SCHEMA = pa.schema([("kind", pa.int32()), ("container", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("source", pa.string()), ("start", pa.int64()), ("size", pa.int32()), ("deficit", pa.float64())])
PLACED, WAITING, DEFICIT = 0, 1, 2


class Queues:
    """Items by size and source; finds the largest size that fits."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.by: dict[str | None, dict[int, list]] = {}
        self.sizes: dict[str | None, int] = {}  # bit s is set if the source has an item of size s
        self.count = 0

    def put(self, source, size: int, item: tuple) -> None:
        self.by.setdefault(source, {}).setdefault(size, []).append(item)
        self.sizes[source] = self.sizes.get(source, 0) | 1 << size
        self.count += 1

    def fits(self, source, room: int) -> int:
        """The largest size of the source that fits, or 0."""
        return (self.sizes.get(source, 0) & ((1 << room + 1) - 1)).bit_length() - 1 if self.sizes.get(source, 0) & ((1 << room + 1) - 1) else 0

    def take(self, source, size: int) -> tuple:
        items = self.by[source][size]
        item = items.pop()
        if not items:
            self.sizes[source] &= ~(1 << size)
        self.count -= 1
        return item


def pack_queues(queues: Queues, shares: dict, deficits: dict) -> Iterator[list[tuple]]:
    """Containers as lists of (source, size, item); ``deficits`` is carried and left as it ends."""
    capacity = queues.capacity
    while queues.count:
        room, got = capacity, []
        for s, share in shares.items():
            if queues.sizes.get(s):
                deficits[s] = deficits.get(s, 0.0) + share * capacity
        turn = [(-deficits.get(s, 0.0), str(s), s) for s in queues.sizes if queues.sizes[s]]
        heapify(turn)
        while turn and room:
            _, name, s = heappop(turn)
            size = queues.fits(s, room)
            if not size:
                continue
            if got and size < room and turn:
                # close to the end an exact or larger fit of another source wastes less room
                best = max(turn, key=lambda x: queues.fits(x[2], room))
                other = queues.fits(best[2], room)
                if 2 * room < capacity and other == room:
                    turn.remove(best)
                    heapify(turn)
                    heappush(turn, (-deficits.get(s, 0.0), name, s))
                    _, name, s = best
                    size = other
            got.append((s, size, queues.take(s, size)))
            room -= size
            deficits[s] = deficits.get(s, 0.0) - size
            if queues.sizes[s]:
                heappush(turn, (-deficits[s], name, s))
        yield got


def pack(items: DataFrame, capacity: int = CAPACITY, full: float = FULL, target: dict | None = None, task: int = TASK) -> DataFrame:
    """``container, place, doc_id, piece, source, start, size`` of items ``doc_id, source, size``.

    ``start`` is the first token of the piece in its document. Containers are
    numbered by round, partition and turn. ``target``: share of each source in the tokens of a container.
    """
    sized = materialize(items.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("size").cast("bigint").alias("size")).where("size > 0"), "sizes")
    # one row a source: the number of sources is that of the kinds of text, not of documents
    totals = sized.groupBy("source").agg(F.sum("size").alias("t")).collect()
    tokens = sum(r.t for r in totals)
    shares = {r.source: (r.t / tokens if target is None else target.get(r.source, 0.0) / sum(target.values())) for r in sorted(totals, key=lambda r: str(r.source))}
    needed = lambda t: max(1, -(-t // (capacity * task)))
    n = needed(tokens)

    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / capacity).cast("int")), lambda i: F.struct(i.alias("piece"), (i.cast("bigint") * capacity).alias("start"), F.least(F.lit(capacity).cast("bigint"), F.col("size") - i.cast("bigint") * capacity).cast("int").alias("size")))
    mark = F.xxhash64("doc_id", "piece", "source", "size")  # spreads the items anew over any number of partitions
    waiting = sized.select("doc_id", "source", F.explode(pieces).alias("x")).select(F.lit(WAITING).alias("kind"), F.lit(None).cast("bigint").alias("container"), F.lit(None).cast("int").alias("place"), "doc_id", "x.piece", "source", "x.start", "x.size", F.lit(None).cast("double").alias("deficit"), F.lit(0).alias("part"))
    placed: list[DataFrame] = []
    turn, last = 0, n == 1
    while True:
        dealt = waiting.withColumn("part", F.pmod(F.when(F.col("kind") == DEFICIT, F.col("part")).otherwise(mark), F.lit(n)).cast("int"))
        done = dealt.repartition(n, "part").sortWithinPartitions("part", "source", "size", "doc_id", "piece").mapInArrow(_round(turn, capacity, capacity if last else full * capacity, last, shares), _ROW + ", part int")
        done = materialize(done, f"pack-{turn}")
        placed.append(done.where(F.col("kind") == PLACED).drop("kind", "deficit", "part"))
        if last:
            break
        waiting = done.where(F.col("kind") != PLACED)
        left = waiting.agg(F.sum("size")).first()[0] or 0
        last, n, turn = 2 * left > tokens or needed(left) == 1, needed(left), turn + 1
        tokens = left
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    return out.select("container", "place", "doc_id", "piece", "source", "start", "size")


def mixture(packed: DataFrame, target: dict | None = None) -> DataFrame:
    """For each source its ``tokens``, share of all (``share``), wanted share (``target``), and how far its share in a container is off that, on average (``off``)."""
    by = packed.groupBy("container", "source").agg(F.sum("size").alias("s"))
    whole = by.groupBy("container").agg(F.sum("s").alias("c"))
    total = by.groupBy("source").agg(F.sum("s").alias("tokens"))
    rows = total.collect()  # one row a source
    tokens, n = sum(r.tokens for r in rows) or 1, whole.count()
    wanted = {r.source: (r.tokens / tokens if target is None else target.get(r.source, 0.0) / sum(target.values())) for r in rows}
    want = F.lit(0.0)
    for s, share in wanted.items():
        want = F.when(F.col("source").eqNullSafe(F.lit(s)), F.lit(share)).otherwise(want)
    # a container without the source is off by the whole target
    off = (F.sum(F.abs(F.col("s") / F.col("c") - F.col("target"))) + (n - F.count("*")) * F.first("target")) / n
    return by.join(whole, "container").withColumn("target", want).groupBy("source").agg(F.sum("s").alias("tokens"), (F.sum("s") / tokens).alias("share"), F.first("target").alias("target"), off.alias("off"))


def _round(turn: int, capacity: int, least: float, last: bool, shares: dict):
    schema = _SCHEMA.append(pa.field("part", pa.int32()))

    def rows_of(part: int, queues: Queues, deficits: dict) -> Iterator[tuple]:
        for number, got in enumerate(pack_queues(queues, shares, deficits)):
            if last or sum(size for _, size, _ in got) >= least:
                container = (turn << 56) | (part << 32) | number
                for place, (source, size, (doc_id, piece, start)) in enumerate(got):
                    yield (PLACED, container, place, doc_id, piece, source, start, size, None, part)
            else:
                for source, size, (doc_id, piece, start) in got:
                    yield (WAITING, None, None, doc_id, piece, source, start, size, None, part)
        if not last:
            for source, deficit in deficits.items():
                yield (DEFICIT, None, None, None, None, source, None, None, deficit, part)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            now, queues, deficits = None, Queues(capacity), {}
            for batch in batches:
                for kind, _, _, doc_id, piece, source, start, size, deficit, part in zip(*(c.to_pylist() for c in batch.columns)):
                    if part != now:
                        if now is not None:
                            yield from rows_of(now, queues, deficits)
                        now, queues, deficits = part, Queues(capacity), {}
                    if kind == DEFICIT:
                        deficits[source] = deficits.get(source, 0.0) + deficit
                    else:
                        queues.put(source, size, (doc_id, piece, start))
            if now is not None:
                yield from rows_of(now, queues, deficits)

        held: list[tuple] = []
        for row in rows():
            held.append(row)
            if len(held) >= 8192:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)

    return run
