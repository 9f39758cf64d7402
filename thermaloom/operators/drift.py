"""Schemas that drift between files.

Every file's schema is a tree whose leaves are the fields. Successive files of a
producer are compared by a tree edit distance: keys of the same name match,
the rest of the children of matched objects are assigned at minimum cost as
renames, deletions and insertions (a subtree costs what its leaves cost), and
leaves that are still single are assigned across the tree as moves. What a
rename costs depends on the names and on the content of the fields. The script
of a file is compiled into a projection from its fields to the producer's
lasting names, and that projection is applied to every record.

Defined results
* A field is a dotted path to a value that is no object; an empty object has none.
  A file has a field if any readable record in it has the key, null or not.
* Records that cannot be parsed, or are no objects, are left out; a file without
  a readable record is skipped, as nothing is known of its schema.
* Lines delivered twice count once in the table and do not matter to the schema.
* A type is known once a value other than null was seen; it is carried over files
  and renames. Where a file holds several types of a field, the one with the most
  values counts (ties by name).
* The first file of a producer has no changes. Rows with a null artifact, producer
  or file number are left out. An empty table gives an empty result.
"""

from __future__ import annotations

import difflib
import json
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TYPES = ("number", "string", "boolean", "array")
#: Tokens that tell a unit or a form, not what a field is.
UNITS = frozenset({"s", "second", "sec", "ms", "utc", "at", "n", "id", "is", "max", "m", "count", "value"})
#: A gone and a come field are one renamed field if a rename costs at most this.
RENAME_COST = 0.5
#: Cost of taking away or adding a leaf, beside which a rename is weighed.
LEAF = 0.5
_SEEDS = 8

FIELD_DDL = "path string, number bigint, string bigint, boolean bigint, array bigint, logs double, whole bigint, chars bigint, digits bigint, letters bigint, spaces bigint, " + ", ".join(f"h{i} bigint" for i in range(_SEEDS))
_SUMS = ("number", "string", "boolean", "array", "logs", "whole", "chars", "digits", "letters", "spaces")
CHANGE_DDL = "artifact string, producer string, file_no int, change_kind string, old_field string, new_field string"


# -- fields of records ---------------------------------------------------------
def leaves(record: dict, at: str = "") -> Iterator[tuple[str, object]]:
    """(dotted path, value) of all values that are no objects; without recursion, so depth does no harm."""
    stack = [(at, record)]
    while stack:
        prefix, node = stack.pop()
        for k, v in node.items():
            path = f"{prefix}.{k}" if prefix else k
            if isinstance(v, dict):
                stack.append((path, v))
            else:
                yield path, v


def parse(body: str | None) -> dict | None:
    try:
        record = json.loads(body) if body else None
    except (ValueError, RecursionError):
        return None
    return record if isinstance(record, dict) else None


class Profile:
    """What a file holds of one field."""

    __slots__ = ("number", "string", "boolean", "array", "logs", "whole", "chars", "digits", "letters", "spaces", "mins")

    def __init__(self) -> None:
        self.number = self.string = self.boolean = self.array = self.whole = self.chars = self.digits = self.letters = self.spaces = 0
        self.logs = 0.0
        self.mins = [None] * _SEEDS

    def see(self, v: object) -> None:
        if v is None:
            return
        if isinstance(v, bool):
            self.boolean += 1
        elif isinstance(v, (int, float)):
            self.number += 1
            size = min(abs(float(v)), 1e300) if v == v else 0.0
            whole = float(size).is_integer()
            self.logs += math.log10(size + (1 if whole else 1e-6))
            self.whole += whole
        elif isinstance(v, str):
            self.string += 1
            self.chars += len(v)
            self.digits += sum(map(str.isdigit, v))
            self.letters += sum(map(str.isalpha, v))
            self.spaces += v.count(" ")
        else:
            self.array += 1
        for x in v if isinstance(v, list) else (v,):
            h = _hash(json.dumps(x, sort_keys=True))
            for i in range(_SEEDS):
                g = (h * (2 * i + 1) * 0x9E3779B97F4A7C15 + i * 0xD1B54A32D192ED03) & 0x7FFFFFFFFFFFFFFF
                if self.mins[i] is None or g < self.mins[i]:
                    self.mins[i] = g

    def kind(self) -> str | None:
        best = max(TYPES, key=lambda t: (getattr(self, t), t))
        return best if getattr(self, best) else None


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text)


def profiles(records: DataFrame) -> DataFrame:
    """Profiles of each file's fields, from rows ``artifact, producer, file_no, body``; combined before the shuffle."""
    names = ["artifact", "producer", "file_no"]
    ddl = "artifact string, producer string, file_no int, " + FIELD_DDL
    schema = pa.schema([("artifact", pa.string()), ("producer", pa.string()), ("file_no", pa.int32()), ("path", pa.string()), *((c, pa.float64() if c == "logs" else pa.int64()) for c in _SUMS), *((f"h{i}", pa.int64()) for i in range(_SEEDS))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple, Profile] = {}
            for a, p, f, body in zip(*(c.to_pylist() for c in batch.columns)):
                record = parse(body)
                if record is None:
                    continue
                seen.setdefault((a, p, f, None), Profile())  # the file has a readable record
                for path, v in leaves(record):
                    seen.setdefault((a, p, f, path), Profile()).see(v)
            if seen:
                rows = [(*k, *(getattr(x, c) for c in _SUMS), *x.mins) for k, x in seen.items()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    whole = records.select(*(F.col(c).cast(t).alias(c) for c, t in zip(names, ("string", "string", "int"))), F.col("body").cast("string").alias("body")).dropna(subset=names)
    return whole.mapInArrow(run, ddl).groupBy(*names, "path").agg(*(F.sum(c).alias(c) for c in _SUMS), *(F.min(f"h{i}").alias(f"h{i}") for i in range(_SEEDS)))


# -- likeness of fields -----------------------------------------------------------
def tokens(name: str) -> list[str]:
    parts = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)
    return [re.sub(r"(?<=..)s$", "", p.lower()) for p in parts] or [name.lower()]


def name_likeness(a: str, b: str) -> float:
    """Of two paths, by the tokens of their last keys and of the whole paths."""
    la, lb = a.rpartition(".")[2], b.rpartition(".")[2]
    if la.lower() == lb.lower():
        return 1.0
    best = 0.0
    for x, y in ((la, lb), (a, b)):
        tx, ty = {t for t in tokens(x) if t not in UNITS}, {t for t in tokens(y) if t not in UNITS}
        if x == a:  # shared parents tell nothing
            shared = set(tokens(a.rpartition(".")[0])) & set(tokens(b.rpartition(".")[0]))
            tx, ty = tx - shared, ty - shared
        if tx and ty:
            best = max(best, len(tx & ty) / min(len(tx), len(ty)) * 0.6 + len(tx & ty) / len(tx | ty) * 0.4)
    core = lambda x: "".join(t for t in tokens(x) if t not in UNITS) or x.lower()
    x, y = core(la), core(lb)
    prefix = 0
    while prefix < min(len(x), len(y)) and x[prefix] == y[prefix]:
        prefix += 1
    if prefix >= 2 and (prefix >= 3 or prefix == min(len(x), len(y))):
        best = max(best, 0.4 + 0.5 * prefix / max(len(x), len(y)))
    return max(best, difflib.SequenceMatcher(None, x, y).ratio() * 0.8 - 0.2, 0.0)


def content_likeness(a: dict, b: dict) -> float | None:
    """0..1; null if the content of either is unknown."""
    ka, kb = kind_of(a), kind_of(b)
    if ka is None or kb is None:
        return None
    if ka != kb:
        return 0.0
    shared = np.mean([a[f"h{i}"] == b[f"h{i}"] for i in range(_SEEDS)])
    if ka == "boolean":
        return 0.5
    if ka == "array":
        return 0.5 + 0.5 * float(shared)
    if ka == "number":
        gap = abs(a["logs"] / a["number"] - b["logs"] / b["number"])
        form = abs(a["whole"] / a["number"] - b["whole"] / b["number"])
        return float(max(shared, max(0.0, 1 - gap / 1.5) * (1 - 0.5 * form)))
    pa_, pb = ([x[c] / max(1, x["chars"]) for c in ("digits", "letters", "spaces")] for x in (a, b))
    shape = 1 - sum(abs(x - y) for x, y in zip(pa_, pb)) / 2
    la, lb = a["chars"] / a["string"], b["chars"] / b["string"]
    return float(max(shared, max(0.0, shape) * (min(la, lb) + 1) / (max(la, lb) + 1)))


def kind_of(f: dict) -> str | None:
    best = max(TYPES, key=lambda t: (f[t] or 0, t))
    return best if f[best] else None


def rename_cost(old: dict, new: dict) -> float:
    """0 for the same field under another name, 1 for fields that have nothing in common."""
    name = name_likeness(old["path"], new["path"])
    content = content_likeness(old, new)
    same_parent = old["path"].rpartition(".")[0] == new["path"].rpartition(".")[0] != ""
    if content is None:
        return 1 - name * 0.85
    if content == 0.0:
        return 1 - name * 0.55 if name > 0.9 else 1.0
    if name < 0.25:  # nothing in the names: only a sibling with close content can be the same field
        return 0.45 if same_parent and content > 0.6 and kind_of(old) != "boolean" else 1.0
    return 1 - (0.6 * name + 0.3 * content + (0.1 if same_parent else 0.05))


# -- tree edit distance -------------------------------------------------------------
def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Minimum-cost assignment of rows to columns (Hungarian method with potentials); rows <= columns."""
    n, m = cost.shape
    u, v, p, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        p[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = p[j0]
            cur = cost[i0 - 1] - u[i0] - v[1:]
            free = ~used[1:]
            better = free & (cur < least[1:])
            least[1:][better] = cur[better]
            way[1:][better] = j0
            j1 = int(np.argmin(np.where(free, least[1:], np.inf))) + 1
            delta = least[j1]
            u[p[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if p[j0] == 0:
                break
        while j0:
            p[j0] = p[way[j0]]
            j0 = way[j0]
    return [(int(p[j]) - 1, j - 1) for j in range(1, m + 1) if p[j]]


def tree(fields: dict[str, dict]) -> dict:
    """Nested dicts; a leaf is the field's path. A key that is both a leaf and an object keeps its leaf under ''."""
    root: dict = {}
    for path in sorted(fields):
        node = root
        *parents, last = path.split(".")
        for k in parents:
            nxt = node.setdefault(k, {})
            if not isinstance(nxt, dict):
                nxt = node[k] = {"": nxt}
            node = nxt
        if isinstance(node.get(last), dict):
            node[last][""] = path
        else:
            node[last] = path
    return root


def _paths(node) -> list[str]:
    return [node] if isinstance(node, str) else [p for c in node.values() for p in _paths(c)]


def edit_script(old: dict[str, dict], new: dict[str, dict]) -> tuple[list[tuple[str, str]], list[str], list[str]]:
    """(renames or moves, deletions, insertions) of least cost, as paths of leaves."""
    pairs, gone, come = _match(tree(old), tree(new), old, new)[1:]
    if gone and come:  # moves: what was left single, across the tree
        cost = np.array([[rename_cost(old[g], new[c]) for c in come] for g in gone])
        moved = _assigned(cost, np.full(len(gone), LEAF), np.full(len(come), LEAF), RENAME_COST)
        pairs += [(gone[i], come[j]) for i, j in moved]
        gone = [g for i, g in enumerate(gone) if i not in {x for x, _ in moved}]
        come = [c for j, c in enumerate(come) if j not in {x for _, x in moved}]
    return sorted((a, b) for a, b in pairs if a != b), gone, come


def _assigned(cost: np.ndarray, delete: np.ndarray, insert: np.ndarray, most: float | np.ndarray) -> list[tuple[int, int]]:
    """Pairs of the cheapest assignment in which each side may also stay single."""
    n, m = cost.shape
    big = np.full((n + m, n + m), 1e6)
    big[:n, :m] = np.where(cost <= most, cost, 1e6)
    big[np.arange(n), m + np.arange(n)] = delete
    big[n + np.arange(m), np.arange(m)] = insert
    big[n:, m:] = 0
    return [(i, j) for i, j in assign(big) if i < n and j < m and cost[i, j] <= (most if np.isscalar(most) else most[i, j])]


def _match(a: dict, b: dict, old: dict, new: dict) -> tuple[float, list, list, list]:
    """Cost, pairs of leaves, single leaves of either side, for two objects taken as the same node."""
    total, pairs, gone, come = 0.0, [], [], []
    rest_a, rest_b = [], []
    for k in sorted(a.keys() | b.keys()):
        x, y = a.get(k), b.get(k)
        if k in a and k in b and isinstance(x, str) == isinstance(y, str):
            if isinstance(x, str):
                pairs.append((x, y))
            else:
                c, p, g, o = _match(x, y, old, new)
                total, pairs, gone, come = total + c, pairs + p, gone + g, come + o
            continue
        rest_a += [x] if k in a else []
        rest_b += [y] if k in b else []
    rest_a.sort(key=_paths)
    rest_b.sort(key=_paths)
    chosen: list[tuple[int, int]] = []
    inner: dict[tuple[int, int], tuple] = {}
    if rest_a and rest_b:
        wa, wb = np.array([LEAF * len(_paths(x)) for x in rest_a]), np.array([LEAF * len(_paths(y)) for y in rest_b])
        cost = np.full((len(rest_a), len(rest_b)), 1e6)
        most = np.zeros_like(cost)
        for i, x in enumerate(rest_a):
            for j, y in enumerate(rest_b):
                if isinstance(x, str) and isinstance(y, str):
                    cost[i, j], most[i, j] = rename_cost(old[x], new[y]), RENAME_COST
                elif isinstance(x, dict) and isinstance(y, dict):  # an object under another name: worth it if its leaves go on
                    inner[i, j] = _match(x, y, old, new)
                    cost[i, j], most[i, j] = 0.2 + inner[i, j][0], 0.5 * (wa[i] + wb[j])
        chosen = _assigned(cost, wa, wb, most)
    for i, j in chosen:
        if isinstance(rest_a[i], str):
            total += rename_cost(old[rest_a[i]], new[rest_b[j]])
            pairs.append((rest_a[i], rest_b[j]))
        else:
            c, p, g, o = inner[i, j]
            total, pairs, gone, come = total + 0.2 + c, pairs + p, gone + g, come + o
    for i, x in enumerate(rest_a):
        if i not in {i for i, _ in chosen}:
            gone += _paths(x)
    for j, y in enumerate(rest_b):
        if j not in {j for _, j in chosen}:
            come += _paths(y)
    return total + LEAF * (len(gone) + len(come)), pairs, sorted(gone), sorted(come)


# -- over the files of a producer ------------------------------------------------------
class History:
    """Walks the files of one producer in order."""

    def __init__(self) -> None:
        self.fields: dict[str, dict] | None = None
        self.types: dict[str, str] = {}
        self.lasting: dict[str, str] = {}  # present name -> lasting name

    def step(self, fields: dict[str, dict]) -> list[tuple[str, str, str]]:
        """Changes (kind, old field, new field) of the next file."""
        changes: list[tuple[str, str, str]] = []
        if self.fields is not None:
            renames, gone, come = edit_script(self.fields, fields)
            changes += [("removed", g, "") for g in gone] + [("added", "", c) for c in come] + [("renamed", a, b) for a, b in renames]
            known = {b: self.types.pop(a) for a, b in renames if a in self.types}
            names = {b: self.lasting.get(a, a) for a, b in renames}
            for c in come:  # a field that was away comes back with what is known of it, unless its name was taken over
                known.pop(c, None)
            self.types |= known
            self.lasting |= names
            for path, f in fields.items():
                kind, before = kind_of(f), self.types.get(path)
                if kind and before and kind != before and path in self.fields:
                    changes.append(("retyped", path, path))
        for path, f in fields.items():
            if kind_of(f):
                self.types[path] = kind_of(f)
            self.lasting.setdefault(path, path)
        # last known content goes on where this file has only nulls
        before = self.fields or {}
        self.fields = {p: f if kind_of(f) or p not in before else before[p] for p, f in fields.items()}
        return changes

    def projection(self) -> dict[str, str]:
        return {p: self.lasting[p] for p in self.fields or {}}


def schema_steps(records: DataFrame) -> DataFrame:
    """``artifact, producer, file_no, changes, projection`` of each file, in one pass over the files' schemas."""
    cols = ["path", *_SUMS, *(f"h{i}" for i in range(_SEEDS))]
    files = profiles(records).groupBy("artifact", "producer", "file_no").agg(F.collect_list(F.when(F.col("path").isNotNull(), F.struct(*cols))).alias("fields"))
    ddl = "artifact string, producer string, file_no int, changes array<struct<kind: string, old: string, new: string>>, projection map<string, string>"
    schema = pa.schema([("artifact", pa.string()), ("producer", pa.string()), ("file_no", pa.int32()), ("changes", pa.list_(pa.struct([("kind", pa.string()), ("old", pa.string()), ("new", pa.string())]))), ("projection", pa.map_(pa.string(), pa.string()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, history = None, History()
        for batch in batches:
            rows = []
            for a, p, f, fields in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, p) != now:
                    now, history = (a, p), History()
                changes = history.step({x["path"]: x for x in fields})
                rows.append((a, p, f, [dict(zip(("kind", "old", "new"), c)) for c in changes], list(history.projection().items())))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return files.repartition("artifact", "producer").sortWithinPartitions("artifact", "producer", "file_no").mapInArrow(run, ddl)


def changes(records: DataFrame) -> DataFrame:
    """``artifact, producer, file_no, change_kind, old_field, new_field``."""
    c = F.explode("changes").alias("c")
    return schema_steps(records).select("artifact", "producer", "file_no", c).select("artifact", "producer", "file_no", F.col("c.kind").alias("change_kind"), F.col("c.old").alias("old_field"), F.col("c.new").alias("new_field"))


def consistent_table(records: DataFrame) -> DataFrame:
    """Every readable record once, under lasting names: ``artifact, producer, file_no, line_no, fields``.

    ``fields`` maps a lasting name to the value's text, the same for a number
    whatever its type in the file; null where the field is null.
    """
    keys = ["artifact", "producer", "file_no"]
    steps = schema_steps(records).select(*keys, "projection")
    lines = records.select(*(F.col(c).cast(t).alias(c) for c, t in zip((*keys, "line_no"), ("string", "string", "int", "int"))), F.col("body").cast("string").alias("body")).dropDuplicates([*keys, "line_no", "body"])
    joined = lines.join(steps, keys).select(*keys, "line_no", "body", "projection")
    ddl = "artifact string, producer string, file_no int, line_no int, fields map<string, string>"
    schema = pa.schema([("artifact", pa.string()), ("producer", pa.string()), ("file_no", pa.int32()), ("line_no", pa.int32()), ("fields", pa.map_(pa.string(), pa.string()))])

    def text(v: object) -> str | None:
        if v is None or isinstance(v, str):
            return v
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, float) and v.is_integer():
            return str(int(v))
        return str(v) if isinstance(v, (int, float)) else json.dumps(v, sort_keys=True)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, p, f, line, body, projection in zip(*(c.to_pylist() for c in batch.columns)):
                record = parse(body)
                if record is not None:
                    to = dict(projection)
                    rows.append((a, p, f, line, sorted({to.get(k, k): text(v) for k, v in leaves(record)}.items())))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return joined.mapInArrow(run, ddl)
