import base64
import os

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from thermaloom.llm import tokenize as tk

pytestmark = pytest.mark.skipif(not os.path.exists(tk.VOCABULARY), reason="no vocabulary file")


@pytest.fixture(scope="module")
def encoder():
    return tk.Encoder(open(tk.VOCABULARY, "rb").read())


@pytest.fixture(scope="module")
def direct():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tk.VOCABULARY, "rb"))}
    return tiktoken.Encoding("direct", pat_str=tk.PATTERN, mergeable_ranks=ranks, special_tokens={})


PIECES = st.sampled_from(["it's", " the ", "\n\n", "  ", "\t", "'", "''", "don't", "😀", "é", "日本", "한국", "１２", "12", "<|endoftext|>", " ", "　", "!'s", "~'re", "x", "Q", "\r\n", "́", "ZZqj"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(PIECES, st.text(max_size=6)), max_size=30))
def test_fragments_encode_as_the_whole(encoder, direct, parts):
    text = "".join(parts)
    want = direct.encode_ordinary(text)
    for least in (1, 5):
        assert encoder.encode(text, least).tolist() == want
    assert "".join(encoder.fragments(text, 1)) == text


def test_long_text_is_cut_and_exact(encoder, direct):
    text = "Surface temperature at the north mast, ２３ °C; la température était élevée. 温度が高い。\n" * 3000
    assert len(encoder.fragments(text)) > 50
    assert encoder.encode(text).tolist() == direct.encode_ordinary(text)
    assert encoder.encode("a" * 5000).tolist() == direct.encode_ordinary("a" * 5000)


def test_table(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, " ", "x"), (4, "<|endoftext|>", "x"), (4, "<|endoftext|>", "x")], "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, tuple(r.ids)) for r in tk.token_ids(docs, spark).collect())
    assert got[0] == (1, ()) and got[1] == (2, ()) and got[2] == (3, (220,))
    assert got[3] == got[4] and len(got[3][1]) > 1
    assert tk.token_ids(docs.limit(0), spark).count() == 0
    counts = tk.token_counts(docs, spark, ["doc_id"]).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in counts)[:3] == [(1, 0), (2, 0), (3, 1)]


def test_long_texts_are_spread_over_tasks(spark, direct):
    text = "Surface temperature at the north mast, 23 °C; la température était élevée.\n"
    rows = [(i, None if i == 3 else "" if i == 4 else text * (1 + 40 * (i % 2))) for i in range(8)] + [(1, text * 41)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = sorted((i, tuple(direct.encode_ordinary(t or ""))) for i, t in rows)
    for spread in (300, 2000, 1 << 20):
        assert sorted((r.doc_id, tuple(r.ids)) for r in tk.token_ids(docs, spark, spread=spread).collect()) == want
        assert sorted((r.doc_id, r.n_tokens) for r in tk.token_counts(docs, spark, ["doc_id"], spread=spread).collect()) == sorted((i, len(x)) for i, x in want)


def test_ordinary_texts_are_cut(encoder):
    """No text is too short for the method but those under one fragment."""
    text = "The logger at mast 7 froze again; we measured 41 °C over asphalt at noon. Please check the cable before you restart.\n" * 3
    assert len(encoder.fragments(text)) > 1 and len(encoder.fragments("short")) == 1
