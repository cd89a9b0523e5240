"""Splitting: the pieces always fit, overlap and cover; the doubling equals the greedy walk."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from mossbrook.llm import splitting as P
from tests.conftest import rows


def walk(at, jump):
    out, i = [0], 0
    while jump[i] != i:
        i = jump[i]
        out.append(i)
    return [int(at[k]) for k in out]


def check(text, limit, overlap):
    at, jump = P.successors(text, limit, overlap)
    cuts = walk(at, jump)
    assert cuts[0] == 0 and cuts[-1] == len(text)
    o = max(0, min(overlap, limit - 1))
    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        start = lo - o if k else 0
        assert start >= 0 and 0 < hi - start <= limit
    return cuts


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n,。é̈", min_size=30, max_size=400), st.integers(5, 60), st.integers(0, 70))
def test_any_text(text, limit, overlap):
    if len(text) > limit:
        check(text, limit, overlap)


def test_doubling_equals_the_walk(spark):
    """The joins reach just the cuts of a greedy walk, for many texts and for one of a thousand pieces."""
    texts = ["word " * 50, "x" * 301, "One. Two. " * 30, "a\n\nb" * 40, "word " * 8_000]
    df = spark.createDataFrame([(str(i), t, 40, 10) for i, t in enumerate(texts)], "key string, content string, max_chars int, overlap_chars int")
    got = {}
    for key, _, at in rows(P.all_cuts(P.successor_table(df)).select("key", "place", "at")):
        got.setdefault(key, []).append(at)
    want = {str(i): walk(*P.successors(t, 40, 10)) for i, t in enumerate(texts)}
    assert {k: sorted(v) for k, v in got.items()} == want and len(want["4"]) > 1000
    assert P.all_cuts(P.successor_table(df.limit(0))).count() == 0


def test_natural_boundaries():
    text = "Alpha beta gamma delta. " * 10
    cuts = check(text, 60, 12)
    assert all(text[c - 1] == " " and text[c - 2] == "." for c in cuts[1:-1])
    text = "First part is here.\n\n" + "Second part goes on. " * 3
    assert 21 in check(text, 40, 0)
    assert check("See No. 7 and ca. 0.25 of it, e.g. That one here is all", 40, 0)[1] not in (8,)

    marked = "e\u0301" * 100
    assert all(marked[c] == "e" for c in check(marked, 31, 4)[1:-1])


def test_operator_edges(spark):
    nodes = spark.createDataFrame(
        [("n1", "d", "paragraph", "a", "word " * 30, 1), ("n1", "d", "paragraph", "a", "word " * 30, 2), ("n2", "d", "paragraph", None, None, 1), ("n3", "d", "paragraph", None, "", 1), ("n4", "d", "free", None, "x" * 500, 1),
         ("n5", "d", "sentence", None, "x" * 100, 1), (None, "d", "sentence", None, "y" * 120, 1), ("n6", "d", "sentence", None, "😀" * 51, 1), ("n7", "d", "paragraph", None, "w" * 100, 1)],
        "node_id string, document_id string, node_kind string, section_path string, content string, max_chars int",
    )
    limits = spark.createDataFrame([("paragraph", 100, 10, 1), ("sentence", 50, 80, 1), ("table", None, 0, 1), (None, 5, 0, 1), ("paragraph", 120, 10, 2)], "node_kind string, max_chars int, overlap_chars int, content int")
    got = P.split_oversized(nodes, limits).toPandas()
    assert set(got["node_id"].dropna()) == {"n1", "n5", "n6"} and got["node_id"].isna().any()
    one = got[got.node_id == "n1"].sort_values("piece_no")
    assert one.piece_no.tolist() == list(range(1, len(one) + 1)) and (one.piece_count == len(one)).all() and (one.section_path == "a").all()
    assert P.split_oversized(nodes.limit(0), limits).count() == 0 and P.split_oversized(nodes, limits.limit(0)).count() == 0
    assert rows(P.split_oversized(nodes.repartition(5), limits).select("node_id", "piece_no", "content")) == rows(P.split_oversized(nodes, limits).select("node_id", "piece_no", "content"))
