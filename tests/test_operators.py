"""Core operators on small inputs: nulls, ties, empties, repeats."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from mossbrook import schema as S
from mossbrook.functions import text as X
from mossbrook.operators import access, corpus, evaluation, events, facts, graph, linking, quality, retrieval, topk
from mossbrook.sources import lake
from tests.conftest import rows


def test_licence_never_leaks(spark):
    d = spark.createDataFrame([(1, "TIER_0", None), (2, "TIER_2", "s"), (3, None, "s"), (4, "odd", "t"), (5, "TIER_2", None)], "id int, license_tier string, source string")
    assert rows(access.guarded(d, 2, 1, ["s"]).select("id")) == [(1,), (2,)]
    assert rows(access.guarded(d.limit(0), 2)) == []
    with pytest.raises(Exception, match="permitted tier"):
        access.assert_no_leak(d, 1).collect()
    assert len(access.assert_no_leak(access.guarded(d, 1), 1).collect()) == 1


def test_alias_keys(spark):
    d = spark.createDataFrame([("ＡＢ－１２",), ("PI3K-δ",), (None,), (" Straße ",)], "v string")
    assert [r[0] for r in d.select(X.alias_key("v")).collect()] == ["ab12", "pi3kdelta", "", "strasse"]
    assert rows(spark.createDataFrame([("AB-123c",)], "v string").select(X.code_variants(F.col("v")))) == [(["AB123c", "AB 123c"],)]


def test_subpaths_and_packing(spark):
    d = spark.createDataFrame([("a / b / c",)], "p string")
    assert d.select(X.subpaths(F.col("p"))).first()[0] == ["a", "a / b", "a / b / c", "b", "b / c", "c"]
    t = spark.createDataFrame([(1, "One two. Three four. " + "x" * 30 + ". End."), (2, None), (3, "")], "doc_id long, text string")
    got = corpus.chunks(t, 20).orderBy("doc_id", "position").collect()
    assert [r["text"] for r in got] == ["One two. Three four.", "x" * 30 + ".", "End."][: len(got)] or all(len(r["text"]) <= 31 for r in got)
    assert {r["doc_id"] for r in got} == {1}


def test_latest_is_order_free(spark):
    data = [("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", None, "n"), (None, 3, "q")]
    out = {tuple(rows(topk.latest(spark.createDataFrame(list(p), "k string, t int, v string"), ["k"], ["t", "v"]))) for p in itertools.islice(itertools.permutations(data), 6)}
    assert out == {(("a", 2, "z"), ("b", None, "n"), (None, 3, "q"))}


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(45)] + [(f"c{i}", f"c{i + 1}") for i in range(40)] + [("hub", f"h{i}") for i in range(50)] + [(None, "x"), ("self", "self")]
    lead = {}

    def find(x):
        while lead.setdefault(x, x) != x:
            x = lead[x]
        return x

    for a, b in edges:
        if a and b:
            ra, rb = sorted((find(a), find(b)))
            lead[rb] = ra
    got = dict(rows(graph.components(spark.createDataFrame(edges, "a string, b string"))))
    groups = {}
    for n in lead:
        groups.setdefault(find(n), []).append(n)
    assert got == {n: min(g) for g in groups.values() for n in g}


def test_walk_and_descendants_on_cycles(spark):
    e = spark.createDataFrame([("a", "broader", "b"), ("b", "has_target", "c"), ("c", "treats", "d"), ("b", "broader", "a")], "src string, predicate string, dst string")
    got = dict((r["node"], (r["hops"], r["weight"])) for r in graph.walk(spark.createDataFrame([("a",)], "seed string"), e).collect())
    assert got == {"b": (1, 0.7), "c": (2, 0.455)}
    h = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "parent string, child string")
    assert rows(graph.descendants(spark.createDataFrame([("a",)], "root string"), h)) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 3)]
    assert rows(graph.on_cycle(h)) == [("a",), ("b",), ("c",)]


def test_gram_similarity_equals_brute_force(spark):
    import math
    from collections import Counter

    left, right = ["aspirin", "asprin", "ibuprofen"], ["aspirin", "ibuprofene", "paracetamol"]

    def grams(w):
        p = f"  {w}  "
        return Counter(p[i : i + 3] for i in range(len(p) - 2))

    df = Counter(g for r in right for g in grams(r))
    idf = {g: math.log(1 + len(right) / (1 + n)) for g, n in df.items()}
    unseen = math.log(1 + len(right))

    def cos(a, b):
        wa = {g: c * idf.get(g, unseen) for g, c in grams(a).items()}
        wb = {g: c * idf[g] for g, c in grams(b).items()}
        return sum(wa[g] * wb.get(g, 0) for g in wa) / math.sqrt(sum(v * v for v in wa.values()) * sum(v * v for v in wb.values()))

    want = {(a, b): cos(a, b) for a in left for b in right if cos(a, b) >= 0.3}
    got = linking.gram_similarity(spark.createDataFrame([(x,) for x in left], "mention string"), spark.createDataFrame([(x,) for x in right], "alias string"), 0.3, 9).collect()
    assert {(r[0], r[1]): r[2] for r in got} == pytest.approx(want, abs=1e-5)


def test_linkage_ties_are_ambiguous(spark):
    p = spark.createDataFrame([("A b", "e1", 0.9), ("a  B", "e2", 0.9), ("c", "e3", 0.95), ("c", "e4", 0.85), ("d", None, 0.99), (None, "e5", 1.0), ("e", "e6", None)], "mention string, enterprise_id string, score double")
    best, ambiguous = linking.linkage_best(p)
    assert rows(best.select("mention_key", "enterprise_id")) == [("c", "e3")] and rows(ambiguous.select("mention_key")) == [("a b",)]


def test_as_of_and_ranges(spark):
    right = spark.createDataFrame([("d", 1, "s1"), ("d", 4, "s2"), ("e", 2, "s3")], "doc string, page int, s string")
    left = spark.createDataFrame([("r1", "d", 3), ("r2", "d", 4), ("r3", "e", 1), ("r4", "d", None)], "row_id string, doc string, page int")
    assert rows(corpus.as_of(left, right, "doc", "page", "s").select("row_id", "s")) == [("r1", "s1"), ("r2", "s2"), ("r3", None), ("r4", None)]
    sec = spark.createDataFrame([("d", 1, 1, 1), ("d", 2, 2, 2), ("d", 3, 2, 5), ("d", 4, 1, 9)], "document_id string, ordinal long, level int, start_page int")
    assert rows(corpus.section_ranges(sec).select("ordinal", "end_page")) == [(1, 8), (2, 4), (3, 8), (4, 9)]
    assert rows(corpus.repaired_levels(sec.withColumn("level", F.lit(5))).select("level")) == [(1,), (2,), (3,), (4,)]


def test_merge_ignores_repeats_in_a_document(spark):
    f = [("s", "p", "o", 1, 0.7), ("s", "p", "o", 1, 0.7), ("s", "p", "o", 2, 0.72), ("s", "p", "x", 1, 0.5)]
    got = rows(facts.merge(spark.createDataFrame(f, "subject string, predicate string, object string, doc_id long, confidence double")).select("object", "docs", "confidence"))
    assert got == [("o", 2, 0.77), ("x", 1, 0.5)]


def test_backlog_fold(spark):
    cols = "observation_id string, mention string, mention_key string, status string, source string, kind_hint string, event_ts string, event_date string"
    d = [("1", "A", "a", "unmapped", "s", None, "t1", "2024-01-01"), ("1", "A", "a", "unmapped", "s", None, "t1", "2024-01-01"), ("2", "A", "a", "mapped", "s", "k", "t2", None), ("3", "B", "b", "mapped", None, "k", "t1", ""), ("4", "B", "b", "unmapped", None, "k", "t3", "2023-01-01"), ("5", None, None, "unmapped", "s", "k", "t1", "2024-01-01")]
    df = spark.createDataFrame(d, cols)
    assert rows(events.backlog(df).select("mention_key", "occurrences", "status", "source", "kind_hint")) == [("b", 2, "unmapped", None, "k")]
    assert rows(events.window_days(df, "2024-01-01").select("observation_id").distinct()) == [("1",), ("2",), ("3",), ("5",)]


def test_cooccurrence_with_a_large_group(spark):
    rng = random.Random(9)
    data = [(g, rng.randrange(30)) for g in range(60) for _ in range(5)] + [(1000, i) for i in range(30)] + [(None, 1), (5, None)]
    sets = {}
    for g, i in data:
        if g is not None and i is not None:
            sets.setdefault(g, set()).add(i)
    want = {}
    for s in sets.values():
        for a, b in itertools.combinations(sorted(s), 2):
            want[a, b] = want.get((a, b), 0) + 1
    known = spark.createDataFrame([(0, 1)], "a int, b int")
    df = spark.createDataFrame(data, "g int, i int")
    for large in (1, 10, 1000):
        got = {(r["a"], r["b"]): r["groups"] for r in events.cooccurrence(df, "g", "i", 3, known, large).collect()}
        assert got == {k: n for k, n in want.items() if n >= 3 and k != (0, 1)}


def test_spans_and_vectors(spark):
    from mossbrook.functions import spans, vectors
    from mossbrook.operators import context

    t = spark.createDataFrame([(1, "the alpha beta gamma"), (2, None), (3, "")], "doc_id int, text string")
    words = spark.createDataFrame([("alphabeta", "c1"), ("betagamma", "c2"), ("gamma", "c3"), ("alpha", "c4")], "alias_norm string, concept_id string")
    found = spans.occurrences(t, words, "doc_id")
    assert rows(spans.longest_first(found, "doc_id").select("start", "concept_id")) == [(2, "c1"), (4, "c3")]
    assert rows(spans.maximal(found, "doc_id").select("start", "concept_id")) == [(2, "c1"), (3, "c2")]
    v = [r[0] for r in t.orderBy("doc_id").select(vectors.embed(F.col("text"), 16)).collect()]
    assert sum(x * x for x in v[0]) == pytest.approx(1.0) and v[1] == v[2] == [0.0] * 16
    assert spark.createDataFrame([("a b a",)], "t string").select(vectors.sparse(F.col("t"))).first()[0] and True
    items = spark.createDataFrame([(1, 'so: {"verdict": "keep", "confidence": 0.9} ok'), (2, '{"verdict": "dismiss", "confidence": 0.2}'), (3, "nonsense"), (4, None), (5, '{"verdict": "keep", "confidence": 7}')], "item_id int, payload string")
    assert [r["verdict"] for r in context.adjudicated(items).orderBy("item_id").collect()] == ["keep", "soft_downrank", "unclear", "unclear", "unclear"]
    m = spark.createDataFrame([({"a": "5 mg", "b": "many", "c": "< 0.5"},)], "m map<string,string>")
    assert m.select(context.quantities(F.col("m"))).first()[0] == {"a": "5 mg", "c": "< 0.5"}


def test_percentiles_are_exact(spark):
    d = spark.createDataFrame([("a", float(v)) for v in [5, 1, 1, 3, 9]] + [("b", None)], "g string, v double")
    assert rows(quality.nearest_rank(d, ["g"], "v", {"p50": 0.5, "p95": 0.95})) == [("a", 5, 3.0, 9.0)]


def test_fingerprint_ignores_order(spark):
    a = [("g", 1, "x"), ("g", 2, None), ("g", 2, None)]
    one = rows(quality.fingerprint(spark.createDataFrame(a, "g string, i int, s string"), ["g"], ["i", "s"]))
    assert one == rows(quality.fingerprint(spark.createDataFrame(a[::-1], "g string, i int, s string"), ["g"], ["i", "s"]))
    assert one != rows(quality.fingerprint(spark.createDataFrame(a[:2], "g string, i int, s string"), ["g"], ["i", "s"]))


def test_metrics_by_hand(spark):
    ranked = spark.createDataFrame([("x", 1, "a", 1), ("x", 1, "b", 2), ("x", 1, "c", 3)], "arm string, qid int, key string, rank int")
    gold = spark.createDataFrame([(1, "b", 2), (1, "z", 1), (1, "n", 0)], "qid int, key string, grade int")
    r = evaluation.per_query(ranked, gold).first()
    assert (r["recall"], r["p5"], r["rr"], r["ap"]) == (0.5, 0.2, 0.5, 0.25)
    assert r["ndcg"] == pytest.approx((2 / 1.584963) / (2 + 1 / 1.584963), abs=1e-5)
    assert evaluation.paired([0.0, 0.0], 50, 1) == (0.0, 0.0, 0.0, 1.0) and evaluation.paired([], 5, 1)[3] == 1.0
    mean, low, high, p = evaluation.paired([0.5, 0.4, 0.6, 0.5, 0.45], 500, 7)
    assert low <= mean <= high and p < 0.1


def test_rrf_ties_and_weights(spark):
    def ch(name, keys):
        return retrieval.channel(spark.createDataFrame([(1, k, s) for k, s in keys], "qid int, k string, score double"), name, "k")

    f = retrieval.rrf([ch("l", [("b", 1.0), ("a", 1.0)]), ch("g", [("b", 3.0)])], {"g": 0.5}).collect()
    got = {r["key"]: (r["fused"], r["ranks"]) for r in f}
    assert got == {"a": (round(1 / 61, 6), {"l": 1}), "b": (round(1 / 62 + 0.5 / 61, 6), {"l": 2, "g": 1})}


def test_replace_is_idempotent(spark, tmp_path):
    schema = "k string, v int"
    p = str(tmp_path / "t")
    lake.replace_rows(spark, p, spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 9), ("", 8)], schema), ["k"], schema)
    for _ in range(2):
        lake.replace_rows(spark, p, spark.createDataFrame([("a", 5, "x")], schema + ", extra string"), ["k"], schema)
    assert rows(spark.read.parquet(p)) == [("a", 5), ("b", 3)]
    emptied = lake.replaced(spark.read.parquet(p), spark.read.parquet(p).limit(0), ["k"], spark.createDataFrame([("b",)], "k string"))
    assert rows(emptied) == [("a", 5)]


def test_retry_only_on_locks():
    tries = []

    def locked():
        tries.append(1)
        if len(tries) < 3:
            raise RuntimeError("table is locked")

    lake.with_retry(locked, wait=0)
    assert len(tries) == 3
    with pytest.raises(ValueError):
        lake.with_retry(lambda: (_ for _ in ()).throw(ValueError("bad")), wait=0)


def test_text_sources(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("cid\tkind\tterm\nCN1\tSY\talpha\nCN1\tPT\tbeta\nXX\tPT\tz\nCN2\tSY\tgamma\n")
    assert rows(lake.read_concepts_tsv(spark, str(tmp_path / "c.tsv"))) == [("CN1", "beta", ["alpha", "beta"]), ("CN2", "gamma", ["gamma"])]
    (tmp_path / "c.jsonl").write_text('{"a": 1}\nbroken\n')
    assert [r["_corrupt"] for r in lake.read_jsonl(spark, str(tmp_path / "c.jsonl"), "a int").collect()] == [None, "broken"]
    assert lake.read_objects(spark, str(tmp_path)).count() == 2
    d = spark.createDataFrame([(1, "# Head\n\nbody\n\n\n## Sub\n\n"), (2, None), (3, "")], "k int, t string")
    assert rows(lake.text_blocks(d, "k", "t").select("k", "kind", "level", "text")) == [(1, "heading", 1, "Head"), (1, "heading", 2, "Sub"), (1, "text", None, "body")]
    assert rows(lake.route(spark.createDataFrame([("a.PDF",), ("b.md",), ("c",)], "path string"))) == [("a.PDF", "pdf", "ocr"), ("b.md", "text", "text"), ("c", "text", "text")]


def test_conform_and_candidates(spark):
    out = S.conform(spark.createDataFrame([("1", 5)], "doc_id string, junk int"), S.TABLES["documents"])
    assert out.columns[0] == "doc_id" and "junk" not in out.columns and len(out.collect()) == 1
    c = spark.createDataFrame([("TBD", "q", "x", 0.9, 1), ("Aspirin", "aspirin 500", "x", 0.9, 3), ("aspirin", "z", None, 0.2, 1), ("12", "12", "x", 0.9, 1)], "mention string, query string, canonical string, confidence double, occurrences int")
    got = {r["mention"]: r["decision"] for r in events.candidates(c, spark.createDataFrame([("tbd",)], "mention string")).collect()}
    assert got == {"TBD": "dismiss", "Aspirin": "keep", "12": "dismiss"}


def test_stream_tumbling_and_projection(spark, tmp_path):
    from mossbrook.streaming import observations as O

    e = spark.createDataFrame([(1, "2024-01-01 00:10:00", 3, "view", 1.0), (2, "2024-01-01 00:50:00", 4, "error", 1.0), (2, "2024-01-01 00:50:00", 4, "error", 1.0)], "event_id long, ts string, user_id long, event_type string, value double")
    e.withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    s = O.deduplicated(O.observations(O.source(spark, str(tmp_path / "in"), "event_id long, ts timestamp, user_id long, event_type string, value double", "parquet")))
    q = O.tumbling(s).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.sql("select status, events from w")) == [("low_confidence", 1), ("unmapped", 1)]
    d = spark.createDataFrame([(1, "z", "s" * 300, [(c, float(i)) for i, c in enumerate("abcdefghijz"[::-1])])], "decision_id int, chosen string, subject string, candidates array<struct<id:string,score:double>>")
    r = O.projected(d).first()
    assert len(r["candidates"]) == 8 and "z" in [c["id"] for c in r["candidates"]] and len(r["subject"]) == 256
