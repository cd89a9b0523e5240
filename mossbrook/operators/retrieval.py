"""Evidence retrieval: channels, fusion, filters. Many queries at once, one row per (qid, key, channel)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mossbrook import schema as S
from mossbrook.functions import text as X
from mossbrook.session import cut_lineage

#: Words of a query that set the floor of its k best.
RAREST = 4


def postings(docs: DataFrame, key: str, text: str, terms: DataFrame | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, term, w): the BM25 weight of each word of each document; only of ``terms``, if given, and then words that nobody asks for are
    dropped before anything is shuffled. Documents without words don't count. What this returns can be kept as an index table."""
    sized = docs.select(key, X.words(F.col(text)).alias("ws")).where(F.size("ws") > 0)
    stats = sized.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(F.size("ws")).alias("mean"))
    tokens = sized.select(key, F.size("ws").alias("length"), F.explode("ws").alias("term"))
    if terms is not None:
        tokens = tokens.join(terms, "term", "left_semi")
    hit = tokens.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))
    df = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    w = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return hit.join(df, "term").join(F.broadcast(stats)).select(key, "term", "df", w.alias("w"))


def bm25(queries: DataFrame, docs: DataFrame, key: str, text: str, k: int, only: DataFrame | None = None) -> DataFrame:
    """(qid, key, score): the k best documents of each query, ties by key; of the documents ``only``, if given, while
    words are counted over all.

    Exact, but a word that most documents hold forms no pairs. First each query is scored by its rarest words: the k-th of these partial
    scores is a floor, as no weight is negative. Words whose greatest weights add up to less than the floor can't lift a document over
    it by themselves, so only documents with another word of the query are candidates, and only these are scored in full.
    """
    q = queries.select("qid", F.explode(F.array_distinct(X.words(F.col("query")))).alias("term"))
    index = cut_lineage(postings(docs, key, text, q.select("term").distinct()))
    if only is not None:
        index = index.join(only.select(key).distinct(), key, "left_semi")
    most = index.groupBy("term").agg(F.max("w").alias("most"), F.count(F.lit(1)).alias("held"))
    asked = cut_lineage(q.join(most, "term"))
    by_weight = Window.partitionBy("qid").orderBy(F.col("most").desc(), "term")
    rarest = asked.withColumn("i", F.row_number().over(by_weight)).where(F.col("i") <= RAREST)
    partial = rarest.select("qid", "term").join(index, "term").groupBy("qid", key).agg(F.sum("w").alias("s"))
    at = Window.partitionBy("qid").orderBy(F.col("s").desc())
    floor = partial.withColumn("i", F.row_number().over(at)).where(F.col("i") == k).select("qid", F.col("s").alias("floor"))
    light = Window.partitionBy("qid").orderBy("most", F.desc("term")).rowsBetween(Window.unboundedPreceding, 0)
    needed = asked.withColumn("mass", F.sum("most").over(light)).join(floor, "qid", "left").where(F.col("floor").isNull() | (F.col("mass") >= F.col("floor") - 1e-6))
    candidates = needed.select("qid", "term").join(index.select(key, "term"), "term").select("qid", key).distinct()
    words = asked.select("qid", "term")
    full = candidates.join(words, "qid").join(index, [key, "term"]).groupBy("qid", key).agg(F.round(F.sum("w"), 6).alias("score"))
    ranked = full.withColumn("r", F.rank().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), key)))
    return ranked.where(F.col("r") <= k).drop("r")


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda acc, z: acc + z)

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def dense(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(qid, key, score): the k nearest by cosine, exact. ``queries`` (qid, qvec) are a stated set run in one block
    against all vectors; each partition keeps k per query before the shuffle."""
    pairs = vectors.select(key, vector).join(queries.select("qid", "qvec"), F.lit(True))
    s = pairs.select("qid", key, F.round(cosine(F.col("qvec"), F.col(vector)), 6).alias("score"))
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), key)
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")


def concept_channel(query_concepts: DataFrame, doc_concepts: DataFrame, key: str) -> DataFrame:
    """(qid, key, score): cosine of concept sets weighted by idf, never under 0.1. Inputs (qid, concept), (key, concept)."""
    d = doc_concepts.select(key, "concept").distinct()
    total = d.agg(F.count_distinct(key).cast("double").alias("total"))
    df = d.groupBy("concept").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.log(F.col("total") / F.col("df")), F.lit(S.IDF_FLOOR))
    df = df.join(F.broadcast(total))
    w = d.join(df, "concept").select(key, "concept", idf.alias("w"))
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("dn"))
    q = query_concepts.select("qid", "concept").distinct().join(df, "concept", "left").select("qid", "concept", F.coalesce(idf, F.lit(S.IDF_FLOOR)).alias("qw"))
    qn = q.groupBy("qid").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
    dots = q.join(w, "concept").groupBy("qid", key).agg(F.sum(F.col("qw") * F.col("w")).alias("dot"))
    return dots.join(norm, key).join(qn, "qid").select("qid", key, F.round(F.col("dot") / (F.col("dn") * F.col("qn")), 6).alias("score"))


def channel(hits: DataFrame, name: str, key: str) -> DataFrame:
    """Hits with their channel and rank, best first, ties by key."""
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), key)
    return hits.select("qid", F.col(key).alias("key"), "score", F.lit(name).alias("channel"), F.row_number().over(w).alias("rank"))


def rrf(channels: Sequence[DataFrame], weights: dict[str, float] | None = None, k: int = S.RRF_K) -> DataFrame:
    """(qid, key, fused, ranks): the sum of weight / (60 + rank) over the channels, and the rank in each."""
    every = channels[0]
    for c in channels[1:]:
        every = every.unionByName(c)
    w = F.lit(1.0)
    for name, v in (weights or {}).items():
        w = F.when(F.col("channel") == name, F.lit(float(v))).otherwise(w)
    return every.groupBy("qid", "key").agg(
        F.round(F.sum(w / (F.lit(k) + F.col("rank"))), 6).alias("fused"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "rank")))).alias("ranks")
    )


def max_merge(lists: Sequence[DataFrame]) -> DataFrame:
    """(qid, key, score): the best score of a key over several lists."""
    every = lists[0]
    for x in lists[1:]:
        every = every.unionByName(x)
    return every.groupBy("qid", "key").agg(F.max("score").alias("score"))


def allowed(rank: Column, source: Column, most: int, entitled: Sequence[str], labels: Column | None = None, any_label: Sequence[str] = (), modality: Column | None = None, modalities: Sequence[str] = ()) -> Column:
    """The retrieval filter: licence, any of the labels, one of the modalities."""
    from mossbrook.operators.access import permits

    out = permits(rank, source, most, 1, entitled)
    if any_label and labels is not None:
        out = out & F.coalesce(F.arrays_overlap(labels, F.array(*map(F.lit, any_label))), F.lit(False))
    if modalities and modality is not None:
        out = out & F.coalesce(modality.isin(*modalities), F.lit(False))
    return out


def hydrate(hits: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Hits with their stored row, ``joined`` says whether there is one; the store's latest row per key."""
    one = store.groupBy(key).agg(F.max(F.struct("at", *[c for c in store.columns if c not in (key, "at")])).alias("r"))
    return hits.join(one, key, "left").select(hits["*"], *[F.col(f"r.{c}").alias(c) for c in store.columns if c not in (key, "at")], F.col("r").isNotNull().alias("joined"))


def known_only(hits: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Hits whose key is in the store."""
    return hits.join(store.select(key).distinct(), key, "left_semi")


def rewrite(queries: DataFrame, expansions: DataFrame, most: int = 8, least: float = 0.35) -> DataFrame:
    """(qid, original, rewritten): the query with up to ``most`` expansion terms (qid, term, weight) it doesn't hold yet, the
    heaviest first."""
    j = expansions.where(F.col("weight") >= least).join(queries, "qid").where(~F.contains(F.lower("query"), F.lower("term")))
    best = j.groupBy("qid").agg(F.array_sort(F.collect_set(F.struct((-F.col("weight")).alias("w"), "term"))).alias("t"))
    terms = F.transform(F.slice("t", 1, most), lambda x: x["term"])
    return queries.join(best, "qid", "left").select("qid", F.col("query").alias("original"), F.concat_ws(" ", "query", F.coalesce(terms, F.array().cast("array<string>"))).alias("rewritten"))


def rerank(fused: DataFrame, scores: DataFrame) -> DataFrame:
    """The fused list in the order of the reranker's score (qid, key, rerank), unscored ones last, then as before."""
    w = Window.partitionBy("qid").orderBy(F.col("rerank").desc_nulls_last(), F.col("fused").desc(), "key")
    return fused.join(scores, ["qid", "key"], "left").withColumn("rank", F.row_number().over(w))


def snippet(c: Column) -> Column:
    return F.substring(c, 1, S.SNIPPET_CHARS)
