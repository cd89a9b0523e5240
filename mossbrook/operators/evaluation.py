"""Retrieval metrics, slices, targets and significance."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mossbrook import schema as S


def per_query(ranked: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """(arm, qid, recall, p5, ndcg, rr, ap) of ranked lists (arm, qid, key, rank) against gold (qid, key, grade).

    Strict: hits without a grade keep their rank. Gains are cut at k on both sides, so nDCG never exceeds 1."""
    g = gold.where(F.col("grade") > 0).groupBy("qid", "key").agg(F.max("grade").alias("grade"))
    wg = Window.partitionBy("qid").orderBy(F.col("grade").desc(), "key")
    ideal = g.withColumn("r", F.row_number().over(wg)).groupBy("qid").agg(F.count(F.lit(1)).alias("relevant"), F.sum(F.when(F.col("r") <= k, F.col("grade") / F.log2(F.col("r") + 1))).alias("idcg"))
    x = ranked.where(F.col("rank") <= k).join(g, ["qid", "key"], "left")
    hit = F.col("grade").isNotNull()
    w = Window.partitionBy("arm", "qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("hit", hit.cast("int")).withColumn("found", F.sum(hit.cast("int")).over(w))
    m = x.groupBy("arm", "qid").agg(
        F.sum("hit").alias("hits"), F.sum(F.when(F.col("rank") <= 5, F.col("hit")).otherwise(0)).alias("h5"), F.coalesce(F.sum(F.when(hit, F.col("grade") / F.log2(F.col("rank") + 1))), F.lit(0.0)).alias("dcg"),
        F.min(F.when(hit, F.col("rank"))).alias("first"), F.coalesce(F.sum(F.when(hit, F.col("found") / F.col("rank"))), F.lit(0.0)).alias("precisions"),
    )
    j = m.join(ideal, "qid")
    return j.select(
        "arm", "qid", F.round(F.col("hits") / F.col("relevant"), 6).alias("recall"), F.round(F.col("h5") / 5, 6).alias("p5"), F.round(F.col("dcg") / F.col("idcg"), 6).alias("ndcg"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr"), F.round(F.col("precisions") / F.least(F.col("relevant"), F.lit(k)), 6).alias("ap"),
    )


METRICS = ("recall", "p5", "ndcg", "rr", "ap")


def slices(scores: DataFrame, dims: list[str]) -> DataFrame:
    """Means per arm over everything and over every value of each dimension: grouping sets, in one pass."""
    name, value = F.lit("all"), F.lit("")
    for d in reversed(dims):
        name = F.when(F.grouping(d) == 0, F.lit(d)).otherwise(name)
        value = F.when(F.grouping(d) == 0, F.coalesce(F.col(d).cast("string"), F.lit(""))).otherwise(value)
    sets = [["arm"], *(["arm", d] for d in dims)]
    sums = [F.round(F.avg(m), 6).alias(m) for m in METRICS]
    every = scores.groupingSets(sets, "arm", *dims).agg(name.alias("slice"), value.alias("value"), F.count(F.lit(1)).alias("queries"), *sums)
    return every.select("arm", "slice", "value", "queries", *METRICS)


def deltas(scores: DataFrame, target: str, baseline: str) -> DataFrame:
    """(qid, metric deltas) of the queries that both arms ran."""
    a, b = scores.where(F.col("arm") == target).alias("a"), scores.where(F.col("arm") == baseline).alias("b")
    return a.join(b, F.col("a.qid") == F.col("b.qid")).select(F.col("a.qid").alias("qid"), *[F.round(F.col(f"a.{m}") - F.col(f"b.{m}"), 6).alias(m) for m in METRICS])


SIGNIFICANCE = "metric string, n int, delta double, low double, high double, p double"


def paired(diffs: list[float], resamples: int, seed: int) -> tuple[float, float, float, float]:
    """(mean, low, high, p) of paired differences: bootstrap interval and sign-flip test, in that order from one generator."""
    n = len(diffs)
    if not n:
        return 0.0, 0.0, 0.0, 1.0
    mean = sum(diffs) / n
    draw = random.Random(seed)
    means = sorted(sum(diffs[draw.randrange(n)] for _ in range(n)) / n for _ in range(resamples))
    if not any(diffs):
        return 0.0, 0.0, 0.0, 1.0
    as_far = sum(abs(sum(d if draw.random() < 0.5 else -d for d in diffs) / n) >= abs(mean) for _ in range(resamples))
    return mean, means[int(0.025 * (resamples - 1))], means[int(0.975 * (resamples - 1))], (as_far + 1) / (resamples + 1)


def significance(delta: DataFrame, resamples: int = S.SIGNIFICANCE_RESAMPLES, seed: int = S.SIGNIFICANCE_SEED) -> DataFrame:
    """One row per metric; the differences of one metric, one per judged query, meet in one task."""
    long = delta.select("qid", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("d")) for m in METRICS])).alias("x")).select("qid", "x.*")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.sort_values("qid")["d"].tolist()
        mean, low, high, p = paired(d, resamples, seed)
        return pd.DataFrame([(pdf["metric"].iloc[0], len(d), round(mean, 6), round(low, 6), round(high, 6), round(p, 6))], columns=["metric", "n", "delta", "low", "high", "p"])

    return long.groupBy("metric").applyInPandas(run, SIGNIFICANCE)


def outcomes(values: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets (id, metric, comparison, threshold, baseline, waived) against values (metric, value): met or not."""
    j = targets.join(values, "metric", "left").join(values.select(F.col("metric").alias("baseline"), F.col("value").alias("base")), "baseline", "left")
    ok = (
        F.when(F.col("comparison") == "at_least", F.col("value") >= F.col("threshold"))
        .when(F.col("comparison") == "absolute_gain", F.round(F.col("value") - F.col("base"), 6) >= F.col("threshold"))
        .when(F.col("comparison") == "relative_gain", F.round(F.col("value") / F.col("base") - 1, 6) >= F.col("threshold"))
        .otherwise(F.round(F.col("base") - F.col("value"), 6) <= F.col("threshold"))
    )
    met = F.coalesce(ok, F.lit(False))
    return j.select("id", "metric", "comparison", met.alias("met"), (met | F.col("waived")).alias("passed"))


def probe_average(scores: DataFrame, probes: list[str]) -> DataFrame:
    """(arm, queries, metrics): means over all queries of the named probes together, each query once, not means of means."""
    x = scores.where(F.col("probe").isin(*probes)).dropDuplicates(["arm", "qid"])
    return x.groupBy("arm").agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(m), 6).alias(m) for m in METRICS])


def judged(ranked: DataFrame, gold: DataFrame, judged_keys: DataFrame, k: int = 10) -> DataFrame:
    """(arm, qid, judged, ceiling): the share of the first k that anyone has judged (1 of nothing), and the recall k can reach."""
    seen = judged_keys.select("key").distinct().withColumn("j", F.lit(1))
    top = ranked.where(F.col("rank") <= k).join(seen, "key", "left")
    share = top.groupBy("arm", "qid").agg(F.round(F.avg(F.coalesce("j", F.lit(0))), 6).alias("judged"))
    relevant = gold.groupBy("qid").agg(F.count_distinct("key").alias("n"))
    reach = F.round(F.least(F.lit(k), F.col("n")) / F.col("n"), 6)
    return relevant.join(share, "qid", "left").select("arm", "qid", F.coalesce("judged", F.lit(1.0)).alias("judged"), reach.alias("ceiling"))


def citation_fidelity(claimed: DataFrame, truth: DataFrame) -> DataFrame:
    """(qid, fidelity): the share of what hits claim (qid, document, concept) that the corpus (document, concept) bears out; a claim
    without a concept holds if the document exists."""
    t = truth.where(F.col("concept").isNotNull()).select("document", "concept").distinct().withColumn("ok", F.lit(True))
    docs = truth.select("document").distinct().withColumn("there", F.lit(True))
    x = claimed.distinct().join(t, ["document", "concept"], "left").join(docs, "document", "left")
    good = F.when(F.col("concept").isNull(), F.coalesce("there", F.lit(False))).otherwise(F.coalesce("ok", F.lit(False)))
    return x.groupBy("qid").agg(F.round(F.avg(good.cast("double")), 6).alias("fidelity"))


def gold_sections(gold: DataFrame, sections: DataFrame, sep: str = " / ") -> DataFrame:
    """(document, section, alias, fallback): each gold section with the indexed section (document, alias) it means: itself, else its
    longest suffix, else the longest of its parts of three letters or more; null if nothing fits."""
    parts = F.filter(F.transform(F.split("section", sep), lambda p: F.trim(p)), lambda p: p != "")
    n = F.size("parts")
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct((i + 1).alias("order"), F.lit(0).alias("size"), F.array_join(F.slice("parts", i, n), sep).alias("alias")))
    single = F.transform(F.filter("parts", lambda p: F.length(p) >= 3), lambda p: F.struct(F.lit(1000).alias("order"), (-F.length(p)).alias("size"), p.alias("alias")))
    exact = F.array(F.struct(F.lit(0).alias("order"), F.lit(0).alias("size"), F.col("section").alias("alias")))
    each = gold.select("document", "section").distinct().withColumn("parts", parts).where(n > 0).select("document", "section", F.explode(F.concat(exact, suffixes, single)).alias("c")).select("document", "section", "c.*")
    best = each.join(sections.select("document", "alias").distinct(), ["document", "alias"]).groupBy("document", "section").agg(F.min(F.struct("order", "size", "alias")).alias("b"))
    return gold.select("document", "section").distinct().join(best, ["document", "section"], "left").select("document", "section", F.col("b.alias").alias("alias"), F.when(F.col("b").isNotNull(), F.col("b.order") > 0).alias("fallback"))


def bridge(cases: DataFrame, left: DataFrame, right: DataFrame, hits: DataFrame) -> DataFrame:
    """(mention, expect, same, found, passed): whether both sides (mention, id) name the expected id, and a search (mention) finds anything."""
    one = lambda df, name: df.groupBy("mention").agg(F.min("id").alias(name))
    n = hits.groupBy("mention").agg(F.count(F.lit(1)).alias("n"))
    x = cases.join(one(left, "l"), "mention", "left").join(one(right, "r"), "mention", "left").join(n, "mention", "left")
    same = F.coalesce((F.col("l") == F.col("expect")) & (F.col("r") == F.col("expect")), F.lit(False))
    found = F.coalesce("n", F.lit(0)) > 0
    return x.select("mention", "expect", same.alias("same"), found.alias("found"), (same & found).alias("passed"))


def latency_slices(scores: DataFrame, dims: list[str], value: str = "elapsed") -> DataFrame:
    """(arm, slice, value, queries, p50, p95): nearest-rank percentiles per slice, of the counts of equal values."""
    rows = [scores.select("arm", F.lit("all").alias("slice"), F.lit("").alias("value"), F.col(value).alias("x"))]
    rows += [scores.select("arm", F.lit(d).alias("slice"), F.coalesce(F.col(d).cast("string"), F.lit("")).alias("value"), F.col(value).alias("x")) for d in dims]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionAll(r)
    by = ["arm", "slice", "value"]
    counts = every.where(F.col("x").isNotNull()).groupBy(*by, "x").agg(F.count(F.lit(1)).alias("n"))
    upto = counts.withColumn("c", F.sum("n").over(Window.partitionBy(*by).orderBy("x"))).withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    at = lambda q: F.min(F.when(F.col("c") >= F.ceil(q * F.col("total")), F.col("x")))
    return upto.groupBy(*by).agg(F.max("total").alias("queries"), at(0.5).alias("p50"), at(0.95).alias("p95"))
