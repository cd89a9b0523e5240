"""Consistency rules, gates, percentiles, sampling, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mossbrook import schema as S


def issues(rule: str, rows: DataFrame, subject: str, severity: str = "block") -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), F.col(subject).cast("string").alias("subject"), F.lit(severity).alias("severity")).distinct()


def dangling_parents(nodes: DataFrame) -> DataFrame:
    """Nodes whose parent isn't a node."""
    ids = nodes.select(F.col("node_id").alias("parent_id")).distinct()
    return issues("dangling_parent", nodes.where(F.col("parent_id").isNotNull() & (F.col("parent_id") != "")).join(ids, "parent_id", "left_anti"), "node_id")


def orphans(nodes: DataFrame) -> DataFrame:
    """Top nodes that nothing hangs on."""
    parents = nodes.where(F.col("parent_id") != "").select(F.col("parent_id").alias("node_id")).distinct()
    return issues("orphan", nodes.where(F.coalesce("parent_id", F.lit("")) == "").join(parents, "node_id", "left_anti"), "node_id", "warn")


def without_evidence(claims: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    return issues("no_evidence", claims.join(evidence.select(key).distinct(), key, "left_anti"), key)


def downgrades(child: DataFrame, parent: DataFrame) -> DataFrame:
    """Children (id, group, rank) under a laxer licence than their group's strictest (group, rank)."""
    p = parent.groupBy("group").agg(F.max("rank").alias("strictest"))
    return issues("license_downgrade", child.join(p, "group").where(F.col("rank") < F.col("strictest")), "id")


def literal_edges(edges: DataFrame) -> DataFrame:
    """Links to something that isn't an identifier."""
    return issues("literal_edge", edges.where(~F.col("object").rlike(r"^[A-Za-z]+:.+")), "subject")


def report(rules: list[DataFrame]) -> DataFrame:
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out


def gate(current: DataFrame, previous: DataFrame, floor: float = S.ACCURACY_FLOOR, drop: float = S.REGRESSION_MOST) -> DataFrame:
    """(kind, accuracy, previous, blocked): under the floor, or lower than before by more than ``drop``. Inputs (kind, accuracy)."""
    j = current.join(previous.select("kind", F.col("accuracy").alias("previous")), "kind", "left")
    worse = F.coalesce(F.round(F.col("previous") - F.col("accuracy"), 6) > drop, F.lit(False))
    return j.select("kind", "accuracy", "previous", ((F.col("accuracy") < floor) | worse).alias("blocked"))


def nearest_rank(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact percentiles: the value at place round-half-even(p * (n - 1)) of each group, in order.

    Values are counted first; places come from running sums over the distinct values, so a hot group isn't collected
    into one row. Nulls don't count.
    """
    c = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    t = c.withColumn("upto", F.sum("n").over(w))
    total = c.groupBy(*by).agg(F.sum("n").alias("total"))
    j = t.join(total, by)
    cols = []
    for name, p in shares.items():
        place = F.bround(F.lit(p) * (F.col("total") - 1)) + 1
        cols.append(F.min(F.when(F.col("upto") >= place, F.col(value))).alias(name))
    return j.groupBy(*by).agg(F.max("total").alias("n"), *cols)


def stratified_sample(df: DataFrame, stratum: str, key: str, k: int, seed: int = S.SAMPLING_SEED) -> DataFrame:
    """k rows per stratum in the order of a seeded hash; the same rows on any cluster."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    w = Window.partitionBy(stratum).orderBy("h", key)
    return df.withColumn("h", h).withColumn("draw", F.row_number().over(w)).where(F.col("draw") <= k).drop("h")


def fingerprint(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """A fingerprint per group that any change of content changes and the order of rows doesn't: the sum of row hashes.

    A sum combines on the map side, where a hash over the sorted rows of a hot group wouldn't."""
    row = F.conv(F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("∅")) for c in cols]), 256), 1, 12), 16, 10).cast("decimal(20,0)")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.sum(row).cast("string").alias("fingerprint"))


def slo(snapshot: dict[str, float], limits: dict[str, float], spark) -> DataFrame:
    """(indicator, value, most, red) of an operations snapshot."""
    return spark.createDataFrame([(k, float(snapshot.get(k, 0.0)), float(v), snapshot.get(k, 0.0) > v) for k, v in limits.items()], "indicator string, value double, most double, red boolean")


def ingest_qa(docs: DataFrame, sources: list[str], most: float = 0.4) -> DataFrame:
    """(doc_id, degraded, reasons, accepted) of documents with four capabilities: text, title, language, study."""
    lost = [F.when(F.coalesce(F.trim(c), F.lit("")) == "", 1).otherwise(0) for c in ("text", "title", "lang", "study_id")]
    ratio = (lost[0] + lost[1] + lost[2] + lost[3]) / F.lit(4.0)
    reasons = F.array_compact(
        F.array(
            F.when(F.col("doc_id").isNull(), "no_id"), F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "no_chunks"), F.when(ratio > most, "degraded"),
            F.when(~F.coalesce(F.col("source").isin(*sources), F.lit(False)), "unregistered_source"), F.when(F.col("license_tier").isNull(), "no_tier"),
        )
    )
    return docs.select("doc_id", F.round(ratio, 6).alias("degraded"), F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("accepted"))


def structure(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row: the number of rows and the share of each check, in one pass."""
    return df.agg(F.count(F.lit(1)).alias("rows"), *[F.round(F.avg(c.cast("double")), 6).alias(n) for n, c in checks.items()])
