"""What is known about an entity: relations, evidence, bridges; and tolerant reading of model output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def related(claims: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity, other) of both ends of the claims (subject, object), without the entity itself."""
    ends = claims.select(F.col("subject").alias("entity"), F.col("object").alias("other")).union(claims.select("object", "subject"))
    return ends.where(F.col("entity") != F.col("other")).distinct().join(entities.select("entity").distinct(), "entity", "left_semi")


def evidence_for(evidence: DataFrame, claims: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity, evidence_id): evidence (evidence_id, entity_ids) that names the entity or that its claims (subject,
    evidence_id) cite: two equi-joins instead of an OR."""
    e = entities.select("entity").distinct()
    named = evidence.select("evidence_id", F.explode("entity_ids").alias("entity")).join(e, "entity", "left_semi")
    cited = claims.select(F.col("subject").alias("entity"), "evidence_id").join(e, "entity", "left_semi").join(evidence.select("evidence_id"), "evidence_id", "left_semi")
    return named.select("entity", "evidence_id").union(cited.select("entity", "evidence_id")).distinct()


def overlapping(rows: DataFrame, key: str, ids: str, wanted: DataFrame) -> DataFrame:
    """(key, hits): rows whose array holds any wanted id (column id), and how many."""
    each = rows.select(key, F.explode(F.array_distinct(ids)).alias("id")).join(wanted.select("id").distinct(), "id", "left_semi")
    return each.groupBy(key).agg(F.count_distinct("id").alias("hits"))


def bridges(concepts: DataFrame, pool: DataFrame) -> DataFrame:
    """(bios_id, enterprise_id): the enterprise ids of concepts that a cross-reference of the pool (external_id) names."""
    x = concepts.select("bios_id", F.explode("external_ids").alias("external_id")).distinct()
    hit = x.join(pool.select("external_id").distinct(), "external_id", "left_semi").select("bios_id").distinct()
    return x.where(F.col("external_id").startswith("HMD:ENT:")).join(hit, "bios_id", "left_semi").select("bios_id", F.col("external_id").alias("enterprise_id"))


def context_pack(entities: DataFrame, slots: dict[str, DataFrame]) -> DataFrame:
    """(entity, one count per slot, missing): which slots (entity, ...) of an entity's context are empty."""
    out = entities.select("entity").distinct()
    for name, df in slots.items():
        out = out.join(df.groupBy("entity").agg(F.count(F.lit(1)).alias(name)), "entity", "left")
    out = out.na.fill(0, list(slots))
    return out.withColumn("missing", F.array_join(F.array_compact(F.array(*[F.when(F.col(n) == 0, F.lit(n)) for n in slots])), ","))


def quantities(values: Column, most: int = 20, length: int = 80) -> Column:
    """Of a map of read-off values those that are a number with an optional unit; at most ``most`` of them, by name."""
    ok = F.map_filter(values, lambda k, v: v.rlike(r"^\s*[<>≤≥~]?\s*-?\d+(\.\d+)?\s*([%\p{L}/µ]+)?\s*$") & (F.length(k) <= length) & (F.length(v) <= length))
    return F.map_from_entries(F.slice(F.array_sort(F.map_entries(ok)), 1, most))


def tolerant_json(c: Column, schema: str) -> Column:
    """JSON from a text that may have words around it: the text itself, else its widest part in braces."""
    inner = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.from_json(F.when(inner != "", inner).otherwise(c), schema)


def adjudicated(items: DataFrame) -> DataFrame:
    """Adjudications (item_id, payload) checked: a verdict of the three, a confidence within 0 to 1; an unsure dismissal
    only pushes down, and what can't be read stays unclear."""
    p = tolerant_json(F.col("payload"), "verdict string, confidence double")
    x = items.withColumn("p", p)
    good = F.col("p.verdict").isin("keep", "dismiss", "unclear") & F.col("p.confidence").between(0.0, 1.0)
    verdict = F.when(F.coalesce(good, F.lit(False)), F.when((F.col("p.verdict") == "dismiss") & (F.col("p.confidence") < 0.6), "soft_downrank").otherwise(F.col("p.verdict"))).otherwise("unclear")
    return x.select("item_id", verdict.alias("verdict"), F.when(F.coalesce(good, F.lit(False)), F.col("p.confidence")).otherwise(0.0).alias("confidence"))


def accuracy(results: DataFrame, by: str) -> DataFrame:
    """Per kind the share of answers (expected, answered) that are right, nulls being answers too."""
    ok = F.col("expected").eqNullSafe(F.col("answered")).cast("double")
    return results.groupBy(by).agg(F.count(F.lit(1)).alias("cases"), F.round(F.avg(ok), 6).alias("accuracy"))
