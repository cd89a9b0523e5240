"""Facts from text and tables, merged and checked for conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mossbrook import schema as S
from mossbrook.functions import text as X

# Relation patterns, (predicate, words a match holds, pattern with subject and object as groups 1 and 2).
_EN, _ZH = r"[^,.;:()\[\]]{1,60}", r"[^，。；、（）]{1,40}"
PATTERNS = (
    ("received", " received ", rf"({_EN}) received (\S{{2,40}}) "),
    ("stopped", " stopped ", rf"({_EN}) stopped (\S{{2,40}}) "),
    ("loss_of", "Loss of ", rf"(Loss) of ({_EN}?) (?:\S+ )?(?:the|a|any|its|each|most|this) "),
    ("given_with", " was given with ", r"when (\S{2,40}) was given with (\S{2,40}) "),
    ("treated_with", "接受", rf"({_ZH})接受({_ZH}?)治疗"),
)
NEGATED = r"(?i)(^|[^\p{L}])(no|not|neither|without evidence|did not|未见|没有)([^\p{L}]|$)"


def extract(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, sentence_no, predicate, subject, object, negated, confidence) of every pattern in every sentence."""
    s = texts.select(key, F.posexplode(X.sentences(F.col("text"))).alias("sentence_no", "s"))
    kinds = F.array_compact(F.array(*[F.when(F.contains("s", F.lit(w)), F.lit(p)) for p, w, _ in PATTERNS]))
    hits = s.select(key, "sentence_no", "s", F.explode(kinds).alias("predicate"))

    def group(k: int) -> Column:
        out = F.lit("")
        for p, _, r in PATTERNS:
            out = F.when(F.col("predicate") == p, F.trim(F.regexp_extract("s", r, k))).otherwise(out)
        return out

    rows = hits.withColumn("object", group(2)).where(F.col("object") != "").withColumn("subject", group(1))
    return rows.select(key, "sentence_no", "predicate", "subject", "object", F.col("s").rlike(NEGATED).alias("negated"), F.lit(0.72).alias("confidence"))


def merge(facts: DataFrame) -> DataFrame:
    """One row per (subject, predicate, object): its documents, and the best confidence plus 0.05 for every further
    document, at most 0.97. The closed form, so repeats in a document change nothing."""
    per = facts.groupBy("subject", "predicate", "object", "doc_id").agg(F.max("confidence").alias("confidence"))
    g = per.groupBy("subject", "predicate", "object").agg(F.count(F.lit(1)).alias("docs"), F.max("confidence").alias("c"), F.min("doc_id").alias("first_doc"))
    conf = F.least(F.lit(S.MERGE_CAP), F.col("c") + S.MERGE_STEP * (F.col("docs") - 1))
    return g.select("subject", "predicate", "object", "docs", "first_doc", F.round(conf, 6).alias("confidence"))


def value_conflicts(facts: DataFrame, by: list[str], value: str) -> DataFrame:
    """Groups with more than one distinct value: their number and range."""
    g = facts.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count_distinct(value).alias("values"), F.min(value).alias("low"), F.max(value).alias("high"))
    return g.where("values > 1")


def spread_conflicts(facts: DataFrame, by: list[str], value: Column, spread: float = S.SPREAD) -> DataFrame:
    """Groups of two or more parsed values with |high - low| / |high| at or over ``spread``; high mustn't be 0."""
    g = facts.withColumn("v", value).where(F.col("v").isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    rel = F.abs(F.col("high") - F.col("low")) / F.abs("high")
    return g.where((F.col("n") >= 2) & (F.col("high") != 0)).withColumn("relative_spread", F.round(rel, 6)).where(rel >= spread)


def claims(facts: DataFrame) -> DataFrame:
    """Governed claims of facts (doc_id, subject, predicate, object), all 'extracted'; ids as in the lake."""
    c = facts.select("doc_id", "subject", "predicate", "object").distinct()
    claim = X.id_hash("KC:", F.col("subject"), F.col("predicate"), F.col("object"), F.col("doc_id"))
    return c.select(claim.alias("claim_id"), "doc_id", "subject", "predicate", "object", F.lit("extracted").alias("claim_status"))


def claims_about(all_claims: DataFrame, entities: DataFrame, predicate: str | None = None, hidden: bool = True) -> DataFrame:
    """Claims with an entity (column entity) at either end: two equi-joins instead of an OR."""
    c = all_claims if predicate is None else all_claims.where(F.col("predicate") == predicate)
    c = c.where("claim_status <> 'extracted'") if hidden else c
    e = entities.select("entity").distinct()
    a = c.join(e, c["subject"] == e["entity"], "left_semi")
    b = c.join(e, c["object"] == e["entity"], "left_semi")
    return a.unionByName(b).dropDuplicates(["claim_id"])


def table_cells(tables: DataFrame) -> DataFrame:
    """(node_id, row_no, row_key, header, value) of tables written row by row with | between cells; a row with another
    number of cells than the header pairs as far as both go."""
    rows = F.split("content", "\n")
    cells = tables.where(F.length("content") > 0).select("node_id", F.split(rows[0], r" \| ").alias("h"), F.posexplode(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))).alias("row_no", "r"))
    pairs = cells.select("node_id", "row_no", F.split("r", r" \| ").alias("c"), "h").select("node_id", "row_no", F.col("c")[0].alias("row_key"), F.explode(F.arrays_zip("h", "c")).alias("z"))
    return pairs.select("node_id", "row_no", "row_key", F.trim("z.h").alias("header"), F.trim("z.c").alias("value")).where(F.col("header").isNotNull() & F.col("value").isNotNull())


def table_facts(cells: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Cells whose header is a metric (header, metric, unit), case aside, with the number in the cell; 0.85 sure."""
    v = vocabulary.select(F.lower(F.trim("header")).alias("k"), "metric", "unit")
    n = F.expr("try_cast(regexp_extract(value, '-?[0-9]+(?:\\\\.[0-9]+)?', 0) AS double)")
    return cells.join(v, F.lower("header") == F.col("k")).withColumn("number", n).where(F.col("number").isNotNull()).select("node_id", "row_no", "row_key", "metric", "unit", "number", F.lit(0.85).alias("confidence"))


def mention_pairs(mentions: DataFrame, most: int = 1) -> DataFrame:
    """Ordered pairs of mentions (doc_id, sentence_no, place, entity, kind) of different kinds, at most ``most`` sentences
    apart. Each mention is spread over the sentences it can reach, so the join is an equi-join on (doc, sentence)."""
    a = mentions.select("doc_id", F.explode(F.sequence(F.col("sentence_no"), F.col("sentence_no") + most)).alias("s"), F.col("sentence_no").alias("s1"), F.col("entity").alias("e1"), F.col("kind").alias("k1"), F.col("place").alias("p1"))
    b = mentions.select("doc_id", F.col("sentence_no").alias("s"), F.col("entity").alias("e2"), F.col("kind").alias("k2"), F.col("place").alias("p2"))
    j = a.join(b, ["doc_id", "s"]).where((F.col("k1") != F.col("k2")) & ((F.col("s1") < F.col("s")) | (F.col("p1") < F.col("p2"))))
    return j.select("doc_id", F.col("s1").alias("first_sentence"), F.col("s").alias("second_sentence"), F.col("e1").alias("first"), F.col("e2").alias("second")).distinct()


def triple_scores(predicted: DataFrame, gold: DataFrame, by: list[str]) -> DataFrame:
    """Micro precision, recall and F1 of predicted against gold triples, by a null-safe full outer join of distinct rows."""
    p = predicted.select(*by).distinct().withColumn("p", F.lit(1))
    g = gold.select(*by).distinct().withColumn("g", F.lit(1))
    j = p.join(g, by, "full_outer").agg(F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    prec, rec = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
    return j.select("tp", "fp", "fn", F.round(prec, 6).alias("precision"), F.round(rec, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def conflict_tags(facts: DataFrame, by: list[str], value: str) -> DataFrame:
    """Every fact with the number of distinct values of its group, by joining the group's count back."""
    n = facts.groupBy(*by).agg(F.count_distinct(value).alias("values"))
    return facts.join(n, by).withColumn("in_conflict", F.col("values") > 1)


def latest_claim(c: DataFrame) -> DataFrame:
    w = Window.partitionBy("claim_id").orderBy(F.col("claim_status").desc())
    return c.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
