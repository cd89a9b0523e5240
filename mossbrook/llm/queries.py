"""The queries pN_... of the training-data operators and the SQL that says the same, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mossbrook.llm import canonical, leakage, lookalike, mixing, ocr, splitting, toxicity


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The kinds of damage in each node."""
    return ocr.found(_t(spark, d, "tree_nodes"))


def p1_repaired(spark: SparkSession, d: str) -> DataFrame:
    """The paragraphs as continuous text."""
    return ocr.repaired(_t(spark, d, "tree_nodes"))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every oversized node."""
    return splitting.split_oversized(_t(spark, d, "tree_nodes"), _t(spark, d, "chunk_limits"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The nodes that were cut."""
    return p3_pieces(spark, d).where(F.col("node_id").isNotNull()).select("node_id").distinct()


def p3_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """Every cut node put together again from its pieces, and whether they fit and overlap as they must."""
    limits = _t(spark, d, "chunk_limits").groupBy("node_kind").agg(F.min("max_chars").alias("most"), F.min("overlap_chars").alias("overlap"))
    pieces = F.array_sort(F.collect_list(F.struct("piece_no", "start_char", "end_char", "content")))
    p = p3_pieces(spark, d).join(limits, "node_kind").groupBy("node_id", "most", "overlap").agg(pieces.alias("p"), F.max("piece_count").alias("pieces"))
    empty = F.struct(F.lit("").alias("text"), F.lit(0).alias("end"), F.lit(True).alias("ok"))

    def add(acc, x):
        start = F.when(x["piece_no"] == 1, F.lit(0)).otherwise(acc["end"] - F.col("overlap"))
        fits = (x["start_char"] == start) & (F.length(x["content"]) <= F.col("most")) & (F.length(x["content"]) == x["end_char"] - x["start_char"])
        return F.struct(F.concat(acc["text"], F.substring(x["content"], acc["end"] - x["start_char"] + 1, F.length(x["content"]))).alias("text"), x["end_char"].alias("end"), (acc["ok"] & fits).alias("ok"))

    whole = p.withColumn("w", F.aggregate("p", empty, add))
    return whole.select("node_id", F.col("w.text").alias("content"), (F.col("w.ok") & (F.size("p") == F.col("pieces"))).alias("fits"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose values look the same without any being the same."""
    mentions = lookalike.value_rows(_t(spark, d, "zingg_matches"), "match_id", ["mention"], [])
    concepts = lookalike.value_rows(_t(spark, d, "bios_subset"), "bios_id", ["preferred_term"], ["terms"])
    return lookalike.same_look_pairs(mentions, concepts)


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct value with what it looks like and its form for comparisons."""
    mentions = lookalike.value_rows(_t(spark, d, "zingg_matches"), "match_id", ["mention"], [])
    concepts = lookalike.value_rows(_t(spark, d, "bios_subset"), "bios_id", ["preferred_term"], ["terms"])
    values = mentions.unionByName(concepts).select("value").distinct()
    return values.select("value", lookalike.look("value").alias("look"), lookalike.canonical("value").alias("form"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The concept each mention means."""
    return canonical.map_mentions(_t(spark, d, "zingg_matches"), _t(spark, d, "bios_subset")).select("match_id", "bios_id")


def p5_matches(spark: SparkSession, d: str) -> DataFrame:
    """The same with the edits and the similarity of the match."""
    return canonical.map_mentions(_t(spark, d, "zingg_matches"), _t(spark, d, "bios_subset"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the items they leak."""
    return leakage.leaks(_t(spark, d, "documents"), _t(spark, d, "eval_items")).select("doc_id", "item_id")


def p6_alignments(spark: SparkSession, d: str) -> DataFrame:
    """The leaks with where and how well they align."""
    return leakage.leaks(_t(spark, d, "documents"), _t(spark, d, "eval_items"))


def p7_records(spark: SparkSession, d: str) -> DataFrame:
    """The records of the mixture with the number of times each is used."""
    return mixing.mixture(_t(spark, d, "documents"), _t(spark, d, "mix_targets"))[0]


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual shares by source."""
    return mixing.mixture(_t(spark, d, "documents"), _t(spark, d, "mix_targets"))[1]


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.scores(_t(spark, d, "documents"), _t(spark, d, "content_labels"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the categories of harmful language they hold."""
    return toxicity.flagged(_scores(spark, d))


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every document's scores and evidence."""
    return _scores(spark, d)


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates per source."""
    return toxicity.rates(_scores(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_repaired, p3_found, p3_pieces, p3_rejoined, p4_found, p4_forms, p5_found, p5_matches, p6_found, p6_alignments, p7_records, p7_report, p8_found, p8_scores, p8_rates)
}

def _look_sql(value: str) -> str:
    """The look of a value in SQL: one character for one by ``translate``, by the rule of ``lookalike``; then what becomes several."""
    chars = [(c, lookalike.one_form(f".{c}.", keep_runs=True)[1:-1]) for c in map(chr, [*range(0x80, 0xD800), *range(0xF900, 0x10000)])]
    single = [(c, r) for c, r in chars if len(r) == 1 and r != c]
    gone = "".join(c for c, r in chars if not r)
    several = [(c, r) for c, r in chars if len(r) > 1 and (0xFB00 <= ord(c) <= 0xFB06 or 0x2160 <= ord(c) <= 0x217F)]
    old, new = ("".join(pair[k] for pair in single).replace("'", "\'\'") for k in (0, 1))
    sql = f"translate({value}, '{old}{gone}', '{new}')"
    for c, r in several:
        sql = f"replace({sql}, '{c}', '{r}')"
    return f"nfc_normalize(trim({sql}))"


ORACLES: dict[str, str] = {
    "p3_rejoined": """
        SELECT DISTINCT n.node_id, n.content, true AS fits FROM tree_nodes n
        JOIN (SELECT node_kind, min(max_chars) AS max_chars FROM chunk_limits WHERE max_chars > 0 GROUP BY 1) l ON n.node_kind = l.node_kind
        WHERE length(n.content) > l.max_chars
    """,
    "p4_found": f"""
        WITH named AS (
            SELECT bios_id AS id, unnest(list_append(coalesce(terms, []), preferred_term)) AS value FROM bios_subset WHERE bios_id IS NOT NULL
        ), kept AS (
            SELECT DISTINCT id, value, true AS concept FROM named WHERE trim(value) <> ''
            UNION
            SELECT DISTINCT match_id, mention, false FROM zingg_matches WHERE match_id IS NOT NULL AND trim(mention) <> ''
        ), looks AS MATERIALIZED (SELECT id, value, concept, {_look_sql("value")} AS look FROM kept)
        SELECT least(a.id, b.id) AS id_1, greatest(a.id, b.id) AS id_2
        FROM looks a JOIN looks b ON a.look = b.look AND b.concept AND (NOT a.concept OR a.id < b.id)
        WHERE a.look <> '' AND a.id <> b.id
        GROUP BY 1, 2 HAVING NOT bool_or(a.value = b.value)
    """,
    "p3_found": """
        SELECT DISTINCT n.node_id FROM tree_nodes n
        JOIN (SELECT node_kind, min(max_chars) AS max_chars FROM chunk_limits WHERE max_chars > 0 GROUP BY 1) l
          ON n.node_kind = l.node_kind
        WHERE length(n.content) > l.max_chars AND n.node_id IS NOT NULL
    """,
}
