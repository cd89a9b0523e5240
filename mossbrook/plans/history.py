"""Queries over the id ledger's history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mossbrook.operators import history as H


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{d}/concept_ids.parquet"), spark.read.parquet(f"{d}/releases.parquet")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The versions of each concept with the releases between which they were valid."""
    return H.attribute_history(*_tables(spark, d)).select("concept_id", "valid_from", "valid_to")


def p2_history(spark: SparkSession, d: str) -> DataFrame:
    """The versions with their state; members as text, one blank between them."""
    return H.attribute_history(*_tables(spark, d)).select(
        "concept_id", "version", "valid_from", "valid_to", F.array_join("members", " ").alias("members"), "is_obsolete"
    )


QUERIES = {"p2_found": p2_found, "p2_history": p2_history}

_VERSIONS = """
    WITH cal AS (SELECT release_id, row_number() OVER (ORDER BY released_at, release_id) AS o FROM releases WHERE release_id IS NOT NULL),
    named AS (SELECT *, regexp_replace(lower(trim(release_id)), '^(release[-_ ]?|v)', '') AS label FROM cal),
    loads AS (
        SELECT concept_id, n.o, n.release_id, c.created_in_release, c.is_obsolete,
               list_sort(list_distinct(members)) AS members,
               row_number() OVER (PARTITION BY concept_id, n.o ORDER BY loaded_at DESC) AS rn
        FROM concept_ids c JOIN named n ON regexp_replace(lower(trim(c.ledger_release)), '^(release[-_ ]?|v)', '') = n.label),
    carried AS (
        SELECT concept_id, o, release_id,
               last_value(members IGNORE NULLS) OVER w AS members,
               last_value(is_obsolete IGNORE NULLS) OVER w AS is_obsolete,
               first_value(created_in_release IGNORE NULLS) OVER (PARTITION BY concept_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS created
        FROM loads WHERE rn = 1
        WINDOW w AS (PARTITION BY concept_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    changes AS (
        SELECT *, row_number() OVER w AS k, lag(members) OVER w AS m0, lag(is_obsolete) OVER w AS b0
        FROM carried WINDOW w AS (PARTITION BY concept_id ORDER BY o)),
    kept AS (
        SELECT c.*, CASE WHEN k = 1 THEN coalesce(n.release_id, c.release_id) ELSE c.release_id END AS valid_from
        FROM changes c LEFT JOIN named n ON n.label = regexp_replace(lower(trim(c.created)), '^(release[-_ ]?|v)', '')
        WHERE k = 1 OR members IS DISTINCT FROM m0 OR is_obsolete IS DISTINCT FROM b0),
    versions AS (
        SELECT concept_id, CAST(row_number() OVER w AS INTEGER) AS version, valid_from,
               coalesce(lead(valid_from) OVER w, '') AS valid_to,
               array_to_string(members, ' ') AS members, is_obsolete
        FROM kept WINDOW w AS (PARTITION BY concept_id ORDER BY o))
"""
ORACLES = {
    "p2_found": _VERSIONS + "SELECT concept_id, valid_from, valid_to FROM versions",
    "p2_history": _VERSIONS + "SELECT concept_id, version, valid_from, valid_to, members, is_obsolete FROM versions",
}
