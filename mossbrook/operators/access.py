"""Licence tiers: one predicate for every path, and the policies of the tiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tier, exportable, trainable, attribution, share-alike, entitlement.
POLICIES = (
    ("TIER_0", True, True, False, False, False),
    ("TIER_1", True, False, True, True, False),
    ("TIER_2", False, False, True, False, True),
    ("TIER_3", False, False, True, False, True),
)
STRICTEST = 3


def rank_of(tier: Column) -> Column:
    """0 to 3; a missing or unknown tier is the strictest."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for i, p in enumerate(POLICIES) for x in (p[0], i)]), tier), F.lit(STRICTEST))


def permits(rank: Column, source: Column, most: int, open_rank: int = 1, entitled: Sequence[str] = ()) -> Column:
    """Within the caller's tier, and open or of a source the caller is entitled to. Never null."""
    return (rank <= most) & ((rank <= open_rank) | F.coalesce(source.isin(*entitled) if entitled else F.lit(False), F.lit(False)))


def guarded(df: DataFrame, most: int, open_rank: int = 1, entitled: Sequence[str] = (), tier: str = "license_tier", source: str = "source") -> DataFrame:
    """The rows that ``permits`` lets through, with their ``license_rank``."""
    return df.withColumn("license_rank", rank_of(F.col(tier))).where(permits(F.col("license_rank"), F.col(source), most, open_rank, entitled))


def filtered_count(df: DataFrame, by: list[str], most: int, open_rank: int = 1, entitled: Sequence[str] = ()) -> DataFrame:
    """Per group, all rows and those the predicate keeps back."""
    allowed = permits(rank_of(F.col("license_tier")), F.col("source"), most, open_rank, entitled)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(~allowed).alias("filtered"))


def gate(df: DataFrame, by: list[str], most: int) -> DataFrame:
    """After fetching: rows kept, rows dropped and the strictest tier kept, per group."""
    rank = rank_of(F.col("license_tier"))
    return df.groupBy(*by).agg(F.count_if(rank <= most).alias("kept"), F.count_if(rank > most).alias("dropped"), F.max(F.when(rank <= most, rank)).alias("strictest_kept"))


def assert_no_leak(df: DataFrame, most: int) -> DataFrame:
    """The rows, or a failure of the job as soon as one of them is over the caller's tier."""
    bad = rank_of(F.col("license_tier")) > most
    return df.withColumn("license_tier", F.when(bad, F.raise_error(F.lit("a row over the permitted tier would leave"))).otherwise(F.col("license_tier")))


def policies(spark) -> DataFrame:
    return spark.createDataFrame(list(POLICIES), "license_tier string, exportable boolean, trainable boolean, attribution boolean, share_alike boolean, entitlement boolean")


def visible_sources(docs: DataFrame, entitled: Sequence[str]) -> DataFrame:
    """(source, license_rank) of the sources, by their strictest document, that are open or entitled."""
    s = docs.where(F.col("source").isNotNull()).groupBy("source").agg(F.max(rank_of(F.col("license_tier"))).alias("license_rank"))
    return s.where((F.col("license_rank") <= 1) | F.col("source").isin(*entitled))
