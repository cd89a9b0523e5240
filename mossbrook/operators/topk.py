"""Ranking with a total order, so that results don't depend on row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Adds 1, 2, ... within ``by``; ``order`` must end in a column that tells rows apart."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark filters before the shuffle (a window group limit)."""
    return ranked(df, by, order, name).where(F.col(name) <= k)


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key, the greatest by ``order``: a partial aggregate, so hot keys combine before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    picked = df.groupBy(*key).agg(F.max(F.struct(*[F.col(o).alias(f"__o{i}") for i, o in enumerate(order)], *rest)).alias("r"))
    return picked.select(*key, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*df.columns)
