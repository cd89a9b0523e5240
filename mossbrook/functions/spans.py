"""Candidate spans of texts and greedy dictionary tagging."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mossbrook.functions import text as X


def windows(c: Column, most: int = 4) -> Column:
    """Distinct runs of 1 to ``most`` words, longest first, then by spelling."""
    w = F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}][\p{L}\p{N}\-]*"), F.lit(0))
    n = F.size(w)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.transform(F.sequence(F.lit(1), F.lit(most)), lambda k: F.when(i + k - 1 <= n, F.array_join(F.slice(w, i, k), " ")))))
    keyed = F.transform(F.array_distinct(F.array_compact(runs)), lambda s: F.struct((-F.length(s)).alias("l"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x["s"])


def occurrences(texts: DataFrame, words: DataFrame, key: str, most: int = 4) -> DataFrame:
    """(key, start, size, span, concept_id) of every run of words that the dictionary (alias_norm, concept_id) has.

    Runs are joined by their key, so the dictionary may be of any size; start counts words."""
    w = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}][\p{L}\p{N}\-]*"), F.lit(0))
    t = texts.select(key, w.alias("w")).where(F.size("w") > 0)
    at = t.select(key, "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("start")).select(key, "w", "start", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("size"))
    s = at.where(F.col("start") + F.col("size") - 1 <= F.size("w")).select(key, "start", "size", F.array_join(F.slice("w", F.col("start"), F.col("size")), " ").alias("span"))
    return s.withColumn("alias_norm", X.ascii_key(F.col("span"))).join(words.select("alias_norm", "concept_id"), "alias_norm").select(key, "start", "size", "span", "concept_id").distinct()


def longest_first(found: DataFrame, key: str) -> DataFrame:
    """Of overlapping occurrences the longest, then the first, takes its words; concepts of one span stay together.

    The occurrences of one text are read in one order by an Arrow batch of its group; a text bounds the group."""
    schema = found.select(key, "start", "size", "span", "concept_id").schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: set[int] = set()
        keep = []
        for (start, size), g in sorted(pdf.groupby(["start", "size"]), key=lambda x: (-x[0][1], x[0][0])):
            own = set(range(start, start + size))
            if not own & taken:
                taken |= own
                keep.append(g)
        return pd.concat(keep) if keep else pdf.iloc[:0]

    return found.select(*schema.names).groupBy(key).applyInPandas(run, schema)


def maximal(found: DataFrame, key: str) -> DataFrame:
    """Occurrences that no other one contains: the longest per start, then those that end after all before them."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("start", F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    one = found.groupBy(key, "start").agg(F.max("size").alias("size"))
    end = F.col("start") + F.col("size")
    kept = one.withColumn("reach", F.max(end).over(w)).where(F.col("reach").isNull() | (end > F.col("reach"))).drop("reach")
    return found.join(kept, [key, "start", "size"], "left_semi")


