"""Mixing sources to target shares of tokens, with hierarchical budgets.

The tree is domain - language - source. Budgets run down from the root in proportion to the weights; what a node
can't use (its records times their highest number of uses) goes to its siblings first, and only what all siblings
together can't use reaches the ancestors' siblings. Each source then draws whole seeded epochs and a token-prefix of
one more, found with per-bucket sums, so that no source is ever sorted in one task.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mossbrook.session import cut_lineage

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
BUCKETS = 4096
BUDGET = "source string, domain string, language string, target_share double, budget double, available long, max_repeats int"


@lru_cache(maxsize=4)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """The input's (doc_id, source, lang, doc_type) with ``tokens``; a null text has 0."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        enc = _encoding(vocabulary)
        return texts.map(lambda t: 0 if not t else len(enc.encode_ordinary(t))).astype("int64")

    return docs.select("doc_id", "source", "lang", "doc_type", count("text").alias("tokens"))


def fill(total: float, weights: list[float], capacity: list[float]) -> list[float]:
    """Shares of ``total`` in proportion to the weights, none over its capacity; what one can't take goes to the rest."""
    out = [0.0] * len(weights)
    open_ = [i for i in range(len(weights)) if weights[i] > 0 and capacity[i] > 0]
    left = min(total, sum(capacity[i] for i in open_))
    while open_ and left > 1e-9:
        total_weight = sum(weights[i] for i in open_)
        part = {i: left * (weights[i] / total_weight) for i in open_}
        full = [i for i in open_ if out[i] + part[i] >= capacity[i] - 1e-9]
        if not full:
            for i in open_:
                out[i] += part[i]
            break
        for i in full:
            left -= capacity[i] - out[i]
            out[i] = capacity[i]
        open_ = [i for i in open_ if i not in full]
    return out


def _budgets(leaves: pd.DataFrame, total: float, path: list[str]) -> pd.Series:
    """The budget of every leaf, level by level along ``path``."""
    if leaves.empty:
        return pd.Series(dtype=float)
    groups = [g for _, g in leaves.groupby(path[0], sort=True, dropna=False)]
    given = fill(total, [g["target_share"].sum() for g in groups], [g["capacity"].sum() for g in groups])
    if len(path) == 1:
        return pd.concat([pd.Series(b, index=g.index) for g, b in zip(groups, given)])
    return pd.concat([_budgets(g, b, path[1:]) for g, b in zip(groups, given)])


def leaf_budgets(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row per target source with its place in the tree and its budget in tokens.

    A source's domain and language are those most of its tokens have. The leaves are the rows of the target table,
    a configuration: they're budgeted in one task. Without ``total_tokens`` the total is what one use of every
    record of the target sources gives. Null or negative shares and repeats count as 0 and 1.
    """

    def main(c: str):
        s = sizes.where(F.col("source").isNotNull()).groupBy("source", c).agg(F.sum("tokens").alias("t"))
        return s.groupBy("source").agg(F.max_by(F.coalesce(c, F.lit("")), F.struct("t", F.coalesce(c, F.lit("")))).alias(c))

    have = sizes.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("tokens").alias("available"))
    asked = (
        targets.where(F.col("source").isNotNull())
        .groupBy("source")
        .agg(F.max(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target_share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("max_repeats"))
    )
    leaves = (
        asked.join(have, "source", "left").join(main("doc_type"), "source", "left").join(main("lang"), "source", "left")
        .select(
            "source", F.coalesce("doc_type", F.lit("")).alias("domain"), F.coalesce("lang", F.lit("")).alias("language"),
            "target_share", F.coalesce("available", F.lit(0)).cast("long").alias("available"), F.col("max_repeats").cast("int").alias("max_repeats"),
        )
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("source").reset_index(drop=True)
        pdf["capacity"] = pdf["available"].astype(float) * pdf["max_repeats"]
        total = float(pdf["available"].sum()) if total_tokens is None else float(total_tokens)
        pdf["budget"] = _budgets(pdf, total, ["domain", "language", "source"])
        return pdf[[p.strip().split()[0] for p in BUDGET.split(",")]]

    return leaves.withColumn("tree", F.lit(0)).groupBy("tree").applyInPandas(lambda pdf: run(pdf.drop(columns="tree")), BUDGET)


def draw(sizes: DataFrame, budgets: DataFrame, seed: int = 17) -> DataFrame:
    """(doc_id, source, tokens, copies) of the drawn records; ``copies`` is how often the mixture uses the record.

    Whole epochs use every record of a source; the last one takes records in the order of a seeded hash as long as
    their tokens fit the rest of the budget. Records without tokens, and of sources without a target, aren't drawn.
    """
    plan = budgets.where((F.col("available") > 0) & (F.col("budget") > 0)).select(
        "source",
        F.floor(F.col("budget") / F.col("available") + 1e-9).cast("int").alias("epochs"),
        F.col("budget").alias("b"),
        "available",
    )
    plan = plan.select("source", "epochs", F.greatest(F.col("b") - F.col("epochs") * F.col("available"), F.lit(0.0)).alias("rest"))
    rows = sizes.where(F.col("tokens") > 0).join(plan, "source").withColumn("h", F.xxhash64(F.lit(seed), "epochs", "doc_id"))
    rows = rows.withColumn("bucket", F.pmod("h", F.lit(BUCKETS)).cast("int"))
    sums = rows.groupBy("source", "bucket").agg(F.sum("tokens").alias("bt"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edge = sums.withColumn("before", F.coalesce(F.sum("bt").over(before), F.lit(0)))
    cut = plan.join(edge, "source").where(F.col("before") <= F.col("rest")).groupBy("source").agg(F.max(F.struct("bucket", "before")).alias("c"))
    marked = rows.join(cut.select("source", F.col("c.bucket").alias("last"), F.col("c.before").alias("taken")), "source")
    inside = marked.where(F.col("bucket") != F.col("last")).withColumn("extra", (F.col("bucket") < F.col("last")).cast("int"))
    order = Window.partitionBy("source").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    split = marked.where(F.col("bucket") == F.col("last")).withColumn("extra", (F.sum("tokens").over(order) + F.col("taken") <= F.col("rest")).cast("int"))
    both = inside.unionByName(split)
    return both.select("doc_id", "source", "tokens", (F.col("epochs") + F.col("extra")).alias("copies")).where(F.col("copies") > 0)


def mixture(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 17, vocabulary: str = DEFAULT_VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(records, report) of a mixture; see ``draw`` and ``report``."""
    sizes = cut_lineage(token_counts(docs, vocabulary))
    budgets = cut_lineage(leaf_budgets(sizes, targets, total_tokens))
    records = draw(sizes, budgets, seed)
    return records, report(records, budgets)


def report(records: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per target source: the share asked for and the share reached, of the tokens drawn from all sources."""
    got = records.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("drawn_tokens"), F.count(F.lit(1)).alias("records"), F.max("copies").alias("most_uses")
    )
    every = Window.partitionBy()
    joined = budgets.join(got, "source", "left").na.fill(0, ["drawn_tokens", "records", "most_uses"])
    total = F.sum("drawn_tokens").over(every)
    return joined.select(
        "domain", "language", "source", "target_share",
        F.when(total > 0, F.round(F.col("drawn_tokens") / total, 6)).otherwise(F.lit(0.0)).alias("actual_share"),
        "available", "drawn_tokens", "records", "most_uses", "max_repeats",
    )
