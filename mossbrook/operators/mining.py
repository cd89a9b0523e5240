"""Traces, the registry of signal miners, pools for review, and records for a linker."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mossbrook.functions import text as X

MINERS: dict[str, Callable[..., DataFrame]] = {}


def miner(kind: str):
    """Registers a miner of signals (payload, occurrences, priority) under its kind."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        MINERS[kind] = f
        return f

    return add


def mine(inputs: dict[str, DataFrame], kinds: Sequence[str] | None = None) -> DataFrame:
    """The signals of all registered miners whose input is there, or of some kinds, as (kind, payload, occurrences, priority)."""
    wanted = [k for k in (kinds or sorted(MINERS)) if k in inputs]
    if not wanted:
        raise ValueError("no miner has an input")
    parts = [MINERS[k](inputs[k]).select(F.lit(k).alias("kind"), "payload", "occurrences", "priority") for k in wanted]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def priority(occurrences: Column) -> Column:
    return F.when(occurrences >= 5, "P0").when(occurrences >= 2, "P1").otherwise("P2")


def _counted(rows: DataFrame, payload: str) -> DataFrame:
    c = rows.groupBy(F.col(payload).alias("payload")).agg(F.count(F.lit(1)).alias("occurrences"))
    return c.withColumn("priority", priority(F.col("occurrences")))


@miner("unmapped_span")
def unmapped(observations: DataFrame) -> DataFrame:
    """Spans without a concept, by mention key; exact counts and the traces they were seen in."""
    return _counted(observations.where("status = 'unmapped' and mention_key <> ''"), "mention_key")


@miner("low_confidence")
def low_confidence(decisions: DataFrame) -> DataFrame:
    return _counted(decisions.where("confidence < 0.6"), "subject")


@miner("zero_result")
def zero_result(calls: DataFrame) -> DataFrame:
    return _counted(calls.where(F.coalesce("total", F.lit(0)) == 0), "query")


@miner("unstable")
def unstable(decisions: DataFrame) -> DataFrame:
    """Subjects decided in more than one way within one stage."""
    s = decisions.groupBy("stage", "subject").agg(F.count_distinct("chosen").alias("n")).where("n > 1")
    return s.groupBy(F.col("subject").alias("payload")).agg(F.sum("n").alias("occurrences")).withColumn("priority", F.lit("P1"))


def span_counts(observations: DataFrame, most: int = 5) -> DataFrame:
    """(mention_key, occurrences, traces, sample): unmapped spans with their counts and up to ``most`` traces, the smallest."""
    x = observations.where("status = 'unmapped' and mention_key <> ''").groupBy("mention_key", "trace_id").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("mention_key").orderBy("trace_id")
    r = x.withColumn("r", F.row_number().over(w))
    sample = F.array_sort(F.collect_list(F.when(F.col("r") <= most, F.col("trace_id"))))
    return r.groupBy("mention_key").agg(F.sum("n").alias("occurrences"), F.count("trace_id").alias("traces"), F.array_join(sample, ",").alias("sample"))


def by_trace(decisions: DataFrame, io: DataFrame, trace: str | None = None) -> DataFrame:
    """Decisions with the calls of their trace, all traces or one; decisions without calls stay."""
    d = decisions if trace is None else decisions.where(F.col("trace_id") == trace)
    return d.join(io, "trace_id", "left")


def stage_hits(decisions: DataFrame) -> DataFrame:
    """(stage, hits): decisions by the stage that made them; what no stage made counts as 'unmapped'."""
    return decisions.groupBy(F.coalesce("stage", F.lit("unmapped")).alias("stage")).agg(F.count(F.lit(1)).alias("hits"))


def most_frequent(rows: DataFrame, key: str) -> DataFrame:
    """One row per key, that of most occurrences, ties by the smallest label."""
    best = rows.groupBy(key).agg(F.min(F.struct((-F.col("occurrences")).alias("o"), "label")).alias("b"))
    return best.select(key, F.col("b.label").alias("label"), (-F.col("b.o")).alias("occurrences"))


def leading(rows: DataFrame, k: int = 200) -> DataFrame:
    """The k mentions of most occurrences, ties by key: the report that a person reads."""
    return rows.orderBy(F.col("occurrences").desc(), "mention_key").limit(k)


def guess_concept(found: DataFrame, chunk_concepts: DataFrame) -> DataFrame:
    """(payload, concept): for a span (payload, chunk) the concept that most of its chunks (chunk, concept) hold; a guess to be reviewed."""
    c = found.select("payload", "chunk").distinct().join(chunk_concepts.select("chunk", "concept").distinct(), "chunk").groupBy("payload", "concept").agg(F.count(F.lit(1)).alias("n"))
    best = c.groupBy("payload").agg(F.min(F.struct((-F.col("n")).alias("n"), "concept")).alias("b"))
    return best.select("payload", F.col("b.concept").alias("concept"))


def review_pool(candidates: DataFrame, every_keep: bool = False) -> DataFrame:
    """Candidates (mention_key, decision, reasons, overlap, method, confidence) for a second opinion: the borderline ones without a hard
    reason, and kept ones that aren't clear, or all kept ones; once per key, borderline first."""
    hard = F.exists("reasons", lambda r: F.startswith(r, F.lit("hard:")))
    clear = (F.coalesce("overlap", F.lit(0.0)) >= 1.0) & (F.coalesce(F.col("method").isin("dictionary", "linkage", "xref", "own_id"), F.lit(False)) | (F.coalesce("confidence", F.lit(0.0)) >= 0.9))
    borderline = (F.col("decision") == "review") & ~F.coalesce(hard, F.lit(False))
    kept = (F.col("decision") == "keep") & (F.lit(every_keep) | ~clear)
    pool = candidates.where((borderline | kept) & (F.coalesce("mention_key", F.lit("")) != ""))
    once = pool.groupBy("mention_key").agg(F.min(F.struct((F.col("decision") == "keep").alias("k"), F.coalesce(-F.col("confidence"), F.lit(0.0)).alias("c"), "decision", "confidence")).alias("b"))
    return once.select("mention_key", "b.decision", "b.confidence")


def proposals(rows: DataFrame, ids: Sequence[str] = (), tier: str | None = None, least: float | None = None, status: str | None = "pending") -> DataFrame:
    """Proposals of a status, of some ids, of a tier, of a least confidence; what isn't given isn't asked."""
    out = rows if status is None else rows.where(F.col("status") == status)
    out = out.where(F.col("proposal_id").isin(*ids)) if ids else out
    out = out if tier is None else out.where(F.col("tier") == tier)
    return out if least is None else out.where(F.coalesce("confidence", F.lit(0.0)) >= least)


def cluster_pairs(records: DataFrame, salts: int = 8) -> DataFrame:
    """(cluster, mention, enterprise_id, score) of clustered records (cluster, id, label, score, own): each distinct observation with each
    enterprise record of its cluster. Enterprise records, one or few by cluster, are repeated over salts for hot clusters."""
    ent = records.where("own").select("cluster", F.col("id").alias("enterprise_id"), F.col("score").alias("own_score")).distinct()
    obs = records.where("not own").where(F.coalesce("label", F.lit("")) != "").groupBy("cluster", F.col("label").alias("mention")).agg(F.max("score").alias("score"))
    spread = ent.select("*", F.explode(F.array(*map(F.lit, range(salts)))).alias("salt"))
    x = obs.withColumn("salt", F.pmod(F.xxhash64("mention"), F.lit(salts)).cast("int")).join(spread, ["cluster", "salt"])
    return x.select("cluster", "mention", "enterprise_id", F.coalesce("score", "own_score", F.lit(0.0)).alias("score"))


def best_matches(pairs: DataFrame) -> DataFrame:
    """(mention_key, mention, enterprise_id, score): the best pair of each mention but for case, ties by the smallest id."""
    best = pairs.groupBy(F.lower(F.trim("mention")).alias("mention_key")).agg(F.min(F.struct((-F.col("score")).alias("s"), "enterprise_id", "mention")).alias("b"))
    return best.select("mention_key", "b.mention", "b.enterprise_id", (-F.col("b.s")).alias("score"))


def linker_files(enterprise: DataFrame, observations: DataFrame, path: str) -> None:
    """Writes both sides of a linkage run as parquet and labelled variants of the own names as CSV for its training."""
    enterprise.write.mode("overwrite").parquet(f"{path}/enterprise")
    observations.write.mode("overwrite").parquet(f"{path}/observations")
    v = enterprise.select("id", "label", F.explode(X.label_variants(F.col("label"))).alias("variant"))
    v.write.mode("overwrite").option("header", True).csv(f"{path}/training")
