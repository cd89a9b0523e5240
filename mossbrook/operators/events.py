"""Append-only observations folded into their latest state, and what is mined from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mossbrook import schema as S
from mossbrook.functions import text as X
from mossbrook.session import cut_lineage

OPEN = ("unmapped", "low_confidence")


def window_days(df: DataFrame, cutoff: str, date: str = "event_date") -> DataFrame:
    """Rows on or after the cutoff; rows without a date always stay."""
    return df.where(F.col(date).isNull() | (F.col(date) == "") | (F.col(date) >= cutoff))


def unique(df: DataFrame, key: str = "observation_id") -> DataFrame:
    """One row per observation, the last arrival by (event_ts, status): a partial aggregate."""
    from mossbrook.operators.topk import latest

    return latest(df, [key], ["event_ts", "status"])


def mode(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """The most frequent value per group, ties by the smaller; nulls don't vote."""
    c = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    best = c.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"))).alias("b"))
    return best.select(*by, F.col("b.v").alias(name))


def backlog(observations: DataFrame, least: int = 1) -> DataFrame:
    """Per mention key: its unique events, the modal source and kind, the first label and the latest status; only keys
    whose latest status is open, with ``least`` events or more."""
    u = unique(observations).where(F.col("mention_key").isNotNull() & (F.col("mention_key") != ""))
    g = u.groupBy("mention_key").agg(
        F.count(F.lit(1)).alias("occurrences"),
        F.min(F.struct("event_ts", "observation_id", "mention")).alias("f"),
        F.max(F.struct("event_ts", "observation_id", "status")).alias("l"),
    )
    out = g.select("mention_key", "occurrences", F.col("f.mention").alias("label"), F.col("l.status").alias("status"), F.col("l.event_ts").alias("last_seen"))
    out = out.where(F.col("status").isin(*OPEN) & (F.col("occurrences") >= least))
    return out.join(mode(u, ["mention_key"], "source", "source"), "mention_key", "left").join(mode(u, ["mention_key"], "kind_hint", "kind_hint"), "mention_key", "left")


def backlog_summary(observations: DataFrame) -> DataFrame:
    """Raw rows, unique events and open keys, in one row."""
    raw = observations.agg(F.count(F.lit(1)).alias("raw_rows"), F.count_distinct("observation_id").alias("unique_events"))
    return raw.join(backlog(observations).agg(F.count(F.lit(1)).alias("open_keys")), F.lit(True))


def priority(occurrences: Column, base: str = "P2") -> Column:
    return F.when(occurrences >= S.P0_FROM, "P0").when(occurrences >= S.P1_FROM, "P1").otherwise(base)


def signal(df: DataFrame, kind: str, payload: Column, occurrences: Column, base: str = "P2") -> DataFrame:
    """(signal_id, kind, payload, occurrences, priority) of a miner's rows."""
    return df.select(payload.alias("payload"), occurrences.cast("bigint").alias("occurrences")).select(
        X.numeric_id(F.lit(kind), F.col("payload")).alias("signal_id"), F.lit(kind).alias("kind"), "payload", "occurrences", priority(F.col("occurrences"), base).alias("priority")
    )


def low_confidence(decisions: DataFrame, floor: float = S.LOW_CONFIDENCE) -> DataFrame:
    """(subject, occurrences, worst, worst_at) of decisions under the floor."""
    d = decisions.where(F.col("confidence") < floor)
    return d.groupBy("subject").agg(F.count(F.lit(1)).alias("occurrences"), F.min(F.struct("confidence", "decision_id")).alias("w")).select("subject", "occurrences", F.col("w.confidence").alias("worst"), F.col("w.decision_id").alias("worst_at"))


def unstable(decisions: DataFrame) -> DataFrame:
    """(subject, choices, abstains): subjects decided in more than one way, or left undecided."""
    g = decisions.groupBy("subject").agg(F.count_distinct("chosen").alias("choices"), F.count_if(F.col("chosen").isNull()).alias("abstains"))
    return g.where((F.col("choices") > 1) | (F.col("abstains") > 0))


def zero_results(calls: DataFrame) -> DataFrame:
    """(query, occurrences) of searches with no or zero total."""
    return calls.where(F.coalesce("total", F.lit(0)) == 0).groupBy("query").agg(F.count(F.lit(1)).alias("occurrences"))


def missed_clicks(clicks: DataFrame, returned: DataFrame) -> DataFrame:
    """Clicks (query, key) on what the search hadn't returned."""
    return clicks.join(returned.select("query", "key").distinct(), ["query", "key"], "left_anti").groupBy("query", "key").agg(F.count(F.lit(1)).alias("occurrences"))


def cooccurrence(rows: DataFrame, group: str, item: str, least: int, known: DataFrame, large: int = 1000) -> DataFrame:
    """(a, b, groups): unordered pairs of items in ``least`` groups or more that aren't known edges (a, b). Exact.

    Items in fewer groups are dropped first. Within groups of up to ``large`` items pairs are formed and counted. No larger group forms all
    its pairs: a pair from the small groups that large ones could lift to ``least`` is looked up in them, and for pairs that share large
    groups only, these are put in one order, the smallest first: two items that share ``least`` of them share one of the first
    n - least + 1 of either, and only there candidates are formed, which are then counted.
    """
    r = rows.select(F.col(group).alias("g"), F.col(item).alias("i")).where(F.col(group).isNotNull() & F.col(item).isNotNull()).distinct()
    often = r.groupBy("i").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("i")
    x = cut_lineage(r.join(often, "i", "left_semi"))
    sizes = x.groupBy("g").agg(F.count(F.lit(1)).alias("size"))
    hot = x.join(sizes.where(F.col("size") > large), "g")
    held = hot.groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    small = x.join(sizes.where(F.col("size") <= large).select("g"), "g", "left_semi")
    light = small.withColumnRenamed("i", "a").join(small.withColumnRenamed("i", "b"), "g").where(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("light"))
    lift = light.join(held.select(F.col("i").alias("a"), F.col("n").alias("na")), "a", "left").join(held.select(F.col("i").alias("b"), F.col("n").alias("nb")), "b", "left")
    lift = cut_lineage(lift.where(F.col("light") + F.coalesce(F.least("na", "nb"), F.lit(0)) >= least).select("a", "b", "light"))
    first = hot.join(held.where(F.col("n") >= least), "i").withColumn("place", F.row_number().over(Window.partitionBy("i").orderBy("size", "g"))).where(F.col("place") <= F.col("n") - least + 1).select("g", "i")
    heavy = first.withColumnRenamed("i", "a").join(first.withColumnRenamed("i", "b"), "g").where(F.col("a") < F.col("b")).select("a", "b")
    asked = lift.select("a", "b").unionAll(heavy).distinct()
    more = asked.join(hot.select(F.col("i").alias("a"), "g"), "a").join(hot.select(F.col("i").alias("b"), "g"), ["b", "g"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("more"))
    total = F.coalesce("light", F.lit(0)) + F.coalesce("more", F.lit(0))
    found = asked.join(lift, ["a", "b"], "left").join(more, ["a", "b"], "left").select("a", "b", total.alias("groups")).where(F.col("groups") >= least)
    return found.join(known.select("a", "b").distinct(), ["a", "b"], "left_anti")


def negative_feedback(feedback: DataFrame) -> DataFrame:
    return signal(feedback.where("verdict <> 'CORRECT'").groupBy("subject").agg(F.count(F.lit(1)).alias("n")), "negative_feedback", F.col("subject"), F.col("n"), "P0")


def mined(parts: list[DataFrame]) -> DataFrame:
    """All signals in their global order: priority, most occurrences, payload."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    once = every.groupBy("signal_id", "kind", "payload", "priority").agg(F.max("occurrences").alias("occurrences"))
    return once.orderBy("priority", F.col("occurrences").desc(), "payload", "kind")


def impact(touched: DataFrame, edges: DataFrame, postings: DataFrame, levels: int = 3) -> DataFrame:
    """(concept, chunks, documents, reindex): what a change of the touched concepts and their descendants reaches."""
    from mossbrook.operators.graph import descendants

    below = descendants(touched.select(F.col("concept").alias("root")), edges, levels).select(F.col("root").alias("concept"), F.col("node").alias("c"))
    hit = below.join(postings.select(F.col("concept").alias("c"), "chunk", "document"), "c", "left").groupBy("concept").agg(F.count_distinct("chunk").alias("chunks"), F.count_distinct("document").alias("documents"))
    return hit.withColumn("reindex", F.col("chunks") > 0)


def kgcl(op: Column, subject: Column, value: Column) -> Column:
    """A change as text."""
    return (
        F.when(op == "new_synonym", F.format_string("create synonym '%s' for %s", value, subject))
        .when(op == "obsolete", F.format_string("obsolete %s with replacement %s", subject, value))
        .when(op == "move", F.format_string("move %s under %s", subject, value))
        .otherwise(F.format_string("rename %s to '%s'", subject, value))
    )


def candidates(c: DataFrame, blocked: DataFrame, least: int = 2, most: int = 80, overlap: float = 0.35) -> DataFrame:
    """Candidates (mention, query, canonical, confidence, occurrences) with the reasons against them and their rank.

    Hard reasons dismiss, soft ones push down; of equal mentions the best one stays. Overlap of query and mention: 1 if
    equal or one holds the other (four letters or more), else the Jaccard of their words."""
    b = blocked.select(X.mention_key(F.col("mention")).alias("k")).distinct().withColumn("listed", F.lit(True))
    x = c.withColumn("k", X.mention_key(F.col("mention"))).join(b, "k", "left")
    q, m = F.lower("query"), F.lower("mention")
    wq, wm = X.words(F.col("query")), X.words(F.col("mention"))
    share = F.size(F.array_intersect(wq, wm)) / F.greatest(F.size(F.array_union(wq, wm)), F.lit(1))
    near = F.when(q == m, 1.0).when((F.length(m) >= 4) & (F.contains(q, m) | F.contains(m, q)), 1.0).otherwise(share)
    reasons = F.array_compact(
        F.array(
            F.when(F.col("listed"), "hard:blocked"), F.when(F.length(F.trim("mention")) < least, "hard:short"), F.when(F.length("mention") > most, "hard:long"),
            F.when(F.col("mention").rlike(r"^[^\p{L}]+$"), "hard:no_letters"), F.when(F.col("canonical").isNull(), "soft:no_entity"), F.when(F.round(near, 6) < overlap, "soft:overlap"),
            F.when(F.coalesce("confidence", F.lit(0.0)) < S.LOW_CONFIDENCE, "soft:confidence"),
        )
    )
    score = F.round(F.coalesce("confidence", F.lit(0.0)) + F.round(near, 6) + 0.5 * F.least(F.col("occurrences"), F.lit(10)) / 10 - 0.3 * F.size(F.filter("reasons", lambda r: r.startswith("soft"))), 6)
    y = x.withColumn("reasons", reasons).withColumn("score", score)
    w = Window.partitionBy("k").orderBy(F.size(F.filter("reasons", lambda r: r.startswith("hard"))), F.col("score").desc(), "mention", F.coalesce("canonical", F.lit("")))
    y = y.withColumn("r", F.row_number().over(w)).where("r = 1")
    hard = F.exists("reasons", lambda r: r.startswith("hard"))
    return y.select("mention", "score", F.array_join("reasons", ",").alias("reasons"), F.when(hard, "dismiss").when(F.size("reasons") > 0, "review").otherwise("keep").alias("decision"))
