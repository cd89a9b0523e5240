"""Validity history of changing entity attributes, from periodic snapshots.

Consecutive snapshots are compared by a null-safe full outer join on (key, release ordinal): a key only in the
later one is ``inserted``, one only in the earlier ``deleted``, one in both with another state ``changed``. The
union of these events, read in release order, gives the versions; ``lead`` closes each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDINAL, STATE, LABEL = "__ordinal", "__state", "__label"


def release_label(c: Column) -> Column:
    """A release label without the ways of writing it: blanks, a leading ``v`` or ``release-``, letter case."""
    return F.regexp_replace(F.lower(F.trim(c)), r"^(release[-_ ]?|v)", "")


def as_set(c: Column) -> Column:
    """An array as a set: sorted, without repeats and nulls; null stays null, empty stays empty."""
    return F.array_sort(F.array_distinct(F.filter(c, lambda x: x.isNotNull())))


def release_order(releases: DataFrame, release_id: str = "release_id", released_at: str = "released_at") -> DataFrame:
    """(label, release_id, ordinal) by released_at, ties by label. The calendar is one row per release: small by nature."""
    packed = releases.where(F.col(release_id).isNotNull()).agg(
        F.array_sort(F.collect_set(F.struct(F.col(released_at), F.col(release_id)))).alias("r")
    )
    return packed.select(F.posexplode("r").alias(ORDINAL, "r")).select(
        ORDINAL, F.col(f"r.{release_id}").alias("release_id"), release_label(F.col(f"r.{release_id}")).alias(LABEL)
    )


def carried_states(
    snapshots: DataFrame,
    releases: DataFrame,
    key: str,
    release: str,
    loaded_at: str,
    state: dict[str, Column],
    created: str,
) -> DataFrame:
    """One row per (key, release present): the latest load, with nulls filled from the releases before.

    Loads of a (key, release) are reduced by a max over (loaded_at, content), which combines on the map side, so a
    release that was loaded very often is no hot group. Equal loaded_at: the greater content, so that the result
    doesn't depend on row order. Rows whose release isn't in the calendar have no place in time and are left out.
    A null state before any known one takes the first known one: it's "as before" of nothing.
    """
    order = release_order(releases)
    latest = (
        snapshots.select(
            F.col(key).alias("k"),
            release_label(F.col(release)).alias(LABEL),
            F.struct(F.col(loaded_at).alias("at"), *[c.alias(n) for n, c in state.items()], F.col(created).alias("created")).alias("row"),
        )
        .groupBy("k", LABEL)
        .agg(F.max("row").alias("row"))
        .join(order, LABEL)
    )
    w = Window.partitionBy("k").orderBy(ORDINAL)
    up, down = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    filled = F.struct(*[F.coalesce(F.last(f"row.{n}", True).over(up), F.first(f"row.{n}", True).over(down)).alias(n) for n in state])
    every = Window.partitionBy("k").orderBy(ORDINAL).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return latest.select("k", ORDINAL, "release_id", filled.alias(STATE), F.first("row.created", True).over(every).alias("created"))


def snapshot_events(states: DataFrame, releases: DataFrame) -> DataFrame:
    """(k, ordinal, event, state, created) from joining each snapshot with the one before it.

    ``deleted`` says that a key is missing from the snapshot of that ordinal; it carries the last known state.
    """
    order = release_order(releases).select(F.col(ORDINAL).alias("at"), F.col("release_id").alias("at_release"))
    now = states.select(F.col("k").alias("k1"), F.col(ORDINAL).alias("o1"), F.col(STATE).alias("s1"), F.col("created").alias("c1"))
    before = states.select(F.col("k").alias("k0"), (F.col(ORDINAL) + 1).alias("o0"), F.col(STATE).alias("s0"), F.col("created").alias("c0"))
    both = now.join(before, F.col("k1").eqNullSafe(F.col("k0")) & (F.col("o1") == F.col("o0")), "full_outer")
    kind = (
        F.when(F.col("o0").isNull(), "inserted")
        .when(F.col("o1").isNull(), "deleted")
        .when(~F.col("s1").eqNullSafe(F.col("s0")), "changed")
    )
    return (
        both.withColumn("event", kind)
        .where(F.col("event").isNotNull())
        .select(
            F.when(F.col("o1").isNull(), F.col("k0")).otherwise(F.col("k1")).alias("k"),
            F.coalesce("o1", "o0").alias(ORDINAL),
            "event",
            F.coalesce("s1", "s0").alias(STATE),
            F.coalesce("c1", "c0").alias("created"),
        )
        .join(order, F.col(ORDINAL) == F.col("at"))
        .select("k", ORDINAL, F.col("at_release").alias("release_id"), "event", STATE, "created")
    )


def versions(events: DataFrame, releases: DataFrame, state_fields: Sequence[str]) -> DataFrame:
    """Versions with their validity. A key that comes back with the state it had before isn't a new version."""
    w = Window.partitionBy("k").orderBy(ORDINAL)
    shown = events.where(F.col("event") != "deleted")
    fresh = shown.withColumn("first", F.row_number().over(w) == 1).withColumn("was", F.lag(STATE).over(w))
    kept = fresh.where(F.col("first") | ~F.col(STATE).eqNullSafe(F.col("was")))
    names = release_order(releases).select(F.col(LABEL).alias("created_label"), F.col("release_id").alias("created_id"))
    start = F.when(F.col("first"), F.coalesce("created_id", "release_id")).otherwise(F.col("release_id"))
    dated = kept.withColumn("created_label", release_label(F.col("created"))).join(names, "created_label", "left")
    return dated.withColumn("valid_from", start).select(
        "k",
        "valid_from",
        F.lead("valid_from", 1, "").over(w).alias("valid_to"),
        F.row_number().over(w).alias("version"),
        *[F.col(f"{STATE}.{n}").alias(n) for n in state_fields],
    )


def attribute_history(
    snapshots: DataFrame,
    releases: DataFrame,
    key: str = "concept_id",
    release: str = "ledger_release",
    loaded_at: str = "loaded_at",
    state: dict[str, Column] | None = None,
    created: str = "created_in_release",
) -> DataFrame:
    """Full history of an entity's attributes: (key, valid_from, valid_to, version, state...).

    Missing snapshots change nothing; a state that returns is a new version; the first version starts at the
    entity's created release (the snapshot's own, where that is null or unknown); valid_to of the last is ''.
    Empty input gives no rows, a null key is a key like any other, other columns of the snapshots are ignored.
    """
    state = state or {"members": as_set(F.col("members")), "is_obsolete": F.col("is_obsolete")}
    states = carried_states(snapshots, releases, key, release, loaded_at, state, created)
    found = versions(snapshot_events(states, releases), releases, list(state))
    return found.withColumnRenamed("k", key)
