"""Keyed tables, late rows, the log, miners and plug-ins: what must survive a failure, and edges."""

import pytest
from pyspark.sql import functions as F

from mossbrook import plugins as P
from mossbrook.operators import evaluation as V
from mossbrook.operators import graph as G
from mossbrook.operators import mining as M
from mossbrook.plans import registry
from mossbrook.sources.tables import Conflict, Table
from mossbrook.streaming import observations as O
from mossbrook.streaming import wal
from tests.conftest import rows

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double"


def _table(spark, tmp_path, schema="k long, v string", name="t"):
    t = Table(spark, str(tmp_path / name), ["k"], 4)
    t.ensure(schema)
    return t


def test_table_edges(spark, tmp_path):
    t = _table(spark, tmp_path)
    assert t.read().count() == 0 and t.by_key(spark.range(3).withColumnRenamed("id", "k")).count() == 0
    new = spark.createDataFrame([(1, "a"), (None, "x"), (2, None), (2, "b")], "k long, v string").withColumn("extra", F.lit(1))
    t.append(new)
    assert rows(t.read()) == [(1, "a"), (2, "b"), (2, None)]
    t.replace(spark.createDataFrame([(2, "c")], "k long, v string"))
    t.replace(new.limit(0))
    assert rows(t.read()) == [(1, "a"), (2, "c")] and rows(t.read(2)) == [(1, "a"), (2, "b"), (2, None)]
    with pytest.raises(ValueError, match="column v"):
        t.ensure("k long, v int")
    t.ensure("k long, v string, w double")
    assert t.read().where("w is null").count() == 2
    t.compact()
    gone = t.expire(1)
    assert gone and rows(t.read().select("k", "v")) == [(1, "a"), (2, "c")] and len(list((tmp_path / "t" / "data").iterdir())) == 1


def test_a_writer_that_died_leaves_the_table(spark, tmp_path):
    """Rows written without a manifest, and a claim without one, are as if they had never been."""
    t = _table(spark, tmp_path)
    t.append(spark.createDataFrame([(1, "a")], "k long, v string"))
    t._store(spark.createDataFrame([(9, "lost")], "k long, v string"))
    (tmp_path / "t" / "log" / "3.claim").touch()
    assert rows(t.read()) == [(1, "a")]
    t.append(spark.createDataFrame([(2, "b")], "k long, v string"))
    assert rows(t.read()) == [(1, "a"), (2, "b")] and t.versions()[-1] == 4


def test_a_second_writer_starts_anew(spark, tmp_path):
    t = _table(spark, tmp_path)
    other = Table(spark, t.path, ["k"], 4)
    seen = []

    def change(m):
        if not seen:
            seen.append(1)
            other.append(spark.createDataFrame([(5, "other")], "k long, v string"))
        return m | {"parts": [*m["parts"], t._store(spark.createDataFrame([(6, "mine")], "k long, v string"))]}

    t._commit(change, wait=0.01)
    assert rows(t.read()) == [(5, "other"), (6, "mine")]
    with pytest.raises(Conflict):
        t._commit(lambda m: (other.append(spark.createDataFrame([(7, "x")], "k long, v string")), m)[1], attempts=2, wait=0.01)


def test_late_and_repeated_rows_are_written_once(spark, tmp_path):
    """A row weeks late, in a later batch than a newer one, is there, once."""
    day = ["2024-03-01 10:00:00", "2024-03-20 10:00:00", "2024-03-02 10:00:00", "2024-03-01 10:00:00"]
    for k, (i, at) in enumerate(zip((1, 2, 3, 1), day)):
        spark.createDataFrame([(i, i, "view", 1.0, at)], "event_id long, user_id long, event_type string, value double, at string").select("event_id", F.col("at").cast("timestamp").alias("ts"), "user_id", "event_type", "value").coalesce(1).write.parquet(str(tmp_path / f"in/part={k}"))
    s = O.source(spark, str(tmp_path / "in/*"), EVENT, "parquet", 1)
    O.merged(O.observations(s), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(str(r.event_date) for r in got.collect()) == ["2024-03-01", "2024-03-02", "2024-03-20"]


def test_log_keeps_what_was_not_sent(spark, tmp_path):
    e = spark.range(10).withColumnRenamed("id", "event_id")

    def away(_):
        raise ConnectionError

    log = str(tmp_path / "log")
    assert wal.produce(e, away, log) == "logged" and wal.waiting(spark, log, "event_id long").first()["lines"] == 10
    assert wal.replay(spark, log, "event_id long", away) == {"sent": 0, "left": 10}
    got = []
    assert wal.replay(spark, log, "event_id long", lambda df: got.extend(df.collect())) == {"sent": 10, "left": 0}
    assert len(got) == 10 and wal.replay(spark, log, "event_id long", away) == {"sent": 0, "left": 0}


def test_a_log_over_the_budget_is_replayed_whole(spark, tmp_path):
    """Four files of 15,000 lines, each more than the budget of a go."""
    spark.range(60_000).selectExpr("id as event_id", "concat('t', id % 7) as event_type").write.parquet(f"{tmp_path}/events.parquet")
    got = registry.QUERIES["wal_replay"](spark, str(tmp_path))
    assert got.count() == 60_000 and got.select("event_id").distinct().count() == 60_000


def test_sixty_levels_and_a_cycle_of_twelve(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "parent int, child int").coalesce(1)
    assert G.descendants(spark.createDataFrame([(0,)], "root int"), chain).agg(F.max("depth")).first()[0] == 60
    ring = spark.createDataFrame([(i, (i + 1) % 12) for i in range(12)] + [(3, 99)], "parent int, child int").coalesce(1)
    assert [r[0] for r in rows(G.on_cycle(ring))] == sorted(range(12), key=lambda x: repr((x,)))


def test_sources_and_miners(spark, tmp_path):
    with pytest.raises(PermissionError):
        P.load_source(spark, "gene_table", str(tmp_path))
    with pytest.raises(KeyError):
        P.load_source(spark, "nowhere", "")
    with pytest.raises(ValueError, match="registered"):
        P.register_source("concept_lines")(lambda s, p: s.range(1))
    with pytest.raises(ValueError):
        M.mine({"unheard_of": spark.range(1)})
    d = spark.createDataFrame([("a", 0.1), ("a", None), (None, 0.2)], "subject string, confidence double")
    assert rows(M.mine({"low_confidence": d}).select("payload", "occurrences")) == [("a", 1), (None, 1)]


def test_gold_sections_fall_back(spark):
    gold = spark.createDataFrame([("d", "A / B / C"), ("d", "X / B / C"), ("d", "X / Methods"), ("d", "nothing"), ("d", ""), ("d", None)], "document string, section string")
    have = spark.createDataFrame([("d", "A / B / C"), ("d", "B / C"), ("d", "Methods")], "document string, alias string")
    got = {r["section"]: (r["alias"], r["fallback"]) for r in V.gold_sections(gold, have).collect()}
    assert got["A / B / C"] == ("A / B / C", False) and got["X / B / C"] == ("B / C", True) and got["X / Methods"] == ("Methods", True) and got["nothing"] == (None, None)
