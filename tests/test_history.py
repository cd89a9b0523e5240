"""Validity history: the differencing of snapshots and its edge cases."""

import datetime as dt

from mossbrook.operators import history as H
from tests.conftest import rows

RELEASES = [(f"{i}.0", dt.datetime(2024, 1, i + 1)) for i in range(5)]
SNAP = "concept_id string, ledger_release string, members array<string>, is_obsolete boolean, created_in_release string, loaded_at timestamp, extra string"


def at(n):
    return dt.datetime(2024, 2, 1, 0, n)


def history(spark, data, releases=RELEASES):
    r = spark.createDataFrame(releases, "release_id string, released_at timestamp")
    return H.attribute_history(spark.createDataFrame(data, SNAP), r)


def spans(spark, data):
    return rows(history(spark, data).select("concept_id", "valid_from", "valid_to"))


def test_versions_follow_the_state_only(spark):
    data = [
        ("A", "0.0", ["x", "y"], False, "0.0", at(0), "p"),
        ("A", "1.0", ["y", "x", "x", None], False, "0.0", at(1), "q"),  # the same set
        ("A", "2.0", ["x"], False, "0.0", at(2), "q"),
        ("A", "3.0", None, None, None, at(3), None),  # as before
        ("A", "4.0", ["x", "y"], False, "0.0", at(4), "q"),  # a state that returns
    ]
    assert spans(spark, data) == [("A", "0.0", "2.0"), ("A", "2.0", "4.0"), ("A", "4.0", "")]


def test_latest_load_counts_and_hot_reloads(spark):
    data = [("A", "0.0", [str(k)], False, "0.0", at(k % 50), None) for k in range(50)] + [("A", "v1.0 ", ["49"], False, "0.0", at(0), None)]
    assert spans(spark, data) == [("A", "0.0", "")]


def test_missing_snapshots_change_nothing(spark):
    data = [("A", "0.0", ["x"], False, "0.0", at(0), None), ("A", "3.0", ["x"], False, "0.0", at(1), None), ("A", "4.0", ["x"], True, "0.0", at(2), None)]
    assert spans(spark, data) == [("A", "0.0", "4.0"), ("A", "4.0", "")]
    states = H.carried_states(
        spark.createDataFrame(data, SNAP), spark.createDataFrame(RELEASES, "release_id string, released_at timestamp"), "concept_id", "ledger_release", "loaded_at",
        {"members": H.as_set(__import__("pyspark").sql.functions.col("members"))}, "created_in_release",
    )
    kinds = rows(H.snapshot_events(states, spark.createDataFrame(RELEASES, "release_id string, released_at timestamp")).select("release_id", "event"))
    assert kinds == [("0.0", "inserted"), ("1.0", "deleted"), ("3.0", "inserted")]


def test_created_release_starts_the_first_version(spark):
    data = [("A", "2.0", [], False, "release-1.0", at(0), None), ("B", "2.0", [], False, None, at(0), None), ("C", "2.0", [], False, "nowhere", at(0), None)]
    assert spans(spark, data) == [("A", "1.0", ""), ("B", "2.0", ""), ("C", "2.0", "")]


def test_empty_null_and_equal_loads(spark):
    assert spans(spark, []) == []
    data = [(None, "0.0", None, None, None, at(0), None), ("A", "9.9", ["x"], False, "0.0", at(0), None), ("B", "0.0", ["b"], False, "0.0", at(0), None), ("B", "0.0", ["a"], False, "0.0", at(0), None)]
    got = rows(history(spark, data).select("concept_id", "valid_from", "members"))
    assert got == [("B", "0.0", ["b"]), (None, "0.0", None)]
    assert rows(history(spark, data + data).select("concept_id")) == [("B",), (None,)]


def test_order_and_partitions_do_not_matter(spark):
    data = [(f"C{k % 7}", f"{k % 5}.0", [str(k % 3)], k % 2 == 0, "0.0", at(k % 60), None) for k in range(200)]
    a = rows(history(spark, data))
    r = spark.createDataFrame(RELEASES, "release_id string, released_at timestamp")
    b = rows(H.attribute_history(spark.createDataFrame(data[::-1], SNAP).repartition(9), r))
    assert a == b
