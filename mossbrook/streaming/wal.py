"""Events when the broker is away: a write-ahead log of JSON lines, its replay, and what keeps watch over it."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Lines of the log from which on the producer is behind.
RED_LINES = 5000


def produce(events: DataFrame, send: Callable[[DataFrame], None], log: str) -> str:
    """Sends a batch, or writes it to the log if that fails; says which, "sent" or "logged"."""
    try:
        send(events)
        return "sent"
    except Exception:
        events.write.mode("append").json(f"{log}/open")
        return "logged"


def _move(spark: SparkSession, old: str, new: str) -> bool:
    jvm = spark.sparkContext._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(old), jvm.org.apache.hadoop.fs.Path(new)
    fs = a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(a):
        return False
    fs.mkdirs(b.getParent())
    return fs.rename(a, b)


def replay(spark: SparkSession, log: str, schema: str, send: Callable[[DataFrame], None], budget: int = 10_000) -> dict[str, int]:
    """Sends up to about ``budget`` lines of the log, file by file; what was sent is archived, what wasn't stays for the next time.

    The log is set aside first, so that a producer writes on undisturbed. A file is archived only after it was sent: one that fails, or
    whose replay dies in between, is sent again, so events come at least once and are told apart by their ids when read.
    """
    _move(spark, f"{log}/open", f"{log}/aside/{uuid.uuid4().hex}")
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{log}/aside")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return {"sent": 0, "left": 0}
    found, sent, left = fs.listFiles(root, True), 0, 0
    names = []
    while found.hasNext():
        name = found.next().getPath().toString()
        if name.endswith(".json"):
            names.append(name)
    for name in sorted(names):
        lines = spark.read.schema(schema).json(name)
        n = lines.count()
        if sent >= budget:
            left += n
            continue
        try:
            send(lines)
        except Exception:
            left += n
            continue
        _move(spark, name, f"{log}/archive/{uuid.uuid4().hex}.json")
        sent += n
    return {"sent": sent, "left": left}


def waiting(spark: SparkSession, log: str, schema: str) -> DataFrame:
    """(lines, red): how many events wait in the log, and whether that is too many."""
    jvm = spark.sparkContext._jvm
    paths = []
    for part in ("open", "aside"):
        p = jvm.org.apache.hadoop.fs.Path(f"{log}/{part}")
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            paths.append(f"{log}/{part}")
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).json(paths) if paths else spark.createDataFrame([], schema)
    return rows.agg(F.count(F.lit(1)).alias("lines")).withColumn("red", F.col("lines") > RED_LINES)


def behind(query: StreamingQuery, most: float = 1.0) -> bool:
    """Whether a stream takes in more rows a second than it works off."""
    p = query.lastProgress
    return bool(p) and (p["processedRowsPerSecond"] or 0.0) * most < (p["inputRowsPerSecond"] or 0.0)


@contextmanager
def paused(queries: list[StreamingQuery], restart: Callable[[], list[StreamingQuery]]) -> Iterator[None]:
    """Stops streams around a commit to the tables they write and starts them again, also after a failure; they go on from their
    checkpoints, so nothing is lost or written twice."""
    for q in queries:
        q.stop()
    try:
        yield
    finally:
        restart()


def closing_events(backlog: DataFrame, mapped: DataFrame, at: str) -> DataFrame:
    """The feedback edge: for each open key of the backlog that is mapped now (mention_key, concept), an event that closes it."""
    m = mapped.where(F.col("concept").isNotNull()).select("mention_key").distinct()
    rows = backlog.select("mention_key", F.col("label").alias("mention"), "kind_hint").join(m, "mention_key", "left_semi")
    return rows.select(
        F.substring(F.sha1(F.concat_ws("|", F.lit("closing"), "mention_key", F.lit(at))), 1, 24).alias("observation_id"), "mention", "mention_key", F.lit("mapped").alias("status"), F.lit("feedback").alias("source"), "kind_hint",
        F.lit(None).cast("string").alias("trace_id"), F.lit(at).alias("event_ts"), F.lit(at[:10]).alias("event_date"),
    )


def folded(stream: DataFrame) -> DataFrame:
    """The latest status and the number of events by mention key, kept as state and put out as it changes: an update-mode aggregate, whose
    state is one row a key. Deliver events once each (``merged``) where repeats must not count."""
    latest = F.max(F.struct("event_ts", "observation_id", "status"))
    return stream.where(F.coalesce("mention_key", F.lit("")) != "").groupBy("mention_key").agg(F.count(F.lit(1)).alias("occurrences"), latest["status"].alias("status"))
