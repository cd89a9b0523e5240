"""Structured Streaming over observation events: deduplicated within a watermark, folded, written idempotently."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mossbrook import schema as S
from mossbrook.functions import text as X


def source(spark: SparkSession, path: str, schema: str, fmt: str = "json", per_trigger: int | None = None) -> DataFrame:
    """A file stream of events with a declared schema."""
    r = spark.readStream.format(fmt).schema(schema)
    return (r.option("maxFilesPerTrigger", per_trigger) if per_trigger else r).load(path)


def observations(events: DataFrame) -> DataFrame:
    """Raw events (event_id, ts, user_id, event_type, value) as observations of the lake's schema."""
    mention = F.concat_ws(" ", "event_type", F.pmod("user_id", F.lit(20)))
    status = F.when(F.col("event_type") == "signup", "mapped").when(F.col("event_type") == "error", "low_confidence").otherwise("unmapped")
    ts = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return events.select(
        F.substring(F.sha1(F.concat_ws("|", F.lit("events"), mention, F.col("event_id").cast("string"), ts)), 1, 24).alias("observation_id"), mention.alias("mention"), X.mention_key(mention).alias("mention_key"), status.alias("status"),
        F.concat(F.lit("s"), F.pmod("user_id", F.lit(3))).alias("source"), F.when(F.pmod("event_id", F.lit(2)) == 0, "Disease").otherwise("Target").alias("kind_hint"),
        F.col("user_id").cast("string").alias("trace_id"), ts.alias("event_ts"), F.date_format("ts", "yyyy-MM-dd").alias("event_date"),
    )


def deduplicated(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Observations once each, however often they are delivered within the watermark; ``at`` is their event time. Rows later than the
    watermark aren't in it: where none may be missing, ``merged`` writes instead."""
    timed = stream.withColumn("at", F.to_timestamp("event_ts"))
    return timed.withWatermark("at", late).dropDuplicatesWithinWatermark(["observation_id"])


def unmapped_spans(tool_io: DataFrame) -> DataFrame:
    """Observations derived from the outputs of tools: every span that they report as unmapped."""
    spans = F.from_json("output_json", "struct<unmapped:array<string>>")["unmapped"]
    each = tool_io.select("trace_id", "event_ts", "event_date", F.explode(spans).alias("mention"))
    return each.select(
        F.substring(F.sha1(F.concat_ws("|", F.lit("tool_io"), X.mention_key(F.col("mention")), "trace_id", "event_ts")), 1, 24).alias("observation_id"), "mention", X.mention_key(F.col("mention")).alias("mention_key"),
        F.lit("unmapped").alias("status"), F.lit("tool_io").alias("source"), F.lit(None).cast("string").alias("kind_hint"), "trace_id", "event_ts", "event_date",
    )


def tumbling(stream: DataFrame, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events per window and status; a stream that has its event time and watermark already keeps them."""
    timed = stream if "at" in stream.columns else stream.withColumn("at", F.to_timestamp("event_ts")).withWatermark("at", late)
    return timed.groupBy(F.window("at", size), "status").agg(F.count(F.lit(1)).alias("events"), F.approx_count_distinct("mention_key").alias("mentions"))


def append(stream: DataFrame, path: str, checkpoint: str, available: bool = True):
    """Starts the append to the lake, partitioned by date; with ``available`` it reads what is there and ends."""
    conformed = S.conform(stream, S.TABLES["er_observations"])
    w = conformed.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("event_date").outputMode("append")
    return (w.trigger(availableNow=True) if available else w.trigger(processingTime="15 seconds")).start()


def merged(stream: DataFrame, path: str, checkpoint: str, available: bool = True, key: str = "observation_id"):
    """Starts an append that writes each observation once however late or often it comes: every micro-batch is held against the dates
    of the lake that it touches. Without a watermark no row is too late, and no state grows; a batch that is run again after a failure
    finds what it had written."""

    def write(batch: DataFrame, _: int) -> None:
        new = S.conform(batch, S.TABLES["er_observations"]).dropDuplicates([key])
        new = new.persist()
        jvm = batch.sparkSession.sparkContext._jvm
        here = jvm.org.apache.hadoop.fs.Path(path)
        if here.getFileSystem(batch.sparkSession.sparkContext._jsc.hadoopConfiguration()).exists(here):
            old = batch.sparkSession.read.schema(S.TABLES["er_observations"]).parquet(path)
            old = old.join(new.select("event_date").distinct(), "event_date", "left_semi").select(key)
            new = new.join(old, key, "left_anti").select(*new.columns)
        new.write.mode("append").partitionBy("event_date").parquet(path)

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available else w.trigger(processingTime="15 seconds")).start()


def projected(decisions: DataFrame, most: int = 8, chars: int = 256) -> DataFrame:
    """Decisions with at most ``most`` candidates, the best ones and always the chosen one, and texts cut to ``chars``."""
    ranked = F.array_sort(F.transform("candidates", lambda c: F.struct((-c["score"]).alias("s"), c["id"].alias("id"))))
    head = F.slice(ranked, 1, most)
    has = F.exists(head, lambda c: c["id"] == F.col("chosen"))
    chosen = F.filter(ranked, lambda c: c["id"] == F.col("chosen"))
    kept = F.when(has | (F.size(chosen) == 0), head).otherwise(F.concat(F.slice(ranked, 1, most - 1), chosen))
    return decisions.select("decision_id", "chosen", F.substring("subject", 1, chars).alias("subject"), F.transform(kept, lambda c: F.struct(c["id"].alias("id"), (-c["s"]).alias("score"))).alias("candidates"))
