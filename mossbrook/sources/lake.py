"""Reading and writing the lake: idempotent replacement, quarantine, compaction, diffs, text sources."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mossbrook import schema as S


def with_retry(action: Callable[[], None], attempts: int = 5, wait: float = 1.5) -> None:
    """Runs a write, again after a growing pause if the table is locked by another writer."""
    for n in range(1, attempts + 1):
        try:
            return action()
        except Exception as e:
            if n == attempts or "lock" not in str(e).lower() and "concurrent" not in str(e).lower():
                raise
            time.sleep(wait * n)
    return None


def replaced(old: DataFrame, new: DataFrame, key: list[str], empty_keys: DataFrame | None = None) -> DataFrame:
    """The table after all rows of the new rows' keys were replaced: one anti-join for all keys. Keys in ``empty_keys`` are
    emptied even without new rows; new rows with a null or blank key aren't written."""
    ok = F.lit(True)
    for k in key:
        ok = ok & F.col(k).isNotNull() & (F.col(k).cast("string") != "")
    fresh = new.where(ok).select(*old.columns)
    keys = fresh.select(*key).distinct()
    keys = keys if empty_keys is None else keys.unionByName(empty_keys.select(*key)).distinct()
    return old.join(keys, key, "left_anti").select(*old.columns).unionByName(fresh)


def replace_rows(spark: SparkSession, path: str, new: DataFrame, key: list[str], schema: str) -> None:
    """Replaces by key in a parquet folder: writes beside it, then swaps, so that a failed job leaves the old table."""
    jvm = spark.sparkContext._jvm
    here = jvm.org.apache.hadoop.fs.Path(path)
    fs = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    new = S.conform(new, schema)
    out = replaced(spark.read.schema(schema).parquet(path), new, key) if fs.exists(here) else replaced(new.limit(0), new, key)
    tag = uuid.uuid4().hex
    aside, old = f"{path}.{tag}.new", f"{path}.{tag}.old"

    def write() -> None:
        out.write.parquet(aside)
        if fs.exists(here):
            fs.rename(here, jvm.org.apache.hadoop.fs.Path(old))
        fs.rename(jvm.org.apache.hadoop.fs.Path(aside), here)
        fs.delete(jvm.org.apache.hadoop.fs.Path(old), True)

    with_retry(write)


def append_rows(new: DataFrame, path: str, schema: str, by: list[str] | None = None) -> None:
    w = S.conform(new, schema).write.mode("append")
    with_retry(lambda: (w.partitionBy(*by) if by else w).parquet(path))


def quarantined(store: DataFrame, records: DataFrame) -> DataFrame:
    """The quarantine after an upsert on (doc_id, plane): while a record is open it keeps first_seen and its replays."""
    new = records.groupBy("doc_id", "plane").agg(F.max(F.struct("seen", "reason")).alias("n"))
    old = store.select("doc_id", "plane", F.struct("reason", "first_seen", "last_seen", "replay_count", "state").alias("o"))
    j = old.join(new, ["doc_id", "plane"], "full_outer")
    open_ = F.col("o.state") == "open"
    keep = F.coalesce(open_, F.lit(False))
    return j.select(
        "doc_id", "plane", F.coalesce("n.reason", "o.reason").alias("reason"), F.when(F.col("n").isNull() | keep, F.col("o.first_seen")).otherwise(F.col("n.seen")).alias("first_seen"),
        F.coalesce("n.seen", "o.last_seen").alias("last_seen"), F.when(F.col("n").isNull() | keep, F.col("o.replay_count")).otherwise(0).alias("replay_count"), F.when(F.col("n").isNotNull(), "open").otherwise(F.col("o.state")).alias("state"),
    )


def compact(spark: SparkSession, path: str, out: str, by: str | None, files: int) -> None:
    """Rewrites a table into ``files`` files, per partition value if there is one."""
    df = spark.read.parquet(path)
    (df.repartition(files, by).write.partitionBy(by) if by else df.repartition(files).write).parquet(out)


def without_old(df: DataFrame, cutoff: str, date: str = "event_date") -> DataFrame:
    """What stays after expiry: newer partitions and rows without a date."""
    return df.where(F.col(date).isNull() | (F.col(date) >= cutoff))


def lookup(store: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Point lookup of many ids at once."""
    return store.join(ids.select(key).distinct(), key, "left_semi")


def inverted_index(concepts: DataFrame) -> DataFrame:
    """(kind, key, curie): external ids and terms of concepts, as written and in lower case."""
    ids = concepts.select(F.lit("id").alias("kind"), F.explode("external_ids").alias("k"), F.col("bios_id").alias("curie"))
    terms = concepts.select(F.lit("term").alias("kind"), F.explode("terms").alias("k"), F.col("bios_id").alias("curie"))
    return ids.unionAll(terms).select("kind", F.explode(F.array_distinct(F.array(F.trim("k"), F.lower(F.trim("k"))))).alias("key"), "curie").where("key <> ''").distinct()


def tag_changes(before: DataFrame, after: DataFrame, key: str, tags: str) -> DataFrame:
    """(key, change): added, removed or changed tags, arrays compared as sets, null-safe."""
    def as_set(c):
        return F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))

    b, a = before.select(key, as_set(F.col(tags)).alias("b")), after.select(key, as_set(F.col(tags)).alias("a"))
    j = b.join(a, key, "full_outer")
    kind = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return j.withColumn("change", kind).where(F.col("change").isNotNull()).select(key, "change")


def dirty(manifest: DataFrame, parsed: DataFrame, stamps: DataFrame) -> DataFrame:
    """(doc_id, why) of documents to be worked on again: never parsed, or with another checksum than stamped."""
    j = manifest.join(parsed.select("doc_id", F.lit(True).alias("parsed")).distinct(), "doc_id", "left").join(stamps.select("doc_id", F.col("checksum").alias("stamp")), "doc_id", "left")
    why = F.when(F.col("parsed").isNull(), "unparsed").when(F.col("stamp").isNull(), "unstamped").when(F.col("stamp") != F.col("checksum"), "changed")
    return j.withColumn("why", why).where(F.col("why").isNotNull()).select("doc_id", "why")


def read_concepts_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(cid, preferred_term, terms) of a TSV of term rows (cid, kind, term): the PT row is preferred, terms in file order."""
    rows = spark.read.csv(path, sep="\t", header=True, quote="", schema="cid string, kind string, term string").withColumn("o", F.monotonically_increasing_id())
    g = rows.where(F.col("cid").startswith("CN")).groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("o", "kind", "term"))).alias("r"))
    first = F.get(F.filter("r", lambda x: x["kind"] == "PT"), F.lit(0))["term"]
    return g.select("cid", F.coalesce(first, F.get("r", F.lit(0))["term"]).alias("preferred_term"), F.array_distinct(F.transform("r", lambda x: x["term"])).alias("terms"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a declared schema; what can't be read comes in ``_corrupt``."""
    return spark.read.schema(schema + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, checksum) of the files under a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("checksum"))


def route(files: DataFrame) -> DataFrame:
    """The parser of each file (path) by its extension, with the one to fall back to."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(ext.isin("md", "txt"), "text").when(ext.isin("pdf"), "pdf").when(ext.isin("docx", "pptx", "xlsx"), "office").when(ext.isin("html", "htm"), "html").when(ext.isin("png", "jpg", "jpeg", "tif"), "ocr").otherwise("text")
    return files.select("path", kind.alias("parser"), F.when(kind == "pdf", "ocr").when(kind == "office", "pdf").otherwise("text").alias("fallback"))


def text_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, block_no, kind, level, text) of plain text or Markdown: blocks at blank lines, # headings with their level."""
    b = docs.select(key, F.posexplode(F.split(F.col(text), r"\n\s*\n")).alias("block_no", "t")).withColumn("t", F.trim("t")).where("t <> ''")
    marks = F.length(F.regexp_extract("t", r"^(#{1,6}) ", 1))
    return b.select(key, "block_no", F.when(marks > 0, "heading").otherwise("text").alias("kind"), F.when(marks > 0, marks).alias("level"), F.regexp_replace("t", r"^#{1,6} ", "").alias("text"))
