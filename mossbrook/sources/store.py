"""The chunk store: batched lookups, document scans in reading order, loads for an index, evidence rows."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mossbrook.sources.tables import Table

ORDER = ("page", "sort_order", "chunk_id")


class ChunkStore(Protocol):
    """What a store of chunks must answer; each call is about many ids at once."""

    def get(self, ids: DataFrame, release: str | None = None) -> DataFrame: ...

    def scan(self, document: str, section: str | None = None) -> DataFrame: ...

    def load(self, release: str, documents: Sequence[str] | None = None) -> DataFrame: ...


class Chunks:
    """A store over any DataFrame of chunks (chunk_id, document_id, section_path, page, sort_order, release, ...)."""

    def __init__(self, chunks: DataFrame):
        self.chunks = chunks

    def get(self, ids: DataFrame, release: str | None = None) -> DataFrame:
        """The chunks of the ids (chunk_id), of one release if given; repeated and null ids count once and not at all."""
        wanted = ids.select("chunk_id").where(F.col("chunk_id").isNotNull()).distinct()
        rows = self.chunks if release is None else self.chunks.where(F.col("release") == release)
        return rows.join(wanted, "chunk_id", "left_semi").select(*self.chunks.columns)

    def scan(self, document: str, section: str | None = None) -> DataFrame:
        """The chunks of a document, or of one section, in reading order; the filter reaches the files."""
        rows = self.chunks.where(F.col("document_id") == document)
        return (rows if section is None else rows.where(F.col("section_path") == section)).orderBy(*ORDER)

    def load(self, release: str, documents: Sequence[str] | None = None) -> DataFrame:
        """The chunks of a release, of some documents if given, in the order of an index."""
        rows = self.chunks.where(F.col("release") == release)
        rows = rows if documents is None else rows.where(F.col("document_id").isin(*documents))
        return rows.orderBy("document_id", *ORDER)


class MemoryChunks(Chunks):
    """The same over chunks held in the executors' memory, spilled to disk if they don't fit."""

    def __init__(self, chunks: DataFrame):
        super().__init__(chunks.persist())


class TableChunks(Chunks):
    """The same over a keyed table; a lookup by document opens only its bucket."""

    def __init__(self, table: Table):
        self.table = table
        super().__init__(table.read())

    def documents(self, ids: DataFrame) -> DataFrame:
        return self.table.by_key(ids)


def evidence_rows(chunks: DataFrame, documents: DataFrame, release: str) -> DataFrame:
    """Chunks as rows of the evidence table: the document's source and tier (TIER_0 without one), and their order: where they begin, or
    their place in the document if that is null or 0."""
    d = documents.groupBy("document_id").agg(F.max(F.struct("source_id", "license_tier")).alias("d"))
    place = F.row_number().over(Window.partitionBy("document_id").orderBy(F.col("page").asc_nulls_first(), "chunk_id")) - 1
    begins = F.when(F.coalesce("char_start", F.lit(0)) != 0, F.col("char_start"))
    return (
        chunks.join(d, "document_id", "left")
        .withColumn("place", place)
        .select(
            "chunk_id", "document_id", F.coalesce("section_path", F.lit("")).alias("section_path"), F.coalesce("content", F.lit("")).alias("content"), F.coalesce("page", F.lit(0)).alias("page"),
            F.lit(release).alias("release"), F.coalesce("d.source_id", F.lit("")).alias("source_id"), F.coalesce("d.license_tier", F.lit("TIER_0")).alias("license_tier"), F.coalesce(begins, "place").cast("int").alias("sort_order"),
        )
    )


def hydrated(hits: DataFrame, loaded: DataFrame, store: ChunkStore) -> DataFrame:
    """Hits (chunk_id) with their rows: those that are loaded, and the missing ones from the store, looked up together."""
    missing = hits.select("chunk_id").join(loaded, "chunk_id", "left_anti")
    more = store.get(missing).select(*loaded.columns)
    rows = loaded.select("*", F.lit(False).alias("fetched")).unionByName(more.select("*", F.lit(True).alias("fetched")))
    return hits.join(rows, "chunk_id", "left")


def unique_paths(sections: DataFrame) -> DataFrame:
    """Adds ``path``: the section's path, from the second one of a document on with " #n"; null paths stay null."""
    n = F.row_number().over(Window.partitionBy("document_id", "section_path").orderBy("ordinal"))
    return sections.withColumn("n", n).withColumn("path", F.when(F.col("n") == 1, F.col("section_path")).otherwise(F.concat("section_path", F.lit(" #"), "n"))).drop("n")
