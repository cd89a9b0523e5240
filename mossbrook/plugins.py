"""What can be plugged in: search back ends, vector indexes, scorers, extractors, layout readers, sources; with offline defaults."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mossbrook.operators import facts as K
from mossbrook.operators import graph as G
from mossbrook.operators import linking as L
from mossbrook.operators import retrieval as R


class SearchBackend(Protocol):
    def retrieve(self, queries: DataFrame, k: int) -> DataFrame: ...


class VectorIndex(Protocol):
    def search(self, mentions: DataFrame, k: int) -> DataFrame: ...


class Reranker(Protocol):
    def rescore(self, pairs: DataFrame) -> DataFrame: ...


class FactExtractor(Protocol):
    def extract(self, texts: DataFrame) -> DataFrame: ...


class Neighbourhood(Protocol):
    def neighbors(self, seeds: DataFrame) -> DataFrame: ...


class Disambiguator(Protocol):
    def choose(self, mention: Column, context: Column) -> Column: ...


class LayoutBackend(Protocol):
    def extract(self, files: DataFrame) -> DataFrame: ...


class Lexical:
    """Words, BM25."""

    def __init__(self, docs: DataFrame, key: str, text: str):
        self.docs, self.key, self.text = docs, key, text

    def retrieve(self, queries: DataFrame, k: int) -> DataFrame:
        return R.channel(R.bm25(queries, self.docs, self.key, self.text, k), "lexical", self.key)


class Dense:
    """Vectors, exact cosine in blocks; queries (qid, qvec)."""

    def __init__(self, vectors: DataFrame, key: str, vector: str):
        self.vectors, self.key, self.vector = vectors, key, vector

    def retrieve(self, queries: DataFrame, k: int) -> DataFrame:
        return R.channel(R.dense(queries, self.vectors, self.key, self.vector, k), "dense", self.key)


class Grams:
    """A vector index of aliases by trigrams."""

    def __init__(self, aliases: DataFrame):
        self.aliases = aliases

    def search(self, mentions: DataFrame, k: int) -> DataFrame:
        return L.gram_similarity(mentions, self.aliases, k=k)


class NoReranker:
    """Leaves the order: no pair gets a score."""

    def rescore(self, pairs: DataFrame) -> DataFrame:
        return pairs.select("qid", "key", F.lit(None).cast("double").alias("rerank"))


class Overlap:
    """Scores a passage by the share of the query's words that it holds."""

    def rescore(self, pairs: DataFrame) -> DataFrame:
        from mossbrook.functions import text as X

        q, p = F.array_distinct(X.words(F.col("query"))), X.words(F.col("passage"))
        return pairs.select("qid", "key", F.round(F.size(F.array_intersect(q, p)) / F.greatest(F.size(q), F.lit(1)), 6).alias("rerank"))


class Patterns:
    """The extractor by sentence patterns."""

    def extract(self, texts: DataFrame) -> DataFrame:
        return K.extract(texts)


class Walk:
    def __init__(self, edges: DataFrame, hops: int = 2):
        self.edges, self.hops = edges, hops

    def neighbors(self, seeds: DataFrame) -> DataFrame:
        return G.walk(seeds, self.edges, self.hops)


class Abstain:
    """A model that isn't there: every ambiguous mention stays open."""

    def choose(self, mention: Column, context: Column) -> Column:
        return F.lit(None).cast("string")


class PlainLayout:
    """Blocks of text files (path, content): parted by blank lines, with their place."""

    def extract(self, files: DataFrame) -> DataFrame:
        blocks = F.filter(F.split(F.col("content").cast("string"), r"\n[ \t]*\n"), lambda b: F.trim(b) != "")
        return files.select("path", F.posexplode(blocks).alias("place", "text"))


def search(backends: dict[str, SearchBackend], queries: dict[str, DataFrame], weights: dict[str, float], k: int) -> DataFrame:
    """(qid, key, fused, ranks): all back ends asked and fused by their ranks."""
    return R.rrf([b.retrieve(queries[name], k).withColumn("channel", F.lit(name)) for name, b in backends.items()], weights)


def reranked(fused: DataFrame, passages: DataFrame, queries: DataFrame, scorer: Reranker) -> DataFrame:
    """The fused list in the order of a scorer, which sees each pair once."""
    pairs = fused.select("qid", "key").join(queries, "qid").join(passages, "key")
    return R.rerank(fused, scorer.rescore(pairs))


# -- sources
SOURCES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], bool]] = {}


def register_source(name: str, needs_licence: bool = False):
    """Registers a reader under a name; ``needs_licence`` ones are read only by who says that the licence was accepted."""

    def add(reader: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        if name in SOURCES:
            raise ValueError(f"source {name} is registered")
        SOURCES[name] = (reader, needs_licence)
        return reader

    return add


def load_source(spark: SparkSession, name: str, path: str, accepted: bool = False) -> DataFrame:
    if name not in SOURCES:
        raise KeyError(f"no source {name}; there are {', '.join(sorted(SOURCES))}")
    reader, needs_licence = SOURCES[name]
    if needs_licence and not accepted:
        raise PermissionError(f"{name}: its licence must be accepted first")
    return reader(spark, path)


@register_source("gene_table", needs_licence=True)
def _genes(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated gene records as concepts: id, symbol, name, synonyms parted by bars."""
    t = spark.read.option("header", True).option("sep", "\t").csv(path)
    return t.select(F.col("id").alias("bios_id"), F.col("symbol").alias("preferred_term"), F.concat(F.array("symbol", "name"), F.coalesce(F.split("synonyms", r"\|"), F.array().cast("array<string>"))).alias("terms"), F.array("id").alias("external_ids"))


@register_source("concept_lines")
def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("bios_id string, preferred_term string, terms array<string>, external_ids array<string>, semtypes array<string>").json(path)


# -- registry of sources
def active(registry: DataFrame, track: str | None = None, kind: str | None = None) -> DataFrame:
    """Registered sources (source, active, track, kinds, authority, slot) that are active, of one track and for one kind of entity."""
    out = registry.where(F.coalesce("active", F.lit(False)))
    out = out if track is None else out.where(F.col("track") == track)
    return out if kind is None else out.where(F.coalesce(F.array_contains("kinds", kind), F.lit(False)))


def authoritative(registry: DataFrame) -> DataFrame:
    """(kind, source): the active source of highest authority for each kind, ties by name."""
    each = active(registry).select("source", "authority", F.explode("kinds").alias("kind"))
    best = each.groupBy("kind").agg(F.min(F.struct((-F.coalesce("authority", F.lit(0))).alias("a"), "source")).alias("b"))
    return best.select("kind", F.col("b.source").alias("source"))


def procurement(registry: DataFrame) -> DataFrame:
    """Sources that aren't active yet, in the order of their slots."""
    return registry.where(~F.coalesce("active", F.lit(False))).orderBy(F.col("slot").asc_nulls_last(), "source")


# -- a cache in front of anything costly
def cached(rows: DataFrame, content: str, cache, compute: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """``compute`` over the distinct contents that a keyed table ``cache`` (hash, ...) hasn't seen; adds them to it and returns the rows with
    what it holds. Equal contents are computed once, however many rows have them."""
    hashed = rows.withColumn("hash", F.sha2(F.col(content).cast("string"), 256))
    new = hashed.select("hash", content).where(F.col(content).isNotNull()).dropDuplicates(["hash"]).join(cache.read().select("hash"), "hash", "left_anti")
    cache.replace(new.mapInPandas(compute, schema))
    return hashed.join(cache.read(), "hash", "left")


def composite(parts: Sequence[Callable[[Column], Column]], text: Column) -> Column:
    """Vectors of several embedders, one after the other."""
    return F.concat(*[p(text) for p in parts])
