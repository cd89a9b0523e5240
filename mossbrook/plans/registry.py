"""All queries of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mossbrook.plans import access, api, context, corpus, events, graph, history, linking, mining, quality, retrieval, world

FLAGSHIP = "rrf_fusion"
BOOKS = (access.book, linking.book, graph.book, corpus.book, retrieval.book, events.book, quality.book, context.book, world.book, mining.book, api.book)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**history.QUERIES}
ORACLES: dict[str, str] = {**history.ORACLES}
for _b in BOOKS:
    QUERIES |= _b.queries
    ORACLES |= _b.oracles
