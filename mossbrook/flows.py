"""Named flows over the lake's keyed tables: what a scheduler runs. Each is safe to run again after it died half way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mossbrook.operators import corpus as C
from mossbrook.operators import facts as K
from mossbrook.operators import quality as Q
from mossbrook.sources import lake as L
from mossbrook.sources.tables import Table

FLOWS: dict[str, Callable] = {}


def flow(f: Callable) -> Callable:
    FLOWS[f.__name__] = f
    return f


@flow
def document_ingest(tables: dict[str, Table], docs: DataFrame, sources: list[str], release: str) -> dict[str, int]:
    """Documents (doc_id, source, title, text, lang, license_tier, ...) checked, cut into chunks and written by key; those that don't pass go to
    the quarantine with their reasons. Returns the versions of the tables."""
    judged = Q.ingest_qa(docs, sources)
    good = docs.join(judged.where("accepted").select("doc_id"), "doc_id", "left_semi")
    bad = judged.where("not accepted").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("text").alias("plane"), F.col("reasons").alias("reason"), F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("seen"))
    rows = good.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("source_id"), "title", "license_tier", F.col("lang").alias("language"), F.lit(release).alias("corpus_version"))
    parts = C.chunks(good).select("chunk_id", F.col("doc_id").cast("string").alias("document_id"), "text", F.col("position").alias("sort_order"), F.lit("TEXT").alias("modality"), F.lit(release).alias("release"))
    return {
        "documents": tables["documents"].replace(rows),
        "evidence_chunks": tables["evidence_chunks"].replace(parts, good.select(F.col("doc_id").cast("string").alias("document_id"))),
        "ingest_quarantine": tables["ingest_quarantine"].replace(L.quarantined(tables["ingest_quarantine"].read(), bad)),
    }


@flow
def replay_quarantine(tables: dict[str, Table], docs: DataFrame, sources: list[str], release: str, most: int = 3) -> dict[str, int]:
    """Ingests again what is open in the quarantine and was tried fewer than ``most`` times; what passes now is closed there."""
    store = tables["ingest_quarantine"]
    open_ = store.read().where((F.col("state") == "open") & (F.coalesce("replay_count", F.lit(0)) < most))
    again = docs.join(open_.select("doc_id"), docs["doc_id"].cast("string") == open_["doc_id"], "left_semi")
    out = document_ingest(tables, again, sources, release)
    passed = tables["documents"].read().select("doc_id")
    tried = store.read().join(open_.select("doc_id", "plane"), ["doc_id", "plane"], "left_semi").withColumn("replay_count", F.coalesce("replay_count", F.lit(0)) + 1)
    state = tried.join(passed.withColumn("ok", F.lit(True)), "doc_id", "left").withColumn("state", F.when(F.col("ok"), "replayed").otherwise(F.col("state"))).drop("ok")
    return out | {"ingest_quarantine": store.replace(state)}


@flow
def claim_promote(tables: dict[str, Table], least: float = 0.8) -> int:
    """Extracted claims of a confidence of ``least`` or more become accepted."""
    t = tables["knowledge_claims"]
    rows = t.read()
    touched = rows.where((F.col("claim_status") == "extracted") & (F.col("confidence") >= least)).select("document_id").distinct()
    status = F.when((F.col("claim_status") == "extracted") & (F.col("confidence") >= least), "accepted").otherwise(F.col("claim_status"))
    return t.replace(rows.join(touched, "document_id", "left_semi").withColumn("claim_status", status))


@flow
def extract_claims(tables: dict[str, Table], docs: DataFrame) -> int:
    """The claims of documents extracted anew; those of the same documents before are replaced."""
    claims = K.claims(K.extract(docs))
    rows = claims.select("claim_id", F.col("doc_id").cast("string").alias("document_id"), F.col("subject").alias("subject_id"), "predicate", F.col("object").alias("object_id"), F.lit("extracted").alias("claim_status"), F.lit(0.72).alias("confidence"))
    return tables["knowledge_claims"].replace(rows, docs.select(F.col("doc_id").cast("string").alias("document_id")))


@flow
def reindex_full(chunks: DataFrame, key: str, text: str) -> DataFrame:
    """The postings of the lexical index of all chunks, to be written as a table."""
    from mossbrook.operators.retrieval import postings

    return postings(chunks, key, text)


@flow
def lake_maintain(tables: dict[str, Table], keep: int = 3) -> dict[str, list[int]]:
    """Compacts every table and forgets versions but the newest ``keep``."""
    out = {}
    for name, t in tables.items():
        t.compact()
        out[name] = t.expire(keep)
    return out


@flow
def ops_snapshot(tables: dict[str, Table]) -> dict[str, float]:
    """The indicators that limits are held against: open quarantine, rows by table."""
    out = {f"rows.{n}": float(t.read().count()) for n, t in tables.items()}
    return out | {"quarantine_open": float(tables["ingest_quarantine"].read().where("state = 'open'").count())}


@flow
def slo_gate(snapshot: dict[str, float], limits: dict[str, float]) -> dict[str, bool]:
    """Which limits hold; an indicator that is missing doesn't hold."""
    return {k: k in snapshot and snapshot[k] <= most for k, most in limits.items()}
