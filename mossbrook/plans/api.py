"""Queries of the public operations, plug-ins, the write-ahead log and the stateful fold."""

from __future__ import annotations

import json
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import functions as F

from mossbrook import plugins as P
from mossbrook.api import Lake, Scope
from mossbrook.operators import events as E
from mossbrook.plans import linking
from mossbrook.plans.base import Book, table
from mossbrook.plans.corpus import NODES
from mossbrook.plans.events import BACKLOG, OBS
from mossbrook.plans.linking import DICT, KEY
from mossbrook.plans.retrieval import BM25, DENSE, RANK, _queries, _vector_queries
from mossbrook.session import ensure_checkpoint_dir
from mossbrook.sources import seeds
from mossbrook.sources.tables import Table
from mossbrook.streaming import observations as O
from mossbrook.streaming import wal

book = Book()
CLAIM = """c AS (SELECT match_id AS claim_id, max(enterprise_id) AS subject_id, max(kind_hint) AS predicate, 'HMD:ENT:DC:' || right(match_id, 7) AS object_id, max(score) AS confidence FROM zingg_matches WHERE match_id IS NOT NULL GROUP BY 1)"""


def _lake(spark, d, scope=Scope(2, 1, ("patent_full",))):
    t = {n: table(spark, d, n) for n in ("bios_subset", "documents", "tree_nodes", "zingg_matches")}
    claims = (
        t["zingg_matches"].where(F.col("match_id").isNotNull()).groupBy(F.col("match_id").alias("claim_id"))
        .agg(F.max("enterprise_id").alias("subject_id"), F.max("kind_hint").alias("predicate"), F.max("score").alias("confidence"))
        .withColumn("object_id", F.concat(F.lit("HMD:ENT:DC:"), F.right("claim_id", F.lit(7)))).withColumn("claim_status", F.lit("open")).withColumn("evidence_id", F.lit(None).cast("string"))
    )
    edges = claims.select(F.col("subject_id").alias("src"), F.lit("has_target").alias("predicate"), F.col("object_id").alias("dst"))
    assets = t["tree_nodes"].where("node_kind = 'figure'").select(F.col("node_id").alias("asset_id"), "entity_ids", F.col("content").alias("title"), F.col("ingested_at").alias("at"))
    return Lake(t["bios_subset"], t["documents"], t["tree_nodes"], t["zingg_matches"], edges, claims, assets, scope)


def _entities(spark, d):
    return table(spark, d, "bios_subset").select(F.explode("external_ids").alias("entity")).where("entity like 'HMD:%'").distinct()


@book.query(f"WITH {DICT} SELECT DISTINCT mention, concept_id, scope FROM (SELECT DISTINCT mention, {KEY.format('mention')} AS alias_norm FROM zingg_matches WHERE mention IS NOT NULL) JOIN dict USING (alias_norm)")
def tool_resolve_alias(spark, d):
    return _lake(spark, d).resolve_alias(table(spark, d, "zingg_matches").where("mention is not null"))


@book.query(f"SELECT * FROM ({linking.book.oracles['cascade_resolve']}) WHERE mention IN (SELECT mention FROM zingg_matches)")
def tool_normalize_entity(spark, d):
    return _lake(spark, d).normalize_entity(table(spark, d, "zingg_matches").where("trim(mention) <> ''"))


@book.query("""WITH x AS (SELECT DISTINCT bios_id, unnest(external_ids) AS id FROM bios_subset), a AS (SELECT DISTINCT id, bios_id AS concept_id FROM x WHERE id LIKE 'HMD:%') SELECT id, concept_id, max(preferred_term) AS label FROM a JOIN bios_subset ON bios_id = concept_id GROUP BY 1, 2""")
def tool_get_concept(spark, d):
    return _lake(spark, d).get_concept(_entities(spark, d).select(F.col("entity").alias("id"))).select("id", "concept_id", "label")


@book.query(f"""WITH {BM25}, ok AS (SELECT doc_id, source, substr(title, 1, 300) AS snippet FROM documents WHERE {RANK} <= 2 AND ({RANK} <= 1 OR coalesce(source = 'patent_full', false))),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM bm JOIN ok USING (doc_id)) SELECT qid, doc_id, score, rank, source, snippet FROM r WHERE rank <= 10""")
def tool_search_documents(spark, d):
    return _lake(spark, d).search_documents(_queries(spark, d))


@book.query(f"WITH {CLAIM} SELECT claim_id, object_id FROM c WHERE predicate = 'Target' AND coalesce(confidence, 0) >= 0.5")
def tool_get_facts(spark, d):
    return _lake(spark, d).get_facts(predicate="Target", least=0.5).select("claim_id", "object_id")


@book.query(f"WITH {CLAIM}, e AS (SELECT DISTINCT subject_id AS src, object_id AS dst FROM c WHERE subject_id IS NOT NULL) SELECT src AS seed, dst AS node, CAST(1 AS INTEGER) AS hops, 0.65::DOUBLE AS weight FROM e WHERE src <> dst")
def tool_expand_concept(spark, d):
    lake = _lake(spark, d)
    return lake.expand_concept(lake.edges.select(F.col("src").alias("seed")).where("seed is not null"), 2)


@book.query(f"""WITH {NODES}, s AS (SELECT DISTINCT parent_id AS section FROM n WHERE node_kind = 'table' AND parent_id IS NOT NULL), p AS (SELECT section, node_id, content, coalesce(sum(length(content) + 2) OVER (PARTITION BY section ORDER BY sort_order NULLS FIRST, node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM n JOIN s ON parent_id = section WHERE length(content) > 0)
    SELECT section, node_id, substr(content, 1, CAST(8000 - used AS INTEGER)) AS piece FROM p WHERE used < 8000""")
def tool_restore_context(spark, d):
    lake = _lake(spark, d)
    return lake.restore_context(lake.nodes.where("node_kind = 'table'"))


@book.query("SELECT s_suppkey AS item, 'CORRECT' AS verdict FROM supplier WHERE s_suppkey % 2 = 1")
def tool_submit_feedback(spark, d):
    t = Table(spark, f"{ensure_checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}", ["item"], 4)
    t.ensure("item long, verdict string")
    s = table(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 2 == 1, F.col("s_suppkey")).alias("item"), F.lit("CORRECT").alias("verdict"))
    _lake(spark, d).submit_feedback(s, t)
    return t.read()


@book.query("WITH x AS (SELECT lower(id) AS k, min(bios_id) AS concept_id FROM (SELECT bios_id, unnest(external_ids) AS id FROM bios_subset) GROUP BY 1), q AS (SELECT DISTINCT lower(unnest(external_ids)) AS id FROM bios_subset UNION SELECT 'none:1') SELECT id, concept_id FROM q LEFT JOIN x ON k = id")
def op_lookup_concept(spark, d):
    q = table(spark, d, "bios_subset").select(F.explode("external_ids").alias("e")).select(F.lower("e").alias("id"))
    return _lake(spark, d).lookup_concept(q.union(spark.createDataFrame([("none:1",)], "id string")))


@book.query(f"""WITH {CLAIM}, e AS (SELECT DISTINCT id AS entity FROM (SELECT unnest(external_ids) AS id FROM bios_subset) WHERE id LIKE 'HMD:%'), a AS (SELECT subject_id AS entity, predicate, object_id AS other, true AS outward FROM c UNION SELECT object_id, predicate, subject_id, false FROM c) SELECT DISTINCT * FROM a WHERE other IS NOT NULL AND entity IN (SELECT entity FROM e)""")
def op_relationships(spark, d):
    return _lake(spark, d).get_relationships(_entities(spark, d))


@book.query(f"""WITH {NODES}, e AS (SELECT DISTINCT id AS entity FROM (SELECT unnest(external_ids) AS id FROM bios_subset) WHERE id LIKE 'HMD:%'), x AS (SELECT DISTINCT node_id AS evidence_id, unnest(entity_ids) AS entity FROM n) SELECT entity, evidence_id FROM x WHERE entity IN (SELECT entity FROM e)""")
def op_entity_evidence(spark, d):
    return _lake(spark, d).get_entity_evidence(_entities(spark, d))


@book.query(f"""WITH {NODES}, e AS (SELECT DISTINCT id AS entity FROM (SELECT unnest(external_ids) AS id FROM bios_subset) WHERE id LIKE 'HMD:%'), x AS (SELECT DISTINCT node_id AS evidence_id, unnest(entity_ids) AS entity, length(content) AS n FROM n), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY entity ORDER BY n DESC NULLS LAST, evidence_id) AS INTEGER) AS rank FROM x WHERE entity IN (SELECT entity FROM e))
    SELECT entity, evidence_id, rank FROM r WHERE rank <= 5""")
def op_search_evidence(spark, d):
    return _lake(spark, d).search_evidence(_entities(spark, d))


@book.query("""WITH a AS (SELECT node_id AS asset_id, max(struct_pack(at := ingested_at, e := entity_ids)) AS r FROM tree_nodes WHERE node_kind = 'figure' GROUP BY 1), e AS (SELECT DISTINCT id FROM (SELECT unnest(external_ids) AS id FROM bios_subset) WHERE id LIKE 'HMD:%'), x AS (SELECT DISTINCT unnest(r.e) AS entity, asset_id FROM a) SELECT entity, asset_id FROM x WHERE entity IN (SELECT id FROM e)""")
def op_entity_assets(spark, d):
    return _lake(spark, d).get_entity_assets(_entities(spark, d))


@book.query()
def golden_path(spark, d):
    return _lake(spark, d).golden_path(table(spark, d, "bios_subset").where("preferred_term is not null").select(F.col("preferred_term").alias("mention")))


@book.query(f"""WITH {BM25}, {DENSE.replace('SELECT vec_id AS qid', 'SELECT (SELECT min(item_id) FROM eval_items) + 3 * (vec_id / 50)::BIGINT AS qid')}, c1 AS (SELECT qid, doc_id AS k, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM bm), c2 AS (SELECT qid, vec_id AS k, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM de)
    SELECT qid, k AS key, round(sum(w / (60 + rank)), 6)::DOUBLE AS fused FROM (SELECT qid, k, 1.0 AS w, rank FROM c1 WHERE rank <= 5 UNION ALL SELECT qid, k, 0.5, rank FROM c2 WHERE rank <= 5) GROUP BY 1, 2""")
def search_backends(spark, d):
    backends = {"lexical": P.Lexical(table(spark, d, "documents"), "doc_id", "text"), "dense": P.Dense(table(spark, d, "embeddings"), "vec_id", "embedding")}
    return P.search(backends, {"lexical": _queries(spark, d), "dense": _vector_queries(spark, d)}, {"dense": 0.5}, 5).select("qid", "key", "fused")


@book.query("""WITH b AS (SELECT doc_id::VARCHAR AS path, list_filter(regexp_split_to_array(text, '\\n[ \\t]*\\n'), lambda x: trim(x) <> '') AS b FROM documents WHERE text IS NOT NULL) SELECT path, CAST(generate_subscripts(b, 1) - 1 AS INTEGER) AS place, unnest(b) AS text FROM b""")
def layout_blocks(spark, d):
    return P.PlainLayout().extract(table(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content")))


REGISTRY = "r AS (SELECT source, target_share >= 0.05 AS active, CASE WHEN max_repeats > 1 THEN 'B' ELSE 'A' END AS track, CASE WHEN target_share >= 0.1 THEN ['Drug', 'Disease'] ELSE ['Drug'] END AS kinds, CAST(round(target_share * 100) AS INTEGER) AS authority FROM mix_targets)"


def _registry(spark, d):
    m = table(spark, d, "mix_targets")
    kinds = F.when(F.col("target_share") >= 0.1, F.array(F.lit("Drug"), F.lit("Disease"))).otherwise(F.array(F.lit("Drug")))
    return m.select("source", (F.col("target_share") >= 0.05).alias("active"), F.when(F.col("max_repeats") > 1, "B").otherwise("A").alias("track"), kinds.alias("kinds"), F.round(F.col("target_share") * 100).cast("int").alias("authority"), F.col("max_repeats").alias("slot"))


@book.query(f"WITH {REGISTRY}, k AS (SELECT source, authority, unnest(kinds) AS kind FROM r WHERE active) SELECT 'authority' AS list, kind AS name, arg_min(source, (-authority, source)) AS source FROM k GROUP BY kind UNION ALL SELECT 'active A', '', source FROM r WHERE active AND track = 'A' UNION ALL SELECT 'later', '', source FROM r WHERE NOT active")
def source_registry(spark, d):
    r = _registry(spark, d)
    a = P.authoritative(r).select(F.lit("authority").alias("list"), F.col("kind").alias("name"), "source")
    return a.union(P.active(r, "A").select(F.lit("active A"), F.lit(""), "source")).union(P.procurement(r).select(F.lit("later"), F.lit(""), "source"))


@book.query("SELECT doc_id, length(text) AS size FROM documents WHERE text IS NOT NULL")
def content_cache(spark, d):
    """Sizes computed once per distinct text through a cache, which the second half of the documents finds half full."""
    cache = Table(spark, f"{ensure_checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}", ["hash"], 8)
    cache.ensure("hash string, size long")

    def sizes(batches):
        for pdf in batches:
            yield pdf[["hash"]].assign(size=pdf["text"].map(len))

    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    P.cached(docs.where("doc_id % 2 = 0"), "text", cache, sizes, "hash string, size long")
    return P.cached(docs, "text", cache, sizes, "hash string, size long").select("doc_id", "size")


@book.query("SELECT 'N' || n_nationkey AS child, 'broader' AS predicate, CASE WHEN n_regionkey <> 2 THEN 'R' || n_regionkey END AS parent, n_regionkey <> 2 AS resolved FROM nation")
def seed_links(spark, d):
    """A seed file written from two tables, read back, its links resolved; one region is missing from it."""
    regions = [{"key": f"R{r.r_regionkey}", "preferred_label_en": r.r_name} for r in table(spark, d, "region").where("r_regionkey <> 2").collect()]
    nations = [{"key": f"N{r.n_nationkey}", "preferred_label_en": r.n_name, "parents": [f"R{r.n_regionkey}"]} for r in table(spark, d, "nation").collect()]
    with tempfile.TemporaryDirectory() as folder:
        path = Path(folder) / "places.json"
        path.write_text(json.dumps({"entity_type": "Place", "concepts": regions + nations}))
        edges, missing = seeds.links(seeds.seed(spark, str(path)))
    return edges.withColumn("resolved", F.lit(True)).unionByName(missing.select(F.col("key").alias("child"), "predicate", F.lit(None).cast("string").alias("parent"), F.lit(False).alias("resolved")))


FEED = "f AS (SELECT mention_key FROM o WHERE mention_key LIKE 'error%' GROUP BY 1)"


@book.query(f"WITH {OBS}, {FEED}, {BACKLOG.format('(SELECT * FROM o WHERE mention_key NOT IN (SELECT mention_key FROM f))')}")
def feedback_edge(spark, d):
    """The backlog after some of its keys were mapped: their closing events are appended and folded with the rest."""
    o = O.observations(table(spark, d, "events"))
    mapped = o.where("mention_key like 'error%'").select("mention_key", F.lit("C").alias("concept"))
    return E.backlog(o.unionByName(wal.closing_events(E.backlog(o), mapped, "2999-01-01 00:00:00")))


@book.query("SELECT event_id, event_type FROM events")
def wal_replay(spark, d):
    """Events whose broker was away, logged, then replayed: a first go fails on some files, more follow until none is left or one sends nothing."""
    base = f"{ensure_checkpoint_dir(spark)}/wal/{uuid.uuid4().hex}"
    e = table(spark, d, "events").select("event_id", "event_type")

    def away(_):
        raise ConnectionError("no broker")

    def send(rows):
        rows.write.mode("append").parquet(f"{base}/topic")

    goes = []

    def unsteady(rows):
        goes.append(1)
        if len(goes) % 2:
            raise ConnectionError("broker went away")
        send(rows)

    wal.produce(e.repartition(4), away, f"{base}/log")
    wal.replay(spark, f"{base}/log", "event_id long, event_type string", unsteady)
    while (went := wal.replay(spark, f"{base}/log", "event_id long, event_type string", send))["sent"] and went["left"]:
        pass
    assert not wal.waiting(spark, f"{base}/log", "event_id long, event_type string").first()["lines"]
    return spark.read.parquet(f"{base}/topic").dropDuplicates(["event_id"])


@book.query(f"WITH {OBS} SELECT mention_key, count(*) AS occurrences, arg_max(status, event_ts || observation_id) AS status FROM o WHERE mention_key <> '' GROUP BY 1")
def stream_stateful_fold(spark, d):
    """The fold kept as state over three triggers, put out as it changes and written by key, equals the fold over the table."""
    base = f"{ensure_checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    for k in range(3):
        e.where(f"event_id % 3 = {k}").coalesce(1).write.parquet(f"{base}/in/part={k}")
    out = Table(spark, f"{base}/out", ["mention_key"], 4)
    out.ensure("mention_key string, occurrences long, status string")
    s = O.source(spark, f"{base}/in/*", "event_id long, ts timestamp, user_id long, event_type string, value double", "parquet", 1)
    q = wal.folded(O.observations(s)).writeStream.outputMode("update").foreachBatch(lambda batch, _: out.replace(batch)).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return out.read()


@book.query("""WITH t AS (SELECT doc_id::VARCHAR AS doc_id, CASE WHEN coalesce(trim(text), '') = '' THEN false ELSE coalesce(source IN ('lit_open', 'trial_registry', 'patent_full', 'label_text'), false) END AS ok FROM documents) SELECT count(*) FILTER (ok) AS least_documents, count(*) AS documents FROM t""")
def flow_ingest(spark, d):
    """A first load by the flows, run twice, compacted: accepted and quarantined documents add up to all."""
    from mossbrook import flows
    from mossbrook.sources.tables import lake

    tables = lake(spark, f"{ensure_checkpoint_dir(spark)}/lakes/{uuid.uuid4().hex}")
    docs = table(spark, d, "documents")
    known = ["lit_open", "trial_registry", "patent_full", "label_text"]
    for _ in range(2):
        flows.document_ingest(tables, docs, known, "r1")
    flows.lake_maintain({n: tables[n] for n in ("documents", "ingest_quarantine")}, 1)
    good, bad = tables["documents"].read().select("doc_id"), tables["ingest_quarantine"].read().where("state = 'open'").select("doc_id")
    ok = F.coalesce(F.trim("text") != "", F.lit(False)) & F.coalesce(F.col("source").isin(*known), F.lit(False))
    wrong = good.join(docs.where(~ok).select(F.col("doc_id").cast("string")), "doc_id", "left_semi").count()
    every = good.unionByName(bad).agg(F.count_distinct("doc_id").alias("documents"))
    return docs.agg(F.count_if(ok).alias("least_documents")).join(F.broadcast(every)).where(F.lit(wrong) == 0).select("least_documents", "documents")
