"""Queries of the chunk store, keyed tables and the world model."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from mossbrook.operators import access as A
from mossbrook.operators import corpus as C
from mossbrook.operators import graph as G
from mossbrook.operators import world as W
from mossbrook.plans.retrieval import RANK
from mossbrook.plans.base import Book, table
from mossbrook.plans.corpus import NODES
from mossbrook.plans.graph import HIER, _hierarchy
from mossbrook.session import ensure_checkpoint_dir
from mossbrook.sources import store as K
from mossbrook.sources.tables import Table

book = Book()
OWN = "HMD:ENT:"


def _chunks(spark, d):
    n = C.nodes(table(spark, d, "tree_nodes"))
    return n.select(F.col("node_id").alias("chunk_id"), "document_id", "section_path", "page", "sort_order", "content", F.col("modality").alias("release"))


def _new(spark, key, buckets=8):
    return Table(spark, f"{ensure_checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}", key, buckets)


@book.query(f"WITH {NODES} SELECT node_id AS chunk_id, section_path, page, sort_order FROM n WHERE document_id = 'DOC:REG.00000001'")
def document_scan(spark, d):
    return K.Chunks(_chunks(spark, d)).scan("DOC:REG.00000001").select("chunk_id", "section_path", "page", "sort_order")


@book.query(f"WITH {NODES} SELECT node_id AS chunk_id, document_id, page FROM n WHERE modality = 'TABLE'")
def index_load(spark, d):
    return K.MemoryChunks(_chunks(spark, d)).load("TABLE").select("chunk_id", "document_id", "page")


@book.query("""WITH h AS (SELECT DISTINCT user_id * 37 AS chunk_id FROM events) SELECT h.chunk_id, s.source, CASE WHEN s.doc_id IS NOT NULL THEN s.doc_id % 2 <> 0 END AS fetched FROM h LEFT JOIN documents s ON s.doc_id = h.chunk_id""")
def missing_hydration(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "source")
    hits = table(spark, d, "events").select((F.col("user_id") * 37).alias("chunk_id")).distinct()
    return K.hydrated(hits, docs.where("chunk_id % 2 = 0"), K.Chunks(docs)).select("chunk_id", "source", "fetched")


@book.query(f"""WITH {NODES}, c AS (SELECT node_id AS chunk_id, document_id, coalesce(section_path, '') AS section_path, coalesce(content, '') AS content, coalesce(page, 0) AS page, sort_order AS char_start,
      row_number() OVER (PARTITION BY document_id ORDER BY page NULLS FIRST, node_id) - 1 AS place FROM n WHERE node_kind = 'table'),
    s AS (SELECT document_id, max(struct_pack(source_id := coalesce(source_ref, ''), license_tier := CASE WHEN modality = 'TEXT' THEN 'TIER_1' ELSE 'TIER_2' END)) AS r FROM n WHERE node_kind = 'document' AND document_id NOT LIKE '%0' GROUP BY 1)
    SELECT chunk_id, document_id, section_path, content, page, 'r1' AS release, coalesce(r.source_id, '') AS source_id, coalesce(r.license_tier, 'TIER_0') AS license_tier, CAST(CASE WHEN coalesce(char_start, 0) <> 0 THEN char_start ELSE place END AS INTEGER) AS sort_order
    FROM c LEFT JOIN s USING (document_id)""")
def evidence_projection(spark, d):
    n = C.nodes(table(spark, d, "tree_nodes"))
    c = n.where("node_kind = 'table'").select(F.col("node_id").alias("chunk_id"), "document_id", "section_path", "content", "page", F.col("sort_order").alias("char_start"))
    tier = F.when(F.col("modality") == "TEXT", "TIER_1").otherwise("TIER_2")
    s = n.where("node_kind = 'document' and document_id not like '%0'").select("document_id", F.coalesce("source_ref", F.lit("")).alias("source_id"), tier.alias("license_tier"))
    return K.evidence_rows(c, s, "r1")


@book.query(f"""WITH {NODES}, s AS (SELECT document_id, node_id, section_path, row_number() OVER (PARTITION BY document_id, section_path ORDER BY sort_order, node_id) AS k FROM n WHERE node_kind = 'paragraph' AND section_path IS NOT NULL)
    SELECT node_id, CASE WHEN k = 1 THEN section_path ELSE section_path || ' #' || k END AS path FROM s""")
def unique_section_paths(spark, d):
    s = C.nodes(table(spark, d, "tree_nodes")).where("node_kind = 'paragraph' and section_path is not null").withColumn("ordinal", F.struct("sort_order", "node_id"))
    return K.unique_paths(s).select("node_id", "path")


@book.query("""SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_custkey % 7 = 0 THEN 1.5 END AS note FROM orders WHERE NOT (o_orderkey % 11 = 0) AND NOT (o_custkey % 7 <> 0 AND o_orderstatus = 'P')""")
def keyed_table_cycle(spark, d):
    """A table created, filled, grown by a column, replaced by key, thinned by key and by condition, compacted and expired."""
    o = table(spark, d, "orders")
    t = _new(spark, ["o_orderkey"])
    t.ensure("o_orderkey long, o_custkey long, o_orderstatus string")
    t.append(o)
    t.ensure("o_orderkey long, o_custkey long, o_orderstatus string, note double")
    t.replace(o.where("o_custkey % 7 = 0").withColumn("o_orderstatus", F.lit("X")).withColumn("note", F.lit(1.5)))
    t.delete(o.where("o_orderkey % 11 = 0"))
    t.delete_where(F.col("o_orderstatus") == "P")
    t.compact()
    t.expire(1)
    return t.read().select("o_orderkey", "o_orderstatus", "note")


@book.query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label, len(embedding) AS dims FROM embeddings WHERE label <> 4 AND vec_id % 50 = 0")
def vector_upsert(spark, d):
    """Vectors written by id, some of their labels written again without vectors, those of one label deleted, some ids asked for."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    t = _new(spark, ["vec_id"])
    t.ensure(e.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", "))
    t.upsert(e.where("label <> 9"))
    t.upsert(e.where("label = 9"))
    t.delete(e.where("label = 4"))
    t.upsert(e.where("vec_id % 3 = 0 and label <> 4").withColumn("label", F.col("label") + 100).withColumn("embedding", F.lit(None).cast("array<float>")), keep=["embedding"])
    return t.by_key(e.where("vec_id % 50 = 0")).select("vec_id", "label", F.size("embedding").cast("bigint").alias("dims"))


@book.query(f"WITH {NODES}, c AS (SELECT document_id, node_id, coalesce(page, 0) AS page FROM n WHERE node_kind IN ('table', 'figure')) SELECT document_id, node_id AS evidence_id, CASE WHEN document_id LIKE '%3' THEN page + 1000 ELSE page END AS page FROM c WHERE document_id NOT LIKE '%7'")
def evidence_by_document(spark, d):
    """Evidence replaced and deleted by whole documents."""
    c = C.nodes(table(spark, d, "tree_nodes")).where("node_kind in ('table', 'figure')").select("document_id", F.col("node_id").alias("evidence_id"), F.coalesce("page", F.lit(0)).cast("bigint").alias("page"))
    t = _new(spark, ["document_id"])
    t.ensure("document_id string, evidence_id string, page bigint")
    t.append(c)
    t.replace(c.where("document_id like '%3'").withColumn("page", F.col("page") + 1000))
    t.delete(c.where("document_id like '%7'"))
    return t.read()


CLAIM = """c AS (SELECT match_id AS claim_id, max(enterprise_id) AS subject_id, max(kind_hint) AS predicate, max(score) AS confidence, max(mention) AS object_value FROM zingg_matches WHERE match_id IS NOT NULL GROUP BY 1)"""


def _claims(spark, d):
    z = table(spark, d, "zingg_matches").where(F.col("match_id").isNotNull())
    return z.groupBy(F.col("match_id").alias("claim_id")).agg(F.max("enterprise_id").alias("subject_id"), F.max("kind_hint").alias("predicate"), F.max("score").alias("confidence"), F.max("mention").alias("object_value"))


@book.query(f"WITH {CLAIM} SELECT claim_id, CASE WHEN coalesce(confidence >= 0.85, false) THEN 'curated' ELSE 'extracted' END AS graph FROM c")
def claims_of_two_graphs(spark, d):
    c = _claims(spark, d)
    return W.all_claims(c.where("confidence >= 0.85"), c).select("claim_id", "graph")


@book.query(f"WITH {CLAIM} SELECT claim_id, subject_id FROM c WHERE predicate = 'Target' AND coalesce(confidence, 0) >= 0.8")
def fact_selection(spark, d):
    return W.select_facts(_claims(spark, d), predicate="Target", least=0.8).select("claim_id", "subject_id")


@book.query(f"""WITH {CLAIM}, q AS (SELECT claim_id AS s, unnest([struct_pack(p := 'fact:subject', o := subject_id), struct_pack(p := 'fact:predicate', o := predicate), struct_pack(p := 'fact:object', o := object_value), struct_pack(p := 'fact:evidence', o := 'E:' || claim_id)]) AS x FROM c)
    SELECT 'g:facts' AS g, s, x.p AS p, x.o AS o FROM q WHERE x.o IS NOT NULL""")
def reified_facts(spark, d):
    c = _claims(spark, d)
    f = c.select(F.col("claim_id").alias("fact_id"), F.col("subject_id").alias("subject"), "predicate", F.col("object_value").alias("object"), F.lit(None).cast("string").alias("confidence"), F.concat(F.lit("E:"), "claim_id").alias("evidence"))
    return W.reified(f, "g:facts")


@book.query("""WITH e AS (SELECT enterprise_id AS query, match_id AS evidence_id, max(note) AS quote, max(score) AS score FROM zingg_matches WHERE enterprise_id IS NOT NULL GROUP BY 1, 2)
    SELECT query, evidence_id, CAST(row_number() OVER (PARTITION BY query ORDER BY coalesce(quote, '') = '', score DESC NULLS LAST, evidence_id) AS INTEGER) AS rank FROM e""")
def evidence_first(spark, d):
    z = table(spark, d, "zingg_matches").where(F.col("enterprise_id").isNotNull())
    e = z.groupBy(F.col("enterprise_id").alias("query"), F.col("match_id").alias("evidence_id")).agg(F.max("note").alias("quote"), F.max("score").alias("score")).withColumn("text", F.lit("x"))
    return W.evidence_first(e).select("query", "evidence_id", "rank")


@book.query(f"SELECT doc_id FROM documents WHERE {RANK} <= 2 AND ({RANK} <= 1 OR coalesce(source = 'patent_full', false))")
def predicate_as_text(spark, d):
    docs = table(spark, d, "documents").withColumn("license_rank", A.rank_of(F.col("license_tier")))
    return docs.where(W.predicate_text(2, 1, ["patent_full", "made up"], ["patent_full", "lit_open"])).select("doc_id")


@book.query(f"""WITH ok AS (SELECT doc_id FROM documents WHERE {RANK} <= 2 AND ({RANK} <= 1 OR coalesce(source = 'patent_full', false)) AND coalesce(doc_type = 'FULL_TEXT', false)) SELECT event_id FROM events WHERE user_id * 37 IN (SELECT doc_id FROM ok)""")
def graph_channel_prefilter(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), A.rank_of(F.col("license_tier")).alias("license_rank"), "source", F.col("doc_type").alias("modality"))
    p = table(spark, d, "events").select("event_id", (F.col("user_id") * 37).alias("chunk_id"))
    return W.prefiltered(p, docs, 2, ["patent_full"], ["FULL_TEXT"]).select("event_id")


@book.query("SELECT DISTINCT source FROM documents WHERE source IN ('patent_full', 'lit_open')")
def known_entitlements(spark, d):
    return W.known_entitlements(["patent_full", "lit_open", "nowhere"], table(spark, d, "documents"))


@book.query("""WITH x AS (SELECT DISTINCT unnest(external_ids) AS id FROM bios_subset UNION SELECT DISTINCT 'PMID: ' || o_orderkey FROM orders UNION SELECT 'Patent:us' || o_orderkey FROM orders UNION SELECT 'exp-' || o_orderkey FROM orders)
    SELECT id, starts_with(id, 'HMD:ENT:') AS own, NOT starts_with(id, 'HMD:ENT:') AND regexp_matches(id, '^[A-Za-z][A-Za-z0-9_.]*:\\S+$') AND NOT regexp_matches(id, '^Patent:') AS external,
      CASE WHEN starts_with(id, 'PMID: ') THEN 'pubmed:' || substr(id, 7) WHEN starts_with(id, 'Patent:') THEN 'patent:' || upper(substr(id, 8)) WHEN starts_with(id, 'exp-') THEN 'eln:' || upper(id) END AS evidence FROM x""")
def id_shapes(spark, d):
    k = table(spark, d, "orders")
    x = table(spark, d, "bios_subset").select(F.explode("external_ids").alias("id"))
    for p in ("PMID: ", "Patent:us", "exp-"):
        x = x.union(k.select(F.concat(F.lit(p), "o_orderkey")))
    c = F.col("id")
    return x.distinct().select("id", W.enterprise_id(c, OWN).alias("own"), W.external_id(c, OWN).alias("external"), W.evidence_id(c).alias("evidence"))


@book.query("SELECT s_name AS component FROM supplier WHERE NOT (s_acctbal > 0) OR s_nationkey < 5")
def uncleared_components(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_name").alias("component"), (F.col("s_acctbal") > 0).alias("cleared"), F.when(F.col("s_nationkey") < 5, "2020-01-01").alias("valid_to"), F.lit("2024-01-01").alias("today"))
    return W.uncleared(s).select("component")


@book.query(f"""WITH RECURSIVE {HIER}, c AS (SELECT parent AS root, parent AS node FROM (SELECT DISTINCT parent FROM e) UNION SELECT root, child FROM c JOIN e ON e.parent = c.node) SELECT root, node FROM c WHERE root <> node""")
def narrower_concepts(spark, d):
    h = _hierarchy(spark, d)
    return W.narrower(G.descendants(h.select(F.col("parent").alias("root")), h)).select("root", "node")


LINKS = "l AS (SELECT DISTINCT concept_id AS key, unnest(consider) AS ref FROM concept_ids), i AS (SELECT DISTINCT concept_id FROM concept_ids WHERE NOT coalesce(is_obsolete, false))"


@book.query(f"WITH {LINKS} SELECT key, ref, concept_id IS NOT NULL AS resolved FROM l LEFT JOIN i ON concept_id = ref WHERE ref IS NOT NULL AND trim(ref) <> ''")
def link_resolution(spark, d):
    c = table(spark, d, "concept_ids")
    ok, bad = W.resolve_keys(c, "concept_id", "consider", c.where("not coalesce(is_obsolete, false)").select(F.col("concept_id").alias("ref"), F.col("concept_id").alias("id")))
    return ok.select("key", "ref", F.lit(True).alias("resolved")).union(bad.select("key", "ref", F.lit(False)))


@book.query(f"""WITH {NODES} SELECT 'entities' AS part, count(*) AS rows FROM bios_subset UNION ALL SELECT 'dictionary', count(*) FROM (SELECT unnest(terms) FROM bios_subset) UNION ALL SELECT 'claims', count(*) FROM zingg_matches
    UNION ALL SELECT 'evidence', count(*) FROM n WHERE node_kind = 'table' UNION ALL SELECT 'assets', count(*) FROM n WHERE node_kind = 'figure'""")
def world_stats(spark, d):
    b, n = table(spark, d, "bios_subset"), C.nodes(table(spark, d, "tree_nodes"))
    return W.World(b, b.select(F.explode("terms")), table(spark, d, "zingg_matches"), n.where("node_kind = 'table'"), n.where("node_kind = 'figure'")).stats()


@book.query(f"WITH {CLAIM} SELECT claim_id, 'new' AS state FROM c WHERE confidence >= 0.9 UNION ALL SELECT claim_id, 'extracted' FROM c WHERE confidence < 0.5")
def world_sync(spark, d):
    """The curated graph replaced by a newer release, which lacks some of its claims; the extracted graph stays."""
    c = _claims(spark, d).select("claim_id", "confidence")
    tables = {n: _new(spark, ["claim_id"]) for n in ("curated", "extracted")}
    for t in tables.values():
        t.ensure("claim_id string, state string")
    tables["curated"].append(c.where("confidence >= 0.8").withColumn("state", F.lit("old")))
    W.append_extracted(tables["extracted"], c.where("confidence < 0.5").withColumn("state", F.lit("extracted")), c.where("confidence < 0.5"))
    W.sync(tables, {"curated": c.where("confidence >= 0.9").withColumn("state", F.lit("new"))})
    return tables["curated"].read().unionByName(tables["extracted"].read())
