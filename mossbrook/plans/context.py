"""Queries of spans, vectors and entity context."""

from __future__ import annotations

from pyspark.sql import functions as F

from mossbrook.functions import spans as P
from mossbrook.functions import vectors as E
from mossbrook.operators import context as C
from mossbrook.operators import facts as K
from mossbrook.operators import linking as L
from mossbrook.operators.corpus import nodes
from mossbrook.plans.base import Book, table
from mossbrook.plans.corpus import FACTS, NODES
from mossbrook.plans.linking import DICT, KEY

book = Book()
W = "regexp_extract_all(text, '[\\p{L}\\p{N}][\\p{L}\\p{N}\\-]*')"
OCC = f"""{DICT}, t AS (SELECT doc_id, {W} AS w FROM documents), a AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS start FROM t), b AS (SELECT doc_id, w, start, unnest([1, 2, 3, 4]) AS size FROM a),
    s AS (SELECT doc_id, start, size, array_to_string(w[start:start + size - 1], ' ') AS span FROM b WHERE start + size - 1 <= len(w)), occ AS (SELECT DISTINCT doc_id, CAST(start AS INTEGER) AS start, CAST(size AS INTEGER) AS size, span, concept_id FROM s JOIN dict ON {KEY.format('span')} = alias_norm)"""


def _found(spark, d):
    return P.occurrences(table(spark, d, "documents"), L.dictionary(table(spark, d, "bios_subset")), "doc_id")


@book.query(f"WITH {OCC} SELECT * FROM occ")
def span_occurrences(spark, d):
    return _found(spark, d)


@book.query(f"WITH {OCC} SELECT * FROM occ a WHERE NOT EXISTS (SELECT 1 FROM occ b WHERE b.doc_id = a.doc_id AND b.start <= a.start AND b.start + b.size >= a.start + a.size AND b.size > a.size)")
def maximal_spans(spark, d):
    return P.maximal(_found(spark, d), "doc_id")


@book.query()
def tagged_spans(spark, d):
    return P.longest_first(_found(spark, d), "doc_id")


@book.query(f"""WITH m AS (SELECT DISTINCT mention AS text FROM zingg_matches WHERE mention IS NOT NULL), t AS (SELECT text, {W} AS w FROM m), a AS (SELECT text, w, unnest(range(1, len(w) + 1)) AS i FROM t), b AS (SELECT text, w, i, unnest([1, 2, 3, 4]) AS k FROM a)
    SELECT DISTINCT text, array_to_string(w[i:i + k - 1], ' ') AS span FROM b WHERE i + k - 1 <= len(w)""")
def span_windows(spark, d):
    m = table(spark, d, "zingg_matches").where(F.col("mention").isNotNull()).select(F.col("mention").alias("text")).distinct()
    return m.select("text", F.explode(P.windows(F.col("text"))).alias("span"))


@book.query()
def hashed_vectors(spark, d):
    return table(spark, d, "documents").select("doc_id", E.embed(F.col("text")).alias("vector"))


CL = f"{FACTS}, c AS (SELECT DISTINCT subject, object, doc_id FROM facts WHERE predicate = 'given_with'), e AS (SELECT DISTINCT preferred_term AS entity FROM bios_subset WHERE preferred_term IS NOT NULL)"


def _claims(spark, d):
    c = K.claims(K.extract(table(spark, d, "documents"))).where("predicate = 'given_with'")
    e = table(spark, d, "bios_subset").where(F.col("preferred_term").isNotNull()).select(F.col("preferred_term").alias("entity"))
    return c, e


@book.query(f"WITH {CL} SELECT DISTINCT entity, other FROM (SELECT subject AS entity, object AS other FROM c UNION SELECT object, subject FROM c) WHERE entity <> other AND entity IN (SELECT entity FROM e)")
def related_entities(spark, d):
    return C.related(*_claims(spark, d))


@book.query(f"""WITH {CL}, x AS (SELECT subject AS entity, count(*) AS claims FROM c GROUP BY 1), y AS (SELECT object AS entity, count(*) AS cited FROM c GROUP BY 1)
    SELECT entity, coalesce(claims, 0) AS claims, coalesce(cited, 0) AS cited, array_to_string(list_filter([CASE WHEN claims IS NULL THEN 'claims' END, CASE WHEN cited IS NULL THEN 'cited' END], lambda z: z IS NOT NULL), ',') AS missing FROM e LEFT JOIN x USING (entity) LEFT JOIN y USING (entity)""")
def context_pack(spark, d):
    c, e = _claims(spark, d)
    return C.context_pack(e, {"claims": c.select(F.col("subject").alias("entity")), "cited": c.select(F.col("object").alias("entity"))})


@book.query(f"""WITH {NODES}, ev AS (SELECT node_id AS evidence_id, entity_ids, parent_id FROM n WHERE node_kind IN ('table', 'figure')), c AS (SELECT DISTINCT unnest(entity_ids) AS subject, node_id AS evidence_id FROM n WHERE node_kind = 'caption'), w AS (SELECT DISTINCT enterprise_id AS entity FROM zingg_matches WHERE score >= 0.9)
    SELECT DISTINCT entity, evidence_id FROM (SELECT evidence_id, unnest(entity_ids) AS entity FROM ev UNION ALL SELECT c.evidence_id, subject FROM c WHERE c.evidence_id IN (SELECT evidence_id FROM ev)) WHERE entity IN (SELECT entity FROM w)""")
def entity_evidence(spark, d):
    n = nodes(table(spark, d, "tree_nodes"))
    ev = n.where("node_kind in ('table', 'figure')").select(F.col("node_id").alias("evidence_id"), "entity_ids")
    c = n.where("node_kind = 'caption'").select(F.explode("entity_ids").alias("subject"), F.col("node_id").alias("evidence_id"))
    return C.evidence_for(ev, c, table(spark, d, "zingg_matches").where("score >= 0.9").select(F.col("enterprise_id").alias("entity")))


@book.query(f"""WITH {NODES}, w AS (SELECT DISTINCT enterprise_id AS id FROM zingg_matches WHERE score >= 0.95) SELECT node_id, count(DISTINCT id) AS hits FROM (SELECT node_id, unnest(entity_ids) AS id FROM n) WHERE id IN (SELECT id FROM w) GROUP BY 1""")
def overlap_join(spark, d):
    return C.overlapping(nodes(table(spark, d, "tree_nodes")), "node_id", "entity_ids", table(spark, d, "zingg_matches").where("score >= 0.95").select(F.col("enterprise_id").alias("id")))


@book.query("""WITH x AS (SELECT DISTINCT bios_id, unnest(external_ids) AS e FROM bios_subset), p AS (SELECT DISTINCT e FROM x WHERE e LIKE 'XCHEM:%' OR e LIKE 'XGENE:0%') SELECT bios_id, e AS enterprise_id FROM x WHERE e LIKE 'HMD:ENT:%' AND bios_id IN (SELECT bios_id FROM x WHERE e IN (SELECT e FROM p))""")
def enterprise_bridges(spark, d):
    b = table(spark, d, "bios_subset")
    pool = b.select(F.explode("external_ids").alias("external_id")).where("external_id like 'XCHEM:%' or external_id like 'XGENE:0%'")
    return C.bridges(b, pool)


@book.query(f"""WITH {DICT}, x AS (SELECT DISTINCT bios_id AS expected, unnest(external_ids) AS e FROM bios_subset), m AS (SELECT DISTINCT mention, kind_hint, expected FROM zingg_matches JOIN x ON e = enterprise_id WHERE trim(mention) <> ''),
    a AS (SELECT alias_norm, min(concept_id) AS answered FROM dict GROUP BY 1) SELECT kind_hint, count(*) AS cases, round(avg(CASE WHEN expected IS NOT DISTINCT FROM answered THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM m LEFT JOIN a ON alias_norm = {KEY.format('mention')} GROUP BY 1""")
def accuracy_by_kind(spark, d):
    from mossbrook.functions import text as X

    b = table(spark, d, "bios_subset")
    x = b.select(F.col("bios_id").alias("expected"), F.explode("external_ids").alias("enterprise_id")).distinct()
    m = table(spark, d, "zingg_matches").where(F.trim("mention") != "").join(x, "enterprise_id").select("mention", "kind_hint", "expected").distinct()
    a = L.dictionary(b).groupBy("alias_norm").agg(F.min("concept_id").alias("answered"))
    return C.accuracy(m.withColumn("alias_norm", X.ascii_key(F.col("mention"))).join(a, "alias_norm", "left"), "kind_hint")
