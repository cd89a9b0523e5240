"""Queries over the document tree, chunks and facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from mossbrook.functions import text as X
from mossbrook.operators import corpus as C
from mossbrook.operators import facts as K
from mossbrook.plans.base import Book, table

book = Book()
NODES = """n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY ingested_at DESC, content DESC) AS rn FROM tree_nodes WHERE node_id IS NOT NULL) WHERE rn = 1)"""
SENT = "string_split(regexp_replace(text, '([.!?。！？])\\s+', '\\1' || chr(1), 'g'), chr(1))"
U = "replace(section_path, ' > ', ' / ')"


@book.query()
def doc_chunks_packed(spark, d):
    return C.chunks(table(spark, d, "documents"))


@book.query(f"""WITH s AS (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, list_filter({SENT}, lambda x: trim(x) <> '') AS s FROM documents))
    SELECT doc_id, CAST(i - 1 AS INTEGER) AS position, 'CHK:s.' || substr(sha1(doc_id || '|' || (i - 1)), 1, 10) AS chunk_id, length(s) AS size,
      CAST(coalesce(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM s""")
def sentence_chunks(spark, d):
    s = table(spark, d, "documents").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("position", "s"))
    s = s.select("doc_id", "position", X.id_hash("CHK:s.", F.col("doc_id"), F.col("position"), size=10).alias("chunk_id"), F.length("s").cast("bigint").alias("size"))
    return C.offsets(s, "doc_id", ["position"], F.col("size"))


@book.query()
def table_slices(spark, d):
    t = C.nodes(table(spark, d, "tree_nodes").where("node_kind = 'table'"))
    return C.table_parts(t, 700).select("node_id", "part", "rows", F.length("text").alias("size"))


@book.query("""WITH t AS (SELECT doc_id, md5(regexp_replace(lower(trim(text)), '\\s+', ' ', 'g')) AS h FROM documents WHERE length(regexp_replace(lower(trim(text)), '\\s+', ' ', 'g')) >= 60)
    SELECT doc_id, same_as FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS same_as FROM t) WHERE doc_id <> same_as""")
def exact_text_dedupe(spark, d):
    return C.first_owner(table(spark, d, "documents"))


TAXONOMY = {"oncology": ["sarcoma", "carcinoma", "leukaemia", "tumour"], "pharmacology": ["half-life", "clearance", "dose steps"], "inflammation": ["vasculitis", "oedema"], "blood": ["leukaemia", "haemorrhage"], "ZH": ["治疗", "患者"]}


def _hits(words):
    def one(k):
        p = k if ord(k[0]) > 255 else f"(^|[^A-Za-z0-9]){k}([^A-Za-z0-9]|$)"
        return f"CAST(regexp_matches(lower(text), '{p}') AS INTEGER)"

    return " + ".join(map(one, words))


@book.query("SELECT doc_id, label, hits, CASE WHEN hits >= 3 THEN 0.92 WHEN hits = 2 THEN 0.80 ELSE 0.55 END::DOUBLE AS confidence FROM ("
            + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS label, {_hits(v)} AS hits FROM documents WHERE text IS NOT NULL" for k, v in TAXONOMY.items()) + ") WHERE hits > 0")
def taxonomy_labels(spark, d):
    return C.labels(table(spark, d, "documents"), TAXONOMY)


@book.query("SELECT lang, round(avg(CASE WHEN " + " + ".join(f"({_hits(v)})" for v in TAXONOMY.values()) + " > 0 THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM documents GROUP BY lang")
def label_coverage(spark, d):
    t = table(spark, d, "documents")
    has = C.labels(t, TAXONOMY).select("doc_id").distinct().withColumn("has", F.lit(1.0))
    return t.join(has, "doc_id", "left").groupBy("lang").agg(F.round(F.avg(F.coalesce("has", F.lit(0.0))), 6).alias("coverage"))


@book.query(f"WITH {NODES} SELECT node_id, coalesce(regexp_matches(lower(list_last(string_split({U}, ' / '))), '^(references|bibliography|acknowledge?ments?|abstract|limitations)'), false) AS boilerplate FROM n WHERE node_kind = 'paragraph'")
def boilerplate_sections(spark, d):
    n = C.nodes(table(spark, d, "tree_nodes").where("node_kind = 'paragraph'"))
    return n.select("node_id", F.coalesce(C.boilerplate(F.col("section_path")), F.lit(False)).alias("boilerplate"))


@book.query(f"""WITH {NODES}, h AS (SELECT document_id, coalesce({U}, '') AS sp, page, length(content)::DOUBLE AS score FROM n WHERE node_kind IN ('paragraph', 'table') AND content IS NOT NULL),
    s AS (SELECT document_id, sp, max(score) AS best, min(page) AS first_page, max(page) AS last_page, count(*) AS hits FROM h GROUP BY 1, 2)
    SELECT document_id, sp AS section_path, best, max(best) OVER (PARTITION BY document_id) AS document_best, first_page, last_page, hits FROM s""")
def evidence_tree(spark, d):
    n = C.nodes(table(spark, d, "tree_nodes").where(F.col("node_kind").isin("paragraph", "table"))).where(F.col("content").isNotNull())
    t = C.evidence_tree(n.select("document_id", F.coalesce(X.unify_path(F.col("section_path")), F.lit("")).alias("section_path"), "page", F.length("content").cast("double").alias("score")))
    x = t.select("document_id", F.col("best").alias("document_best"), F.explode("sections").alias("s"))
    return x.select("document_id", "s.section_path", "s.best", "document_best", "s.first_page", "s.last_page", "s.hits")


@book.query(f"""WITH {NODES}, u AS (SELECT node_id, document_id, content, coalesce(sum(length(content) + 2) OVER (PARTITION BY document_id ORDER BY sort_order, node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
      FROM n WHERE node_kind = 'paragraph' AND content IS NOT NULL) SELECT node_id, document_id, CAST(used AS BIGINT) AS used, length(substr(content, 1, CAST(8000 - used AS INTEGER))) AS size FROM u WHERE used < 8000""")
def restore_context_budget(spark, d):
    n = C.nodes(table(spark, d, "tree_nodes").where("node_kind = 'paragraph'")).where(F.col("content").isNotNull())
    r = C.restore(n.select("node_id", "document_id", "sort_order", "content"), "document_id", ["sort_order", "node_id"])
    return r.select("node_id", "document_id", "used", F.length("piece").cast("bigint").alias("size"))


@book.query(f"WITH {NODES} SELECT node_id, lag(node_id) OVER w AS before, lead(node_id) OVER w AS after FROM n WINDOW w AS (PARTITION BY document_id, parent_id ORDER BY sort_order NULLS FIRST, node_id)")
def restore_siblings(spark, d):
    return C.siblings(C.nodes(table(spark, d, "tree_nodes")))


SECTIONS = f"""sec AS (SELECT document_id, CAST(sort_order AS BIGINT) AS ordinal, CASE node_kind WHEN 'document' THEN 1 WHEN 'section' THEN 2 ELSE 4 END AS level, page AS start_page FROM n
      WHERE node_kind IN ('document', 'section', 'subsection') AND page IS NOT NULL AND sort_order IS NOT NULL)"""


def _sections(spark, d):
    n = C.nodes(table(spark, d, "tree_nodes"))
    level = F.when(F.col("node_kind") == "document", 1).when(F.col("node_kind") == "section", 2).otherwise(4)
    s = n.where(F.col("node_kind").isin("document", "section", "subsection") & F.col("page").isNotNull() & F.col("sort_order").isNotNull())
    return n, s.select("document_id", F.col("sort_order").cast("bigint").alias("ordinal"), level.alias("level"), F.col("page").alias("start_page"))


RANGES = f"""{SECTIONS}, nxt AS (SELECT a.*, (SELECT b.start_page FROM sec b WHERE b.document_id = a.document_id AND b.ordinal > a.ordinal AND b.level <= a.level ORDER BY b.ordinal, b.start_page LIMIT 1) AS np,
      (SELECT max(start_page) FROM sec c WHERE c.document_id = a.document_id) AS pages FROM sec a),
    rng AS (SELECT document_id, ordinal, level, start_page, CASE WHEN np IS NULL THEN greatest(1, pages) ELSE greatest(start_page, np - 1) END AS end_page FROM nxt)"""


@book.query(f"WITH {NODES}, {RANGES} SELECT document_id, ordinal, level, start_page, end_page FROM rng")
def section_ranges(spark, d):
    return C.section_ranges(_sections(spark, d)[1])


@book.query(f"""WITH {NODES}, {RANGES}, b AS (SELECT document_id, node_id AS block_id, page FROM n WHERE node_kind = 'table' AND page IS NOT NULL),
    j AS (SELECT b.*, ordinal, level, row_number() OVER (PARTITION BY block_id ORDER BY level DESC NULLS LAST, start_page DESC, ordinal DESC) AS k FROM b LEFT JOIN rng r ON r.document_id = b.document_id AND b.page BETWEEN start_page AND end_page)
    SELECT document_id, block_id, page, ordinal, level FROM j WHERE k = 1""")
def section_range_assign(spark, d):
    n, s = _sections(spark, d)
    b = n.where("node_kind = 'table' and page is not null").select("document_id", F.col("node_id").alias("block_id"), "page")
    return C.assign_deepest(b, C.section_ranges(s))


@book.query(f"""WITH {NODES}, {SECTIONS}, b AS (SELECT document_id, node_id AS row_id, page FROM n WHERE node_kind IN ('table', 'figure') AND page IS NOT NULL),
    r AS (SELECT document_id, start_page AS page, max(ordinal) AS ordinal FROM sec GROUP BY 1, 2)
    SELECT b.row_id, b.document_id, b.page, r.ordinal FROM b ASOF LEFT JOIN r ON b.document_id = r.document_id AND b.page >= r.page""")
def asof_section(spark, d):
    n, s = _sections(spark, d)
    b = n.where("node_kind in ('table', 'figure') and page is not null").select("document_id", F.col("node_id").alias("row_id"), "page")
    return C.as_of(b, s.select("document_id", F.col("start_page").alias("page"), "ordinal"), "document_id", "page", "ordinal")


@book.query(f"""WITH {NODES}, {SECTIONS}, s AS (SELECT document_id, ordinal, level, row_number() OVER (PARTITION BY document_id ORDER BY ordinal, level) - 1 AS i FROM sec)
    SELECT document_id, ordinal, CAST(i + least(1, min(level - i) OVER (PARTITION BY document_id ORDER BY i)) AS INTEGER) AS level FROM s""")
def heading_levels_repaired(spark, d):
    return C.repaired_levels(_sections(spark, d)[1])


@book.query(f"WITH {NODES}, {SECTIONS} SELECT a.document_id, a.ordinal, (SELECT max(b.ordinal) FROM sec b WHERE b.document_id = a.document_id AND b.ordinal < a.ordinal AND b.level < a.level) AS parent_ordinal FROM sec a")
def heading_parents(spark, d):
    return C.parent_by_level(_sections(spark, d)[1])


@book.query(f"""WITH {NODES}, c AS (SELECT document_id, page, content AS title, 'layout' AS source, 0.72 AS confidence FROM n WHERE node_kind IN ('section', 'subsection') AND content IS NOT NULL
      UNION ALL SELECT document_id, page, list_last(string_split({U}, ' / ')), 'path', 0.62 FROM n WHERE node_kind IN ('section', 'subsection', 'paragraph') AND section_path IS NOT NULL),
    g AS (SELECT document_id, page, lower(trim(title)) AS key, max(confidence) AS c, arg_max(title, confidence * 10 + 0) AS t0, max(CASE WHEN confidence = 0.72 THEN title END) AS t1, max(title) AS t2, count(DISTINCT source) AS sources FROM c GROUP BY 1, 2, 3)
    SELECT document_id, page, coalesce(t1, t2) AS title, round(CASE WHEN sources > 1 THEN least(0.98, c + 0.06) ELSE c END::DOUBLE, 6) AS confidence, sources FROM g""")
def merged_headings(spark, d):
    n = C.nodes(table(spark, d, "tree_nodes"))
    a = n.where("node_kind in ('section', 'subsection') and content is not null").select("document_id", "page", F.col("content").alias("title"), F.lit("layout").alias("source"), F.lit(0.72).alias("confidence"))
    b = n.where("node_kind in ('section', 'subsection', 'paragraph') and section_path is not null").select("document_id", "page", F.element_at(F.split(X.unify_path(F.col("section_path")), " / "), -1).alias("title"), F.lit("path").alias("source"), F.lit(0.62).alias("confidence"))
    return C.merged_headings(a.unionAll(b))


_P = [("received", r"([^,.;:()\[\]]{1,60}) received (\S{2,40}) "), ("stopped", r"([^,.;:()\[\]]{1,60}) stopped (\S{2,40}) "),
      ("loss_of", r"(Loss) of ([^,.;:()\[\]]{1,60}?) (?:\S+ )?(?:the|a|any|its|each|most|this) "), ("given_with", r"when (\S{2,40}) was given with (\S{2,40}) "), ("treated_with", r"([^，。；、（）]{1,40})接受([^，。；、（）]{1,40}?)治疗")]
FACTS = f"""s AS (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, list_filter({SENT}, lambda x: trim(x) <> '') AS s FROM documents)),
    f AS (""" + " UNION ALL ".join(f"SELECT doc_id, i - 1 AS sentence_no, '{p}' AS predicate, trim(regexp_extract(s, '{r}', 1)) AS subject, trim(regexp_extract(s, '{r}', 2)) AS object, s FROM s" for p, r in _P) + "), facts AS (SELECT * FROM f WHERE object <> '')"
NEG = "regexp_matches(s, '(?i)(^|[^\\p{L}])(no|not|neither|without evidence|did not|未见|没有)([^\\p{L}]|$)')"


@book.query(f"WITH {FACTS} SELECT doc_id, CAST(sentence_no AS INTEGER) AS sentence_no, predicate, subject, object, {NEG} AS negated, 0.72::DOUBLE AS confidence FROM facts")
def extracted_facts(spark, d):
    return K.extract(table(spark, d, "documents"))


@book.query(f"WITH {FACTS}, g AS (SELECT subject, predicate, object, count(DISTINCT doc_id) AS docs, min(doc_id) AS first_doc FROM facts GROUP BY 1, 2, 3) SELECT subject, predicate, object, docs, first_doc, round(least(0.97, 0.72 + 0.05 * (docs - 1))::DOUBLE, 6) AS confidence FROM g")
def fact_merge_confidence(spark, d):
    return K.merge(K.extract(table(spark, d, "documents")))


@book.query(f"WITH {FACTS} SELECT DISTINCT 'KC:' || substr(sha1(subject || '|' || predicate || '|' || object || '|' || doc_id), 1, 12) AS claim_id, doc_id, subject, predicate, object, 'extracted' AS claim_status FROM facts")
def claim_ids(spark, d):
    return K.claims(K.extract(table(spark, d, "documents")))


@book.query(f"""WITH {FACTS}, c AS (SELECT DISTINCT 'KC:' || substr(sha1(subject || '|' || predicate || '|' || object || '|' || doc_id), 1, 12) AS claim_id, doc_id, subject, predicate, object FROM facts WHERE predicate = 'given_with'),
    e AS (SELECT DISTINCT preferred_term AS e FROM bios_subset) SELECT DISTINCT claim_id, subject, object FROM c WHERE subject IN (SELECT e FROM e WHERE e IS NOT NULL) OR object IN (SELECT e FROM e WHERE e IS NOT NULL)""")
def claims_about_entities(spark, d):
    c = K.claims(K.extract(table(spark, d, "documents")))
    e = table(spark, d, "bios_subset").where(F.col("preferred_term").isNotNull()).select(F.col("preferred_term").alias("entity"))
    return K.claims_about(c, e, "given_with", hidden=False).select("claim_id", "subject", "object")


@book.query("SELECT l_partkey, l_suppkey, count(DISTINCT l_discount) AS values, min(l_discount) AS low, max(l_discount) AS high FROM lineitem WHERE l_discount IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT l_discount) > 1")
def value_conflicts(spark, d):
    return K.value_conflicts(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"], "l_discount")


@book.query("""WITH v AS (SELECT l_partkey, l_extendedprice AS v FROM lineitem), g AS (SELECT l_partkey, count(*) AS n, min(v) AS low, max(v) AS high FROM v GROUP BY 1)
    SELECT l_partkey, n, low, high, round(abs(high - low) / abs(high), 6) AS relative_spread FROM g WHERE n >= 2 AND high <> 0 AND abs(high - low) / abs(high) >= 0.1""")
def multi_source_conflict(spark, d):
    return K.spread_conflicts(table(spark, d, "lineitem"), ["l_partkey"], F.col("l_extendedprice"))


@book.query(f"""WITH {NODES}, t AS (SELECT node_id, content, string_split(content, chr(10)) AS rows FROM n WHERE node_kind = 'table' AND length(content) > 0), r AS (SELECT node_id, string_split(rows[1], ' | ') AS h, unnest(rows[2:]) AS r, generate_subscripts(rows[2:], 1) - 1 AS row_no FROM t),
    c AS (SELECT node_id, row_no, string_split(r, ' | ') AS c, h, unnest(range(1, len(h) + 1)) AS k FROM r), f AS (SELECT node_id, row_no, c[1] AS row_key, trim(h[k]) AS header, trim(c[k]) AS value FROM c WHERE c[k] IS NOT NULL)
    SELECT node_id, CAST(row_no AS INTEGER) AS row_no, row_key, CASE lower(header) WHEN 'n' THEN 'arm_size' ELSE 'effect' END AS metric, CASE lower(header) WHEN 'n' THEN 'count' ELSE 'percent' END AS unit,
      TRY_CAST(regexp_extract(value, '-?[0-9]+(?:\\.[0-9]+)?') AS DOUBLE) AS number, 0.85::DOUBLE AS confidence FROM f WHERE lower(header) IN ('n', 'value') AND TRY_CAST(regexp_extract(value, '-?[0-9]+(?:\\.[0-9]+)?') AS DOUBLE) IS NOT NULL""")
def table_metric_facts(spark, d):
    t = C.nodes(table(spark, d, "tree_nodes").where("node_kind = 'table'"))
    v = spark.createDataFrame([("N", "arm_size", "count"), ("Value", "effect", "percent")], "header string, metric string, unit string")
    return K.table_facts(K.table_cells(t), v)


@book.query(f"""WITH {FACTS}, m AS (SELECT DISTINCT doc_id, sentence_no, subject AS entity, 'g' AS kind, 1 AS place FROM facts WHERE predicate = 'given_with' UNION SELECT DISTINCT doc_id, sentence_no, object, 'r', 2 FROM facts WHERE predicate IN ('received', 'stopped'))
    SELECT DISTINCT a.doc_id, CAST(a.sentence_no AS INTEGER) AS first_sentence, CAST(b.sentence_no AS INTEGER) AS second_sentence, a.entity AS first, b.entity AS second FROM m a JOIN m b ON a.doc_id = b.doc_id AND b.sentence_no BETWEEN a.sentence_no AND a.sentence_no + 1
      AND a.kind <> b.kind AND (a.sentence_no < b.sentence_no OR a.place < b.place)""")
def mention_pairs(spark, d):
    f = K.extract(table(spark, d, "documents"))
    a = f.where("predicate = 'given_with'").select("doc_id", "sentence_no", F.col("subject").alias("entity"), F.lit("g").alias("kind"), F.lit(1).alias("place"))
    b = f.where("predicate in ('received', 'stopped')").select("doc_id", "sentence_no", F.col("object").alias("entity"), F.lit("r").alias("kind"), F.lit(2).alias("place"))
    return K.mention_pairs(a.union(b).distinct())
