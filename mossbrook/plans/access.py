"""Licence and text-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from mossbrook.functions import text as X
from mossbrook.operators import access as A
from mossbrook.plans.base import Book, table

book = Book()
RANK = "CASE license_tier WHEN 'TIER_0' THEN 0 WHEN 'TIER_1' THEN 1 WHEN 'TIER_2' THEN 2 ELSE 3 END"
ENTITLED = ("patent_full", "csr_archive")


@book.query(f"""SELECT doc_id, source, {RANK} AS license_rank FROM documents
    WHERE {RANK} <= 2 AND ({RANK} <= 1 OR coalesce(source IN ('patent_full','csr_archive'), false))""")
def license_filter(spark, d):
    return A.guarded(table(spark, d, "documents").select("doc_id", "source", "license_tier"), 2, 1, ENTITLED).select("doc_id", "source", "license_rank")


@book.query(f"""SELECT lang, count(*) AS total, count(*) FILTER (NOT ({RANK} <= 2 AND ({RANK} <= 1 OR coalesce(source IN ('patent_full','csr_archive'), false)))) AS filtered
    FROM documents GROUP BY lang""")
def license_filtered_count(spark, d):
    return A.filtered_count(table(spark, d, "documents"), ["lang"], 2, 1, ENTITLED)


@book.query(f"""SELECT doc_type, count(*) FILTER ({RANK} <= 1) AS kept, count(*) FILTER ({RANK} > 1) AS dropped,
    max(CASE WHEN {RANK} <= 1 THEN {RANK} END) AS strictest_kept FROM documents GROUP BY doc_type""")
def license_gate(spark, d):
    return A.gate(table(spark, d, "documents"), ["doc_type"], 1)


@book.query("""SELECT license_tier, license_tier IN ('TIER_0','TIER_1') AS exportable, license_tier = 'TIER_0' AS trainable, count(*) AS documents
    FROM documents WHERE license_tier IS NOT NULL GROUP BY 1, 2, 3""")
def tier_policy(spark, d):
    docs = table(spark, d, "documents").groupBy("license_tier").agg(F.count(F.lit(1)).alias("documents"))
    return docs.join(A.policies(spark), "license_tier").select("license_tier", "exportable", "trainable", "documents")


@book.query(f"""SELECT source, max({RANK}) AS license_rank FROM documents WHERE source IS NOT NULL GROUP BY source
    HAVING max({RANK}) <= 1 OR source IN ('patent_full','csr_archive')""")
def visible_sources(spark, d):
    return A.visible_sources(table(spark, d, "documents"), ENTITLED)


@book.query("""SELECT DISTINCT p_name AS value, regexp_replace(lower(trim(p_name)), '[\\s\\-_/.,'']+', '', 'g') AS key FROM part
    UNION SELECT DISTINCT s_name, regexp_replace(lower(trim(s_name)), '[\\s\\-_/.,'']+', '', 'g') FROM supplier""")
def alias_norm_ascii(spark, d):
    p = table(spark, d, "part").select(F.col("p_name").alias("value")).union(table(spark, d, "supplier").select("s_name")).distinct()
    return p.select("value", X.ascii_key(F.col("value")).alias("key"))


@book.query()
def alias_norm_unicode(spark, d):
    m = table(spark, d, "zingg_matches").where(F.col("mention").isNotNull()).select("mention").distinct()
    return m.select("mention", X.alias_key("mention").alias("key"), X.mention_key(F.col("mention")).alias("mention_key"))


_TERMS = "(SELECT DISTINCT unnest(terms) AS term FROM bios_subset)"


@book.query(f"""WITH t AS (SELECT term FROM {_TERMS} WHERE regexp_matches(term, '^([A-Za-z]{{1,6}})[\\s\\-]?(\\d{{2,6}})([A-Za-z]?)$')),
    v AS (SELECT term, regexp_extract(term, '^([A-Za-z]{{1,6}})[\\s\\-]?(\\d{{2,6}})([A-Za-z]?)$', 1) AS a, regexp_extract(term, '^([A-Za-z]{{1,6}})[\\s\\-]?(\\d{{2,6}})([A-Za-z]?)$', 2) AS n,
      regexp_extract(term, '^([A-Za-z]{{1,6}})[\\s\\-]?(\\d{{2,6}})([A-Za-z]?)$', 3) AS s FROM t)
    SELECT term, variant FROM (SELECT term, unnest([a||n||s, a||'-'||n||s, a||' '||n||s]) AS variant FROM v) WHERE lower(variant) <> lower(trim(term))""")
def code_variants(spark, d):
    t = table(spark, d, "bios_subset").select(F.explode("terms").alias("term")).distinct()
    return t.select("term", F.explode(X.code_variants(F.col("term"))).alias("variant"))


@book.query("""SELECT lang, count(*) AS documents, count(*) FILTER (regexp_matches(text, '[一-鿿㐀-䶿]')) AS with_cjk FROM documents GROUP BY lang""")
def cjk_documents(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.count_if(X.has_cjk(F.col("text"))).alias("with_cjk"))


@book.query("""WITH s AS (SELECT doc_id, unnest(list_filter(string_split(regexp_replace(text, '([.!?。！？])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')) AS sentence, generate_subscripts(list_filter(string_split(regexp_replace(text, '([.!?。！？])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> ''), 1) AS k FROM documents)
    SELECT doc_id, CAST(k - 1 AS INTEGER) AS sentence_no, sentence FROM s""")
def sentence_split(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("sentence_no", "sentence"))


_Q = "([0-9]+\\.[0-9]+) (mg/kg|mg|µg|ng/mL|mL/min|mmol/L|nM|IU|per cent|points)"


@book.query(f"""WITH q AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_Q}')) AS m FROM documents)
    SELECT regexp_extract(m, '{_Q}', 2) AS unit, count(*) AS n, max(CAST(regexp_extract(m, '{_Q}', 1) AS DOUBLE)) AS most FROM q GROUP BY 1""")
def quantity_units(spark, d):
    q = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(X.QUANTITY), F.lit(0))).alias("m"))
    return q.groupBy(F.regexp_extract("m", X.QUANTITY, 2).alias("unit")).agg(F.count(F.lit(1)).alias("n"), F.max(F.regexp_extract("m", X.QUANTITY, 1).cast("double")).alias("most"))


@book.query("""SELECT bios_id, external_id, 'https://w3id.org/x/' || replace(external_id, ':', '/') AS iri FROM (SELECT DISTINCT bios_id, unnest(external_ids) AS external_id FROM bios_subset)""")
def xref_iris(spark, d):
    x = table(spark, d, "bios_subset").select("bios_id", F.explode("external_ids").alias("external_id")).distinct()
    iri = X.curie_to_iri(F.col("external_id"))
    return x.withColumn("iri", iri).where(X.iri_to_curie(F.col("iri")) == F.col("external_id"))


@book.query("""SELECT node_id, '' || CASE WHEN regexp_matches(lower(content), '\\b(ct|mri|pet|x-ray|scan|imaging)\\b') THEN 'RADIOLOGY'
      WHEN regexp_matches(lower(content), '\\b(histolog|microscop|stain|immunohisto)') THEN 'MICROSCOPY' WHEN regexp_matches(lower(content), '\\b(blot|gel)\\b') THEN 'GEL_BLOT'
      WHEN regexp_matches(lower(content), '\\b(flow ?chart|consort|pathway|scheme)\\b') THEN 'DIAGRAM' WHEN regexp_matches(lower(content), '\\b(kaplan|curve|plot|by arm|over time|forest|bar)\\b') THEN 'CHART' ELSE 'OTHER' END AS kind
    FROM (SELECT DISTINCT node_id, content FROM tree_nodes WHERE node_kind = 'caption')""")
def figure_kinds(spark, d):
    c = table(spark, d, "tree_nodes").where("node_kind = 'caption'").select("node_id", "content").distinct()
    return c.select("node_id", X.figure_kind(F.col("content")).alias("kind"))


@book.query("""WITH p AS (SELECT DISTINCT replace(section_path, ' > ', ' / ') AS path FROM tree_nodes WHERE section_path IS NOT NULL),
    s AS (SELECT path, string_split(path, ' / ') AS parts FROM p),
    i AS (SELECT path, parts, unnest(range(1, len(parts) + 1)) AS a FROM s), j AS (SELECT path, parts, a, unnest(range(a, len(parts) + 1)) AS b FROM i)
    SELECT DISTINCT path, array_to_string(parts[a:b], ' / ') AS alias FROM j""")
def section_subpaths(spark, d):
    p = table(spark, d, "tree_nodes").where(F.col("section_path").isNotNull()).select(X.unify_path(F.col("section_path")).alias("path")).distinct()
    return p.select("path", F.explode(X.subpaths(F.col("path"))).alias("alias"))


@book.query("""SELECT doc_id, 'DOC:' || substr(sha1(coalesce(source, 'None') || '|' || doc_id || '|' || coalesce(title, 'None')), 1, 12) AS node,
      lpad(CAST(CAST('0x' || substr(sha1(CAST(doc_id AS VARCHAR)), 1, 9) AS BIGINT) % 1000000000 AS VARCHAR), 9, '0') AS signal FROM documents""")
def deterministic_ids(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", X.id_hash("DOC:", F.col("source"), F.col("doc_id"), F.col("title")).alias("node"), X.numeric_id(F.col("doc_id").cast("string")).alias("signal"))


@book.query("""WITH l AS (SELECT node_id, unnest(string_split(content, chr(10))) AS line FROM (SELECT DISTINCT node_id, content FROM tree_nodes WHERE node_kind IN ('paragraph', 'sentence')))
    SELECT DISTINCT node_id, line AS title, CAST(least(6, len(string_split(regexp_extract(line, '^([0-9]+(?:\\.[0-9]+)*)\\.? [A-Z]', 1), '.'))) AS INTEGER) AS level
    FROM l WHERE regexp_matches(line, '^([0-9]+(?:\\.[0-9]+)*)\\.? [A-Z]') AND length(line) <= 80""")
def numbered_headings(spark, d):
    n = table(spark, d, "tree_nodes").where(F.col("node_kind").isin("paragraph", "sentence")).select("node_id", "content").distinct()
    lines = n.select("node_id", F.explode(F.split("content", "\n")).alias("title"))
    return lines.withColumn("level", X.heading_level(F.col("title"))).where(F.col("level").isNotNull()).select("node_id", "title", F.col("level").cast("int").alias("level")).distinct()


@book.query("""SELECT mention, regexp_matches(mention, '^[A-Za-z]{1,6}-?\\d{2,6}[A-Za-z]?$') OR regexp_matches(mention, '^[A-Z][A-Z0-9]{1,7}$') OR regexp_matches(mention, '^\\p{Lu}\\p{Ll}+( \\p{Ll}+)*$')
      OR regexp_matches(mention, '[一-鿿㐀-䶿]') AS shaped FROM (SELECT DISTINCT mention FROM zingg_matches WHERE mention IS NOT NULL)""")
def entity_shapes(spark, d):
    m = table(spark, d, "zingg_matches").where(F.col("mention").isNotNull()).select("mention").distinct()
    return m.select("mention", X.entity_shaped(F.col("mention")).alias("shaped"))
