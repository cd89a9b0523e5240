"""Entity resolution queries over the concept list and the mentions."""

from __future__ import annotations

from pyspark.sql import functions as F

from mossbrook.functions import text as X
from mossbrook.operators import linking as L
from mossbrook.plans.base import Book, table

book = Book()
KEY = "regexp_replace(lower(trim({0})), '[\\s\\-_/.,'']+', '', 'g')"
MKEY = "regexp_replace(lower(trim({0})), '\\s+', ' ', 'g')"
DICT = f"""dict AS (SELECT alias_norm, concept_id, min(scope) AS scope FROM (
      SELECT {KEY.format('term')} AS alias_norm, bios_id AS concept_id, CASE WHEN term = preferred_term THEN 'EXACT' ELSE 'NARROW' END AS scope
      FROM (SELECT bios_id, preferred_term, unnest(terms) AS term FROM bios_subset) WHERE trim(term) <> '') WHERE alias_norm <> '' GROUP BY 1, 2)"""
MENTIONS = "m AS (SELECT DISTINCT mention FROM zingg_matches WHERE trim(mention) <> '')"
MATCH = f"hits AS (SELECT mention, concept_id, max(CASE scope WHEN 'EXACT' THEN 1.0 ELSE 0.8 END)::DOUBLE AS score FROM m JOIN dict ON {KEY.format('mention')} = alias_norm GROUP BY 1, 2)"


def _mentions(spark, d):
    m = table(spark, d, "zingg_matches").where(F.trim("mention") != "").select("mention").distinct()
    return m.withColumn("alias_norm", X.ascii_key(F.col("mention")))


def _dict(spark, d):
    return L.dictionary(table(spark, d, "bios_subset"))


@book.query(f"WITH {DICT}, {MENTIONS}, {MATCH} SELECT * FROM hits")
def alias_dictionary_match(spark, d):
    return L.match(_mentions(spark, d), _dict(spark, d))


@book.query(f"WITH {DICT} SELECT alias_norm, count(DISTINCT concept_id) AS concepts, min(concept_id) AS first_concept FROM dict GROUP BY 1 HAVING count(DISTINCT concept_id) > 1")
def alias_collisions(spark, d):
    g = _dict(spark, d).groupBy("alias_norm").agg(F.count_distinct("concept_id").alias("concepts"), F.min("concept_id").alias("first_concept"))
    return g.where("concepts > 1")


CODE = "'^([A-Za-z]{1,6})[\\s\\-]?(\\d{2,6})([A-Za-z]?)$'"
VARIANTS = f"""b AS (SELECT mention, trim(regexp_replace(mention, '[®™©]', '', 'g')) AS bare, regexp_extract(mention, {CODE}, 1) AS a, regexp_extract(mention, {CODE}, 2) AS n, regexp_extract(mention, {CODE}, 3) AS s FROM m),
    v AS (SELECT DISTINCT mention, unnest(list_concat(CASE WHEN regexp_matches(mention, {CODE}) THEN list_filter([a || n || s, a || '-' || n || s, a || ' ' || n || s], lambda z: lower(z) <> lower(trim(mention))) ELSE [] END, [bare],
      list_filter(list_transform(string_split_regex(bare, '[/+]'), lambda z: trim(z)), lambda z: length(z) >= 4))) AS v FROM b)"""


@book.query(f"WITH {DICT}, {MENTIONS}, {VARIANTS} SELECT mention, concept_id, round(0.95 * max(CASE scope WHEN 'EXACT' THEN 1.0 ELSE 0.8 END), 6)::DOUBLE AS score FROM v JOIN dict ON {KEY.format('v')} = alias_norm GROUP BY 1, 2")
def alias_variant_match(spark, d):
    return L.match_variants(_mentions(spark, d), _dict(spark, d))


@book.query(f"WITH {DICT}, {MENTIONS}, {MATCH}, r AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS nxt FROM hits WINDOW w AS (PARTITION BY mention ORDER BY score DESC, concept_id)) "
            "SELECT mention, concept_id, score, round(score - coalesce(nxt, 0), 6) AS margin, nxt IS NOT NULL AND round(score - coalesce(nxt, 0), 6) < 0.08 AS ambiguous FROM r WHERE rank = 1")
def ambiguity_margin(spark, d):
    return L.margins(L.match(_mentions(spark, d), _dict(spark, d)))


_G = """{0}g AS (SELECT v, gram, count(*) AS c FROM (SELECT v, unnest(list_transform(range(1, length(v) + 3), lambda i: substr('  ' || v || '  ', i, 3))) AS gram FROM {0}) GROUP BY 1, 2)"""


@book.query(f"""WITH l AS (SELECT DISTINCT p_name AS v FROM part), r AS (SELECT DISTINCT preferred_term AS v FROM bios_subset WHERE preferred_term IS NOT NULL UNION SELECT DISTINCT p_name FROM part),
    {_G.format('l')}, {_G.format('r')}, idf AS (SELECT gram, ln(1 + (SELECT count(*) FROM r) / (1 + count(*))) AS idf FROM rg GROUP BY 1),
    rw AS (SELECT v, rg.gram, c * idf AS w FROM rg JOIN idf USING (gram)), lw AS (SELECT v, lg.gram, c * coalesce(idf, ln(1 + (SELECT count(*) FROM r))) AS w FROM lg LEFT JOIN idf USING (gram)),
    rn AS (SELECT v, sqrt(sum(w * w)) AS n FROM rw GROUP BY 1), ln_ AS (SELECT v, sqrt(sum(w * w)) AS n FROM lw GROUP BY 1),
    s AS (SELECT lw.v AS mention, rw.v AS alias, round(sum(lw.w * rw.w) / (any_value(ln_.n) * any_value(rn.n)), 6) AS score FROM lw JOIN rw USING (gram) JOIN rn ON rn.v = rw.v JOIN ln_ ON ln_.v = lw.v GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY score DESC, alias) AS rank FROM s WHERE score >= 0.6)
    SELECT mention, alias, score FROM k WHERE rank = 1""")
def ngram_similarity_top1(spark, d):
    parts = table(spark, d, "part")
    return _similar(spark, d, parts, parts)


def _similar(spark, d, parts, known):
    names = table(spark, d, "bios_subset").where(F.col("preferred_term").isNotNull()).select(F.col("preferred_term").alias("alias")).union(known.select("p_name"))
    return L.gram_similarity(parts.select(F.col("p_name").alias("mention")), names)


LINK = f"""ok AS (SELECT {MKEY.format('mention')} AS mention_key, enterprise_id, score FROM zingg_matches WHERE score >= 0.8 AND enterprise_id IS NOT NULL AND {MKEY.format('mention')} <> ''),
    tops AS (SELECT mention_key, score, count(DISTINCT enterprise_id) AS ids, min(enterprise_id) AS enterprise_id FROM ok JOIN (SELECT mention_key, max(score) AS score FROM ok GROUP BY 1) USING (mention_key, score) GROUP BY 1, 2)"""


@book.query(f"WITH {LINK} SELECT mention_key, score, enterprise_id FROM tops WHERE ids = 1")
def linkage_best_no_ties(spark, d):
    return L.linkage_best(table(spark, d, "zingg_matches"))[0]


@book.query(f"WITH {LINK} SELECT mention_key, score, ids FROM tops WHERE ids > 1")
def linkage_ambiguous(spark, d):
    return L.linkage_best(table(spark, d, "zingg_matches"))[1]


XREFS = "xr AS (SELECT DISTINCT bios_id AS concept_id, unnest(external_ids) AS external_id FROM bios_subset)"


@book.query(f"""WITH {DICT}, {LINK}, {XREFS}, m AS (SELECT DISTINCT mention FROM (SELECT mention FROM zingg_matches UNION ALL SELECT enterprise_id FROM zingg_matches UNION ALL SELECT bios_id FROM bios_subset) WHERE trim(mention) <> ''),
    own AS (SELECT DISTINCT concept_id AS own FROM xr), x AS (SELECT external_id, min(concept_id) AS x, count(DISTINCT concept_id) AS xn FROM xr GROUP BY 1),
    a AS (SELECT alias_norm, min(concept_id) AS a, count(DISTINCT concept_id) AS an FROM dict GROUP BY 1),
    l AS (SELECT mention_key, score, min(concept_id) AS l FROM tops JOIN xr ON external_id = enterprise_id WHERE ids = 1 GROUP BY 1, 2)
    SELECT mention, coalesce(own, x, a, l) AS concept_id,
      CASE WHEN own IS NOT NULL THEN 'own_id' WHEN x IS NOT NULL THEN 'xref' WHEN a IS NOT NULL THEN 'alias' WHEN l IS NOT NULL THEN 'linkage' ELSE 'unmapped' END AS stage,
      CASE WHEN own IS NOT NULL THEN 1.0 WHEN xn = 1 THEN 1.0 WHEN x IS NOT NULL THEN 0.75 WHEN an = 1 THEN 1.0 WHEN a IS NOT NULL THEN 0.7 WHEN l IS NOT NULL THEN least(0.95, greatest(0.5, score)) ELSE 0.0 END::DOUBLE AS confidence
    FROM m LEFT JOIN own ON own = mention LEFT JOIN x ON external_id = mention LEFT JOIN a ON alias_norm = {KEY.format('mention')} LEFT JOIN l ON l.mention_key = {MKEY.format('mention')}""")
def cascade_resolve(spark, d):
    z, b = table(spark, d, "zingg_matches"), table(spark, d, "bios_subset")
    xr = b.select(F.col("bios_id").alias("concept_id"), F.explode("external_ids").alias("external_id")).distinct()
    m = z.select("mention").unionAll(z.select("enterprise_id")).unionAll(b.select("bios_id")).where(F.trim("mention") != "")
    best = L.linkage_best(z)[0].join(xr, F.col("enterprise_id") == F.col("external_id")).groupBy("mention_key", "score").agg(F.min("concept_id").alias("concept_id"))
    return L.cascade(m, xr, L.dictionary(b), best)


@book.query(f"WITH {XREFS} SELECT external_id, concept_id, CAST(row_number() OVER (PARTITION BY external_id ORDER BY concept_id) AS INTEGER) AS rank FROM xr QUALIFY rank <= 3")
def xref_lookup(spark, d):
    from mossbrook.operators.topk import top

    xr = table(spark, d, "bios_subset").select(F.col("bios_id").alias("concept_id"), F.explode("external_ids").alias("external_id")).distinct()
    return top(xr, ["external_id"], [F.col("concept_id")], 3)


_SENSES = [("C:onc", 0.5, ["sarcoma", "carcinoma", "spindle-cell"]), ("C:immuno", 0.3, ["vasculitis", "receptor", "channel subunit"]), ("C:pk", 0.2, ["clearance", "half-life", "at week 12"])]


def _w(cues, prior):
    one = ", ".join(f"CASE WHEN contains(lower(coalesce(text, '')), '{c}') THEN {8.0 if ' ' in c else 3.0} END" for c in cues)
    return f"({prior} * list_aggregate(list_concat([1.0, 1.0], list_reverse_sort(list_filter([{one}], lambda x: x IS NOT NULL))[1:3]), 'product'))::DOUBLE"


@book.query("WITH w AS (SELECT doc_id, " + ", ".join(f"{_w(c, p)} AS w{i}" for i, (_, p, c) in enumerate(_SENSES)) + ", "
            + " OR ".join(f"contains(lower(coalesce(text, '')), '{c}')" for _, _, cs in _SENSES for c in cs) + """ AS seen FROM documents),
    b AS (SELECT *, greatest(w0, w1, w2) AS top, w0 + w1 + w2 AS total FROM w)
    SELECT doc_id, list_reverse_sort([{'w': w0, 'c': 'C:onc'}, {'w': w1, 'c': 'C:immuno'}, {'w': w2, 'c': 'C:pk'}])[1].c AS concept_id,
      round(CASE WHEN seen THEN top / total ELSE least(top / total, 0.55) END, 6) AS confidence FROM b""")
def disambiguate_senses(spark, d):
    t = table(spark, d, "documents").select("doc_id", L.disambiguate(F.col("text"), _SENSES).alias("s"))
    return t.select("doc_id", "s.concept_id", "s.confidence")
