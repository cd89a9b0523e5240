"""Graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from mossbrook.operators import graph as G
from mossbrook.plans.base import Book, table

book = Book()
HIER = """e AS (SELECT 'R' || r_regionkey AS parent, 'N' || n_nationkey AS child FROM nation JOIN region ON n_regionkey = r_regionkey
      UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey FROM supplier)"""


def _hierarchy(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    a = n.select(F.concat(F.lit("R"), "r_regionkey").alias("parent"), F.concat(F.lit("N"), "n_nationkey").alias("child"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("N"), "s_nationkey").alias("parent"), F.concat(F.lit("S"), "s_suppkey").alias("child"))
    return a.unionAll(s)


@book.query(f"""WITH RECURSIVE {HIER}, c AS (SELECT parent AS root, parent AS node, 0 AS depth FROM (SELECT DISTINCT parent FROM e WHERE parent LIKE 'R%')
      UNION ALL SELECT root, child, depth + 1 FROM c JOIN e ON e.parent = c.node) SELECT DISTINCT root, node, depth, round(pow(0.85, depth), 6) AS weight FROM c""")
def expand_weighted(spark, d):
    h = _hierarchy(spark, d)
    return G.expansion(G.descendants(h.where("parent like 'R%'").select(F.col("parent").alias("root")), h))


@book.query("""WITH RECURSIVE e AS (SELECT DISTINCT parent_id AS parent, node_id AS child FROM tree_nodes WHERE parent_id <> ''),
    c AS (SELECT node_id AS root, node_id AS node, 0 AS depth FROM (SELECT DISTINCT node_id FROM tree_nodes WHERE node_kind = 'document') UNION ALL SELECT root, child, depth + 1 FROM c JOIN e ON e.parent = c.node)
    SELECT root, count(*) AS nodes, max(depth) AS depth FROM (SELECT DISTINCT * FROM c) GROUP BY root""")
def tree_depths(spark, d):
    t = table(spark, d, "tree_nodes")
    e = t.where("parent_id <> ''").select(F.col("parent_id").alias("parent"), F.col("node_id").alias("child"))
    below = G.descendants(t.where("node_kind = 'document'").select(F.col("node_id").alias("root")), e)
    return below.groupBy("root").agg(F.count(F.lit(1)).alias("nodes"), F.max("depth").alias("depth"))


EDGES = """ed AS (SELECT DISTINCT 'P' || l_partkey AS src, 'has_target' AS predicate, 'S' || l_suppkey AS dst FROM lineitem
      UNION SELECT DISTINCT 'S' || s_suppkey, 'broader', 'N' || s_nationkey FROM supplier UNION SELECT DISTINCT 'N' || n_nationkey, 'broader', 'R' || n_regionkey FROM nation
      UNION SELECT DISTINCT 'S' || l_suppkey, 'targeted_by', 'P' || l_partkey FROM lineitem)"""


def _edges(spark, d):
    li = table(spark, d, "lineitem")
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    P, Q = F.concat(F.lit("P"), "l_partkey"), F.concat(F.lit("S"), "l_suppkey")
    parts = [
        li.select(P.alias("src"), F.lit("has_target").alias("predicate"), Q.alias("dst")),
        s.select(F.concat(F.lit("S"), "s_suppkey"), F.lit("broader"), F.concat(F.lit("N"), "s_nationkey")),
        n.select(F.concat(F.lit("N"), "n_nationkey"), F.lit("broader"), F.concat(F.lit("R"), "n_regionkey")),
        li.select(Q, F.lit("targeted_by"), P),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


@book.query(f"""WITH {EDGES}, e AS (SELECT *, CASE predicate WHEN 'has_target' THEN 0.65 WHEN 'targeted_by' THEN 0.55 ELSE 0.7 END AS d, CASE WHEN predicate = 'broader' THEN 0 ELSE 1 END AS x FROM ed),
    s AS (SELECT DISTINCT src AS seed FROM ed WHERE src LIKE 'S%'), h1 AS (SELECT seed, dst AS node, x AS crossed, d AS w FROM s JOIN e ON src = seed WHERE dst <> seed AND d >= 0.1),
    h2 AS (SELECT seed, e.dst AS node, w * d AS w FROM h1 JOIN e ON e.src = h1.node WHERE crossed + x <= 1 AND e.dst <> seed AND w * d >= 0.1),
    a AS (SELECT seed, node, 1 AS hops, w FROM h1 UNION ALL SELECT seed, node, 2, w FROM h2)
    SELECT seed, node, CAST(arg_min(hops, -w * 1000000 + hops) AS INTEGER) AS hops, round(max(w)::DOUBLE, 6) AS weight FROM a GROUP BY 1, 2""")
def khop_weighted(spark, d):
    return _khop(_edges(spark, d))


def _khop(e):
    return G.walk(e.where("src like 'S%'").select(F.col("src").alias("seed")), e)


def _adjacency(e):
    both = e.union(e.select("dst", F.concat(F.lit("inv_"), "predicate"), "src"))
    return both.groupBy(F.col("src").alias("node")).agg(F.count_distinct("dst").alias("neighbours"), F.count_distinct("predicate").alias("kinds"))


@book.query(f"WITH {EDGES} SELECT src AS node, count(DISTINCT dst) AS neighbours, count(DISTINCT predicate) AS kinds FROM (SELECT src, predicate, dst FROM ed UNION SELECT dst, 'inv_' || predicate, src FROM ed) GROUP BY 1")
def adjacency(spark, d):
    return _adjacency(_edges(spark, d))


@book.query("""WITH RECURSIVE m AS (SELECT DISTINCT bios_id AS a, unnest(external_ids) AS b FROM bios_subset), u AS (SELECT a, b FROM m UNION SELECT b, a FROM m),
    r AS (SELECT a AS node, a AS low FROM u UNION SELECT u.b, r.low FROM r JOIN u ON u.a = r.node WHERE r.low < u.b)
    SELECT node, least(min(low), node) AS component FROM r GROUP BY node""")
def components_min_label(spark, d):
    b = table(spark, d, "bios_subset")
    return G.components(b.select(F.col("bios_id").alias("a"), F.explode("external_ids").alias("b")))


@book.query("""WITH m AS (SELECT DISTINCT bios_id AS a, unnest(external_ids) AS b FROM bios_subset), u AS (SELECT a AS node, a AS c FROM m UNION SELECT b, a FROM m),
    p AS (SELECT c, node, split_part(node, ':', 1) AS prefix, CASE split_part(node, ':', 1) WHEN 'HMD' THEN 0 WHEN 'XCHEM' THEN 1 ELSE 2 END AS r FROM u),
    k AS (SELECT c, prefix, count(*) AS k FROM p GROUP BY 1, 2)
    SELECT f.node AS primary, CAST((SELECT sum(k) FROM k WHERE k.c = f.c) AS BIGINT) AS members, (SELECT count(*) FROM k WHERE k.c = f.c AND k.k > 1) AS conflicts
    FROM (SELECT c, arg_min(node, r || node) AS node FROM p GROUP BY c) f""")
def clique_primary(spark, d):
    b = table(spark, d, "bios_subset").select(F.col("bios_id").alias("subject"), F.explode("external_ids").alias("object"))
    return G.cliques(b.withColumn("predicate", F.lit("exact_match")).withColumn("confidence", F.lit(0.95)), ["HMD", "XCHEM"])


@book.query("""WITH RECURSIVE e AS (SELECT DISTINCT concept_id AS p, unnest(consider) AS c FROM concept_ids UNION SELECT DISTINCT replaced_by, concept_id FROM concept_ids WHERE replaced_by IS NOT NULL UNION SELECT DISTINCT concept_id, replaced_by FROM concept_ids WHERE replaced_by IS NOT NULL),
    w AS (SELECT p AS root, c AS node FROM e UNION SELECT root, c FROM w JOIN e ON p = node) SELECT DISTINCT root AS node FROM w WHERE root = node""")
def hierarchy_cycles(spark, d):
    c = table(spark, d, "concept_ids")
    r = c.where(F.col("replaced_by").isNotNull())
    e = c.select(F.col("concept_id").alias("parent"), F.explode("consider").alias("child")).union(r.select("replaced_by", "concept_id")).union(r.select("concept_id", "replaced_by"))
    return G.on_cycle(e.distinct())


QUADS = """q AS (SELECT 'g:supplier' AS g, CAST(s_suppkey AS VARCHAR) AS s, 'name' AS p, s_name AS o FROM supplier UNION ALL SELECT 'g:supplier', CAST(s_suppkey AS VARCHAR), 'nation', CAST(s_nationkey AS VARCHAR) FROM supplier
      UNION ALL SELECT 'g:nation', CAST(n_nationkey AS VARCHAR), 'label', n_name FROM nation UNION ALL SELECT 'g:nation', CAST(n_nationkey AS VARCHAR), 'region', CAST(n_regionkey AS VARCHAR) FROM nation WHERE n_regionkey <> 2)"""


def _quads(spark, d):
    s = G.quads("g:supplier", table(spark, d, "supplier"), "s_suppkey", {"name": "s_name", "nation": "s_nationkey"})
    n = table(spark, d, "nation").withColumn("r", F.when(F.col("n_regionkey") != 2, F.col("n_regionkey")))
    return s.unionAll(G.quads("g:nation", n, "n_nationkey", {"label": "n_name", "region": "r"}))


@book.query(f"""WITH {QUADS} SELECT a.s AS supplier, a.o AS name, l.o AS nation_label, r.o AS region FROM q a JOIN q n ON n.s = a.s AND n.g = 'g:supplier' AND n.p = 'nation'
    JOIN q l ON l.s = n.o AND l.g = 'g:nation' AND l.p IN ('label', 'name') LEFT JOIN q r ON r.s = n.o AND r.g = 'g:nation' AND r.p = 'region' WHERE a.g = 'g:supplier' AND a.p = 'name'""")
def bgp_cross_graph_optional(spark, d):
    q = _quads(spark, d)
    name = G.pattern(q, ["name"], "supplier", "name", ["g:supplier"])
    of = G.pattern(q, ["nation"], "supplier", "nation", ["g:supplier"])
    label = G.pattern(q, ["label", "name"], "nation", "nation_label", ["g:nation"])
    region = G.pattern(q, ["region"], "nation", "region", ["g:nation"])
    return name.join(of, "supplier").join(label, "nation").join(region, "nation", "left").select("supplier", "name", "nation_label", "region")


@book.query(f"""WITH {QUADS} SELECT DISTINCT s AS subject, 'label' AS via, o AS value FROM q WHERE p IN ('label', 'name') UNION SELECT DISTINCT s, 'link', o FROM q WHERE p IN ('nation', 'region') AND o IN ('1', '2', '3')""")
def bgp_union_values(spark, d):
    q = _quads(spark, d)
    a = G.pattern(q, ["label", "name"], "subject", "value").select("subject", F.lit("label").alias("via"), "value")
    b = G.pattern(q, ["nation", "region"], "subject", "value").where(F.col("value").isin("1", "2", "3")).select("subject", F.lit("link").alias("via"), "value")
    return a.union(b).distinct()


@book.query(f"WITH {QUADS} SELECT g, p, count(*) AS triples FROM q WHERE NOT (g = 'g:supplier' AND s IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal < 0)) GROUP BY 1, 2")
def graph_counts_after_delete(spark, d):
    bad = table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").cast("string").alias("s"))
    return G.delete_where(_quads(spark, d), "g:supplier", bad).groupBy("g", "p").agg(F.count(F.lit(1)).alias("triples"))
