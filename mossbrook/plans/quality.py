"""Queries of quality, evaluation and the lake."""

from __future__ import annotations

from pyspark.sql import functions as F

from mossbrook.operators import access as A
from mossbrook.operators import evaluation as V
from mossbrook.operators import facts as K
from mossbrook.operators import quality as Q
from mossbrook.operators.corpus import nodes
from mossbrook.plans.base import Book, table
from mossbrook.plans.corpus import FACTS, NODES
from mossbrook.plans.retrieval import RANK
from mossbrook.sources import lake as L

book = Book()


@book.query(f"""WITH {NODES}, r AS (SELECT 'dangling_parent' AS rule, node_id AS subject, 'block' AS severity FROM n WHERE parent_id <> '' AND parent_id NOT IN (SELECT node_id FROM n)
      UNION SELECT 'orphan', node_id, 'warn' FROM n WHERE coalesce(parent_id, '') = '' AND node_id NOT IN (SELECT parent_id FROM n WHERE parent_id <> '')
      UNION SELECT 'no_evidence', concept_id, 'block' FROM (SELECT DISTINCT concept_id FROM concept_ids) WHERE concept_id NOT IN (SELECT concept_id FROM concept_ids WHERE len(members) > 0)
      UNION SELECT 'license_downgrade', doc_id::VARCHAR, 'block' FROM (SELECT doc_id, {RANK} AS rank, max({RANK}) OVER (PARTITION BY study_id) AS strictest FROM documents WHERE study_id IS NOT NULL) WHERE rank < strictest
      UNION SELECT 'literal_edge', concept_id, 'block' FROM (SELECT concept_id, unnest(members) AS object FROM concept_ids) WHERE NOT regexp_matches(object, '^[A-Za-z]+:.+')) SELECT * FROM r""")
def consistency_union(spark, d):
    n = nodes(table(spark, d, "tree_nodes"))
    c = table(spark, d, "concept_ids")
    docs = table(spark, d, "documents").where(F.col("study_id").isNotNull()).select(F.col("doc_id").alias("id"), F.col("study_id").alias("group"), A.rank_of(F.col("license_tier")).alias("rank"))
    return Q.report([
        Q.dangling_parents(n), Q.orphans(n), Q.without_evidence(c.select("concept_id"), c.where(F.size("members") > 0), "concept_id"), Q.downgrades(docs, docs.select("group", "rank")),
        Q.literal_edges(c.select(F.col("concept_id").alias("subject"), F.explode("members").alias("object"))),
    ])


@book.query("""WITH a AS (SELECT source AS kind, round(avg(CASE WHEN n_chars = length(text) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM documents WHERE source IS NOT NULL GROUP BY 1), p AS (SELECT source AS kind, round(avg(CASE WHEN lang IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS previous FROM documents WHERE source IS NOT NULL GROUP BY 1)
    SELECT kind, accuracy, previous, accuracy < 0.9 OR coalesce(round(previous - accuracy, 6) > 0.02, false) AS blocked FROM a LEFT JOIN p USING (kind)""")
def accuracy_gate(spark, d):
    t = table(spark, d, "documents").where(F.col("source").isNotNull())
    a = t.groupBy(F.col("source").alias("kind")).agg(F.round(F.avg((F.col("n_chars") == F.length("text")).cast("double")), 6).alias("accuracy"))
    p = t.groupBy(F.col("source").alias("kind")).agg(F.round(F.avg(F.col("lang").isNotNull().cast("double")), 6).alias("accuracy"))
    return Q.gate(a, p)


@book.query("""WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
    SELECT event_type, any_value(n) AS n, max(CASE WHEN i = round_even(0.5 * (n - 1), 0) THEN value END) AS p50, max(CASE WHEN i = round_even(0.95 * (n - 1), 0) THEN value END) AS p95 FROM s GROUP BY 1""")
def latency_nearest_rank(spark, d):
    return Q.nearest_rank(table(spark, d, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@book.query("SELECT doc_id, lang, CAST(draw AS INTEGER) AS draw FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('20260801|' || doc_id), doc_id) AS draw FROM documents) WHERE draw <= 20")
def stratified_hash_sample(spark, d):
    return Q.stratified_sample(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 20)


@book.query("""SELECT entity_type, count(*) AS rows, CAST(CAST(sum(CAST(CAST('0x' || substr(sha256(coalesce(concept_id, '∅') || '|' || coalesce(ledger_release, '∅') || '|' || coalesce(replaced_by, '∅')), 1, 12) AS BIGINT) AS DECIMAL(20,0))) AS HUGEINT) AS VARCHAR) AS fingerprint FROM concept_ids GROUP BY 1""")
def fingerprints(spark, d):
    return Q.fingerprint(table(spark, d, "concept_ids"), ["entity_type"], ["concept_id", "ledger_release", "replaced_by"])


@book.query("""WITH x AS (SELECT doc_id, source, license_tier, text, ((CASE WHEN coalesce(trim(text), '') = '' THEN 1 ELSE 0 END) + (CASE WHEN coalesce(trim(title), '') = '' THEN 1 ELSE 0 END) + (CASE WHEN coalesce(trim(lang), '') = '' THEN 1 ELSE 0 END) + (CASE WHEN coalesce(trim(study_id), '') = '' THEN 1 ELSE 0 END)) / 4.0 AS r FROM documents),
    y AS (SELECT doc_id, round(r::DOUBLE, 6) AS degraded, list_filter([CASE WHEN coalesce(trim(text), '') = '' THEN 'no_chunks' END, CASE WHEN r > 0.4 THEN 'degraded' END, CASE WHEN NOT coalesce(source IN ('lit_open', 'trial_registry', 'patent_full', 'label_text'), false) THEN 'unregistered_source' END, CASE WHEN license_tier IS NULL THEN 'no_tier' END], lambda z: z IS NOT NULL) AS rs FROM x)
    SELECT doc_id, degraded, array_to_string(rs, ',') AS reasons, len(rs) = 0 AS accepted FROM y""")
def ingest_qa(spark, d):
    return Q.ingest_qa(table(spark, d, "documents"), ["lit_open", "trial_registry", "patent_full", "label_text"])


@book.query("SELECT count(*) AS rows, round(avg(CASE WHEN section_path IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS with_path, round(avg(CASE WHEN page IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS with_page, round(avg(CASE WHEN len(entity_ids) > 0 THEN 1.0 ELSE 0.0 END), 6) AS with_entities FROM tree_nodes")
def structural_metrics(spark, d):
    checks = {"with_path": F.col("section_path").isNotNull(), "with_page": F.col("page").isNotNull(), "with_entities": F.coalesce(F.size("entity_ids") > 0, F.lit(False))}
    return Q.structure(table(spark, d, "tree_nodes"), checks)


@book.query("""WITH b AS (SELECT 'backlog' AS indicator, (SELECT count(DISTINCT user_id) FROM events)::DOUBLE AS value, 500.0::DOUBLE AS most UNION ALL SELECT 'wal_lines', (SELECT count(*) FROM events)::DOUBLE, 5000.0) SELECT indicator, value, most, value > most AS red FROM b""")
def slo_red(spark, d):
    e = table(spark, d, "events").agg(F.count_distinct("user_id").alias("u"), F.count(F.lit(1)).alias("n")).first()
    return Q.slo({"backlog": e["u"], "wal_lines": e["n"]}, {"backlog": 500, "wal_lines": 5000}, spark)


GOLD = "gold AS (SELECT user_id AS qid, CAST(json_extract(props, '$.k') AS INTEGER) AS key, CASE WHEN max(event_type = 'purchase') THEN 2 ELSE 1 END AS grade FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY 1, 2)"
ARMS = """runs AS (SELECT arm, qid, key, CAST(row_number() OVER (PARTITION BY arm, qid ORDER BY s DESC, key) AS INTEGER) AS rank FROM (
      SELECT 'click' AS arm, user_id AS qid, CAST(json_extract(props, '$.k') AS INTEGER) AS key, count(*) AS s FROM events WHERE event_type = 'click' GROUP BY 2, 3 UNION ALL
      SELECT 'view', user_id, CAST(json_extract(props, '$.k') AS INTEGER), count(*) FROM events WHERE event_type = 'view' GROUP BY 2, 3))"""
SCORES = f"""{GOLD}, {ARMS}, idl AS (SELECT qid, count(*) AS relevant, sum(CASE WHEN r <= 10 THEN grade / log2(r + 1) END) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, key) AS r FROM gold) GROUP BY 1),
    x AS (SELECT arm, runs.qid, rank, grade, sum(CASE WHEN grade IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY arm, runs.qid ORDER BY rank) AS found FROM runs LEFT JOIN gold ON runs.qid = gold.qid AND runs.key = gold.key WHERE rank <= 10),
    scores AS (SELECT arm, qid, round(count(grade) / any_value(relevant), 6) AS recall, round(count(grade) FILTER (rank <= 5) / 5, 6) AS p5, round(coalesce(sum(grade / log2(rank + 1)), 0) / any_value(idcg), 6) AS ndcg,
      round(coalesce(1 / min(CASE WHEN grade IS NOT NULL THEN rank END), 0), 6) AS rr, round(coalesce(sum(CASE WHEN grade IS NOT NULL THEN found / rank END), 0) / least(any_value(relevant), 10), 6) AS ap FROM x JOIN idl USING (qid) GROUP BY 1, 2)"""


def _scores(spark, d):
    e = table(spark, d, "events").withColumn("key", F.get_json_object("props", "$.k").cast("int"))
    g = e.where("event_type in ('purchase', 'signup')").groupBy(F.col("user_id").alias("qid"), "key").agg(F.max(F.when(F.col("event_type") == "purchase", 2).otherwise(1)).alias("grade"))
    r = e.where("event_type in ('click', 'view')").groupBy(F.col("event_type").alias("arm"), F.col("user_id").alias("qid"), "key").agg(F.count(F.lit(1)).alias("s"))
    from mossbrook.operators.topk import ranked

    return V.per_query(ranked(r, ["arm", "qid"], [F.col("s").desc(), F.col("key")]), g)


@book.query(f"WITH {SCORES} SELECT * FROM scores")
def ir_metrics(spark, d):
    return _scores(spark, d)


@book.query(f"""WITH {SCORES}, y AS (SELECT *, qid % 3 AS lang, qid % 2 AS intent FROM scores)
    SELECT arm, CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(intent) = 0 THEN 'intent' ELSE 'all' END AS slice, coalesce(CASE WHEN grouping(lang) = 0 THEN lang::VARCHAR END, CASE WHEN grouping(intent) = 0 THEN intent::VARCHAR END, '') AS value, count(*) AS queries,
      round(avg(recall), 6) AS recall, round(avg(p5), 6) AS p5, round(avg(ndcg), 6) AS ndcg, round(avg(rr), 6) AS rr, round(avg(ap), 6) AS ap FROM y GROUP BY GROUPING SETS ((arm), (arm, lang), (arm, intent))""")
def ir_slices(spark, d):
    s = _scores(spark, d).withColumn("lang", F.pmod("qid", F.lit(3))).withColumn("intent", F.pmod("qid", F.lit(2)))
    return V.slices(s, ["lang", "intent"])


@book.query(f"WITH {SCORES} SELECT a.qid, round(a.recall - b.recall, 6) AS recall, round(a.p5 - b.p5, 6) AS p5, round(a.ndcg - b.ndcg, 6) AS ndcg, round(a.rr - b.rr, 6) AS rr, round(a.ap - b.ap, 6) AS ap FROM scores a JOIN scores b ON a.qid = b.qid AND a.arm = 'view' AND b.arm = 'click'")
def arm_deltas(spark, d):
    return V.deltas(_scores(spark, d), "view", "click")


@book.query()
def paired_significance(spark, d):
    return V.significance(V.deltas(_scores(spark, d), "view", "click"), resamples=1000)


@book.query(f"""WITH {SCORES}, m AS (SELECT arm || '.ndcg' AS metric, round(avg(ndcg), 6) AS value FROM scores GROUP BY arm UNION ALL SELECT arm || '.recall', round(avg(recall), 6) FROM scores GROUP BY arm),
    t AS (SELECT * FROM (VALUES ('T1', 'view.ndcg', 'absolute_gain', -0.5, 'click.ndcg', false), ('T2', 'view.recall', 'not_worse', 0.01, 'click.recall', false), ('T3', 'click.ndcg', 'at_least', 0.99, NULL, true), ('T4', 'view.ndcg', 'relative_gain', 5.0, 'click.ndcg', false)) v(id, metric, comparison, threshold, baseline, waived)),
    j AS (SELECT t.*, m.value, b.value AS base FROM t LEFT JOIN m ON m.metric = t.metric LEFT JOIN m b ON b.metric = t.baseline),
    k AS (SELECT *, coalesce(CASE comparison WHEN 'at_least' THEN value >= threshold WHEN 'absolute_gain' THEN round(value - base, 6) >= threshold WHEN 'relative_gain' THEN round(value / base - 1, 6) >= threshold ELSE round(base - value, 6) <= threshold END, false) AS met FROM j)
    SELECT id, metric, comparison, met, met OR waived AS passed FROM k""")
def target_outcomes(spark, d):
    s = _scores(spark, d)
    m = s.groupBy("arm").agg(F.round(F.avg("ndcg"), 6).alias("ndcg"), F.round(F.avg("recall"), 6).alias("recall"))
    v = m.select(F.concat("arm", F.lit(".ndcg")).alias("metric"), F.col("ndcg").alias("value")).unionAll(m.select(F.concat("arm", F.lit(".recall")), "recall"))
    t = spark.createDataFrame(
        [("T1", "view.ndcg", "absolute_gain", -0.5, "click.ndcg", False), ("T2", "view.recall", "not_worse", 0.01, "click.recall", False), ("T3", "click.ndcg", "at_least", 0.99, None, True), ("T4", "view.ndcg", "relative_gain", 5.0, "click.ndcg", False)],
        "id string, metric string, comparison string, threshold double, baseline string, waived boolean",
    )
    return V.outcomes(v, t)


@book.query(f"""WITH {FACTS}, p AS (SELECT DISTINCT subject, predicate, object FROM facts), g AS (SELECT DISTINCT subject, predicate, object FROM facts WHERE doc_id % 2 = 0 UNION SELECT 'Nobody', 'received', preferred_term FROM bios_subset WHERE preferred_term IS NOT NULL),
    c AS (SELECT count(*) FILTER (p.subject IS NOT NULL AND g.subject IS NOT NULL) AS tp, count(*) FILTER (g.subject IS NULL) AS fp, count(*) FILTER (p.subject IS NULL) AS fn FROM p FULL JOIN g ON p.subject = g.subject AND p.predicate = g.predicate AND p.object = g.object)
    SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def triple_prf(spark, d):
    f = K.extract(table(spark, d, "documents"))
    extra = table(spark, d, "bios_subset").where(F.col("preferred_term").isNotNull()).select(F.lit("Nobody").alias("subject"), F.lit("received").alias("predicate"), F.col("preferred_term").alias("object"))
    gold = f.where("doc_id % 2 = 0").select("subject", "predicate", "object").unionByName(extra)
    return K.triple_scores(f, gold, ["subject", "predicate", "object"])


@book.query("""WITH new AS (SELECT o_orderkey, o_custkey, 'X' AS o_orderstatus, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_custkey % 7 = 0 AND o_orderkey % 2 = 0)
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM new) UNION ALL SELECT * FROM new""")
def replace_by_key_state(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    new = o.where("o_custkey % 7 = 0 and o_orderkey % 2 = 0").withColumn("o_orderstatus", F.lit("X")).withColumn("o_totalprice", F.col("o_totalprice") * 2)
    once = L.replaced(o, new, ["o_custkey"])
    return L.replaced(once, new, ["o_custkey"])


@book.query("""WITH st AS (SELECT user_id::VARCHAR AS doc_id, event_type AS plane, 'old' AS reason, min(ts) AS first_seen, max(ts) AS last_seen, CAST(count(*) AS INTEGER) AS replay_count, CASE WHEN user_id % 2 = 0 THEN 'open' ELSE 'replayed' END AS state FROM events WHERE event_type IN ('error', 'view') GROUP BY 1, 2, user_id),
    n AS (SELECT user_id::VARCHAR AS doc_id, event_type AS plane, max(ts) AS seen, 'new' AS reason FROM events WHERE event_type IN ('error', 'click') AND user_id % 3 = 0 GROUP BY 1, 2)
    SELECT coalesce(st.doc_id, n.doc_id) AS doc_id, coalesce(st.plane, n.plane) AS plane, coalesce(n.reason, st.reason) AS reason, CASE WHEN n.doc_id IS NULL OR coalesce(state = 'open', false) THEN first_seen ELSE n.seen END AS first_seen, coalesce(n.seen, last_seen) AS last_seen,
      CASE WHEN n.doc_id IS NULL OR coalesce(state = 'open', false) THEN replay_count ELSE 0 END AS replay_count, CASE WHEN n.doc_id IS NOT NULL THEN 'open' ELSE state END AS state FROM st FULL JOIN n ON st.doc_id = n.doc_id AND st.plane = n.plane""")
def quarantine_upsert(spark, d):
    e = table(spark, d, "events").withColumn("doc_id", F.col("user_id").cast("string")).withColumn("plane", F.col("event_type"))
    st = e.where("plane in ('error', 'view')").groupBy("doc_id", "plane", "user_id").agg(F.lit("old").alias("reason"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).cast("int").alias("replay_count"))
    st = st.withColumn("state", F.when(F.col("user_id") % 2 == 0, "open").otherwise("replayed")).drop("user_id")
    return L.quarantined(st, e.where("plane in ('error', 'click') and user_id % 3 = 0").select("doc_id", "plane", F.col("ts").alias("seen"), F.lit("new").alias("reason")))


@book.query("""WITH t AS (SELECT node_id, max(list_sort(list_distinct(coalesce(entity_ids, [])))) AS a FROM tree_nodes GROUP BY 1), b AS (SELECT node_id, CASE WHEN length(node_id) % 2 = 0 AND len(a) > 1 THEN a[1:1] ELSE a END AS b FROM t WHERE substr(node_id, -1) <> '0'), a AS (SELECT * FROM t WHERE substr(node_id, -1) <> '1')
    SELECT node_id, CASE WHEN b IS NULL THEN 'added' WHEN a IS NULL THEN 'removed' ELSE 'changed' END AS change FROM b FULL JOIN a USING (node_id) WHERE a IS DISTINCT FROM b""")
def retag_diff(spark, d):
    t = table(spark, d, "tree_nodes").groupBy("node_id").agg(F.max(F.array_sort(F.array_distinct(F.coalesce("entity_ids", F.array().cast("array<string>"))))).alias("a"))
    before = t.where(F.substring("node_id", -1, 1) != "0").withColumn("a", F.when((F.length("node_id") % 2 == 0) & (F.size("a") > 1), F.slice("a", 1, 1)).otherwise(F.col("a")))
    return L.tag_changes(before, t.where(F.substring("node_id", -1, 1) != "1"), "node_id", "a")


@book.query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'unparsed' WHEN doc_id % 7 = 0 THEN 'unstamped' ELSE 'changed' END AS why FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0 OR doc_id % 11 = 0""")
def dirty_docs(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("checksum"))
    stamps = t.where("doc_id % 7 <> 0").withColumn("checksum", F.when(F.col("doc_id") % 11 == 0, "old").otherwise(F.col("checksum")))
    return L.dirty(t, t.where("doc_id % 5 <> 0"), stamps)


@book.query("""WITH x AS (SELECT 'id' AS kind, unnest(external_ids) AS k, bios_id AS curie FROM bios_subset UNION ALL SELECT 'term', unnest(terms), bios_id FROM bios_subset), y AS (SELECT kind, trim(k) AS key, curie FROM x UNION SELECT kind, lower(trim(k)), curie FROM x) SELECT DISTINCT * FROM y WHERE key <> ''""")
def inverted_index(spark, d):
    return L.inverted_index(table(spark, d, "bios_subset"))


@book.query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT user_id * 37 FROM events)")
def point_lookup(spark, d):
    ids = table(spark, d, "events").select((F.col("user_id") * 37).alias("doc_id"))
    return L.lookup(table(spark, d, "documents").select("doc_id", "source"), ids, "doc_id")


@book.query("""WITH l AS (SELECT doc_id, string_split_regex(text, '\\n\\s*\\n') AS l FROM documents), b AS (SELECT doc_id, trim(unnest(l)) AS t, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS block_no FROM l), h AS (SELECT *, length(regexp_extract(t, '^(#{1,6}) ', 1)) AS m FROM b WHERE t <> '')
    SELECT doc_id, block_no, CASE WHEN m > 0 THEN 'heading' ELSE 'text' END AS kind, CASE WHEN m > 0 THEN CAST(m AS INTEGER) END AS level, regexp_replace(t, '^#{1,6} ', '') AS text FROM h""")
def text_blocks(spark, d):
    return L.text_blocks(table(spark, d, "documents"), "doc_id", "text")


@book.query("SELECT event_date, count(*) AS rows FROM (SELECT strftime(ts, '%Y-%m-%d') AS event_date FROM events) WHERE event_date >= '2024-01-10' GROUP BY 1")
def retention(spark, d):
    e = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("event_date"))
    return L.without_old(e, "2024-01-10").groupBy("event_date").agg(F.count(F.lit(1)).alias("rows"))
