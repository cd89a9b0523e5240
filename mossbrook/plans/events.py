"""Queries over the event stream, mining and signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from mossbrook.operators import events as E
from mossbrook.plans.base import Book, table
from mossbrook.streaming import observations as O

book = Book()
OBS = """o AS (SELECT substr(sha1('events|' || event_type || ' ' || (user_id % 20) || '|' || event_id || '|' || strftime(ts, '%Y-%m-%d %H:%M:%S')), 1, 24) AS observation_id, event_type || ' ' || (user_id % 20) AS mention, event_type || ' ' || (user_id % 20) AS mention_key,
      CASE event_type WHEN 'signup' THEN 'mapped' WHEN 'error' THEN 'low_confidence' ELSE 'unmapped' END AS status, 's' || (user_id % 3) AS source, CASE WHEN event_id % 2 = 0 THEN 'Disease' ELSE 'Target' END AS kind_hint,
      strftime(ts, '%Y-%m-%d %H:%M:%S') AS event_ts, strftime(ts, '%Y-%m-%d') AS event_date, event_id, user_id, value, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)"""
BACKLOG = """g AS (SELECT mention_key, count(*) AS occurrences, arg_min(mention, event_ts || observation_id) AS label, arg_max(status, event_ts || observation_id) AS status, max(event_ts) AS last_seen FROM {0} GROUP BY 1),
    sm AS (SELECT mention_key, arg_min(source, lpad((1000000000 - n)::VARCHAR, 10, '0') || source) AS source FROM (SELECT mention_key, source, count(*) AS n FROM {0} GROUP BY 1, 2) GROUP BY 1),
    km AS (SELECT mention_key, arg_min(kind_hint, lpad((1000000000 - n)::VARCHAR, 10, '0') || kind_hint) AS kind_hint FROM (SELECT mention_key, kind_hint, count(*) AS n FROM {0} GROUP BY 1, 2) GROUP BY 1)
    SELECT g.mention_key, occurrences, label, status, last_seen, source, kind_hint FROM g LEFT JOIN sm USING (mention_key) LEFT JOIN km USING (mention_key) WHERE status IN ('unmapped', 'low_confidence')"""


def _obs(spark, d):
    return O.observations(table(spark, d, "events"))


@book.query(f"WITH {OBS}, {BACKLOG.format('o')}")
def er_backlog(spark, d):
    once = _obs(spark, d)
    return E.backlog(once.unionAll(once))


@book.query(f"WITH {OBS}, w AS (SELECT * FROM o WHERE event_date >= '2024-01-20'), {BACKLOG.format('w')}")
def er_backlog_window(spark, d):
    return E.backlog(E.window_days(_obs(spark, d), "2024-01-20"))


@book.query(f"WITH {OBS}, l AS (SELECT mention_key, arg_max(status, event_ts || observation_id) AS status FROM o GROUP BY 1) SELECT 2 * (SELECT count(*) FROM o) AS raw_rows, (SELECT count(DISTINCT observation_id) FROM o) AS unique_events, (SELECT count(*) FROM l WHERE status <> 'mapped') AS open_keys")
def backlog_summary(spark, d):
    once = _obs(spark, d)
    return E.backlog_summary(once.unionAll(once))


def _decisions(spark, d):
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(F.col("event_id").alias("decision_id"), F.concat_ws(" ", "event_type", F.pmod("user_id", F.lit(20))).alias("subject"), (k / 100).alias("confidence"), F.when(k >= 20, F.concat(F.lit("C"), F.pmod(k, F.lit(3)))).alias("chosen"))


@book.query(f"WITH {OBS} SELECT mention AS subject, count(*) AS occurrences, min(k / 100) AS worst, arg_min(event_id, k * 1000000000::BIGINT + event_id) AS worst_at FROM o WHERE k / 100 < 0.6 GROUP BY 1")
def mined_low_confidence(spark, d):
    return E.low_confidence(_decisions(spark, d))


@book.query(f"WITH {OBS} SELECT mention AS subject, count(DISTINCT CASE WHEN k >= 20 THEN 'C' || (k % 3) END) AS choices, count(*) FILTER (k < 20) AS abstains FROM o GROUP BY 1 HAVING count(DISTINCT CASE WHEN k >= 20 THEN 'C' || (k % 3) END) > 1 OR count(*) FILTER (k < 20) > 0")
def mined_unstable(spark, d):
    return E.unstable(_decisions(spark, d))


@book.query(f"WITH {OBS} SELECT mention AS query, count(*) AS occurrences FROM o WHERE event_id % 1 = 0 AND k = 0 GROUP BY 1")
def mined_zero_result(spark, d):
    e = table(spark, d, "events")
    return E.zero_results(e.select(F.concat_ws(" ", "event_type", F.pmod("user_id", F.lit(20))).alias("query"), F.get_json_object("props", "$.k").cast("int").alias("total")))


@book.query("""WITH c AS (SELECT user_id AS query, CAST(json_extract(props, '$.k') AS INTEGER) AS key FROM events WHERE event_type = 'click'), r AS (SELECT DISTINCT user_id AS query, CAST(json_extract(props, '$.k') AS INTEGER) AS key FROM events WHERE event_type = 'view')
    SELECT query, key, count(*) AS occurrences FROM c WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.query = c.query AND r.key = c.key) GROUP BY 1, 2""")
def mined_expansion_miss(spark, d):
    e = table(spark, d, "events").select("event_type", F.col("user_id").alias("query"), F.get_json_object("props", "$.k").cast("int").alias("key"))
    return E.missed_clicks(e.where("event_type = 'click'"), e.where("event_type = 'view'"))


@book.query("""WITH x AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) GROUP BY 1 HAVING count(*) >= 12)), p AS (SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS groups FROM x a JOIN x b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2 HAVING count(*) >= 12)
    SELECT a, b, groups FROM p WHERE NOT EXISTS (SELECT 1 FROM supplier s JOIN supplier t ON s.s_nationkey = t.s_nationkey WHERE s.s_suppkey = p.a AND t.s_suppkey = p.b)""")
def cooccurrence_anomaly(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    known = s.select(F.col("s_suppkey").alias("a"), "s_nationkey").join(s.select(F.col("s_suppkey").alias("b"), "s_nationkey"), "s_nationkey")
    return E.cooccurrence(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey", 12, known)


_SIG = "SELECT lpad(CAST(CAST('0x' || substr(sha1(kind || '|' || payload), 1, 9) AS BIGINT) % 1000000000 AS VARCHAR), 9, '0') AS signal_id, kind, payload, occurrences, CASE WHEN occurrences >= 5 THEN 'P0' WHEN occurrences >= 2 THEN 'P1' ELSE base END AS priority"


@book.query(f"""WITH {OBS}, m AS (SELECT 'low_confidence' AS kind, mention AS payload, count(*) AS occurrences, 'P2' AS base FROM o WHERE k / 100 < 0.6 GROUP BY 2 UNION ALL SELECT 'zero_result', mention, count(*), 'P2' FROM o WHERE k = 0 GROUP BY 2
      UNION ALL SELECT 'negative_feedback', user_id::VARCHAR, count(*), 'P0' FROM o WHERE status = 'low_confidence' GROUP BY 2), s AS ({_SIG} FROM m)
    SELECT * FROM s""")
def mined_signals(spark, d):
    e = table(spark, d, "events")
    low = E.low_confidence(_decisions(spark, d))
    zero = E.zero_results(e.select(F.concat_ws(" ", "event_type", F.pmod("user_id", F.lit(20))).alias("query"), F.get_json_object("props", "$.k").cast("int").alias("total")))
    bad = E.negative_feedback(e.select(F.col("user_id").cast("string").alias("subject"), F.when(F.col("event_type") == "error", "WRONG").otherwise("CORRECT").alias("verdict")))
    return E.mined([E.signal(low, "low_confidence", F.col("subject"), F.col("occurrences")), E.signal(zero, "zero_result", F.col("query"), F.col("occurrences")), bad])


@book.query("""WITH RECURSIVE e AS (SELECT DISTINCT parent_id AS p, node_id AS c FROM tree_nodes WHERE parent_id <> ''), t AS (SELECT DISTINCT node_id AS concept FROM tree_nodes WHERE node_kind = 'section' AND parent_id <> ''),
    b AS (SELECT concept, concept AS node, 0 AS k FROM t UNION ALL SELECT concept, c, k + 1 FROM b JOIN e ON p = node WHERE k < 3), po AS (SELECT DISTINCT node_id AS node, content AS chunk, document_id FROM tree_nodes WHERE node_kind = 'table')
    SELECT concept, count(DISTINCT chunk) AS chunks, count(DISTINCT document_id) AS documents, count(DISTINCT chunk) > 0 AS reindex FROM b LEFT JOIN po USING (node) GROUP BY 1""")
def change_impact(spark, d):
    t = table(spark, d, "tree_nodes")
    edges = t.where("parent_id <> ''").select(F.col("parent_id").alias("parent"), F.col("node_id").alias("child"))
    touched = t.where("node_kind = 'section' and parent_id <> ''").select(F.col("node_id").alias("concept")).distinct()
    post = t.where("node_kind = 'table'").select(F.col("node_id").alias("concept"), F.col("content").alias("chunk"), F.col("document_id").alias("document"))
    return E.impact(touched, edges, post)


@book.query("""SELECT DISTINCT concept_id, CASE WHEN is_obsolete THEN 'obsolete ' || concept_id || ' with replacement ' || replaced_by ELSE 'create synonym ''' || members[1] || ''' for ' || concept_id END AS change
    FROM concept_ids WHERE (is_obsolete AND replaced_by IS NOT NULL) OR (NOT is_obsolete AND len(members) > 0)""")
def kgcl_changes(spark, d):
    c = table(spark, d, "concept_ids").where("(is_obsolete and replaced_by is not null) or (not is_obsolete and size(members) > 0)")
    op = F.when(F.col("is_obsolete"), "obsolete").otherwise("new_synonym")
    value = F.when(F.col("is_obsolete"), F.col("replaced_by")).otherwise(F.get("members", F.lit(0)))
    return c.select("concept_id", E.kgcl(op, F.col("concept_id"), value).alias("change")).distinct()


@book.query("""WITH lab AS (SELECT id, min(preferred_term) AS label FROM (SELECT unnest(external_ids) AS id, preferred_term FROM bios_subset) GROUP BY 1), c0 AS (SELECT mention, enterprise_id AS canonical, count(*) AS occ, max(CASE WHEN score <= 1 THEN score END) AS conf FROM zingg_matches WHERE mention IS NOT NULL GROUP BY 1, 2),
    c1 AS (SELECT c0.*, coalesce(label, mention) AS query FROM c0 LEFT JOIN lab ON id = canonical), c2 AS (SELECT *, lower(query) AS q, lower(mention) AS m, list_distinct(regexp_extract_all(lower(query), '\\p{L}+')) AS wq, list_distinct(regexp_extract_all(lower(mention), '\\p{L}+')) AS wm FROM c1),
    c AS (SELECT *, CASE WHEN q = m THEN 1.0 WHEN length(m) >= 4 AND (contains(q, m) OR contains(m, q)) THEN 1.0 ELSE len(list_intersect(wq, wm)) / greatest(len(list_distinct(list_concat(wq, wm))), 1) END AS near FROM c2),
    x AS (SELECT *, regexp_replace(lower(trim(mention)), '\\s+', ' ', 'g') AS k, list_filter([CASE WHEN regexp_replace(lower(trim(mention)), '\\s+', ' ', 'g') IN ('tbd', 'unknown', '-') THEN 'hard:blocked' END, CASE WHEN length(trim(mention)) < 2 THEN 'hard:short' END, CASE WHEN length(mention) > 80 THEN 'hard:long' END,
      CASE WHEN regexp_matches(mention, '^[^\\p{L}]+$') THEN 'hard:no_letters' END, CASE WHEN canonical IS NULL THEN 'soft:no_entity' END, CASE WHEN round(near, 6) < 0.35 THEN 'soft:overlap' END, CASE WHEN coalesce(conf, 0) < 0.6 THEN 'soft:confidence' END], lambda z: z IS NOT NULL) AS rs FROM c),
    y AS (SELECT *, len(list_filter(rs, lambda z: starts_with(z, 'hard'))) AS hard, round(coalesce(conf, 0) + round(near, 6) + 0.5 * least(occ, 10) / 10 - 0.3 * len(list_filter(rs, lambda z: starts_with(z, 'soft'))), 6) AS score FROM x),
    z AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY hard, score DESC, mention, coalesce(canonical, '')) AS r FROM y)
    SELECT mention, score, array_to_string(rs, ',') AS reasons, CASE WHEN hard > 0 THEN 'dismiss' WHEN len(rs) > 0 THEN 'review' ELSE 'keep' END AS decision FROM z WHERE r = 1""")
def candidate_filter(spark, d):
    z = table(spark, d, "zingg_matches").where(F.col("mention").isNotNull())
    c = z.groupBy("mention", F.col("enterprise_id").alias("canonical")).agg(F.count(F.lit(1)).alias("occurrences"), F.max(F.when(F.col("score") <= 1, F.col("score"))).alias("confidence"))
    label = table(spark, d, "bios_subset").select(F.explode("external_ids").alias("canonical"), "preferred_term").groupBy("canonical").agg(F.min("preferred_term").alias("label"))
    c = c.join(label, "canonical", "left").withColumn("query", F.coalesce("label", "mention")).drop("label")
    return E.candidates(c, spark.createDataFrame([("TBD",), ("unknown",), ("-",)], "mention string"))


@book.query(f"WITH {OBS} SELECT observation_id, mention_key, status, event_ts FROM o")
def stream_dedupe(spark, d):
    """The events written twice as files, streamed in several batches, each written once however late, and read back."""
    import uuid

    from mossbrook.session import ensure_checkpoint_dir

    base = f"{ensure_checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    for k in range(2):
        e.write.parquet(f"{base}/in/part={k}")
    s = O.source(spark, f"{base}/in/*", "event_id long, ts timestamp, user_id long, event_type string, value double", "parquet", 1)
    O.merged(O.observations(s), f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("observation_id", "mention_key", "status", "event_ts")


@book.query(f"WITH {OBS}, {BACKLOG.format('o')}")
def stream_event_fold(spark, d):
    """The fold over what the stream delivered equals the fold over the table."""
    import uuid

    from mossbrook.session import ensure_checkpoint_dir

    base = f"{ensure_checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"
    table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value").write.parquet(f"{base}/in")
    s = O.source(spark, f"{base}/in", "event_id long, ts timestamp, user_id long, event_type string, value double", "parquet")
    O.append(O.observations(s), f"{base}/out", f"{base}/state").awaitTermination()
    return E.backlog(spark.read.parquet(f"{base}/out"))
