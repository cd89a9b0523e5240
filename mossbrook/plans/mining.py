"""Queries of traces, miners, review pools, linker records and further evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from mossbrook.functions import text as X
from mossbrook.operators import corpus as C
from mossbrook.operators import evaluation as V
from mossbrook.operators import mining as M
from mossbrook.plans.base import Book, table
from mossbrook.plans.corpus import NODES, U
from mossbrook.plans.quality import SCORES, _scores

book = Book()
DEC = """d AS (SELECT event_id AS decision_id, user_id::VARCHAR AS trace_id, CASE event_type WHEN 'error' THEN NULL ELSE event_type END AS stage, 's' || (user_id % 7) AS subject, round(value / 100.0, 6) AS confidence, CAST(json_extract(props, '$.k') AS INTEGER) AS chosen FROM events)"""


def _decisions(spark, d):
    return table(spark, d, "events").select(
        F.col("event_id").alias("decision_id"), F.col("user_id").cast("string").alias("trace_id"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("stage"),
        F.concat(F.lit("s"), F.pmod("user_id", F.lit(7))).alias("subject"), F.round(F.col("value") / 100.0, 6).alias("confidence"), F.get_json_object("props", "$.k").cast("int").alias("chosen"),
    )


@book.query(f"WITH {DEC}, io AS (SELECT o_custkey::VARCHAR AS trace_id, o_orderkey AS call FROM orders WHERE o_custkey < 200) SELECT decision_id, d.trace_id, call FROM d LEFT JOIN io USING (trace_id)")
def decisions_by_trace(spark, d):
    io = table(spark, d, "orders").where("o_custkey < 200").select(F.col("o_custkey").cast("string").alias("trace_id"), F.col("o_orderkey").alias("call"))
    return M.by_trace(_decisions(spark, d), io).select("decision_id", "trace_id", "call")


@book.query(f"WITH {DEC} SELECT coalesce(stage, 'unmapped') AS stage, count(*) AS hits FROM d GROUP BY 1")
def stage_histogram(spark, d):
    return M.stage_hits(_decisions(spark, d))


@book.query(f"""WITH {DEC}, u AS (SELECT stage || ' ' || subject AS mention_key, trace_id, count(*) AS n FROM d WHERE stage IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY mention_key ORDER BY trace_id) AS r FROM u)
    SELECT mention_key, CAST(sum(n) AS BIGINT) AS occurrences, count(*) AS traces, string_agg(CASE WHEN r <= 5 THEN trace_id END, ',' ORDER BY trace_id) AS sample FROM r GROUP BY 1""")
def unmapped_counts(spark, d):
    o = _decisions(spark, d).where("stage is not null").select(F.concat_ws(" ", "stage", "subject").alias("mention_key"), "trace_id", F.lit("unmapped").alias("status"))
    return M.span_counts(o)


@book.query(f"""WITH {DEC}, z AS (SELECT subject AS payload, count(*) AS occurrences FROM d WHERE confidence < 0.6 GROUP BY 1), us AS (SELECT stage, subject, count(DISTINCT chosen) AS n FROM d GROUP BY 1, 2)
    SELECT 'low_confidence' AS kind, payload, occurrences, CASE WHEN occurrences >= 5 THEN 'P0' WHEN occurrences >= 2 THEN 'P1' ELSE 'P2' END AS priority FROM z
    UNION ALL SELECT 'unstable', subject, CAST(sum(n) AS BIGINT), 'P1' FROM us WHERE n > 1 GROUP BY subject""")
def miner_registry(spark, d):
    x = _decisions(spark, d)
    return M.mine({"low_confidence": x, "unstable": x})


@book.query("WITH m AS (SELECT lower(trim(mention)) AS mention_key, mention AS label, count(*) AS occurrences FROM zingg_matches WHERE trim(mention) <> '' GROUP BY 1, 2) SELECT mention_key, arg_min(label, (-occurrences, label)) AS label, max(occurrences) AS occurrences FROM m GROUP BY 1")
def most_frequent_label(spark, d):
    return M.most_frequent(_mentions(spark, d), "mention_key")


def _mentions(spark, d):
    z = table(spark, d, "zingg_matches").where("trim(mention) <> ''")
    return z.groupBy(F.lower(F.trim("mention")).alias("mention_key"), F.col("mention").alias("label")).agg(F.count(F.lit(1)).alias("occurrences"))


@book.query("SELECT lower(trim(mention)) AS mention_key, count(*) AS occurrences FROM zingg_matches WHERE trim(mention) <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 200")
def leading_mentions(spark, d):
    return M.leading(_mentions(spark, d).groupBy("mention_key").agg(F.sum("occurrences").alias("occurrences")))


@book.query(f"""WITH {NODES}, f AS (SELECT DISTINCT lower(w) AS payload, node_id AS chunk FROM (SELECT node_id, unnest(regexp_extract_all(content, '[A-Z]{{2,4}}-[0-9]+')) AS w FROM n)), c AS (SELECT DISTINCT node_id AS chunk, unnest(entity_ids) AS concept FROM n),
    g AS (SELECT payload, concept, count(*) AS k FROM f JOIN c USING (chunk) GROUP BY 1, 2) SELECT payload, arg_min(concept, (-k, concept)) AS concept FROM g GROUP BY 1""")
def guessed_concepts(spark, d):
    n = C.nodes(table(spark, d, "tree_nodes"))
    f = n.select(F.explode(F.regexp_extract_all("content", F.lit("[A-Z]{2,4}-[0-9]+"), F.lit(0))).alias("w"), F.col("node_id").alias("chunk")).select(F.lower("w").alias("payload"), "chunk")
    return M.guess_concept(f, n.select(F.col("node_id").alias("chunk"), F.explode("entity_ids").alias("concept")))


POOL = """p AS (SELECT lower(trim(mention)) AS mention_key, CASE WHEN score >= 0.8 THEN 'keep' WHEN score IS NULL THEN 'dismiss' ELSE 'review' END AS decision, CASE WHEN length(mention) < 6 THEN ['hard:short'] ELSE ['soft:x'] END AS reasons,
    CASE WHEN note IS NULL THEN 1.0 ELSE 0.5 END AS overlap, CASE WHEN kind_hint = 'Target' THEN 'xref' ELSE 'model' END AS method, score AS confidence FROM zingg_matches WHERE mention IS NOT NULL)"""


@book.query(f"""WITH {POOL}, k AS (SELECT mention_key, decision, confidence, row_number() OVER (PARTITION BY mention_key ORDER BY decision = 'keep', coalesce(-confidence, 0), decision, confidence) AS r FROM p WHERE mention_key <> '' AND
      ((decision = 'review' AND NOT (reasons[1] = 'hard:short')) OR (decision = 'keep' AND NOT (overlap >= 1 AND (method = 'xref' OR coalesce(confidence, 0) >= 0.9))))) SELECT mention_key, decision, confidence FROM k WHERE r = 1""")
def review_pool(spark, d):
    z = table(spark, d, "zingg_matches").where(F.col("mention").isNotNull())
    c = z.select(
        F.lower(F.trim("mention")).alias("mention_key"), F.when(F.col("score") >= 0.8, "keep").when(F.col("score").isNull(), "dismiss").otherwise("review").alias("decision"),
        F.array(F.when(F.length("mention") < 6, "hard:short").otherwise("soft:x")).alias("reasons"), F.when(F.col("note").isNull(), 1.0).otherwise(0.5).alias("overlap"), F.when(F.col("kind_hint") == "Target", "xref").otherwise("model").alias("method"), F.col("score").alias("confidence"),
    )
    return M.review_pool(c)


@book.query("SELECT match_id AS proposal_id, score AS confidence FROM zingg_matches WHERE kind_hint = 'Target' AND coalesce(note, 'pending') = 'pending' AND coalesce(score, 0) >= 0.7")
def proposal_selection(spark, d):
    p = table(spark, d, "zingg_matches").select(F.col("match_id").alias("proposal_id"), F.col("kind_hint").alias("tier"), F.col("score").alias("confidence"), F.coalesce("note", F.lit("pending")).alias("status"))
    return M.proposals(p, tier="Target", least=0.7).select("proposal_id", "confidence")


CLUSTER = """r AS (SELECT enterprise_id AS cluster, match_id AS id, mention AS label, score, false AS own FROM zingg_matches WHERE enterprise_id IS NOT NULL UNION ALL SELECT x, x, preferred_term, NULL, true FROM (SELECT unnest(external_ids) AS x, preferred_term FROM bios_subset) WHERE starts_with(x, 'HMD:')),
    pr AS (SELECT o.cluster, mention, enterprise_id, coalesce(score, own_score, 0.0) AS score FROM (SELECT cluster, label AS mention, max(score) AS score FROM r WHERE NOT own AND coalesce(label, '') <> '' GROUP BY 1, 2) o JOIN (SELECT DISTINCT cluster, id AS enterprise_id, score AS own_score FROM r WHERE own) e USING (cluster))"""


def _records(spark, d):
    a = table(spark, d, "zingg_matches").where(F.col("enterprise_id").isNotNull()).select(F.col("enterprise_id").alias("cluster"), F.col("match_id").alias("id"), F.col("mention").alias("label"), "score", F.lit(False).alias("own"))
    b = table(spark, d, "bios_subset").select(F.explode("external_ids").alias("x"), "preferred_term").where("x like 'HMD:%'")
    return a.unionByName(b.select(F.col("x").alias("cluster"), F.col("x").alias("id"), F.col("preferred_term").alias("label"), F.lit(None).cast("double").alias("score"), F.lit(True).alias("own")))


@book.query(f"WITH {CLUSTER} SELECT cluster, mention, enterprise_id, score FROM pr")
def cluster_pairs(spark, d):
    return M.cluster_pairs(_records(spark, d))


@book.query(f"WITH {CLUSTER}, k AS (SELECT *, lower(trim(mention)) AS mention_key, row_number() OVER (PARTITION BY lower(trim(mention)) ORDER BY score DESC, enterprise_id, mention) AS r FROM pr) SELECT mention_key, mention, enterprise_id, score FROM k WHERE r = 1")
def cluster_matches(spark, d):
    return M.best_matches(M.cluster_pairs(_records(spark, d)))


@book.query("""WITH b AS (SELECT DISTINCT trim(preferred_term) AS label FROM bios_subset WHERE preferred_term IS NOT NULL), v AS (SELECT label, unnest(list_concat([lower(label), upper(replace(replace(replace(label, 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl')), replace(label, '-', ''), replace(label, ' ', ''), replace(label, '-', ' ')],
      CASE WHEN length(label) >= 5 AND regexp_full_match(label, '[ -~]+') THEN [label || right(label, 1), left(label, length(label) - 1) || 'x'] ELSE [] END)) AS variant FROM b)
    SELECT DISTINCT label, variant FROM v WHERE variant <> '' AND regexp_replace(lower(trim(variant)), '\\s+', ' ', 'g') <> regexp_replace(lower(trim(label)), '\\s+', ' ', 'g')""")
def label_variants(spark, d):
    b = table(spark, d, "bios_subset").where(F.col("preferred_term").isNotNull()).select(F.trim("preferred_term").alias("label")).distinct()
    return b.select("label", F.explode(X.label_variants(F.col("label"))).alias("variant"))


@book.query("SELECT DISTINCT doc_id, CASE WHEN doc_id % 5 <> 0 THEN round(greatest(0.0, (epoch_us(TIMESTAMPTZ '2024-06-01 00:00:00+00') - epoch_us(ingested_at)) / 3600000000.0), 4) END AS hours FROM documents")
def ages(spark, d):
    at = F.when(F.col("doc_id") % 5 != 0, F.date_format("ingested_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")).otherwise("not a time")
    return table(spark, d, "documents").select("doc_id", X.hours_since(at, F.lit("2024-06-01 00:00:00").cast("timestamp")).alias("hours")).distinct()


@book.query("""WITH b AS (SELECT DISTINCT bios_id, preferred_term, coalesce(terms, []) AS terms FROM bios_subset), s AS (SELECT bios_id, preferred_term, terms, list_transform(list_filter(list_concat([preferred_term], terms), lambda x: coalesce(length(trim(x)) >= 2, false)), lambda x: trim(x)) AS e FROM b)
    SELECT bios_id, list_filter(e, lambda x, i: list_position(list_transform(e, lambda y: lower(y)), lower(x)) = i)[1:8] AS surfaces FROM s""")
def concept_surfaces(spark, d):
    b = table(spark, d, "bios_subset").select("bios_id", "preferred_term", F.coalesce("terms", F.array().cast("array<string>")).alias("terms")).distinct()
    return b.select("bios_id", X.surfaces(F.col("preferred_term"), F.col("terms")).alias("surfaces"))


@book.query(f"""WITH {NODES}, t AS (SELECT node_id, string_split(content, chr(10)) AS rows FROM n WHERE node_kind = 'table' AND length(content) > 0), r AS (SELECT node_id, string_split(rows[1], ' | ') AS h, unnest(rows[2:]) AS r FROM t),
    q AS (SELECT node_id, r, array_to_string(list_filter(list_transform(range(1, least(len(h), len(string_split(r, ' | '))) + 1), lambda i: CASE WHEN h[i] IN ('N', 'Arm') AND trim(string_split(r, ' | ')[i]) <> '' THEN h[i] || '=' || trim(string_split(r, ' | ')[i]) END), lambda x: x IS NOT NULL), ';') AS qualifiers FROM r)
    SELECT DISTINCT node_id, qualifiers FROM q WHERE qualifiers <> ''""")
def row_qualifiers(spark, d):
    t = C.nodes(table(spark, d, "tree_nodes").where("node_kind = 'table'")).where("length(content) > 0").withColumn("rows", F.split("content", "\n"))
    r = t.select("node_id", F.split(F.col("rows")[0], r" \| ").alias("h"), F.explode(F.slice("rows", F.lit(2), F.greatest(F.size("rows"), F.lit(1)))).alias("r"))
    q = r.select("node_id", F.array_join(X.qualifiers(F.col("h"), F.split("r", r" \| "), ["N", "Arm"]), ";").alias("qualifiers"))
    return q.where("qualifiers <> ''").distinct()


@book.query("""WITH t AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '[一-鿿]+')) AS run FROM documents WHERE lang = 'zh'), p AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(run, '[的了和与及在是对为被将从于中或者]')) AS piece FROM t) SELECT doc_id, count(*) AS pieces FROM p WHERE length(piece) = 4 GROUP BY 1""")
def bounded_segments(spark, d):
    """Pieces of four Han characters that are whole stretches, by document: every place is asked."""
    t = table(spark, d, "documents").where("lang = 'zh' and length(text) >= 4")
    at = t.select("doc_id", "text", F.explode(F.sequence(F.lit(1), F.length("text") - 3)).alias("i"))
    ok = at.where(X.bounded(F.col("text"), F.col("i"), F.lit(4))).select("doc_id", F.substring("text", F.col("i"), F.lit(4)).alias("piece")).distinct()
    return ok.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"))


@book.query(f"WITH {SCORES} SELECT arm, count(*) AS queries, round(avg(recall), 6) AS recall, round(avg(p5), 6) AS p5, round(avg(ndcg), 6) AS ndcg, round(avg(rr), 6) AS rr, round(avg(ap), 6) AS ap FROM scores WHERE qid % 4 IN (1, 2) GROUP BY 1")
def probe_micro_average(spark, d):
    s = _scores(spark, d).withColumn("probe", F.concat(F.lit("p"), F.pmod("qid", F.lit(4))))
    return V.probe_average(s, ["p1", "p2"])


RUNS = "runs AS (SELECT arm, qid, key, CAST(row_number() OVER (PARTITION BY arm, qid ORDER BY n DESC, key) AS INTEGER) AS rank FROM (SELECT event_type AS arm, user_id AS qid, CAST(json_extract(props, '$.k') AS INTEGER) AS key, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2, 3))"


def _runs(spark, d):
    from mossbrook.operators.topk import ranked

    e = table(spark, d, "events").withColumn("key", F.get_json_object("props", "$.k").cast("int"))
    r = e.where("event_type in ('click', 'view')").groupBy(F.col("event_type").alias("arm"), F.col("user_id").alias("qid"), "key").agg(F.count(F.lit(1)).alias("n"))
    gold = e.where("event_type = 'purchase'").select(F.col("user_id").alias("qid"), "key").distinct()
    return ranked(r, ["arm", "qid"], [F.col("n").desc(), F.col("key")]), gold


@book.query(f"""WITH {RUNS}, gold AS (SELECT user_id AS qid, count(DISTINCT CAST(json_extract(props, '$.k') AS INTEGER)) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1), j AS (SELECT arm, qid, round(avg(CASE WHEN key % 3 <> 0 THEN 1 ELSE 0 END), 6) AS judged FROM runs WHERE rank <= 10 GROUP BY 1, 2)
    SELECT arm, qid, coalesce(judged, 1.0) AS judged, round(least(10, n) / n, 6) AS ceiling FROM gold LEFT JOIN j USING (qid)""")
def judged_at_k(spark, d):
    runs, gold = _runs(spark, d)
    return V.judged(runs, gold, table(spark, d, "events").select(F.get_json_object("props", "$.k").cast("int").alias("key")).where("key % 3 <> 0"))


@book.query(f"""WITH {NODES}, tr AS (SELECT DISTINCT document_id AS document, unnest(entity_ids) AS concept FROM n), k AS (SELECT DISTINCT parent_id AS qid, document_id AS document, entity_ids[1] AS concept FROM n WHERE node_kind = 'paragraph' UNION SELECT DISTINCT parent_id, document_id, 'X' FROM n WHERE node_kind = 'table')
    SELECT qid, round(avg(CASE WHEN k.concept IS NULL THEN 1.0 WHEN tr.concept IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS fidelity FROM k LEFT JOIN tr ON k.document = tr.document AND k.concept = tr.concept GROUP BY 1""")
def citation_fidelity(spark, d):
    n = C.nodes(table(spark, d, "tree_nodes"))
    truth = n.select(F.col("document_id").alias("document"), F.explode_outer("entity_ids").alias("concept"))
    a = n.where("node_kind = 'paragraph'").select(F.col("parent_id").alias("qid"), F.col("document_id").alias("document"), F.get("entity_ids", F.lit(0)).alias("concept"))
    b = n.where("node_kind = 'table'").select(F.col("parent_id").alias("qid"), F.col("document_id").alias("document"), F.lit("X").alias("concept"))
    return V.citation_fidelity(a.union(b), truth)


@book.query(f"""WITH {NODES}, s AS (SELECT DISTINCT document_id AS document, {U} AS section FROM n WHERE section_path IS NOT NULL AND node_kind = 'paragraph'), i AS (SELECT DISTINCT document, list_last(string_split(section, ' / ')) AS alias FROM s WHERE document LIKE '%1' UNION SELECT document, section FROM s WHERE document LIKE '%2')
    SELECT s.document, s.section, CASE WHEN document LIKE '%2' THEN section WHEN document LIKE '%1' THEN list_last(string_split(section, ' / ')) END AS alias,
      CASE WHEN document LIKE '%2' THEN false WHEN document LIKE '%1' THEN contains(section, ' / ') END AS fallback FROM s""")
def gold_section_alias(spark, d):
    n = C.nodes(table(spark, d, "tree_nodes")).where("section_path is not null and node_kind = 'paragraph'")
    s = n.select(F.col("document_id").alias("document"), X.unify_path(F.col("section_path")).alias("section")).distinct()
    a = s.where("document like '%1'").select("document", F.element_at(F.split("section", " / "), -1).alias("alias"))
    return V.gold_sections(s, a.union(s.where("document like '%2'")))


@book.query("""WITH c AS (SELECT DISTINCT preferred_term AS mention, list_filter(external_ids, lambda x: starts_with(x, 'HMD:'))[1] AS expect FROM bios_subset WHERE preferred_term IS NOT NULL AND len(list_filter(external_ids, lambda x: starts_with(x, 'HMD:'))) > 0),
    l AS (SELECT mention, min(enterprise_id) AS l FROM zingg_matches GROUP BY 1), h AS (SELECT DISTINCT mention FROM zingg_matches)
    SELECT c.mention, expect, coalesce(l = expect, false) AS same, h.mention IS NOT NULL AS found, coalesce(l = expect, false) AND h.mention IS NOT NULL AS passed FROM c LEFT JOIN l USING (mention) LEFT JOIN h USING (mention)""")
def bridge_checks(spark, d):
    b = table(spark, d, "bios_subset").where(F.col("preferred_term").isNotNull()).select(F.col("preferred_term").alias("mention"), F.get(F.filter("external_ids", lambda x: F.startswith(x, F.lit("HMD:"))), F.lit(0)).alias("expect")).where("expect is not null").distinct()
    z = table(spark, d, "zingg_matches").select("mention", F.col("enterprise_id").alias("id"))
    return V.bridge(b, b.select("mention", F.col("expect").alias("id")), z, z)


@book.query("""WITH e AS (SELECT event_type AS arm, user_id % 3 AS lang, round(value, 1) AS x FROM events), s AS (SELECT arm, 'all' AS slice, '' AS value, x FROM e UNION ALL SELECT arm, 'lang', lang::VARCHAR, x FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY arm, slice, value ORDER BY x) AS k, count(*) OVER (PARTITION BY arm, slice, value) AS n FROM s)
    SELECT arm, slice, value, any_value(n) AS queries, min(CASE WHEN k >= ceil(0.5 * n) THEN x END) AS p50, min(CASE WHEN k >= ceil(0.95 * n) THEN x END) AS p95 FROM r GROUP BY 1, 2, 3""")
def latency_slices(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("arm"), F.pmod("user_id", F.lit(3)).alias("lang"), F.round("value", 1).alias("elapsed"))
    return V.latency_slices(e, ["lang"])
