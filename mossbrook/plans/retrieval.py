"""Retrieval queries: the evaluation items' questions ask the documents and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from mossbrook.operators import access as A
from mossbrook.operators import retrieval as R
from mossbrook.plans.base import Book, table

book = Book()
RANK = "CASE license_tier WHEN 'TIER_0' THEN 0 WHEN 'TIER_1' THEN 1 WHEN 'TIER_2' THEN 2 ELSE 3 END"
ENTITLED = ("patent_full",)
QUERIES = "qs AS (SELECT item_id AS qid, list_last(string_split(text, chr(10))) AS query FROM eval_items)"
WORDS = "regexp_extract_all(lower({0}), '\\p{{L}}+')"
BM25 = f"""{QUERIES}, qt AS (SELECT DISTINCT qid, unnest({WORDS.format('query')}) AS term FROM qs),
    p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({WORDS.format('text')}) AS term FROM documents) GROUP BY 1, 2), len AS (SELECT doc_id, sum(tf) AS length FROM p GROUP BY 1),
    st AS (SELECT count(*) AS n, avg(length) AS mean FROM len), dfs AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
    w AS (SELECT p.doc_id, p.term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)) AS w FROM p JOIN dfs USING (term) JOIN len USING (doc_id), st),
    bm AS (SELECT qid, doc_id, round(sum(w), 6) AS score FROM qt JOIN w USING (term) GROUP BY 1, 2)"""
DENSE = """dq AS (SELECT vec_id AS qid, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id % 50 = 0),
    de AS (SELECT qid, vec_id, round(list_cosine_similarity(v, list_transform(embedding, lambda x: x::DOUBLE)), 6) AS score FROM embeddings, dq)"""


def _queries(spark, d):
    return table(spark, d, "eval_items").select(F.col("item_id").alias("qid"), F.element_at(F.split("text", "\n"), -1).alias("query"))


def _lexical(spark, d, k, docs=None):
    return R.bm25(_queries(spark, d), table(spark, d, "documents"), "doc_id", "text", k, docs)


@book.query(f"WITH {BM25}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM bm) SELECT qid, doc_id AS key, score, rank FROM r WHERE rank <= 10")
def bm25_channel(spark, d):
    return R.channel(_lexical(spark, d, 10), "lexical", "doc_id").select("qid", "key", "score", "rank")


@book.query(f"WITH {DENSE}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM de) SELECT qid, vec_id, score FROM r WHERE rank <= 10")
def dense_channel(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    return R.dense(q, e, "vec_id", "embedding", 10)


CONCEPTS = """dc AS (SELECT DISTINCT node_id AS k, unnest(entity_ids) AS concept FROM tree_nodes), qc AS (SELECT DISTINCT document_id AS qid, unnest(entity_ids) AS concept FROM tree_nodes WHERE node_kind = 'document' AND CAST(right(document_id, 7) AS INTEGER) % 50 = 0),
    t AS (SELECT count(DISTINCT k) AS n FROM dc), dfs AS (SELECT concept, count(*) AS df FROM dc GROUP BY 1), dw AS (SELECT k, concept, greatest(ln(n / df), 0.1) AS w FROM dc JOIN dfs USING (concept), t),
    dn AS (SELECT k, sqrt(sum(w * w)) AS dn FROM dw GROUP BY 1), qw AS (SELECT qid, concept, coalesce(greatest(ln(n / df), 0.1), 0.1) AS qw FROM qc LEFT JOIN dfs USING (concept), t), qn AS (SELECT qid, sqrt(sum(qw * qw)) AS qn FROM qw GROUP BY 1),
    cc AS (SELECT qid, k, round(any_value(dot) / (any_value(dn) * any_value(qn)), 6) AS score FROM (SELECT qid, k, sum(qw * w) AS dot FROM qw JOIN dw USING (concept) GROUP BY 1, 2) JOIN dn USING (k) JOIN qn USING (qid) GROUP BY 1, 2)"""


def _concepts(spark, d):
    t = table(spark, d, "tree_nodes")
    dc = t.select(F.col("node_id").alias("k"), F.explode("entity_ids").alias("concept"))
    qc = t.where("node_kind = 'document' and cast(right(document_id, 7) as int) % 50 = 0").select(F.col("document_id").alias("qid"), F.explode("entity_ids").alias("concept"))
    return R.concept_channel(qc, dc, "k")


@book.query(f"WITH {CONCEPTS} SELECT qid, k, score FROM cc")
def concept_idf_channel(spark, d):
    return _concepts(spark, d)


FUSE = f"""{BM25}, {DENSE.replace('dq AS', 'dq AS').replace('SELECT vec_id AS qid', 'SELECT (SELECT min(item_id) FROM eval_items) + 3 * (vec_id / 50)::BIGINT AS qid')},
    c1 AS (SELECT qid, doc_id AS k, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM bm), c2 AS (SELECT qid, vec_id AS k, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM de)"""


def _vector_queries(spark, d):
    first = table(spark, d, "eval_items").agg(F.min("item_id").alias("m"))
    q = table(spark, d, "embeddings").where("vec_id % 50 = 0").join(F.broadcast(first))
    return q.select((F.col("m") + 3 * F.floor(F.col("vec_id") / 50)).cast("bigint").alias("qid"), F.col("embedding").alias("qvec"))


def _channels(spark, d):
    e, q = table(spark, d, "embeddings"), _vector_queries(spark, d)
    a = R.channel(_lexical(spark, d, 30), "lexical", "doc_id")
    b = R.channel(R.dense(q, e, "vec_id", "embedding", 30), "dense", "vec_id")
    return a, b


@book.query(f"""WITH {FUSE}, u AS (SELECT qid, k, 'lexical' AS ch, rank FROM c1 WHERE rank <= 30 UNION ALL SELECT qid, k, 'dense', rank FROM c2 WHERE rank <= 30),
    f AS (SELECT qid, k, round(sum(CASE ch WHEN 'dense' THEN 0.5 ELSE 1.0 END / (60 + rank)), 6) AS fused, CAST(max(CASE ch WHEN 'lexical' THEN rank END) AS INTEGER) AS lexical_rank, CAST(max(CASE ch WHEN 'dense' THEN rank END) AS INTEGER) AS dense_rank FROM u GROUP BY 1, 2),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY fused DESC, k) AS INTEGER) AS rank FROM f) SELECT qid, k AS key, fused::DOUBLE AS fused, lexical_rank, dense_rank, rank FROM r WHERE rank <= 10""")
def rrf_fusion(spark, d):
    f = R.rrf(_channels(spark, d), {"dense": 0.5})
    from mossbrook.operators.topk import top

    r = top(f, ["qid"], [F.col("fused").desc(), F.col("key")], 10)
    return r.select("qid", "key", "fused", F.try_element_at("ranks", F.lit("lexical")).alias("lexical_rank"), F.try_element_at("ranks", F.lit("dense")).alias("dense_rank"), "rank")


@book.query(f"""WITH {FUSE}, a AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM bm), b AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM de)
    SELECT qid, key, max(score) AS score FROM (SELECT qid, doc_id AS key, score FROM a WHERE rank <= 50 UNION ALL SELECT qid, vec_id, score FROM b WHERE rank <= 50) GROUP BY 1, 2""")
def max_merge(spark, d):
    dense = R.dense(_vector_queries(spark, d), table(spark, d, "embeddings"), "vec_id", "embedding", 50)
    return R.max_merge([_lexical(spark, d, 50).select("qid", F.col("doc_id").alias("key"), "score"), dense.select("qid", F.col("vec_id").alias("key"), "score")])


@book.query(f"""WITH {BM25}, ok AS (SELECT doc_id, source, coalesce({RANK}, 3) AS license_rank, substr(title, 1, 300) AS snippet FROM documents
      WHERE {RANK} <= 2 AND ({RANK} <= 1 OR coalesce(source = 'patent_full', false)) AND coalesce(doc_type IN ('FULL_TEXT', 'JOURNAL_ARTICLE'), false)),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM bm JOIN ok USING (doc_id)) SELECT qid, doc_id, source, license_rank, snippet, rank FROM r WHERE rank <= 20""")
def filtered_search(spark, d):
    docs = table(spark, d, "documents")
    rank = A.rank_of(F.col("license_tier"))
    ok = docs.where(R.allowed(rank, F.col("source"), 2, ENTITLED, modality=F.col("doc_type"), modalities=("FULL_TEXT", "JOURNAL_ARTICLE")))
    hits = R.channel(_lexical(spark, d, 20, ok), "lexical", "doc_id").select("qid", F.col("key").alias("doc_id"), "rank")
    stored = ok.select("doc_id", "source", rank.alias("license_rank"), R.snippet(F.col("title")).alias("snippet"))
    return hits.join(stored, "doc_id").select("qid", "doc_id", "source", "license_rank", "snippet", "rank")


@book.query("""WITH h AS (SELECT event_id, user_id * 37 AS doc_id FROM events), s AS (SELECT doc_id, arg_max(title, ingested_at) AS title FROM documents GROUP BY doc_id)
    SELECT event_id, h.doc_id, title, s.doc_id IS NOT NULL AS joined FROM h LEFT JOIN s USING (doc_id)""")
def hydrate_left_join(spark, d):
    h = table(spark, d, "events").select("event_id", (F.col("user_id") * 37).alias("doc_id"))
    return R.hydrate(h, table(spark, d, "documents").select("doc_id", F.col("ingested_at").alias("at"), "title"), "doc_id").select("event_id", "doc_id", "title", "joined")


@book.query("SELECT event_id, user_id * 37 AS doc_id FROM events WHERE user_id * 37 IN (SELECT doc_id FROM documents)")
def orphan_drop(spark, d):
    h = table(spark, d, "events").select("event_id", (F.col("user_id") * 37).alias("doc_id"))
    return R.known_only(h, table(spark, d, "documents"), "doc_id").select("event_id", "doc_id")


@book.query("""WITH q AS (SELECT bios_id AS qid, preferred_term AS query FROM bios_subset WHERE preferred_term IS NOT NULL GROUP BY ALL), x AS (SELECT DISTINCT bios_id AS qid, unnest(terms) AS term FROM bios_subset), e AS (SELECT qid, term, CASE WHEN length(term) > 8 THEN 0.8 ELSE 0.5 END AS w FROM x),
    j AS (SELECT qid, query, term, w FROM e JOIN q USING (qid) WHERE NOT contains(lower(query), lower(term))), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY w DESC, term) AS k FROM j),
    a AS (SELECT qid, string_agg(term, ' ' ORDER BY k) AS t FROM r WHERE k <= 8 GROUP BY qid) SELECT qid, query AS original, query || coalesce(' ' || t, '') AS rewritten FROM q LEFT JOIN a USING (qid)""")
def query_rewrite(spark, d):
    b = table(spark, d, "bios_subset")
    q = b.where(F.col("preferred_term").isNotNull()).select(F.col("bios_id").alias("qid"), F.col("preferred_term").alias("query")).distinct()
    e = b.select(F.col("bios_id").alias("qid"), F.explode("terms").alias("term")).distinct().withColumn("weight", F.when(F.length("term") > 8, 0.8).otherwise(0.5))
    return R.rewrite(q, e)


@book.query(f"""WITH {BM25}, f AS (SELECT qid, doc_id AS k, score AS fused, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS r0 FROM bm), s AS (SELECT doc_id AS k, CASE WHEN n_chars % 3 <> 0 THEN n_chars::DOUBLE END AS rerank FROM documents),
    j AS (SELECT qid, k AS key, CAST(row_number() OVER (PARTITION BY qid ORDER BY rerank DESC NULLS LAST, fused DESC, k) AS INTEGER) AS rank FROM f LEFT JOIN s USING (k) WHERE r0 <= 20) SELECT * FROM j""")
def rerank_pool(spark, d):
    f = R.channel(_lexical(spark, d, 20), "lexical", "doc_id").select("qid", "key", F.col("score").alias("fused"))
    s = table(spark, d, "documents").where("n_chars % 3 <> 0").select(F.col("doc_id").alias("key"), F.col("n_chars").cast("double").alias("rerank"))
    return R.rerank(f, f.select("qid", "key").join(s, "key").select("qid", "key", "rerank")).select("qid", "key", "rank")
