"""Documents as trees, sections and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mossbrook import schema as S
from mossbrook.functions import text as X


def nodes(tree: DataFrame) -> DataFrame:
    """The tree's nodes once each: the latest arrival of a node_id."""
    from mossbrook.operators.topk import latest

    return latest(tree.where(F.col("node_id").isNotNull()), ["node_id"], ["ingested_at", "content"])


def pack(sentences: Column, limit: int = S.CHUNK_CHARS) -> Column:
    """Greedy chunks of whole sentences, joined by a blank, none over ``limit`` unless one sentence is."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc: Column, s: Column) -> Column:
        full = (acc["cur"] != "") & (F.length(acc["cur"]) + F.length(s) > limit)
        done = F.when(full, F.concat(acc["done"], F.array(F.trim(acc["cur"])))).otherwise(acc["done"])
        cur = F.when(full | (acc["cur"] == ""), s).otherwise(F.concat(acc["cur"], F.lit(" "), s))
        return F.struct(done.alias("done"), cur.alias("cur"))

    return F.aggregate(sentences, empty, step, lambda acc: F.when(F.trim(acc["cur"]) != "", F.concat(acc["done"], F.array(F.trim(acc["cur"])))).otherwise(acc["done"]))


def chunks(docs: DataFrame, limit: int = S.CHUNK_CHARS) -> DataFrame:
    """(doc_id, chunk_id, position, text) of the documents, packed by sentences."""
    c = docs.select("doc_id", F.posexplode(pack(X.sentences(F.col("text")), limit)).alias("position", "text"))
    return c.select("doc_id", X.id_hash("CHK:txt.", F.col("doc_id"), F.col("position"), size=10).alias("chunk_id"), "position", "text")


def table_parts(tables: DataFrame, budget: int = S.TABLE_BYTES) -> DataFrame:
    """(node_id, part, rows, text) of long tables, cut by rows within a byte budget, the header repeated."""
    rows = F.split("content", "\n")
    header = rows[0]
    room = F.greatest(F.lit(budget) - F.octet_length(header), F.lit(S.TABLE_LEAST))
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("cur"), F.lit(0).alias("size"))

    def step(acc: Column, r: Column) -> Column:
        n = F.octet_length(r) + 1
        full = (F.size(acc["cur"]) > 0) & (acc["size"] + n > F.col("room"))
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]).alias("done"),
            F.when(full, F.array(r)).otherwise(F.concat(acc["cur"], F.array(r))).alias("cur"),
            F.when(full, n).otherwise(acc["size"] + n).alias("size"),
        )

    packed = F.aggregate(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), start, step, lambda a: F.when(F.size(a["cur"]) > 0, F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"]))
    t = tables.where(F.length("content") > 0).withColumn("room", room)
    out = t.select("node_id", header.alias("header"), F.posexplode(packed).alias("part", "r"))
    return out.select("node_id", "part", F.size("r").alias("rows"), F.concat_ws("\n", "header", F.array_join("r", "\n")).alias("text"))


def offsets(parts: DataFrame, by: str, order: list[str], size: Column) -> DataFrame:
    """Adds ``start``: the sizes before a part within its group."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("start", F.coalesce(F.sum(size).over(w), F.lit(0)))


def first_owner(docs: DataFrame, least: int = S.DEDUPE_LEAST) -> DataFrame:
    """(doc_id, same_as): documents whose text, blanks and case aside, another one of a smaller id has too; texts of
    ``least`` characters or more. Grouped by hash, the smallest id is a partial aggregate."""
    t = docs.select("doc_id", F.regexp_replace(F.lower(F.trim("text")), r"\s+", " ").alias("t")).where(F.length("t") >= least).select("doc_id", F.md5("t").alias("h"))
    own = t.groupBy("h").agg(F.min("doc_id").alias("same_as"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return t.join(own, "h").where(F.col("doc_id") != F.col("same_as")).select("doc_id", "same_as")


def labels(docs: DataFrame, taxonomy: dict[str, list[str]]) -> DataFrame:
    """(doc_id, label, hits, confidence) for labels with one keyword or more in the text."""
    each = F.array(*[F.struct(F.lit(k).alias("label"), F.size(X.keyword_hits(F.col("text"), v)).alias("hits")) for k, v in taxonomy.items()])
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", F.explode(each).alias("l")).select("doc_id", "l.label", "l.hits").where("hits > 0")
    return rows.withColumn("confidence", X.label_confidence(F.col("hits")))


def boilerplate(path: Column) -> Column:
    """The last part of the path is references, acknowledgements and the like."""
    return F.lower(F.element_at(F.split(X.unify_path(path), " / "), -1)).rlike(r"^(references|bibliography|acknowledge?ments?|abstract|limitations)")


def evidence_tree(hits: DataFrame) -> DataFrame:
    """Hits (document_id, section_path, page, score) as (document_id, best, sections): sections by first page, each with
    its best score, its pages and its number of hits."""
    s = hits.groupBy("document_id", "section_path").agg(F.max("score").alias("best"), F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count(F.lit(1)).alias("hits"))
    return s.groupBy("document_id").agg(F.max("best").alias("best"), F.array_sort(F.collect_list(F.struct("first_page", "section_path", "last_page", "best", "hits"))).alias("sections"))


def restore(parts: DataFrame, by: str, order: list[str], limit: int = S.RESTORE_CHARS, joint: int = S.RESTORE_JOINT) -> DataFrame:
    """The parts of a context that fit a budget of characters, the one on the border cut: adds ``used`` and ``piece``."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("content") + joint).over(w), F.lit(0))
    left = F.lit(limit) - F.col("used")
    return parts.withColumn("used", before).where(left > 0).withColumn("piece", F.substring("content", F.lit(1), left))


def siblings(tree: DataFrame) -> DataFrame:
    """Each node with its neighbours under the same parent, in reading order."""
    w = Window.partitionBy("document_id", "parent_id").orderBy("sort_order", "node_id")
    return tree.select("node_id", F.lag("node_id").over(w).alias("before"), F.lead("node_id").over(w).alias("after"))


def _by_level(values: dict[int, Column], level: Column) -> Column:
    """The value of a row's level; a level without one is an error."""
    out = F.raise_error(F.concat(F.lit("heading level out of range: "), F.coalesce(level.cast("string"), F.lit("null"))))
    for k, v in values.items():
        out = F.when(level == k, v).otherwise(out)
    return out


def section_ranges(sections: DataFrame) -> DataFrame:
    """(document_id, ordinal, level, start_page, end_page): a section ends on the page before the next of its level or
    above; of several at one place, the first by page. One running value per level from the end of the document, so a document of many headings needs no array."""
    w = Window.partitionBy("document_id").orderBy(F.desc("ordinal")).rangeBetween(Window.unboundedPreceding, -1)
    pages = F.max("start_page").over(Window.partitionBy("document_id"))
    later = {k: F.min(F.when(F.col("level") <= k, F.struct("ordinal", "start_page"))).over(w) for k in S.HEADING_LEVELS}
    x = sections.withColumn("__pages", pages).select("*", *[v.alias(f"__next{k}") for k, v in later.items()])
    after = _by_level({k: F.col(f"__next{k}") for k in later}, F.col("level"))
    end = F.when(after.isNotNull(), F.greatest(F.col("start_page"), after["start_page"] - 1)).otherwise(F.greatest(F.lit(1), F.col("__pages")))
    return x.select("document_id", "ordinal", "level", "start_page", end.alias("end_page"))


def repaired_levels(sections: DataFrame) -> DataFrame:
    """(document_id, ordinal, level): no level more than one below the one before it, as repaired. Unrolled, the i-th level is
    i plus the least of 1 and all levels up to it, each less its place: a running minimum."""
    w = Window.partitionBy("document_id").orderBy("ordinal", "level")
    x = sections.select("document_id", "ordinal", F.greatest(F.lit(1), "level").alias("level")).withColumn("__i", F.row_number().over(w) - 1)
    low = F.min(F.col("level") - F.col("__i")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return x.select("document_id", F.col("ordinal").cast("bigint").alias("ordinal"), (F.col("__i") + F.least(F.lit(1), low)).cast("int").alias("level"))


def assign_deepest(blocks: DataFrame, ranges: DataFrame) -> DataFrame:
    """Blocks (document_id, block_id, page) with the deepest section over their page; an equi-join on the document and
    the page, sections being spread over the pages they cover."""
    pages = ranges.select("document_id", "ordinal", "level", "start_page", F.explode(F.sequence("start_page", "end_page")).alias("page"))
    best = pages.groupBy("document_id", "page").agg(F.max(F.struct("level", "start_page", "ordinal")).alias("b"))
    return blocks.join(best, ["document_id", "page"], "left").select("document_id", "block_id", "page", F.col("b.ordinal").alias("ordinal"), F.col("b.level").alias("level"))


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """As-of join: each left row with the value of the last right row at or before it. Both are merged in one order and
    the last value carried on, so no pair is ever formed."""
    r = right.select(by, F.col(at).alias("__at"), F.lit(0).alias("__side"), F.struct(F.col(value).alias("v")).alias("__v"), F.lit(None).cast(left.schema["row_id"].dataType).alias("row_id"))
    x = left.select(by, F.col(at).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(r.schema["__v"].dataType).alias("__v"), "row_id")
    w = Window.partitionBy(by).orderBy("__at", "__side", F.col("__v.v")).rowsBetween(Window.unboundedPreceding, 0)
    return r.unionByName(x).withColumn("m", F.last("__v", True).over(w)).where("__side = 1").select("row_id", by, F.col("__at").alias(at), F.col("m.v").alias(value))


def merged_headings(candidates: DataFrame) -> DataFrame:
    """Headings (document_id, page, title, source, confidence) merged by lower-cased title and page: the best one, a
    little surer with more than one source, never over 0.98."""
    g = candidates.groupBy("document_id", "page", F.lower(F.trim("title")).alias("key")).agg(F.max(F.struct("confidence", "title")).alias("b"), F.count_distinct("source").alias("sources"))
    conf = F.when(F.col("sources") > 1, F.least(F.lit(0.98), F.col("b.confidence") + 0.06)).otherwise(F.col("b.confidence"))
    return g.select("document_id", "page", F.col("b.title").alias("title"), F.round(conf, 6).alias("confidence"), "sources")


def parent_by_level(sections: DataFrame) -> DataFrame:
    """(document_id, ordinal, parent_ordinal): the last heading before with a lower level; one running value per level."""
    w = Window.partitionBy("document_id").orderBy("ordinal").rangeBetween(Window.unboundedPreceding, -1)
    above = {k: F.max(F.when(F.col("level") < k, F.col("ordinal"))).over(w) for k in S.HEADING_LEVELS}
    x = sections.select("*", *[v.alias(f"__above{k}") for k, v in above.items()])
    return x.select("document_id", "ordinal", _by_level({k: F.col(f"__above{k}") for k in above}, F.col("level")).alias("parent_ordinal"))
