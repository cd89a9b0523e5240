"""The world model: entities, claims of two graphs, evidence and assets, and what is asked of them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mossbrook.operators.access import permits
from mossbrook.operators.topk import latest
from mossbrook.sources.tables import Table

#: Predicates that link a reified fact to its parts.
FACT_PARTS = ("subject", "predicate", "object", "confidence", "evidence")


@dataclass
class World:
    """A release of the world model as DataFrames."""

    entities: DataFrame
    dictionary: DataFrame
    claims: DataFrame
    evidence: DataFrame
    assets: DataFrame

    def stats(self) -> DataFrame:
        """(part, rows) of every part."""
        parts = [getattr(self, n).agg(F.lit(n).alias("part"), F.count(F.lit(1)).alias("rows")) for n in ("entities", "dictionary", "claims", "evidence", "assets")]
        return reduce(DataFrame.unionByName, parts)


def all_claims(curated: DataFrame, extracted: DataFrame) -> DataFrame:
    """Claims of the curated and the extracted graph, once per claim_id; of equal ids the curated one stays."""
    a, b = curated.withColumn("graph", F.lit("curated")), extracted.withColumn("graph", F.lit("extracted"))
    both = a.unionByName(b, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in ("claim_id", "graph")]
    first = both.groupBy("claim_id").agg(F.min(F.struct("graph", *rest)).alias("r"))
    return first.select("claim_id", "r.*")


def select_facts(claims: DataFrame, subject: str | None = None, predicate: str | None = None, object_: str | None = None, status: str | None = None, least: float = 0.0) -> DataFrame:
    """Claims that equal all that is given, with a confidence (null as 0) of ``least`` or more."""
    wanted = {"subject_id": subject, "predicate": predicate, "object_id": object_, "claim_status": status}
    conditions = [F.col(c) == v for c, v in wanted.items() if v is not None] + [F.coalesce("confidence", F.lit(0.0)) >= least]
    return claims.where(reduce(lambda a, b: a & b, conditions))


def reified(facts: DataFrame, graph: str) -> DataFrame:
    """(g, s, p, o): each fact (fact_id, subject, predicate, object, confidence, evidence) as a node of its own; parts that are null give no quad."""
    parts = F.array(*[F.struct(F.lit(f"fact:{c}").alias("p"), F.col(c).cast("string").alias("o")) for c in FACT_PARTS])
    return facts.select(F.lit(graph).alias("g"), F.col("fact_id").alias("s"), F.explode(parts).alias("x")).select("g", "s", "x.p", "x.o").where(F.col("o").isNotNull())


def append_extracted(table: Table, claims: DataFrame, sources: DataFrame) -> int:
    """Replaces the extracted claims of whole documents: those of ``sources`` (document_id) are taken out, then the new ones written."""
    return table.replace(claims, sources)


def sync(tables: dict[str, Table], parts: dict[str, DataFrame]) -> dict[str, int]:
    """Writes the parts of a world model: curated tables are replaced by key and lose the keys that the new model lacks, the
    extracted graph, which isn't named in ``parts``, stays as it is. Returns the versions."""
    out = {}
    for name, new in parts.items():
        t = tables[name]
        gone = t.read().select(*t.key).distinct().join(new.select(*t.key).distinct(), list(t.key), "left_anti")
        out[name] = t.replace(new, gone)
    return out


def evidence_first(evidence: DataFrame, quoted: bool = True) -> DataFrame:
    """Evidence with its rank: what has a quote first, then by score, then by id. With ``quoted``, what has neither quote nor text is left out."""
    from mossbrook.operators.topk import ranked

    rows = evidence.where((F.coalesce("quote", F.lit("")) != "") | (F.coalesce("text", F.lit("")) != "")) if quoted else evidence
    bare = F.coalesce("quote", F.lit("")) == ""
    return ranked(rows, ["query"], [bare.asc(), F.col("score").desc_nulls_last(), F.col("evidence_id")])


def predicate_text(most: int, open_rank: int, entitled: Sequence[str], known: Sequence[str]) -> str:
    """The licence predicate as SQL for a foreign engine: entitlements that no registered source has are dropped, and a
    source that isn't a plain name is an error, not something to escape."""
    import re

    names = sorted(set(entitled) & set(known))
    for n in names:
        if not re.fullmatch(r"[A-Za-z0-9_.:-]+", n):
            raise ValueError(f"not a source name: {n!r}")
    base = f"license_rank <= {int(most)}"
    if not names:
        return f"{base} AND license_rank <= {int(open_rank)}"
    return f"{base} AND (license_rank <= {int(open_rank)} OR coalesce(source IN ({', '.join(repr(n) for n in names)}), false))"


def known_entitlements(entitled: Sequence[str], sources: DataFrame) -> DataFrame:
    """(source): the entitlements that are registered sources."""
    return sources.select("source").where(F.col("source").isin(*entitled) if entitled else F.lit(False)).distinct()


def prefiltered(postings: DataFrame, chunks: DataFrame, most: int, entitled: Sequence[str] = (), modalities: Sequence[str] = ()) -> DataFrame:
    """Postings of chunks that the caller may see: the graph channel under the conditions of the others, before it ranks."""
    ok = permits(F.col("license_rank"), F.col("source"), most, 1, entitled)
    if modalities:
        ok = ok & F.coalesce(F.col("modality").isin(*modalities), F.lit(False))
    return postings.join(chunks.where(ok).select("chunk_id"), "chunk_id", "left_semi")


def enterprise_id(c: Column, prefix: str) -> Column:
    return F.coalesce(F.startswith(c, F.lit(prefix)) & F.substring(c, len(prefix) + 1, 1 << 30).rlike(r"^[A-Z]+:[A-Za-z0-9_-]+$"), F.lit(False))


def external_id(c: Column, prefix: str) -> Column:
    """A prefix and a local part, and neither an own id nor evidence."""
    return F.coalesce(c.rlike(r"^[A-Za-z][A-Za-z0-9_.]*:\S+$"), F.lit(False)) & ~F.coalesce(F.startswith(c, F.lit(prefix)), F.lit(False)) & evidence_id(c).isNull()


def evidence_id(c: Column) -> Column:
    """The usual ways to cite a source in one form, null for anything else."""
    t = F.trim(c)
    number = F.regexp_extract(t, r"(?i)^pmid[:\s]*(\d+)$", 1)
    code = F.upper(F.regexp_extract(t, r"(?i)^(?:eln:|lims:|patent:)?((?:exp|asy)-[a-z0-9_-]+|(?:us|wo|ep|cn)\d[\w/-]*)$", 1))
    scheme = F.when(F.startswith(code, F.lit("EXP-")), "eln:").when(F.startswith(code, F.lit("ASY-")), "lims:").otherwise("patent:")
    full = F.lower(t).rlike(r"^(pubmed|eln|lims|patent|doc):\S+$")
    return (
        F.when(number != "", F.concat(F.lit("pubmed:"), number))
        .when(code != "", F.concat(scheme, code))
        .when(full, F.concat(F.lower(F.substring_index(t, ":", 1)), F.lit(":"), F.regexp_replace(t, r"^[^:]*:", "")))
    )


def uncleared(components: DataFrame) -> DataFrame:
    """Components that may not ship: without a clearance, or with one that has run out before ``today``."""
    return components.where(~F.coalesce("cleared", F.lit(False)) | F.coalesce(F.col("valid_to") < F.col("today"), F.lit(False)))


def assert_cleared(components: DataFrame) -> DataFrame:
    """The components, or a failure of the job as soon as one of them isn't cleared."""
    bad = ~F.coalesce("cleared", F.lit(False)) | F.coalesce(F.col("valid_to") < F.col("today"), F.lit(False))
    return components.withColumn("component", F.when(bad, F.raise_error(F.concat(F.lit("not cleared: "), F.coalesce("component", F.lit("?"))))).otherwise(F.col("component")))


def narrower(below: DataFrame) -> DataFrame:
    """Descendants (root, node, depth) without the root itself."""
    return below.where(F.col("root") != F.col("node"))


def resolve_keys(rows: DataFrame, key: str, refs: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved, unresolved): the keys that the rows refer to with their ids (ref, id), and those that nothing has."""
    each = rows.select(F.col(key).alias("key"), F.explode(refs).alias("ref")).where(F.col("ref").isNotNull() & (F.trim("ref") != "")).distinct()
    one = ids.groupBy("ref").agg(F.min("id").alias("id"))
    joined = each.join(one, "ref", "left")
    return joined.where(F.col("id").isNotNull()).select("key", "ref", "id"), joined.where(F.col("id").isNull()).select("key", "ref")


def newest(assets: DataFrame) -> DataFrame:
    """Assets once each, the latest arrival."""
    return latest(assets, ["asset_id"], ["at"])
