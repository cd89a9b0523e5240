"""The public operations: eight tools over texts and concepts, ten over the world model, and the golden path.

Every operation takes a DataFrame of many requests and returns a DataFrame, so a thousand questions are one plan. What a caller may see is
decided by one ``Scope``, applied before anything is ranked.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mossbrook import schema as S
from mossbrook.functions import text as X
from mossbrook.operators import access as A
from mossbrook.operators import context as C
from mossbrook.operators import corpus as K
from mossbrook.operators import graph as G
from mossbrook.operators import linking as L
from mossbrook.operators import retrieval as R
from mossbrook.operators import world as W
from mossbrook.operators.topk import top


@dataclass(frozen=True)
class Scope:
    """What a caller may see: tiers up to ``most``, those over ``open_rank`` only of entitled sources."""

    most: int = 1
    open_rank: int = 1
    entitled: tuple[str, ...] = ()

    def permits(self, tier: str = "license_tier", source: str = "source"):
        return A.permits(A.rank_of(F.col(tier)), F.col(source), self.most, self.open_rank, self.entitled)


@dataclass
class Lake:
    """The tables that the operations read.

    concepts: bios_id, preferred_term, terms, external_ids, semtypes; documents: doc_id, text, title, source, license_tier, doc_type;
    tree: the document nodes; linkage: mention, enterprise_id, score; edges: src, predicate, dst; claims: claim_id, subject_id, predicate,
    object_id, claim_status, confidence, evidence_id; assets: asset_id, entity_ids, title, at.
    """

    concepts: DataFrame
    documents: DataFrame
    tree: DataFrame
    linkage: DataFrame
    edges: DataFrame
    claims: DataFrame
    assets: DataFrame
    scope: Scope = Scope()

    # -- shared parts
    @cached_property
    def words(self) -> DataFrame:
        return L.dictionary(self.concepts)

    @cached_property
    def xrefs(self) -> DataFrame:
        return self.concepts.select(F.col("bios_id").alias("concept_id"), F.explode("external_ids").alias("external_id")).distinct()

    @cached_property
    def nodes(self) -> DataFrame:
        return K.nodes(self.tree)

    @cached_property
    def visible(self) -> DataFrame:
        return self.documents.where(self.scope.permits())

    def _by_own_id(self) -> DataFrame:
        return self.linkage.join(self.xrefs.select("concept_id", F.col("external_id").alias("enterprise_id")), "enterprise_id")

    # -- the eight tools
    def normalize_entity(self, mentions: DataFrame) -> DataFrame:
        """(mention, concept_id, stage, confidence) for mentions in any writing."""
        best = L.linkage_best(self.linkage)[0].join(self.xrefs.select("concept_id", F.col("external_id").alias("enterprise_id")), "enterprise_id")
        once = best.groupBy("mention_key").agg(F.min(F.struct("concept_id", "score")).alias("b")).select("mention_key", "b.concept_id", "b.score")
        return L.cascade(mentions, self.xrefs, self.words, once)

    def resolve_alias(self, aliases: DataFrame) -> DataFrame:
        """(mention, concept_id, scope): every concept that has the alias, with its scope."""
        keyed = aliases.select("mention").distinct().withColumn("alias_norm", X.ascii_key(F.col("mention")))
        return keyed.join(self.words, "alias_norm").select("mention", "concept_id", "scope")

    def expand_concept(self, seeds: DataFrame, hops: int = 2) -> DataFrame:
        """(seed, node, hops, weight): the weighted neighbourhood."""
        return G.walk(seeds, self.edges, hops)

    def get_concept(self, ids: DataFrame) -> DataFrame:
        """(concept_id, label, surfaces, external_ids) of concepts, found by own or external id."""
        own = self.concepts.select(F.col("bios_id").alias("concept_id"), F.col("bios_id").alias("id"))
        asked = ids.select("id").distinct().join(own.union(self.xrefs.select("concept_id", "external_id")), "id").select("id", "concept_id").distinct()
        card = self.concepts.groupBy(F.col("bios_id").alias("concept_id")).agg(F.max(F.struct("preferred_term", F.array_sort("terms").alias("terms"), F.array_sort("external_ids").alias("external_ids"))).alias("c"))
        return asked.join(card, "concept_id").select("id", "concept_id", F.col("c.preferred_term").alias("label"), X.surfaces(F.col("c.preferred_term"), F.col("c.terms")).alias("surfaces"), "c.external_ids")

    def search_documents(self, queries: DataFrame, k: int = 10, modalities: Sequence[str] = ()) -> DataFrame:
        """(qid, doc_id, score, rank, source, snippet) of what the caller may see; the filter comes before the ranks."""
        ok = self.visible.where(F.coalesce(F.col("doc_type").isin(*modalities), F.lit(False))) if modalities else self.visible
        hits = R.channel(R.bm25(queries, self.documents, "doc_id", "text", k, ok), "lexical", "doc_id")
        return hits.select("qid", F.col("key").alias("doc_id"), "score", "rank").join(ok.select("doc_id", "source", R.snippet(F.col("title")).alias("snippet")), "doc_id")

    def get_facts(self, **wanted) -> DataFrame:
        """Claims that equal what is given (subject, predicate, object_, status, least)."""
        return W.select_facts(self.claims, **wanted)

    def submit_feedback(self, feedback: DataFrame, table) -> int:
        """Appends verdicts to a keyed table; returns its version. Rows without a key aren't written."""
        return table.append(feedback)

    def restore_context(self, hits: DataFrame, limit: int = S.RESTORE_CHARS) -> DataFrame:
        """(section, node_id, piece): the siblings of hits (node_id) in reading order, as far as the budget goes."""
        at = hits.select("node_id").join(self.nodes.select("node_id", F.col("parent_id").alias("section")), "node_id").select("section").distinct()
        parts = self.nodes.where("length(content) > 0").withColumnRenamed("parent_id", "section").join(at, "section", "left_semi")
        return K.restore(parts, "section", ["sort_order", "node_id"], limit).select("section", "node_id", "piece")

    # -- the ten operations on the world model
    def resolve_entity(self, mentions: DataFrame) -> DataFrame:
        """(mention, canonical_entity, stage, confidence): the own id of what a mention means."""
        own = self.xrefs.where(F.startswith("external_id", F.lit("HMD:"))).groupBy("concept_id").agg(F.min("external_id").alias("canonical_entity"))
        return self.normalize_entity(mentions).join(own, "concept_id", "left").select("mention", "canonical_entity", "stage", "confidence")

    def lookup_concept(self, ids: DataFrame) -> DataFrame:
        """(id, concept_id): concepts of external ids, whatever their letter case."""
        low = self.xrefs.withColumn("key", F.lower("external_id")).groupBy("key").agg(F.min("concept_id").alias("concept_id"))
        return ids.select("id").distinct().withColumn("key", F.lower("id")).join(low, "key", "left").select("id", "concept_id")

    def get_entity(self, ids: DataFrame) -> DataFrame:
        return self.get_concept(ids).select("id", "concept_id", "label")

    def get_relationships(self, entities: DataFrame) -> DataFrame:
        """(entity, predicate, other, outward): the claims of entities in both directions."""
        out = self.claims.select(F.col("subject_id").alias("entity"), "predicate", F.col("object_id").alias("other"), F.lit(True).alias("outward"))
        back = self.claims.select(F.col("object_id").alias("entity"), "predicate", F.col("subject_id").alias("other"), F.lit(False).alias("outward"))
        return out.union(back).where("other is not null").distinct().join(entities.select("entity").distinct(), "entity", "left_semi")

    def find_related_entities(self, entities: DataFrame) -> DataFrame:
        return C.related(self.claims.select(F.col("subject_id").alias("subject"), F.col("object_id").alias("object")), entities)

    def get_entity_evidence(self, entities: DataFrame) -> DataFrame:
        """(entity, evidence_id): nodes that name the entity or that its claims cite."""
        ev = self.nodes.where(F.size("entity_ids") > 0).select(F.col("node_id").alias("evidence_id"), "entity_ids")
        return C.evidence_for(ev, self.claims.select(F.col("subject_id").alias("subject"), "evidence_id"), entities)

    def search_evidence(self, entities: DataFrame, k: int = 5) -> DataFrame:
        """(entity, evidence_id, rank): evidence of entities, longer text first."""
        e = self.get_entity_evidence(entities).join(self.nodes.select(F.col("node_id").alias("evidence_id"), F.length("content").alias("n")), "evidence_id", "left")
        return top(e, ["entity"], [F.col("n").desc_nulls_last(), F.col("evidence_id")], k).select("entity", "evidence_id", "rank")

    def get_entity_assets(self, entities: DataFrame) -> DataFrame:
        """(entity, asset_id): the newest state of the assets that name an entity."""
        a = W.newest(self.assets).select("asset_id", F.explode("entity_ids").alias("entity"))
        return a.join(entities.select("entity").distinct(), "entity", "left_semi").select("entity", "asset_id").distinct()

    def search_assets(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """(qid, asset_id, score): assets by the words of their titles."""
        hits = R.bm25(queries, W.newest(self.assets), "asset_id", "title", k)
        return hits.select("qid", "asset_id", "score")

    def get_entity_context(self, entities: DataFrame) -> DataFrame:
        """(entity, related, evidence, assets, missing): how much is known, and what isn't."""
        return C.context_pack(entities, {"related": self.find_related_entities(entities), "evidence": self.get_entity_evidence(entities), "assets": self.get_entity_assets(entities)})

    # -- composite
    def golden_path(self, mentions: DataFrame, k: int = 5) -> DataFrame:
        """(mention, canonical_entity, related, evidence, assets, documents): from a mention to what is known and written about it; a mention
        that means nothing known has nulls, but its documents are still looked for."""
        resolved = self.resolve_entity(mentions)
        known = resolved.where(F.col("canonical_entity").isNotNull()).select(F.col("canonical_entity").alias("entity")).distinct()
        context = self.get_entity_context(known)
        found = self.search_documents(mentions.select(F.col("mention").alias("qid"), F.col("mention").alias("query")).distinct(), k)
        n = found.groupBy(F.col("qid").alias("mention")).agg(F.count(F.lit(1)).alias("documents"))
        return (
            resolved.join(context, resolved["canonical_entity"] == context["entity"], "left").join(n, "mention", "left")
            .select("mention", "canonical_entity", "related", "evidence", "assets", F.coalesce("documents", F.lit(0)).alias("documents"))
        )
