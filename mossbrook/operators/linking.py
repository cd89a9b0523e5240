"""From mentions to identifiers: dictionary match, variants, n-gram similarity, cascade, linkage, disambiguation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mossbrook import schema as S
from mossbrook.functions import text as X
from mossbrook.session import cut_lineage


def dictionary(concepts: DataFrame) -> DataFrame:
    """(alias_norm, concept_id, scope) of every term: the preferred one and its equals are EXACT, others NARROW."""
    t = concepts.select("bios_id", "preferred_term", F.explode("terms").alias("term")).where(F.trim("term") != "")
    t = t.select(X.ascii_key(F.col("term")).alias("alias_norm"), F.col("bios_id").alias("concept_id"), F.when(F.col("term") == F.col("preferred_term"), "EXACT").otherwise("NARROW").alias("scope"))
    return t.where(F.col("alias_norm") != "").groupBy("alias_norm", "concept_id").agg(F.min("scope").alias("scope"))


def best_per_concept(hits: DataFrame, key: list[str]) -> DataFrame:
    """The highest score of each concept, (key..., concept_id, score)."""
    return hits.groupBy(*key, "concept_id").agg(F.max("score").alias("score"))


def match(mentions: DataFrame, words: DataFrame) -> DataFrame:
    """Mentions (mention, alias_norm) with every concept of that key; EXACT scores 1, NARROW 0.8, BROAD nothing."""
    score = F.when(F.col("scope") == "EXACT", 1.0).otherwise(0.8)
    return best_per_concept(mentions.join(words.where("scope <> 'BROAD'"), "alias_norm").withColumn("score", score), ["mention"])


def match_variants(mentions: DataFrame, words: DataFrame) -> DataFrame:
    """As ``match`` over the code and rule variants of the mentions, a little lower."""
    v = mentions.select("mention", F.explode(F.concat(X.code_variants(F.col("mention")), X.rule_variants(F.col("mention")))).alias("v"))
    hits = match(v.select("mention", X.ascii_key(F.col("v")).alias("alias_norm")).distinct(), words)
    return hits.withColumn("score", F.round(F.col("score") * S.RULE_FACTOR, 6))


def _heavy(weights: DataFrame, key: str, floor: float) -> DataFrame:
    """Of (key, gram, w) vectors of length 1, the rarest grams without which the rest is shorter than ``floor``."""
    rest = Window.partitionBy(key).orderBy("rarity", "gram").rowsBetween(Window.unboundedPreceding, 0)
    return weights.withColumn("rest", F.sum(F.col("w") * F.col("w")).over(rest)).where(F.col("rest") >= floor * floor - 1e-9).select(key, "gram")


def gram_similarity(left: DataFrame, right: DataFrame, floor: float = S.NGRAM_FLOOR, k: int = 1) -> DataFrame:
    """TF-IDF cosine over padded trigrams, (mention, alias, score) of the k best at or over the floor.

    Weight c*ln(1 + N/(1 + df)), df over the distinct aliases of the right side. With grams in one order, rarest first, two vectors at
    the floor or over it share a gram among the rarest of both: what comes after in either is shorter than the floor. Only these
    rare grams are joined, so a gram that most names hold forms no pairs, and nothing is lost; the pairs found are verified in full.
    """
    r = right.select("alias").distinct()
    total = r.agg(F.count(F.lit(1)).cast("double").alias("total"))
    rg = r.select("alias", F.explode(X.grams(F.col("alias"))).alias("gram")).groupBy("alias", "gram").agg(F.count(F.lit(1)).alias("c"))
    idf = rg.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(total)).select("gram", F.log(1 + F.col("total") / (1 + F.col("df"))).alias("idf"))
    rw = rg.join(idf, "gram").select("alias", "gram", (F.col("c") * F.col("idf")).alias("w"), F.col("idf").alias("rarity"))
    lg = left.select("mention").distinct().select("mention", F.explode(X.grams(F.col("mention"))).alias("gram")).groupBy("mention", "gram").agg(F.count(F.lit(1)).alias("c"))
    known = F.coalesce("idf", F.log(1 + F.col("total")))
    lw = lg.join(idf, "gram", "left").join(F.broadcast(total)).select("mention", "gram", (F.col("c") * known).alias("w"), known.alias("rarity"))
    rw, lw = (cut_lineage(x.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key))))) for x, key in ((rw, "alias"), (lw, "mention")))
    pairs = _heavy(lw, "mention", floor).join(_heavy(rw, "alias", floor), "gram").select("mention", "alias").distinct()
    dots = pairs.join(lw.select("mention", "gram", "w"), "mention").join(rw.select("alias", "gram", F.col("w").alias("v")), ["alias", "gram"])
    s = dots.groupBy("mention", "alias").agg(F.round(F.sum(F.col("w") * F.col("v")), 6).alias("score")).where(F.col("score") >= floor)
    w = Window.partitionBy("mention").orderBy(F.col("score").desc(), "alias")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("mention", "alias", "score")


def linkage_best(pairs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(best, ambiguous) linkage per lower-cased mention: the ids at the highest score at or over the threshold; with
    more than one distinct id the mention is ambiguous and has no best."""
    ok = pairs.where((F.col("score") >= threshold) & F.col("enterprise_id").isNotNull()).select(X.mention_key(F.col("mention")).alias("mention_key"), "enterprise_id", "score").where(F.col("mention_key") != "")
    top = ok.groupBy("mention_key").agg(F.max("score").alias("score"))
    at = ok.join(top, ["mention_key", "score"]).groupBy("mention_key", "score").agg(F.count_distinct("enterprise_id").alias("ids"), F.min("enterprise_id").alias("enterprise_id"))
    return at.where("ids = 1").drop("ids"), at.where("ids > 1").drop("enterprise_id")


def cascade(mentions: DataFrame, xrefs: DataFrame, words: DataFrame, linkage: DataFrame) -> DataFrame:
    """(mention, concept_id, stage, confidence): own id, then cross-reference, dictionary, linkage; else unmapped.

    A stage with several concepts gives the smallest id with its lower confidence.
    """
    own = xrefs.select("concept_id").distinct().select(F.col("concept_id").alias("own"), F.col("concept_id").alias("mention"))
    x = xrefs.groupBy(F.col("external_id").alias("mention")).agg(F.min("concept_id").alias("x"), F.count_distinct("concept_id").alias("xn"))
    a = words.where("scope <> 'BROAD'").groupBy("alias_norm").agg(F.min("concept_id").alias("a"), F.count_distinct("concept_id").alias("an"))
    j = (
        mentions.select("mention").distinct().withColumn("alias_norm", X.ascii_key(F.col("mention"))).withColumn("mention_key", X.mention_key(F.col("mention")))
        .join(own, "mention", "left").join(x, "mention", "left").join(a, "alias_norm", "left")
        .join(linkage.select("mention_key", F.col("concept_id").alias("l"), "score"), "mention_key", "left")
    )
    stage = F.when(F.col("own").isNotNull(), "own_id").when(F.col("x").isNotNull(), "xref").when(F.col("a").isNotNull(), "alias").when(F.col("l").isNotNull(), "linkage").otherwise("unmapped")
    conf = (
        F.when(F.col("own").isNotNull(), 1.0).when(F.col("xn") == 1, 1.0).when(F.col("x").isNotNull(), 0.75).when(F.col("an") == 1, 1.0).when(F.col("a").isNotNull(), 0.7)
        .when(F.col("l").isNotNull(), F.least(F.lit(0.95), F.greatest(F.lit(0.5), F.col("score")))).otherwise(0.0)
    )
    return j.select("mention", F.coalesce("own", "x", "a", "l").alias("concept_id"), stage.alias("stage"), conf.alias("confidence"))


def margins(hits: DataFrame, key: str = "mention", margin: float = S.AMBIGUITY_MARGIN) -> DataFrame:
    """The best concept of each mention, its lead over the runner-up, and whether that is too small to tell."""
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), "concept_id")
    r = hits.withColumn("rank", F.row_number().over(w)).withColumn("next", F.lead("score").over(w)).where("rank = 1")
    lead = F.round(F.col("score") - F.coalesce("next", F.lit(0.0)), 6)
    return r.select(key, "concept_id", "score", lead.alias("margin"), (F.col("next").isNotNull() & (lead < margin)).alias("ambiguous"))


def disambiguate(context: Column, senses: list[tuple[str, float, list[str]]], single: float = 3.0, multi: float = 8.0, best: int = 3) -> Column:
    """Struct(concept_id, confidence): prior times the likelihood ratio of the best three cues that the context holds,
    normalised over the senses; without any cue the confidence is capped, so that a prior alone doesn't decide."""
    low = F.lower(F.coalesce(context, F.lit("")))
    scored, hits = [], []
    for concept, prior, cues in senses:
        ratios = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(c.lower())), F.lit(multi if " " in c else single)) for c in cues]))
        top = F.slice(F.sort_array(ratios, False), 1, best)
        weight = F.aggregate(top, F.lit(float(prior)), lambda acc, r: acc * r)
        scored.append(F.struct(weight.alias("w"), F.lit(concept).alias("concept_id")))
        hits.append(F.size(ratios))
    every = F.array(*scored)
    total = F.aggregate(every, F.lit(0.0), lambda acc, s: acc + s["w"])
    win = F.array_max(every)
    share = win["w"] / total
    seen = sum(hits[1:], hits[0]) > 0
    return F.struct(win["concept_id"].alias("concept_id"), F.round(F.when(seen, share).otherwise(F.least(share, F.lit(S.PRIOR_CAP))), 6).alias("confidence"))
