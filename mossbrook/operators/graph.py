"""Hierarchies, weighted neighbourhoods, components and quads."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mossbrook import schema as S
from mossbrook.session import cut_lineage


def decay_of(predicate: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in S.RELATION_DECAY.items() for x in kv]), predicate), F.lit(S.OTHER_DECAY))


def walk(seeds: DataFrame, edges: DataFrame, hops: int = 2, cross: Sequence[str] = ("has_target", "targeted_by", "treats", "treated_by"), prune: float = S.PRUNE_BELOW) -> DataFrame:
    """(seed, node, hops, weight): up to ``hops`` steps along edges (src, predicate, dst), the product of the decays, at
    most one step that leaves the type, weights under ``prune`` dropped, the best path of each node.

    Each step is a join on the frontier, reduced to the best row per node and kind of path before the next one.
    """
    e = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).groupBy("src", "dst", F.col("predicate").isin(*cross).cast("int").alias("x")).agg(F.max(decay_of(F.col("predicate"))).alias("d"))
    frontier = seeds.select("seed").distinct().select("seed", F.col("seed").alias("node"), F.lit(0).alias("crossed"), F.lit(1.0).alias("weight"))
    found = None
    for k in range(1, hops + 1):
        step = (
            frontier.join(e, F.col("node") == F.col("src"))
            .where((F.col("crossed") + F.col("x") <= 1) & (F.col("dst") != F.col("seed")))
            .select("seed", F.col("dst").alias("node"), (F.col("crossed") + F.col("x")).alias("crossed"), (F.col("weight") * F.col("d")).alias("weight"))
            .where(F.col("weight") >= prune)
            .groupBy("seed", "node", "crossed")
            .agg(F.max("weight").alias("weight"))
        )
        frontier = step
        at = step.select("seed", "node", F.lit(k).alias("hops"), "weight")
        found = at if found is None else found.unionAll(at)
    best = found.groupBy("seed", "node").agg(F.max(F.struct("weight", (-F.col("hops")).alias("h"))).alias("b"))
    return best.select("seed", "node", (-F.col("b.h")).alias("hops"), F.round("b.weight", 6).alias("weight"))


def descendants(roots: DataFrame, edges: DataFrame, levels: int | None = None) -> DataFrame:
    """(root, node, depth) below each root along (parent, child); the shortest depth; to ``levels`` at most, if given.

    Goes level by level and stops when a level adds nothing, so cycles end; the frontier alone is joined each time.
    """
    e = edges.select(F.col("parent").alias("p"), F.col("child").alias("c")).where(F.col("p").isNotNull() & F.col("c").isNotNull()).distinct()
    seen = roots.select("root").distinct().select("root", F.col("root").alias("node"), F.lit(0).alias("depth"))
    frontier = seen
    for k in itertools.count(1) if levels is None else range(1, levels + 1):
        step = frontier.join(e, F.col("node") == F.col("p")).select("root", F.col("c").alias("node"), F.lit(k).alias("depth")).distinct()
        frontier = cut_lineage(step.join(seen, ["root", "node"], "left_anti").select("root", "node", "depth"))
        if frontier.isEmpty():
            break
        seen = cut_lineage(seen.unionAll(frontier)) if k % 4 == 0 else seen.unionAll(frontier)
    return seen


def expansion(found: DataFrame) -> DataFrame:
    """Adds the weight of an expansion: 0.85 per level."""
    return found.withColumn("weight", F.round(F.pow(F.lit(S.DEPTH_DECAY), F.col("depth")), 6))


def on_cycle(edges: DataFrame, levels: int | None = None) -> DataFrame:
    """(node) of those that reach themselves along (parent, child), by ``levels`` steps and one more at most, if given."""
    starts = edges.select(F.col("parent").alias("root")).distinct()
    below = descendants(starts, edges, levels)
    back = below.join(edges.select(F.col("parent").alias("node"), F.col("child").alias("c")), "node").where(F.col("c") == F.col("root"))
    return back.select(F.col("root").alias("node")).distinct()


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node of each connected component of (a, b).

    Alternates large-star and small-star steps, which need a logarithmic number of rounds even on long chains, and
    pre-aggregates the minimum, so that a node with very many links is no hot group. The state is checkpointed. Goes on until nothing changes and raises if
    ``rounds`` weren't enough, which a chain of 2 ** rounds nodes would take.
    """
    links = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    g = cut_lineage(links.where(F.col("a") != F.col("b")).select("a", "b").distinct())
    for _ in range(rounds):
        both = g.unionAll(g.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        floor = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(floor, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).unionAll(floor.select("a", F.col("m").alias("b"))).distinct()
        new = cut_lineage(small)
        if new.exceptAll(g).isEmpty() and g.exceptAll(new).isEmpty():
            break
        g = new
    else:
        raise RuntimeError(f"components not found within {rounds} rounds")
    lead = g.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return nodes.join(lead, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def cliques(mappings: DataFrame, priority: Sequence[str]) -> DataFrame:
    """(component, primary, members, conflicts) over exact matches of confidence 0.9 or more: the primary is the first by
    prefix priority, then by name; a prefix with several members is a conflict."""
    ok = mappings.where((F.col("predicate") == "exact_match") & (F.col("confidence") >= S.CLIQUE_CONFIDENCE))
    c = components(ok.select(F.col("subject").alias("a"), F.col("object").alias("b")))
    prefix = F.split("node", ":")[0]
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for i, p in enumerate(priority) for x in (p, i)]), prefix), F.lit(len(priority)))
    per = c.withColumn("prefix", prefix).groupBy("component", "prefix").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct(rank.alias("r"), F.col("node"))).alias("first"))
    return per.groupBy("component").agg(F.min("first").alias("first"), F.sum("k").alias("members"), F.count_if(F.col("k") > 1).alias("conflicts")).select(F.col("first.node").alias("primary"), "members", "conflicts")


def quads(g: str, df: DataFrame, subject: str, triples: dict[str, str]) -> DataFrame:
    """(g, s, p, o) of a table: one quad per column named in ``triples`` (predicate to column) that isn't null."""
    pairs = F.array(*[F.struct(F.lit(p).alias("p"), F.col(c).cast("string").alias("o")) for p, c in triples.items()])
    return df.select(F.lit(g).alias("g"), F.col(subject).cast("string").alias("s"), F.explode(pairs).alias("t")).select("g", "s", "t.p", "t.o").where(F.col("o").isNotNull())


def pattern(store: DataFrame, predicates: Sequence[str], subject: str, object_: str, graphs: Sequence[str] | None = None) -> DataFrame:
    """The bindings of one triple pattern: alternatives of predicates, in the named graphs only."""
    q = store.where(F.col("p").isin(*predicates))
    if graphs is not None:
        q = q.where(F.col("g").isin(*graphs))
    return q.select(F.col("s").alias(subject), F.col("o").alias(object_)).distinct()


def delete_where(store: DataFrame, g: str, subjects: DataFrame) -> DataFrame:
    """The store without the quads of graph g about the subjects (s)."""
    gone = subjects.select("s").distinct().withColumn("g", F.lit(g))
    return store.join(gone, ["g", "s"], "left_anti")
