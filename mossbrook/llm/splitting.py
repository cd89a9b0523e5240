"""Cutting oversized text at natural boundaries, with an overlap between consecutive pieces.

A piece that ends at boundary e, after a cut at s, is ``text[s - overlap : e]``. The boundaries of all texts are one table, each with its
farthest legal successor (of the strongest kind within reach). That table is joined with itself: after k squarings it leads 2**k pieces
on, and what is reached from the beginnings doubles with it, so all cuts of all texts are found in log2(pieces) joins, and a text of very
many pieces is spread over tasks like any other rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mossbrook.session import cut_lineage

# Abbreviations that don't end a sentence.
ABBREVIATIONS = r"(?i:(?<!\bcf)(?<!\bca)(?<!\bno)(?<!\bvs)(?<!\bsect)(?<!\bfig)(?<!\betc)(?<!\bdr)(?<!\be\.g)(?<!\bi\.e)(?<!\bresp)(?<!\bapprox))"
#: From the strongest boundary to the weakest; a cut lies at the end of a match.
LEVELS = (
    re.compile(r"\n[ \t]*\n\s*"),
    re.compile(r"\n"),
    re.compile(ABBREVIATIONS + r"[.!?]+[\"')\]]*\s+(?=[\"'(\[]?[^\Wa-z_])|[。！？]+[”’」』）]*\s*"),
    re.compile(r"[,;:]\s+|[，；：、]\s*"),
    re.compile(r"\s+"),
)


def boundaries(text: str, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where the text may be cut and their levels (5 strongest, 0 none natural), ends included.

    Weaker boundaries are looked for only in gaps of over half a step between stronger ones, and places within a
    run of letters only in gaps that no legal piece spans; a hard cut never parts a letter from its accents.
    """
    n = len(text)
    found = {0: len(LEVELS) + 1, n: len(LEVELS) + 1}
    for rank, pattern in enumerate(LEVELS):
        at = sorted(found)
        for lo, hi in zip(at, at[1:]):
            if hi - lo > step // 2 or rank < 2:
                for m in pattern.finditer(text, lo, hi):
                    if lo < m.end() < hi:
                        found.setdefault(m.end(), len(LEVELS) - rank)
    return np.array(sorted(found)), np.array([found[p] for p in sorted(found)])


def _hard(text: str, at: int, least: int) -> int:
    while at > least + 1 and (unicodedata.combining(text[at]) or text[at] in "‍️" or text[at - 1] == "‍"):
        at -= 1
    return at


def successors(text: str, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, index of each one's successor): the farthest boundary of the strongest level found in the second
    half of what is legal, else the farthest legal one at all, else a hard cut. The end is its own successor."""
    overlap = max(0, min(overlap, limit - 1))
    step, n = limit - overlap, len(text)
    at, level = boundaries(text, step)
    extra: list[int] = []
    for i, (lo, hi) in enumerate(zip(at, at[1:])):
        if i == 0 or hi - lo > step:
            p = int(lo)
            reach = limit if p == 0 else step
            while p + reach < hi:
                p = _hard(text, p + reach, p)
                extra.append(p)
                reach = step
    first_far = at[(at >= max(overlap, 1)) & (at <= limit)]
    if not len(first_far) and limit < n:
        p, reach = 0, limit
        while p + reach < n:
            p = _hard(text, p + reach, p)
            extra.append(p)
            reach = step
    known = set(at.tolist())
    extra = [p for p in dict.fromkeys(extra) if p not in known]
    if extra:
        at, level = np.concatenate([at, extra]), np.concatenate([level, np.zeros(len(extra), int)])
        order = np.argsort(at, kind="stable")
        at, level = at[order], level[order]
    reach = np.where(at == 0, limit, step)
    last = np.searchsorted(at, at + reach, side="right") - 1
    mid = np.searchsorted(at, np.maximum(at + reach // 2, np.where(at == 0, overlap, 0)), side="left")
    mid = np.maximum(mid, np.arange(len(at)) + 1)
    out = np.empty(len(at), int)
    end = len(at) - 1
    for i in range(len(at)):
        lo, hi = int(mid[i]), int(last[i])
        if i == end or hi == end:
            out[i] = end
        elif lo <= hi and level[lo : hi + 1].max() > 0:
            window = level[lo : hi + 1]
            out[i] = lo + int(np.flatnonzero(window == window.max())[-1])
        else:
            legal = np.arange(i + 1, hi + 1)
            if at[i] == 0:
                legal = legal[at[legal] >= overlap]
            natural = legal[level[legal] > 0]
            out[i] = int(natural[-1]) if len(natural) else int(legal[-1])
    return at, out


TABLE = "key string, place int, at int, next int"


def successor_table(texts: DataFrame) -> DataFrame:
    """(key, place, at, next): every boundary of every text (key, content, max_chars, overlap_chars) with the place of its successor."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, text, most, overlap in zip(pdf["key"], pdf["content"], pdf["max_chars"], pdf["overlap_chars"]):
                at, following = successors(text, int(most), int(overlap))
                yield pd.DataFrame({"key": key, "place": np.arange(len(at), dtype=np.int32), "at": at.astype(np.int32), "next": following.astype(np.int32)})

    return texts.select("key", "content", "max_chars", "overlap_chars").mapInPandas(run, TABLE)


def all_cuts(table: DataFrame) -> DataFrame:
    """(key, place, at) of every cut of every text, beginnings and ends included, by pointer doubling over the table of successors."""
    table = cut_lineage(table)
    jump = table.select("key", "place", "next")
    reached = table.where("place = 0").select("key", "place")
    n = reached.count()
    while n:
        on = reached.join(jump, ["key", "place"]).select("key", F.col("next").alias("place"))
        reached = cut_lineage(reached.unionAll(on).distinct())
        if n == (n := reached.count()):
            break
        further = jump.select("key", F.col("place").alias("next"), F.col("next").alias("far"))
        jump = cut_lineage(jump.join(further, ["key", "next"]).select("key", "place", F.col("far").alias("next")))
    return table.join(reached, ["key", "place"], "left_semi").select("key", "place", "at")


def split_oversized(nodes: DataFrame, limits: DataFrame) -> DataFrame:
    """Ordered pieces of every node whose content, in code points, exceeds the limit of its kind.

    Repeats of a node (equal id, kind, path and content) come out once. Kinds without a limit, null or not positive
    limits, null and short contents give no pieces. Of several limits of a kind the smallest holds; a null overlap
    is 0, one that isn't below the limit is cut to the limit less one. Extra columns are ignored.
    """
    rule = (
        limits.where(F.col("node_kind").isNotNull() & (F.col("max_chars") > 0))
        .groupBy("node_kind")
        .agg(F.min(F.struct("max_chars", F.coalesce("overlap_chars", F.lit(0)).alias("overlap_chars"))).alias("rule"))
        .select("node_kind", "rule.max_chars", "rule.overlap_chars")
    )
    big = (
        nodes.select("node_id", "document_id", "node_kind", "section_path", "content")
        .join(rule, "node_kind")
        .where(F.length("content") > F.col("max_chars"))
        .dropDuplicates(["node_id", "document_id", "node_kind", "section_path", "content"])
    )
    identity = ["node_id", "document_id", "node_kind", "section_path", "content"]
    big = cut_lineage(big.withColumn("key", F.md5(F.to_json(F.struct(*identity)))))
    cuts = all_cuts(successor_table(big)).groupBy("key").agg(F.array_sort(F.collect_list("at")).alias("cuts"))
    overlap = F.greatest(F.lit(0), F.least("overlap_chars", F.col("max_chars") - 1))
    pairs = F.zip_with(F.slice("cuts", F.lit(1), F.size("cuts") - 1), F.slice("cuts", F.lit(2), F.size("cuts") - 1), lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi")))
    each = big.join(cuts, "key").select(*identity, overlap.alias("overlap"), (F.size("cuts") - 1).alias("piece_count"), F.posexplode(pairs).alias("k", "p"))
    start = F.when(F.col("k") == 0, F.lit(0)).otherwise(F.col("p.lo") - F.col("overlap"))
    return each.select(
        "node_id", "document_id", "node_kind", "section_path", (F.col("k") + 1).alias("piece_no"), "piece_count", start.alias("start_char"), F.col("p.hi").alias("end_char"),
        F.substring("content", start + 1, F.col("p.hi") - start).alias("content"),
    )
