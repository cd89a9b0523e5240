"""Evaluation passages inside training documents: n-gram seeds, then Smith-Waterman alignment.

A passage with at most one word in ten altered over ``MIN_WORDS`` words or more keeps at least ``MIN_SEEDS`` of its
5-grams (each altered word spoils five), and at least ``NEAR_SEEDS`` of them within ``NEAR_WORDS`` words; both counts
are exact consequences of the definition, so filtering by them loses nothing. Texts are joined to passages by rare seeds only: put the
``MIN_SEEDS`` - 1 most frequent of a passage aside, and a leak still shares one of the others. Seeds are looked up in a bitmap of
fixed size first, so what is broadcast doesn't grow with the items; the exact join on the seed's hash follows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mossbrook.llm.lookalike import one_form
from mossbrook.session import cut_lineage

GRAM = 5
MIN_WORDS = 25
MAX_ALTERED = 0.1
MIN_SEEDS = 11
NEAR_SEEDS, NEAR_WORDS = 8, 36
BITS = 23
SALTS = 16
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_HAN = re.compile(r"([぀-ヿ㐀-鿿])")
_MARKS = re.compile(r"[\W_]+")
_CACHE: dict[str, int] = {}


def words(text: str) -> list[str]:
    """Words without case, punctuation and the characters a letter is written with; a Han character is a word."""
    text = one_form(text, True) or ""
    if not text.isascii():
        text = _HAN.sub(r" \1 ", text)
    return [w if w.isalnum() else v for w in text.split() if w.isalnum() or (v := _MARKS.sub("", w))]


def _hashes(ws: list[str]) -> np.ndarray:
    if len(_CACHE) > 1_000_000:
        _CACHE.clear()
    out = np.empty(len(ws), np.uint64)
    get = _CACHE.get
    for i, w in enumerate(ws):
        h = get(w)
        if h is None:
            h = _CACHE[w] = xxhash.xxh64_intdigest(w)
        out[i] = h
    return out


def grams(h: np.ndarray) -> np.ndarray:
    """Hashes of the runs of ``GRAM`` words, by the first word."""
    n = len(h) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(GRAM):
        out = out * MULTIPLIER + h[k : k + n]
    return out ^ (out >> np.uint64(29))


def _bit(g: np.ndarray) -> np.ndarray:
    return (g >> np.uint64(64 - BITS)).astype(np.int64)


def passages(items: DataFrame) -> DataFrame:
    """(passage, words, item_ids): items with an equal passage, in words, are one. The question after the last new
    line isn't part of the passage; an item without a new line is all passage. Fewer than 25 words can't leak."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else words(t.rstrip().rpartition("\n")[0] or t))

    return (
        items.where(F.col("text").isNotNull() & F.col("item_id").isNotNull())
        .select("item_id", split("text").alias("words"))
        .where(F.size("words") >= MIN_WORDS)
        .groupBy("words")
        .agg(F.collect_set("item_id").alias("item_ids"))
        .withColumn("passage", F.xxhash64("words"))
    )


def seeds(found: DataFrame) -> DataFrame:
    """(passage, place, gram) of every run of five words of the passages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, i, g) for p, ws in zip(pdf["passage"], pdf["words"]) for i, g in enumerate(grams(_hashes(list(ws))).view(np.int64))]
            yield pd.DataFrame(rows, columns=["passage", "place", "gram"])

    return found.select("passage", "words").mapInPandas(run, "passage long, place int, gram long")


def _bitmap(seed: DataFrame) -> np.ndarray:
    """Bits of all seeds, 2**BITS of them whatever the number of items."""
    bits = seed.select(F.shiftrightunsigned("gram", 64 - BITS).alias("bit")).distinct()
    packed = bits.groupBy(F.shiftright("bit", 3).alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, cast(bit & 7 as int))")).alias("v"))
    out = np.zeros(2 ** (BITS - 3), np.uint8)
    got = packed.toPandas()
    out[got["byte"].to_numpy(np.int64)] = got["v"].to_numpy(np.uint8)
    return out


def seeded_documents(docs: DataFrame, seed: DataFrame) -> DataFrame:
    """(doc_id, words, hits) of the documents that hold enough possible seeds close together."""
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(seed))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bitmap = shared.value
        for pdf in batches:
            ids, texts, hits = [], [], []
            lists = [words(t) for t in pdf["text"]]
            flat = grams(_hashes([w for ws in lists for w in ws]))
            b = _bit(flat)
            ok = (bitmap[b >> 3] >> (b & 7).astype(np.uint8)) & 1
            at = np.flatnonzero(ok)
            start = 0
            for doc, ws in zip(pdf["doc_id"], lists):
                lo, hi = np.searchsorted(at, [start, start + max(0, len(ws) - GRAM + 1)])
                mine = at[lo:hi]
                if len(mine) >= MIN_SEEDS and (mine[NEAR_SEEDS - 1 :] - mine[: len(mine) - NEAR_SEEDS + 1]).min() < NEAR_WORDS:
                    ids.append(doc)
                    texts.append(ws)
                    hits.append([{"gram": g, "at": a} for g, a in zip(flat[mine].view(np.int64), mine - start)])
                start += len(ws)
            yield pd.DataFrame({"doc_id": pd.Series(ids, dtype="int64"), "words": pd.Series(texts, dtype=object), "hits": pd.Series(hits, dtype=object)})

    return (
        docs.where(F.col("text").isNotNull())
        .select("doc_id", "text")
        .mapInPandas(run, "doc_id long, words array<string>, hits array<struct<gram:long,at:int>>")
    )


def align(a: np.ndarray, b: np.ndarray, used: dict[int, list[int]] | None = None) -> tuple[int, int, int, int, int]:
    """Smith-Waterman (match 2, altered or missing or added word -2) of passage a in text b.

    Of the best alignment, the longest stretch with at most ``MAX_ALTERED`` of its passage words altered:
    (words of the passage, altered, first in a, first in b, score). Equal words in ``used``, places in b by place in a,
    don't match again; those of the alignment are added."""
    n, m = len(a), len(b)
    if not n or not m:
        return 0, 0, 0, 0, 0
    table = np.zeros((n + 1, m + 1), np.int32)
    slope = 2 * np.arange(m + 1, dtype=np.int32)
    for i in range(1, n + 1):
        row = table[i - 1] - 2
        equal = b == a[i - 1]
        if used and i - 1 in used:
            equal[used[i - 1]] = False
        row[1:] = np.maximum(row[1:], table[i - 1][:-1] + np.where(equal, 2, -2))
        row = np.maximum(row, 0)
        table[i] = np.maximum.accumulate(row + slope) - slope
    i, j = np.unravel_index(int(table.argmax()), table.shape)
    score = int(table[i, j])
    ops: list[tuple[int, int, int, int]] = []  # words of a, altered, place in a, place in b
    while table[i, j] > 0:
        same = i and j and a[i - 1] == b[j - 1] and not (used and j - 1 in used.get(i - 1, ()))
        if i and j and table[i, j] == table[i - 1, j - 1] + (2 if same else -2):
            i, j = i - 1, j - 1
            ops.append((1, int(not same), i, j))
        elif i and table[i, j] == table[i - 1, j] - 2:
            i -= 1
            ops.append((1, 1, i, j))
        else:
            j -= 1
            ops.append((0, 1, i, j))
    ops.reverse()
    if used is not None:
        for one, bad, at_a, at_b in ops:
            if one and not bad:
                used.setdefault(int(at_a), []).append(int(at_b))
    best = (0, 0, 0, 0, score)
    if ops:
        c = np.cumsum([[0, 0]] + [o[:2] for o in ops], axis=0)
        for lo in range(len(ops)):
            if ops[lo][1]:
                continue
            span, bad = c[lo + 1 :, 0] - c[lo, 0], c[lo + 1 :, 1] - c[lo, 1]
            fine = np.flatnonzero(bad <= MAX_ALTERED * span)
            if len(fine) and span[fine[-1]] > best[0]:
                best = (int(span[fine[-1]]), int(bad[fine[-1]]), ops[lo][2], ops[lo][3], score)
    return best


def longest(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, int, int]:
    """As ``align``, the longest stretch of all alignments, not of the best one only: aligned again without the pairs of words
    of those before, until a longer stretch can't be left, as one of n words scores (2 - 4 * MAX_ALTERED) * n at least."""
    used: dict[int, list[int]] = {}
    best = (0, 0, 0, 0, 0)
    while True:
        got = align(a, b, used)
        best = max(best, got, key=lambda x: (x[0], x[4]))
        if best[0] == len(a) or got[4] < (2 - 4 * MAX_ALTERED) * max(best[0] + 1, MIN_WORDS):
            return best


def regions(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of text b that may hold a leak of passage a: around its seeds, parted where two seeds are so far from each other
    that no leak spans both. None if fewer than ``MIN_SEEDS`` places of the passage have their seed in the text."""
    ga, gb = grams(a), grams(b)
    if np.isin(ga, gb).sum() < MIN_SEEDS:
        return []
    at = np.flatnonzero(np.isin(gb, ga))
    margin = 2 * len(a)
    cut = np.flatnonzero(np.diff(at) > 2 * margin) + 1
    return [(max(0, int(part[0]) - margin), int(part[-1]) + GRAM + margin) for part in np.split(at, cut) if len(part) >= NEAR_SEEDS]


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            a, b = _hashes(list(r.passage_words)), _hashes(list(r.words))
            for lo, hi in regions(a, b):
                span, altered, at_a, at_b, score = longest(a, b[lo:hi])
                rows.append((r.doc_id, r.passage, span, altered, at_a, at_b + lo, score))
        yield pd.DataFrame(rows, columns=["doc_id", "passage", "span", "altered", "passage_at", "doc_at", "score"])


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, span, altered, passage_at, doc_at, score): every document with every item it leaks.

    Null texts and ids hold and leak nothing; repeated doc_ids count once for each text and come out once by item.
    """
    found = cut_lineage(passages(items))
    seed = cut_lineage(seeds(found))
    held = cut_lineage(seeded_documents(docs, seed))
    hits = held.select("doc_id", F.xxhash64("words").alias("text_key"), F.explode("hits.gram").alias("gram")).distinct()
    # A leak has MIN_SEEDS places of its passage or more, so one at least is left when the MIN_SEEDS - 1 most frequent are put aside.
    often = hits.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("passage").orderBy(F.coalesce("n", F.lit(0)).desc(), "place"))
    rare = seed.join(often, "gram", "left").withColumn("order", place).where(F.col("order") >= MIN_SEEDS).select("passage", "gram").distinct()
    spread = rare.select("*", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    pairs = hits.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(SALTS)).cast("int")).join(spread, ["gram", "salt"]).select("doc_id", "text_key", "passage").distinct()
    texts = held.select("doc_id", F.xxhash64("words").alias("text_key"), "words").dropDuplicates(["doc_id", "text_key"])
    checked = (
        pairs.join(texts, ["doc_id", "text_key"])
        .join(found.select("passage", F.col("words").alias("passage_words")), "passage")
        .select("doc_id", "passage", "words", "passage_words")
        .mapInPandas(_verify, "doc_id long, passage long, span int, altered int, passage_at int, doc_at int, score int")
        .where(F.col("span") >= MIN_WORDS)
    )
    best = checked.groupBy("doc_id", "passage").agg(F.max(F.struct("span", "score", "altered", "passage_at", "doc_at")).alias("b"))
    return best.join(found.select("passage", F.explode("item_ids").alias("item_id")), "passage").select(
        "doc_id", "item_id", "b.span", "b.altered", "b.passage_at", "b.doc_at", "b.score"
    )
