"""Hashed bag-of-words vectors: an embedder that needs no model."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mossbrook.functions import text as X


def bucket(word: str, size: int) -> tuple[int, float]:
    """The place of a word and its sign, from eight bytes of its BLAKE2b hash."""
    h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
    return h % size, 1.0 if h >> 63 else -1.0


def hashed(words: list[str], size: int) -> list[float]:
    """The vector of a bag of words, of length 1; without words all zeros."""
    out = [0.0] * size
    for w, n in Counter(words).items():
        at, sign = bucket(w, size)
        out[at] += sign * n
    norm = math.sqrt(sum(v * v for v in out)) or 1.0
    return [v / norm for v in out]


def embed(text: Column, size: int = 64) -> Column:
    """Dense vectors of texts by their lower-cased words; a null text gives zeros."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(words: pd.Series) -> pd.Series:
        return words.map(lambda ws: hashed([] if ws is None else list(ws), size))

    return run(X.words(text))


def sparse(text: Column, size: int = 1 << 20) -> Column:
    """Term counts by hash bucket, a map, wholly built in."""
    w = F.transform(F.coalesce(X.words(text), F.array().cast("array<string>")), lambda t: F.pmod(F.xxhash64(t), F.lit(size)))
    return F.map_from_arrays(F.array_distinct(w), F.transform(F.array_distinct(w), lambda b: F.size(F.filter(w, lambda t: t == b))))
