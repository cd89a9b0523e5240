"""One consistent form for text that looks the same but differs in its characters.

The form is the compatibility normalisation, composed, with default-ignorable characters removed, blanks and
hyphens mapped to the ordinary ones, look-alike letters of other scripts mapped to Latin and, on request, full
case folding. Values are normalised once per distinct value of an Arrow batch.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of Greek and Cyrillic drawn like a Latin one, as pairs of letter and Latin letter.
CONFUSABLE = dict(
    pair
    for pair in (
        "аa вb еe ѕs іi јj оo рp сc уy хx һh ԁd ԛq ԝw ѵv ӏl "
        "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ԌG ԚQ ԜW "
        "οo νv ϲc ϳj ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX "
        "ɑa ɡg ıi օo"
    ).split()
)
# Marks that are drawn as a hyphen.
HYPHENS = frozenset("‐‑‒–−⁃﹣－")
# Compatibility tags whose characters look different from their decomposition.
KEPT_TAGS = ("<super>", "<sub>", "<circle>", "<fraction>", "<square>", "<vertical>")
# Ranges of the property Default_Ignorable_Code_Point.
IGNORABLE = (
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)
_BEYOND_ASCII = re.compile(r"[^\x00-\x7f]")


@lru_cache(maxsize=200_000)
def _char(ch: str) -> str:
    """What one character becomes, decomposed."""
    cp = ord(ch)
    if any(lo <= cp <= hi for lo, hi in IGNORABLE):
        return ""
    if ch in HYPHENS:
        return "-"
    if unicodedata.category(ch) in ("Zs", "Zl", "Zp", "Cc"):
        return " "
    if unicodedata.decomposition(ch).startswith(KEPT_TAGS):
        return ch
    return "".join("-" if c in HYPHENS else CONFUSABLE.get(c, c) for c in unicodedata.normalize("NFKD", ch))


def one_form(text: str | None, fold_case: bool = False, keep_runs: bool = False) -> str | None:
    """The consistent form of a text; null stays null, a text of nothing visible becomes ''. Several blanks become one unless
    ``keep_runs``: they show, so they belong to the look."""
    if text is None:
        return None
    if not text.isascii():
        text = unicodedata.normalize("NFC", _BEYOND_ASCII.sub(lambda m: _char(m.group()), text))
    text = re.sub(r"\s", " ", text).strip() if keep_runs else " ".join(text.split())
    if fold_case:
        text = unicodedata.normalize("NFC", text.casefold())
    return text


def _each_distinct(values: pd.Series, fold: bool, keep_runs: bool) -> pd.Series:
    codes, distinct = pd.factorize(values, use_na_sentinel=True)
    forms = [one_form(v, fold, keep_runs) for v in distinct]
    return pd.Series([None if c < 0 else forms[c] for c in codes], dtype=object)


@F.pandas_udf(T.StringType())
def _look(values: pd.Series) -> pd.Series:
    return _each_distinct(values, False, True)


@F.pandas_udf(T.StringType())
def _folded(values: pd.Series) -> pd.Series:
    return _each_distinct(values, True, False)


def look(c: Column | str) -> Column:
    """What a value looks like: equal for values that can't be told apart by eye; letter case and the number of blanks count."""
    return _look(c)


def canonical(c: Column | str) -> Column:
    """The form for comparisons: as ``look``, with full case folding and one blank for several."""
    return _folded(c)


def value_rows(df: DataFrame, id_col: str, scalars: list[str], arrays: list[str]) -> DataFrame:
    """Distinct (id, value) of the named columns; null ids and null or blank values name nothing and are left out."""
    parts = [F.array(*scalars)] if scalars else []
    parts += [F.coalesce(F.col(a), F.array().cast("array<string>")) for a in arrays]
    return (
        df.select(F.col(id_col).cast("string").alias("id"), F.explode(F.concat(*parts)).alias("value"))
        .where(F.col("id").isNotNull() & (F.trim("value") != ""))
        .distinct()
    )


def same_look_pairs(mentions: DataFrame, concepts: DataFrame, salts: int = 16) -> DataFrame:
    """Pairs (id_1, id_2), smaller first, of a mention and a concept or of two concepts: some value of one looks the
    same as some of the other, but they have no value in common character for character.

    Both inputs are (id, value). An equal value is also an equal look, so one join on the look decides both. The
    concept list is repeated ``salts`` times, so that a look that a third of all mentions share is spread over tasks.
    Rows of one id count as one row; an id is never paired with itself.
    """
    m = mentions.withColumn("look", look("value")).where(F.col("look") != "").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    c = concepts.withColumn("look", look("value")).where(F.col("look") != "")
    spread = c.select(F.col("id").alias("cid"), F.col("value").alias("cvalue"), "look", F.explode(F.array(*map(F.lit, range(salts)))).alias("salt"))
    spread = spread.withColumn("salt", F.col("salt").cast("bigint"))
    first = m.join(spread, ["look", "salt"]).select(F.col("id").alias("a"), F.col("cid").alias("b"), (F.col("value") == F.col("cvalue")).alias("same"))
    other = c.select(F.col("id").alias("b"), F.col("value").alias("bv"), "look")
    second = c.join(other, "look").where(F.col("id") < F.col("b")).select(F.col("id").alias("a"), "b", (F.col("value") == F.col("bv")).alias("same"))
    return (
        first.where(F.col("a") != F.col("b"))
        .unionAll(second)
        .select(F.least("a", "b").alias("id_1"), F.greatest("a", "b").alias("id_2"), "same")
        .groupBy("id_1", "id_2")
        .agg(F.max("same").alias("same"))
        .where(~F.col("same"))
        .select("id_1", "id_2")
    )
