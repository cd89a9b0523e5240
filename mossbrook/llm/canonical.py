"""Mapping free-typed values to a canonical list by a prefix-filter set-similarity join.

Values and list terms are sets of padded trigrams of their words. Trigrams are ordered by how rare they are over both
sides; only the rarest, as many as the allowed misspellings can spoil and one more, are joined. Length and positional
filters follow, then the exact overlap and Jaccard, and last a check of what a set can't see: numbers must be equal,
a word of the list can't stand for another word of the list, and the edits must fit the length.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mossbrook.llm.lookalike import one_form
from mossbrook.session import cut_lineage

UNMATCHED = "UNMATCHED"
#: Trigrams that one misspelling (a transposition at worst) spoils.
SPOILED = 4
SALTS = 8
# Words that dress a name without being part of it, and units after a dose.
DRESSING = frozenset(
    "a adv advanced and anti arm arms as blinded bid capsule capsules code cohort confirmed cpd compound drug for gene "
    "group h history human hx in inj injection iv monotherapy nos of or oral patient patients po possible probable "
    "protein pt pts qd salt solution subjects suspected susp tab tablet tablets tabs target the tid treatment w with".split()
)
UNITS = frozenset("mg ml g kg mcg ug μg iu nm mmol l dl percent".split())
ROMAN = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "x": "10"}
GREEK = {c: str(k + 1) for k, c in enumerate("αβγδεζηθ")}
_PARTS = re.compile(r"[^\W\d_]+|\d+")
CORE = T.StructType(
    [T.StructField("words", T.ArrayType(T.StringType())), T.StructField("numbers", T.StringType()), T.StructField("key", T.StringType())]
)


def parts(value: str) -> list[str]:
    """Words and numbers of a value without accents; Greek letters that stand alone and ``type`` numerals are numbers."""
    form = one_form(value, True) or ""
    form = "".join(c for c in unicodedata.normalize("NFD", form) if not unicodedata.combining(c))
    out: list[str] = []
    for p in _PARTS.findall(form):
        if p in ROMAN and out and out[-1] in ("type", "stage", "grade"):
            p = ROMAN[p]
        out.append(GREEK.get(p, p))
    return out


def core(value: str) -> tuple[list[str], list[str]]:
    """(words, numbers) of a value without what dresses it: form words, doses with their units, stages."""
    seq = parts(value)
    words: list[str] = []
    numbers: list[str] = []
    for i, p in enumerate(seq):
        after = seq[i + 1] if i + 1 < len(seq) else ""
        if p.isdigit():
            if after in UNITS or (i and seq[i - 1] in ("stage", "grade")):
                continue
            numbers.append(p)
        elif p in UNITS and i and seq[i - 1].isdigit() or p in ("type", "stage", "grade"):
            continue
        elif p == "iii" and "type" in seq:
            numbers.append("3")
        elif p not in DRESSING:
            words.append(p)
    return words, sorted(numbers)


@F.pandas_udf(CORE)
def _core(values: pd.Series) -> pd.DataFrame:
    known: dict[str, tuple] = {}
    rows = []
    for v in values:
        if v is None:
            rows.append((None, None, None))
            continue
        if v not in known:
            w, n = core(v)
            known[v] = (w, " ".join(n), " ".join(w) + "|" + " ".join(n))
        rows.append(known[v])
    return pd.DataFrame(rows, columns=["words", "numbers", "key"])


def trigrams(words: Column) -> Column:
    """The distinct trigrams of the words, each word padded by one mark on both sides."""
    padded = F.transform(words, lambda w: F.concat(F.lit("#"), w, F.lit("#")))
    each = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 2, F.lit(1))), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(each))


def allowed(n: Column) -> Column:
    """Misspellings allowed where the smaller of two values has n trigrams. It grows with n, so the prefix that a value's own
    n asks for is long enough for every partner."""
    return F.when(n <= 4, 0).when(n <= 7, 1).when(n <= 24, 2).otherwise(3)


def list_terms(concepts: DataFrame, id_col: str, scalars: list[str], arrays: list[str]) -> DataFrame:
    """(bios_id, term, rank, words, numbers): every term of the list, salts and the like taken off.

    A word is a modifier if some concept has a term with and the same term without it, neither with a number.
    The modifiers, one row, are words of the reference list and few. A numbered name also counts
    by its first word and number alone, where no other concept shares these. rank: 0 an ordinary term, 1 one that
    isn't written in ordinary characters, 2 a short form made here.
    """
    filled = [F.array(*scalars)] + [F.coalesce(F.col(a), F.array().cast("array<string>")) for a in arrays]
    flat = (
        concepts.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).cast("string").alias("bios_id"), F.explode(F.array_distinct(F.concat(*filled))).alias("term"))
        .where(F.trim("term") != "")
        .distinct()
        .withColumn("c", _core("term"))
        .where(F.size("c.words") > 0)
        .select("bios_id", "term", "c.words", "c.numbers", F.when(F.col("term") == _plain("term"), 0).otherwise(1).alias("rank"))
    )
    flat = cut_lineage(flat)
    a, b = flat.alias("a"), flat.alias("b")
    pairs = a.join(b, (F.col("a.bios_id") == F.col("b.bios_id")) & (F.col("a.numbers") == "") & (F.col("b.numbers") == "") & (F.size("a.words") == F.size("b.words") + 1))
    extra = F.array_except("a.words", "b.words")
    modifiers = pairs.where((F.size(extra) == 1) & (F.size(F.array_except("b.words", "a.words")) == 0)).select(extra[0].alias("word")).distinct()
    base = flat.join(F.broadcast(modifiers.agg(F.array_sort(F.collect_set("word")).alias("mods"))))
    base = base.withColumn("short", F.filter("words", lambda w: ~F.array_contains("mods", w)))
    base = base.withColumn("words", F.when(F.size("short") > 0, F.col("short")).otherwise(F.col("words"))).drop("short")
    numbered = base.where((F.col("numbers") != "") & (F.size("words") > 1)).select("bios_id", "term", F.array(F.col("words")[0]).alias("words"), "numbers", F.lit(2).alias("rank"), "mods")
    clear = numbered.groupBy("words", "numbers").agg(F.count_distinct("bios_id").alias("n")).where("n = 1").drop("n")
    return base.select("bios_id", "term", "words", "numbers", "rank", "mods").unionByName(numbered.join(clear, ["words", "numbers"], "left_semi"))


@F.pandas_udf(T.StringType())
def _plain(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else one_form(v))


def _edits(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance, or most + 1 where it's greater."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


MOST_EDITS = 3


def _limit(n: int) -> int:
    return 0 if n <= 4 else 1 if n <= 7 else 2 if n <= 16 else MOST_EDITS


@F.pandas_udf(T.ArrayType(T.StringType()))
def _without_modifiers(words: pd.Series, mods: pd.Series, known: pd.Series) -> pd.Series:
    """The words that aren't modifiers, well or badly spelled; all of them if nothing else is left."""
    out = []
    for ws, ms, ks in zip(words, mods, known):
        ks = set(ks)
        kept = [w for w in ws if w not in ms and (w in ks or len(w) < 5 or all(_edits(w, m, 2) > 2 for m in ms))]
        out.append(kept or list(ws))
    return pd.Series(out)


def distance(mine: list[str], theirs: list[str], known: set[str]) -> int:
    """Edits between a value's words and a term's, in any order; -1 if they can't mean the same.

    ``known`` are the value's words that are words of the list: each must be a word of the term as it stands."""
    left, right = list(mine), list(theirs)
    for w in mine:
        if w in right:
            left.remove(w)
            right.remove(w)
    if any(w in known for w in left):
        return -1
    if not left and not right:
        return 0
    a, b = "".join(left), "".join(right)
    most = _limit(max(len(a), len(b)))
    if not most and min(len(a), len(b)) > 2 and sum(map(len, mine)) - len(a) >= 8:
        most = 1
    best = _edits(a, b, most)
    if len(left) == len(right) > 1:
        total, rest = 0, list(right)
        for w in sorted(left, key=len, reverse=True):
            d, v = min((_edits(w, v, 4), v) for v in rest)
            rest.remove(v)
            total += d if d <= max(1, _limit(len(w))) else 99
        best = min(best, total if total <= most + len(left) - 1 else most + 1 + 99)
        most = most + len(left) - 1
    return best if best <= most else -1


@F.pandas_udf(T.IntegerType())
def _distance(mine: pd.Series, theirs: pd.Series, known: pd.Series) -> pd.Series:
    return pd.Series([distance(list(a), list(b), set(k)) for a, b, k in zip(mine, theirs, known)], dtype="int32")


def _ordered(df: DataFrame, rarity: DataFrame, key: list[str]) -> DataFrame:
    """The rows of ``df`` by gram of their prefix: (key..., gram, place, n), the rarest grams first."""
    n = F.size("grams")
    long = df.select(*key, "grams", F.explode("grams").alias("gram")).join(rarity, "gram")
    packed = long.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("sorted"), F.first("grams").alias("grams"))
    prefix = F.least(n, allowed(n) * SPOILED + 1)
    return packed.select(*key, n.alias("n"), F.posexplode(F.slice("sorted", F.lit(1), prefix)).alias("place", "g")).select(*key, "n", "place", F.col("g.gram").alias("gram"))


def map_values(values: DataFrame, terms: DataFrame) -> DataFrame:
    """(key, bios_id, edits, jaccard) of the distinct values (key, words, numbers) that name a term; the best one.

    Order of the candidates: highest Jaccard, fewest edits, ordinary before odd writing, smallest id.
    """
    none = F.array().cast("array<string>")
    words = terms.select(F.explode("words").alias("word")).distinct()
    listed = values.select("key", F.explode("words").alias("word")).join(words, "word", "left_semi").groupBy("key").agg(F.collect_set("word").alias("known"))
    mods = terms.agg(F.coalesce(F.first("mods", ignorenulls=True), none).alias("mods"))
    v = values.join(listed, "key", "left").join(F.broadcast(mods)).withColumn("known", F.coalesce("known", none))
    v = v.withColumn("words", _without_modifiers("words", "mods", "known")).select("key", "words", "numbers", "known", trigrams(F.col("words")).alias("grams"))
    t = terms.groupBy("words", "numbers").agg(F.min(F.struct("rank", "bios_id")).alias("r")).select("words", "numbers", "r.rank", "r.bios_id", trigrams(F.col("words")).alias("grams"))
    v, t = cut_lineage(v), cut_lineage(t.withColumn("tid", F.xxhash64("words", "numbers")))
    rarity = v.select(F.explode("grams").alias("gram")).unionAll(t.select(F.explode("grams").alias("gram"))).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    left = _ordered(v.select("key", "numbers", "grams"), rarity, ["key", "numbers"])
    right = _ordered(t.select("tid", "numbers", "grams"), rarity, ["tid", "numbers"]).select("tid", "numbers", F.col("n").alias("tn"), F.col("place").alias("tplace"), "gram")
    least = F.least("n", "tn")
    need = F.greatest("n", "tn") - allowed(least) * SPOILED
    pairs = (
        left.join(right, ["gram", "numbers"])
        .where(least >= need)
        .where(1 + F.least(F.col("n") - F.col("place"), F.col("tn") - F.col("tplace")) >= need)
        .select("key", "tid")
        .distinct()
    )
    full = (
        pairs.join(v.select("key", "words", "known", "grams"), "key")
        .join(t.select("tid", "bios_id", "rank", F.col("words").alias("twords"), F.col("grams").alias("tgrams")), "tid")
        .withColumn("both", F.size(F.array_intersect("grams", "tgrams")))
    )
    a, b = F.size("grams"), F.size("tgrams")
    exact = full.where(F.col("both") >= F.greatest(F.greatest(a, b) - allowed(F.least(a, b)) * SPOILED, F.lit(1))).withColumn("jaccard", F.col("both") / F.size(F.array_union("grams", "tgrams")))
    # What the alignment of words rejects anyway, told from the words left on both sides before any row goes to Python.
    left, right = F.array_except("words", "twords"), F.array_except("twords", "words")
    once = (F.size(F.array_distinct("words")) == F.size("words")) & (F.size(F.array_distinct("twords")) == F.size("twords"))
    length = F.abs(F.length(F.array_join(left, "")) - F.length(F.array_join(right, "")))
    likely = (F.size(F.array_intersect(left, F.col("known"))) == 0) & (~once | (length <= MOST_EDITS + F.greatest(F.size(left) - 1, F.lit(0))))
    checked = exact.where(likely).withColumn("edits", _distance("words", "twords", "known")).where(F.col("edits") >= 0)
    best = checked.groupBy("key").agg(F.min(F.struct((-F.round("jaccard", 6)).alias("j"), "edits", "rank", "bios_id")).alias("b"))
    return best.select("key", "b.bios_id", "b.edits", (-F.col("b.j")).alias("jaccard"))


def map_mentions(mentions: DataFrame, concepts: DataFrame) -> DataFrame:
    """(match_id, bios_id, edits, jaccard): one row for each match_id with a mention that isn't null or blank.

    ``bios_id`` is UNMATCHED where the list has no such name. The unreliable score and candidate id aren't used.
    A match_id with several mentions takes the one with the fewest edits. A popular value is looked up once and
    spread over ``SALTS`` tasks when it's joined back.
    """
    rows = (
        mentions.where(F.col("match_id").isNotNull() & (F.trim("mention") != ""))
        .select("match_id", "mention")
        .distinct()
        .withColumn("c", _core("mention"))
        .select("match_id", F.col("c.key").alias("key"), "c.words", "c.numbers", F.pmod(F.xxhash64("match_id"), F.lit(SALTS)).alias("salt"))
    )
    rows = cut_lineage(rows)
    values = rows.where(F.size("words") > 0).groupBy("key").agg(F.first("words").alias("words"), F.first("numbers").alias("numbers"))
    terms = cut_lineage(list_terms(concepts, "bios_id", ["preferred_term"], ["terms"]))
    found = map_values(values, terms).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    joined = rows.select("match_id", "key", "salt").join(found, ["key", "salt"], "left")
    one = joined.groupBy("match_id").agg(F.min(F.struct(F.coalesce("edits", F.lit(999)).alias("e"), "bios_id", "edits", "jaccard")).alias("b"))
    return one.select("match_id", F.coalesce("b.bios_id", F.lit(UNMATCHED)).alias("bios_id"), "b.edits", F.round("b.jaccard", 6).alias("jaccard"))
