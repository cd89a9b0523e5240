"""Text functions: keys, variants, grams, sentences, patterns, ids. All built-in but ``alias_key``."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Greek letters and their names.
GREEK = dict(
    zip(
        "αβγδεζηθικλμνξοπρστυφχψω",
        "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split(),
    )
)
_SEPARATORS = re.compile(r"[\s\-_/.,'’·・]+")


def _alias(value: str | None) -> str:
    if not value:
        return ""
    s = unicodedata.normalize("NFKC", value).strip()
    s = "".join(GREEK.get(c.lower(), c) if c.lower() in GREEK else c for c in s)
    return _SEPARATORS.sub("", s.casefold())


@F.pandas_udf(T.StringType())
def alias_key(values: pd.Series) -> pd.Series:
    """Dictionary key: compatibility form, Greek spelled out, case folded, separators dropped."""
    codes, distinct = pd.factorize(values, use_na_sentinel=True)
    forms = [_alias(v) for v in distinct]
    return pd.Series([forms[c] if c >= 0 else "" for c in codes])


def mention_key(c: Column) -> Column:
    """Lower case, blanks collapsed; another key than ``alias_key`` on purpose."""
    return F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")


def ascii_key(c: Column) -> Column:
    """The part of ``alias_key`` that SQL can say: enough for values in ordinary characters."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s\-_/.,']+", "")


CODE = r"^([A-Za-z]{1,6})[\s\-]?(\d{2,6})([A-Za-z]?)$"


def code_variants(c: Column) -> Column:
    """The other spellings of a code: joined, with a hyphen, with a blank; empty for what isn't a code."""
    a, d, s = (F.regexp_extract(c, CODE, k) for k in (1, 2, 3))
    every = F.array(F.concat(a, d, s), F.concat(a, F.lit("-"), d, s), F.concat(a, F.lit(" "), d, s))
    return F.when(c.rlike(CODE), F.filter(every, lambda v: F.lower(v) != F.lower(F.trim(c)))).otherwise(F.array().cast("array<string>"))


def rule_variants(c: Column) -> Column:
    """A name without trade marks, and its parts of four letters or more at / and +."""
    bare = F.trim(F.regexp_replace(c, "[®™©]", ""))
    parts = F.filter(F.transform(F.split(bare, r"[/+]"), F.trim), lambda p: F.length(p) >= 4)
    return F.array_distinct(F.concat(F.array(bare), parts))


def has_cjk(c: Column) -> Column:
    return c.rlike("[一-鿿㐀-䶿]")


def grams(c: Column, n: int = 3, pad: int = 2) -> Column:
    """Character n-grams with ``pad`` blanks on both sides, repeats kept."""
    padded = F.concat(F.lit(" " * pad), c, F.lit(" " * pad))
    return F.transform(F.sequence(F.lit(1), F.length(padded) - (n - 1)), lambda i: F.substring(padded, i, F.lit(n)))


SENTENCE_END = r"([.!?。！？])\s+"
BREAK = "\u0001"


def sentences(c: Column) -> Column:
    """Sentences, cut after an end mark and blanks; empty ones dropped."""
    marked = F.regexp_replace(c, SENTENCE_END, "$1" + BREAK)
    return F.filter(F.split(marked, BREAK), lambda s: F.trim(s) != "")


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+"), F.lit(0))


def entity_shaped(c: Column) -> Column:
    """Looks like the name of an entity: a code, an acronym, title case, or Han letters."""
    return c.rlike(r"^[A-Za-z]{1,6}-?\d{2,6}[A-Za-z]?$") | c.rlike(r"^[A-Z][A-Z0-9]{1,7}$") | c.rlike(r"^\p{Lu}\p{Ll}+( \p{Ll}+)*$") | has_cjk(c)


def curies(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"[A-Z][A-Za-z]+:[A-Za-z0-9:]*[0-9]+"), F.lit(0))


def keyword_hits(c: Column, keywords: list[str]) -> Column:
    """The keywords a text holds: Latin ones with nothing alphanumeric beside them, Han ones anywhere."""
    def one(k: str) -> Column:
        p = re.escape(k) if re.search("[一-鿿]", k) else rf"(^|[^A-Za-z0-9]){re.escape(k)}([^A-Za-z0-9]|$)"
        return F.when(F.lower(c).rlike(p), F.lit(k))

    return F.array_compact(F.array(*map(one, keywords)))


def label_confidence(hits: Column) -> Column:
    return F.when(hits >= 3, 0.92).when(hits == 2, 0.80).when(hits == 1, 0.55).otherwise(0.0)


UNITS = r"mg/kg|mg|µg|ng/mL|mL/min|mmol/L|nM|IU|per cent|points"
QUANTITY = rf"([0-9]+\.[0-9]+) ({UNITS})"


def id_hash(prefix: str, *cols: Column, size: int = 12) -> Column:
    """``prefix`` and the first ``size`` letters of the SHA-1 of the parts; a null part reads 'None', as in the ids of old."""
    joined = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("None")) for c in cols])
    return F.concat(F.lit(prefix), F.substring(F.sha1(joined), 1, size))


def numeric_id(*cols: Column) -> Column:
    """Nine digits from the first nine hexadecimal digits of the SHA-1."""
    h = F.conv(F.substring(F.sha1(F.concat_ws("|", *cols)), 1, 9), 16, 10).cast("bigint")
    return F.lpad((h % 1000000000).cast("string"), 9, "0")


def subpaths(path: Column, sep: str = " / ") -> Column:
    """All runs of consecutive parts of a path, each joined again, first occurrences kept."""
    parts = F.split(path, re.escape(sep))
    n = F.size(parts)
    runs = F.flatten(
        F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(i, n), lambda j: F.array_join(F.slice(parts, i, j - i + 1), sep)))
    )
    return F.array_distinct(runs)


def parent_path(path: Column) -> Column:
    """The path without its last part; '' for a top one."""
    return F.when(path.rlike(r" [/>] "), F.regexp_replace(path, r" [/>] [^/>]*$", "")).otherwise(F.lit(""))


def unify_path(path: Column) -> Column:
    return F.regexp_replace(path, " > ", " / ")


def curie_to_iri(c: Column, base: str = "https://w3id.org/x/") -> Column:
    return F.concat(F.lit(base), F.regexp_replace(c, ":", "/"))


def iri_to_curie(c: Column, base: str = "https://w3id.org/x/") -> Column:
    return F.regexp_replace(F.regexp_replace(c, "^" + re.escape(base), ""), "/", ":")


# Kinds of figure by words of the caption, in the order they are tried.
FIGURE_RULES = (
    ("RADIOLOGY", r"\b(ct|mri|pet|x-ray|scan|imaging)\b"),
    ("MICROSCOPY", r"\b(histolog|microscop|stain|immunohisto)"),
    ("GEL_BLOT", r"\b(blot|gel)\b"),
    ("DIAGRAM", r"\b(flow ?chart|consort|pathway|scheme)\b"),
    ("CHART", r"\b(kaplan|curve|plot|by arm|over time|forest|bar)\b"),
)


def figure_kind(caption: Column) -> Column:
    out = F.lit("OTHER")
    for kind, pattern in reversed(FIGURE_RULES):
        out = F.when(F.lower(caption).rlike(pattern), kind).otherwise(out)
    return F.coalesce(out, F.lit("OTHER"))


HEADING = r"^([0-9]+(?:\.[0-9]+)*)\.? [A-Z]"


def heading_level(line: Column) -> Column:
    """Depth of a numbered heading, at most 6; null for what is none."""
    number = F.regexp_extract(line, HEADING, 1)
    return F.when(line.rlike(HEADING) & (F.length(line) <= 80), F.least(F.lit(6), F.size(F.split(number, r"\."))))


def bounded(texts: Column, start: Column, size: Column) -> Column:
    """Whether the piece of ``size`` characters at ``start`` (from 1) is a whole stretch of Han characters between function characters,
    the nearest to a word that text without blanks shows. The stretch is what is left of a run when ``FUNCTION`` splits it."""
    piece = F.substring(texts, start, size)
    before, after = F.substring(texts, start - 1, F.lit(1)), F.substring(texts, start + size, F.lit(1))
    open_ = ~before.rlike(HAN) | before.rlike(FUNCTION) | (start <= 1)
    shut = ~after.rlike(HAN) | after.rlike(FUNCTION)
    return piece.rlike(f"^{HAN}+$") & ~piece.rlike(FUNCTION) & open_ & shut


HAN = "[\u4e00-\u9fff]"
# Han characters that join words and belong to none.
FUNCTION = "[的了和与及在是对为被将从于中或者]"


def qualifiers(header: Column, cells: Column, kept: list[str]) -> Column:
    """What a table's row says about its numbers: "header=value" for the headers ``kept``, without blank values."""
    pairs = F.zip_with(header, cells, lambda h, v: F.struct(h.alias("h"), F.trim(v).alias("v")))
    good = F.filter(pairs, lambda p: p["h"].isin(*kept) & F.coalesce(p["v"] != "", F.lit(False)))
    return F.transform(good, lambda p: F.concat(p["h"], F.lit("="), p["v"]))


def surfaces(label: Column, others: Column, most: int = 8) -> Column:
    """The label and other names of a concept as search terms: trimmed, distinct but for case, of two letters or more."""
    every = F.transform(F.filter(F.concat(F.array(label), F.coalesce(others, F.array().cast("array<string>"))), lambda s: F.coalesce(F.length(F.trim(s)) >= 2, F.lit(False))), lambda s: F.trim(s))
    first = F.filter(every, lambda s, i: F.array_position(F.transform(every, lambda x: F.lower(x)), F.lower(s)) == i + 1)
    return F.slice(first, 1, most)


def label_variants(label: Column) -> Column:
    """Controlled variants of a label for training a linker: case, hyphens and blanks taken out, and a slightly wrong ending."""
    base = F.trim(label)
    plain = F.array(F.lower(base), F.upper(base), F.replace(base, F.lit("-"), F.lit("")), F.replace(base, F.lit(" "), F.lit("")), F.replace(base, F.lit("-"), F.lit(" ")))
    last = F.substring(base, -1, 1)
    noisy = F.when((F.length(base) >= 5) & base.rlike("^[ -~]+$"), F.array(F.concat(base, last), F.concat(F.substring(base, F.lit(1), F.length(base) - 1), F.lit("x")))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.filter(F.array_distinct(F.concat(plain, noisy)), lambda v: (v != "") & (mention_key(v) != mention_key(base))))


def hours_since(at: Column, now: Column) -> Column:
    """Hours between an ISO time and another, null if it isn't one; times in the future count 0."""
    t = F.try_to_timestamp(at)
    return F.when(t.isNotNull(), F.greatest(F.lit(0.0), F.round((F.unix_micros(now) - F.unix_micros(t)) / 3.6e9, 4)))
