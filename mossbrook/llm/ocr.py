"""Repair of text read from scanned pages.

Words are counted over the whole corpus. A rare word is joined to a frequent one through its anagram hash: the sum of
a value per character, so that "what was read for what stands there" is one difference of hashes, and candidates are
found by an equi-join on hash + difference, then checked by spelling. Lines at the edges of a page are judged by the
document they stand in: its title, lines that come back from page to page, and numbers that keep their distance to
the page. A mark at a line's end is a division or a compound's own hyphen by which of the two the corpus knows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mossbrook.session import cut_lineage

# What is printed and what it's read as.
CONFUSIONS = (
    ("e", "c"), ("i", "!"), ("t", "†"), ("o", "0"), ("l", "1"), ("d", "cl"), ("s", "5"), ("u", "ii"), ("m", "rn"), ("y", "v"), ("ti", "n"),
    ("in", "m"), ("rn", "m"), ("nn", "mi"), ("cl", "d"), ("h", "b"), ("g", "q"), ("li", "h"), ("w", "vv"), ("1", "l"), ("0", "o"), ("5", "s"), ("8", "b"),
    ("b", "8"), ("i", "l"),
)
MARKS = "-‐­¬"
#: How much more frequent than its misreading a word must be.
RATIO = 3
#: Letters from which on a word may hold two confusions; shorter words come too close to others.
LONG_WORD = 7
LONGEST = 80
BITS = 23
EDGE_LINES = 2
# From the first character of a token only: a long unbroken run is read once, not from each of its characters.
BROKEN = rf"(?<!\S)\S+[{MARKS}] ?\n\s*\S+"
_BREAK = re.compile(BROKEN)
_PARTS = re.compile(rf"(?<!\S)(\S+)([{MARKS}]) ?\n\s*(\S+)")
_HAN = re.compile(r"[\u3400-\u9fff]+")
_INNER = re.compile(r"[!†]?[^\W_](?:[\w!†]*[^\W_])?[!†]?")
NUMBER = re.compile(r"(?=[\dlOSB.,/]*\d)(?=[\dlOSB.,/]*[lOSB])[\dlO][\dlOSB]*(?:[.,/][\dlOSB]+)*")
#: A shape of header stands in this share of the documents with edge lines, and in three of them at least.
SHAPE_SHARE, SHAPE_DOCS = 0.001, 3
#: Share of all words from which on a word is a familiar one.
FAMILIAR = 1e-5


def char_value(c: str) -> int:
    """The value of a character in the anagram hash: the fifth power of its code, within 40 bits."""
    return pow(ord(c), 5, (1 << 40) - 87)


def anagram(word: str) -> int:
    return sum(map(char_value, word))


def token_words(token: str) -> list[str]:
    """The words of a token between blanks, case folded: those of its parts at hyphens, and "a-b" of what stands on both sides of each
    hyphen. A part of several words, as at a slash, gives each, one of more than ``LONGEST`` characters its pieces. Han characters,
    which no confusion touches, part words and are none."""
    low = token.casefold()
    if not low.isascii():
        low = _HAN.sub(" ", low)
    parts = [[w[k : k + LONGEST] for w in _INNER.findall(part) for k in range(0, len(w), LONGEST)] for part in low.split("-")]
    return [w for ws in parts for w in ws] + [f"{a[-1]}-{b[0]}" for a, b in zip(parts, parts[1:]) if a and b]


class Tokens:
    """The words of tokens; most tokens come again, so what they give is kept."""

    def __init__(self, size: int = 400_000):
        self.size, self.kept = size, {}

    def __call__(self, token: str) -> list[str]:
        got = self.kept.get(token)
        if got is None:
            got = token_words(token)
            if len(self.kept) >= self.size:
                self.kept.clear()
            if len(token) < LONGEST:
                self.kept[token] = got
        return got


def word_counts(nodes: DataFrame) -> DataFrame:
    """(word, n) over all contents; words divided by a line's end don't count."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = Tokens()
        for pdf in batches:
            raw: Counter[str] = Counter()
            for t in pdf["content"]:
                if "\n" in t:
                    t = _BREAK.sub(" ", t)
                raw.update(t.split())
            words: Counter[str] = Counter()
            for token, n in raw.items():
                for w in tokens(token):
                    words[w] += n
            yield pd.DataFrame({"word": pd.Series(list(words), dtype=object), "n": pd.Series(list(words.values()), dtype="int64")})

    texts = nodes.where(F.length("content") > 0).select("content")
    return texts.mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@F.pandas_udf(T.LongType())
def _anagram(words: pd.Series) -> pd.Series:
    return words.map(anagram).astype("int64")


def _spellings(word: str) -> set[str]:
    """What may stand in the print where a word was read, by one confusion, or by two if it's ``LONG_WORD`` long."""
    def once(w: str) -> set[str]:
        return {w[:i] + a + w[i + len(b) :] for a, b in CONFUSIONS for i in range(len(w)) if w.startswith(b, i)}

    first = once(word)
    return first | {v for w in first for v in once(w) if len(v) >= LONG_WORD}


@F.pandas_udf(T.BooleanType())
def _spelled(read: pd.Series, printed: pd.Series) -> pd.Series:
    kept: dict[str, set[str]] = {}
    out = []
    for r, p in zip(read, printed):
        if r not in kept:
            if len(kept) > 2000:
                kept.clear()
            kept[r] = _spellings(r)
        out.append(p in kept[r])
    return pd.Series(out)


def corrections(counts: DataFrame) -> DataFrame:
    """(word, printed): the best frequent word for every rare word that one or two confusions explain.

    The printed word is at least ``RATIO`` times as frequent. Where only letters are confused it has four letters or
    more. Of several, the most frequent, then the first by spelling.
    """
    single = [(anagram(a) - anagram(b), b, "") for a, b in CONFUSIONS]
    double = [(x + y, b, c) for i, (x, b, _) in enumerate(single) for y, c, _ in single[i:]]
    shifts = F.array(*[F.struct(F.lit(x).cast("long").alias("shift"), F.lit(b).alias("b"), F.lit(c).alias("c")) for x, b, c in sorted(set(single + double))])
    words = counts.where(~F.contains("word", F.lit("-")) & (F.length("word") > 1) & ~F.col("word").rlike(r"^\d+$"))
    hashed = words.withColumn("hash", _anagram("word"))
    reads = hashed.select("word", "n", "hash")
    fitting = F.filter(shifts, lambda s: F.contains(F.col("word"), s["b"]) & F.contains(F.col("word"), s["c"]))
    keys = reads.select("word", "n", "hash", F.explode(fitting).alias("s")).select("word", "n", (F.col("hash") + F.col("s.shift")).alias("hash")).distinct()
    frequent = hashed.where(F.col("n") >= RATIO).select(F.col("word").alias("printed"), F.col("n").alias("printed_n"), "hash")
    odd = F.col("word").rlike(r"[0-9!†]")
    pairs = (
        keys.join(frequent, "hash")
        .where((F.col("printed") != F.col("word")) & (F.col("printed_n") >= RATIO * F.col("n")))
        .where(odd & F.col("printed").rlike(r"\p{L}") | (F.length("printed") >= 4))
        .where(_spelled("word", "printed"))
    )
    best = pairs.groupBy("word").agg(F.max(F.struct("printed_n", F.col("printed"))).alias("b"))
    return best.select("word", F.col("b.printed").alias("printed"))


def _bit(word: str) -> int:
    return xxhash.xxh64_intdigest(word) >> (64 - BITS)


def _bitmap(words: DataFrame) -> np.ndarray:
    """A bit per word, in a map whose size doesn't depend on how many there are."""

    @F.pandas_udf(T.LongType())
    def bit(values: pd.Series) -> pd.Series:
        return values.map(_bit).astype("int64")

    packed = words.select(bit("word").alias("bit")).groupBy(F.shiftright("bit", 3).alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, cast(bit & 7 as int))")).alias("v")).toPandas()
    out = np.zeros(2 ** (BITS - 3), np.uint8)
    out[packed["byte"].to_numpy(np.int64)] = packed["v"].to_numpy(np.uint8)
    return out


class Hits(dict):
    """What of a token may be misread: words that stand in the bitmap, and "" for a number with letters in it; kept by token."""

    def __init__(self, bitmap: np.ndarray, size: int = 400_000):
        super().__init__()
        self.bitmap, self.size = bitmap, size

    def __missing__(self, token: str) -> tuple[str, ...]:
        hits = tuple(w for w in token_words(token) if self.bitmap[(b := _bit(w)) >> 3] >> (b & 7) & 1)
        if any(c in token for c in "lOSB") and any(NUMBER.fullmatch(p) for p in re.split(r"[-–(]", token.strip(".,;:()"))):
            hits += ("",)
        if len(token) < LONGEST:
            if len(self) >= self.size:
                self.clear()
            self[token] = hits
        return hits


def misread_places(nodes: DataFrame, fixes: DataFrame) -> DataFrame:
    """(node_id, line, word, printed) of misread words and numbers; printed is null for a number, which is read back
    digit by digit. Lines are counted from 0."""
    shared = nodes.sparkSession.sparkContext.broadcast(_bitmap(fixes))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Hits(shared.value)
        for pdf in batches:
            rows = []
            for node, text in zip(pdf["node_id"], pdf["content"]):
                for token, hits in [(t, h) for t in set(text.split()) if (h := known[t])]:
                    lines = [k for k, line in enumerate(text.split("\n")) if token in line.split()]
                    rows += [(node, k, w or token.strip(".,;:()"), not w) for k in lines for w in hits]
            yield pd.DataFrame(rows, columns=["node_id", "line", "word", "is_number"])

    found = nodes.mapInPandas(run, "node_id string, line int, word string, is_number boolean").distinct()
    words = found.where(~F.col("is_number")).join(fixes, "word").select("node_id", "line", "word", "printed")
    numbers = found.where("is_number").select("node_id", "line", "word", F.lit(None).cast("string").alias("printed"))
    return words.unionByName(numbers)


def divisions(nodes: DataFrame, counts: DataFrame) -> DataFrame:
    """(node_id, left, mark, right, divided): every line that ends in a mark, and whether a word is divided there.

    Other marks than the hyphen divide. For a hyphen the corpus decides: the joined word or the compound, whichever
    is more frequent; if it knows neither, parts that are both words of their own make a compound, as do codes.
    """
    ends = [F.contains("content", F.lit(mark + gap + "\n")) for mark in MARKS for gap in ("", " ")]
    broken = nodes.where(reduce(or_, ends)).select("node_id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(BROKEN), F.lit(0)))).alias("at"))
    parts = rf"^(\S+)([{MARKS}]) ?\n\s*(\S+)$"
    each = cut_lineage(broken.select("node_id", *[F.regexp_extract("at", parts, k).alias(n) for k, n in ((1, "left"), (2, "mark"), (3, "right"))]))
    each = each.withColumn("a", F.lower(F.regexp_extract("left", r"([\p{L}\p{N}!†]+)$", 1))).withColumn("z", F.lower(F.regexp_extract("right", r"^([\p{L}\p{N}!†]+)", 1)))
    cases = each.where((F.col("a") != "") & (F.col("z") != "")).select("a", "z", "mark").where("mark = '-'").select("a", "z").distinct()
    asked = cases.select("a", "z", F.explode(F.array(F.concat("a", "z"), F.concat_ws("-", "a", "z"), F.concat(F.lit("<"), "a"), F.concat(F.lit(">"), "z"))).alias("q"))
    asked = asked.withColumn("word", F.regexp_replace("q", "^[<>]", ""))
    known = (
        asked.join(counts, "word")
        .groupBy("a", "z")
        .agg(
            *[
                F.coalesce(F.max(F.when(c, F.col("n"))), F.lit(0)).alias(n)
                for n, c in (
                    ("joined", F.col("q") == F.concat("a", "z")), ("compound", F.col("q") == F.concat_ws("-", "a", "z")),
                    ("na", F.col("q") == F.concat(F.lit("<"), "a")), ("nz", F.col("q") == F.concat(F.lit(">"), "z")),
                )
            ]
        )
    )
    judged = each.join(known, ["a", "z"], "left").na.fill(0, ["joined", "compound", "na", "nz"])
    judged = judged.join(F.broadcast(counts.agg((F.coalesce(F.sum("n"), F.lit(0)) * FAMILIAR).alias("familiar"))))
    code = F.col("z").rlike(r"^[0-9Ͱ-Ͽ]") | F.col("left").rlike(r"[0-9]$") | F.col("right").rlike(r"^[0-9]")
    by_corpus = F.when(F.col("joined") > F.col("compound"), True).when(F.col("compound") > 0, False).when(code, False)
    divided = F.when((F.col("a") == "") | (F.col("z") == ""), False).when(F.col("mark") != "-", True).otherwise(
        F.coalesce(by_corpus, ~((F.col("na") >= F.greatest(F.lit(RATIO), "familiar")) & (F.col("nz") >= F.greatest(F.lit(RATIO), "familiar"))))
    )
    return judged.select("node_id", "left", "mark", "right", divided.alias("divided"))


def _plain(c: Column) -> Column:
    """Letters and digits in upper case."""
    return F.regexp_replace(F.upper(c), r"[^\p{L}\p{N}]", "")


def _digits(c: Column) -> Column:
    return F.translate(c, "lIOoSB", "110058")


STYLES = (
    ("of", r"^\p{L}{1,5}[.]? *([0-9lOoSB]+) \p{L}{1,2} [0-9lOoSB]+$"),
    ("slash", r"^([0-9lOoSB]+) */ *[0-9lOoSB]+$"),
    ("page", r"^[PpF]\p{L}{2,4}[.]? *([0-9lOoSB]+)$"),
    ("p", r"^[Pp][.,]? +([0-9lOoSB]+)$"),
    ("dash", r"^[-–—] *([0-9lOoSB]+) *[-–—]$"),
    ("bracket", r"^\[ *([0-9lOoSB]+) *\]$"),
    ("roman", r"^([ivxlc]+|[IVXLC]+)$"),
    ("bare", r"^([0-9][0-9lOoSB]*)$"),
)


def _title() -> Column:
    """The first part of a section's path: what the document is called."""
    return F.trim(F.split("section_path", r" [/>] ")[0])


def edge_parts(nodes: DataFrame) -> DataFrame:
    """(node_id, document_id, parent_id, title, page, line, side, rank, alone, part, before, after) of the first and last
    lines that aren't blank, cut at wide gaps; before and after are the neighbouring lines."""
    lines = F.filter(F.transform(F.split("content", "\n"), lambda x, i: F.struct(i.alias("line"), F.trim(x).alias("text"))), lambda s: s["text"] != "")
    base = nodes.where(F.contains("content", F.lit("\n"))).select(
        "node_id", "document_id", "parent_id", "page", _title().alias("title"), lines.alias("l")
    )
    n = F.size("l")
    tops = F.transform(F.sequence(F.lit(1), F.least(F.lit(EDGE_LINES), n)), lambda k: F.struct(F.lit("top").alias("side"), k.alias("rank"), k.alias("at")))
    ends = F.transform(F.sequence(F.lit(1), F.least(F.lit(EDGE_LINES), n)), lambda k: F.struct(F.lit("end").alias("side"), k.alias("rank"), (n - k + 1).alias("at")))
    at = base.where(n > 0).select("*", F.explode(F.concat(tops, ends)).alias("e"))
    text = F.get("l", F.col("e.at") - 1)
    cut = at.select(
        "node_id", "document_id", "parent_id", "title", "page", text["line"].alias("line"), "e.side", "e.rank",
        F.split(text["text"], r"\s{3,}").alias("parts"), F.get("l", F.col("e.at") - 2)["text"].alias("before"), F.get("l", F.col("e.at"))["text"].alias("after"),
    )
    return cut.select("*", (F.size("parts") == 1).alias("alone"), F.explode("parts").alias("part")).drop("parts")


def edge_noise(nodes: DataFrame) -> DataFrame:
    """(node_id, line, noise, part) of running headers and page numbers.

    A header resembles the title, or has a shape (digits as #) that starts or ends pages of ``SHAPE_SHARE`` of the
    documents and is no line of text, or comes back on another page of its section. A page number has one of the usual
    forms; a lone number must keep the distance to the page that others of its section keep, or follow no list.
    """
    parts = edge_parts(nodes).distinct()
    group = ["document_id", "parent_id"]
    titles = nodes.where(F.contains("content", F.lit("\n"))).groupBy(*group).agg(F.max(_title()).alias("group_title"))
    style = F.coalesce(*[F.when(F.col("part").rlike(p), F.lit(s)) for s, p in STYLES])
    value = F.coalesce(*[F.when(F.col("part").rlike(p), _digits(F.regexp_extract("part", p, 1))) for s, p in STYLES if s != "roman"])
    parts = parts.join(titles, group, "left").withColumn("group_title", F.coalesce("title", "group_title"))
    parts = parts.withColumn("style", style).withColumn("v", value).withColumn("offset", F.expr("try_cast(v as int) - page"))

    plain, title = _plain(F.col("part")), _plain(F.col("group_title"))
    shown = F.substring(title, F.lit(1), F.greatest(F.length(plain), F.lit(1)))
    near = F.levenshtein(plain, shown, 12)
    like_title = (F.length(plain) >= 8) & (near >= 0) & (near <= F.greatest(F.lit(1), F.length(plain) / 5))
    shape = F.regexp_replace("part", r"[0-9lO]*[0-9]+[0-9lO]*", "#")
    parts = parts.withColumn("like_title", F.coalesce(like_title, F.lit(False))).withColumn("shape", F.regexp_replace(shape, r" ?\p{Lu}[^\p{L}#]*#[^\p{L}]*$", " A#"))
    worded = F.col("part").rlike(r"\p{L}{3}") & ~F.col("part").rlike(r"[:.;,]$") & F.col("style").isNull() & (F.length("part") <= 70)
    few = F.size(F.split("part", " ")) <= 4
    # Told once for all that follows.
    parts = cut_lineage(parts.withColumn("worded", F.coalesce(worded, F.lit(False))).withColumn("few", few).drop("title", "group_title"))
    worded, few = F.col("worded"), F.col("few")
    shapes = (
        parts.where(worded & few & ~F.col("like_title") & F.contains("shape", F.lit("#")) & ((F.col("rank") == 1) | ~F.col("alone")))
        .select("shape", *group, "part").distinct()
        .groupBy("shape").agg(F.count_distinct("document_id").alias("docs"), F.count_distinct("part").alias("forms"))
        .join(F.broadcast(parts.agg(F.greatest(F.lit(SHAPE_DOCS), F.count_distinct("document_id") * SHAPE_SHARE).alias("least"))))
        .where((F.col("docs") >= F.col("least")) & (F.col("forms") >= F.col("least")) & ~F.col("shape").rlike(r"^#"))
    )
    again = parts.where(worded & ~F.col("like_title")).groupBy(*group, "part").agg(F.count_distinct("page").alias("pages")).where("pages > 1")
    headers = parts.where(F.col("like_title")).select("node_id", "line", "part")
    by_shape = parts.where(worded).join(shapes.select("shape"), "shape", "left_semi").select("node_id", "line", "part")
    stems = shapes.select(F.col("shape").alias("good"))
    fuzzy = (
        parts.where(worded & few & ~F.col("like_title") & F.contains("shape", F.lit("#")) & (F.length("shape") <= 16))
        .select("node_id", "line", "part", "shape", F.explode(_deletions("shape")).alias("key"))
        .join(stems.select("good", F.explode(_deletions("good")).alias("key")).distinct(), "key")
        .where(F.levenshtein("shape", "good", 3) >= 0)
        .select("node_id", "line", "part")
    )
    by_return = parts.where(worded).join(again.select(*group, "part"), [*group, "part"], "left_semi").select("node_id", "line", "part")
    header_rows = headers.unionAll(by_shape).unionAll(fuzzy).unionAll(by_return).distinct().withColumn("noise", F.lit("running_header"))

    explicit = F.col("style").isin("of", "slash", "page", "p", "dash", "bracket", "roman")
    lists = F.coalesce(F.col("before").rlike(r"^[0-9lOS.]+$|:$"), F.lit(False)) | F.coalesce(F.col("after").rlike(r"^[0-9lOS.]+$"), F.lit(False))
    kept = parts.where((F.col("style") == "bare") & F.col("alone")).where(F.col("offset").isNotNull()).groupBy(*group, "side", "offset").agg(F.count_distinct("page").alias("support"))
    most = kept.groupBy(*group, "side").agg(F.max(F.struct("support", (-F.abs("offset")).alias("near"), "offset")).alias("m"))
    other = parts.where(explicit & F.col("alone")).groupBy(*group).agg(F.count_distinct("node_id").alias("formal"))
    bare = parts.where((F.col("style") == "bare") & F.col("alone")).join(most, [*group, "side"], "left").join(other, group, "left")
    steady = F.coalesce(F.col("m.support") >= 2, F.lit(False))
    fits = F.coalesce(F.col("offset") == F.col("m.offset"), F.lit(False))
    loose = (F.col("rank") == 1) & ~lists & F.coalesce(F.col("formal") < 2, F.lit(True))
    bare_rows = bare.where((steady & fits) | (~fits & loose & (F.col("offset").isNull() | ~steady | F.col("part").rlike("[lOSBo]")))).select("node_id", "line", "part")
    inline = parts.where(~F.col("alone") & (F.col("style").isNotNull())).select("node_id", "line", "part")
    formal_rows = parts.where(explicit & F.col("alone")).select("node_id", "line", "part")
    number_rows = bare_rows.unionAll(inline).unionAll(formal_rows).distinct().withColumn("noise", F.lit("page_number"))
    return header_rows.unionByName(number_rows).select("node_id", "line", "noise", "part")


def _deletions(c: str) -> Column:
    """A string without each of its characters in turn, and itself: equal keys for strings one or two edits apart."""
    s = F.col(c)
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
    return F.array_distinct(F.concat(F.array(s), each))


def paragraphs(nodes: DataFrame) -> DataFrame:
    """The rows the operator reads: paragraphs with an id and a content."""
    return nodes.where((F.col("node_kind") == "paragraph") & F.col("node_id").isNotNull() & (F.length("content") > 0)).select(
        "node_id", "document_id", "parent_id", "section_path", "page", "content"
    )


def noise(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edge lines, divisions, misread places) of all paragraphs; see the functions of these names."""
    own = paragraphs(nodes)
    counts = cut_lineage(word_counts(nodes))
    edges = cut_lineage(edge_noise(own))
    split = divisions(own, counts).where("divided")
    places = misread_places(own.select("node_id", "content"), cut_lineage(corrections(counts)))
    misread = places.join(edges.select("node_id", "line").distinct(), ["node_id", "line"], "left_anti")
    return edges, split, misread


def found(nodes: DataFrame) -> DataFrame:
    """(node_id, noise), distinct. Nodes without content, ids or damage give no row; repeats of a node count once."""
    edges, split, misread = noise(nodes)
    return (
        edges.select("node_id", "noise")
        .unionAll(split.select("node_id", F.lit("hyphenation")))
        .unionAll(misread.select("node_id", F.lit("misread")))
        .distinct()
    )


def rebuild(text: str, drop: dict[int, list[str]], divided: set[tuple[str, str, str]], printed: dict[str, str]) -> str:
    """One text without its noise, each paragraph on one line, paragraphs apart by a blank line."""
    lines: list[str] = []
    for k, line in enumerate(text.split("\n")):
        if k in drop:
            rest = [p for p in re.split(r"\s{3,}", line.strip()) if p not in drop[k]]
            if not any(rest):
                continue
            line = "   ".join(rest)
        lines.append(line)
    body = "\n".join(lines)
    if divided or any(mark in body for mark in MARKS):
        body = _PARTS.sub(lambda m: m[1] + ("" if m.groups() in divided else m[2]) + m[3], body)
    blocks = re.split(r"\n[ \t]*\n|\n(?=[ \t]{2,}\S)|(?<=:)\n(?=\d)|(?<=\d)\n(?=\d+$)", body, flags=re.M)
    out = []
    for b in blocks:
        words = []
        for token in b.split():
            fixed = token
            for w in token_words(token):
                if p := printed.get(w):
                    fixed = re.sub(re.escape(w), lambda m, p=p: p.capitalize() if m[0][:1].isupper() else p, fixed, flags=re.I)
            core = fixed.strip(".,;:()")
            if core in printed and printed[core] == "":
                fixed = fixed.replace(core, core.translate(str.maketrans("lOSB", "1058")))
            words.append(fixed)
        if words:
            out.append(" ".join(words))
    return "\n\n".join(out)


def repaired(nodes: DataFrame) -> DataFrame:
    """(node_id, content): every distinct paragraph, its noise taken out; text without damage keeps its words."""
    edges, split, misread = noise(nodes)
    per = (
        edges.groupBy("node_id").agg(F.collect_set(F.struct("line", "part")).alias("edges"))
        .join(split.groupBy("node_id").agg(F.collect_set(F.struct("left", "mark", "right")).alias("split")), "node_id", "full_outer")
        .join(misread.groupBy("node_id").agg(F.collect_set(F.struct("word", F.coalesce("printed", F.lit("")).alias("printed"))).alias("misread")), "node_id", "full_outer")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                drop: dict[int, list[str]] = {}
                for e in r.edges if r.edges is not None else ():
                    drop.setdefault(e["line"], []).append(e["part"])
                divided = {(s["left"], s["mark"], s["right"]) for s in (r.split if r.split is not None else ())}
                printed = {m["word"]: m["printed"] for m in (r.misread if r.misread is not None else ())}
                out.append(rebuild(r.content, drop, divided, printed))
            yield pd.DataFrame({"node_id": pdf["node_id"], "content": pd.Series(out, dtype=object)})

    rows = paragraphs(nodes).select("node_id", "content").dropDuplicates(["node_id"]).join(per, "node_id", "left")
    return rows.mapInPandas(run, "node_id string, content string")
