"""Scan repair: what was damaged on purpose is found and undone, what wasn't is left alone."""

import random

import pytest

from mossbrook.llm import ocr as R
from tests.conftest import rows

RNG = random.Random(2)
WORDS = "sustained reduction behind improvement moderate patients with treatment received baseline severe condition measured outcome transient exposure clearance stability half life long term study".split()
TITLE = "Sustained reduction of kestatiromab in renal sarcoma"
SCHEMA = "node_id string, document_id string, parent_id string, node_kind string, section_path string, page int, content string, noise string"


def text(n, seed):
    r = random.Random(seed)
    return [r.choice(WORDS) for _ in range(n)]


def lines(words, width=8):
    return [" ".join(words[i : i + width]) for i in range(0, len(words), width)]


@pytest.fixture(scope="module")
def nodes(spark):
    out = [(f"c{d}-{k}", f"doc{d}", f"sec{d}", "paragraph", f"Other title {d}", k, " ".join(text(60, d * 99 + k)) + ".", "x") for d in range(8) for k in range(12)]
    for d in range(6):
        for p in range(1, 5):
            head = TITLE.upper()[:40] if p % 2 else f"Annex B{100 + d}"
            out.append((f"s{d}-{p}", f"scan{d}", f"scansec{d}", "paragraph", f"{TITLE} / Scan", p, "\n".join([head, *lines(text(40, d * 7 + p)), f"- {p + 2} -"]), "x"))
    body = lines(text(40, 1))
    extra = [
        ("h1", "the improve-\nment was seen"), ("h2", "of long-\nterm study and half-\nlife"), ("h3", "stab­\nility of code TBM-\n7080 here"), ("m1", "behmd the severc conclition\n" + body[0]), ("m2", "p = 0.1 and 2O7 of l5 patients\n" + body[1]),
        ("ok", "Dose levels:\n10\n20\n5\nmoderate exposure\nand codes D770 XKV-680"), ("e1", ""), ("e2", None), ("long", " ".join(text(30_000, 5))), ("l2", "moderate outcome\nwith exposure\nDose levels:\n80\n160"),
    ]
    out += [(i, "misc", "miscsec", "paragraph", "Misc study", 1, t, "x") for i, t in extra]
    out += [("h1", "misc", "miscsec", "paragraph", "Misc study", 1, extra[0][1], "x"), (None, "misc", None, "paragraph", None, None, "behmd it", "x"), ("t1", "misc", None, "table", None, None, "behmd | it", "x")]
    return spark.createDataFrame(out, SCHEMA)


@pytest.fixture(scope="module")
def got(nodes):
    out = {}
    for n, k in rows(R.found(nodes)):
        out.setdefault(n, set()).add(k)
    return out


def test_kinds(got):
    assert got["h1"] == {"hyphenation"} and got["h3"] == {"hyphenation"} and "h2" not in got
    assert got["m1"] == {"misread"} and got["m2"] == {"misread"}
    for d in range(6):
        for p in range(1, 5):
            assert got[f"s{d}-{p}"] == {"running_header", "page_number"}
    assert not any(k[0] == "c" or k in ("ok", "e1", "e2", "long", "l2", "t1", None) for k in got)


def test_repair(nodes):
    out = {r["node_id"]: r["content"] for r in R.repaired(nodes).collect()}
    assert out["h1"] == "the improvement was seen" and out["h2"] == "of long-term study and half-life" and out["h3"] == "stability of code TBM-7080 here"
    assert out["m1"].startswith("behind the severe condition ") and out["m2"].startswith("p = 0.1 and 207 of 15 patients")
    assert out["s0-1"] == " ".join(text(40, 1)) and out["s1-2"] == " ".join(text(40, 9))
    assert out["ok"].split() == "Dose levels: 10 20 5 moderate exposure and codes D770 XKV-680".split()
    assert out["long"] == " ".join(text(30_000, 5)) and "e1" not in out and len(out) == len(set(out))


def test_empty(nodes):
    assert R.found(nodes.limit(0)).count() == 0 and R.repaired(nodes.limit(0)).count() == 0


def test_corrections_equal_brute_force(spark):
    counts = {w: 50 for w in WORDS} | {"behmd": 2, "severc": 1, "conclition": 1, "cxposurc": 1, "wi†h": 1, "tbe": 1, "the": 90, "rnoderate": 30, "odd": 1, "a-b": 5, "12": 9}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = {}
    for w, n in counts.items():
        ok = [(m, p) for p in R._spellings(w) if (m := counts.get(p, 0)) >= R.RATIO * n and p != w and m >= R.RATIO and "-" not in w and not w.isdigit() and (len(p) >= 4 or any(c in w for c in "0123456789!†"))]
        if ok:
            want[w] = max(ok)[1]
    assert dict(rows(R.corrections(df))) == want
    assert {"behmd", "severc", "conclition", "cxposurc", "wi†h"} <= set(want) and "rnoderate" not in want


def test_anagram_differences():
    for a, b in R.CONFUSIONS:
        assert R.anagram("x" + b + "y") + R.anagram(a) - R.anagram(b) == R.anagram("x" + a + "y")


def test_long_runs_are_read_once_and_whole():
    """A run of 400,000 unbroken characters costs no more than its length, and its words count."""
    import time

    run = "Ab-" * 100_000 + "x" * 100_000
    began = time.perf_counter()
    assert R.rebuild(run + "\nimprove-\nment", {}, {("improve", "-", "ment")}, {}) == run + " improvement"
    assert R._BREAK.sub(" ", run + "-\nb end") == "  end"
    assert time.perf_counter() - began < 5
    assert R.token_words("Zestabra/Stadaflu-Xy") == ["zestabra", "stadaflu", "xy", "stadaflu-xy"]
    assert R.token_words("中" * 200 + "qqb-4208" + "文" * 90) == ["qqb", "4208", "qqb-4208"]
    assert "".join(R.token_words("y" * 250)[:4]) == "y" * 250


def test_generated_pages_come_back(spark):
    """Pages with divided words, headers and numbers added by rule come out as the text they were made of."""
    r = random.Random(11)
    clean, rows_ = {}, []
    for d in range(12):
        for p in range(1, 6):
            words = text(60, 1000 + d * 50 + p)
            out, k = [], 0
            while k < len(words):
                line = words[k : k + 8]
                k += 8
                if k < len(words) and len(line[-1]) > 7 and r.random() < 0.5:
                    out.append(" ".join(line[:-1] + [line[-1][:4] + "-"]))
                    words[k : k + 1] = [line[-1][4:], words[k]]
                else:
                    out.append(" ".join(line))
            clean[f"g{d}-{p}"] = " ".join(text(60, 1000 + d * 50 + p))
            rows_.append((f"g{d}-{p}", f"gen{d}", f"gensec{d}", "paragraph", f"{TITLE} / Scan", p, "\n".join([TITLE[:44], *out, f"Page {p + 4}"]), "x"))
    rows_ += [(f"plain{i}", "plain", "plainsec", "paragraph", "Plain", i, " ".join(text(80, 5000 + i)), "x") for i in range(20)]
    got = {x["node_id"]: x["content"] for x in R.repaired(spark.createDataFrame(rows_, SCHEMA)).collect()}
    same = sum(got[n] == t for n, t in clean.items())
    assert same >= 0.95 * len(clean), [(got[n], t) for n, t in clean.items() if got[n] != t][:2]
