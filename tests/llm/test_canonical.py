"""Canonical list: the join finds what comparing with every term finds."""

import random
import string

import pytest

from mossbrook.llm import canonical as C
from tests.conftest import rows

LIST = [
    ("b1", "crepobra kinase 3", ["crepobra kinase 3", "CERK3", "crepobra-γ"], 1), ("b2", "crepobra kinase 2", ["crepobra kinase type II"], 1), ("b3", "mucinous hepatic dystrophy", ["dystrophy, mucinous hepatic", "MHDT"], 1),
    ("b4", "zofafiquarin", ["zofafiquarin mesylate", "GGF-9758", "Bageboex"], 1), ("b5", None, ["sclerosing renal tumour"], 1), ("b6", "贝格达美单抗", None, 1), ("b4", "zofafiquarin", ["zofafiquarin mesylate", "GGF-9758", "Bageboex"], 2),
    ("b7", "mucinous adrenal dystrophy", [], 1), (None, "nothing", [], 1), ("b8", "ｆｉｇｒｉｔｅｌｉｔｒｅｘ", ["", None], 1),
]
CASES = {
    "Crepobra  kinase 3": "b1", "cerk3": "b1", "crepobra kinase type III": "b1", "human crepobra kinase 2 (target)": "b2", "crepobra kniase 2": "b2", "crepobra kinase 4": "UNMATCHED", "crepobra ligase 3": "b1?", "CERK2": "UNMATCHED",
    "hepatic dystrophy mucinous": "b3", "mucnous hepatic dystrohpy pts": "b3", "mucinous renal dystrophy": "UNMATCHED", "mucinous dystrophy": "UNMATCHED", "zofafiquarin 200 mg": "b4", "zofafquarin mesylate": "b4", "zofafiquarin mesylat salt": "b4",
    "GGF 9758": "b4", "ggf9758 arm": "b4", "GGF-9759": "UNMATCHED", "sclerosing-renal-tumour": "b5", "贝格达美单抗": "b6", "unknown": "UNMATCHED", "-": "UNMATCHED", "tablets": "UNMATCHED", "Вageboех": "b4", "figritelitrex": "b8", "x" * 5000: "UNMATCHED",
}


@pytest.fixture(scope="module")
def concepts(spark):
    return spark.createDataFrame(LIST, "bios_id string, preferred_term string, terms array<string>, match_id int")


def test_cases(spark, concepts):
    names = [k for k, v in CASES.items() if not v.endswith("?")]
    data = [(f"m{i}", n, 0.1, "x") for i, n in enumerate(names)] + [("n1", None, 1.0, None), ("n2", "  ", 1.0, None), (None, "zofafiquarin", 1.0, None), ("m0", names[0], 0.9, "y")]
    m = spark.createDataFrame(data, "match_id string, mention string, score double, bios_id string")
    got = {r["match_id"]: r["bios_id"] for r in C.map_mentions(m, concepts).collect()}
    assert {n: got[f"m{i}"] for i, n in enumerate(names)} == {n: CASES[n] for n in names}
    assert len(got) == len(names)


def test_empty(spark, concepts):
    m = spark.createDataFrame([("m", "zofafiquarin")], "match_id string, mention string")
    assert C.map_mentions(m.limit(0), concepts).count() == 0
    assert rows(C.map_mentions(m, concepts.limit(0)).select("match_id", "bios_id")) == [("m", "UNMATCHED")]


def test_join_equals_all_pairs(spark):
    rng = random.Random(11)
    names = ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randrange(5, 22))) for _ in range(60)]
    terms = spark.createDataFrame([(f"b{i:02}", [n], []) for i, n in enumerate(names)], "bios_id string, terms array<string>, preferred array<string>").selectExpr("bios_id", "terms", "cast(null as string) as preferred_term")

    def damage(w):
        for _ in range(rng.randrange(3)):
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(string.ascii_lowercase) + w[i:], w[:i] + w[i : i + 2][::-1] + w[i + 2 :]])
        return w

    typed = sorted({damage(rng.choice(names)) for _ in range(150)})
    m = spark.createDataFrame([(t, t) for t in typed], "match_id string, mention string")
    got = {r["match_id"]: (r["bios_id"], r["edits"]) for r in C.map_mentions(m, terms).collect()}

    def grams(w):
        return {f"#{w}#"[i : i + 3] for i in range(len(w))}

    def allowed(n):
        return 0 if n <= 4 else 1 if n <= 7 else 2 if n <= 24 else 3

    for t in typed:
        core = " ".join(C.core(t)[0])
        best = []
        for i, n in enumerate(names):
            a, b = grams(core), grams(n)
            if core and len(a & b) >= max(max(len(a), len(b)) - C.SPOILED * allowed(min(len(a), len(b))), 1):
                d = C.distance([core], [n], {core} & set(names))
                if d >= 0:
                    best.append((d, -len(a & b) / len(a | b), f"b{i:02}"))
        assert got[t][0] == (min(best)[2] if best else "UNMATCHED"), t


def test_edits():
    assert C._edits("abcd", "abdc", 2) == 1 and C._edits("abc", "xyz", 1) == 2 and C._edits("", "", 0) == 0
    assert C.distance(["ligase"], ["kinase"], {"ligase"}) == -1
