"""Look-alike text: one form, equal for what looks equal."""

import itertools

from mossbrook.llm import lookalike as L
from tests.conftest import rows


def test_forms():
    same = ["BRT-2069", "ＢＲＴ－２０６９", "ΒRТ‑2069", "BR​T-20­69", "BRT‐2069 "]
    assert {L.one_form(x) for x in same} == {"BRT-2069"}
    assert L.one_form("Zäzofi") == L.one_form("Zäzofi") != L.one_form("Zazofi")
    assert L.one_form("a b　c") == "a b c" and L.one_form("ﬁne") == "fine" and L.one_form("µ-x") == "μ-x"
    assert L.one_form("Abc") != L.one_form("abc") and L.one_form("STRASSE", True) == L.one_form("Straße", True)
    assert L.one_form("x²") != L.one_form("x2") and L.one_form("vavotro-α") != L.one_form("vavotro-a")
    assert L.one_form(None) is None and L.one_form("​﻿") == "" and L.one_form("") == ""
    assert L.one_form("中文 字") == "中文 字"


def test_idempotent_and_long():
    for x in ["é" * 2000, "‮" + "ａ" * 50_000, "😀‍👩"]:
        assert L.one_form(L.one_form(x)) == L.one_form(x)


def test_pairs_equal_brute_force(spark):
    mentions = [("m8", "x  y"), ("m9", "x y"), ("m1", "аbс"), ("m2", "abc"), ("m3", "abc"), ("m3", "аbc"), ("m4", "ABC"), ("m5", None), (None, "abc"), ("m6", " "), ("m7", "x y"), ("m1", "аbс")]
    concepts = [("b1", "abc", ["zz"]), ("b2", None, ["аbc", "x y"]), ("b3", "q", None), ("b4", "ａbc", []), ("b1", "abc", ["zz"])]
    m = L.value_rows(spark.createDataFrame(mentions, "match_id string, mention string"), "match_id", ["mention"], [])
    c = L.value_rows(spark.createDataFrame(concepts, "bios_id string, preferred_term string, terms array<string>"), "bios_id", ["preferred_term"], ["terms"])
    values = {}
    for i, v in mentions:
        if i and v and v.strip():
            values.setdefault(i, set()).add(v)
    names = {}
    for i, p, ts in concepts:
        names.setdefault(i, set()).update(v for v in [p, *(ts or [])] if v)
    want = set()
    for (a, va), (b, vb) in itertools.chain(itertools.product(values.items(), names.items()), itertools.combinations(names.items(), 2)):
        if not va & vb and {L.one_form(x, keep_runs=True) for x in va} & {L.one_form(x, keep_runs=True) for x in vb}:
            want.add(tuple(sorted((a, b))))
    assert set(rows(L.same_look_pairs(m, c))) == want and want
    assert L.same_look_pairs(m.limit(0), c.limit(0)).count() == 0


def test_distinct_values_once(spark):
    d = spark.createDataFrame([("ａ",)] * 50 + [(None,)], "v string")
    assert {r[0] for r in d.select(L.look("v")).collect()} == {"a", None}
    assert {r[0] for r in spark.createDataFrame([("ÀB",)], "v string").select(L.canonical("v")).collect()} == {"àb"}
