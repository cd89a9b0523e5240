"""Leakage: the seed filters lose nothing, the alignment finds edited copies."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from mossbrook.llm import leakage as K
from tests.conftest import rows

RNG = random.Random(5)
VOCABULARY = [f"w{i}" for i in range(4000)]
PASSAGE = [RNG.choice(VOCABULARY) for _ in range(60)]


def altered(words, every):
    return [f"zz{i}" if every and i % every == every - 1 else w for i, w in enumerate(words)]


@settings(max_examples=60, deadline=None)
@given(st.integers(25, 60), st.data())
def test_seed_counts_are_guaranteed(n, data):
    start = data.draw(st.integers(0, 60 - n))
    part = PASSAGE[start : start + n]
    for i in data.draw(st.sets(st.integers(0, n - 1), max_size=n // 10)):
        part[i] = f"q{i}"
    own = set(zip(*[PASSAGE[k:] for k in range(K.GRAM)]))
    hits = [i for i, g in enumerate(zip(*[part[k:] for k in range(K.GRAM)])) if g in own]
    assert len(hits) >= K.MIN_SEEDS
    assert min(b - a for a, b in zip(hits, hits[K.NEAR_SEEDS - 1 :])) < K.NEAR_WORDS


def test_alignment():
    h = lambda ws: K._hashes(ws)
    text = ["pad"] * 20 + altered(PASSAGE, 10) + ["pad"] * 9
    span, bad, at_a, at_b, _ = K.align(h(PASSAGE), h(text))
    assert span >= 58 and bad <= 6 and at_b - at_a == 20
    assert K.align(h(PASSAGE), h(PASSAGE[10:34]))[0] == 24
    dropped = PASSAGE[:20] + PASSAGE[21:40] + ["new"] + PASSAGE[40:]
    assert K.align(h(PASSAGE), h(dropped))[:2] == (60, 2)
    assert K.align(h(PASSAGE), h(altered(PASSAGE, 4)))[0] < K.MIN_WORDS
    assert K.align(h([]), h(PASSAGE)) == (0, 0, 0, 0, 0)
    assert K.grams(np.empty(0, np.uint64)).size == 0


def test_leaks(spark):
    say = " ".join
    quoted = "> " + "\n> ".join(say(PASSAGE[i : i + 8]) for i in range(0, 60, 8))
    looks = say(w.replace("w", "ｗ") + "​" for w in PASSAGE).upper()
    noise = say(RNG.choice(VOCABULARY) for _ in range(3000))
    docs = [(1, say(PASSAGE)), (2, f"{noise} {say(altered(PASSAGE[:40], 11))} {noise}"), (3, say(PASSAGE[:24])), (4, quoted), (5, looks), (6, noise), (7, None), (8, ""), (9, say(altered(PASSAGE, 5))), (1, say(PASSAGE)), (10, say(PASSAGE[30:55]))]
    items = [(100, say(PASSAGE) + "\nWhat? (A) yes"), (101, say(PASSAGE).upper() + ".\nWhy?"), (102, "too short\nQ"), (103, None), (None, say(PASSAGE)), (104, say(RNG.choice(VOCABULARY) for _ in range(30)))]
    d = spark.createDataFrame([(a, b, 0) for a, b in docs], "doc_id long, text string, item_id int")
    i = spark.createDataFrame([(a, b, 0) for a, b in items], "item_id long, text string, doc_id int")
    got = rows(K.leaks(d, i).select("doc_id", "item_id"))
    assert got == sorted(((x, y) for x in (1, 2, 4, 5, 10) for y in (100, 101)), key=repr)
    assert K.leaks(d.limit(0), i).count() == 0 and K.leaks(d, i.limit(0)).count() == 0


def test_whole_text_of_a_long_document(spark):
    long = " ".join(RNG.choice(VOCABULARY) for _ in range(120_000)) + " " + " ".join(PASSAGE)
    d = spark.createDataFrame([(1, long)], "doc_id long, text string")
    i = spark.createDataFrame([(7, " ".join(PASSAGE) + "\n?")], "item_id long, text string")
    assert rows(K.leaks(d, i).select("doc_id", "item_id")) == [(1, 7)]


def test_clean_part_beside_a_loose_copy(spark):
    """The best alignment holds no stretch; another one of the same document and passage does. Han characters are words."""
    rng = random.Random(9)
    passage = [rng.choice(VOCABULARY) for _ in range(120)]
    loose = altered(passage, 5)
    han = "".join(chr(0x4E00 + i) for i in rng.sample(range(4000), 40))
    texts = [loose + ["pad"] * 300 + passage[40:70], passage[40:70] + ["pad"] * 9 + loose, loose[:60] + passage[10:40] + loose[60:], loose]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)] + [(9, han[:30])], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(passage) + "\n?"), (8, han + "\n?")], "item_id long, text string")
    got = rows(K.leaks(docs, items).select("doc_id", "item_id", "span"))
    assert [r[:2] for r in got] == [(0, 7), (1, 7), (2, 7), (9, 8)] and min(r[2] for r in got) >= 30
