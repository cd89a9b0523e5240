"""Whole tables and whole structures: the hot document, long cycles and paths."""

import os

import pytest

from mossbrook.operators import corpus as C
from mossbrook.operators import graph as G
from mossbrook.plans import registry
from tests.conftest import rows
from tests.oracle import DIR


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", ["section_ranges", "section_range_assign", "asof_section", "heading_parents", "heading_levels_repaired"])
def test_dossier_is_in(spark, name):
    assert registry.QUERIES[name](spark, DIR).where("document_id like 'DOC:DOSSIER%'").count() > 0


def test_many_headings_against_brute_force(spark):
    s = [("DOC:DOSSIER", i, 1 + (i * i + i // 3) % 4, 1 + i // 2) for i in range(200)] + [("d", 0, 4, 1), ("d", 1, 4, 2)]
    df = spark.createDataFrame(s, "document_id string, ordinal long, level int, start_page int")
    level, parent = [], []
    for doc in ("DOC:DOSSIER", "d"):
        before, last = [], 0
        for _, o, lv, _ in (x for x in s if x[0] == doc):
            last = max(1, min(lv, last + 1))
            level.append((doc, o, last))
            parent.append((doc, o, next((p for p, q in reversed(before) if q < lv), None)))
            before.append((o, lv))
    assert rows(C.repaired_levels(df)) == sorted(level, key=repr) and rows(C.parent_by_level(df)) == sorted(parent, key=repr)


def test_long_cycles_are_reported(spark, tmp_path):
    """A cycle of nine concepts through the query, and all of a path of 22 steps."""
    names = [f"c{i}" for i in range(9)]
    spark.createDataFrame([(c, [names[(i + 1) % 9]], None) for i, c in enumerate(names)], "concept_id string, consider array<string>, replaced_by string").write.parquet(f"{tmp_path}/concept_ids.parquet")
    assert rows(registry.QUERIES["hierarchy_cycles"](spark, str(tmp_path))) == [(c,) for c in names]
    path = spark.createDataFrame([(i, i + 1) for i in range(22)], "parent int, child int").coalesce(1)
    assert G.descendants(spark.createDataFrame([(0,)], "root int"), path).count() == 23
