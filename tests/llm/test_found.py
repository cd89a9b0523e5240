"""The pN_ queries over whole test tables."""

import os

import pytest

from mossbrook.llm import queries as Q
from tests.oracle import DIR, duck, table

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")

COLUMNS = {
    "p1_found": ["node_id", "noise"], "p3_found": ["node_id"], "p4_found": ["id_1", "id_2"], "p5_found": ["match_id", "bios_id"], "p6_found": ["doc_id", "item_id"], "p8_found": ["doc_id", "category"],
}


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, name):
    got = Q.QUERIES[name](spark, DIR).toPandas()
    if name in COLUMNS:
        assert list(got.columns) == COLUMNS[name] and not got.duplicated().any() and len(got)
    if name in Q.ORACLES:
        assert table(got) == table(duck(Q.ORACLES[name]))


def test_every_mention_is_answered(spark):
    got = Q.QUERIES["p5_found"](spark, DIR).toPandas()
    want = duck("SELECT count(DISTINCT match_id) AS n FROM zingg_matches WHERE trim(mention) <> ''")["n"][0]
    assert len(got) == want == got["match_id"].nunique()


def test_every_document_is_scored(spark):
    assert Q.QUERIES["p8_scores"](spark, DIR).count() == spark.read.parquet(f"{DIR}/documents.parquet").count()
