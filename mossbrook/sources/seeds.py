"""Seeds, corpora, ambiguity and taxonomy files: small YAML or JSON documents that people edit, as DataFrames."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    import yaml
except ImportError:
    yaml = None

SEED = "key string, preferred_label_en string, preferred_label_zh string, parents array<string>, targets array<string>, indications array<string>, aliases array<struct<raw:string,lang:string,scope:string>>"
SENSES = "alias string, concept_key string, prior double, cues array<string>"
TAXONOMY = "label_id string, dimension string, label_en string, label_zh string, keywords_en array<string>, keywords_zh array<string>"
DOCUMENT = "doc_id string, source_id string, external_id string, title string, doc_type string, published_on string, language string, license_tier string, sections array<struct<name:string,page:int,text:string>>, tables array<struct<table_id:string,caption:string,page:int,header:array<string>,rows:array<array<string>>>>"
LIMIT = 64 << 20


def document(path: str) -> dict:
    """A file that a person edits, in whole; over 64 MB it's no such file and an error. YAML needs its library, JSON doesn't."""
    p = Path(path)
    if p.stat().st_size > LIMIT:
        raise ValueError(f"{path} is too large to be edited by hand")
    text = p.read_text("utf-8")
    if p.suffix in (".yaml", ".yml"):
        if yaml is None:
            raise ImportError("reading YAML needs its library; give JSON instead")
        return yaml.safe_load(text) or {}
    return json.loads(text or "{}")


def _frame(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    lines = spark.createDataFrame([(json.dumps(r, ensure_ascii=False),) for r in rows], "line string")
    return lines.select(F.from_json("line", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def seed(spark: SparkSession, path: str) -> DataFrame:
    """Concepts of a seed file with their links; a key given twice is an error."""
    doc = document(path)
    keys = [c["key"] for c in doc.get("concepts", [])]
    if len(keys) != len(set(keys)):
        raise ValueError(f"{path}: a key is given twice")
    return _frame(spark, doc.get("concepts", []), SEED).withColumn("entity_type", F.lit(doc.get("entity_type")))


def senses(spark: SparkSession, path: str) -> DataFrame:
    """(alias, concept_key, prior, cues) of an ambiguity registry."""
    rows = [{"alias": a["alias"], "concept_key": s["concept_key"], "prior": s.get("prior", 0.0), "cues": s.get("context_cues", [])} for a in document(path).get("aliases", []) for s in a["senses"]]
    return _frame(spark, rows, SENSES)


def taxonomy(spark: SparkSession, path: str) -> DataFrame:
    return _frame(spark, document(path).get("labels", []), TAXONOMY)


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a corpus file; a field of another type is an error."""
    doc = document(path)
    return _frame(spark, doc.get("documents", []), DOCUMENT).withColumn("corpus_version", F.lit(doc.get("corpus_version")))


def links(concepts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, unresolved): (child, predicate, parent) by keys, and the references that no concept has."""
    from mossbrook.operators.world import resolve_keys

    ids = concepts.select(F.col("key").alias("ref"), F.col("key").alias("id"))
    edges, open_ = None, None
    for column, predicate in (("parents", "broader"), ("targets", "has_target"), ("indications", "treats")):
        ok, bad = resolve_keys(concepts, "key", column, ids)
        ok, bad = ok.select(F.col("key").alias("child"), F.lit(predicate).alias("predicate"), F.col("id").alias("parent")), bad.withColumn("predicate", F.lit(predicate))
        edges, open_ = (ok, bad) if edges is None else (edges.unionByName(ok), open_.unionByName(bad))
    return edges, open_
