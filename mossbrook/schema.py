"""Table schemas, fixed constants and ``conform``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values that results depend on.
RRF_K = 60
GRAPH_WEIGHT = 0.5
IDF_FLOOR = 0.1
DEPTH_DECAY = 0.85
RELATION_DECAY = {"narrower": 0.8, "broader": 0.7, "has_target": 0.65, "targeted_by": 0.55, "treats": 0.65, "treated_by": 0.55}
OTHER_DECAY = 0.5
PRUNE_BELOW = 0.1
SCOPE_WEIGHT = {"EXACT": 1.0, "NARROW": 0.8, "BROAD": 0.0, "RELATED": 0.0}
NGRAM_FLOOR = 0.60
RULE_FACTOR = 0.95
AMBIGUITY_MARGIN = 0.08
PRIOR_CAP = 0.55
CHUNK_CHARS = 600
TABLE_BYTES, TABLE_LEAST = 6000, 512
DEDUPE_LEAST = 60
MERGE_STEP, MERGE_CAP = 0.05, 0.97
LOW_CONFIDENCE = 0.60
SPREAD = 0.10
P0_FROM, P1_FROM = 5, 2
CLIQUE_CONFIDENCE = 0.9
ACCURACY_FLOOR, REGRESSION_MOST = 0.90, 0.02
SIGNIFICANCE_RESAMPLES, SIGNIFICANCE_SEED = 10_000, 20240501
SAMPLING_SEED = 20260801
RESTORE_CHARS, RESTORE_JOINT = 8000, 2
SNIPPET_CHARS = 300

#: Columns of the lake's tables, as DDL.
TABLES: dict[str, str] = {
    "documents": "doc_id string, source_id string, title string, doc_type string, license_tier string, language string, corpus_version string, ingested_at string",
    "evidence_chunks": "chunk_id string, document_id string, text string, section_path string, page int, sort_order int, modality string, release string, concept_ids array<string>, labels array<string>",
    "knowledge_claims": "claim_id string, document_id string, subject_id string, predicate string, object_id string, object_value string, claim_status string, confidence double, evidence_ids array<string>",
    "obs_tool_io": "trace_id string, tool string, input_json string, output_json string, event_ts string, event_date string",
    "obs_decision": "decision_id string, trace_id string, step int, stage string, chosen string, confidence double, candidates_json string, event_ts string, event_date string",
    "obs_span": "span_id string, parent_id string, trace_id string, name string, start_ts string, end_ts string, event_date string",
    "er_observations": "observation_id string, mention string, mention_key string, status string, source string, kind_hint string, trace_id string, event_ts string, event_date string",
    "ingest_quarantine": "doc_id string, plane string, reason string, first_seen string, last_seen string, replay_count int, state string",
}


def conform(df: DataFrame, schema: str | T.StructType) -> DataFrame:
    """The declared columns only, cast and in order; those that are missing come as null."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
#: Levels a heading can have.
HEADING_LEVELS = range(1, 10)
