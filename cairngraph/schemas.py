"""Schemas of the tables and the values their columns may take."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}


def struct(text: str) -> T.StructType:
    """A flat schema from `name type, name type`; needs no session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (f.split() for f in text.split(","))])


SCHEMA_VERSION = 1
CONFIDENCE = ("unknown", "heuristic", "extracted", "manual")  # weakest first
EDGE_KINDS = ("executes", "sources", "reads_env", "writes_env", "mutates_host", "defines", "imports", "exposes_script", "links_to", "references", "styles", "depends_on", "wraps", "tests")
RUN_STATUS = ("running", "complete", "failed")

OBSERVATION = struct(
    "run_id bigint, ordinal bigint, kind string, source_id string, path string, confidence string, extractor string, extractor_version string,"
    " schema_version int, start_line int, end_line int, name string, target string, metadata string"
)

TABLES = {
    name: struct(ddl)
    for name, ddl in {
        "repositories": "name string, root_path string, remote_url string, created_at timestamp, run_id bigint",
        "runs": "run_id bigint, root_path string, git_commit string, started_at timestamp, finished_at timestamp, status string, tool_versions string",
        "raw_observations": "root_path string, run_id bigint, ordinal bigint, schema_version int, kind string, source_id string, path string, confidence string,"
        " extractor string, extractor_version string, start_line int, end_line int, name string, target string, metadata string, payload_hash string",
        "files": "root_path string, run_id bigint, path string, language string, role string, content_hash string, executable boolean, generated boolean, metadata string, seq bigint",
        "nodes": "root_path string, run_id bigint, stable_key string, kind string, name string, path string, start_line int, end_line int, metadata string, seq bigint",
        "evidence": "root_path string, run_id bigint, stable_key string, path string, start_line int, end_line int, excerpt string, extractor string, metadata string, seq bigint",
        "edges": "root_path string, run_id bigint, stable_key string, kind string, src_key string, dst_key string, confidence string, evidence_key string, metadata string, seq bigint",
        "canonical_nodes": "root_path string, run_id bigint, graph_key_version int, canonical_key string, kind string, display_name string, metadata string, confidence string, conflict boolean",
        "canonical_edges": "root_path string, run_id bigint, graph_key_version int, edge_key string, source_key string, kind string, target_key string,"
        " identity_metadata_hash string, metadata string, confidence string, conflict boolean",
        "canonical_evidence": "root_path string, run_id bigint, graph_key_version int, evidence_key string, ordinal bigint, raw_schema_version int, raw_kind string,"
        " raw_source_id string, path string, start_line int, end_line int, extractor string, extractor_version string, confidence string, metadata string",
        "canonical_node_evidence": "root_path string, run_id bigint, canonical_key string, evidence_key string, link_kind string",
        "canonical_edge_evidence": "root_path string, run_id bigint, edge_key string, evidence_key string, link_kind string",
        "diagnostics": "root_path string, run_id bigint, ordinal bigint, severity string, category string, message string, raw_source_id string, path string, field string, value string, placeholder_key string",
    }.items()
}
