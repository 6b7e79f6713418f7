"""The evidence graph of the star-schema tables: every dimension row a node, every foreign key a
`references` edge, every event an observation. The same views exist as DuckDB SQL (CTES), so that the
graph's plans can be compared with an independent engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairngraph.functions.keys import EMPTY_JSON_SHA256, KEY_VERSION, edge_key_col

#: table: (key column, name column)
DIMENSIONS = {
    "region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name"), "customer": ("c_custkey", "c_name"), "supplier": ("s_suppkey", "s_name"), "part": ("p_partkey", "p_name"),
    "orders": ("o_orderkey", "o_orderpriority"),
}
#: (table, its key, referenced table, foreign key)
FOREIGN_KEYS = (
    ("nation", "n_nationkey", "region", "n_regionkey"), ("customer", "c_custkey", "nation", "c_nationkey"), ("supplier", "s_suppkey", "nation", "s_nationkey"),
    ("orders", "o_orderkey", "customer", "o_custkey"), ("lineitem", "l_orderkey", "orders", "l_orderkey"), ("lineitem", "l_orderkey", "part", "l_partkey"), ("lineitem", "l_orderkey", "supplier", "l_suppkey"),
)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(table: str, c: str) -> Column:
    return F.concat(F.lit(f"external:{table}:"), F.col(c).cast("string"))


def _confidence(c: str) -> Column:
    return F.when(F.col(c) % 3 == 0, F.lit("heuristic")).when(F.col(c) % 3 == 1, F.lit("extracted")).otherwise(F.lit("manual"))


def nodes(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] = tuple(DIMENSIONS)) -> DataFrame:
    out = None
    for t in tables:
        k, n = DIMENSIONS[t]
        one = _t(spark, sf_dir, t).select(
            F.lit(KEY_VERSION).alias("graph_key_version"), _key(t, k).alias("canonical_key"), F.lit(t).alias("kind"), F.col(n).alias("display_name"), F.lit("{}").alias("metadata"),
            _confidence(k).alias("confidence"), (F.col(k) % 4 + 1).cast("long").alias("run_id"),
        )
        out = one if out is None else out.unionAll(one)
    return out


def edge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every observed reference; equal ones are not merged yet."""
    out = None
    for t, k, to, fk in FOREIGN_KEYS:
        source = "orders" if t == "lineitem" else t
        rows = _t(spark, sf_dir, t)
        if fk == k:
            continue
        one = rows.select(_key(source, k).alias("source_key"), F.lit("references").alias("kind"), _key(to, fk).alias("target_key"), _confidence(fk).alias("confidence"), (F.col(fk) % 4 + 1).cast("long").alias("run_id"))
        out = one if out is None else out.unionAll(one)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an edge: strongest confidence, first and last run, number of observations."""
    rank = F.when(F.col("confidence") == "manual", 3).when(F.col("confidence") == "extracted", 2).when(F.col("confidence") == "heuristic", 1).otherwise(0)
    merged = edge_rows(spark, sf_dir).groupBy("source_key", "kind", "target_key").agg(
        F.max(rank).alias("r"), F.min("run_id").alias("first_seen_run_id"), F.max("run_id").alias("last_seen_run_id"), F.count(F.lit(1)).alias("evidence_count")
    )
    return merged.select(
        F.lit(KEY_VERSION).alias("graph_key_version"), edge_key_col(F.col("source_key"), F.col("kind"), F.col("target_key")).alias("edge_key"), "source_key", "kind", "target_key",
        F.lit(EMPTY_JSON_SHA256).alias("identity_metadata_hash"), F.lit("{}").alias("metadata"),
        F.get(F.array(*(F.lit(c) for c in ("unknown", "heuristic", "extracted", "manual"))), F.col("r")).alias("confidence"), "first_seen_run_id", "last_seen_run_id", "evidence_count",
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the observation envelope, with provenance in the metadata."""
    e = _t(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    metadata = F.concat(
        F.lit('{"k":'), F.get_json_object("props", "$.k"), F.lit(',"source_acquired_at":"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit('","source_id_configured":"user-'),
        user, F.lit('","source_run_id":"run-'), F.date_format("ts", "yyyyMMdd"), F.lit('","source_type":"'), F.when(F.col("user_id") % 2 == 0, F.lit("feed")).otherwise(F.lit("api")), F.lit('"}'),
    )
    return e.select(
        F.lit(1).cast("long").alias("run_id"), F.col("event_id").alias("ordinal"), F.concat(F.lit("event."), F.col("event_type")).alias("kind"),
        F.concat(F.lit("user/"), user, F.lit("#"), F.col("event_id").cast("string")).alias("source_id"), F.concat(F.lit("user/"), user).alias("path"), _confidence("event_id").alias("confidence"),
        F.lit("events").alias("extractor"), F.lit("1").alias("extractor_version"), F.lit(1).alias("schema_version"), F.lit(None).cast("int").alias("start_line"),
        F.lit(None).cast("int").alias("end_line"), F.col("event_type").alias("name"), F.concat(F.lit("external:event_type:"), F.col("event_type")).alias("target"), metadata.alias("metadata"),
    )


# --- the same in DuckDB SQL -------------------------------------------------------------------------------

_CASE = "CASE WHEN {0} % 3 = 0 THEN 'heuristic' WHEN {0} % 3 = 1 THEN 'extracted' ELSE 'manual' END"
_NODES = " UNION ALL ".join(
    f"SELECT 'external:{t}:' || {k} AS canonical_key, '{t}' AS kind, {n} AS display_name, {_CASE.format(k)} AS confidence, ({k} % 4 + 1)::BIGINT AS run_id FROM {t}" for t, (k, n) in DIMENSIONS.items()
)
_EDGE_ROWS = " UNION ALL ".join(
    f"SELECT 'external:{'orders' if t == 'lineitem' else t}:' || {k} AS source_key, 'references' AS kind, 'external:{to}:' || {fk} AS target_key, {_CASE.format(fk)} AS confidence, ({fk} % 4 + 1)::BIGINT AS run_id FROM {t}"
    for t, k, to, fk in FOREIGN_KEYS
    if k != fk
)
_RANK = "CASE confidence WHEN 'manual' THEN 3 WHEN 'extracted' THEN 2 WHEN 'heuristic' THEN 1 ELSE 0 END"
_BODY = (
    "'{\"graph_key_version\":1,\"identity_metadata\":{},\"kind\":\"' || kind || '\",\"source_key\":\"' || source_key || '\",\"target_key\":\"' || target_key || '\"}'"
)
CTES = {
    "n": f"n AS ({_NODES})",
    "er": f"er AS ({_EDGE_ROWS})",
    "e": f"e AS (SELECT 'canonical-edge:' || sha256({_BODY}) AS edge_key, source_key, kind, target_key, ['unknown', 'heuristic', 'extracted', 'manual'][max({_RANK}) + 1] AS confidence,"
    " min(run_id) AS first_seen_run_id, max(run_id) AS last_seen_run_id, count(*) AS evidence_count FROM er GROUP BY source_key, kind, target_key)",
    "o": "o AS (SELECT event_id AS ordinal, 'event.' || event_type AS kind, 'user/' || user_id || '#' || event_id AS source_id, 'user/' || user_id AS path, "
    f"{_CASE.format('event_id')} AS confidence, event_type AS name, 'external:event_type:' || event_type AS target, json_extract_string(props, '$.k')::INT AS k,"
    " strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS acquired_at, 'user-' || user_id AS source, 'run-' || strftime(ts, '%Y%m%d') AS source_run_id,"
    " CASE WHEN user_id % 2 = 0 THEN 'feed' ELSE 'api' END AS source_type FROM events)",
}


def with_ctes(query: str, *names: str) -> str:
    return "WITH " + ", ".join(CTES[n] for n in names) + " " + query
