"""The normalised graph: one node and evidence row an observation, an edge where it has a target; the
last writer of a key wins, and rows keep the place of the first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def node_key() -> Column:
    return F.concat(F.lit("node:"), F.col("path"), F.lit(":"), F.col("kind"), F.lit(":"), F.col("source_id"))


def evidence_key() -> Column:
    line = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    return F.concat(F.lit("evidence:"), F.col("path"), F.lit(":"), line("start_line"), F.lit("-"), line("end_line"), F.lit(":"), F.col("extractor"), F.lit(":"), F.col("source_id"))


def edge_key() -> Column:
    return F.concat(F.lit("edge:"), node_key(), F.lit(":"), F.col("kind"), F.lit(":"), F.col("target"))


def target_kind(t: Column) -> Column:
    """What stands before the first colon, else `target`."""
    return F.when(F.instr(t, ":") > 1, F.substring_index(t, ":", 1)).otherwise(F.lit("target"))


def target_name(t: Column) -> Column:
    rest = F.regexp_extract(t, r"(?s)^[^:]*:(.+)$", 1)
    return F.when(rest != "", rest).otherwise(t)


def last_wins(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key, with `position`: where the key was first seen."""
    rest = [c for c in rows.columns if c not in keys]
    done = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r"), F.min(order).alias("position"))
    return done.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest), "position")


@dataclass
class Normalized:
    nodes: DataFrame
    edges: DataFrame
    evidence: DataFrame


def normalize(observations: DataFrame) -> Normalized:
    at = F.col("ordinal")
    nodes = observations.select(node_key().alias("stable_key"), "kind", F.coalesce("name", "source_id").alias("name"), "path", "start_line", "end_line", "metadata", "ordinal")
    raw_id = F.to_json(F.struct(F.col("source_id").alias("raw_source_id")))
    evidence = observations.select(evidence_key().alias("stable_key"), "path", "start_line", "end_line", "extractor", "extractor_version", raw_id.alias("metadata"), "ordinal")
    edges = observations.where("target IS NOT NULL").select(
        edge_key().alias("stable_key"), node_key().alias("src_key"), F.col("target").alias("dst_key"), "kind", "confidence", evidence_key().alias("evidence_key"), F.lit("{}").alias("metadata"), "ordinal"
    )
    one = lambda df: last_wins(df, ["stable_key"], at).drop("ordinal")
    return Normalized(one(nodes), one(edges), one(evidence))


def _text(name: str, default: str | None = None) -> Column:
    v = F.get_json_object("metadata", f"$.{name}")
    return v if default is None else F.when(F.trim(v) != "", v).otherwise(F.lit(default))


def files(observations: DataFrame) -> DataFrame:
    """Projection of `file` observations, the last of each path."""
    rows = observations.where("kind = 'file'").select(
        "path", _text("language", "unknown").alias("language"), _text("role", "unknown").alias("role"), "confidence", _text("content_hash").alias("content_hash"),
        F.coalesce(_text("executable") == "true", F.lit(False)).alias("executable"), F.coalesce(_text("generated") == "true", F.lit(False)).alias("generated"), "metadata", "ordinal",
    )
    return last_wins(rows, ["path"], F.col("ordinal")).drop("ordinal", "position")


def matching(files_: DataFrame, role: str | None = None, language: str | None = None, generated: str = "include") -> DataFrame:
    """generated: include, exclude or only."""
    if generated not in ("include", "exclude", "only"):
        raise ValueError("generated must be include, exclude or only")
    out = files_ if role is None else files_.where(F.col("role") == role)
    out = out if language is None else out.where(F.col("language") == language)
    return out if generated == "include" else out.where(F.col("generated") == (generated == "only"))


def entrypoints(files_: DataFrame) -> DataFrame:
    return files_.where("role = 'entrypoint'")


def relationships(observations: DataFrame) -> DataFrame:
    """Rows with a target that are no files: source node, target node, edge and evidence in one."""
    t = F.col("target")
    return observations.where("kind <> 'file' AND target IS NOT NULL").select(
        "path", node_key().alias("src_key"), F.col("kind").alias("src_kind"), F.coalesce("name", "source_id").alias("src_name"), "start_line", "end_line", F.col("metadata").alias("src_metadata"),
        t.alias("dst_key"), target_kind(t).alias("dst_kind"), target_name(t).alias("dst_name"), edge_key().alias("edge_key"), F.col("kind").alias("edge_kind"), "confidence",
        evidence_key().alias("evidence_key"), "extractor", "extractor_version", "ordinal",
    )


def host_mutators(observations: DataFrame, category: str | None = None, tool: str | None = None) -> DataFrame:
    rows = observations.where("kind = 'shell.host_mutation'").select(
        "path", F.coalesce("start_line", F.lit(0)).alias("line"), F.coalesce("name", "source_id").alias("name"), _text("category", "unknown").alias("category"), _text("tool", "unknown").alias("tool"),
        _text("reason", "unknown").alias("reason"), F.coalesce(_text("privileged") == "true", F.lit(False)).alias("privileged"), F.from_json(_text("argv"), "array<string>").alias("argv"), "confidence",
    )
    rows = rows if category is None else rows.where(F.col("category") == category)
    return rows if tool is None else rows.where(F.col("tool") == tool)


def host_mutator_summary(mutators: DataFrame) -> DataFrame:
    return mutators.groupBy("category", "tool").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("privileged").cast("long")).alias("privileged"))
