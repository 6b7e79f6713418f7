"""The observation envelope as JSON lines: reading, checking and writing.

Reading keeps the file's order as `ordinal`: a file of any size is read by ranges, lines are numbered within
their range, ranges one after another in their file, and files by their path. The first bad line of a range makes the read fail,
with its number; `problems()` gives all of them as rows instead.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairngraph.functions.keys import canonical_json
from cairngraph.schemas import CONFIDENCE, OBSERVATION, SCHEMA_VERSION
from cairngraph.sources.numbering import firsts

_ENVELOPE = (
    "kind string, source_id string, path string, confidence string, extractor string, extractor_version string, schema_version int,"
    " start_line int, end_line int, name string, target string"
)
REQUIRED = ("kind", "source_id", "path", "confidence", "extractor", "extractor_version")


@F.pandas_udf(T.StringType())
def canonical_metadata(raw: pd.Series) -> pd.Series:
    """The `metadata` object of a JSON line in canonical form; null if it is no object."""

    def one(line: str | None) -> str | None:
        try:
            value = json.loads(line).get("metadata", {})
        except (ValueError, AttributeError, TypeError):
            return None
        return canonical_json(value) if isinstance(value, dict) else None

    return raw.map(one)


def problem(c: Column) -> Column:
    """What is wrong with a parsed envelope, or null."""
    blank = lambda n: F.coalesce(F.trim(c[n]) == "", F.lit(True))
    lines = (
        F.when(c["start_line"].isNull() != c["end_line"].isNull(), F.lit("start_line and end_line must be given together"))
        .when(c["start_line"] < 1, F.lit("start_line must be at least 1"))
        .when(c["end_line"] < c["start_line"], F.lit("end_line must not be before start_line"))
    )
    found = F.when(c["kind"].isNull() & c["path"].isNull() & c["source_id"].isNull(), F.lit("not an observation object"))
    for n in REQUIRED:
        found = found.when(blank(n), F.lit(f"{n} is required"))
    return (
        found.when(~c["confidence"].isin(*CONFIDENCE), F.lit("confidence is not known"))
        .when(F.coalesce(c["schema_version"], F.lit(SCHEMA_VERSION)) != SCHEMA_VERSION, F.lit("schema_version is not supported"))
        .otherwise(lines)
    )


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, place (the file and the range of it that a task reads, in their order), at (grows within a place) and raw of every line."""
    text = spark.read.option("lineSep", "\n").text(path)
    file, begin = F.col("_metadata.file_path"), F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0")
    return text.select(file.alias("file"), F.concat(file, F.lit("\0"), begin).alias("place"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r$", "").alias("raw"))


def _told() -> Column:
    return F.trim("raw") != ""


def parsed(rows: DataFrame) -> DataFrame:
    """rows(raw, ...) with the envelope's columns, metadata and problem (null for blank lines) in place of raw."""
    e = rows.withColumn("e", F.from_json("raw", _ENVELOPE)).withColumn("metadata", canonical_metadata("raw")).withColumn("told", _told())
    e = e.withColumn("problem", F.when(F.col("told"), F.coalesce(problem(F.col("e")), F.when(F.col("metadata").isNull(), F.lit("metadata must be an object")))))
    return e.select(*(c for c in rows.columns if c != "raw"), "told", "e.*", "metadata", "problem")


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """All lines that are not blank, parsed, with `line` (from 1, in the file) and `ordinal` (from 0, without blank lines, by file and line).

    Lines are counted within their place, and the places' sizes are told by the bare text, which is not parsed for that."""
    bare = lines(spark, path)
    sizes = bare.groupBy("file", "place").agg(F.count(F.lit(1)).alias("lines"), F.count_if(_told()).alias("n"))
    before = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)  # a row a place
    begun = sizes.select("place", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("lines")).join(firsts(sizes, "place", bare), "place")
    within = Window.partitionBy("place").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    own = parsed(bare).withColumns({"i": F.count(F.lit(1)).over(within), "k": F.count_if("told").over(within) - 1}).where("told")
    # Every place has a row there; a left join keeps the order of the lines, so that the first bad one of a place is told of.
    return own.join(begun, "place", "left").withColumns({"line": F.col("lines") + F.col("i"), "ordinal": (F.col("first") + F.col("k")).cast("long")})


def problems(spark: SparkSession, path: str) -> DataFrame:
    return numbered(spark, path).where("problem IS NOT NULL").select("file", "line", "problem")


def read_jsonl(spark: SparkSession, path: str, run_id: int = 1) -> DataFrame:
    """Observations with ordinals from 0, in the order of the files' paths and lines."""
    placed = numbered(spark, path).withColumn("ok", F.assert_true(F.col("problem").isNull(), F.concat(F.lit("line "), F.col("line"), F.lit(": "), F.col("problem"))))
    return placed.where(F.col("ok").isNull()).select(
        F.lit(run_id).cast("long").alias("run_id"), "ordinal", *(F.col(n) for n in REQUIRED), F.coalesce("schema_version", F.lit(SCHEMA_VERSION)).alias("schema_version"), "start_line", "end_line", "name", "target", "metadata",
    ).select(*OBSERVATION.names)


def payload(o: dict) -> dict:
    """The observation as an object: optional fields that are null are left out."""
    body = {n: o[n] for n in (*REQUIRED, "schema_version")}
    body |= {n: o[n] for n in ("start_line", "end_line", "name", "target") if o[n] is not None and o[n] == o[n]}
    return body | {"metadata": json.loads(o["metadata"] or "{}")}


_PAYLOAD = [*REQUIRED, "schema_version", "start_line", "end_line", "name", "target", "metadata"]


@F.pandas_udf(T.StringType())
def payload_json(rows: pd.DataFrame) -> pd.Series:
    """Canonical JSON of an observation given as a struct."""

    def one(o: dict) -> str:
        for n in ("start_line", "end_line", "schema_version"):
            o[n] = None if o[n] is None or o[n] != o[n] else int(o[n])
        return canonical_json(payload(o))

    columns = (rows[n].tolist() for n in _PAYLOAD)
    return pd.Series([one(dict(zip(_PAYLOAD, values, strict=True))) for values in zip(*columns, strict=True)], dtype=object)


def with_payload_hash(observations: DataFrame) -> DataFrame:
    return observations.withColumn("payload_hash", F.sha2(payload_json(F.struct(*_PAYLOAD)), 256))


def write_jsonl(observations: DataFrame, path: str) -> None:
    """A line an observation, keys sorted; ranges of ordinals a file, so that names sort like ordinals."""
    observations.repartitionByRange("ordinal").sortWithinPartitions("ordinal").select(payload_json(F.struct(*_PAYLOAD)).alias("value")).write.text(path)


def from_rows(spark: SparkSession, rows: Iterator[dict], run_id: int = 1) -> DataFrame:
    """Observations of a small list of objects (fixtures, command line)."""
    full = []
    for i, o in enumerate(rows):
        full.append((run_id, i, *(o.get(n) for n in REQUIRED), o.get("schema_version", SCHEMA_VERSION), o.get("start_line"), o.get("end_line"), o.get("name"), o.get("target"), canonical_json(o.get("metadata", {}))))
    return spark.createDataFrame(full, OBSERVATION)
