"""Continuous loading: JSON lines that arrive in a folder become runs of a store.

Each micro-batch is one run: foreachBatch hands its rows to the same writer as a batch load, whose last write commits.
A batch that is tried again after a failure is recognised by its id and not loaded twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairngraph.plans.store import Store
from cairngraph.schemas import OBSERVATION, SCHEMA_VERSION
from cairngraph.sources.numbering import numbered_by
from cairngraph.sources.observations import REQUIRED, canonical_metadata, problem

_ENVELOPE = "kind string, source_id string, path string, confidence string, extractor string, extractor_version string, schema_version int, start_line int, end_line int, name string, target string"


def observation_stream(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """Valid observations of the lines of new files; a bad line is left out (problem_stream has it)."""
    return _parsed(spark, folder, max_files).where("problem IS NULL").drop("problem", "raw")


def problem_stream(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    return _parsed(spark, folder, max_files).where("problem IS NOT NULL").select("file", "raw", "problem")


def _parsed(spark: SparkSession, folder: str, max_files: int) -> DataFrame:
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(folder).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw")).where(F.trim("raw") != "")
    e = lines.withColumn("e", F.from_json("raw", _ENVELOPE)).withColumn("metadata", canonical_metadata("raw"))
    wrong = F.coalesce(problem(F.col("e")), F.when(F.col("metadata").isNull(), F.lit("metadata must be an object")))
    return e.select("file", "raw", "e.*", "metadata", wrong.alias("problem"))


def load_stream(stream: DataFrame, store: Store, name: str, root_path: str, checkpoint: str) -> StreamingQuery:
    """Loads every micro-batch as a run whose commit names the batch."""

    def load(batch: DataFrame, batch_id: int) -> None:
        mark = f"batch-{batch_id}"
        done = store.rows("runs").where((F.col("root_path") == root_path) & (F.col("git_commit") == mark)).limit(1).count()
        if done or batch.limit(1).count() == 0:
            return
        # Ordinals follow file and content, so that a repeated batch numbers its rows alike.
        full = numbered_by(batch, "file", "source_id", "metadata").select(
            F.lit(0).cast("long").alias("run_id"), "ordinal", *REQUIRED, F.coalesce("schema_version", F.lit(SCHEMA_VERSION)).alias("schema_version"), "start_line", "end_line", "name", "target", "metadata"
        )
        store.load_canonical(full.select(*OBSERVATION.names), name, root_path, mark)

    return stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kind_counts(stream: DataFrame, seconds: int = 60) -> DataFrame:
    """Observations by kind and window of arrival, with a watermark so that state stays bounded."""
    timed = stream.withColumn("arrived", F.current_timestamp())
    return timed.withWatermark("arrived", f"{seconds} seconds").groupBy(F.window("arrived", f"{seconds} seconds"), "kind").agg(F.count(F.lit(1)).alias("n"))
