"""A corpus pipeline over `documents`: five stages, each written as Parquet and read again by the next.

language_id drops documents whose language the model cannot tell; near_dedup keeps one document of each
SimHash component (the least doc_id); decontamination drops documents that hold a benchmark window;
secret_scan replaces every secret by a mark (n_chars follows); packing cuts what remains into sequences.
Each stage works on all rows that its predecessor kept. ORACLE_SQL is None: SQL cannot express the
language model, the fingerprints' hash or the tokeniser, so tests compare with a brute-force version.

Defined cases: a null text or one without letters has no language and goes with the first stage; rows are told apart by id
and text, so repeated and null ids stay unless their text does not; of equal rows one stays; texts of any length are
read whole; other columns pass through all stages but the last, whatever they are called; without documents, or
without labelled ones, nothing is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairngraph.llm import decontaminate, language_id, packing, secret_scan, simhash
from cairngraph.llm.common import drop, table, written


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.with_known_language(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = secret_scan.without_secrets(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("secret_scan", secret_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, at = written(stage(spark, docs, sf_dir), name)
        if before:
            drop(spark, before)  # the stage that read it is written
        before = at
    return STAGES[-1][1](spark, docs, sf_dir)
