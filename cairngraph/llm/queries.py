"""The registered queries of the corpus operators: each applies its operator, with production
parameters, to its whole table and derives the contract's columns from the operator's output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairngraph.llm import ball_kmeans, decontaminate, language_id, license_scan, oracles, packing, pii, quality, secret_scan, simhash, substring_dedup, token_alignment, url_filter, warc
from cairngraph.llm.common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.repetition(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.col("words").alias("n_words"), "word_chars", F.col("symbols").alias("n_symbols"), F.col("dup_lines").alias("n_dup_lines"),
        F.col("repeat_words").alias("n_repeat_words"), "base_failed", "kept", "dup_line_chars", *(f"chars_{k}" for k in quality.COVERAGE_LIMITS),
    )


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.licenses(table(spark, sf_dir, "documents"))
    labels = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.first").alias("first_word"), F.array_max("base.first").alias("last_word"),
        labels(F.col("base.label")).alias("base_labels"), labels(F.concat("base.label", "matches.label")).alias("labels"), "score",
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymised(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("entities", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = F.array_join(F.transform("entities", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return found.select("doc_id", F.size("entities").cast("long").alias("n_entities"), *(count(k) for k in pii.KINDS), spans.alias("spans"), F.col("new_text").alias("text"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", decontaminate.items_digest().alias("items_sha256"), "contaminated")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"].isin([r.kind for r in secret_scan.RULES if r.base]))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(secret_scan.listed(base), 256).alias("base_sha256"), secret_scan.listed(F.col("spans")).alias("spans")
    )


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.predictions(docs, language_id.trained(docs))
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return url_filter.judged(table(spark, sf_dir, "pages"), outcomes)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    # A revisit holds no payload: what it states counts; a response's is computed from what was read.
    told = lambda stated, read: F.when(F.col("type") == "revisit", F.col(stated)).otherwise(F.col(read))
    size, digest = told("stated_bytes", "bytes"), told("stated_digest", "digest")
    return found.select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), F.col("type").alias("record_type"), "refers_to", "intact")


def op11_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ball_kmeans.clustered(table(spark, sf_dir, "embeddings"))
    listed = F.array_join(F.transform("centroid", lambda x: x.cast("string")), ",")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(listed, 256).alias("centroid_sha256"), "members")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality, op2_licenses, op3_simhash, op4_pii, op5_decontamination, op6_secrets, op7_language, op8_packing, op9_urls, op10_warc, op11_substrings, op12_clusters, op13_alignment)
}
SQL: dict[str, str] = dict(oracles.SQL)
