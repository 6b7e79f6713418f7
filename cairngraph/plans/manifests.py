"""Manifests of source runs beside the store's runs: what was planned and what was loaded, in one answer.

A manifest is published whole or not at all, as a file named by its content, so publishing it again changes nothing. Of several
manifests of one source run the last published counts. A source run that has no manifest, and a manifest that no loaded run
names, are told of, not dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairngraph.functions.keys import canonical_json
from cairngraph.plans.store import Store
from cairngraph.plans.summary import meta

#: Kinds of sources, and the member by which manifests and observations name a run of one.
RUN_NAMES = {"bulk": "bulk_run_id", "api": "api_run_id"}
_MANIFEST = (
    "kind string, root_path string, body struct<source_id: string, bulk_run_id: string, api_run_id: string, extractor_counts: map<string, bigint>, diagnostic_counts: map<string, bigint>,"
    " total_bytes_included: bigint, total_bytes: bigint, limit_hit: boolean>"
)


def publish(store: Store, kind: str, root_path: str, manifest: Mapping) -> str:
    """The manifest's name in the store."""
    if kind not in RUN_NAMES or not isinstance(manifest.get(RUN_NAMES[kind]), str):
        raise ValueError("a manifest names its kind and its run")
    text = canonical_json({"kind": kind, "root_path": root_path, "body": dict(manifest)})
    name = hashlib.sha256(text.encode()).hexdigest()
    if not store.has(f"_manifests/{name}.json"):
        store.write_text(f"_manifests/{name}.json", text)
    return name


def manifests(store: Store) -> DataFrame:
    """The last manifest of every source run: kind, root_path, source_id, source_run_id, included_files, skipped_files, total_bytes, limit_hit."""
    if not store.names("_manifests"):
        published = store.spark.createDataFrame([], f"{_MANIFEST}, at timestamp, name string")
    else:
        # Names that begin with an underscore are hidden from a folder's listing, not from a pattern.
        text = store.spark.read.text(f"{store.base}/_manifests/*.json", wholetext=True)
        published = text.select(F.from_json("value", _MANIFEST).alias("m"), F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_name").alias("name")).select("m.*", "at", "name")
    published = published if store.root_path is None else published.where(F.col("root_path") == store.root_path)
    sums = lambda c: F.coalesce(F.aggregate(F.map_values(c), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))
    rows = published.select(
        "kind", "root_path", "body.source_id", F.coalesce("body.bulk_run_id", "body.api_run_id").alias("source_run_id"), sums("body.extractor_counts").alias("included_files"), sums("body.diagnostic_counts").alias("skipped_files"),
        F.coalesce("body.total_bytes_included", "body.total_bytes", F.lit(0).cast("long")).alias("total_bytes"), F.coalesce("body.limit_hit", F.lit(False)).alias("limit_hit"), "at", "name",
    )
    keys = ["kind", "root_path", "source_run_id"]
    rest = [c for c in rows.columns if c not in (*keys, "at", "name")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("at", "name")).alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def ledger(store: Store) -> DataFrame:
    """A row a source run, planned or loaded: what its manifest says, how many observations the last run of the store that names it
    holds, and its state: complete, manifest_only or run_only."""
    named = F.coalesce(*(F.when(meta(n).isNotNull(), F.struct(F.lit(k).alias("kind"), meta(n).alias("id"))) for k, n in RUN_NAMES.items()))
    seen = store.rows("raw_observations").withColumn("source", named).where("source.id IS NOT NULL")
    each = seen.groupBy(F.col("source.kind").alias("kind"), "root_path", F.col("source.id").alias("source_run_id"), "run_id").agg(F.count(F.lit(1)).alias("n"))
    loaded = each.groupBy("kind", "root_path", "source_run_id").agg(F.max_by("n", "run_id").alias("observations"), F.max("run_id").alias("run_id"))
    both = manifests(store).withColumn("planned", F.lit(True)).join(loaded, ["kind", "root_path", "source_run_id"], "full")
    state = F.when(F.col("planned").isNull(), F.lit("run_only")).when(F.col("run_id").isNull(), F.lit("manifest_only")).otherwise(F.lit("complete"))
    return both.withColumn("state", state).drop("planned")


def summary(store: Store) -> DataFrame:
    """One row over the ledger."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c)
    of = lambda s: F.count_if(F.col("state") == s).alias(s)
    return ledger(store).agg(
        F.count(F.lit(1)).alias("source_runs"), F.count_distinct("source_id").alias("sources"), of("complete"), of("manifest_only"), of("run_only"), total("observations"), total("included_files"), total("skipped_files"), total("total_bytes"), F.count_if("limit_hit").alias("limit_hits")
    )
