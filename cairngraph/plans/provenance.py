"""Where observations came from: sources, their runs, feed items and references.

Thirteen provenance fields are flattened out of the metadata once. "Latest" is max_by over the time of
acquisition (ISO text, so it sorts), with rows without a time last. Correlated lists of an item are
grouped by the item's key and joined, never looked up row by row.

Ordinals count within a run, and keys within a root: links join on root, run and ordinal, nodes and edges on root and key,
as far as the frames name them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairngraph.plans.query import positive_limit, roots

FIELDS = {
    "source_id_configured": "string", "source_type": "string", "source_display_name": "string", "source_policy_status": "string", "source_run_id": "string", "source_artifact_id": "string",
    "source_artifact_path": "string", "source_artifact_sha256": "string", "source_artifact_bytes": "bigint", "source_acquired_at": "string", "acquisition_http_status": "int",
    "acquisition_content_type": "string", "acquisition_url_summary": "string",
}


def source_observations(raw: DataFrame) -> DataFrame:
    out = raw
    for n, t in FIELDS.items():
        v = F.get_json_object("metadata", f"$.{n}")
        out = out.withColumn(n, v if t == "string" else v.try_cast(t))
    return out.where("source_id_configured IS NOT NULL")


def _place(*frames: DataFrame) -> list[str]:
    """What names an observation: root, run and ordinal, as far as all frames have them."""
    return [c for c in ("root_path", "run_id", "ordinal") if all(c in f.columns for f in frames)]


def _distinct(what: Column, place: list[str]) -> Column:
    """The number of observations for which `what` holds, counted once each."""
    return F.count_distinct(F.when(what, F.struct(*place)))


def latest(c: str) -> Column:
    return F.max_by(c, F.coalesce("source_acquired_at", F.lit("")))


def sources(observed: DataFrame, source_type: str | None = None, policy_status: str | None = None, links: DataFrame | None = None, limit: int = 50) -> DataFrame:
    """A row a source (and root, if observations have one). links(place, canonical_key): with them, observations count once a
    linked node, as a join does."""
    rows = observed if source_type is None else observed.where(F.col("source_type") == source_type)
    rows = rows if policy_status is None else rows.where(F.col("source_policy_status") == policy_status)
    rows = rows.withColumn("canonical_key", F.lit(None).cast("string")) if links is None else rows.join(links, _place(observed, links), "left")
    root = roots(observed)
    return (
        rows.groupBy(*root, F.col("source_id_configured").alias("source_id"))
        .agg(
            F.min("source_type").alias("source_type"), F.min("source_display_name").alias("display_name"), F.min("source_policy_status").alias("policy_status"),
            latest("source_run_id").alias("latest_source_run_id"), latest("source_artifact_id").alias("latest_artifact_id"), latest("source_artifact_path").alias("latest_artifact_path"),
            F.max("source_acquired_at").alias("latest_acquired_at"), F.count(F.lit(1)).alias("feed_observation_count"),
            F.count_distinct(F.when(F.col("canonical_key").startswith("feed.item:"), F.col("canonical_key"))).alias("canonical_feed_item_count"),
        )
        .orderBy("source_id", *root)
        .limit(positive_limit(limit))
    )


def source_summary(observed: DataFrame, links: DataFrame, source_id: str) -> DataFrame:
    """One row, also for a source that nothing is known of; observed and links: of one root. Link and enclosure references are counted by the kind of
    their observation."""
    rows = observed.where(F.col("source_id_configured") == source_id).join(links, _place(observed, links), "left")
    place = _place(observed)
    keys = lambda k: F.count_distinct(F.when(F.col("canonical_key").startswith(f"feed.{k}:"), F.col("canonical_key")))
    refs = lambda k: _distinct(F.col("kind") == f"feed.{k}", place)
    return rows.agg(
        F.lit(source_id).alias("source_id"), F.min("source_type").alias("source_type"), F.min("source_display_name").alias("display_name"),
        F.coalesce(F.min("source_policy_status"), F.lit("unknown")).alias("policy_status"), F.min("acquisition_url_summary").alias("configured_url_summary"),
        latest("source_run_id").alias("latest_source_run_id"), latest("source_artifact_id").alias("latest_artifact_id"), latest("source_artifact_path").alias("latest_artifact_path"),
        F.max("source_acquired_at").alias("latest_acquired_at"), keys("document").alias("feed_documents"), keys("channel").alias("feed_channels"), keys("item").alias("feed_items"),
        keys("author").alias("feed_authors"), keys("category").alias("feed_categories"), refs("link").alias("link_references"), refs("enclosure").alias("enclosure_references"),
        _distinct(F.col("kind") == "feed.parse_error", place).alias("parse_errors"),
    )


def source_runs(observed: DataFrame, source_id: str, limit: int = 25) -> DataFrame:
    runs = observed.where((F.col("source_id_configured") == source_id) & F.col("source_run_id").isNotNull()).groupBy("source_run_id").agg(
        F.max("source_acquired_at").alias("acquired_at"), F.max("source_artifact_id").alias("artifact_id"), F.max("source_artifact_path").alias("artifact_path"),
        F.max("source_artifact_bytes").alias("artifact_byte_length"), F.max("source_artifact_sha256").alias("artifact_sha256"), F.max("acquisition_http_status").alias("http_status"),
        F.max("acquisition_content_type").alias("content_type"), F.count(F.lit(1)).alias("observation_count"),
        F.when(F.count_if(F.col("kind") == "feed.parse_error") > 0, F.lit("parse_errors")).otherwise(F.lit("ok")).alias("status_summary"),
    )
    return runs.orderBy(F.desc_nulls_last("acquired_at"), F.desc("source_run_id")).limit(positive_limit(limit))


def feed_items(nodes: DataFrame, edges: DataFrame, observed: DataFrame, links: DataFrame, source_id: str | None = None, source_run_id: str | None = None, limit: int | None = 50) -> DataFrame:
    """Items with their sources and the sorted targets of their links, authors and categories; latest first. limit: None for all of them."""
    seen = observed if source_id is None else observed.where(F.col("source_id_configured") == source_id)
    seen = seen if source_run_id is None else seen.where(F.col("source_run_id") == source_run_id)
    root, place = roots(nodes, edges, observed, links), _place(observed, links)
    items = nodes.where("kind = 'feed.item'").select(
        *root, "canonical_key", F.coalesce(F.get_json_object("metadata", "$.title"), "display_name").alias("title"), F.get_json_object("metadata", "$.published_at").alias("published_at"),
        F.get_json_object("metadata", "$.updated_at").alias("updated_at"),
    )
    shown = seen.join(links, place).groupBy(*root, "canonical_key").agg(F.count_distinct(F.struct(*place)).alias("evidence_count"), F.max("source_id_configured").alias("source_id"), latest("source_run_id").alias("source_run_id"))
    out = edges.where("kind = 'references'").select(*root, F.col("source_key").alias("canonical_key"), "target_key", F.substring_index("target_key", ":", 1).alias("k"))
    lists = out.groupBy(*root, "canonical_key").agg(
        F.array_sort(F.collect_set(F.when(~F.col("k").isin("feed.author", "feed.category"), F.col("target_key")))).alias("link_targets"),
        F.array_sort(F.collect_set(F.when(F.col("k") == "feed.author", F.col("target_key")))).alias("authors"),
        F.array_sort(F.collect_set(F.when(F.col("k") == "feed.category", F.col("target_key")))).alias("categories"),
    )
    key = [*root, "canonical_key"]
    found = items.join(shown, key).join(lists, key, "left").orderBy(F.desc_nulls_last("published_at"), *reversed(key))
    return found if limit is None else found.limit(positive_limit(limit))


def explain_item(nodes: DataFrame, edges: DataFrame, observed: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """One feed item (a row a root) with its lists and `evidence`: the observations that tell of it, in order of run and ordinal."""
    root, place = roots(nodes, edges, observed, links), _place(observed, links)
    item = feed_items(nodes.where(F.col("canonical_key") == key), edges.where(F.col("source_key") == key), observed, links.where(F.col("canonical_key") == key), limit=1000)
    told = F.struct(*(c for c in place if c != "root_path"), "kind", "source_id", "path", "confidence", "extractor", "source_run_id", "source_artifact_path")
    seen = observed.join(links.where(F.col("canonical_key") == key).distinct(), place).groupBy(*root, "canonical_key").agg(F.array_sort(F.collect_list(told)).alias("evidence"))
    return item.join(seen, [*root, "canonical_key"], "left")


def references(edges: DataFrame, links: DataFrame, observed: DataFrame, source_id: str | None = None, target_kind: str | None = None, limit: int = 50) -> DataFrame:
    """Reference edges out of feed items; links(place, edge_key)."""
    e = edges.where("kind = 'references'").where(F.col("source_key").startswith("feed.item:"))
    e = e if target_kind is None else e.where(F.split("target_key", ":")[0] == target_kind)
    seen = observed if source_id is None else observed.where(F.col("source_id_configured") == source_id)
    root, place = roots(edges, links, observed), _place(observed, links)
    got = e.select(*root, "edge_key", "source_key", "target_key").join(links, [*root, "edge_key"]).join(seen.select(*place, "source_id_configured", "source_run_id"), place)
    shown = got.select(*root, "source_key", "target_key", F.split("target_key", ":")[0].alias("target_kind"), "source_id_configured", "source_run_id").distinct()
    return shown.orderBy("source_key", "target_key", *root, "source_run_id").limit(positive_limit(limit))


def refresh_status(graphs: DataFrame, repositories: DataFrame, runs: DataFrame, nodes: DataFrame, edges: DataFrame, raw: DataFrame) -> DataFrame:
    """A row a configured graph(graph_id, repository_name): its latest run and counts, matched by the repository's name."""
    repo = repositories.select(F.col("name").alias("repository_name"), "root_path")
    last = runs.groupBy("root_path").agg(F.max_by(F.struct("run_id", "status", "git_commit", "finished_at"), "run_id").alias("r")).select("root_path", "r.*")
    n = lambda df, name: df.groupBy("root_path").agg(F.count(F.lit(1)).alias(name))
    out = graphs.join(repo, "repository_name", "left").join(last, "root_path", "left")
    for df, name in ((raw, "raw_observations"), (nodes, "canonical_nodes"), (edges, "canonical_edges")):
        out = out.join(n(df, name), "root_path", "left")
    stamp = F.date_format("finished_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return out.select("graph_id", "repository_name", "root_path", "run_id", "status", "git_commit", stamp.alias("finished_at"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("raw_observations", "canonical_nodes", "canonical_edges")))
