"""Read-back queries over node, edge, evidence and observation frames.

Frames are passed in, so the same plans run over the store, over a fresh graph or over any table with
these columns. Where frames name a root_path, every join is held to it: equal keys of two repositories are two things.
Filters are plain conditions that reach the scan. A neighbourhood of a key filters the edges once, for both
directions. Ordering is left to the caller, as a global sort costs a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairngraph.functions import keys as K
from cairngraph.schemas import EDGE_KINDS

DIRECTIONS = ("in", "out", "both")


def roots(*frames: DataFrame) -> list[str]:
    """The root_path as a join column, if all frames have it."""
    return ["root_path"] if all("root_path" in f.columns for f in frames) else []


def equal(df: DataFrame, **values: object) -> DataFrame:
    for name, v in values.items():
        if v is not None:
            df = df.where(F.col(name) == v)
    return df


def positive_limit(n: int) -> int:
    if not isinstance(n, int) or isinstance(n, bool) or n < 1:
        raise ValueError("limit must be a positive integer")
    return n


def path_prefix_key(prefix: str) -> str:
    """A path prefix as the prefix of file keys; the whole repository for '' and '.'."""
    if prefix in ("", "."):
        return "file:"
    return K.file_key(prefix) + "/"


def canonical_nodes(nodes: DataFrame, kind: str | None = None, key: str | None = None, path_prefix: str | None = None, version: int = K.KEY_VERSION) -> DataFrame:
    if path_prefix is not None:
        if kind not in (None, "file"):
            raise ValueError("a path prefix needs kind file")
        kind = "file"
        exact = path_prefix_key(path_prefix)
        nodes = nodes.where(F.col("canonical_key").startswith(exact) | (F.col("canonical_key") == exact.rstrip("/")))
    if key is not None:
        K.parse(key)
    return equal(nodes, graph_key_version=version, kind=kind, canonical_key=key)


def canonical_edges(edges: DataFrame, kind: str | None = None, source: str | None = None, target: str | None = None, version: int = K.KEY_VERSION) -> DataFrame:
    if kind is not None and kind not in EDGE_KINDS:
        raise ValueError(f"edge kind must be one of {', '.join(EDGE_KINDS)}")
    for k in (source, target):
        if k is not None:
            K.parse(k)
    return equal(edges, graph_key_version=version, kind=kind, source_key=source, target_key=target)


def touching(edges: DataFrame, centers: DataFrame, src: str, dst: str, key: str, direction: str = "both") -> DataFrame:
    """Edges with an end in centers(key); a loop counts once."""
    if direction not in DIRECTIONS:
        raise ValueError("direction must be in, out or both")
    root = roots(edges, centers)
    c = centers.select(*root, F.col(key).alias("__center")).distinct()
    at = lambda df, end, how: df.join(c.withColumnRenamed("__center", end), [*root, end], how).select(*edges.columns)
    if direction != "both":
        return at(edges, dst if direction == "in" else src, "left_semi")
    return at(edges, src, "left_semi").unionByName(at(at(edges, dst, "left_semi"), src, "left_anti"))


def neighborhood(nodes: DataFrame, edges: DataFrame, key: str, direction: str = "both", version: int = K.KEY_VERSION) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(center, edges, neighbours without the center); no edges if there is no such node."""
    if direction not in DIRECTIONS:
        raise ValueError("direction must be in, out or both")
    center = canonical_nodes(nodes, key=key, version=version)
    out, into = F.col("source_key") == key, F.col("target_key") == key
    # The key itself is the filter, so it reaches the scan, also through an aggregation by the edge's ends.
    mine = edges.where((F.col("graph_key_version") == version) & {"out": out, "in": into, "both": out | into}[direction])
    root = roots(nodes, edges)
    known = center.select(*root, F.col("canonical_key").alias("__center")).distinct()
    near = mine.withColumn("__center", F.when(out, F.col("source_key")).otherwise(F.col("target_key"))).join(known, [*root, "__center"], "left_semi").select(*edges.columns)
    ends = near.select(*root, F.explode(F.array("source_key", "target_key")).alias("canonical_key")).where(F.col("canonical_key") != key).distinct()
    return center, near, nodes.where(F.col("graph_key_version") == version).join(ends, [*root, "canonical_key"], "left_semi").select(*nodes.columns)


def legacy_neighborhood(nodes: DataFrame, edges: DataFrame, key: str | None = None, path: str | None = None, direction: str = "both") -> tuple[DataFrame, DataFrame]:
    """(edges, nodes with the centers): of one node, or of all nodes of a file."""
    center = nodes.where(F.col("stable_key") == key) if path is None else nodes.where(F.col("path") == path)
    near = touching(edges, center, "src_key", "dst_key", "stable_key", direction).distinct()
    root = roots(nodes, edges)
    ends = near.select(*root, F.explode(F.array("src_key", "dst_key")).alias("stable_key")).union(center.select(*root, "stable_key")).distinct()
    return near, nodes.join(ends, [*root, "stable_key"], "left_semi").select(*nodes.columns)


def explain_edge(edges: DataFrame, links: DataFrame, evidence: DataFrame, raw: DataFrame, source: str, kind: str, target: str, identity_hash: str = K.EMPTY_JSON_SHA256, version: int = K.KEY_VERSION) -> DataFrame:
    """One row a root: the edge with its evidence and what was observed, in order of run, ordinal and key."""
    both = lambda *frames: [c for c in ("root_path", "run_id") if all(c in f.columns for f in frames)]
    edge = canonical_edges(edges, kind, source, target, version).where(F.col("identity_metadata_hash") == identity_hash)
    root = roots(edges, links)
    said = evidence.withColumnRenamed("metadata", "evidence_metadata")
    seen = edge.select(*root, "edge_key").join(links, [*root, "edge_key"]).join(said, ["evidence_key", *both(links, evidence)])
    on = ["ordinal", *both(seen, raw)]
    hashed = F.col("payload_hash") if "payload_hash" in raw.columns else F.lit(None).cast("string").alias("payload_hash")
    seen = seen.join(raw.select(*on, F.col("kind").alias("observed_kind"), F.col("target").alias("observed_target"), hashed), on, "left")
    run = F.col("run_id") if "run_id" in seen.columns else F.lit(1)
    item = F.struct(run.alias("run_id"), "ordinal", "evidence_key", "link_kind", "path", "start_line", "end_line", "extractor", "confidence", "evidence_metadata", "observed_kind", "observed_target", "payload_hash")
    lists = seen.groupBy(*root, "edge_key").agg(F.array_sort(F.collect_list(item)).alias("evidence"))
    return edge.join(lists, [*root, "edge_key"], "left")


def file_nodes(files: DataFrame, nodes: DataFrame, evidence: DataFrame, path: str | None = None) -> DataFrame:
    """Files with their node and every evidence row of the file."""
    root = roots(files, nodes, evidence)
    f = equal(files, path=path)
    n = nodes.where("kind = 'file'").select(*root, "path", "stable_key", F.col("name").alias("node_name"))
    e = evidence.select(*root, "path", F.col("stable_key").alias("evidence_key"), F.col("extractor").alias("evidence_extractor"), F.col("start_line").alias("evidence_start_line"))
    return f.join(n, [*root, "path"]).join(e, [*root, "path"])


def legacy_edges(nodes: DataFrame, edges: DataFrame, evidence: DataFrame, kind: str | None = None, source: str | None = None, target: str | None = None) -> DataFrame:
    root = roots(nodes, edges, evidence)
    e = equal(edges, kind=kind, src_key=source, dst_key=target)
    src = nodes.select(*root, F.col("stable_key").alias("src_key"), F.col("kind").alias("src_kind"), F.col("path").alias("src_path"))
    dst = nodes.select(*root, F.col("stable_key").alias("dst_key"), F.col("kind").alias("dst_kind"), F.col("name").alias("dst_name"))
    ev = evidence.select(*root, F.col("stable_key").alias("evidence_key"), F.col("start_line").alias("evidence_start_line"), F.col("end_line").alias("evidence_end_line"))
    return e.join(src, [*root, "src_key"]).join(dst, [*root, "dst_key"]).join(ev, [*root, "evidence_key"])


def canonical_host_mutators(edges: DataFrame, category: str | None = None, tool: str | None = None) -> DataFrame:
    target = None if category is None else K.key("host.category", category)
    out = canonical_edges(edges, "mutates_host", None, target)
    if tool is None:
        return out
    tools = F.from_json(F.get_json_object("metadata", "$.tools"), "array<string>")
    return out.where(F.coalesce(F.array_contains(tools, tool), F.lit(False)) | F.coalesce(F.get_json_object("metadata", "$.tool") == tool, F.lit(False)))


# --- search -------------------------------------------------------------------------------------------

SEARCHED = {
    "nodes": (("canonical_key", "kind", "display_name"), ("canonical_key",)),
    "observations": (("kind", "source_id", "path", "metadata"), ("-run_id", "ordinal")),
    "files": (("path", "language", "role"), ("path",)),
}


def validate_query(q: str) -> str:
    if not isinstance(q, str) or not q.strip() or len(q) > 200:
        raise ValueError("query must have 1 to 200 characters")
    return q


def validate_page(limit: int) -> int:
    if not isinstance(limit, int) or isinstance(limit, bool) or not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    return limit


def _holds(c: Column, q: str) -> Column:
    return F.coalesce(F.contains(F.lower(c), F.lit(q.lower())), F.lit(False))


def search(df: DataFrame, target: str, query: str, kind: str | None = None, path: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of matches and one row more, which tells whether others follow."""
    names, order = SEARCHED[target]
    hit = F.lit(False)
    for n in names:
        hit = hit | _holds(F.col(n), validate_query(query))
    by = [F.desc(n[1:]) if n.startswith("-") else F.asc(n) for n in order]
    return equal(df.where(hit), kind=kind, path=path).orderBy(*by).offset(offset).limit(validate_page(limit) + 1)


def page(rows: list, limit: int, offset: int) -> dict:
    """rows: what search() gave. total counts what has been seen so far, not all matches."""
    shown = rows[:limit]
    return {"rows": shown, "has_more": len(rows) > limit, "total": offset + len(shown)}
