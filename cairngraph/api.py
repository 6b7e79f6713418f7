"""Named read-only operations over a store: what the command line and the RPC server offer.

Each operation is a function of (store, arguments) that returns a DataFrame; adapters only render rows. All take a
root_path, which holds them to one repository; without it the repositories stand side by side, never joined.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairngraph.functions.keys import canonical_json
from cairngraph.operators.base import redact_url, secret_name
from cairngraph.plans import legacy, manifests, ops, provenance, query, summary
from cairngraph.plans.store import Store

Operation = Callable[[Store, Mapping], DataFrame]


def _limit(a: Mapping, default: int) -> int | None:
    """The number of rows asked for; None, if that is what is asked for, is all of them."""
    n = a.get("limit", default)
    return None if n is None else int(n)


def _links(store: Store, edges: bool = False) -> DataFrame:
    """(root_path, run_id, ordinal, canonical_key or edge_key) of evidence."""
    table, key = ("canonical_edge_evidence", "edge_key") if edges else ("canonical_node_evidence", "canonical_key")
    on = ["root_path", "run_id", "evidence_key"]
    return store.rows(table).join(store.rows("canonical_evidence").select(*on, "ordinal"), on).select("root_path", "run_id", "ordinal", key).distinct()


def _observed(store: Store) -> DataFrame:
    return provenance.source_observations(store.rows("raw_observations"))


def _neighborhood(store: Store, a: Mapping) -> DataFrame:
    center, near, others = query.neighborhood(store.current("canonical_nodes"), store.current("canonical_edges"), a["node"], a.get("direction", "both"))
    node = lambda df, what: df.select("root_path", F.lit(what).alias("what"), F.col("canonical_key").alias("key"), "kind", F.col("display_name").alias("name"), F.lit(None).cast("string").alias("source_key"), F.lit(None).cast("string").alias("target_key"), "confidence")
    edge = near.select("root_path", F.lit("edge").alias("what"), F.col("edge_key").alias("key"), "kind", F.lit(None).cast("string").alias("name"), "source_key", "target_key", "confidence")
    return node(center, "center").unionByName(edge).unionByName(node(others, "node"))


def _legacy_neighborhood(store: Store, a: Mapping) -> DataFrame:
    near, nodes = query.legacy_neighborhood(store.current("nodes"), store.current("edges"), a.get("node"), a.get("path"), a.get("direction", "both"))
    e = near.select("root_path", F.lit("edge").alias("what"), F.col("stable_key").alias("key"), "kind", F.col("src_key").alias("source_key"), F.col("dst_key").alias("target_key"))
    return e.unionByName(nodes.select("root_path", F.lit("node").alias("what"), F.col("stable_key").alias("key"), "kind", F.lit(None).cast("string").alias("source_key"), F.lit(None).cast("string").alias("target_key")))


def _search(target: str, table: str) -> Operation:
    def run(store: Store, a: Mapping) -> DataFrame:
        df = store.rows(table) if table == "raw_observations" else store.current(table)
        return query.search(df, target, a["query"], a.get("kind"), a.get("path"), int(a.get("limit", 20)), int(a.get("offset", 0)))

    return run


def _summary(name: str) -> Operation:
    return lambda store, a: summary.summarize(name, store.rows("raw_observations"), store.current("canonical_nodes"), store.current("canonical_edges"))


def _host_mutators(store: Store, a: Mapping) -> DataFrame:
    return legacy.host_mutators(store.rows("raw_observations"), a.get("category"), a.get("tool")).distinct()


def _scoped(operation: Operation) -> Operation:
    return lambda store, a: operation(store.at(a.get("root_path")), a)


_OPERATIONS: dict[str, Operation] = {
    "files": lambda s, a: legacy.matching(s.current("files"), a.get("role"), a.get("language"), a.get("generated", "include")).orderBy("path"),
    "entrypoints": lambda s, a: legacy.entrypoints(s.current("files")).orderBy("path"),
    "file-nodes": lambda s, a: query.file_nodes(s.current("files"), s.current("nodes"), s.current("evidence"), a.get("path")),
    "nodes": lambda s, a: query.equal(s.current("nodes"), kind=a.get("kind"), path=a.get("path"), stable_key=a.get("key")).orderBy("stable_key"),
    "edges": lambda s, a: query.legacy_edges(s.current("nodes"), s.current("edges"), s.current("evidence"), a.get("kind"), a.get("source"), a.get("target")).orderBy("kind", "stable_key"),
    "neighborhood": _legacy_neighborhood,
    "file-neighborhood": _legacy_neighborhood,
    "canonical-nodes": lambda s, a: query.canonical_nodes(s.current("canonical_nodes"), a.get("kind"), a.get("key"), a.get("path_prefix")).orderBy("canonical_key"),
    "canonical-edges": lambda s, a: query.canonical_edges(s.current("canonical_edges"), a.get("kind"), a.get("source"), a.get("target")).orderBy("source_key", "kind", "target_key"),
    "canonical-neighborhood": _neighborhood,
    "explain-canonical-edge": lambda s, a: query.explain_edge(s.current("canonical_edges"), s.rows("canonical_edge_evidence"), s.rows("canonical_evidence"), s.rows("raw_observations"), a["source"], a["kind"], a["target"]),
    "host-mutators": _host_mutators,
    "host-mutators-summary": lambda s, a: legacy.host_mutator_summary(_host_mutators(s, a)).orderBy("category", "tool"),
    "canonical-host-mutators": lambda s, a: query.canonical_host_mutators(s.current("canonical_edges"), a.get("category"), a.get("tool")),
    "summary": lambda s, a: summary.storage(s),
    "canonical-summary": lambda s, a: summary.canonical_storage(s),
    **{f"{n.replace('_', '-')}-summary": _summary(n) for n in summary.SUMMARIES},
    "ingested-sources": lambda s, a: provenance.sources(_observed(s), a.get("source_type"), a.get("policy_status"), _links(s), int(a.get("limit", 50))),
    "source-summary": lambda s, a: provenance.source_summary(_observed(s), _links(s), a["source_id"]),
    "source-runs": lambda s, a: provenance.source_runs(_observed(s), a["source_id"], int(a.get("limit", 25))),
    "source-feed-items": lambda s, a: provenance.feed_items(s.current("canonical_nodes"), s.current("canonical_edges"), _observed(s), _links(s), a.get("source_id"), a.get("source_run_id"), _limit(a, 50)),
    "explain-source-feed-item": lambda s, a: provenance.explain_item(s.current("canonical_nodes"), s.current("canonical_edges"), _observed(s), _links(s), a["item"]),
    "source-references": lambda s, a: provenance.references(s.current("canonical_edges"), _links(s, True), _observed(s), a.get("source_id"), a.get("target_kind"), int(a.get("limit", 50))),
    "search-nodes": _search("nodes", "canonical_nodes"),
    "search-observations": _search("observations", "raw_observations"),
    "search-files": _search("files", "files"),
    "projects": lambda s, a: s.projects().orderBy("root_path"),
    "status": lambda s, a: summary.by_root(s).orderBy("root_path"),
    "project-summary": lambda s, a: summary.by_root(s).orderBy("root_path"),
    "runs": lambda s, a: s.latest_runs(),
    "manifest-ledger": lambda s, a: query.equal(manifests.ledger(s), kind=a.get("kind"), state=a.get("state")).orderBy("kind", "root_path", "source_run_id"),
    "manifest-summary": lambda s, a: manifests.summary(s),
    "diagnostics": lambda s, a: query.equal(s.rows("diagnostics"), severity=a.get("severity")).orderBy("run_id", "ordinal"),
}
OPERATIONS: dict[str, Operation] = {n: _scoped(f) for n, f in _OPERATIONS.items()}

#: Operations over the configured graphs beside the store.
REGISTRY_OPERATIONS: dict[str, Callable[[Store, ops.Registry, Mapping], DataFrame]] = {
    "list-graphs": lambda s, r, a: ops.registry_frame(s.spark, r).orderBy("graph_id"),
    "graph-status": lambda s, r, a: query.equal(ops.status(s, r), graph_id=a["graph_id"]),
    "refresh-status": lambda s, r, a: query.equal(ops.status(s, r), graph_id=a.get("graph_id")).orderBy("graph_id"),
}

_TEXT, _NUMBER = {"type": "string"}, {"type": "integer", "minimum": 1}
_PAGE = {"query": _TEXT, "kind": _TEXT, "path": _TEXT, "limit": _NUMBER | {"maximum": 100}, "offset": {"type": "integer", "minimum": 0}}
_NEAR = {"direction": {"type": "string", "enum": list(query.DIRECTIONS)}}
_EDGE = {"kind": _TEXT, "source": _TEXT, "target": _TEXT}
_SOURCE = {"source_id": _TEXT, "limit": _NUMBER}
#: What operations may be told besides root_path, and what they must be.
ARGUMENTS: dict[str, dict[str, dict]] = {
    "files": {"role": _TEXT, "language": _TEXT, "generated": {"type": "string", "enum": ["include", "exclude", "only"]}}, "file-nodes": {"path": _TEXT}, "nodes": {"kind": _TEXT, "path": _TEXT, "key": _TEXT},
    "edges": _EDGE, "neighborhood": {"node": _TEXT} | _NEAR, "file-neighborhood": {"path": _TEXT} | _NEAR, "canonical-nodes": {"kind": _TEXT, "key": _TEXT, "path_prefix": _TEXT}, "canonical-edges": _EDGE,
    "canonical-neighborhood": {"node": _TEXT} | _NEAR, "explain-canonical-edge": _EDGE, "host-mutators": {"category": _TEXT, "tool": _TEXT}, "host-mutators-summary": {"category": _TEXT, "tool": _TEXT},
    "canonical-host-mutators": {"category": _TEXT, "tool": _TEXT}, "ingested-sources": {"source_type": _TEXT, "policy_status": _TEXT, "limit": _NUMBER}, "source-summary": {"source_id": _TEXT},
    "source-runs": _SOURCE, "source-feed-items": _SOURCE | {"source_run_id": _TEXT}, "explain-source-feed-item": {"item": _TEXT}, "source-references": _SOURCE | {"target_kind": _TEXT},
    "search-nodes": _PAGE, "search-observations": _PAGE, "search-files": _PAGE, "diagnostics": {"severity": _TEXT}, "manifest-ledger": {"kind": _TEXT, "state": _TEXT}, "graph-status": {"graph_id": _TEXT}, "refresh-status": {"graph_id": _TEXT},
}
REQUIRED: dict[str, tuple[str, ...]] = {
    "neighborhood": ("node",), "file-neighborhood": ("path",), "canonical-neighborhood": ("node",), "explain-canonical-edge": ("source", "kind", "target"), "source-summary": ("source_id",),
    "source-runs": ("source_id",), "explain-source-feed-item": ("item",), "search-nodes": ("query",), "search-observations": ("query",), "search-files": ("query",), "graph-status": ("graph_id",),
}


def schema(operation: str) -> dict:
    """The JSON schema of an operation's arguments."""
    root = {} if operation in REGISTRY_OPERATIONS else {"root_path": _TEXT}
    return {"type": "object", "properties": root | ARGUMENTS.get(operation, {}), "required": list(REQUIRED.get(operation, ())), "additionalProperties": False}


def truncated(text: str, most: int = 500, keep: int = 485) -> str:
    return text if len(text) <= most else text[:keep] + "...[truncated]"


def sanitized(value: object, name: str | None = None) -> object:
    """What may be shown: secret members hidden, logins in urls hidden, long texts cut."""
    if name and secret_name(name) and isinstance(value, (str, int, float)) and not isinstance(value, bool):
        return "<redacted>"
    if isinstance(value, Mapping):
        return {str(k): sanitized(v, str(k)) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [sanitized(v) for v in value]
    if isinstance(value, str):
        return truncated(re.sub(r"[a-z][a-z0-9+.-]*://\S+", lambda m: redact_url(m[0]), value))
    return value if value is None or isinstance(value, (bool, int, float)) else str(value)


#: Rows that are shown at most unless more are asked for.
MOST_SHOWN = 10_000


def records(df: DataFrame, most: int = MOST_SHOWN) -> list[dict]:
    """At most so many rows as objects (metadata parsed), for people and programs outside of Spark."""
    rows = df.limit(most).collect()
    out = []
    for r in rows:
        d = r.asDict(recursive=True)
        if isinstance(d.get("metadata"), str):
            d["metadata"] = json.loads(d["metadata"])
        out.append(d)
    return out


def table(rows: list[dict]) -> str:
    """Rows as an aligned text table."""
    if not rows:
        return "(no rows)"
    names = list(rows[0])
    cells = [names] + [[x if isinstance(x := r[n], str) else "" if x is None else canonical_json(sanitized(x)) for n in names] for r in rows]
    width = [min(60, max(len(c[i]) for c in cells)) for i in range(len(names))]
    return "\n".join("  ".join(v[:60].ljust(w) for v, w in zip(c, width, strict=True)).rstrip() for c in cells)
