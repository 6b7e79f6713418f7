"""Configured graphs: a TOML registry, refreshing them into a store, and their status.

A registry names graphs (id, repository, root, whether enabled and visible, privacy). Reading it gives graphs and
diagnostics; refreshing discovers and loads one root or all enabled ones in their order, and a failure becomes a row instead of
stopping the others.
"""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from cairngraph.operators.base import redact_url, secret_name
from cairngraph.plans import provenance
from cairngraph.plans.store import Store
from cairngraph.sources import repository

# What a registry may say.
PRIVACY = ("public", "public-dev", "private", "private-ops", "private-memory", "private-config")
REFRESH = ("manual", "startup_check", "watch")
SECTIONS = ("schema_version", "service", "store", "graphs", "sources", "server_memory")
FIELDS = ("id", "name", "root_path", "repository_name", "privacy", "enabled", "mcp_visible", "extractor_profile", "refresh_policy")


@dataclass(frozen=True)
class Graph:
    id: str
    name: str
    root_path: str
    repository_name: str
    privacy: str = "private"
    enabled: bool = False
    visible: bool = False
    extractor_profile: str = "default"
    refresh_policy: str = "manual"


@dataclass(frozen=True)
class Registry:
    graphs: tuple[Graph, ...]
    diagnostics: tuple[tuple[str, str, str], ...]  # severity, field, message

    @property
    def ok(self) -> bool:
        return not any(s == "error" for s, _, _ in self.diagnostics)


def read_registry(text: str) -> Registry:
    try:
        t = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        return Registry((), (("error", "", f"not TOML: {e}"),))
    said: list[tuple[str, str, str]] = []
    if t.get("schema_version", 1) != 1:
        said.append(("error", "schema_version", "only version 1 is known"))
    said += [("warning", n, "section is not known") for n in t if n not in SECTIONS]
    graphs, seen = [], set()
    items = t.get("graphs", [])
    if not isinstance(items, list):
        said.append(("error", "graphs", "must be an array of tables"))
        items = []
    for i, g in enumerate(items):
        at = f"graphs[{i}]"
        said += [("error" if secret_name(n) else "warning", f"{at}.{n}", "a registry holds no secrets" if secret_name(n) else "field is not known") for n in g if n not in FIELDS]
        missing = [n for n in ("id", "root_path", "repository_name") if not isinstance(g.get(n), str) or not g[n].strip()]
        said += [("error", f"{at}.{n}", "is required") for n in missing]
        if g.get("privacy", "private") not in PRIVACY:
            said.append(("error", f"{at}.privacy", "is not known"))
        if g.get("refresh_policy", "manual") not in REFRESH:
            said.append(("error", f"{at}.refresh_policy", "is not known"))
        if g.get("refresh_policy") == "watch":
            said.append(("warning", f"{at}.refresh_policy", "nothing watches by itself; use a stream"))
        if g.get("mcp_visible") and str(g.get("privacy", "private")).startswith("private"):
            said.append(("warning", f"{at}.mcp_visible", "a private graph is visible"))
        if g.get("id") in seen:
            said.append(("error", f"{at}.id", "is used twice"))
        seen.add(g.get("id"))
        if not missing:
            graphs.append(Graph(g["id"], g.get("name", g["id"]), os.path.expanduser(g["root_path"]), g["repository_name"], g.get("privacy", "private"), bool(g.get("enabled")), bool(g.get("mcp_visible")), g.get("extractor_profile", "default"), g.get("refresh_policy", "manual")))
    return Registry(tuple(graphs), tuple(said))


def refresh(store: Store, graph: Graph) -> dict:
    """Discovers and loads one graph; a row of what came of it."""
    row = {"graph_id": graph.id, "repository_name": graph.repository_name, "run_id": None, "status": "skipped", "error": None}
    if not graph.enabled:
        return row | {"error": "graph is not enabled"}
    try:
        found = repository.with_selector_matches(repository.discover(store.spark, graph.root_path))
        done = store.load(found, graph.repository_name, graph.root_path)
    except Exception as e:  # a graph that fails must not stop the others
        return row | {"status": "failed", "error": redact_url(str(e).splitlines()[0][:300]) if str(e) else type(e).__name__}
    return row | {"run_id": done.run_id, "status": done.status}


def refresh_enabled(store: Store, registry: Registry) -> list[dict]:
    return [refresh(store, g) for g in registry.graphs if g.enabled]


def registry_frame(spark: SparkSession, registry: Registry) -> DataFrame:
    rows = [(g.id, g.name, g.repository_name, g.root_path, g.privacy, g.enabled, g.visible, g.refresh_policy) for g in registry.graphs]
    return spark.createDataFrame(rows, "graph_id string, name string, repository_name string, configured_root string, privacy string, enabled boolean, visible boolean, refresh_policy string")


def status(store: Store, registry: Registry) -> DataFrame:
    """The latest run and the counts of every configured graph."""
    graphs = registry_frame(store.spark, registry).select("graph_id", "repository_name")
    return provenance.refresh_status(graphs, store.repositories(), store.rows("runs"), store.current("canonical_nodes"), store.current("canonical_edges"), store.rows("raw_observations"))
