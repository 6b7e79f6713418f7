"""Command line: discover and load repositories, plan and import sources, ask the store.

    python -m cairngraph.cli discover ROOT --out observations
    python -m cairngraph.cli load ROOT --store STORE --name NAME
    python -m cairngraph.cli ask canonical-nodes --store STORE --set kind=file
    python -m cairngraph.cli serve --store STORE
"""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from cairngraph import api, rpc
from cairngraph.functions.keys import KEY_VERSION
from cairngraph.operators.base import VERSION
from cairngraph.plans import legacy, manifests, migrations, ops
from cairngraph.plans.canonicalize import canonicalize, severity_counts
from cairngraph.plans.store import LoadRefused, Store
from cairngraph.schemas import SCHEMA_VERSION
from cairngraph.sources import ingest, mailbox, remote, repository
from cairngraph.sources.observations import read_jsonl, write_jsonl


def session() -> SparkSession:
    return SparkSession.builder.appName("cairngraph").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cairngraph", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)

    def add(command: str, help_: str, /, *args: str, **options: str) -> argparse.ArgumentParser:
        c = sub.add_parser(command, help=help_)
        for a in args:
            c.add_argument(a)
        for o, h in options.items():
            c.add_argument(f"--{o.replace('_', '-')}", help=h)
        c.add_argument("--json", action="store_true", help="JSON instead of a table")
        return c

    add("discover", "extract the observations of a repository", "root", out="folder for JSON lines")
    add("observations", "normalise or canonicalise observations", "what", "path")
    for n in ("files", "entrypoints", "host-mutators", "host-mutators-summary"):
        add(n, f"{n} of observations in JSON lines", "path", role="role", language="language", generated="include, exclude or only", category="category", tool="tool")
    add("load", "load a repository, or observations in JSON lines", "root", store="store", name="repository name", root_path="root path to store", commit="commit", mode="all, canonical or files")
    add("bulk-plan", "plan a local corpus", "config", "root")
    add("bulk-import", "import a local corpus", "config", "root", store="store")
    add("import-warc", "import WARC archives", "config", "root", store="store")
    add("import-archive", "import a saved page or report", "config", "root", store="store", kind="saved-page, report or export")
    add("import-mail", "load mailboxes of any size", "root", store="store", name="repository name")
    add("ingest-feed", "fetch a feed, keep it and load it", "config", "folder", store="store", acquired_at="time of acquisition (ISO; now unless given)")
    for n in ("api", "github"):
        add(f"{n}-plan", f"the requests that a {n} source would make", "config")
        add(f"{n}-acquire", f"load saved responses of a {n} source", "config", "folder", store="store", manifest="file to write the manifest to")
    add("migrate", "bring a store up to the present schema", store="store", steps="folder of steps, if not the package's own")
    add("compact", "merge the runs of a store into a snapshot, and keep so many of the last", store="store", keep="snapshots to keep (all unless given)")
    add("identity", "the version of keys, schemas and extractors")
    add("ops", "config-check, graphs, refresh-graph, refresh-enabled or refresh-status of a graph registry", "what", "config", store="store", graph="id of the graph to refresh")
    ask = add("ask", "ask the store", "operation", store="store")
    ask.add_argument("--set", action="append", default=[], metavar="NAME=VALUE", help="argument of the operation")
    add("serve", "answer read-only JSON-RPC on standard input", store="store", registry="graph registry, for the tools over configured graphs")
    return p


def show(rows: list[dict], as_json: bool) -> None:
    print(json.dumps(api.sanitized(rows), indent=2, sort_keys=True) if as_json else api.table(api.sanitized(rows)))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or session()
    try:
        return _run(a, spark)
    except (ValueError, KeyError, LoadRefused, migrations.MigrationProblem) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


def _run(a: argparse.Namespace, spark: SparkSession) -> int:
    if a.command == "discover":
        found = repository.with_selector_matches(repository.discover(spark, a.root))
        if a.out:
            write_jsonl(found, a.out)
        else:
            show(api.records(found.groupBy("kind").count().orderBy("kind")), a.json)
    elif a.command == "observations":
        o = read_jsonl(spark, a.path)
        if a.what == "normalize":
            g = legacy.normalize(o)
            show([{"nodes": g.nodes.count(), "edges": g.edges.count(), "evidence": g.evidence.count()}], a.json)
        else:
            show(api.records(severity_counts(canonicalize(o).diagnostics)), a.json)
    elif a.command in ("files", "entrypoints", "host-mutators", "host-mutators-summary"):
        o = read_jsonl(spark, a.path)
        files = legacy.matching(legacy.files(o), a.role, a.language, a.generated or "include")
        found = {"files": lambda: files, "entrypoints": lambda: legacy.entrypoints(files), "host-mutators": lambda: legacy.host_mutators(o, a.category, a.tool), "host-mutators-summary": lambda: legacy.host_mutator_summary(legacy.host_mutators(o, a.category, a.tool))}[a.command]()
        show(api.records(found), a.json)
    elif a.command == "load":
        store = Store(spark, a.store)
        o = read_jsonl(spark, a.root) if a.root.endswith(".jsonl") else repository.with_selector_matches(repository.discover(spark, a.root))
        load = {"all": store.load, "canonical": store.load_canonical, "files": store.load_files}[a.mode or "all"]
        done = load(o, a.name or "repository", a.root_path or a.root, a.commit)
        show([{"run_id": done.run_id, "status": done.status}], a.json)
    elif a.command == "migrate":
        show([{"step": x.name, "checksum": x.checksum} for x in migrations.apply(Store(spark, a.store), a.steps)], a.json)
    elif a.command == "compact":
        store = Store(spark, a.store)
        done = store.compact()
        show([{"snapshot": done.number, "runs": len(store.ended()), "expired": store.expire_snapshots(int(a.keep)) if a.keep else []}], a.json)
    elif a.command == "identity":
        show([{"package": "cairngraph", "graph_key_version": KEY_VERSION, "schema_version": SCHEMA_VERSION, "extractor_version": VERSION}], a.json)
    elif a.command in ("api-plan", "api-acquire", "github-plan", "github-acquire"):
        with open(a.config, encoding="utf-8") as f:
            r = remote.read_remote(f.read())
        if a.command.startswith("github") != bool(r.owner):
            raise ValueError("the source is of another kind")
        if a.command.endswith("-plan"):
            show(remote.plan(r)["requests"], a.json)
        else:
            made, o = remote.acquire(spark, r, remote.saved_answers(a.folder))
            if a.manifest:
                with open(a.manifest, "w", encoding="utf-8") as f:
                    json.dump(made, f, sort_keys=True)
            manifests.publish(Store(spark, a.store), "api", a.folder, made)
            done = Store(spark, a.store).load_canonical(o, r.source_id, a.folder)
            show([{"run_id": done.run_id, "status": done.status, "api_run_id": made["api_run_id"], "responses": len(made["responses"])}], a.json)
    elif a.command == "ingest-feed":
        with open(a.config, encoding="utf-8") as f:
            s = ingest.read_source(f.read())
        at = a.acquired_at or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        done = Store(spark, a.store).load_canonical(ingest.ingest_feed(spark, s, a.folder, at), s.source_id, a.folder)
        show([{"run_id": done.run_id, "status": done.status}], a.json)
    elif a.command == "import-mail":
        done = Store(spark, a.store).load_canonical(mailbox.loadable(spark, a.root), a.name or "mail", a.root)
        show([{"run_id": done.run_id, "status": done.status}], a.json)
    elif a.command in ("bulk-plan", "bulk-import", "import-warc", "import-archive"):
        with open(a.config, encoding="utf-8") as f:
            s = ingest.read_source(f.read())
        if a.command == "bulk-plan":
            show([ingest.manifest(s, ingest.plan(repository.scan(spark, a.root).select("path", "content"), s))], a.json)
        else:
            if a.command == "import-warc":
                o = ingest.warc_import(spark, a.root, s)
            elif a.command == "import-archive":
                o = ingest.archive_observations(spark, a.root, s, a.kind or "saved-page")[1]
            else:
                planned, o = ingest.bulk_observations(spark, a.root, s)
                manifests.publish(Store(spark, a.store), "bulk", a.root, ingest.manifest(s, planned))
            done = Store(spark, a.store).load_canonical(o, s.source_id, a.root)
            show([{"run_id": done.run_id, "status": done.status}], a.json)
    elif a.command == "ops":
        with open(a.config, encoding="utf-8") as f:
            registry = ops.read_registry(f.read())
        if a.what == "config-check":
            show([dict(zip(("severity", "field", "message"), d, strict=True)) for d in registry.diagnostics], a.json)
            return 0 if registry.ok else 1
        if a.what == "graphs":
            show(api.records(ops.registry_frame(spark, registry)), a.json)
        else:
            store = Store(spark, a.store)
            if a.what == "refresh-graph":
                show([ops.refresh(store, next(g for g in registry.graphs if g.id == a.graph))] if any(g.id == a.graph for g in registry.graphs) else [], a.json)
            else:
                show(ops.refresh_enabled(store, registry) if a.what == "refresh-enabled" else api.records(ops.status(store, registry)), a.json)
    elif a.command == "ask":
        given = dict(x.split("=", 1) for x in a.set)
        show(api.records(api.OPERATIONS[a.operation](Store(spark, a.store), given)), a.json)
    else:
        registry = None
        if a.registry:
            with open(a.registry, encoding="utf-8") as f:
                registry = ops.read_registry(f.read())
        rpc.serve(Store(spark, a.store), sys.stdin, sys.stdout, registry)
    return 0


if __name__ == "__main__":
    sys.exit(main())
