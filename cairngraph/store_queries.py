"""Queries over a store of two roots and three runs, made from the events table, each through the operation that the command
line and the tools offer. The SQL beside them tells the same from the events themselves.

Events whose number leaves 0 or 1 when divided by 3 are the runs 1 and 2 of root /a, the others run 3 of root /b. What an
event becomes depends on its number divided by 7: a file, a variable, a command, a host mutation, a feed item, a kind that the graph
does not know, or a link.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairngraph import api
from cairngraph.plans import manifests, migrations
from cairngraph.plans.canonicalize import canonicalize
from cairngraph.plans.store import Store
from cairngraph.shared import exists, shared_folder, spread
from cairngraph.sources import observations as jsonl

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_stores: dict[tuple[str, str], Store] = {}
_pins: dict[tuple[str, str], Store] = {}

ITEM = "feed.item:file%3Auser%2F8.sh:click"


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(n) for n, c in sorted(fields.items()))))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spread(spark.read.parquet(f"{sf_dir}/events.parquet"))  # a load works in Python on every row
    n, k, user, what = F.col("event_id"), F.get_json_object("props", "$.k").cast("int"), F.col("user_id"), F.col("event_type")
    path = F.concat(F.lit("user/"), user.cast("string"), F.lit(".sh"))
    at = F.concat(F.lit("file%3Auser%2F"), user.cast("string"), F.lit(".sh"))
    item = F.concat(F.lit("feed.item:"), at, F.lit(":"), what)
    source = {
        "source_id_configured": F.concat(F.lit("feed-"), (user % 5).cast("string")), "source_type": F.lit("feed"), "source_policy_status": F.lit("allowed"),
        "source_run_id": F.concat(F.lit("r"), F.date_format("ts", "yyyyMMdd")), "source_acquired_at": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
    }
    kinds = ("file", "shell.env", "shell.command", "shell.host_mutation", "feed.item", "future.thing", "markdown.link")
    metadata = (
        _json(language=F.when(k > 50, F.lit("shell")).otherwise(F.lit("bash")), role=F.when(user % 2 == 0, F.lit("entrypoint")).otherwise(F.lit("source")), content_hash=F.concat(F.lit("h"), n.cast("string"))),
        _json(operation=F.lit("write"), variable=F.upper(what)),
        _json(command=what),
        _json(category=F.lit("package-management"), tool=what, privileged=k > 50),
        _json(title=what, **source),
        _json(x=k),
        _json(link_text=what),
    )
    target = (None, F.concat(F.lit("env:"), F.upper(what)), F.concat(F.lit("tool:"), what), F.lit("host.category:package-management"), item, None, F.concat(F.lit("external.url:"), what))
    pick = lambda xs: F.get(F.array(*(F.lit(x).cast("string") if x is None or isinstance(x, str) else x for x in xs)), (n % 7).cast("int"))
    return e.select(
        F.lit(0).cast("long").alias("run_id"), n.alias("ordinal"), pick(kinds).alias("kind"), F.concat(path, F.lit("#"), n.cast("string")).alias("source_id"), path.alias("path"),
        F.when(n % 2 == 0, F.lit("heuristic")).otherwise(F.lit("extracted")).alias("confidence"), F.lit("events").alias("extractor"), F.lit("1").alias("extractor_version"), F.lit(1).alias("schema_version"),
        F.lit(3).alias("start_line"), F.lit(3).alias("end_line"), what.alias("name"), pick(target).alias("target"), pick(metadata).alias("metadata"), (n % 3).alias("part"),
    )


def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations written as JSON lines and read again, with the ordinals that reading gives them."""
    path = shared_folder(spark, "observations")
    jsonl.write_jsonl(observations(spark, sf_dir).drop("part"), path)
    return jsonl.read_jsonl(spark, path).select("ordinal", "kind", "source_id", "path", "confidence", "start_line", "name", "target")


def stored(spark: SparkSession, sf_dir: str) -> Store:
    """The store of these events, made once a session."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _stores or not exists(spark, _stores[at].base):
        store, rows = Store(spark, shared_folder(spark, "store")), observations(spark, sf_dir)
        for part, (name, root) in enumerate((("first", "/a"), ("first again", "/a"), ("second", "/b"))):
            store.load(rows.where(F.col("part") == part).drop("part"), name, root)
        _stores[at] = store
    return _stores[at]


def compacted(spark: SparkSession, sf_dir: str) -> tuple[Store, Store]:
    """A store of the same runs with a snapshot after the first and two runs since; and what a reader saw that was pinned after
    the second, whatever was loaded and compacted later."""
    at = (spark.sparkContext.applicationId, f"{sf_dir} compacted")
    if at not in _stores or not exists(spark, _stores[at].base):
        store, rows = Store(spark, shared_folder(spark, "compacted")), observations(spark, sf_dir)
        part = lambda n: rows.where(F.col("part") == n).drop("part")
        store.load(part(0), "first", "/a")
        store.compact()
        store.load(part(1), "first again", "/a")
        _pins[at] = store.pinned()
        store.compact()
        store.load(part(2), "second", "/b")
        _stores[at] = store
    return _stores[at], _pins[at]


#: What files of a store of the first schema lack.
FIRST_SCHEMA_LACKS = {"evidence": ("stable_key", "seq"), "edges": ("stable_key", "seq"), "nodes": ("seq",), "files": ("seq",)}


def migrated(spark: SparkSession, sf_dir: str) -> Store:
    """A store whose files are of the first schema, migrated."""
    at = (spark.sparkContext.applicationId, f"{sf_dir} migrated")
    if at not in _stores or not exists(spark, _stores[at].base):
        new, old = stored(spark, sf_dir), Store(spark, shared_folder(spark, "migrated"))
        for table in ("runs", "repositories", "nodes", "files", "evidence", "edges"):
            rows = new.rows(table).drop(*FIRST_SCHEMA_LACKS.get(table, ()))
            rows.write.partitionBy("root_path", "run_id").parquet(f"{old.base}/{table}")
        migrations.apply(old)
        _stores[at] = old
    return _stores[at]


def with_manifests(spark: SparkSession, sf_dir: str) -> Store:
    """A store of suppliers as files, a source run a nation. Nations that 5 divides have no manifest, nation 1 has two, and one
    manifest is of a run that was never loaded."""
    at = (spark.sparkContext.applicationId, f"{sf_dir} manifests")
    if at not in _stores or not exists(spark, _stores[at].base):
        store, t = Store(spark, shared_folder(spark, "manifests")), spark.read.parquet(f"{sf_dir}/supplier.parquet")
        path, run = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".md")), F.concat(F.lit("bulk-"), F.col("s_nationkey").cast("string"))
        rows = t.select(
            F.lit(1).cast("long").alias("run_id"), F.col("s_suppkey").cast("long").alias("ordinal"), F.lit("file").alias("kind"), path.alias("source_id"), path.alias("path"), F.lit("extracted").alias("confidence"), F.lit("t").alias("extractor"),
            F.lit("1").alias("extractor_version"), F.lit(1).alias("schema_version"), F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"), path.alias("name"), F.lit(None).cast("string").alias("target"), _json(bulk_run_id=run).alias("metadata"),
        )
        store.load_canonical(rows, "suppliers", "/s")
        for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey").collect():
            n = r.n_nationkey
            said = {"source_id": f"source-{n % 3}", "bulk_run_id": f"bulk-{n}", "extractor_counts": {"markdown": n, "html": 1}, "diagnostic_counts": {"unsupported_extension": 2}, "total_bytes_included": 10 * n, "limit_hit": n % 2 == 0}
            for _ in range(n == 1):
                manifests.publish(store, "bulk", "/s", said)
            if n % 5:
                manifests.publish(store, "bulk", "/s", said)
        manifests.publish(store, "bulk", "/s", {"source_id": "source-x", "bulk_run_id": "bulk-never", "extractor_counts": {"css": 7}, "total_bytes_included": 5, "limit_hit": True})
        _stores[at] = store
    return _stores[at]


_X = (
    "x AS (SELECT event_id AS n, event_id AS ordinal, CASE event_id % 3 WHEN 2 THEN '/b' ELSE '/a' END AS root_path, (event_id % 3 + 1)::BIGINT AS run_id, event_id % 7 AS sort, user_id AS u, event_type AS what,"
    " 'user/' || user_id || '.sh' AS path, 'user/' || user_id || '.sh#' || event_id AS source_id, json_extract_string(props, '$.k')::INT AS k, ts,"
    " CASE WHEN event_id % 2 = 0 THEN 'heuristic' ELSE 'extracted' END AS confidence, 'file:user/' || user_id || '.sh' AS file, 'feed.item:file%3Auser%2F' || user_id || '.sh:' || event_type AS item,"
    " ['file', 'shell.env', 'shell.command', 'shell.host_mutation', 'feed.item', 'future.thing', 'markdown.link'][event_id % 7 + 1] AS kind,"
    " CASE event_id % 7 WHEN 1 THEN 'env:' || upper(event_type) WHEN 2 THEN 'tool:' || event_type WHEN 3 THEN 'host.category:package-management' WHEN 4 THEN 'feed.item:file%3Auser%2F' || user_id || '.sh:' || event_type WHEN 6 THEN 'external.url:' || event_type END AS target,"
    " 'feed-' || user_id % 5 AS source, 'r' || strftime(ts, '%Y%m%d') AS source_run, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS acquired FROM events)"
)
#: Every edge that an observation draws, and every node that it names: (root, run, ordinal, ...).
_E = (
    "e AS (SELECT root_path, run_id, ordinal, confidence, CASE sort WHEN 4 THEN 'feed.document:file%3Auser%2F' || u || '.sh' WHEN 6 THEN 'doc.page:file%3Auser%2F' || u || '.sh' ELSE file END AS source_key,"
    " CASE sort WHEN 1 THEN 'writes_env' WHEN 2 THEN 'executes' WHEN 3 THEN 'mutates_host' WHEN 4 THEN 'defines' ELSE 'links_to' END AS kind, target AS target_key FROM x WHERE sort IN (1, 2, 3, 4, 6))"
)
_M = "m AS (SELECT root_path, run_id, ordinal, confidence, source_key AS key FROM e UNION ALL SELECT root_path, run_id, ordinal, confidence, target_key FROM e UNION ALL SELECT root_path, run_id, ordinal, confidence, file FROM x WHERE sort = 0)"
_RANK = "max(CASE confidence WHEN 'extracted' THEN 2 ELSE 1 END)"
_STRONG = "CASE arg_max(r, run_id) WHEN 2 THEN 'extracted' ELSE 'heuristic' END"
#: Current nodes and edges: the strongest confidence of the last run, first and last run.
_CN = f"cn AS (SELECT root_path, key AS canonical_key, split_part(key, ':', 1) AS kind, {_STRONG} AS confidence, min(run_id) AS first_seen_run_id, max(run_id) AS last_seen_run_id FROM (SELECT root_path, run_id, key, {_RANK} AS r FROM m GROUP BY ALL) GROUP BY root_path, key)"
_BODY = "'{\"graph_key_version\":1,\"identity_metadata\":{},\"kind\":\"' || kind || '\",\"source_key\":\"' || source_key || '\",\"target_key\":\"' || target_key || '\"}'"
_CE = (
    f"ce AS (SELECT root_path, 'canonical-edge:' || sha256({_BODY}) AS edge_key, source_key, kind, target_key, {_STRONG} AS confidence, min(run_id) AS first_seen_run_id, max(run_id) AS last_seen_run_id"
    f" FROM (SELECT root_path, run_id, source_key, kind, target_key, {_RANK} AS r FROM e GROUP BY ALL) GROUP BY root_path, source_key, kind, target_key)"
)
_F = (
    "f AS (SELECT root_path, path, arg_max(CASE WHEN k > 50 THEN 'shell' ELSE 'bash' END, run_id * 1000000000 + n) AS language, CASE WHEN any_value(u) % 2 = 0 THEN 'entrypoint' ELSE 'source' END AS role,"
    " 'h' || arg_max(n, run_id * 1000000000 + n) AS content_hash, min(run_id) AS first_seen_run_id, max(run_id) AS last_seen_run_id FROM x WHERE sort = 0 GROUP BY root_path, path)"
)
#: The legacy tables: nodes of files, of sources and of targets; an edge each observation with a target.
_L = (
    "l AS (SELECT root_path, run_id, ordinal, n, kind, path, confidence, what AS name, 'node:' || path || ':' || kind || ':' || source_id AS src_key, target AS dst_key, 'edge:node:' || path || ':' || kind || ':' || source_id || ':' || kind || ':' || target AS edge_key,"
    " 'evidence:' || path || ':3-3:events:' || source_id AS evidence_key FROM x WHERE sort <> 0 AND target IS NOT NULL)"
)
_LN = (
    "ln AS (SELECT root_path, key AS stable_key, any_value(kind) AS kind, min(run_id) AS first_seen_run_id, max(run_id) AS last_seen_run_id FROM (SELECT root_path, run_id, src_key AS key, kind FROM l UNION ALL"
    " SELECT root_path, run_id, dst_key, split_part(dst_key, ':', 1) FROM l UNION ALL SELECT root_path, run_id, file, 'file' FROM x WHERE sort = 0) GROUP BY root_path, key)"
)
_CTES = {"e": _E, "m": _M, "cn": _CN, "ce": _CE, "f": _F, "l": _L, "ln": _LN}


def _registered(name: str, frame: Callable[[Store], DataFrame], sql: str, *ctes: str, of: Callable[[SparkSession, str], Store] = stored) -> None:
    QUERIES[name] = lambda spark, sf_dir: frame(of(spark, sf_dir))
    SQL[name] = "WITH " + ", ".join([_X, *(_CTES[c] for c in ctes)]) + ("" if sql.startswith(",") else " ") + sql


def _op(operation: str, *columns: str, **arguments: object) -> Callable[[Store], DataFrame]:
    return lambda store: api.OPERATIONS[operation](store, arguments).selectExpr(*columns)


def _add() -> None:
    seen = ("first_seen_run_id", "last_seen_run_id")
    add = _registered
    add("store_files", _op("files", "root_path", "path", "language", "role", "content_hash", *seen), "SELECT * FROM f", "f")
    add("store_files_of_root", _op("files", "path", "language", "role", root_path="/b", language="bash", role="source"), "SELECT path, language, role FROM f WHERE root_path = '/b' AND language = 'bash' AND role = 'source'", "f")
    add("store_entrypoints", _op("entrypoints", "root_path", "path"), "SELECT root_path, path FROM f WHERE role = 'entrypoint'", "f")
    add("store_nodes", _op("nodes", "root_path", "stable_key", "kind", *seen), "SELECT * FROM ln", "l", "ln")
    add("store_evidence", lambda s: s.current("evidence").select("root_path", "stable_key", "path", "start_line", "extractor", *seen),
        "SELECT root_path, 'evidence:' || path || ':3-3:events:' || source_id AS stable_key, path, 3 AS start_line, 'events' AS extractor, run_id AS first_seen_run_id, run_id AS last_seen_run_id FROM x WHERE sort = 0 OR target IS NOT NULL")
    add("store_edges", _op("edges", "root_path", "stable_key AS edge_key", "kind", "src_key", "src_path", "dst_key", "dst_kind", "confidence", "evidence_key", "evidence_start_line", kind="shell.env"),
        "SELECT root_path, edge_key, kind, src_key, path AS src_path, dst_key, 'env' AS dst_kind, confidence, evidence_key, 3 AS evidence_start_line FROM l WHERE kind = 'shell.env'", "l")
    add("store_file_nodes", _op("file-nodes", "root_path", "path", "stable_key", "node_name", "evidence_key", path="user/8.sh"),
        "SELECT f.root_path, f.path, 'file:' || f.path AS stable_key, f.path AS node_name, 'evidence:' || x.path || ':3-3:events:' || x.source_id AS evidence_key FROM f JOIN x ON x.root_path = f.root_path AND x.path = f.path AND (x.sort = 0 OR x.target IS NOT NULL) WHERE f.path = 'user/8.sh'", "f")
    add("store_legacy_neighborhood", _op("neighborhood", "root_path", "what", "key", node="tool:click", direction="in", root_path="/a"),
        "SELECT root_path, 'edge' AS what, edge_key AS key FROM l WHERE root_path = '/a' AND dst_key = 'tool:click' UNION ALL SELECT root_path, 'node', src_key FROM l WHERE root_path = '/a' AND dst_key = 'tool:click'"
        " UNION ALL SELECT DISTINCT root_path, 'node', dst_key FROM l WHERE root_path = '/a' AND dst_key = 'tool:click'", "l")
    add("store_file_neighborhood", _op("file-neighborhood", "root_path", "what", "key", path="user/8.sh"),
        ", c AS (SELECT root_path, src_key AS key FROM l WHERE path = 'user/8.sh' UNION SELECT root_path, 'file:' || path FROM f WHERE path = 'user/8.sh'), t AS (SELECT l.* FROM l JOIN c ON c.root_path = l.root_path AND c.key = l.src_key)"
        " SELECT root_path, 'edge' AS what, edge_key AS key FROM t UNION ALL SELECT DISTINCT root_path, 'node', key FROM (SELECT root_path, key FROM c UNION ALL SELECT root_path, dst_key FROM t)", "f", "l")
    add("store_canonical_nodes", _op("canonical-nodes", "root_path", "canonical_key", "kind", "confidence", *seen), "SELECT * FROM cn", "e", "m", "cn")
    add("store_node_prefix", _op("canonical-nodes", "canonical_key", *seen, root_path="/a", path_prefix="user"), "SELECT canonical_key, first_seen_run_id, last_seen_run_id FROM cn WHERE root_path = '/a' AND canonical_key LIKE 'file:user/%'", "e", "m", "cn")
    add("store_canonical_edges", _op("canonical-edges", "root_path", "edge_key", "source_key", "kind", "target_key", "confidence", *seen), "SELECT * FROM ce", "e", "ce")
    add("store_edges_by_kind", _op("canonical-edges", "root_path", "source_key", "target_key", kind="writes_env", target="env:CLICK"), "SELECT root_path, source_key, target_key FROM ce WHERE kind = 'writes_env' AND target_key = 'env:CLICK'", "e", "ce")
    for d, where in (("in", "target_key = 'file:user/8.sh'"), ("out", "source_key = 'file:user/8.sh'"), ("both", "'file:user/8.sh' IN (source_key, target_key)")):
        add(f"store_neighborhood_{d}", _op("canonical-neighborhood", "root_path", "what", "key", node="file:user/8.sh", direction=d),
            f", t AS (SELECT * FROM ce WHERE {where}) SELECT root_path, 'edge' AS what, edge_key AS key FROM t UNION ALL SELECT root_path, 'center', canonical_key FROM cn WHERE canonical_key = 'file:user/8.sh' UNION ALL"
            " SELECT DISTINCT root_path, 'node', k FROM (SELECT root_path, source_key AS k FROM t UNION ALL SELECT root_path, target_key FROM t) WHERE k <> 'file:user/8.sh'", "e", "m", "cn", "ce")
    add("store_explain_edge", lambda s: api.OPERATIONS["explain-canonical-edge"](s, {"source": "file:user/8.sh", "kind": "executes", "target": "tool:click"}).select("root_path", "edge_key", F.explode("evidence").alias("v")).select(
        "root_path", "edge_key", "v.run_id", "v.ordinal", "v.evidence_key", "v.path", "v.confidence", "v.observed_kind", "v.observed_target", "v.link_kind"),
        "SELECT e.root_path, edge_key, e.run_id, e.ordinal, 'evidence:' || e.ordinal || ':user/8.sh:3-3:events:user/8.sh#' || e.ordinal AS evidence_key, 'user/8.sh' AS path, e.confidence, 'shell.command' AS observed_kind, 'tool:click' AS observed_target, 'supports' AS link_kind"
        " FROM ce JOIN e USING (root_path, source_key, kind, target_key) WHERE source_key = 'file:user/8.sh' AND kind = 'executes' AND target_key = 'tool:click'", "e", "ce")
    add("store_canonical_evidence", lambda s: s.rows("canonical_evidence").select("root_path", "run_id", "ordinal", "evidence_key", "raw_kind", "raw_source_id", "path", "start_line", "confidence"),
        "SELECT root_path, run_id, ordinal, 'evidence:' || ordinal || ':' || path || ':3-3:events:' || source_id AS evidence_key, kind AS raw_kind, source_id AS raw_source_id, path, 3 AS start_line, confidence FROM x WHERE sort <> 5")
    add("store_node_links", lambda s: s.rows("canonical_node_evidence").groupBy("root_path", "run_id", "canonical_key", "link_kind").count().withColumnRenamed("count", "n"),
        "SELECT root_path, run_id, key AS canonical_key, link_kind, count(*) AS n FROM (SELECT root_path, run_id, ordinal, source_key AS key, 'inferred_from_edge' AS link_kind FROM e UNION ALL SELECT root_path, run_id, ordinal, target_key, CASE kind WHEN 'defines' THEN 'observed' ELSE 'inferred_from_edge' END FROM e"
        " UNION ALL SELECT root_path, run_id, ordinal, file, 'observed' FROM x WHERE sort = 0) GROUP BY ALL", "e")
    add("store_edge_links", lambda s: s.rows("canonical_edge_evidence").groupBy("root_path", "run_id", "edge_key").count().withColumnRenamed("count", "n"),
        "SELECT e.root_path, e.run_id, edge_key, count(*) AS n FROM e JOIN ce USING (root_path, source_key, kind, target_key) GROUP BY ALL", "e", "ce")
    add("store_raw_observations", lambda s: s.rows("raw_observations").select("root_path", "run_id", "ordinal", "kind", "source_id", "path", "confidence", "target", F.length("payload_hash").alias("hashed")),
        "SELECT root_path, run_id, ordinal, kind, source_id, path, confidence, target, 64 AS hashed FROM x")
    add("store_diagnostics", lambda s: api.OPERATIONS["diagnostics"](s, {"severity": "warning"}).groupBy("root_path", "run_id", "category", "field").count().withColumnRenamed("count", "n"),
        "SELECT root_path, run_id, 'unsupported_raw_observation_kind' AS category, 'kind' AS field, count(*) AS n FROM x WHERE sort = 5 GROUP BY ALL UNION ALL"
        " SELECT root_path, run_id, 'conflicting_evidence', 'metadata.' || f, sum(d - 1)::BIGINT FROM (SELECT root_path, run_id, path, 'language' AS f, count(DISTINCT k > 50) AS d FROM x WHERE sort = 0 GROUP BY ALL UNION ALL"
        " SELECT root_path, run_id, path, 'content_hash', count(DISTINCT n) FROM x WHERE sort = 0 GROUP BY ALL) GROUP BY root_path, run_id, f HAVING sum(d - 1) > 0")
    add("store_file_conflicts", lambda s: s.current("canonical_nodes").where("kind = 'file'").select("root_path", "canonical_key", "conflict"),
        "SELECT root_path, file AS canonical_key, coalesce(max(c) FILTER (run_id = last), false) AS conflict FROM (SELECT m.root_path, m.key AS file, m.run_id, max(m.run_id) OVER (PARTITION BY m.root_path, m.key) AS last,"
        " (SELECT count(DISTINCT x.n) > 1 FROM x WHERE x.sort = 0 AND x.root_path = m.root_path AND x.run_id = m.run_id AND x.file = m.key) AS c FROM (SELECT DISTINCT root_path, run_id, key FROM m WHERE key LIKE 'file:%') m) GROUP BY root_path, file", "e", "m")
    add("store_orphans", lambda s: s.orphans().agg(F.count(F.lit(1)).alias("n")),
        "SELECT count(*) AS n FROM ce WHERE NOT EXISTS (SELECT 1 FROM cn WHERE cn.root_path = ce.root_path AND cn.canonical_key = ce.source_key) OR NOT EXISTS (SELECT 1 FROM cn WHERE cn.root_path = ce.root_path AND cn.canonical_key = ce.target_key)", "e", "m", "cn", "ce")
    add("store_projects", _op("projects", "root_path", "name", "run_id", "status"), "SELECT * FROM (VALUES ('/a', 'first again', 2::BIGINT, 'complete'), ('/b', 'second', 3::BIGINT, 'complete')) t(root_path, name, run_id, status)")
    add("store_runs", _op("runs", "root_path", "run_id", "status"), "SELECT root_path, max(run_id) AS run_id, 'complete' AS status FROM x GROUP BY root_path")
    add("store_status", _op("project-summary", "root_path", "repository_name", "latest_run_id", "graph_key_version", "runs", "files", "nodes", "edges", "evidence"),
        "SELECT r.root_path, r.name AS repository_name, r.run AS latest_run_id, 1 AS graph_key_version, r.runs, (SELECT count(*) FROM f WHERE f.root_path = r.root_path) AS files, (SELECT count(*) FROM ln WHERE ln.root_path = r.root_path) AS nodes,"
        " (SELECT count(*) FROM l WHERE l.root_path = r.root_path) AS edges, (SELECT count(*) FROM x WHERE x.root_path = r.root_path AND (sort = 0 OR target IS NOT NULL)) AS evidence"
        " FROM (VALUES ('/a', 'first again', 2::BIGINT, 2::BIGINT), ('/b', 'second', 3::BIGINT, 1::BIGINT)) r(root_path, name, run, runs)", "f", "l", "ln")
    add("store_summary", _op("summary", "runs", "files", "nodes", "edges", "evidence", "latest_run_id"),
        "SELECT 3::BIGINT AS runs, (SELECT count(*) FROM f) AS files, (SELECT count(*) FROM ln) AS nodes, (SELECT count(*) FROM l) AS edges, (SELECT count(*) FROM x WHERE sort = 0 OR target IS NOT NULL) AS evidence, 3::BIGINT AS latest_run_id", "f", "l", "ln")
    add("store_canonical_summary", _op("canonical-summary", "repositories", "runs", "raw_observations", "canonical_nodes", "canonical_edges", "canonical_evidence", "canonical_edge_evidence", root_path="/a"),
        "SELECT 1::BIGINT AS repositories, 2::BIGINT AS runs, (SELECT count(*) FROM x WHERE root_path = '/a') AS raw_observations, (SELECT count(*) FROM cn WHERE root_path = '/a') AS canonical_nodes, (SELECT count(*) FROM ce WHERE root_path = '/a') AS canonical_edges,"
        " (SELECT count(*) FROM x WHERE root_path = '/a' AND sort <> 5) AS canonical_evidence, (SELECT count(*) FROM e WHERE root_path = '/a') AS canonical_edge_evidence", "e", "m", "cn", "ce")
    add("store_host_mutators", _op("host-mutators", "path", "line", "name", "category", "tool", "privileged", "confidence", root_path="/b", tool="click"),
        "SELECT DISTINCT path, 3 AS line, what AS name, 'package-management' AS category, what AS tool, k > 50 AS privileged, confidence FROM x WHERE sort = 3 AND root_path = '/b' AND what = 'click'")
    add("store_host_mutators_summary", _op("host-mutators-summary", "category", "tool", "n", "privileged", root_path="/a"),
        "SELECT category, tool, count(*) AS n, sum(p)::BIGINT AS privileged FROM (SELECT DISTINCT path, what AS tool, 'package-management' AS category, (k > 50)::INT AS p, confidence FROM x WHERE sort = 3 AND root_path = '/a') GROUP BY category, tool")
    add("store_canonical_host_mutators", _op("canonical-host-mutators", "root_path", "source_key", "target_key", category="package-management"), "SELECT root_path, source_key, target_key FROM ce WHERE kind = 'mutates_host'", "e", "ce")
    add("store_sources", _op("ingested-sources", "root_path", "source_id", "source_type", "policy_status", "latest_source_run_id", "latest_acquired_at", "feed_observation_count", "canonical_feed_item_count"),
        "SELECT root_path, source AS source_id, 'feed' AS source_type, 'allowed' AS policy_status, arg_max(source_run, acquired) AS latest_source_run_id, max(acquired) AS latest_acquired_at, (2 * count(*))::BIGINT AS feed_observation_count, count(DISTINCT item) AS canonical_feed_item_count"
        " FROM x WHERE sort = 4 GROUP BY root_path, source")
    add("store_source_summary", _op("source-summary", "source_id", "source_type", "policy_status", "latest_source_run_id", "latest_acquired_at", "feed_documents", "feed_items", "link_references", "parse_errors", source_id="feed-3", root_path="/a"),
        "SELECT 'feed-3' AS source_id, 'feed' AS source_type, 'allowed' AS policy_status, arg_max(source_run, acquired) AS latest_source_run_id, max(acquired) AS latest_acquired_at, count(DISTINCT u) AS feed_documents, count(DISTINCT item) AS feed_items, 0::BIGINT AS link_references,"
        " 0::BIGINT AS parse_errors FROM x WHERE sort = 4 AND source = 'feed-3' AND root_path = '/a'")
    add("store_source_runs", _op("source-runs", "source_run_id", "acquired_at", "observation_count", "status_summary", source_id="feed-3", root_path="/b"),
        "SELECT source_run AS source_run_id, max(acquired) AS acquired_at, count(*) AS observation_count, 'ok' AS status_summary FROM x WHERE sort = 4 AND source = 'feed-3' AND root_path = '/b' GROUP BY source_run ORDER BY acquired_at DESC, source_run DESC LIMIT 25")
    add("store_feed_items", _op("source-feed-items", "root_path", "canonical_key", "title", "source_id", "source_run_id", "evidence_count", limit=None),
        "SELECT root_path, item AS canonical_key, what AS title, max(source) AS source_id, arg_max(source_run, acquired) AS source_run_id, count(*) AS evidence_count FROM x WHERE sort = 4 GROUP BY root_path, item, what")
    add("store_explain_item", lambda s: api.OPERATIONS["explain-source-feed-item"](s, {"item": ITEM}).select("root_path", "canonical_key", "evidence_count", F.explode("evidence").alias("v")).select("root_path", "canonical_key", "evidence_count", "v.run_id", "v.ordinal", "v.kind", "v.source_run_id"),
        f"SELECT root_path, item AS canonical_key, count(*) OVER (PARTITION BY root_path) AS evidence_count, run_id, ordinal, 'feed.item' AS kind, source_run AS source_run_id FROM x WHERE sort = 4 AND item = '{ITEM}'")
    add("store_search_nodes", _op("search-nodes", "root_path", "canonical_key", "kind", query="TOOL:", root_path="/a", limit=3), "SELECT root_path, canonical_key, kind FROM cn WHERE root_path = '/a' AND canonical_key LIKE 'tool:%' ORDER BY canonical_key LIMIT 4", "e", "m", "cn")
    add("store_search_observations", _op("search-observations", "run_id", "ordinal", "kind", query="host_mut", root_path="/a", limit=20, offset=10), "SELECT run_id, ordinal, kind FROM x WHERE root_path = '/a' AND sort = 3 ORDER BY run_id DESC, ordinal OFFSET 10 LIMIT 21")
    add("store_search_files", _op("search-files", "path", "language", query="ENTRY", root_path="/b", limit=5), "SELECT path, language FROM f WHERE root_path = '/b' AND role = 'entrypoint' ORDER BY path LIMIT 6", "f")

    # The same answers from a snapshot and the runs since, as the reader saw them that was pinned before run 3, and after a migration.
    whole, pinned = (lambda spark, sf: compacted(spark, sf)[0]), (lambda spark, sf: compacted(spark, sf)[1])
    for of, prefix, where in ((whole, "snapshot", ""), (pinned, "pinned", " WHERE run_id < 3")):
        x = _X.replace(" FROM events)", " FROM events)" if not where else " FROM events WHERE event_id % 3 < 2)")

        def told(name: str, frame: Callable[[Store], DataFrame], sql: str, *ctes: str, of=of, prefix=prefix, x=x) -> None:
            add(f"{prefix}_{name}", frame, sql, *ctes, of=of)
            SQL[f"{prefix}_{name}"] = SQL[f"{prefix}_{name}"].replace(_X, x)

        told("canonical_nodes", _op("canonical-nodes", "root_path", "canonical_key", "kind", "confidence", *seen), "SELECT * FROM cn", "e", "m", "cn")
        told("canonical_edges", _op("canonical-edges", "root_path", "edge_key", "source_key", "kind", "target_key", "confidence", *seen), "SELECT * FROM ce", "e", "ce")
        told("files", _op("files", "root_path", "path", "language", "role", "content_hash", *seen), "SELECT * FROM f", "f")
        told("runs", _op("runs", "root_path", "run_id"), "SELECT root_path, max(run_id) AS run_id FROM x GROUP BY root_path")
    add("migrated_edges", _op("edges", "root_path", "stable_key AS edge_key", "kind", "src_key", "dst_key", "evidence_key", "evidence_start_line"),
        "SELECT root_path, edge_key, kind, src_key, dst_key, evidence_key, 3 AS evidence_start_line FROM l", "l", of=migrated)
    add("migrated_evidence", lambda s: s.current("evidence").select("root_path", "stable_key", "path", "extractor", *seen),
        "SELECT root_path, 'evidence:' || path || ':3-3:events:' || source_id AS stable_key, path, 'events' AS extractor, run_id AS first_seen_run_id, run_id AS last_seen_run_id FROM x WHERE sort = 0 OR target IS NOT NULL", of=migrated)


_add()
QUERIES["observations_round_trip"] = round_trip
SQL["observations_round_trip"] = f"WITH {_X} SELECT row_number() OVER (ORDER BY n) - 1 AS ordinal, kind, source_id, path, confidence, 3 AS start_line, what AS name, target FROM x"


_LEDGER = (
    "WITH n AS (SELECT n_nationkey AS k, n_nationkey % 5 > 0 AS planned, count(s_suppkey) AS c FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL),"
    " l AS (SELECT 'bulk-' || k AS source_run_id, CASE WHEN NOT planned THEN 'run_only' WHEN c = 0 THEN 'manifest_only' ELSE 'complete' END AS state, CASE WHEN c > 0 THEN c END AS observations, CASE WHEN planned THEN 'source-' || k % 3 END AS source_id,"
    " CASE WHEN planned THEN k + 1 END AS included_files, CASE WHEN planned THEN 2 END AS skipped_files, CASE WHEN planned THEN 10 * k END AS total_bytes, CASE WHEN planned THEN k % 2 = 0 END AS limit_hit FROM n WHERE planned OR c > 0"
    " UNION ALL SELECT 'bulk-never', 'manifest_only', NULL, 'source-x', 7, 0, 5, true)"
)
QUERIES["manifest_ledger"] = lambda spark, sf_dir: api.OPERATIONS["manifest-ledger"](with_manifests(spark, sf_dir), {"kind": "bulk"}).select(
    "source_run_id", "state", "observations", "source_id", "included_files", "skipped_files", "total_bytes", "limit_hit"
)
SQL["manifest_ledger"] = f"{_LEDGER} SELECT source_run_id, state, observations::BIGINT AS observations, source_id, included_files::BIGINT AS included_files, skipped_files::BIGINT AS skipped_files, total_bytes::BIGINT AS total_bytes, limit_hit FROM l"
QUERIES["manifest_summary"] = lambda spark, sf_dir: api.OPERATIONS["manifest-summary"](with_manifests(spark, sf_dir), {})
SQL["manifest_summary"] = (
    f"{_LEDGER} SELECT count(*) AS source_runs, count(DISTINCT source_id) AS sources, count(*) FILTER (state = 'complete') AS complete, count(*) FILTER (state = 'manifest_only') AS manifest_only, count(*) FILTER (state = 'run_only') AS run_only,"
    " coalesce(sum(observations), 0)::BIGINT AS observations, sum(included_files)::BIGINT AS included_files, sum(skipped_files)::BIGINT AS skipped_files, sum(total_bytes)::BIGINT AS total_bytes, count(*) FILTER (limit_hit) AS limit_hits FROM l"
)


def folded_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of feed links, an observation an event: what a link is said to be differs from event to event, and the edge's metadata is
    the fold of all of them in order."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    user, k = F.col("user_id").cast("string"), F.get_json_object("props", "$.k").cast("int")
    kind = lambda n: F.get(F.array(F.lit("rss"), F.lit("atom"), F.lit("json")), n)
    metadata = _json(feed_format=kind(k % 3), field=F.lit("link"), length=F.when(F.col("user_id") % 2 == 0, F.lit(5)).otherwise(k % 2), source_key=F.concat(F.lit("feed.document:file%3A"), user))
    rows = e.select(
        F.lit(1).cast("long").alias("run_id"), F.col("event_id").alias("ordinal"), F.lit("feed.link").alias("kind"), F.concat(user, F.lit("#"), F.col("event_id").cast("string")).alias("source_id"), user.alias("path"),
        F.lit("extracted").alias("confidence"), F.lit("events").alias("extractor"), F.lit("1").alias("extractor_version"), F.lit(1).alias("schema_version"), F.lit(None).cast("int").alias("start_line"),
        F.lit(None).cast("int").alias("end_line"), F.col("event_type").alias("name"), F.concat(F.lit("external.url:"), F.col("event_type")).alias("target"), metadata.alias("metadata"),
    )
    return canonicalize(rows).edges.where("kind = 'references'").select("source_key", "target_key", "metadata")


QUERIES["edge_metadata_folds"] = folded_edges
SQL["edge_metadata_folds"] = """
WITH x AS (
  SELECT event_id, user_id, event_type, ['"rss"', '"atom"', '"json"'][json_extract_string(props, '$.k')::INT % 3 + 1] AS feed, CASE WHEN user_id % 2 = 0 THEN '5' ELSE (json_extract_string(props, '$.k')::INT % 2)::VARCHAR END AS size FROM events
),
l AS (SELECT user_id, event_type, list(feed ORDER BY event_id) AS feeds, list(size ORDER BY event_id) AS sizes FROM x GROUP BY ALL)
SELECT 'feed.document:file%3A' || user_id AS source_key, 'external.url:' || event_type AS target_key,
  '{"feed_format":' || list_reduce(feeds, lambda a, v: CASE WHEN a = v THEN a ELSE '[' || a || ',' || v || ']' END) || ',"field":"link","length":'
  || list_reduce(sizes, lambda a, v: CASE WHEN a = v THEN a ELSE '[' || a || ',' || v || ']' END) || '}' AS metadata
FROM l
"""
