"""Append-only storage: every load is a run, every table a folder of Parquet partitioned by root and run.

A load claims its run id by making a file that nobody else can make, so loads at the same time get different ones. A
run's rows are written first, its row in `runs` last: readers join with the runs that are there, so a load that dies
half-way is never seen, and its run id is not given again; it may be resumed under the same id, which writes its
partitions anew and refuses observations that changed. What an upsert would have kept is read back by aggregation:
the first and the last run that saw a key, and the values of the last. A run that has ended is never rewritten.

Current rows come from the last snapshot and the runs since (snapshots.py); without a snapshot from all runs. A store whose files
are older than the schema is read as if it were migrated (migrations.py), and loads want it migrated.

Observations are interpreted once a load: the interpreted rows are written to a folder of the run, which all tables of
the graph derive from, and dropped at its end.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cached_property
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairngraph.plans import legacy, migrations
from cairngraph.plans.canonicalize import Graph, canonicalize, is_loadable
from cairngraph.plans.query import roots
from cairngraph.plans.snapshots import Pin, Snapshot, condition, ranges, within
from cairngraph.schemas import TABLES
from cairngraph.shared import shared_folder
from cairngraph.sources.observations import with_payload_hash

#: Natural keys of the tables that are upserted.
KEYS = {
    "files": ["root_path", "path"],
    "nodes": ["root_path", "stable_key"],
    "evidence": ["root_path", "stable_key"],
    "edges": ["root_path", "stable_key"],
    "canonical_nodes": ["root_path", "graph_key_version", "canonical_key"],
    "canonical_edges": ["root_path", "graph_key_version", "source_key", "kind", "target_key", "identity_metadata_hash"],
}


class LoadRefused(RuntimeError):
    """Observations that cannot be stored: errors in canonicalization, or a changed ordinal."""


@dataclass(frozen=True)
class Load:
    run_id: int
    status: str


class Store:
    """root_path: what is read is held to this root; loads name their own. pin: what is read is held to what was there then."""

    def __init__(self, spark: SparkSession, base: str, root_path: str | None = None, pin: Pin | None = None) -> None:
        self.spark, self.base, self.root_path, self.pin = spark, base.rstrip("/"), root_path, pin

    def at(self, root_path: str | None) -> Store:
        """The store as one root sees it; the whole of it for None."""
        return self if root_path is None else Store(self.spark, self.base, root_path, self.pin)

    def pinned(self) -> Store:
        """The store as it is now, whatever is loaded or compacted later (until its snapshot is expired)."""
        return Store(self.spark, self.base, self.root_path, Pin(self.snapshot(), tuple(sorted(self.ended()))))

    # --- files --------------------------------------------------------------------------------------

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def has(self, name: str) -> bool:
        fs, p = self._path(f"{self.base}/{name}")
        return fs.exists(p)

    def names(self, folder: str, prefix: str = "") -> list[str]:
        """Names in a folder of the store that start so."""
        fs, p = self._path(f"{self.base}/{folder}")
        return [n for n in (s.getPath().getName() for s in fs.listStatus(p)) if n.startswith(prefix)] if fs.exists(p) else []

    def read_text(self, name: str) -> str:
        fs, p = self._path(f"{self.base}/{name}")
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_text(self, name: str, text: str) -> None:
        """A file that is there whole or not at all."""
        fs, p = self._path(f"{self.base}/{name}")
        part = self._path(f"{self.base}/{name}.part")[1]
        stream = fs.create(part, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        fs.rename(part, p)

    def delete(self, name: str) -> None:
        fs, p = self._path(f"{self.base}/{name}")
        fs.delete(p, True)

    def replace(self, source: str, target: str) -> None:
        """Puts a folder in the place of another."""
        self.delete(target)
        fs, p = self._path(f"{self.base}/{source}")
        fs.rename(p, self._path(f"{self.base}/{target}")[1])

    # --- tables -------------------------------------------------------------------------------------

    def tables_present(self) -> dict[str, bool]:
        return {t: self.has(t) for t in TABLES}

    @cached_property
    def _behind(self) -> tuple[migrations.Step, ...]:
        return migrations.pending(self, migrations.discover())

    def forget(self) -> None:
        """What was read of the ledger."""
        self.__dict__.pop("_behind", None)

    def written_rows(self, table: str) -> DataFrame:
        """Everything ever written as it is in the files, with nulls for columns that they lack."""
        schema = TABLES[table]
        if not self.has(table):
            return self.spark.createDataFrame([], schema)
        return self._files(table, f"{self.base}/{table}")

    def _files(self, table: str, *paths: str) -> DataFrame:
        rows = self.spark.read.schema(TABLES[table]).option("basePath", f"{self.base}/{table}").parquet(*paths).select(*TABLES[table].names)
        return rows if self.root_path is None else rows.where(F.col("root_path") == self.root_path)

    def all_rows(self, table: str) -> DataFrame:
        """Everything ever written, of whatever run; a root is a partition, so no other root's files are read."""
        return migrations.filled(self.written_rows(table), table, self._behind)

    def ended(self) -> set[tuple[str, int]]:
        """(root, run) of the runs that have ended: the names of their folders, nothing is read."""
        if self.pin is not None:
            return set(self.pin.ended)
        return {
            (unquote(root.removeprefix("root_path=")), int(run.removeprefix("run_id=")))
            for root in self.names("runs", "root_path=")
            for run in self.names(f"runs/{root}", "run_id=")
        }

    def rows(self, table: str) -> DataFrame:
        """Rows of runs that have ended (complete or failed)."""
        rows = self.all_rows(table)
        if self.pin is not None:
            return rows.where(condition(self.pin.runs))
        return rows if table == "runs" else rows.join(F.broadcast(self.all_rows("runs").select("run_id").distinct()), "run_id", "left_semi").select(*rows.columns)  # a row a run: by shuffle a task would get all of a run

    def _seen(self, table: str) -> DataFrame:
        """The table's rows as snapshots hold them: with first_seen_run_id and last_seen_run_id in place of the run."""
        snapshot = self.snapshot()
        once = lambda rows: rows.withColumns({"first_seen_run_id": F.col("run_id"), "last_seen_run_id": F.col("run_id")}).drop("run_id")
        if snapshot is None:
            return self._merged(table, once(self.rows(table)))
        held = self._held(snapshot, table)
        later = [(root, run) for root, run in sorted(self.ended()) if not within(run, snapshot.runs) and self.root_path in (None, root)]
        folder = {unquote(n): n for n in self.names(table, "root_path=")} if later else {}
        at = [f"{table}/{folder[f'root_path={root}']}/run_id={run}" for root, run in later if f"root_path={root}" in folder]
        paths = [p for p in at if self.has(p)]
        if not paths:
            return held
        new = migrations.filled(self._files(table, *(f"{self.base}/{p}" for p in paths)), table, self._behind)
        return self._merged(table, held.unionByName(once(new)))

    @staticmethod
    def _merged(table: str, rows: DataFrame) -> DataFrame:
        """One row a natural key: the values of the last run (and of the last row in it), the first and the last run."""
        keys, seen = KEYS[table], ("first_seen_run_id", "last_seen_run_id")
        rest = [c for c in rows.columns if c not in (*keys, *seen)]
        order = F.struct("last_seen_run_id", "seq") if "seq" in rest else F.col("last_seen_run_id")
        done = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r"), F.min(seen[0]).alias(seen[0]), F.max(seen[1]).alias(seen[1]))
        return done.select(*(F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in TABLES[table].names if c != "run_id"), *seen)

    def current(self, table: str) -> DataFrame:
        """One row a natural key: values of the last run, first_seen_run_id and last_seen_run_id."""
        return self._seen(table).drop("seq")

    # --- snapshots ----------------------------------------------------------------------------------

    def snapshot(self) -> Snapshot | None:
        """The last snapshot whose manifest is there (of a pinned store, its own)."""
        if self.pin is not None:
            return self.pin.snapshot
        numbers = [int(n.removesuffix(".json")) for n in self.names("_snapshots") if n.endswith(".json")]
        return Snapshot.of(self.read_text(f"_snapshots/{max(numbers)}.json")) if numbers else None

    def _held(self, snapshot: Snapshot, table: str) -> DataFrame:
        schema = [f for f in TABLES[table].fields if f.name != "run_id"]
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", first_seen_run_id bigint, last_seen_run_id bigint"
        rows = self.spark.read.schema(columns).parquet(f"{self.base}/_snapshots/{snapshot.number}/{table}")
        rows = rows.select(*(f.name for f in schema), "first_seen_run_id", "last_seen_run_id")
        return rows if self.root_path is None else rows.where(F.col("root_path") == self.root_path)

    def compact(self) -> Snapshot:
        """Merges the last snapshot and the runs since into a new one."""
        if self.root_path is not None or self.pin is not None:
            raise ValueError("a whole store is compacted, as it is now")
        now = self.pinned()
        number = self._claimed("_snapshots/_claims")
        for table, keys in KEYS.items():
            rows = now._seen(table).sortWithinPartitions(*keys)  # by key, so that a filter on it passes over row groups
            rows.write.mode("overwrite").partitionBy("root_path").parquet(f"{self.base}/_snapshots/{number}/{table}")
        done = Snapshot(number, ranges(run for _, run in now.ended()))
        self.write_text(f"_snapshots/{number}.json", done.text())
        return done

    def expire_snapshots(self, keep: int = 1) -> list[int]:
        """Deletes all but the last snapshots, and what compactions that died left before them; their numbers."""
        if keep < 1:
            raise ValueError("the last snapshot is kept")
        whole = sorted(int(n.removesuffix(".json")) for n in self.names("_snapshots") if n.endswith(".json"))
        first = whole[-keep] if len(whole) >= keep else 0
        gone = sorted(int(n) for n in self.names("_snapshots") if n.isdigit() and int(n) < first)
        for n in gone:
            self.delete(f"_snapshots/{n}.json")
            self.delete(f"_snapshots/{n}")
        return gone

    def repositories(self) -> DataFrame:
        """The latest name of each root."""
        r = self.rows("repositories")
        return r.groupBy("root_path").agg(F.max_by("name", "run_id").alias("name"), F.max_by("remote_url", "run_id").alias("remote_url"), F.min("created_at").alias("created_at"))

    def projects(self) -> DataFrame:
        """A row a root: its names and its latest run."""
        last = self.latest_runs().select("root_path", "run_id", "status", "git_commit", "finished_at")
        return self.repositories().join(last, "root_path", "left")

    def latest_runs(self) -> DataFrame:
        r = self.rows("runs")
        return r.groupBy("root_path").agg(F.max_by(F.struct(*(c for c in r.columns if c != "root_path")), "run_id").alias("r")).select("root_path", "r.*")

    def _put(self, table: str, df: DataFrame) -> None:
        """Writes the partitions (root and run) of df, in place of what a load that died left in them."""
        names = TABLES[table].names
        rows = df.select(*(F.col(n).cast(TABLES[table][n].dataType).alias(n) for n in names))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("root_path", "run_id").parquet(f"{self.base}/{table}")

    # --- loading ------------------------------------------------------------------------------------

    def _claimed(self, folder: str) -> int:
        """A number above all claimed in the folder so far; the file that claims it is made by one caller only."""
        fs, at = self._path(f"{self.base}/{folder}")
        fs.mkdirs(at)
        n = 1 + max(map(int, self.names(folder)), default=0)
        while not fs.createNewFile(self._path(f"{self.base}/{folder}/{n}")[1]):
            n += 1
        return n

    def claim_run_id(self) -> int:
        """A run id above all claimed so far."""
        return self._claimed("_claims")

    def _begin(self, name: str, root_path: str, observations: DataFrame, resumed: int | None) -> tuple[int, DataFrame]:
        migrations.settle(self)
        run = self.claim_run_id() if resumed is None else resumed
        if resumed is not None:
            if self.all_rows("runs").where(F.col("run_id") == run).limit(1).count():
                raise LoadRefused(f"run {run} has ended")
            if self.changed_payloads(observations, run).limit(1).count():
                raise LoadRefused(f"observations of run {run} have changed")
        one = self.spark.range(1).select(F.lit(name).alias("name"), F.lit(root_path).alias("root_path"), F.lit(None).cast("string").alias("remote_url"), F.current_timestamp().alias("created_at"), F.lit(run).alias("run_id"))
        self._put("repositories", one)
        self._put("raw_observations", with_payload_hash(observations.withColumn("run_id", F.lit(run))).withColumn("root_path", F.lit(root_path)))
        return run, self.all_rows("raw_observations").where((F.col("run_id") == run) & (F.col("root_path") == root_path))

    def _end(self, run: int, root_path: str, status: str, git_commit: str | None) -> Load:
        now = F.current_timestamp()
        row = self.spark.range(1).select(
            F.lit(run).alias("run_id"), F.lit(root_path).alias("root_path"), F.lit(git_commit).cast("string").alias("git_commit"), now.alias("started_at"), now.alias("finished_at"),
            F.lit(status).alias("status"), F.lit("{}").alias("tool_versions"),
        )
        self._put("runs", row.coalesce(1))
        return Load(run, status)

    def _tagged(self, df: DataFrame, run: int, root_path: str) -> DataFrame:
        return df.withColumns({"run_id": F.lit(run), "root_path": F.lit(root_path)})

    @contextmanager
    def _graph(self, raw: DataFrame, run: int) -> Iterator[Graph]:
        """The run's graph, over rows that are interpreted once and dropped at the end."""
        path = f"{self.base}/_interpreted/{run}"

        def keep(rows: DataFrame) -> DataFrame:
            rows.write.mode("overwrite").parquet(path)
            return self.spark.read.schema(rows.schema).parquet(path)

        try:
            yield canonicalize(raw, keep)
        finally:
            fs, p = self._path(path)
            fs.delete(p, True)

    def _write_graph(self, graph: Graph, run: int, root_path: str) -> None:
        for table, df in graph.tables().items():
            self._put(table, self._tagged(df, run, root_path))

    def _write_legacy(self, raw: DataFrame, run: int, root_path: str) -> None:
        files = legacy.files(raw)
        put = lambda t, df: self._put(t, self._tagged(df, run, root_path))
        put("files", files.withColumn("seq", F.lit(0)))
        n = legacy.relationships(raw)
        source = n.select(F.col("src_key").alias("stable_key"), F.col("src_kind").alias("kind"), F.col("src_name").alias("name"), "path", "start_line", "end_line", F.col("src_metadata").alias("metadata"), (F.col("ordinal") * 2).alias("seq"))
        target = n.select(
            F.col("dst_key").alias("stable_key"), F.col("dst_kind").alias("kind"), F.col("dst_name").alias("name"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("start_line"),
            F.lit(None).cast("int").alias("end_line"), F.to_json(F.struct(F.col("dst_key").alias("target"))).alias("metadata"), (F.col("ordinal") * 2 + 1).alias("seq"),
        )
        own = raw.where("kind = 'file'").select(F.concat(F.lit("file:"), F.col("path")).alias("stable_key"), F.lit("file").alias("kind"), F.col("path").alias("name"), "path", "start_line", "end_line", "metadata", (F.col("ordinal") * 2).alias("seq"))
        last = lambda df: legacy.last_wins(df, ["stable_key"], F.col("seq"))
        put("nodes", last(own.union(source).union(target)))
        seen = raw.where("kind = 'file' OR target IS NOT NULL").select(
            legacy.evidence_key().alias("stable_key"), "path", "start_line", "end_line", F.lit(None).cast("string").alias("excerpt"), "extractor",
            F.to_json(F.struct("extractor_version", F.col("source_id").alias("raw_source_id"))).alias("metadata"), F.col("ordinal").alias("seq"),
        )
        put("evidence", last(seen))
        put("edges", last(n.select(F.col("edge_key").alias("stable_key"), F.col("edge_kind").alias("kind"), "src_key", "dst_key", "confidence", "evidence_key", F.lit("{}").alias("metadata"), F.col("ordinal").alias("seq"))))

    def load(self, observations: DataFrame, name: str, root_path: str, git_commit: str | None = None, resumed: int | None = None) -> Load:
        """Legacy, raw and canonical rows in one run; refused, without a run, if canonicalization has an error.
        resumed: the id of a run that did not end."""
        run, raw = self._begin(name, root_path, observations, resumed)
        with self._graph(raw, run) as graph:
            if not is_loadable(graph):
                raise LoadRefused("canonicalization has errors")
            self._write_legacy(raw, run, root_path)
            self._write_graph(graph, run, root_path)
        return self._end(run, root_path, "complete", git_commit)

    def load_canonical(self, observations: DataFrame, name: str, root_path: str, git_commit: str | None = None, resumed: int | None = None) -> Load:
        """Raw and canonical rows; on an error the raw rows stay, in a run that failed, and LoadRefused is raised."""
        run, raw = self._begin(name, root_path, observations, resumed)
        with self._graph(raw, run) as graph:
            if not is_loadable(graph):
                self._put("diagnostics", self._tagged(graph.diagnostics, run, root_path))
                self._end(run, root_path, "failed", git_commit)
                raise LoadRefused("canonicalization has errors")
            self._write_graph(graph, run, root_path)
        return self._end(run, root_path, "complete", git_commit)

    def load_files(self, observations: DataFrame, name: str, root_path: str, git_commit: str | None = None, resumed: int | None = None) -> Load:
        """Legacy and raw rows only."""
        run, raw = self._begin(name, root_path, observations, resumed)
        self._write_legacy(raw, run, root_path)
        return self._end(run, root_path, "complete", git_commit)

    def changed_payloads(self, observations: DataFrame, run_id: int) -> DataFrame:
        """Ordinals that the run already holds with another payload: the guard of a repeated load."""
        held = self.all_rows("raw_observations").where(F.col("run_id") == run_id).select("ordinal", F.col("payload_hash").alias("held"))
        return with_payload_hash(observations).join(held, "ordinal").where(F.col("payload_hash") != F.col("held")).select("ordinal", "payload_hash", "held")

    def orphans(self) -> DataFrame:
        """Canonical edges an end of which is no node: none, if loads were whole."""
        return orphans(self.current("canonical_nodes"), self.current("canonical_edges"))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges an end of which is no node (of their root, where both name one), with the `end` that is lost."""
    root = roots(nodes, edges)
    known = nodes.select(*root, F.col("canonical_key").alias("k"))
    ends = edges.select(*root, F.explode(F.array("source_key", "target_key")).alias("k")).distinct()
    lost, at = ends.join(known, [*root, "k"], "left_anti"), shared_folder(edges.sparkSession, "lost")
    lost.write.parquet(at)  # keys alone are shuffled; whole edges only if so many are lost that they cannot be broadcast
    lost = edges.sparkSession.read.schema(lost.schema).parquet(at)
    e, l = edges.alias("e"), lost.alias("l")
    same = lambda end: [F.col(f"e.{a}").eqNullSafe(F.col(f"l.{b}")) for a, b in (*((r, r) for r in root), (end, "k"))]  # noqa: E731  an end that is null is lost
    of = lambda end: e.join(l, same(end), "left_semi").select(*edges.columns, F.lit(end).alias("end"))
    return of("source_key").unionByName(of("target_key"))


def seen_view(rows: DataFrame, keys: list[str], values: list[str], order: Column | str = "run_id") -> DataFrame:
    """The upsert view of any run-tagged rows."""
    order = F.col(order) if isinstance(order, str) else order
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("r"), F.min("run_id").alias("first_seen_run_id"), F.max("run_id").alias("last_seen_run_id")).select(
        *keys, *(F.col(f"r.{v}").alias(v) for v in values), "first_seen_run_id", "last_seen_run_id"
    )
