"""Snapshots, pinned readers and migrations of a store."""

import json
import os
import shutil

import pytest

from cairngraph import cli
from cairngraph.plans import manifests, migrations
from cairngraph.plans.snapshots import ranges, within
from cairngraph.plans.store import KEYS, Store
from cairngraph.sources.observations import from_rows
from cairngraph.store_queries import FIRST_SCHEMA_LACKS, observations
from tests.test_graph import obs


def load(store, spark, n, root="/r", extra=()):
    rows = [obs("file", "a.sh", language="shell", role="entrypoint", content_hash=f"h{n}"), obs("shell.command", "a.sh", 1, command="nix", target="tool:nix"), *extra]
    return store.load(from_rows(spark, rows), f"name {n}", root)


def everything(store):
    return {t: sorted(map(str, (r.asDict() for r in store.current(t).collect()))) for t in KEYS}


def test_ranges():
    assert ranges([3, 1, 2, 7, 9, 8, 2]) == ((1, 3), (7, 9)) and ranges([]) == ()
    assert within(8, ((1, 3), (7, 9))) and not within(5, ((1, 3), (7, 9)))


def test_a_snapshot_changes_no_answer(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    load(store, spark, 1, extra=[obs("shell.command", "old.sh", 3, command="gone", target="tool:gone")])
    load(store, spark, 2)
    before = everything(store)
    reader = store.pinned()
    first = store.compact()
    assert first.runs == ((1, 2),) and everything(store) == before
    # Without later runs the answer is the snapshot itself: nothing is merged, and no file of a run is read.
    plan = store.current("canonical_nodes")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and all("_snapshots" in f for f in store.current("canonical_nodes").inputFiles())
    load(store, spark, 3, extra=[obs("shell.command", "new.sh", 4, command="new", target="tool:new")])
    load(store, spark, 4, "/other")
    after = everything(store)
    assert after == everything(Store(spark, str(tmp_path))) and after != before
    files = store.current("canonical_nodes").inputFiles()
    assert not any("run_id=1" in f or "run_id=2" in f for f in files) and any("run_id=3" in f for f in files)
    assert everything(reader) == before  # pinned before all of that
    store.compact()
    assert everything(store) == after and everything(reader) == before
    assert everything(store.at("/other"))["files"] and not any("/r'" in x for x in everything(store.at("/other"))["canonical_nodes"])
    shutil.rmtree(tmp_path / "_snapshots")
    assert everything(store) == after  # all runs at once say the same


def test_a_late_run_and_a_dead_compaction(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    load(store, spark, 1)
    late = store.claim_run_id()  # run 2 is under way while run 3 ends and is compacted
    load(store, spark, 3)
    assert store.compact().runs == ((1, 1), (3, 3))
    (tmp_path / "_snapshots" / "_claims" / "2").touch()  # a compaction that died: no manifest
    (tmp_path / "_snapshots" / "2" / "files").mkdir(parents=True)
    row = from_rows(spark, [obs("file", "late.sh", language="shell", role="source")])
    store.load(row, "late", "/r", resumed=late)
    assert {r.path: (r.first_seen_run_id, r.last_seen_run_id) for r in store.current("files").collect()} == {"a.sh": (1, 3), "late.sh": (2, 2)}
    last = store.compact()
    assert last.number == 3 and last.runs == ((1, 3),)
    assert store.expire_snapshots() == [1, 2] and store.snapshot() == last
    assert {r.path for r in store.current("files").collect()} == {"a.sh", "late.sh"}
    with pytest.raises(ValueError):
        store.pinned().compact()
    with pytest.raises(ValueError):
        store.expire_snapshots(0)


def first_schema(spark, source, base):
    """A store of the first schema: without ledger, and with files that lack columns."""
    for table in ("runs", "repositories", "nodes", "files", "evidence", "edges"):
        source.rows(table).drop(*FIRST_SCHEMA_LACKS.get(table, ())).write.partitionBy("root_path", "run_id").parquet(f"{base}/{table}")
    return Store(spark, base)


def test_an_old_store_is_read_migrated_once_and_loaded(spark, tmp_path):
    new = Store(spark, str(tmp_path / "new"))
    load(new, spark, 1)
    load(new, spark, 2)
    assert [n for n, _ in migrations.ledger(new)] == [s.name for s in migrations.discover()]  # a new store starts with all steps
    old = first_schema(spark, new, str(tmp_path / "old"))
    keys = lambda s, t: sorted((r.stable_key, r.first_seen_run_id, r.last_seen_run_id) for r in s.current(t).collect())
    assert keys(old, "edges") == keys(new, "edges") and keys(old, "evidence") == keys(new, "evidence")  # before any migration
    with pytest.raises(migrations.MigrationProblem, match="must be migrated"):
        load(old, spark, 3)
    assert "stable_key" not in spark.read.parquet(f"{old.base}/edges").columns
    assert [s.name for s in migrations.apply(old)] == [s.name for s in migrations.discover()]
    assert {"stable_key", "seq"} <= set(spark.read.parquet(f"{old.base}/edges").columns)
    assert spark.read.parquet(f"{old.base}/edges").where("stable_key IS NULL").count() == 0
    assert keys(old, "edges") == keys(new, "edges")
    assert migrations.apply(old) == () and keys(old, "evidence") == keys(new, "evidence")
    assert not [n for n in old.names("_schema") if n.startswith("staged")]
    assert load(old, spark, 3).run_id > 0 and old.current("edges").count() == 1


def test_a_back_fill_goes_on_where_it_died(spark, tmp_path, monkeypatch):
    new = Store(spark, str(tmp_path / "new"))
    for n in (1, 2):
        load(new, spark, n)
    old = first_schema(spark, new, str(tmp_path / "old"))
    real, done = Store.replace, []

    def dies(self, source, target):
        if len(done) == 3:  # two runs of nodes or files are there, the next is deleted but not yet in place
            self.delete(target)
            done.append(target)
            raise OSError("executor lost")
        done.append(target)
        real(self, source, target)

    monkeypatch.setattr(Store, "replace", dies)
    with pytest.raises(OSError):
        migrations.apply(old)
    monkeypatch.setattr(Store, "replace", real)
    migrations.apply(Store(spark, old.base))
    again = Store(spark, old.base)
    for t in ("files", "nodes", "evidence", "edges"):
        assert again.rows(t).count() == new.rows(t).count(), t


def test_altered_and_unreadable_steps_are_refused(spark, tmp_path):
    folder = tmp_path / "steps"
    shutil.copytree(migrations.STEPS_FOLDER, folder)
    store = Store(spark, str(tmp_path / "store"))
    load(store, spark, 1)
    assert migrations.apply(store, str(folder)) == ()
    path = folder / "graph" / "004-add-edge-stable-key.json"
    text = path.read_text()
    path.write_text(text.replace("'edge:'", "'e:'"))
    with pytest.raises(migrations.MigrationProblem, match="altered"):
        migrations.apply(store, str(folder))
    path.write_text(text)
    os.rename(folder / "graph" / "007-allow-styles-edges.json", folder / "graph" / "0070.txt")
    with pytest.raises(migrations.MigrationProblem, match="1 steps more"):
        migrations.apply(store, str(folder))
    (folder / "graph" / "008-bad.json").write_text(json.dumps({"name": "x", "allows": {"canonical_edges": {"kind": ["likes"]}}}))
    with pytest.raises(migrations.MigrationProblem):
        migrations.apply(store, str(folder))
    for bad in ("[]", "{", '{"name": ""}', '{"name": "x", "drops": []}', '{"name": "x", "creates": ["nope"]}', '{"name": "x", "adds": {"edges": {"run_id": "1"}}}', '{"name": "add-order-in-run"}'):
        (folder / "graph" / "008-bad.json").write_text(bad)
        with pytest.raises(migrations.MigrationProblem):
            migrations.discover(str(folder))
    for changelog in ("{}", '{"include": ["nowhere"]}'):
        (folder / "changelog.json").write_text(changelog)
        with pytest.raises(migrations.MigrationProblem):
            migrations.discover(str(folder))
    with pytest.raises(migrations.MigrationProblem):
        migrations.discover(str(tmp_path / "none"))


def test_values_that_a_step_does_not_allow_stop_it(spark, tmp_path):
    folder = tmp_path / "steps"
    shutil.copytree(migrations.STEPS_FOLDER, folder)
    store = Store(spark, str(tmp_path / "store"))
    load(store, spark, 1)
    (folder / "graph" / "008-fewer-kinds.json").write_text(json.dumps({"name": "fewer-kinds", "allows": {"canonical_edges": {"kind": ["defines"]}}}))
    with pytest.raises(migrations.MigrationProblem, match="executes"):
        migrations.apply(store, str(folder))
    assert len(migrations.ledger(store)) == len(migrations.discover())


def test_commands(spark, tmp_path, capsys):
    store = Store(spark, str(tmp_path / "s"))
    load(store, spark, 1)
    assert cli.main(["compact", "--store", store.base, "--json"], spark) == 0
    assert json.loads(capsys.readouterr().out)[0]["snapshot"] == 1
    assert cli.main(["compact", "--store", store.base, "--keep", "1", "--json"], spark) == 0
    assert json.loads(capsys.readouterr().out)[0]["expired"] == [1]
    assert cli.main(["migrate", "--store", store.base, "--json"], spark) == 0 and json.loads(capsys.readouterr().out) == []
    assert cli.main(["migrate", "--store", store.base, "--steps", str(tmp_path)], spark) == 2


def test_manifests_and_runs_in_one_answer(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert manifests.ledger(store).count() == 0 and manifests.summary(store).first().source_runs == 0
    one = {"source_id": "s", "bulk_run_id": "bulk-1", "extractor_counts": {"css": 2, "html": 1}, "diagnostic_counts": {}, "total_bytes_included": 9, "limit_hit": False}
    assert manifests.publish(store, "bulk", "/r", one) == manifests.publish(store, "bulk", "/r", dict(reversed(one.items())))  # the same, told again
    manifests.publish(store, "bulk", "/other", one)
    manifests.publish(store, "api", "/r", {"source_id": "a", "api_run_id": "api-1", "total_bytes": 4})
    (tmp_path / "_manifests" / "half.json.part").write_text("{")  # a publisher that died
    store.load(from_rows(spark, [obs("file", "x.md", bulk_run_id="bulk-1"), obs("file", "y.md", bulk_run_id="bulk-2"), obs("file", "z.md")]), "r", "/r")
    got = {(r.kind, r.root_path, r.source_run_id): (r.state, r.observations, r.included_files) for r in manifests.ledger(store).collect()}
    assert got == {
        ("bulk", "/r", "bulk-1"): ("complete", 1, 3), ("bulk", "/other", "bulk-1"): ("manifest_only", None, 3), ("bulk", "/r", "bulk-2"): ("run_only", 1, None), ("api", "/r", "api-1"): ("manifest_only", None, 0),
    }
    manifests.publish(store, "bulk", "/r", one | {"total_bytes_included": 12})  # a later plan of the same run counts once
    r = manifests.summary(store.at("/r")).first()
    assert (r.source_runs, r.complete, r.manifest_only, r.run_only, r.total_bytes) == (3, 1, 1, 1, 16)
    for bad in (("feed", one), ("bulk", {"source_id": "s"})):
        with pytest.raises(ValueError):
            manifests.publish(store, bad[0], "/r", bad[1])


def test_a_load_works_in_all_tasks(spark, tiny):
    rows = observations(spark, tiny)  # one file
    assert rows.where("part = 1").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_rows_of_a_run_are_never_brought_to_one_task(spark, tiny):
    from cairngraph import store_queries
    from cairngraph.plans import migrations

    new, old = store_queries.stored(spark, tiny), Store(spark, store_queries.shared_folder(spark, "old"))
    new.rows("evidence").drop("stable_key", "seq").write.partitionBy("root_path", "run_id").parquet(f"{old.base}/evidence")
    step = next(s for s in migrations.discover() if "evidence" in s.adds)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for rows in (migrations._to_fill(old, "evidence", step), new.rows("evidence")):
            plan = rows._jdf.queryExecution().sparkPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert migrations._to_fill(old, "evidence", step).count() == new.rows("evidence").count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
