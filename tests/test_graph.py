"""Keys, canonicalization, store and queries on small graphs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from cairngraph.functions import keys as K
from cairngraph.plans import legacy, query, summary
from cairngraph.plans.canonicalize import _interpreted, canonicalize, fold, is_calm, to_object
from cairngraph.plans.store import LoadRefused, Store
from cairngraph.sources import observations
from cairngraph.sources.observations import from_rows, problems, read_jsonl, write_jsonl


def obs(kind, path, n=0, confidence="heuristic", target=None, name=None, **metadata):
    return {"kind": kind, "source_id": f"{path}#{kind}:{n}", "path": path, "confidence": confidence, "extractor": "t", "extractor_version": "1", "target": target, "name": name, "metadata": metadata}


PATHS = ["a/b.py", "a/../b", "./a//b", "..", "/x", "", ".", "a b/ü%.md", "a\\b", "a/*~'\"", "x/./y/../z", "a/../../b"]


def test_keys_in_python_and_in_the_jvm_agree(spark):
    rows = spark.createDataFrame([(p,) for p in PATHS], "p string").select("p", K.file_key_col("p").alias("k")).collect()
    for r in rows:
        try:
            want = K.file_key(r.p)
        except K.KeyProblem:
            want = None
        assert r.k == want, r.p
        if want:
            assert K.parse(want)[0] == "file"
    e = spark.range(1).select(K.edge_key_col(F.lit("file:scripts/build.sh"), F.lit("writes_env"), F.lit("env:FOO")).alias("k")).first().k
    assert e == K.edge_key("file:scripts/build.sh", "writes_env", "env:FOO") == "canonical-edge:f950f097c6992e0318a1391cf1da37b30e82f4eb9192b502c9cf92f7e8da26c4"


@pytest.mark.parametrize("bad", ["", "x", "tool:", "tool:a:b", "tool:a b", "tool:%2f", "tool:%G0", "tool:%", "tool:%FF", "file:", "file:a//b", "file:a/../b", "file:a/./b", "nope:a"])
def test_bad_keys_are_refused(bad):
    assert not K.is_key(bad)


def graph(spark, rows):
    return to_object(canonicalize(from_rows(spark, rows)), len(rows))


def test_first_writer_names_a_node_and_the_strongest_confidence_wins(spark):
    g = graph(spark, [obs("shell.command", "a.sh", 1, command="nix", argv=["nix", "build"]), obs("shell.command", "a.sh", 2, "manual", command="nix", argv=["nix", "run"])])
    assert [(n["canonical_key"], n["confidence"]) for n in g["nodes"]] == [("file:a.sh", "manual"), ("tool:nix", "manual")]
    assert g["edges"][0]["metadata"] == {"argv_examples": [["nix", "build"], ["nix", "run"]], "commands": ["nix"]}
    assert g["ok"] and len(g["evidence"]) == 2 and len(g["node_evidence_links"]) == 4


def test_file_conflicts_become_lists_and_warnings(spark):
    g = graph(spark, [obs("file", "a", 1, language="x", role="source"), obs("file", "a", 2, language="y", role="test"), obs("file", "a", 3, language="x")])
    assert g["nodes"][0]["metadata"] == {"language": ["x", "y"], "role": ["source", "test"]} and g["nodes"][0]["conflict"]
    assert [(d["category"], d["field"], d["value"]) for d in g["diagnostics"]] == [("conflicting_evidence", "metadata.language", "y")]


def test_secrets_never_reach_the_graph(spark):
    g = graph(spark, [obs("shell.env", "a.sh", 1, operation="write", variable="API_TOKEN", value="hush", scope="shell")])
    assert "hush" not in json.dumps(g) and g["evidence"][0]["metadata"]["value_redacted"]


def test_errors_and_unsupported_kinds(spark):
    g = graph(spark, [obs("file", "../x"), obs("future.thing", "a"), obs("markdown.link", "a.md", target="bad key")])
    assert not g["ok"] and [d["severity"] for d in g["diagnostics"]] == ["error", "warning", "warning"]
    assert {n["canonical_key"] for n in g["nodes"]} == {"doc.page:file%3Aa.md", "unknown:external.url:malformed-markdown-link"}


def test_fold_is_ordered():
    assert json.loads(fold(['{"a":[1],"p":1}', '{"a":[2,1],"p":2}', '{"a":[3],"p":3}'])) == {"a": [1, 2, 3], "p": [[1, 2], 3]}


def plain_fold(rows):
    """Row by row, as a dictionary."""
    out = {}
    for m in rows:
        for k, v in m.items():
            if k not in out:
                out[k] = v
            elif k == "privileged_observed" and isinstance(out[k], bool) and isinstance(v, bool):
                out[k] = out[k] or v
            elif isinstance(out[k], list) and isinstance(v, list):
                for x in v:
                    out[k] = out[k] if x in out[k] else [*out[k], x]
            elif out[k] != v:
                out[k] = [out[k], v]
    return out


def test_fold_equals_the_plain_one():
    rnd = random.Random(5)
    value = lambda: rnd.choice([1, 2, "x", True, False, None, [], [1], ["x", 1], [[1, 2]], [[1, "x"], 2], {"a": 1}])
    for _ in range(3000):
        rows = [{k: value() for k in rnd.sample(["a", "b", "privileged_observed"], rnd.randrange(4))} for _ in range(rnd.randrange(1, 7))]
        assert json.loads(fold(map(json.dumps, rows))) == plain_fold(rows)
        distinct = list({json.dumps(m, sort_keys=True): m for m in rows}.values())
        if is_calm([json.dumps(m) for m in distinct]):
            assert plain_fold(distinct) == plain_fold(rows)
    deep = fold(['{"a":1}', '{"a":2}'] * 50_000)  # as deep as there are rows
    assert deep.startswith('{"a":' + "[" * 99_999 + "1,2],1],2]") and deep.count("]") == 99_999


@pytest.mark.parametrize("seed", range(3))
def test_edges_fold_all_rows_in_order_whatever_the_partitioning(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for n in range(120):
        hub = rnd.choice(["a.xml", "b.xml", "c.xml"])
        facts = {"feed_format": rnd.choice(["rss", "atom", "json"] if hub != "c.xml" else ["rss"]), "not_fetched": rnd.choice([True, False] if hub == "a.xml" else [True]), "rel": rnd.choice([None, "self"])}
        rows.append(obs("feed.link", hub, n, target="external.url:http%3A%2F%2Fx%2F" + str(rnd.randrange(3)), source_key="feed.document:file%3A" + hub, field="link", **{k: v for k, v in facts.items() if v is not None}))
    plain = canonicalize(from_rows(spark, rows).coalesce(1))
    want: dict = {}
    interpreted = [(r.ordinal, e) for r in _interpreted(from_rows(spark, rows)).collect() for e in r.edges]
    for _, e in sorted(interpreted, key=lambda x: x[0]):
        want.setdefault((e.source, e.kind, e.target), []).append(json.loads(e.metadata))
    assert want and any(len({json.dumps(m) for m in ms}) > 2 for ms in want.values())
    for graph_ in (plain, canonicalize(from_rows(spark, rows).repartition(9))):
        got = {(r.source_key, r.kind, r.target_key): json.loads(r.metadata) for r in graph_.edges.collect()}
        assert got == {k: plain_fold(ms) for k, ms in want.items()}


def test_partitioning_does_not_change_the_graph(spark):
    rows = [obs("shell.command", f"{i % 3}.sh", i, ["heuristic", "manual"][i % 2], command=f"t{i % 4}", argv=[str(i % 5)]) for i in range(40)]
    df = from_rows(spark, rows)
    assert to_object(canonicalize(df.repartition(7)), 40) == to_object(canonicalize(df.coalesce(1)), 40)


def test_store_appends_runs_and_keeps_first_and_last_seen(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    first = [obs("file", "a.sh", language="shell", role="entrypoint"), obs("shell.command", "a.sh", 1, command="nix", target="tool:nix"), obs("shell.host_mutation", "a.sh", 2, target="host.category:package-management", category="package-management", tool="brew", privileged=True, argv=["brew"])]
    assert store.load(from_rows(spark, first), "r", "/r").run_id == 1
    assert store.load(from_rows(spark, first[:2]), "r2", "/r").run_id == 2
    nodes = {r.canonical_key: (r.first_seen_run_id, r.last_seen_run_id) for r in store.current("canonical_nodes").collect()}
    assert nodes == {"file:a.sh": (1, 2), "tool:nix": (1, 2), "host.category:package-management": (1, 1)}
    assert store.repositories().first().name == "r2" and store.orphans().count() == 0
    assert store.latest_runs().first().run_id == 2
    changed = [first[0] | {"metadata": {"language": "x"}}, *first[1:2]]
    assert [r.ordinal for r in store.changed_payloads(from_rows(spark, changed), 2).collect()] == [0]
    with pytest.raises(LoadRefused):
        store.load(from_rows(spark, [obs("file", "/abs")]), "r", "/r")
    with pytest.raises(LoadRefused):
        store.load_canonical(from_rows(spark, [obs("file", "/abs")]), "r", "/r")
    assert {r.run_id: r.status for r in store.rows("runs").collect()} == {1: "complete", 2: "complete", 4: "failed"}
    assert [r.path for r in legacy.entrypoints(store.current("files")).collect()] == ["a.sh"]
    m = legacy.host_mutator_summary(legacy.host_mutators(store.rows("raw_observations"))).collect()
    assert [(r.category, r.tool, r.n, r.privileged) for r in m] == [("package-management", "brew", 1, 1)]
    edges = store.current("canonical_edges")
    assert query.canonical_host_mutators(edges, "package-management", "brew").count() == 1
    got = query.explain_edge(edges, store.rows("canonical_edge_evidence"), store.rows("canonical_evidence"), store.rows("raw_observations"), "file:a.sh", "executes", "tool:nix").first()
    assert [(e.run_id, e.ordinal, e.observed_kind) for e in got.evidence] == [(1, 1, "shell.command"), (2, 1, "shell.command")]
    assert summary.canonical_storage(store).first().canonical_nodes == 3


def test_neighbourhoods(spark):
    edges = [obs("shell.source", "a.sh", 1, resolved_path="b.sh"), obs("shell.source", "b.sh", 2, resolved_path="a.sh"), obs("shell.source", "a.sh", 3, resolved_path="a.sh"), obs("shell.source", "c.sh", 4, resolved_path="b.sh")]
    g = canonicalize(from_rows(spark, edges))
    for direction, n, others in (("in", 2, {"file:b.sh"}), ("out", 2, {"file:b.sh"}), ("both", 3, {"file:b.sh"})):
        _, near, found = query.neighborhood(g.nodes, g.edges, "file:a.sh", direction)
        assert near.count() == n and {r.canonical_key for r in found.collect()} == others
    assert query.neighborhood(g.nodes, g.edges, "file:none", "both")[1].count() == 0
    with pytest.raises(ValueError):
        query.neighborhood(g.nodes, g.edges, "file:a.sh", "sideways")
    with pytest.raises(ValueError):
        query.canonical_edges(g.edges, "likes")


def test_search_pages(spark):
    nodes = canonicalize(from_rows(spark, [obs("file", f"x{i:02d}.py") for i in range(7)])).nodes
    rows = query.search(nodes, "nodes", "X0", limit=3, offset=3).collect()
    page = query.page(rows, 3, 3)
    assert [r.canonical_key for r in page["rows"]] == ["file:x03.py", "file:x04.py", "file:x05.py"] and page["has_more"] and page["total"] == 6
    for bad in ("", "q" * 201):
        with pytest.raises(ValueError):
            query.validate_query(bad)


def test_json_lines_round_trip_and_report_bad_lines(spark, tmp_path):
    df = from_rows(spark, [obs("file", f"p{i}", language="é") for i in range(9)])
    write_jsonl(df, str(tmp_path / "out"))
    back = read_jsonl(spark, str(tmp_path / "out"))
    key = lambda x: sorted((r.ordinal, r.path, r.metadata) for r in x.collect())
    assert key(back) == key(df)
    (tmp_path / "bad.jsonl").write_text('{"kind":"file"}\n\nnot json\n' + json.dumps(obs("file", "ok")) + "\n")
    assert [(r.line) for r in problems(spark, str(tmp_path / "bad.jsonl")).orderBy("line").collect()] == [1, 3]
    with pytest.raises(Exception, match="line 1"):
        read_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()


def test_json_lines_of_one_file_are_read_by_ranges(spark, tmp_path):
    many = [json.dumps(obs("file", f"p{i}")) + "\n" * (1 + i % 3) for i in range(50)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_bytes("".join(many).replace("\n", "\r\n").encode())
    (tmp_path / "in" / "b.jsonl").write_text("\n" + "".join(many)[:-2])
    (tmp_path / "in" / "c.jsonl").write_text("\n \n")
    old = {n: spark.conf.get(n) for n in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for n in old:
            spark.conf.set(n, "500")
        assert observations.lines(spark, str(tmp_path / "in" / "a.jsonl")).rdd.getNumPartitions() > 5
        back = sorted((r.ordinal, r.path) for r in read_jsonl(spark, str(tmp_path / "in")).collect())
        assert back == [(i, f"p{i % 50}") for i in range(100)]
        text = "".join(many) + "bad\n" + "".join(many) + "[]"
        (tmp_path / "bad.jsonl").write_text(text)
        bad = [(i, line) for i, line in enumerate(text.split("\n"), 1) if line in ("bad", "[]")]
        assert sorted(r.line for r in problems(spark, str(tmp_path / "bad.jsonl")).collect()) == [i for i, _ in bad]
    finally:
        for n, v in old.items():
            spark.conf.set(n, v)


@pytest.mark.parametrize("name", sorted(summary.SUMMARIES))
def test_summaries_are_one_row(spark, name):
    g = from_rows(spark, [obs("python.flask_route", "a.py"), obs("ruby.file", "a.rb", target="ruby.file:file%3Aa.rb", profile="rake"), obs("js.test_expectation", "a.js", expectation_count=3), obs("openapi.operation", "o.json", method="get"), obs("terraform.file", "x.auto.tfvars", file_family="tfvars")])
    c = canonicalize(g)
    row = summary.summarize(name, g, c.nodes, c.edges).collect()
    assert len(row) == 1
    want = {"ruby": ("ruby_files", 1), "js": ("test_expectations", 3)}.get(name)
    if want:
        assert row[0][want[0]] == want[1]
    if name == "python":
        assert row[0].frameworks.flask_routes == 1
    if name == "openapi":
        assert row[0].methods["get"] == 1
    if name == "terraform":
        assert row[0].file_families.auto_tfvars == 1 and row[0].file_families.tfvars == 0


def test_edges_with_a_lost_end_are_found_without_moving_the_edges(spark, tiny):
    from cairngraph import queries
    from cairngraph.plans.store import orphans

    nodes = spark.createDataFrame([("r", "a"), ("r", "b"), ("s", "c")], "root_path string, canonical_key string")
    rows = [("r", "a", "b"), ("r", "a", "c"), ("s", "x", "c"), ("s", "x", "y"), ("r", None, "a")]
    edges = spark.createDataFrame(rows, "root_path string, source_key string, target_key string")
    got = sorted((tuple(x or "" for x in r) for r in orphans(nodes, edges).collect()))
    assert got == [("r", "", "a", "source_key"), ("r", "a", "c", "target_key"), ("s", "x", "c", "source_key"), ("s", "x", "y", "source_key"), ("s", "x", "y", "target_key")]
    found = queries.fk_orphans_anti(spark, tiny)
    joined = found._jdf.queryExecution().sparkPlan().toString()
    assert found.count() == 0 and "SortMergeJoin" not in joined and joined.count("BroadcastHashJoin") >= 2
