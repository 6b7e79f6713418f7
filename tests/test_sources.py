"""Sources with policies, provenance, streaming, the command line and the RPC server."""

import gzip
import io
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from cairngraph import api, cli, rpc
from cairngraph.plans import ops, provenance
from cairngraph.plans.canonicalize import canonicalize
from cairngraph.plans.store import Store
from cairngraph.functions import keys as K
from cairngraph.operators import mail
from cairngraph.sources import ingest, mailbox, numbering, remote, repository
from cairngraph.streaming.ingest import load_stream, observation_stream

TOML = '[source]\nsource_id = "s"\nsource_type = "local.directory"\npolicy_status = "allowed_with_limits"\ncorpus_kind = "mixed_corpus"\n[limits]\nmax_files = 3\nmax_total_bytes = 60\nmax_file_bytes = 40\nmax_depth = 3\n[exclude]\npaths = ["no"]\n'


@pytest.mark.parametrize("bad", ["x", TOML.replace("allowed_with_limits", "blocked"), TOML.replace("mixed_corpus", "odd"), TOML.replace("= 3\nmax_total", "= 0\nmax_total"), TOML.replace("max_files = 3", "follow_symlinks = true"), TOML + '\n[source2]\n', TOML.replace('source_id = "s"', 'api_token = "x"')])
def test_policies(bad):
    if bad.endswith("[source2]\n"):
        assert ingest.read_source(bad).source_id == "s"
    else:
        with pytest.raises(ingest.PolicyRefused):
            ingest.read_source(bad)


def test_bulk_plan_passes_over_what_does_not_fit(spark):
    sizes = {"a.md": 30, "b.md": 35, "c.md": 25, "d.md": 3, "e.md": 1, "f.md": 1, "big.md": 41, ".h.md": 1, "no/x.md": 1, "v/w/x/y.md": 1, "vendor/z.md": 1, "q.zip": 1, "q.warc": 1, "q.exe": 1}
    files = spark.createDataFrame([(p, bytearray(b"x" * n)) for p, n in sizes.items()], "path string, content binary")
    p = ingest.plan(files, ingest.read_source(TOML))
    assert sorted(r.path for r in p.included.collect()) == ["a.md", "c.md", "d.md"] and p.total_bytes == 58
    assert {r.path: r.reason for r in p.skipped.collect()} == {
        "b.md": "max_total_bytes_exceeded", "e.md": "max_files_exceeded", "f.md": "max_files_exceeded", "big.md": "max_file_bytes_exceeded", ".h.md": "hidden_excluded", "no/x.md": "excluded_path",
        "v/w/x/y.md": "max_depth_exceeded", "vendor/z.md": "excluded_directory", "q.zip": "archive_deferred", "q.warc": "warc_deferred", "q.exe": "unsupported_extension",
    }
    assert ingest.plan(files.repartition(3), ingest.read_source(TOML)).run_id == p.run_id and ingest.manifest(ingest.read_source(TOML), p)["limit_hit"]


def test_feeds_carry_provenance_to_reports(spark, tmp_path):
    body = b"<rss><channel><title>C</title><item><guid>1</guid><title>A</title><link>https://e.x/1</link><author>Al</author></item></channel></rss>"
    s = ingest.Source("f1", "rss", "allowed", url="https://u:p@e.x/feed?token=t")
    o = ingest.feed_observations(spark, s, lambda url: (body, 200, "application/rss+xml"), "2026-01-02T03:04:05Z", "artifacts/f.xml")
    assert "u:p" not in "".join(r.metadata for r in o.collect())
    store = Store(spark, str(tmp_path))
    store.load_canonical(o, "f1", "/f")
    got = api.records(api.OPERATIONS["source-feed-items"](store, {}))
    assert [(r["title"], r["link_targets"], r["source_id"]) for r in got] == [("A", ["external.url:https%3A%2F%2Fe.x%2F1"], "f1")] and len(got[0]["authors"]) == 1
    assert api.records(api.OPERATIONS["ingested-sources"](store, {}))[0]["canonical_feed_item_count"] == 1
    one = api.records(api.OPERATIONS["source-summary"](store, {"source_id": "f1"}))[0]
    assert one["feed_items"] == 1 and one["link_references"] == 1 and one["latest_acquired_at"] == "2026-01-02T03:04:05Z"
    assert api.records(api.OPERATIONS["source-summary"](store, {"source_id": "none"}))[0]["policy_status"] == "unknown"
    assert api.records(api.OPERATIONS["source-runs"](store, {"source_id": "f1"}))[0]["status_summary"] == "ok"
    status = provenance.refresh_status(spark.createDataFrame([("g", "f1"), ("h", "none")], "graph_id string, repository_name string"), store.repositories(), store.rows("runs"), store.current("canonical_nodes"), store.current("canonical_edges"), store.rows("raw_observations"))
    assert {r.graph_id: r.status for r in status.collect()} == {"g": "complete", "h": None}
    with pytest.raises(ingest.PolicyRefused):
        ingest.feed_observations(spark, ingest.Source("f", "rss", "allowed", url="http://e.x"), lambda u: (b"", 200, ""), "t", "p")


def test_api_values_are_redacted(spark):
    s = ingest.Source("a1", "api", "allowed")
    o = ingest.api_observations(spark, s, {"users": {"name": "x", "access_token": "hush", "list": [{"password": 1}]}})
    assert "hush" not in "".join(r.metadata for r in o.collect()) and canonicalize(o).diagnostics.where("severity = 'error'").count() == 0
    assert ingest.redact_value({"k": [{"secret": None}]}) == {"k": [{"secret": {"redacted": True, "redaction_reason": "secret-prone-key", "literal_type": "null"}}]}


def test_warc_import(spark, tmp_path):
    rec = lambda i: b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:%d>\r\nWARC-Target-URI: https://e.x/?token=abc\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" % i
    (tmp_path / "a.warc").write_bytes(rec(1) + rec(1) + b"WARC/9\r\n" + rec(2))
    o = ingest.warc_import(spark, str(tmp_path), ingest.Source("w", "warc", "allowed"))
    kinds = {r.kind: r.n for r in o.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"warc.document": 1, "warc.record": 2, "warc.header": 2, "warc.reference": 2, "warc.payload": 2, "warc.parse_error": 1}
    assert "abc" not in "".join(r.metadata for r in o.where("kind = 'warc.reference'").collect())
    assert canonicalize(o).diagnostics.where("severity = 'error'").count() == 0


def test_stream_loads_each_batch_once(spark, tmp_path):
    folder, store = tmp_path / "in", Store(spark, str(tmp_path / "store"))
    folder.mkdir()
    line = lambda i: json.dumps({"kind": "file", "source_id": f"p{i}", "path": f"p{i}", "confidence": "extracted", "extractor": "t", "extractor_version": "1"})
    for step in range(2):
        (folder / f"{step}.jsonl").write_text("\n".join(line(step * 10 + i) for i in range(4)) + "\nbad\n")
        load_stream(observation_stream(spark, str(folder)), store, "r", "/r", str(tmp_path / "check")).awaitTermination()
    assert store.rows("runs").count() == 2 and store.current("canonical_nodes").count() == 8


def test_command_line_and_rpc(spark, tmp_path, capsys):
    root, store = tmp_path / "repo", str(tmp_path / "store")
    (root / "bin").mkdir(parents=True)
    (root / "bin" / "run").write_text("#!/bin/sh\nbrew install jq\nexport API_TOKEN=hush\n")
    (root / "a.md").write_text("# A\n")
    assert cli.main(["discover", str(root), "--out", str(tmp_path / "obs")], spark) == 0
    assert cli.main(["host-mutators-summary", str(tmp_path / "obs"), "--json"], spark) == 0
    assert json.loads(capsys.readouterr().out)[0]["category"] == "package-management"
    assert cli.main(["load", str(root), "--store", store, "--name", "r", "--root-path", "/r"], spark) == 0
    assert cli.main(["ask", "canonical-nodes", "--store", store, "--set", "kind=file", "--json"], spark) == 0
    shown = capsys.readouterr().out
    assert {r["canonical_key"] for r in json.loads(shown[shown.index("[\n  {\n    \"canonical_key") :])} == {"file:a.md", "file:bin/run"}
    assert cli.main(["ask", "canonical-edges", "--store", store, "--set", "kind=likes"], spark) == 2
    out = io.StringIO()
    calls = [{"method": "initialize"}, {"method": "tools/list"}, {"method": "tools/call", "params": {"name": "search_nodes", "arguments": {"query": "bin"}}}, {"method": "tools/call", "params": {"name": "drop"}}, {"method": "nope"},
             {"method": "tools/call", "params": {"name": "search_nodes", "arguments": {"query": ""}}}, {"method": "tools/call", "params": {"name": "search_observations", "arguments": {"query": "API_TOKEN"}}}]
    rpc.serve(Store(spark, store), io.StringIO("\n".join([json.dumps({"jsonrpc": "2.0", "id": i} | c) for i, c in enumerate(calls)] + ["not json", ""])), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert len(got[1]["result"]["tools"]) == len(api.OPERATIONS) and json.loads(got[2]["result"]["content"][0]["text"])["rows"][0]["canonical_key"] == "file:bin/run"
    assert [g.get("error", {}).get("code") for g in got[3:5]] == [-32602, -32601] and got[5]["result"]["isError"] and got[7]["error"]["code"] == -32700


def test_every_operation_answers(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.sh").write_text("source ./b.sh\nnix build\n")
    store = Store(spark, str(tmp_path / "store"))
    store.load(repository.discover(spark, str(tmp_path / "r")), "r", "/r")
    given = {"node": "file:a.sh", "source": "file:a.sh", "kind": None, "target": "tool:nix", "query": "a", "source_id": "x", "direction": "both", "item": "feed.item:file%3Aa:x"}
    for name, op in api.OPERATIONS.items():
        a = dict(given)
        if name in ("edges", "canonical-edges"):
            a = {}
        if name == "explain-canonical-edge":
            a["kind"] = "executes"
        api.table(api.records(op(store, a), 5))
    assert api.records(api.OPERATIONS["explain-canonical-edge"](store, given | {"kind": "executes"}))[0]["evidence"]


def test_registry_and_refresh(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.md").write_text("# A\n")
    one = '[[graphs]]\nid = "{}"\nroot_path = "{}"\nrepository_name = "{}"\nenabled = {}\n'
    text = "schema_version = 1\n[odd]\n" + one.format("a", tmp_path / "r", "ra", "true") + one.format("b", tmp_path / "none", "rb", "true") + one.format("c", tmp_path, "rc", "false")
    registry = ops.read_registry(text)
    assert registry.ok and [d[:2] for d in registry.diagnostics] == [("warning", "odd")]
    store = Store(spark, str(tmp_path / "store"))
    assert [(r["graph_id"], r["status"]) for r in ops.refresh_enabled(store, registry)] == [("a", "complete"), ("b", "failed")]
    assert {r.graph_id: (r.status, r.canonical_nodes > 0) for r in ops.status(store, registry).collect()} == {"a": ("complete", True), "b": (None, False), "c": (None, False)}
    for bad in ("x =", "schema_version = 2", '[[graphs]]\nid = "a"', one.format("a", "/x", "r", "true") * 2, one.format("a", "/x", "r", "true") + 'token = "t"\n'):
        assert not ops.read_registry(bad).ok


REMOTE = """
[source]
source_id = "gh"
policy_status = "allowed"
read_only = true
credentials_ref = "env_ref:TOKEN_NAME"
[github]
owner = "some-one"
repository = "thing"
[limits]
max_items_per_run = 3
[[endpoints]]
name = "issues"
path = "/repos/{owner}/{repo}/issues"
saved_response = "issues.json"
"""


def test_github_source_is_planned_redacted_and_loaded(spark, tmp_path):
    r = remote.read_remote(REMOTE)
    p = remote.plan(r)
    assert p == remote.plan(remote.read_remote(REMOTE)) and p["requests"][0]["path"] == "/repos/some-one/thing/issues" and p["requests"][0]["data_class"] == "issues"
    issues = [{"id": 1, "title": "t", "body": "private words", "clone_url": "https://h/x.git", "url": "https://h/x?access_token=abc"}]
    (tmp_path / "issues.json").write_text(json.dumps(issues))
    made, o = remote.acquire(spark, r, remote.saved_answers(str(tmp_path)))
    assert made["total_items"] == 1 and made["responses"][0]["redacted"] and made["api_run_id"] == p["api_run_id"]
    text = "".join(x.metadata for x in o.collect())
    assert "private words" not in text and "abc" not in text and '"github_owner":"some-one"' in text and '"redacted":true' in text
    assert canonicalize(o).diagnostics.where("severity = 'error'").count() == 0
    shown = remote.redact_github(issues)[0]
    assert shown["title"] == "t" and shown["body"]["body_length"] == 13 and shown["clone_url"]["redacted"] and shown["url"]["redaction_reason"] == "sensitive_url"
    many = lambda request: remote.Answer(200, json.dumps([1, 2, 3, 4]).encode())
    for transport in (many, lambda request: remote.Answer(500, b"{}"), lambda request: remote.Answer(200, b"no")):
        with pytest.raises(ingest.PolicyRefused):
            remote.acquire(spark, r, transport)
    for old, new in (("read_only = true", "read_only = false"), ('"allowed"', '"blocked"'), ("/issues", "/keys"), ("env_ref:TOKEN_NAME", "ghp_x"), ('saved_response', 'method = "POST"\nsaved_response'), ('[limits]', '[limits]\napi_token = "x"')):
        with pytest.raises(ingest.PolicyRefused):
            remote.read_remote(REMOTE.replace(old, new))
    with pytest.raises(ingest.PolicyRefused):
        remote.saved_answers(str(tmp_path))(p["requests"][0] | {"saved_response": "../x"})
    (tmp_path / "m.json").write_text(json.dumps(made))
    total = remote.manifest_summary(remote.manifests(spark, str(tmp_path / "m.json"))).first()
    assert (total.sources, total.runs, total.requests, total.responses, total.redacted_responses, total.total_items) == (1, 1, 1, 1, 1, 1)


def test_saved_pages_and_gzipped_archives(spark, tmp_path):
    page = tmp_path / "page"
    (page / "assets").mkdir(parents=True)
    (page / "other.html").write_text("<html><body>o</body></html>")
    (page / "index.html").write_text("<html><head><link rel=stylesheet href=assets/a.css></head></html>")
    (page / "assets" / "a.css").write_text(".a { color: red }")
    s = ingest.Source("saved", "local.archive", "allowed")
    m, o = ingest.archive_observations(spark, str(page), s)
    assert m["entry_path"] == "index.html" and m["archive_kind"] == "saved-page" and sum(m["extractor_counts"].values()) == 3
    kinds = {r.kind for r in o.collect()}
    assert {"html.asset", "css.rule", "file"} <= kinds and all('"archive_kind":"saved-page"' in r.metadata for r in o.collect())
    with pytest.raises(ingest.PolicyRefused):
        ingest.archive_manifest(spark, str(page), s, "odd")

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<html><body><a href=\'http://h/x\'>x</a></body></html>"
    record = lambda kind, body: b"WARC/1.1\r\nWARC-Type: response\r\nContent-Type: %s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind, len(body), body)
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc.gz").write_bytes(gzip.compress(record(b"application/http; msgtype=response", http)) + gzip.compress(record(b"application/json", b'{"k": 1}') + record(b"image/png", b"xx")))
    o = ingest.warc_import(spark, str(tmp_path / "w"), s).collect()
    routed = {r.path for r in o if ".records/" in r.path}
    assert routed == {"a.warc.gz.records/1.html", "a.warc.gz.records/2.json"} and {"html.link", "config.path", "warc.record"} <= {r.kind for r in o}
    assert sorted(r.ordinal for r in o) == list(range(len(o))) and sum(r.kind == "warc.record" for r in o) == 3


def test_feeds_are_kept_and_plans_come_in_pages(spark, tmp_path, monkeypatch):
    body = b'<rss version="2.0"><channel><title>C</title><item><title>I</title><guid>g</guid></item></channel></rss>'
    s = ingest.Source("f", "feed", "allowed", url="https://h/feed")
    fetch = lambda url: (body, 200, "application/rss+xml")
    for _ in range(2):
        o = ingest.ingest_feed(spark, s, str(tmp_path / "kept"), "2024-01-01T00:00:00Z", fetch)
    kept = [p for p in (tmp_path / "kept" / "f").iterdir() if p.suffix == ".xml"]
    assert len(kept) == 1 and kept[0].read_bytes() == body and "feed.item" in {r.kind for r in o.collect()}
    files = spark.createDataFrame([(f"{i:02d}.txt", bytearray(b"x" * (i % 5 + 1))) for i in range(40)], "path string, content binary")
    source = ingest.Source("c", "local.directory", "allowed", max_total_bytes=50, max_files=100)
    whole = ingest.plan(files, source)
    left, taken = 50, []
    for i in range(40):
        if i % 5 + 1 <= left:
            taken.append(f"{i:02d}.txt")
            left -= i % 5 + 1
    assert sorted(r.path for r in whole.included.collect()) == taken and whole.reasons == {"max_total_bytes_exceeded": 40 - len(taken)}
    monkeypatch.setattr(ingest, "PLAN_PAGE", 3)
    paged = ingest.plan(files, source)
    assert paged.run_id == whole.run_id and paged.reasons == whole.reasons
    monkeypatch.setattr(ingest, "PLAN_RANGES", 4)
    assert ingest.plan(files, source).run_id == whole.run_id
    few = ingest.plan(files, ingest.Source("c", "local.directory", "allowed", max_total_bytes=1000, max_files=7))
    assert len(few.included.collect()) == 7 and few.reasons == {"max_files_exceeded": 33}


def test_numbers_follow_groups_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(numbering, "RANGES", 8)
    monkeypatch.setattr(numbering, "DRAWN", 16)
    rows = [(f"p{i * 7 % 50:03d}", j) for i in range(50) for j in range(i % 4 + 1)]
    df = spark.createDataFrame(rows, "path string, seq int").repartition(5)
    got = sorted((r.ordinal, r.path, r.seq) for r in numbering.numbered_by(df, "path", "seq").collect())
    assert got == [(n, *x) for n, x in enumerate(sorted(rows))]
    assert numbering.numbered_by(df.where("false"), "path", "seq").count() == 0


def test_new_commands(spark, tmp_path, capsys):
    (tmp_path / "gh.toml").write_text(REMOTE)
    (tmp_path / "issues.json").write_text('[{"id": 1}]')
    store = str(tmp_path / "store")
    run = lambda *a: cli.main(list(a), spark)
    assert run("identity") == 0 and "graph_key_version" in capsys.readouterr().out
    assert run("github-plan", str(tmp_path / "gh.toml"), "--json") == 0 and "request_id" in capsys.readouterr().out
    assert run("api-plan", str(tmp_path / "gh.toml")) == 2
    assert run("github-acquire", str(tmp_path / "gh.toml"), str(tmp_path), "--store", store, "--manifest", str(tmp_path / "m.json")) == 0
    assert json.loads((tmp_path / "m.json").read_text())["total_items"] == 1
    (tmp_path / "page").mkdir()
    (tmp_path / "page" / "index.html").write_text("<html></html>")
    (tmp_path / "s.toml").write_text('[source]\nsource_id = "s"\nsource_type = "local.archive"\npolicy_status = "allowed"\n')
    assert run("import-archive", str(tmp_path / "s.toml"), str(tmp_path / "page"), "--store", store) == 0
    (tmp_path / "g.toml").write_text(f'[[graphs]]\nid = "a"\nroot_path = "{tmp_path / "page"}"\nrepository_name = "ra"\nenabled = true\n')
    assert run("ops", "refresh-graph", str(tmp_path / "g.toml"), "--store", store, "--graph", "a", "--json") == 0
    assert '"complete"' in capsys.readouterr().out
    registry = ops.read_registry((tmp_path / "g.toml").read_text())
    call = lambda name, **a: rpc.answer(Store(spark, store), {"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": name, "arguments": a}}, registry)
    for name, arguments in (("list_graphs", {}), ("graph_status", {"graph_id": "a"}), ("refresh_status", {}), ("projects", {}), ("project_summary", {"root_path": str(tmp_path / "page")})):
        assert len(json.loads(call(name, **arguments)["result"]["content"][0]["text"])["rows"]) >= 1, name
    assert call("graph_status")["error"]["code"] == -32602 and call("files", odd=1)["error"]["code"] == -32602
    assert all(t["inputSchema"]["properties"] is not None for t in rpc.tools(registry))


@pytest.mark.parametrize("seed", range(4))
def test_a_budget_accepts_what_the_plain_fold_does(spark, monkeypatch, seed):
    rnd = random.Random(seed)
    monkeypatch.setattr(ingest, "PLAN_PAGE", 5)
    monkeypatch.setattr(ingest, "PLAN_RANGES", 6)
    sizes = {f"{rnd.randrange(10**6):06d}": rnd.choice([0, 1, 3, 40, 500, rnd.randrange(100)]) for _ in range(260)}
    rows = spark.createDataFrame(list(sizes.items()), "path string, bytes bigint")
    for most, files in ((sum(sizes.values()) // 3, 10**6), (10**6, 70), (300, 40), (0, 10**6), (sum(sizes.values()), 10**6)):
        left, number, want = most, files, []
        for path in sorted(sizes):
            if number and sizes[path] <= left:
                want.append(path)
                left -= sizes[path]
                number -= 1
        folded = []
        b = ingest.Budget(most, files)
        plain = b.fold
        monkeypatch.setattr(b, "fold", lambda page, plain=plain, folded=folded: plain(folded.append(len(page)) or page))
        b.walk(rows)
        got = sorted([r.path for r in rows.where(b.accepts()).collect()] + b.single)
        assert got == want and (b.bytes, b.files) == (left, number)
        assert max(folded, default=0) <= 5 and (most < sum(sizes.values()) or files < 260 or not folded)  # a page at most; none if all fit


@pytest.mark.parametrize("size", [17, 64, 1000, 1 << 27])
def test_a_mailbox_is_read_alike_at_any_size_of_its_ranges(spark, tmp_path, size):
    rnd = random.Random(3)
    texts = []
    for i in range(40):
        body = "\n".join(rnd.choice(["", "text é", ">From quoted", "x" * 90, "From: a", "\r"]) for _ in range(rnd.randrange(8)))
        texts.append(f"From a@b {i}\nMessage-ID: <{i}@x>\nFrom: A <a{i}@x.org>\nSubject: s{i}\n\n{body}\n".encode() + (b"\xff\xfe\n" if i % 7 == 0 else b""))
    (tmp_path / "boxes").mkdir()
    boxes = {"a.mbox": b"".join(texts), "b.mbox": b"no separator\n" + texts[3] + b"From last", "c.mbox": b"".join(texts[:1500])}
    for name, content in boxes.items():
        (tmp_path / "boxes" / name).write_bytes(content)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = sorted((r.path, r.message, r.seq, r.kind, r.source_id, r.target, r.metadata) for r in mailbox.observations(spark, str(tmp_path / "boxes")).collect())
        big = mailbox.observations(spark, str(tmp_path / "boxes"), most_bytes=150)
        assert {r.kind for r in big.where("message = 40").collect()} <= {"email.parse_error", "email.message", "email.address", "email.part"} and big.where("kind = 'email.parse_error' AND source_id LIKE '%size'").count() > 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = []
    for name, content in boxes.items():
        content = content if content.endswith(b"\n") else content + b"\n"
        heads = [m.start() for m in re.finditer(rb"(?m)^From ", content)]
        for n, (a, b) in enumerate(zip(heads, [*heads[1:], len(content)], strict=True), 1):
            raw = mail.unescaped(content[content.index(b"\n", a) + 1 : b])
            want += [(name, n, k, o["kind"], o["source_id"], o["target"], K.canonical_json(o["metadata"])) for k, o in enumerate(mail.message(name, raw, "mbox", n))]
    assert got == sorted(want) and len(want) > 200


def test_lines_of_a_mailbox_become_pieces_by_range():
    rows = [("a", 0, b"before"), ("a", 0, b"From x"), ("a", 0, b"H: 1"), ("a", 0, b""), ("a", 0, b"From y"), ("a", 9, b"rest"), ("a", 9, b"From z"), ("b", 9, b"From z"), ("b", 9, b"long enough")]
    got = list(mailbox.cut(iter(rows), 8))
    assert got == [("a", 0, 0, 7, b"before\n"), ("a", 0, 1, 6, b"H: 1\n\n"), ("a", 0, 2, 0, b""), ("a", 9, 0, 5, b"rest\n"), ("a", 9, 1, 0, b""), ("b", 9, 1, 12, None)]
    assert not list(mailbox.cut(iter(()), 8))


def test_messages_are_read_once(spark, tiny):
    from cairngraph.queries import mailbox_messages

    found = mailbox_messages(spark, tiny)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2  # the pieces, and what messages tell
    assert found.count() == spark.read.parquet(f"{tiny}/documents.parquet").where("length(text) > 0").count()


def test_headers_that_are_remembered_tell_the_same():
    raw = b"Message-ID: <1@x>\nFrom: A <a@x.org>, b@y.org\nSubject: s\nContent-Type: text/plain; charset=utf-8; name=\"%s\"\n\nhi\n"
    for name in (b"f.txt", b"f" * 2 * mail.MEMO_CHARACTERS):
        told = [list(mail.message("a.eml", raw % name, "eml")) for _ in range(2)]
        with_plain = mail.POLICY
        mail.POLICY = mail.policy.default
        try:
            assert told[0] == told[1] == list(mail.message("a.eml", raw % name, "eml"))
        finally:
            mail.POLICY = with_plain


def test_mailboxes_are_loaded(spark, tmp_path, capsys):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.mbox").write_bytes(b"From x\nMessage-ID: <1@x>\nFrom: a@x.org\n\nhi\nFrom y\nMessage-ID: <2@x>\n\nyo\n")
    assert cli.main(["import-mail", str(tmp_path / "m"), "--store", str(tmp_path / "s"), "--name", "mail", "--json"], spark) == 0
    assert json.loads(capsys.readouterr().out)[0]["status"] == "complete"
    store = Store(spark, str(tmp_path / "s"))
    assert store.current("canonical_nodes").where("kind = 'email.message'").count() == 2
    assert [r.ordinal for r in store.rows("raw_observations").orderBy("ordinal").collect()][0] == 0


def test_all_feed_items_are_told_of(spark):
    n = 60  # more than the 50 that are shown unless more are asked for
    rows = spark.range(n).withColumns({"canonical_key": F.concat(F.lit("feed.item:f:"), F.col("id").cast("string")), "ordinal": F.col("id")})
    nodes = rows.select("canonical_key", F.lit("feed.item").alias("kind"), F.lit("t").alias("display_name"), F.lit("{}").alias("metadata"))
    edges = rows.where("false").select(F.lit("references").alias("kind"), F.col("canonical_key").alias("source_key"), F.col("canonical_key").alias("target_key"))
    observed = rows.select("ordinal", F.lit("s").alias("source_id_configured"), F.lit("r").alias("source_run_id"), F.lit("x").alias("source_acquired_at"))
    tell = lambda **a: provenance.feed_items(nodes, edges, observed, rows.select("ordinal", "canonical_key"), **a).count()
    assert tell() == 50 and tell(limit=None) == n
