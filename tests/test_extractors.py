"""Extractors on small sources, and a repository from files to graph."""

import io
import json
import zipfile

import pyarrow as pa

from cairngraph.operators import base, config, css, documents, feed, html, javascript, mail, markdown, nix, python_code, ruby, shell
from cairngraph.operators.base import Context
from cairngraph.plans.canonicalize import canonicalize
from cairngraph.plans.rules import interpret
from cairngraph.sources import repository

NONE = Context()


def facts(found, kind):
    return [o for o in found if o["kind"] == kind]


def run(extract, path, content, context=NONE):
    out = list(extract(path, content, context))
    for o in out:
        said = interpret(o | {"metadata": json.dumps(o["metadata"])})
        assert not [d for d in said.diagnostics if d[0] == "error"], (o, said)
    assert len({o["source_id"] for o in out}) == len(out)
    return out


def test_shell():
    got = run(shell.extract, "bin/x", "A=1 B=$C make all # $Z\n# $Q\nsource ../lib/a.sh\n. $dyn\nsudo -u me rm -rf /tmp/x\ncp a /etc/b\ncp /etc/b a\nbad 'quote\nif true\n")
    assert [(o["metadata"]["operation"], o["name"]) for o in facts(got, "shell.env")] == [("write", "A"), ("write", "B"), ("read", "C"), ("read", "dyn")]
    assert [o["target"] for o in facts(got, "shell.source")] == ["file:lib/a.sh"]
    assert [(o["metadata"]["tool"], o["metadata"]["privileged"]) for o in facts(got, "shell.host_mutation")] == [("rm", True), ("cp", False)]
    assert [o["name"] for o in facts(got, "shell.command")] == ["make all", ".", "sudo", "cp a", "cp /etc/b"] or [o["metadata"]["command"] for o in facts(got, "shell.command")] == ["make", ".", "sudo", "cp", "cp"]


def test_python():
    known = Context(modules=frozenset({"pkg.lib.helper", "pkg.lib"}))
    got = run(python_code.extract, "src/main/python/pkg/app.py", "from pkg.lib import helper\nimport json\nfrom . import lost\nclass A:\n    async def f(self): ...\ndef g(): ...\n", known)
    assert [(o["target"], o["metadata"]["resolution"]) for o in facts(got, "python.import")] == [("python.module:pkg.lib.helper", "local"), ("external:python.module:json", "external"), ("unknown:python.module:missing-module", "unknown")]
    assert facts(got, "python.method")[0]["metadata"]["async"] is True
    assert run(python_code.extract, "a.py", "def (")[0]["kind"] == "python.parse_error"
    tests = run(python_code.extract, "tests/test_a.py", "import unittest\nclass T(unittest.TestCase):\n    def test_x(self):\n        self.assertTrue(1)\ndef test_y():\n    assert 1\n")
    assert [o["name"] for o in facts(tests, "python.test_method")] == ["test_x"] and [o["name"] for o in facts(tests, "python.pytest_test")] == ["test_y"]
    web = run(python_code.extract, "w.py", "from fastapi import FastAPI\napp = FastAPI()\n@app.get('/x')\ndef x(): ...\n")
    assert [(o["metadata"]["route_method"], o["metadata"]["route_pattern"]) for o in facts(web, "python.fastapi_route")] == [("GET", "/x")]


def test_markdown():
    text = "---\ntitle: T\napi_token: x\n---\n# A\n## B\n# A\n```\n# no\n```\n[l](b.md#c) [m](../../x) ![i](p.png) `[n](o)` <https://e.x/>\n"
    known = Context(frozenset({"docs/b.md", "docs/a.md"}), anchors={"docs/b.md": frozenset({"c"})})
    got = run(markdown.extract, "docs/a.md", text, known)
    assert [(o["metadata"]["anchor"], o["metadata"].get("parent_anchor")) for o in facts(got, "markdown.heading")] == [("a", None), ("b", "a"), ("a-1", None)]
    assert "x" not in facts(got, "markdown.frontmatter")[0]["metadata"]["values"].values()
    assert [o["target"].partition(":")[0] for o in facts(got, "markdown.link")] == ["doc.section", "unknown", "unknown", "external.url"]


def test_html_and_css():
    page = run(html.extract, "i.html", '<!doctype html><html lang=en><head><title>T</title><link rel=stylesheet href="s.css"></head><body><div class="k"><p id=a>x</p><p>y</p></div><a href="#a">1</a><a href="/z">2</a><input type=password name=pw><i></body></html>')
    pointers = [o["metadata"]["pointer"] for o in facts(page, "html.element")]
    assert "/html/body/div/p[2]" in pointers and facts(page, "html.document")[0]["metadata"]["title"] == "T"
    assert [o["target"] for o in facts(page, "html.link")] == ["html.anchor:file%3Ai.html:a", "external:file:absolute-config-reference"]
    assert [o["metadata"]["error_kind"] for o in facts(page, "html.parse_error")] == ["unclosed-element"]
    sheet = run(css.extract, "s.css", "/* x */ .k p, #a { color: red; --t: 1 } @media print { b { c: url(data:x) } } div > p {a:b} q { r { s: t } }")
    assert [o["metadata"]["selector_text"] for o in facts(sheet, "css.selector")] == [".k p", "#a", "b", "div > p", "q"]
    assert [o["metadata"]["error_kind"] for o in facts(sheet, "css.parse_error")] == ["nested-style-rule"]
    assert facts(sheet, "css.reference")[0]["metadata"]["raw_value_summary"] == "data:<redacted>"


def test_selector_matches(spark):
    page = run(html.extract, "i.html", '<html><head><link href="s.css"></head><body><div class="k"><p id=a>x</p></div><p>y</p></body></html>')
    sheet = run(css.extract, "s.css", ".k p{a:b} #a{a:b} p{a:b} .none{a:b} body > p{a:b}")
    rows = [tuple(o[n] if n != "metadata" else json.dumps(o[n]) for n in ("kind", "source_id", "path", "confidence", "target", "metadata")) for o in page + sheet]
    df = spark.createDataFrame(rows, "kind string, source_id string, path string, confidence string, target string, metadata string")
    got = {(json.loads(r.metadata)["selector_text"], json.loads(r.metadata)["html_pointer"], r.confidence) for r in css.selector_matches(df).collect()}
    assert got == {(".k p", "/html/body/div/p", "heuristic"), ("#a", "/html/body/div/p", "extracted"), ("p", "/html/body/div/p", "extracted"), ("p", "/html/body/p", "extracted")}


def test_documents():
    table = run(documents.extract, "d.csv", "name,amount,account_number,homepage\na,1,9,https://e.x/a\nb,2,8,https://e.x/b\n")
    assert [o["metadata"]["type_summary"] for o in facts(table, "document.table_column")] == ["text", "integer", "redacted", "url-like"]
    assert len(facts(table, "document.reference")) == 2
    assert run(documents.extract, "d.csv", "a,b\n1\n")[0]["metadata"]["error_kind"] == "ragged-table"
    text = run(documents.extract, "n.txt", "# One\nsee https://e.x/y. and ./a/b.txt\npassword https://no.no\n")
    assert [o["metadata"]["reference_kind"] for o in facts(text, "document.reference")] == ["url", "path"] and facts(text, "document.text_document")[0]["metadata"]["summary_redacted"]
    assert documents.without_comments(r"a \% b % c") == r"a \% b " and documents.without_comments(r"a \\% c") == r"a \\"
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        ns = ' xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0"'
        z.writestr("content.xml", f'<r{ns}><text:h text:outline-level="1">H</text:h><text:p>see https://e.x/</text:p></r>')
    odt = run(documents.odf, "n.odt", box.getvalue())
    assert [o["kind"] for o in odt] == ["document.odf_document", "document.odf_text", "document.reference"]
    assert run(documents.odf, "n.odt", b"no")[0]["metadata"]["error_kind"] == "malformed-zip"


def test_config():
    got = run(config.extract, "c.json", '{"env": {"HOME_DIR": "$HOME"}, "a": [1, {"b": 2}], "url": "https://u:p@e.x/?token=t", "api_key": "k", "p": "./x.json", "q": "../../y.json"}')
    assert all("u:p" not in json.dumps(o) and '"k"' not in json.dumps(o["metadata"].get("value_summary")) for o in got)
    assert [o["target"].partition(":")[0] for o in facts(got, "config.reference")] == ["env", "external.url", "file", "unknown"]
    assert json.loads(config.without_comments('{"a": "//x", /* c */ "b": [1,2,], // d\n}')) == {"a": "//x", "b": [1, 2]}
    lines = run(config.extract, "l.jsonl", '{"a":1}\nbad\n{"a":2}\n')
    assert facts(lines, "config.document")[0]["metadata"]["record_count"] == 2 and len(facts(lines, "config.parse_error")) == 1
    toml = run(config.extract, "t.toml", '[[tool]]\nname = "a"\nv = 1\n')
    assert "/tool/name=a/v" in [o["name"] for o in facts(toml, "config.path")]
    assert run(config.extract, "x.xml", "<!DOCTYPE a><a/>")[0]["kind"] == "xml.parse_error"
    assert [o["metadata"]["xml_pointer"] for o in facts(run(config.extract, "x.xml", "<a><b/><b/></a>"), "xml.element")] == ["/a", "/a/b[1]", "/a/b[2]"]
    req = run(config.extract, "requirements.txt", "a[x]>=1,<2 ; python_version>'3'\n-r b.txt\ngit+https://u:p@h/x\n")
    assert facts(req, "python.requirement")[0]["metadata"]["version_constraint"] == ">=1,<2" and len(facts(req, "python.reference")) == 2
    tf = run(config.extract, "m.tf", 'module "m" {\n  source = "./x"\n  password = "p"\n}\n')
    assert facts(tf, "terraform.reference")[0]["metadata"]["reference_kind"] == "module_source_local" and len(facts(tf, "terraform.redaction")) == 1


def test_yaml():
    text = """# c
a: 1
b:
  - x
  - y: "q # no"   # c
    z: {k: [1, 'two'], m: true}
  -
    - n
c: |
  one
    two
d: >-
  f
  g
'e f': ~
g: a: b
""".replace("g: a: b\n", "u: http://e.x/#f\n")
    want = {"a": 1, "b": ["x", {"y": "q # no", "z": {"k": [1, "two"], "m": True}}, ["n"]], "c": "one\n  two", "d": "f g", "e f": None, "u": "http://e.x/#f"}
    assert list(config.yaml_lite.documents(text)) == [want]
    assert list(config.yaml_lite.documents("---\na: 1\n---\nb:\n- 1\n- 2\n")) == [{"a": 1}, {"b": [1, 2]}]
    for bad in ("a: 1\na: 2", "a: [1", 'a: "x', "a: 1\n  b: 2", "\ta: 1", "a: !!python/object x"):
        assert run(config.extract, "x.yaml", bad)[0]["kind"] == "config.parse_error", bad
    got = run(config.extract, "k.yml", "apiVersion: v1\nkind: Pod\nmetadata:\n  name: p\nspec:\n  containers:\n  - name: c\n    image: r/i:1\n    env:\n      API_TOKEN: hush\n---\napiVersion: argoproj.io/v1\nkind: Application\nmetadata: {name: a}\nspec:\n  source: {repoURL: 'https://u:p@h/x'}\n")
    assert [o["name"] for o in got if o["kind"] in ("kubernetes.resource", "argocd.application")] == ["p", "a"]
    assert facts(got, "docker.reference")[0]["name"] == "r/i:1" and "hush" not in json.dumps(got) and "u:p" not in json.dumps(got)


def test_feed_and_mail():
    rss = "<rss><channel><title>C</title>" + "<item><guid>1</guid><title>A</title><author>a@b.c (Al)</author><pubDate>Tue, 30 Jun 2026 12:00:00 +0200</pubDate></item>" * 2 + "</channel></rss>"
    got = run(feed.extract, "f.xml", rss)
    assert [o["metadata"]["duplicate_disambiguator"] for o in facts(got, "feed.item")] == ["duplicate-1", "duplicate-2"]
    assert facts(got, "feed.item")[0]["metadata"]["published_at"] == "2026-06-30T10:00:00Z" and "a@b.c" not in json.dumps(facts(got, "feed.author"))
    raw = b"From: Ann <Ann@Ex.org>\nTo: b@ex.org\nMessage-ID: <1@x>\nSubject: private words\nList-Unsubscribe: <https://e.x/?token=abc>\nIn-Reply-To: <0@x>\nContent-Type: text/plain\n\nbody words\n"
    got = run(mail.extract, "m.eml", raw)
    assert all(s not in json.dumps(got) for s in ("private words", "body words", "Ann@", "ann@", "abc"))
    assert [o["metadata"]["address_domain"] for o in facts(got, "email.address")] == ["ex.org", "ex.org"]
    box = run(mail.extract, "m.mbox", b"From x\n" + raw + b"\nFrom y\n" + raw.replace(b"1@x", b"2@x"))
    assert facts(box, "email.mailbox")[0]["metadata"]["mailbox_message_count"] == 2 and len(facts(box, "email.message")) == 2


def test_nix_ruby_javascript():
    got = run(nix.extract, "flake.nix", '{ imports = [ ./m.nix ]; apps.x.t = { program = "${self}/bin/t"; }; checks.x.u = import ./c.nix; y = ../out; }')
    assert facts(got, "nix.app")[0]["metadata"]["program_path"] == "bin/t" and len(facts(got, "nix.import")) == 2
    got = run(ruby.extract, "lib/a.rb", "module A\n  class B < C\n    KEY = 1\n    def self.x; end\n    def y\n    end\n  end\nend\nrequire_relative 'z'\n")
    assert [o["name"] for o in facts(got, "ruby.class")] == ["A::B"] and facts(got, "ruby.reference")[0]["target"] == "file:lib/z.rb"
    assert not facts(got, "ruby.parse_error")
    known = Context(paths=frozenset({"src/b.ts", "src/c/index.js"}))
    got = run(javascript.extract, "src/a.ts", "import x from './b'\nexport * from './c'\nconst y = require('@s/p/q')\nimport(z)\nexport function f() {}\nclass K {\n  m() {\n  }\n}\n", known)
    assert [o["target"] for o in facts(got, "js.reference")] == ["file:src/b.ts", "file:src/c/index.js", "external:js.package:%40s%2Fp", "dynamic:js.import:computed-specifier"]
    assert javascript.next_route("app/(g)/u/[id]/page.tsx") == ("page", "/u/[id]") and javascript.next_route("pages/api/x.ts") == ("api_route", "/api/x")


def test_repository_to_graph(spark, tmp_path):
    files = {"README.md": "# Top\n[d](docs/x.md)\n", "docs/x.md": "# X\n", "bin/run": "#!/bin/sh\nnix build\n", "src/main/python/p/a.py": "import json\n", "node_modules/z.js": "x", "i.html": '<p class="k">', "s.css": ".k{a:b}", "generated/g.txt": "x"}
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(content)
    found = repository.discover(spark, str(tmp_path))
    rows = found.orderBy("ordinal").collect()
    assert [r.ordinal for r in rows] == list(range(len(rows)))
    kinds = {r.path: json.loads(r.metadata) for r in rows if r.kind == "file"}
    assert "node_modules/z.js" not in kinds and kinds["bin/run"]["language"] == "shell" and kinds["bin/run"]["role"] == "entrypoint"
    assert kinds["generated/g.txt"]["role"] == "generated" and kinds["README.md"]["role"] == "documentation"
    g = canonicalize(found)
    assert g.diagnostics.where("severity = 'error'").count() == 0
    assert g.edges.where("kind = 'links_to'").first().target_key == "doc.page:file%3Adocs%2Fx.md"


def test_javascript_limits_hold_for_frameworks_only():
    imports = "".join(f"import a{i} from './m{i}';\n" for i in range(150))
    other = "".join(f"function f{i}() {{}}\nconst v{i} = {i};\nexport class C{i} {{\n  m{i}() {{\n  }}\n}}\n" for i in range(150))
    found = run(javascript.extract, "src/a.js", imports + other)
    for kind in ("import", "reference", "function", "variable", "class", "method", "export"):
        assert len(facts(found, f"js.{kind}")) == 150
    assert not facts(found, "js.parse_error")
    routes = "import express from 'express';\nconst app = express();\n" + "".join(f"app.get('/r{i}', h);\n" for i in range(150))
    found = run(javascript.extract, "src/b.js", routes)
    assert len(facts(found, "express.route")) == 100 and len(facts(found, "js.route")) == 150
    assert [o["metadata"]["error_kind"] for o in facts(found, "js.parse_error")] == ["framework-observation-limit"]


def test_python_limits_of_tests_and_web_are_apart():
    tests = "".join(f"def test_{i}():\n    pass\n" for i in range(600))
    routes = "".join(f"@app.get('/r{i}')\ndef r{i}():\n    pass\n" for i in range(20))
    found = run(python_code.extract, "tests/test_a.py", f"from fastapi import FastAPI\napp = FastAPI()\n{tests}{routes}")
    assert len(facts(found, "python.pytest_test")) == 511 and len(facts(found, "python.test_file")) == 1
    assert len(facts(found, "python.fastapi_route")) == 20 and len(facts(found, "python.parse_error")) == 1


def test_targets_resolve_alike_at_every_size(spark, monkeypatch):
    files = {
        "README.md": "# Top\n[d](docs/x.md#part-b)\n[e](docs/x.md#none)\n[f](#top)\n[g](src/b.ts)\n[h](no.md)\n", "docs/x.md": "# X\n## Part B\n[up](../README.md#top)\n",
        "src/p/a.py": "from p.b import c\nfrom . import b\nfrom .gone import z\nimport json\n", "src/p/b.py": "c = 1\n", "src/p/__init__.py": "",
        "src/a.ts": "import x from './b';\nimport y from './c';\nimport z from './gone';\n", "src/b.ts": "export const x = 1;\n", "src/c/index.js": "module.exports = 1;\n", "t/m.tex": "\\input{part}\n\\includegraphics{i.png}\n", "t/part.tex": "x", "t/i.png": "x",
    }
    rows = spark.createDataFrame([(p, c.encode(), False) for p, c in files.items()], "path string, content binary, executable boolean")
    classified = repository.classify(rows)
    modules = frozenset(python_code.module_of(p)[0] for p in files if p.endswith(".py"))
    anchors = {p: frozenset(h["anchor"] for h in markdown.headings(c)) for p, c in files.items() if p.endswith(".md")}
    want = sorted(map(str, repository.observe(classified, context=Context(frozenset(files), modules, anchors)).collect()))
    monkeypatch.setattr(repository, "MOST_KNOWN", 1, raising=False)
    got = repository.observe(classified)
    assert sorted(map(str, got.collect())) == want
    targets = {(r.path, r.kind, r.target) for r in got.collect()}
    assert any("b.ts" in t[2] for t in targets if t[:2] == ("src/a.ts", "js.import"))
    assert want != sorted(map(str, repository.observe(classified, context=Context()).collect()))


def test_a_file_is_read_by_its_extractor_once_a_pass(spark, monkeypatch):
    """However often the result is looked at. (What files ask for one another is found in a pass of its own, which is not counted here.)"""
    files = {f"d/{i}.md": f"# T{i}\n[x]({(i + 1) % 9}.md)\n" for i in range(9)}
    rows = spark.createDataFrame([(p, c.encode(), False) for p, c in files.items()], "path string, content binary, executable boolean")
    read, real = spark.sparkContext.accumulator(0), repository._choose

    def counted(path, content, context):
        read.add(1)
        return real(path, content, context)

    monkeypatch.setattr(repository, "_choose", counted)
    found = repository.observe(repository.classify(rows), context=Context(frozenset(files)))
    assert found.count() == found.select("ordinal").distinct().count() > 9 and read.value == 9
    found = repository.observe(repository.classify(rows))
    assert found.where("kind = 'markdown.link'").count() == 9 and found.count() and read.value == 9 + 9


def test_observations_are_handed_on_in_bounded_batches():
    class Files:  # what a task is given, without a session
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    blank = dict.fromkeys((f.split()[0] for f in base.OBSERVATIONS.split(",")), None)
    many = lambda path, content: (blank | {"path": path, "metadata": {}} for _ in range(int(content)))
    run = base.extracted(Files(), many)
    files = [("a", b"5000"), ("b", b"0"), ("c", b"3"), *((f"d{i}", b"50") for i in range(100))]
    batch = pa.RecordBatch.from_arrays([pa.array([p for p, _ in files]), pa.array([c for _, c in files])], ["path", "content"])
    out = list(run(iter([batch, batch.slice(0, 0)])))
    assert max(b.num_rows for b in out) <= base.AT_ONCE
    got = [(p, s) for b in out for p, s in zip(b.column(b.schema.get_field_index("path")).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True)]
    assert got == [(p, s) for p, c in files for s in range(int(c))]


def test_extractors_of_one_small_file_work_with_all_tasks(spark, tiny):
    from cairngraph import code_queries, extractor_queries

    rows = extractor_queries.suppliers(spark, tiny)
    assert rows.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism > 1
    used = []
    for module in (extractor_queries, code_queries):
        plain = module.suppliers
        module.suppliers = lambda *a, plain=plain: used.append(1) or plain(*a)
        try:
            name = next(n for n in module.QUERIES if n in ("extract_shell", "code_ruby_blocks"))
            assert module.QUERIES[name](spark, tiny).count() > 0
        finally:
            module.suppliers = plain
    assert len(used) == 2
