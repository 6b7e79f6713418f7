"""A query for each family of rules: observations of all its kinds, one of each a supplier, are canonicalised, and nodes
and edges with their metadata come back. The SQL beside it is made from the same cases: what a kind's nodes and edges are
called stands in the case, the metadata that they keep in the contract's tables (plans/rules.py).

`@n` stands for the supplier's number in all texts.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairngraph.plans.canonicalize import canonicalize
from cairngraph.plans.rules import EDGE_FLAGS, EDGE_METADATA, NODE_METADATA

CONFIDENCE = "extracted"


def _fields(contract: str) -> dict[str, str]:
    """field: the name that the graph gives it ('' for its own, as it is)"""
    return {a: b for a, _, b in (p.partition(">") for p in contract.split())}


@dataclass
class Case:
    """An observation and what it asserts. node: the contract of the first node that `nodes` marks with its own metadata;
    edge: the contract of all edges. more: metadata besides what the contracts name."""

    kind: str
    path: str
    nodes: list[tuple[str, str, bool]]  # key, display name, whether it carries the node's metadata
    edges: list[tuple[str, str, str]] = field(default_factory=list)
    node: str | None = None
    edge: str | None = None
    name: str | None = None
    target: str | None = None
    more: dict = field(default_factory=dict)
    node_metadata: dict | None = None
    edge_metadata: dict | None = None

    def metadata(self) -> dict:
        names = [*_fields(NODE_METADATA.get(self.node, "")), *_fields(EDGE_METADATA.get(self.edge, ""))]
        flags = dict.fromkeys(_fields(EDGE_FLAGS.get(self.edge, "")), True)
        return {n: f"{n}-@n" for n in names} | flags | {"beyond_the_contract": "@n"} | self.more

    def of_node(self) -> dict:
        m = self.metadata()
        return self.node_metadata if self.node_metadata is not None else {n: m[n] for n in _fields(NODE_METADATA.get(self.node, ""))}

    def of_edge(self) -> dict:
        if self.edge_metadata is not None:
            return self.edge_metadata
        m = self.metadata()
        renamed = {b or a: [m[a]] if b else m[a] for a, b in _fields(EDGE_METADATA.get(self.edge, "")).items() if not (b and isinstance(m[a], bool))}
        return renamed | {b: m[a] for a, b in _fields(EDGE_FLAGS.get(self.edge, "")).items()}


def _json(value: dict) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def _column(template: str | None) -> Column:
    if template is None:
        return F.lit(None).cast("string")
    first, *rest = template.split("@n")
    return F.concat(F.lit(first), *(x for r in rest for x in (F.col("n"), F.lit(r))))


def _sql(template: str) -> str:
    return " || n || ".join("'" + part.replace("'", "''") + "'" for part in template.split("@n"))


def _file(path: str) -> str:
    return "file%3A" + path.replace("/", "%2F")


def defined(kind: str, path: str, key: str, display: str, node: str | None, edge: str, source: str | None = None, **rest) -> Case:
    """source -defines-> key; the source is the file unless named."""
    src = source or f"file:{path}"
    return Case(kind, path, [(src, path if source is None else src.rpartition(":")[2], False), (key, display, True)], [(src, "defines", key)], node, edge, **rest)


def referred(kind: str, path: str, source: str, target: str, edge: str, verb: str = "references", **rest) -> Case:
    """source -verb-> target, both only inferred."""
    shown = path if source.startswith("file:") else source.rpartition(":")[2]
    return Case(kind, path, [(source, shown, False), (target, target.rpartition(":")[2], False)], [(source, verb, target)], None, edge, target=target, **rest)


def _shell() -> list[Case]:
    p, f = "s/@n.sh", "file:s/@n.sh"
    edge = lambda dst, kind, shown=None: ([(f, p, False), (dst, shown or dst.rpartition(":")[2], False)], [(f, kind, dst)])
    plain = {"node_metadata": {}}
    return [
        Case("file", "s/@n.sh", [(f, p, True)], node_metadata={"content_hash": "h@n", "executable": True, "generated": False, "language": "shell", "role": "entrypoint"},
             more={"content_hash": "h@n", "executable": True, "generated": False, "language": "shell", "role": "entrypoint"}),
        Case("shell.command", p, *edge("tool:tool-@n", "executes", "tool-@n"), more={"command": "tool-@n", "argv": ["tool-@n", "x"]}, edge_metadata={"argv_examples": [["tool-@n", "x"]], "commands": ["tool-@n"]}, **plain),
        Case("shell.command", p, *edge("dynamic:tool:why-@n", "executes", "why-@n"), more={"dynamic_reason": "why-@n"}, edge_metadata={"dynamic_reasons": ["why-@n"]}, **plain),
        Case("shell.command", p, *edge("unknown:tool:missing-command", "executes"), edge_metadata={}, **plain),
        Case("shell.source", p, *edge("file:s/lib@n.sh", "sources"), edge="shell.source", more={"resolved_path": "s/x/../lib@n.sh"}, **plain),
        Case("shell.source", p, *edge("dynamic:file:var-@n", "sources"), more={"dynamic_reason": "var-@n"}, edge_metadata={}, **plain),
        Case("shell.source", p, *edge("unknown:file:repo-escaping-source", "sources"), more={"resolved_path": "../../x"}, edge_metadata={"resolved_paths": ["../../x"]}, **plain),
        Case("shell.env", p, *edge("env:VAR_@n", "writes_env"), more={"operation": "write", "variable": "VAR_@n", "value": "v@n", "scope": "export"}, edge_metadata={"operations": ["write"], "scopes": ["export"], "values": ["v@n"]}, **plain),
        Case("shell.env", p, *edge("env:API_TOKEN_@n", "writes_env"), more={"operation": "write", "variable": "API_TOKEN_@n", "value": "hush"}, edge_metadata={"operations": ["write"], "value_redacted": True}, **plain),
        Case("shell.env", p, *edge("env:HOME@n", "reads_env"), more={"operation": "read", "variable": "HOME@n"}, edge_metadata={"operations": ["read"]}, **plain),
        Case("shell.host_mutation", p, *edge("host.category:package-management", "mutates_host"), more={"category": "package-management", "tool": "t@n", "argv": ["t@n"], "effective_argv": ["t"], "privileged": True, "reason": "r@n"},
             edge_metadata={"argv_examples": [["t@n"]], "effective_argv_examples": [["t"]], "privileged_observed": True, "reasons": ["r@n"], "tools": ["t@n"]}, **plain),
        Case("shell.host_mutation", p, *edge("unknown:host.category:unregistered-odd", "mutates_host"), more={"category": "odd"}, edge_metadata={}, **plain),
    ]


def _python() -> list[Case]:
    p, f = "p/@n.py", "file:p/@n.py"
    d = lambda kind, key, shown, plural, **more: Case(f"python.{kind}", p, [(f, p, False), (key, shown, False)], [(f, "defines", key)], name=more.pop("name"), more={"module": "p.m@n"} | more, edge_metadata={plural: [shown]})
    i = lambda dst, **more: Case("python.import", p, [("python.module:p.m@n", "p.m@n", False), (dst, dst.rpartition(":")[2], False)], [("python.module:p.m@n", "imports", dst)], target=more.pop("target", None), more={"module": "p.m@n"} | more,
                                   edge_metadata={"imported_modules": [more["imported_module"]], "resolutions": [more["resolution"]]})
    return [
        d("module", "python.module:p.m@n", "p.m@n", "modules", name=None),
        d("class", "python.class:p.m@n:C@n", "C@n", "classes", name="C@n"),
        d("function", "python.function:p.m@n:f@n", "f@n", "functions", name="f@n"),
        d("method", "python.method:p.m@n:C@n:g", "C@n.g", "methods", name="g", **{"class": "C@n"}),
        i("python.module:p.other@n", imported_module="p.other@n", resolution="local"),
        i("external:python.module:os@n", imported_module="os@n", resolution="external"),
        i("unknown:python.module:lost@n", imported_module="lost@n", resolution="unknown", target="unknown:python.module:lost@n"),
    ]


def _nix() -> list[Case]:
    p, f = "n/@n.nix", "file:n/@n.nix"
    imports = lambda dst, **more: Case("nix.import", p, [(f, p, False), (dst, dst.rpartition(":")[2], False)], [(f, "sources", dst)], edge="nix.import", more=more, node_metadata={})
    out = [
        imports("file:n/lib@n.nix", resolved_path="n/lib@n.nix"),
        Case("nix.import", p, [(f, p, False), ("dynamic:file:expr-@n", "expr-@n", False)], [(f, "sources", "dynamic:file:expr-@n")], more={"dynamic_reason": "expr-@n"}, edge_metadata={}, node_metadata={}),
    ]
    for kind, plural in (("package", "packages"), ("devShell", "devShells"), ("check", "checks")):
        key = f"nix.{kind}:.:x86@n:o@n"
        m = {"flake_ref": ".", "system": "x86@n", "attr_path": f"a.{kind}", "output_kind": kind}
        out.append(Case(f"nix.{kind}", p, [(f, p, False), (key, "o@n", False)], [(f, "defines", key)], name="o@n", more=m, edge_metadata={"flake_refs": ["."], "systems": ["x86@n"], "attr_paths": [f"a.{kind}"], "output_kinds": [kind], plural: ["o@n"]}))
    return out


def _nix_apps() -> list[Case]:
    """An app defines itself and exposes its script, with metadata of its own."""
    p, f, key = "n/a@n.nix", "file:n/a@n.nix", "nix.app:.:x86@n:run@n"
    m = {"flake_ref": ".", "system": "x86@n", "program": "prog", "program_path": "bin/run@n.sh"}
    return [Case("nix.app", p, [(f, p, False), (key, "run@n", False), ("file:bin/run@n.sh", "bin/run@n.sh", False)], [(key, "exposes_script", "file:bin/run@n.sh")], name="run@n", more=m,
                 edge_metadata={"flake_refs": ["."], "systems": ["x86@n"], "programs": ["prog"], "program_paths": ["bin/run@n.sh"]})]


def _markdown() -> list[Case]:
    p = "docs/@n.md"
    page, section = f"doc.page:{_file(p)}", f"doc.section:{_file(p)}:anchor-@n"
    return [
        defined("markdown.document", p, page, "title-@n", "markdown.document", "markdown.definition"),
        defined("markdown.heading", p, section, "text-@n", "markdown.heading", "markdown.definition"),
        defined("markdown.adr_metadata", p, "doc.adr:adr_number-@n", "title-@n", "markdown.adr_metadata", "markdown.definition"),
        defined("markdown.skill_metadata", p, "doc.skill:skill_name-@n", "skill_name-@n", "markdown.skill_metadata", "markdown.definition"),
        referred("markdown.link", p, page, "doc.page:file%3Adocs%2Fother%40n.md".replace("%40n", "@n"), "markdown.link", "links_to"),
        referred("markdown.link", p, section, "external.url:http%3A%2F%2Fh%2F@n", "markdown.link", "links_to", more={"source_anchor": "anchor-@n"}),
        Case("markdown.frontmatter", "docs/front@n.md", [("doc.page:file%3Adocs%2Ffront@n.md", "docs/front@n.md", True)], more={"keys": ["a", "k@n"], "parse_status": "ok"}, node_metadata={"frontmatter_keys": ["a", "k@n"], "frontmatter_parse_statuses": ["ok"]}),
        Case("markdown.code_fence", "docs/fence@n.md", [("doc.page:file%3Adocs%2Ffence@n.md", "docs/fence@n.md", True)], more={"language": "l@n", "closed": True}, node_metadata={"code_fence_languages": ["l@n"], "code_fence_closed_observed": True}),
    ]


def _config() -> list[Case]:
    p = "c/@n.json"
    doc, key = f"config.document:{_file(p)}", f"config.path:{_file(p)}:pointer-@n"
    return [
        defined("config.document", p, doc, "document_role-@n", "config.document", "config.definition"),
        defined("config.path", p, key, "pointer-@n", "config.path", "config.definition", source=doc),
        referred("config.reference", p, doc, "file:c/ref@n.json", "config.reference"),
        referred("config.reference", p, key, "external.url:u@n", "config.reference", more={"source_key": key}),
    ]


def _html() -> list[Case]:
    p = "h/@n.html"
    doc, one, head = f"html.document:{_file(p)}", f"html.element:{_file(p)}:pointer-@n", f"html.element:{_file(p)}:source_element_pointer-@n"
    return [
        defined("html.document", p, doc, "doc @n", "html.document", "html.definition", name="doc @n"),
        defined("html.element", p, one, "el @n", "html.element", "html.definition", source=doc, name="el @n"),
        defined("html.heading", p, head, "head @n", "html.heading", "html.definition", source=doc, name="head @n"),
        referred("html.link", p, doc, "external.url:http%3A%2F%2Fh%2F@n", "html.reference"),
        referred("html.asset", p, one, "file:h/@n.css", "html.reference", more={"source_key": one}),
        referred("html.form", p, head, "file:h/form@n", "html.reference", more={"source_key": head}),
    ]


def _xml() -> list[Case]:
    p = "x/@n.xml"
    doc, one, at = f"xml.document:{_file(p)}", f"xml.element:{_file(p)}:xml_pointer-@n", f"xml.attribute:{_file(p)}:e:a@n"
    return [
        defined("xml.document", p, doc, "doc @n", "xml.document", "xml.definition", name="doc @n"),
        defined("xml.element", p, one, "el @n", "xml.element", "xml.definition", source=doc, name="el @n"),
        defined("xml.attribute", p, at, "at @n", "xml.attribute", "xml.definition", source=one, name="at @n", target=at, more={"source_key": one}),
        referred("xml.reference", p, at, "external.url:ns@n", "xml.reference", more={"source_key": at}),
    ]


def _css() -> list[Case]:
    p = "y/@n.css"
    doc, rule, sel, prop = (f"css.{k}:{_file(p)}{r}" for k, r in (("document", ""), ("rule", ":rule_pointer-@n"), ("selector", ":selector_pointer-@n"), ("custom_property", ":property_name-@n")))
    return [
        defined("css.document", p, doc, "doc @n", "css.document", "css.definition", name="doc @n"),
        defined("css.rule", p, rule, "rule @n", "css.rule", "css.definition", source=doc, name="rule @n"),
        defined("css.selector", p, sel, "sel @n", "css.selector", "css.definition", source=rule, name="sel @n", more={"source_key": rule}),
        defined("css.custom_property", p, prop, "prop @n", "css.custom_property", "css.definition", source=rule, name="prop @n", more={"source_key": rule}),
        referred("css.reference", p, rule, "file:y/img@n.png", "css.reference", more={"source_key": rule}),
        referred("css.selector_match", p, sel, "html.element:file%3Ah%2F@n.html:p", "css.selector_match", "styles", more={"source_key": sel}),
    ]


def _feed() -> list[Case]:
    p = "f/@n.xml"
    doc = f"feed.document:{_file(p)}"
    channel, item, author, category = (f"feed.{k}:{_file(p)}:{k}-@n" for k in ("channel", "item", "author", "category"))
    part = lambda kind, key, source, **more: defined(f"feed.{kind}", p, key, "title-@n", "feed", "feed.definition", source=source, target=key, more={"source_key": source} | more)
    return [
        defined("feed.document", p, doc, "title-@n", "feed", "feed.definition"),
        part("channel", channel, doc),
        part("item", item, channel),
        part("author", author, channel),
        part("category", category, channel),
        referred("feed.link", p, item, "external.url:l@n", "feed.reference", more={"source_key": item}),
        referred("feed.enclosure", p, item, "external.url:e@n", "feed.reference", more={"source_key": item}),
    ]


def _warc() -> list[Case]:
    p = "w/@n.warc"
    doc, record = f"warc.document:{_file(p)}", f"warc.record:{_file(p)}:r@n"
    return [
        defined("warc.document", p, doc, "doc @n", "warc", "warc.definition", name="doc @n"),
        defined("warc.record", p, record, "rec @n", "warc", "warc.definition", source=doc, name="rec @n", target=record),
        referred("warc.reference", p, record, "external.url:t@n", "warc.reference", more={"source_key": record}),
    ]


def _ruby() -> list[Case]:
    p = "r/@n.rb"
    file = f"ruby.file:{_file(p)}"
    keys = {"module": "ruby.module:M@n", "class": "ruby.class:C@n", **{k: f"ruby.{k}:{_file(p)}:{k}@n" for k in ("method", "singleton_method", "constant", "test_case", "test_method", "route")}}
    return [
        defined("ruby.file", p, file, "file @n", "ruby", "ruby.definition", name="file @n"),
        *(defined(f"ruby.{k}", p, key, f"{k} @n", "ruby", "ruby.definition", source=file, name=f"{k} @n", target=key, more={"source_key": file}) for k, key in keys.items()),
        referred("ruby.reference", p, keys["class"], "external:ruby:gem@n", "ruby.reference", more={"source_key": keys["class"]}),
    ]


def _js() -> list[Case]:
    p = "j/@n.js"
    file, module = f"js.file:{_file(p)}", f"js.module:{_file(p)}"
    keys = {k: f"js.{k}:{_file(p)}:{k}@n" for k in ("function", "class", "method", "variable", "component", "test_suite", "test_case", "route")}
    return [
        defined("js.file", p, file, "file @n", "js", "js.definition", name="file @n"),
        defined("js.module", p, module, "module @n", "js", "js.definition", source=file, name="module @n", more={"source_key": file}),
        *(defined(f"js.{k}", p, key, f"{k} @n", "js", "js.definition", source=module, name=f"{k} @n", target=key, more={"source_key": module}) for k, key in keys.items()),
        referred("js.reference", p, module, "external:npm:pkg@n", "js.reference"),
    ]


def _document() -> list[Case]:
    out = []
    parts = {
        "document.text_document": None, "document.latex_document": None, "document.odf_document": None, "document.text_section": "section", "document.latex_section": "section",
        "document.odf_text": "section", "document.table_document": "table", "document.odf_table": "table", "document.odf_sheet": "sheet", "document.table_column": "column",
        "document.odf_column": "column", "document.latex_command": "latex_command",
    }
    shown = {"section": "heading_summary-@n", "table": "display_name-@n", "sheet": "display_name-@n", "column": "column_name_summary-@n", "latex_command": "part @n"}
    for i, (kind, part) in enumerate(parts.items()):
        p = f"o{i}/@n.x"
        doc = f"document.file:{_file(p)}"
        case = defined(kind, p, doc, p, f"document.{part}" if part else "document.file", "document.definition", name="part @n")
        if part:
            key = f"document.{part}:{_file(p)}:pointer-@n"
            # The document itself keeps what its own contract shares with the part's metadata; its mention stands in `extra`.
            case.nodes = [(f"file:{p}", p, False), (key, shown[part], True)]
            case.edges.append((doc, "defines", key))
        out.append(case)
    doc = f"document.file:{_file('o0/@n.x')}"
    return [*out, referred("document.reference", "o0/@n.x", doc, "external.url:d@n", "document.reference")]


def _email() -> list[Case]:
    p = "e/@n.eml"
    box, message = f"email.mailbox:{_file(p)}", f"email.message:{_file(p)}:m@n"
    keys = {k: f"email.{k}:m@n:{k}@n" for k in ("part", "attachment_stub", "thread_hint")}
    return [
        defined("email.mailbox", p, box, "email mailbox (3 messages)", "email.mailbox", "email.definition", target=box, more={"mailbox_message_count": 3}),
        defined("email.message", p, message, "email message message_id_h", "email.message", "email.definition", source=box, target=message, more={"source_key": box}),
        *(defined(f"email.{k}", p, key, "part_path-@n", f"email.{k}", "email.definition", source=message, target=key, more={"source_key": message}) for k, key in keys.items()),
        Case("email.address", p, [(message, "m@n", False), ("email.address:addrhash%3Aa@n", "address_domain-@n", True)], [(message, "references", "email.address:addrhash%3Aa@n")], "email.address", "email.reference",
             target="email.address:addrhash%3Aa@n", more={"source_key": message}),
        referred("email.reference", p, message, "external.url:x@n", "email.reference", more={"source_key": message}),
    ]


FAMILIES = {
    "shell": _shell, "python": _python, "nix": _nix, "nix_apps": _nix_apps, "markdown": _markdown, "config": _config, "html": _html, "xml": _xml, "css": _css, "feed": _feed, "warc": _warc,
    "ruby": _ruby, "js": _js, "document": _document, "email": _email,
}


def observations(suppliers: DataFrame, cases: list[Case]) -> DataFrame:
    """The cases' observations, for every supplier; a case's ordinals come before the next one's."""
    each = [
        F.struct(
            (F.lit(i * 1_000_000_000) + F.col("s_suppkey")).cast("long").alias("ordinal"), F.lit(c.kind).alias("kind"), _column(f"{c.path}#{i}").alias("source_id"), _column(c.path).alias("path"),
            _column(c.name).alias("name"), _column(c.target).alias("target"), _column(_json(c.metadata())).alias("metadata"),
        )
        for i, c in enumerate(cases)
    ]
    rows = suppliers.select("s_suppkey", F.col("s_suppkey").cast("string").alias("n")).select(F.explode(F.array(*each)).alias("o")).select("o.*")
    return rows.select(
        F.lit(1).cast("long").alias("run_id"), "*", F.lit(CONFIDENCE).alias("confidence"), F.lit("cases").alias("extractor"), F.lit("1").alias("extractor_version"),
        F.lit(1).alias("schema_version"), F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"),
    )


#: Nodes that only `document` parts mention beside their own: the document, with what both contracts name.
def _shared(case: Case) -> list[tuple[str, str, dict]]:
    if case.node and case.node.startswith("document.") and case.node != "document.file":
        m = case.metadata()
        doc = next(s for s, _, _ in case.edges if s.startswith("document.file:"))
        return [(doc, case.path, {n: m[n] for n in _fields(NODE_METADATA["document.file"]) if n in m})]
    return []


def rows(spark: SparkSession, sf_dir: str, cases: list[Case]) -> DataFrame:
    g = canonicalize(observations(spark.read.parquet(f"{sf_dir}/supplier.parquet"), cases))
    node = g.nodes.select(F.lit("node").alias("what"), F.col("canonical_key").alias("key"), "kind", F.col("display_name").alias("name"), "metadata", F.lit("").alias("source"), F.lit("").alias("target"), "confidence")
    wanted = {kind for c in cases for _, kind, _ in c.edges}
    edge = g.edges.where(F.col("kind").isin(*wanted)).select(F.lit("edge").alias("what"), F.col("edge_key").alias("key"), "kind", F.lit("").alias("name"), "metadata", F.col("source_key").alias("source"), F.col("target_key").alias("target"), "confidence")
    return node.unionByName(edge)


def sql(cases: list[Case]) -> str:
    mentions, drawn = [], []
    for i, c in enumerate(cases):
        nodes = [(k, d, c.of_node() if own else {}) for k, d, own in c.nodes] + _shared(c)
        mentions += [f"SELECT {i * 10 + j} AS ord, {_sql(k)} AS key, {_sql(d)} AS name, {_sql(_json(m))} AS metadata FROM t" for j, (k, d, m) in enumerate(nodes)]
        drawn += [f"SELECT {_sql(s)} AS source, '{kind}' AS kind, {_sql(d)} AS target, {_sql(_json(c.of_edge()))} AS metadata FROM t" for s, kind, d in c.edges]
    body = "'{\"graph_key_version\":1,\"identity_metadata\":{},\"kind\":\"' || kind || '\",\"source_key\":\"' || source || '\",\"target_key\":\"' || target || '\"}'"
    return (
        f"WITH t AS (SELECT s_suppkey::VARCHAR AS n FROM supplier), m AS ({' UNION ALL '.join(mentions)}), e AS ({' UNION ALL '.join(drawn)})"
        f" SELECT 'node' AS what, key, split_part(key, ':', 1) AS kind, arg_min(name, ord) AS name, arg_min(metadata, ord) AS metadata, '' AS source, '' AS target, '{CONFIDENCE}' AS confidence FROM m GROUP BY key"
        f" UNION ALL SELECT 'edge', 'canonical-edge:' || sha256({body}), kind, '', any_value(metadata), source, target, '{CONFIDENCE}' FROM e GROUP BY source, kind, target"
    )


def _query(cases: list[Case]):
    return lambda spark, sf_dir: rows(spark, sf_dir, cases)


QUERIES = {f"rules_{name}": _query(make()) for name, make in FAMILIES.items()}
SQL = {f"rules_{name}": sql(make()) for name, make in FAMILIES.items()}
