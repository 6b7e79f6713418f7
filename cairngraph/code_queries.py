"""Code with traps: files whose strings, comments, templates, heredocs and elements hold what only looks like code, made from
the suppliers. The SQL beside each query was written by hand from what the code means, before any run; some facts hold for some
suppliers only.

`@n` stands for the supplier's number. A line is a text, or (condition over n, text if it holds, text if not).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairngraph.extractor_queries import _column, _sql, suppliers
from cairngraph.sources import repository

Line = str | tuple[str, str, str]
#: name: (lines by path, facts as (path, kind, line, name, target[, condition]))
CODE: dict[str, tuple[dict[str, list[Line]], list[tuple]]] = {}
EVEN = "n % 2 = 0"

_WEB, _WEB_MODULE = "web/@n.tsx", "js.module:file%3Aweb%2F@n.tsx"
CODE["javascript_scopes"] = (
    {
        _WEB: [
            "import React from 'react'; // import no from './comment'",
            "/* import no1 from './block';",
            "   export const no2 = 1; */",
            "import {",
            "  a@n,",
            "} from './m@n';",
            "const text = \"import no3 from './string'\", quote = /import 'no4'/g;",
            "const page = `export class No5 {} ${ import('./lazy@n') } import no6 from './t'`;",
            "export class Box@n extends Component {",
            "  size() { return this.w / 2 / this.h; }",
            "  render() {",
            "    const go = (x) => { if (x) { call(x); } };",
            "    return <p onClick={() => go('x')}>import no7 from './jsx' {this.size()} it's {go(1)}</p>;",
            "  }",
            (EVEN, "  even@n(a = '}') {", "  odd@n(a = `}`) {"),
            "  }",
            "}",
            "export function Plain@n() { return <Route path=\"/p@n\" element={null} />; }",
            "const late = 4 / 2; class No8 { } // } class No9 {",
        ],
        "web/m@n.ts": [(EVEN, "export const a@n = 1;", "")],
    },
    [
        (_WEB, "js.file", None, None, "js.file:file%3Aweb%2F@n.tsx"), (_WEB, "js.module", None, None, _WEB_MODULE),
        (_WEB, "js.import", 1, "react", "external:js.package:react"), (_WEB, "js.reference", 1, "react", "external:js.package:react"),
        (_WEB, "js.import", 4, "./m@n", "file:web/m@n.ts"), (_WEB, "js.reference", 4, "./m@n", "file:web/m@n.ts"),
        (_WEB, "js.variable", 7, "text", "js.variable:" + _WEB_MODULE.replace("%", "%25").replace(":", "%3A") + ":text"),
        (_WEB, "js.variable", 8, "page", "js.variable:" + _WEB_MODULE.replace("%", "%25").replace(":", "%3A") + ":page"),
        (_WEB, "js.import", 8, "./lazy@n", "unknown:file:missing-import"), (_WEB, "js.reference", 8, "./lazy@n", "unknown:file:missing-import"),
        (_WEB, "js.export", 9, "Box@n", None), (_WEB, "js.class", 9, "Box@n", None), (_WEB, "js.component", 9, "Box@n", None),
        (_WEB, "js.method", 10, "size", None), (_WEB, "js.method", 11, "render", None),
        (_WEB, "js.method", 15, "even@n", None, EVEN), (_WEB, "js.method", 15, "odd@n", None, "n % 2 = 1"),
        (_WEB, "js.export", 18, "Plain@n", None), (_WEB, "js.component", 18, "Plain@n", None), (_WEB, "js.route", 18, "/p@n", None),
        (_WEB, "js.variable", 19, "late", None),
        ("web/m@n.ts", "js.file", None, None, "js.file:file%3Aweb%2Fm@n.ts"), ("web/m@n.ts", "js.module", None, None, "js.module:file%3Aweb%2Fm@n.ts"),
        ("web/m@n.ts", "js.export", 1, "a@n", None, EVEN), ("web/m@n.ts", "js.variable", 1, "a@n", None, EVEN),
    ],
)

_TEST = "t/@n.test.js"
CODE["javascript_suites"] = (
    {
        _TEST: [
            "describe('outer @n', () => {",
            "  it('a', () => { expect(x / y / 2).toBe(1); });",
            "  describe(\"inner\", () => {",
            "    it('b', () => {});",
            "  });",
            "  // it('no', () => {});",
            "  test('c', () => { const s = \"it('no2', () => {})\"; });",
            "});",
            (EVEN, "it('top', () => {});", "const s = `",),
            (EVEN, "", "it('no3', () => {})`;"),
        ],
    },
    [
        (_TEST, "js.test_suite", 1, "outer @n", None), (_TEST, "jest.suite", 1, "outer @n", None),
        (_TEST, "js.test_case", 2, "a", "outer"), (_TEST, "jest.test", 2, "a", None), (_TEST, "js.test_expectation", 2, None, None), (_TEST, "jest.expectation", 2, "expect", None),
        (_TEST, "js.test_suite", 3, "inner", None), (_TEST, "jest.suite", 3, "inner", None),
        (_TEST, "js.test_case", 4, "b", "inner"), (_TEST, "jest.test", 4, "b", None),
        (_TEST, "js.test_case", 7, "c", "outer"), (_TEST, "jest.test", 7, "c", None),
        (_TEST, "js.test_case", 9, "top", "module", EVEN), (_TEST, "jest.test", 9, "top", None, EVEN),
        (_TEST, "js.variable", 9, "s", None, "n % 2 = 1"),
        (_TEST, "js.file", None, None, None), (_TEST, "js.module", None, None, None),
    ],
)

_SERVER = "s/@n.js"
CODE["javascript_routes"] = (
    {
        _SERVER: [
            "const express = require('express');",
            "const app = express();",
            "const doc = `app.get('/no', h)`;",
            "app.get('/u@n', (req, res) => { res.send(\"app.post('/no2')\"); });",
            "// app.put('/no3', h);",
            (EVEN, "app.delete('/d@n', h);", "app.use(errorHandler);"),
            "module.exports = app;",
        ],
    },
    [
        (_SERVER, "js.file", None, None, None), (_SERVER, "js.module", None, None, None),
        (_SERVER, "js.import", 1, "express", None), (_SERVER, "js.reference", 1, "express", None), (_SERVER, "node.require", 1, "express", None), (_SERVER, "js.variable", 1, "express", None),
        (_SERVER, "js.variable", 2, "app", None), (_SERVER, "express.app", 2, "app", None), (_SERVER, "js.variable", 3, "doc", None),
        (_SERVER, "express.route", 4, "GET /u@n", None), (_SERVER, "js.route", 4, "GET /u@n", None),
        (_SERVER, "express.route", 6, "DELETE /d@n", None, EVEN), (_SERVER, "js.route", 6, "DELETE /d@n", None, EVEN),
        (_SERVER, "express.middleware", 6, None, None, "n % 2 = 1"), (_SERVER, "express.error_handler", 6, "use", None, "n % 2 = 1"),
        (_SERVER, "node.export", 7, "module.exports", None),
    ],
)

_RUBY = "lib/@n.rb"
CODE["ruby_blocks"] = (
    {
        _RUBY: [
            "module Top@n",
            "  class Box < Base",
            "    def ready?; @ready unless @off; end",
            "    def size = @items.size / 2",
            "    def total(list)",
            "      return 0 if list.empty?",
            "      sum = if list.one? then 1 else 2 end",
            "      while sum > 3 do sum -= 1 end",
            "      text = <<~TEXT + %w[class No1 end].join",
            "        class No2; def no3",
            "        require 'no4'",
            "      TEXT",
            "      list.each do |x|",
            "        puts \"def no5 #{x.map { |y| y[\"end\"] }}\" if x.end == :end",
            "      end # end",
            "      text =~ /class No6 end/ ? {if: 1, end: 2} : list.class",
            "    end",
            (EVEN, "    private def even@n(a) = a.begin", "    def odd@n(a); begin; a; end while a; end"),
            "    class << self",
            "      def make; new; end",
            "    end",
            "    LIMIT = 3",
            "    def after; end",
            "  end",
            "  def self.outer; case 1 when 1 then 2 end; end",
            "  class Late; end",
            "end",
            "=begin",
            "class No7; end",
            "=end",
            "require_relative 'part@n'",
            "def free; end",
            "__END__",
            "class No8",
        ],
    },
    [
        (_RUBY, "ruby.file", None, None, None), (_RUBY, "ruby.module", 1, "Top@n", None), (_RUBY, "ruby.class", 2, "Top@n::Box", None),
        (_RUBY, "ruby.method", 3, "ready?", "ruby.method:Top@n%3A%3ABox:ready%3F"), (_RUBY, "ruby.method", 4, "size", "ruby.method:Top@n%3A%3ABox:size"), (_RUBY, "ruby.method", 5, "total", "ruby.method:Top@n%3A%3ABox:total"),
        (_RUBY, "ruby.method", 18, "even@n", "ruby.method:Top@n%3A%3ABox:even@n", EVEN), (_RUBY, "ruby.method", 18, "odd@n", "ruby.method:Top@n%3A%3ABox:odd@n", "n % 2 = 1"),
        (_RUBY, "ruby.singleton_method", 20, "make", "ruby.singleton_method:Top@n%3A%3ABox:make"), (_RUBY, "ruby.constant", 22, "LIMIT", None),
        (_RUBY, "ruby.method", 23, "after", "ruby.method:Top@n%3A%3ABox:after"), (_RUBY, "ruby.singleton_method", 25, "outer", "ruby.singleton_method:Top@n:outer"),
        (_RUBY, "ruby.class", 26, "Top@n::Late", None), (_RUBY, "ruby.require", 31, "part@n", "file:lib/part@n.rb"), (_RUBY, "ruby.reference", 31, "part@n", "file:lib/part@n.rb"),
        (_RUBY, "ruby.method", 32, "free", "ruby.method:Object:free"),
    ],
)

_TF, _VARS = "infra/@n.tf", "infra/@n.tfvars"
CODE["terraform_blocks"] = (
    {
        _TF: [
            "terraform {",
            "  required_version = \">= 1.@n\"",
            "  required_providers {",
            "    aws = { source = \"hashicorp/aws\", version = \"~> 5.@n\" }",
            "    tls = \"4.@n\"",
            "  }",
            "  backend \"s3\" { key = \"}\" }",
            "}",
            "# resource \"no\" \"one\" {",
            "resource \"aws_instance\" \"box@n\" {",
            "  user_data = <<-EOT",
            "    resource \"no\" \"two\" {",
            "    EOT-not-yet }}}",
            "    EOT",
            "  name = \"a}${ join(\"{\", [\"}\"]) }b\"",
            "  tags = { \"{\" = \"x\", password = \"hush@n\" }",
            "  dynamic \"rule\" {",
            "    for_each = [for x in var.a : { y = x } if x != \"]\"]",
            "    content { api_token = \"t@n\" }",
            "  }",
            "} /* } */",
            "module \"net@n\" {",
            (EVEN, "  source = \"./net@n\" // local", "  source = \"registry/net/@n\""),
            "  inner { source = \"./no\" }",
            "}",
            "locals { a@n = 1 }",
            (EVEN, "output \"url@n\" { value = \"http://x/${var.y}\" }", "data \"aws_ami\" \"img@n\" {"),
        ],
        _VARS: ["region = \"eu-@n\"", "map = {", "  no1 = 1", "}", "text = <<EOT", "no2 = 2", "EOT", "list@n = [", "  \"no3 = 3\",", "]"],
    },
    [
        (_TF, "terraform.file", None, None, None), (_TF, "terraform.block", 1, "terraform", None), (_TF, "terraform.required_version", 2, None, None),
        (_TF, "terraform.required_provider", 4, "aws", None), (_TF, "terraform.reference", 4, "hashicorp/aws", None), (_TF, "terraform.required_provider", 5, "tls", None), (_TF, "terraform.backend", 7, "s3", None),
        (_TF, "terraform.resource", 10, "aws_instance.box@n", None), (_TF, "terraform.redaction", 16, None, None), (_TF, "terraform.redaction", 19, None, None),
        (_TF, "terraform.module", 22, "net@n", None), (_TF, "terraform.reference", 23, "./net@n", None, EVEN), (_TF, "terraform.reference", 23, "registry/net/@n", None, "n % 2 = 1"),
        (_TF, "terraform.block", 26, "locals", None), (_TF, "terraform.local", 26, "a@n", None),
        (_TF, "terraform.output", 27, "url@n", None, EVEN), (_TF, "terraform.data_source", 27, "aws_ami.img@n", None, "n % 2 = 1"), (_TF, "terraform.parse_error", None, None, None, "n % 2 = 1"),
        (_VARS, "terraform.file", None, None, None), (_VARS, "terraform.variable", 1, "region", None), (_VARS, "terraform.redaction", 1, "region", None), (_VARS, "terraform.variable", 2, "map", None), (_VARS, "terraform.redaction", 2, "map", None),
        (_VARS, "terraform.variable", 5, "text", None), (_VARS, "terraform.redaction", 5, "text", None), (_VARS, "terraform.variable", 8, "list@n", None), (_VARS, "terraform.redaction", 8, "list@n", None),
    ],
)


def _content(lines: list[Line]) -> Column:
    each = [_column(x) if isinstance(x, str) else F.when(F.expr(x[0]), _column(x[1])).otherwise(_column(x[2])) for x in lines]
    return F.concat(*(p for x in each for p in (x, F.lit("\n"))))


#: What is told of a target: the whole, or of a test the suite that it belongs to.
def _shown(target: Column) -> Column:
    suite = F.regexp_extract(F.url_decode(F.url_decode(target)), r"^js\.test_case:.*js\.test_suite:.*?:([a-z]+)[^:]*:[^:]*$", 1)
    return F.when(target.startswith("js.test_case:"), F.when(suite == "", F.lit("module")).otherwise(suite)).otherwise(target)


def observed(suppliers: DataFrame, files: dict[str, list[Line]], told: set[str]) -> DataFrame:
    """What the extractors tell of the files; the target where the expectation names one for the kind."""
    rows = suppliers.select(F.col("s_suppkey").alias("n"))
    each = F.array(*(F.struct(_column(p).alias("path"), _content(c).alias("content")) for p, c in files.items()))
    made = rows.select(F.explode(each).alias("f")).select("f.path", F.encode("f.content", "UTF-8").alias("content"), F.lit(False).alias("executable"))
    found = repository.observe(repository.classify(made)).where("kind <> 'file'")
    return found.select("path", "kind", "start_line", "name", F.when(F.col("kind").isin(*told), _shown(F.col("target"))).alias("target"))


def _told(facts: list[tuple]) -> set[str]:
    """Kinds of which every expected fact names its target."""
    kinds = {f[1] for f in facts}
    return {k for k in kinds if all(f[4] is not None for f in facts if f[1] == k)}


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    files, facts = CODE[name]
    return lambda spark, sf_dir: observed(suppliers(spark, sf_dir), files, _told(facts))


def _expected(name: str) -> str:
    _, facts = CODE[name]
    told = _told(facts)
    rows = []
    for path, kind, line, said, target, *condition in facts:
        rows.append(
            f"SELECT {_sql(path)} AS path, '{kind}' AS kind, {_sql(line)}::INT AS start_line, {_sql(said)}::VARCHAR AS name, {_sql(target if kind in told else None)}::VARCHAR AS target FROM t"
            + (f" WHERE {condition[0].replace('n %', 'k %')}" if condition else "")
        )
    return f"WITH t AS (SELECT s_suppkey AS k, s_suppkey::VARCHAR AS n FROM supplier) {' UNION ALL '.join(rows)}"


QUERIES = {f"code_{name}": _query(name) for name in CODE}
SQL = {f"code_{name}": _expected(name) for name in CODE}
