"""A query for each summary: the events stand in for observations, nodes and edges of the kinds that it counts, each kind in turn,
and its counters come back a row each. The SQL beside it counts the events themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairngraph.plans import summary
from cairngraph.sources import ingest, remote

#: family: (counter: kind of observation, counter: kind of node). What each counter counts is told here once more, in plain kinds.
COUNTED: dict[str, tuple[dict[str, str], dict[str, str]]] = {
    "ruby": (
        {"gem_dependencies": "ruby.gem_dependency", "vagrant_configs": "ruby.vagrant_config"},
        {
            "ruby_files": "ruby.file", "modules": "ruby.module", "classes": "ruby.class", "methods": "ruby.method", "singleton_methods": "ruby.singleton_method", "constants": "ruby.constant",
            "routes": "ruby.route", "test_cases": "ruby.test_case", "test_methods": "ruby.test_method",
        },
    ),
    "js": (
        {"imports": "js.import", "exports": "js.export", "hooks": "js.hook"},
        {
            "js_files": "js.file", "modules": "js.module", "functions": "js.function", "classes": "js.class", "methods": "js.method", "variables": "js.variable", "components": "js.component",
            "routes": "js.route", "test_suites": "js.test_suite", "test_cases": "js.test_case",
        },
    ),
    "js_framework": (
        {
            "node.entrypoints": "node.entrypoint", "node.requires": "node.require", "node.exports": "node.export", "express.apps": "express.app", "express.routers": "express.router",
            "express.routes": "express.route", "express.middleware": "express.middleware", "express.error_handlers": "express.error_handler", "nest.modules": "nest.module",
            "nest.controllers": "nest.controller", "nest.providers": "nest.provider", "nest.routes": "nest.route", "nest.decorators": "nest.decorator", "next.pages": "next.page",
            "next.api_routes": "next.api_route", "next.app_routes": "next.app_route", "next.components": "next.component", "next.route_handlers": "next.route", "jest.suites": "jest.suite",
            "jest.tests": "jest.test", "jest.expectations": "jest.expectation", "jest.mocks": "jest.mock", "jquery.selectors": "jquery.selector", "jquery.events": "jquery.event",
            "jquery.ajax_references": "jquery.ajax", "jquery.plugin_references": "jquery.plugin_reference",
        },
        {"generic_js.canonical_routes": "js.route", "generic_js.canonical_test_suites": "js.test_suite", "generic_js.canonical_test_cases": "js.test_case", "generic_js.canonical_components": "js.component"},
    ),
    "openapi": (
        {
            "openapi_documents": "openapi.document", "openapi.info": "openapi.info", "openapi.servers": "openapi.server", "openapi.paths": "openapi.path", "openapi.operations": "openapi.operation",
            "openapi.parameters": "openapi.parameter", "openapi.request_bodies": "openapi.request_body", "openapi.responses": "openapi.response", "openapi.schemas": "openapi.schema",
            "openapi.components": "openapi.component", "openapi.security_schemes": "openapi.security_scheme", "openapi.tags": "openapi.tag", "openapi.examples": "openapi.example",
            "diagnostics.parse_errors": "openapi.parse_error", "generic_config.config_references": "config.reference",
        },
        {"generic_config.config_documents": "config.document", "generic_config.config_paths": "config.path"},
    ),
    "terraform": (
        {
            "terraform_files": "terraform.file", "terraform.blocks": "terraform.block", "terraform.providers": "terraform.provider", "terraform.required_providers": "terraform.required_provider",
            "terraform.required_versions": "terraform.required_version", "terraform.backends": "terraform.backend", "terraform.resources": "terraform.resource",
            "terraform.data_sources": "terraform.data_source", "terraform.modules": "terraform.module", "terraform.variables": "terraform.variable", "terraform.outputs": "terraform.output",
            "terraform.locals": "terraform.local", "terraform.moved": "terraform.moved", "terraform.imports": "terraform.import", "terraform.checks": "terraform.check",
            "terraform.removed": "terraform.removed", "references.total": "terraform.reference", "diagnostics.parse_errors": "terraform.parse_error",
            "generic_config.config_references": "config.reference",
        },
        {"generic_config.config_documents": "config.document", "generic_config.config_paths": "config.path"},
    ),
    "python": (
        {
            "package_files.pyproject": "python.pyproject", "packaging.requirements": "python.requirement", "packaging.dependency_groups": "python.dependency_group",
            "packaging.build_systems": "python.build_system", "packaging.entry_points": "python.entry_point", "packaging.tool_configs": "python.tool_config", "tests.test_files": "python.test_file",
            "tests.unittest_cases": "python.unittest_case", "tests.pytest_tests": "python.pytest_test", "tests.test_functions": "python.test_function", "tests.test_methods": "python.test_method",
            "tests.parametrize": "python.test_parametrize", "tests.assertions": "python.test_assertion", "tests.fixtures": "python.pytest_fixture", "frameworks.flask_apps": "python.flask_app",
            "frameworks.flask_blueprints": "python.flask_blueprint", "frameworks.flask_routes": "python.flask_route", "frameworks.fastapi_apps": "python.fastapi_app",
            "frameworks.fastapi_routers": "python.fastapi_router", "frameworks.fastapi_routes": "python.fastapi_route", "frameworks.fastapi_dependencies": "python.fastapi_dependency",
            "frameworks.django_projects": "python.django_project", "frameworks.django_apps": "python.django_app", "frameworks.django_urlpatterns": "python.django_urlpattern",
            "frameworks.django_views": "python.django_view", "frameworks.django_models": "python.django_model", "frameworks.django_setting_references": "python.django_setting_reference",
            "references.total": "python.reference", "diagnostics.parse_errors": "python.parse_error", "generic_python.imports": "python.import", "generic_config.config_references": "config.reference",
        },
        {
            "generic_python.modules": "python.module", "generic_python.classes": "python.class", "generic_python.functions": "python.function", "generic_python.methods": "python.method",
            "generic_config.config_documents": "config.document", "generic_config.config_paths": "config.path",
        },
    ),
    "email": (
        {"address_observations": "email.address", "parse_errors": "email.parse_error"},
        {
            "mailboxes": "email.mailbox", "messages": "email.message", "addresses": "email.address", "mime_parts": "email.part", "attachment_stubs": "email.attachment_stub",
            "thread_hints": "email.thread_hint",
        },
    ),
}

#: Counters of more than a kind: family: {counter: SQL over x(n, k, kind)}; every observation and node has the metadata of _METADATA.
CONDITIONS: dict[str, dict[str, str]] = {
    "js_framework": {
        "framework_observations": "kind NOT LIKE 'js.%'", "framework_profiles.jest": "kind LIKE 'jest.%'", "framework_profiles.express": "kind LIKE 'express.%'", "express.dynamic_routes": "kind = 'express.route' AND k > 50",
    },
    "openapi": {
        "openapi_observations": "kind LIKE 'openapi.%'", "methods.get": "kind = 'openapi.operation' AND k % 2 = 0", "methods.post": "kind = 'openapi.operation' AND k % 2 = 1",
        "diagnostics.limit_overflows": "kind = 'openapi.parse_error' AND k > 50",
    },
    "terraform": {
        "terraform_observations": "kind LIKE 'terraform.%'", "references.remote_refs_not_fetched": "kind = 'terraform.reference' AND k > 50 AND k % 2 = 0", "references.provider_sources": "false",
        "references.module_sources": "kind = 'terraform.reference'", "references.local_module_refs": "kind = 'terraform.reference' AND k % 2 = 1", "diagnostics.limit_overflows": "kind = 'terraform.parse_error' AND k > 50",
        "diagnostics.malformed_hcl": "kind = 'terraform.parse_error' AND k <= 50",
    },
    "python": {
        "python_observations": "kind LIKE 'python.%'", "references.framework_refs": "kind = 'python.reference' AND k % 2 = 0", "diagnostics.dynamic_constructs": "kind = 'python.parse_error' AND k > 50",
        "diagnostics.limit_overflows": "kind = 'python.parse_error' AND k > 50",
    },
    "email": {"malformed_or_oversized_diagnostics": "kind = 'email.parse_error'", "list_unsubscribe_references": "false"},
}


def _metadata() -> F.Column:
    k = F.get_json_object("props", "$.k").cast("int")
    return F.to_json(F.struct(
        (k > 50).alias("dynamic"), (k > 50).alias("not_fetched"), F.when(k % 2 == 0, F.lit("get")).otherwise(F.lit("post")).alias("method"),
        F.when(k > 50, F.lit("some-limit")).otherwise(F.lit("malformed-hcl")).alias("error_kind"), F.when(k % 2 == 0, F.lit("module_source")).otherwise(F.lit("module_source_local")).alias("reference_kind"),
        F.when(k % 2 == 0, F.lit("flask")).otherwise(F.lit("other")).alias("framework"),
    ))


def _of_kinds(spark: SparkSession, sf_dir: str, kinds: list[str]) -> DataFrame:
    """Every event with one of the kinds, in turn."""
    kind = F.get(F.array(*(F.lit(k) for k in kinds)), (F.col("event_id") % len(kinds)).cast("int"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(kind.alias("kind"), F.concat(F.lit("p/"), F.col("event_id").cast("string")).alias("path"), F.lit(None).cast("string").alias("target"), _metadata().alias("metadata"))


def _query(family: str) -> Callable[[SparkSession, str], DataFrame]:
    raw, nodes = COUNTED[family]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        edges = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.lit("references").alias("kind"), F.concat(F.lit(f"{family.split('_')[0]}.x:"), F.col("event_id").cast("string")).alias("source_key"), F.lit("external.url:u").alias("target_key"))
        row = summary.summarize(family, _of_kinds(spark, sf_dir, list(raw.values())), _of_kinds(spark, sf_dir, list(nodes.values())), edges)
        counters = [*raw, *nodes, *CONDITIONS.get(family, {}), *(["references"] if family in ("ruby", "js") else []), *(["external_url_references"] if family == "email" else [])]
        return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("counter"), F.col(c).cast("long").alias("n")) for c in counters))).alias("x")).select("x.*")

    return run


def _sql(family: str) -> str:
    raw, nodes = COUNTED[family]
    lists = {"x": list(raw.values()), "y": list(nodes.values())}
    ctes = ", ".join(f"{t} AS (SELECT event_id AS n, json_extract_string(props, '$.k')::INT AS k, {ks!r}[event_id % {len(ks)} + 1] AS kind FROM events)" for t, ks in lists.items())
    counted = [f"SELECT '{c}' AS counter, count(*) AS n FROM {t} WHERE kind = '{k}'" for t, of in (("x", raw), ("y", nodes)) for c, k in of.items()]
    counted += [f"SELECT '{c}', count(*) FROM x WHERE {where}" for c, where in CONDITIONS.get(family, {}).items()]
    if family in ("ruby", "js", "email"):
        counted.append(f"SELECT '{'external_url_references' if family == 'email' else 'references'}', count(*) FROM events")
    return f"WITH {ctes} {' UNION ALL '.join(counted)}"


QUERIES = {f"summary_{family}": _query(family) for family in COUNTED}
SQL = {f"summary_{family}": _sql(family) for family in COUNTED}


# --- manifests ----------------------------------------------------------------------------------------------


def _manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as manifests of plans and acquisitions: a source a customer, a run an order."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key = F.col("o_orderkey")
    counts = F.create_map(F.lit("html"), key % 5, F.lit("json"), key % 3)
    row = F.struct(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source_id"), F.concat(F.lit("b"), key.cast("string")).alias("bulk_run_id"), F.concat(F.lit("a"), key.cast("string")).alias("api_run_id"),
        counts.alias("extractor_counts"), F.create_map(F.lit("max_files_exceeded"), key % 2).alias("diagnostic_counts"), (key * 10).alias("total_bytes_included"), (key % 2 == 1).alias("limit_hit"),
        F.array(F.struct(key.cast("string").alias("request_id"))).alias("requests"), F.array(F.struct(F.lit(200).alias("status"), (key % 4 == 0).alias("redacted"))).alias("responses"), (key * 10).alias("total_bytes"), (key % 7).alias("total_items"),
    )
    return o.select(F.to_json(row).alias("value"))


QUERIES |= {
    "manifests_bulk": lambda spark, sf_dir: ingest.manifest_summary(_manifests(spark, sf_dir)),
    "manifests_api": lambda spark, sf_dir: remote.manifest_summary(_manifests(spark, sf_dir)),
}
SQL |= {
    "manifests_bulk": "SELECT count(DISTINCT o_custkey) AS sources, count(*) AS runs, sum(o_orderkey % 5 + o_orderkey % 3)::BIGINT AS included_files, sum(o_orderkey % 2)::BIGINT AS skipped_files, sum(o_orderkey * 10)::BIGINT AS total_bytes_included,"
    " count(*) FILTER (o_orderkey % 2 = 1) AS limit_hits FROM orders",
    "manifests_api": "SELECT count(DISTINCT o_custkey) AS sources, count(*) AS runs, count(*) AS requests, count(*) AS responses, count(*) FILTER (o_orderkey % 4 = 0) AS redacted_responses, sum(o_orderkey % 7)::BIGINT AS total_items,"
    " sum(o_orderkey * 10)::BIGINT AS total_bytes FROM orders",
}
