"""Summaries: one row of counters for each family of facts.

A summary is a table of named conditions over three frames: raw observations, canonical nodes and
canonical edges. Each frame is scanned once with all its conditions as one conditional aggregate (a
few numbers a task reach the last exchange), whatever the number of counters.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairngraph.functions.keys import KEY_VERSION


def meta(name: str) -> Column:
    return F.get_json_object("metadata", f"$.{name}")


def flag(name: str) -> Column:
    return F.coalesce(F.lower(meta(name)) == "true", F.lit(False))


def has(name: str) -> Column:
    """The field is there, be it null."""
    return F.array_contains(F.json_object_keys("metadata"), name)


def kind(*names: str) -> Column:
    return F.col("kind").isin(*names)


def family(prefix: str) -> Column:
    return F.col("kind").startswith(f"{prefix}.")


def each(prefix: str, **names: str) -> dict[str, Column]:
    """counter=last part of the kind"""
    return {n: kind(f"{prefix}.{k}") for n, k in names.items()}


def under(group: str, counters: Mapping[str, Column]) -> dict[str, Column]:
    return {f"{group}.{n}": c for n, c in counters.items()}


def any_of(c: Column, *parts: str) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.coalesce(F.contains(c, F.lit(p)), F.lit(False))
    return out


@dataclass
class Summary:
    raw: dict[str, Column] = field(default_factory=dict)
    nodes: dict[str, Column] = field(default_factory=dict)
    edges: dict[str, Column] = field(default_factory=dict)
    raw_sums: dict[str, Column] = field(default_factory=dict)
    node_distinct: dict[str, Column] = field(default_factory=dict)
    constants: dict[str, bool] = field(default_factory=dict)
    profile_of: str | None = None  # counts the profiles of nodes of this kind


def run(s: Summary, raw: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row; names with a dot make structs."""
    parts: list[tuple[DataFrame, dict[str, Column]]] = [
        (raw, {n: F.count_if(c) for n, c in s.raw.items()} | {n: F.coalesce(F.sum(c), F.lit(0)).cast("long") for n, c in s.raw_sums.items()}),
        (nodes, {n: F.count_if(c) for n, c in s.nodes.items()} | {n: F.count_distinct(c) for n, c in s.node_distinct.items()}),
        (edges, {n: F.count_if(c) for n, c in s.edges.items()}),
    ]
    row: DataFrame | None = None
    names: list[str] = []
    for df, aggs in parts:
        if aggs:
            names += aggs
            one = df.agg(*(a.alias(n.replace(".", "__")) for n, a in aggs.items()))
            row = one if row is None else row.crossJoin(one)  # of two single rows
    if s.profile_of:
        counted = nodes.where(F.col("kind") == s.profile_of).groupBy(F.coalesce(meta("profile"), F.lit("unknown")).alias("p")).agg(F.count(F.lit(1)).alias("n"))
        profiles = counted.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("p", "n")))).alias("profile_counts"))  # a row a profile
        names.append("profile_counts")
        row = row.crossJoin(profiles)
    flat: dict[str, Column] = {n: F.col(n.replace(".", "__")) for n in names} | {n: F.lit(v) for n, v in s.constants.items()}
    out: dict[str, list[Column] | Column] = {}
    for n, c in flat.items():
        group, dot, rest = n.rpartition(".")
        if dot:
            out.setdefault(group, []).append(c.alias(rest))
        else:
            out[n] = c
    return row.select(*(F.struct(*c).alias(n) if isinstance(c, list) else c.alias(n) for n, c in out.items()))


def counts(**frames: DataFrame) -> DataFrame:
    """One row: the number of rows of each frame."""
    row: DataFrame | None = None
    for n, df in frames.items():
        one = df.agg(F.count(F.lit(1)).alias(n))
        row = one if row is None else row.crossJoin(one)
    return row


_KEPT_OUT = ("no_execution", "no_fetch", "raw_profile_only", "no_new_canonical_namespaces")
RUBY = lambda: Summary(
    nodes=each("ruby", ruby_files="file", modules="module", classes="class", methods="method", singleton_methods="singleton_method", constants="constant", routes="route", test_cases="test_case", test_methods="test_method"),
    edges={"references": (F.col("kind") == "references") & F.col("source_key").startswith("ruby.")},
    raw=each("ruby", gem_dependencies="gem_dependency", vagrant_configs="vagrant_config")
    | {f"rake_{n}s": kind("ruby.dsl") & (meta("profile") == "rake") & (meta("dsl_name") == n) for n in ("task", "namespace")}
    | {"dynamic_diagnostics": kind("ruby.parse_error") & flag("dynamic"), "parse_errors": kind("ruby.parse_error") & ~flag("dynamic")},
    constants={"no_execution": True},
    profile_of="ruby.file",
)

JS = lambda: Summary(
    nodes=each("js", js_files="file", modules="module", functions="function", classes="class", methods="method", variables="variable", components="component", routes="route", test_suites="test_suite", test_cases="test_case")
    | {f"{p}_files": kind("js.file") & (meta("profile") == p) for p in ("frontend_asset", "saved_page_asset", "test_report_asset")},
    edges={"references": (F.col("kind") == "references") & F.col("source_key").startswith("js.")},
    raw=each("js", imports="import", exports="export", hooks="hook")
    | {
        "source_map_references": kind("js.reference") & (meta("reference_kind") == "source_map"),
        "dynamic_diagnostics": kind("js.parse_error") & flag("dynamic"),
        "parse_errors": kind("js.parse_error") & ~flag("dynamic"),
    },
    raw_sums={"test_expectations": F.when(kind("js.test_expectation"), F.coalesce(meta("expectation_count").try_cast("long"), F.lit(1)))},
    constants={"no_execution": True},
    profile_of="js.file",
)


def _frameworks() -> Summary:
    families = {
        "node": each("node", entrypoints="entrypoint", requires="require", exports="export"),
        "express": each("express", apps="app", routers="router", routes="route", middleware="middleware", error_handlers="error_handler"),
        "nest": each("nest", modules="module", controllers="controller", providers="provider", routes="route", decorators="decorator"),
        "next": each("next", pages="page", api_routes="api_route", app_routes="app_route", components="component", route_handlers="route"),
        "jest": each("jest", suites="suite", tests="test", expectations="expectation", mocks="mock"),
        "jquery": each("jquery", selectors="selector", events="event", ajax_references="ajax", plugin_references="plugin_reference"),
    }
    generic = kind(*(f"js.{k}" for k in (
        "dom_selector dom_event ajax_reference framework_reference framework_profile runtime_profile package_context route_handler middleware controller provider module_binding"
        " test_config server_entrypoint client_entrypoint"
    ).split()))
    anything = generic
    for f in families:
        anything = anything | family(f)
    raw = {"framework_observations": anything} | {f"framework_profiles.{f}": family(f) for f in families} | {"framework_profiles.generic_js": generic}
    for f, c in families.items():
        raw |= under(f, c)
    raw |= {
        "node.env_references": kind("js.framework_reference") & (meta("reference_kind") == "environment"),
        "express.dynamic_routes": kind("express.route") & flag("dynamic"),
        "diagnostics.framework_observation_limit": kind("js.parse_error") & (meta("error_kind") == "framework-observation-limit"),
        "diagnostics.framework_selector_limit": kind("js.parse_error") & (meta("error_kind") == "framework-selector-limit"),
    }
    return Summary(raw=raw, nodes=under("generic_js", each("js", canonical_routes="route", canonical_test_suites="test_suite", canonical_test_cases="test_case", canonical_components="component")), constants={f"safety.{n}": True for n in _KEPT_OUT})


def _openapi() -> Summary:
    ref, scope = kind("openapi.reference"), lambda s: meta("reference_scope") == s
    reason = lambda r: meta("redaction_reason") == r
    raw = {"openapi_observations": family("openapi"), "openapi_documents": kind("openapi.document")}
    raw |= {f"spec_families.{s}": kind("openapi.document") & (meta("spec_family") == s) for s in ("openapi3", "swagger2")}
    raw |= under("openapi", each("openapi", info="info", servers="server", paths="path", operations="operation", parameters="parameter", request_bodies="request_body", responses="response", schemas="schema", components="component", security_schemes="security_scheme", tags="tag", examples="example"))
    raw |= {f"methods.{m.lower()}": kind("openapi.operation") & (F.upper(F.coalesce(meta("method"), F.lit(""))) == m) for m in ("GET", "POST", "PUT", "PATCH", "DELETE", "OPTIONS", "HEAD", "TRACE")}
    raw |= {
        "references.internal_refs": ref & scope("internal"), "references.local_file_refs": ref & scope("local_file"), "references.remote_refs_not_fetched": ref & scope("remote") & flag("not_fetched"),
        "references.external_docs_not_fetched": ref & scope("external_docs") & flag("not_fetched"), "references.refs_not_fetched": ref & flag("not_fetched"),
        "redactions.credentialed_urls": family("openapi") & reason("credentialed-url"),
        "redactions.openapi_ref_summaries": kind("openapi.redaction") & reason("openapi-ref-summary-only"),
        "redactions.text_summaries": kind("openapi.redaction") & reason("openapi-text-summary-only"),
        "redactions.example_summaries": kind("openapi.redaction") & reason("openapi-example-summary-only"),
        "diagnostics.parse_errors": kind("openapi.parse_error"),
        "diagnostics.limit_overflows": kind("openapi.parse_error") & any_of(meta("error_kind"), "limit"),
        "generic_config.config_references": kind("config.reference"),
    }
    return Summary(raw=raw, nodes=under("generic_config", each("config", config_documents="document", config_paths="path")), constants={f"safety.{n}": True for n in _KEPT_OUT})


def _terraform() -> Summary:
    tf = lambda k: kind(f"terraform.{k}")
    file, ref, red, err = tf("file"), tf("reference"), tf("redaction"), tf("parse_error")
    of = lambda *v: meta("reference_kind").isin(*v)
    why = lambda *v: meta("redaction_reason").isin(*v)
    place = F.col("path")
    named = (place == "terraform.tfvars") | place.endswith("/terraform.tfvars")
    auto, limit = place.endswith(".auto.tfvars"), any_of(meta("error_kind"), "limit")
    raw = {
        "terraform_observations": family("terraform"), "terraform_files": file, "file_families.tf": file & (meta("file_family") == "tf"),
        "file_families.tfvars": file & (meta("file_family") == "tfvars") & ~named & ~auto, "file_families.terraform_tfvars": file & named, "file_families.auto_tfvars": file & auto,
    } | under("terraform", each("terraform", blocks="block", providers="provider", required_providers="required_provider", required_versions="required_version", backends="backend", resources="resource", data_sources="data_source", modules="module", variables="variable", outputs="output", locals="local", moved="moved", imports="import", checks="check", removed="removed")) | {
        "references.total": ref, "references.provider_sources": ref & of("provider_source"),
        "references.version_constraints": (ref & of("required_version")) | (tf("required_provider") & meta("version_constraint").isNotNull()),
        "references.module_sources": ref & of("module_source", "module_source_local"), "references.local_module_refs": ref & of("module_source_local"),
        "references.remote_refs_not_fetched": ref & flag("not_fetched") & ~of("module_source_local"), "references.depends_on": ref & of("depends_on"),
        "references.provider_aliases": ref & of("provider_alias"), "references.repo_escape_diagnostics": err & meta("error_kind").isin("terraform-local-path-outside-root", "terraform-repo-escape"),
        "tfvars.files": file & (meta("file_family") == "tfvars"), "tfvars.variables": tf("variable") & (meta("profile") == "terraform_tfvars"),
        "redactions.tfvars_values": red & why("tfvars-sensitive-by-default"),
        "redactions.secret_like_fields": red & why("secret-prone-terraform-attribute", "secret-prone-terraform-local", "secret-prone-key"),
        "redactions.credentialed_urls": red & why("credentialed-terraform-url", "credentialed-terraform-module-source"),
        "redactions.import_ids": red & why("terraform-import-id-sensitive-by-default"),
        "redactions.backend_values": red & why("secret-prone-terraform-attribute") & meta("field_name").isin("access_key", "secret_key", "token", "password"),
        "diagnostics.parse_errors": err, "diagnostics.limit_overflows": err & limit, "diagnostics.malformed_hcl": err & meta("error_kind").isNotNull() & ~limit,
        "generic_config.config_references": kind("config.reference"), "generic_config.file_nodes": kind("file") & (meta("language") == "terraform"),
    }
    safe = (*_KEPT_OUT, "no_terraform_cli", "no_provider_download", "no_module_download", "no_state_access", "tfvars_redacted")
    return Summary(raw=raw, nodes=under("generic_config", each("config", config_documents="document", config_paths="path")), constants={"tfvars.literal_values_exposed": False} | {f"safety.{n}": True for n in safe})


def _python() -> Summary:
    py = lambda *k: kind(*(f"python.{x}" for x in k))
    ref, red, err, web = py("reference"), py("redaction"), py("parse_error"), ("flask", "fastapi", "django")
    of = lambda *v: F.coalesce(meta("reference_kind").isin(*v), F.lit(False))
    why = lambda *v: any_of(meta("redaction_reason"), *v)
    in_web = F.coalesce(meta("framework").isin(*web), F.lit(False))
    urls = ("index_url", "extra_index_url", "find_links")
    raw = {
        "python_observations": family("python"),
        "package_files.requirements": py("package_file") & (F.coalesce(meta("file_family").startswith("requirements"), F.lit(False)) | F.coalesce(meta("source_format") == "python-requirements", F.lit(False))),
        "package_files.pyproject": py("pyproject"),
    }
    raw |= under("packaging", each("python", requirements="requirement", dependency_groups="dependency_group", build_systems="build_system", entry_points="entry_point", tool_configs="tool_config"))
    raw |= under("tests", each("python", test_files="test_file", unittest_cases="unittest_case", pytest_tests="pytest_test", test_functions="test_function", test_methods="test_method", parametrize="test_parametrize", assertions="test_assertion"))
    raw |= {"tests.fixtures": py("test_fixture", "pytest_fixture")}
    raw |= under("frameworks", each("python", flask_apps="flask_app", flask_blueprints="flask_blueprint", flask_routes="flask_route", fastapi_apps="fastapi_app", fastapi_routers="fastapi_router", fastapi_routes="fastapi_route", fastapi_dependencies="fastapi_dependency", django_projects="django_project", django_apps="django_app", django_urlpatterns="django_urlpattern", django_views="django_view", django_models="django_model", django_setting_references="django_setting_reference"))
    raw |= {
        "references.total": ref,
        "references.package_refs": ref & (F.coalesce(meta("source_format").isin("python-requirements", "pyproject.toml"), F.lit(False)) | of("include_file", "constraint_file", "direct_url", "vcs_url", "editable_local_path", "local_path", *urls)),
        "references.local_file_refs": ref & (F.coalesce(F.col("target").startswith("file:"), F.lit(False)) | F.coalesce(meta("resolution") == "local", F.lit(False))),
        "references.direct_urls_not_fetched": ref & flag("not_fetched") & (of("direct_url", "vcs_url", "dependency_url") | flag("direct_url")),
        "references.index_urls_not_fetched": ref & flag("not_fetched") & of(*urls), "references.framework_refs": ref & in_web,
        "redactions.credentialed_urls": red & why("credential"), "redactions.private_indexes": red & why("index"), "redactions.secret_like_config": red & why("secret"),
        "redactions.framework_settings": red & (in_web | why(*web)),
        "diagnostics.parse_errors": err, "diagnostics.limit_overflows": err & any_of(meta("error_kind"), "limit"),
        "diagnostics.dynamic_constructs": err & (flag("dynamic") | F.coalesce(meta("error_kind").startswith("dynamic-"), F.lit(False))),
        "generic_python.imports": py("import"), "generic_config.config_references": kind("config.reference"),
    }
    nodes = under("generic_python", each("python", modules="module", classes="class", functions="function", methods="method")) | under("generic_config", each("config", config_documents="document", config_paths="path"))
    safe = (*_KEPT_OUT, "no_imports", "no_test_execution", "no_framework_startup", "no_package_install", "no_openapi_fetch")
    return Summary(raw=raw, nodes=nodes, constants={f"safety.{n}": True for n in safe})


def _email() -> Summary:
    e = lambda *k: kind(*(f"email.{x}" for x in k))
    refs = (F.col("kind") == "references") & F.col("source_key").startswith("email.")
    nodes = each("email", mailboxes="mailbox", messages="message", addresses="address", mime_parts="part", attachment_stubs="attachment_stub", thread_hints="thread_hint") | {
        "eml_messages": e("message") & (meta("format") == "eml"), "mbox_messages": e("message") & (meta("format") == "mbox"),
        "text_plain_parts": e("part") & (meta("content_type") == "text/plain"), "text_html_parts": e("part") & (meta("content_type") == "text/html"),
        "inline_attachments": e("attachment_stub") & flag("inline"), "content_id_parts": e("part", "attachment_stub") & flag("content_id_present"),
        "message_id_present": e("message") & flag("message_id_present"), "message_id_missing_or_invalid": e("message") & ~(flag("message_id_present") & flag("message_id_valid")),
        "messages_with_attachments": e("message") & flag("has_attachments"), "messages_with_html": e("message") & flag("has_text_html"), "messages_with_plain": e("message") & flag("has_text_plain"),
        "mailbox_limits": e("mailbox") & flag("mailbox_message_count_limited"),
    }
    return Summary(
        nodes=nodes,
        node_distinct={"address_domains": F.when(e("address") & has("address_domain"), meta("address_domain"))},
        edges={
            "message_references": refs & (F.col("target_key").startswith("email.message:") | F.col("target_key").startswith("unknown:email-message:")),
            "external_url_references": refs & F.col("target_key").startswith("external.url:"),
        },
        raw={
            "address_observations": e("address"), "list_unsubscribe_references": e("reference") & (meta("reference_kind") == "list_unsubscribe"), "parse_errors": e("parse_error"),
            "malformed_or_oversized_diagnostics": e("parse_error") & (any_of(meta("error_kind"), "limit", "malformed") | F.coalesce(meta("error_kind") == "mbox-missing-from-separator", F.lit(False))),
        },
        constants={n: True for n in ("no_provider_api", "no_mutation", "no_body_text", "no_attachment_content")},
    )


def _bulk() -> Summary:
    mine = F.coalesce(has("bulk_run_id"), F.lit(False))
    return Summary(raw={"bulk_observations": mine, "bulk_redacted_observations": mine & flag("redacted")})


def _api() -> Summary:
    mine = F.coalesce(has("api_run_id"), F.lit(False))
    return Summary(raw={"api_observations": mine, "api_redacted_observations": mine & flag("redacted"), "api_config_documents": mine & kind("config.document")})


SUMMARIES = {"ruby": RUBY, "js": JS, "js_framework": _frameworks, "openapi": _openapi, "terraform": _terraform, "python": _python, "email": _email, "bulk": _bulk, "api": _api}


def summarize(name: str, raw: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return run(SUMMARIES[name](), raw, nodes, edges)


def canonical_storage(store) -> DataFrame:
    """Counts of the canonical tables and the latest run of a store."""
    t = lambda n: store.rows(n)
    row = counts(
        repositories=store.repositories(), runs=t("runs"), raw_observations=t("raw_observations"), canonical_nodes=store.current("canonical_nodes"), canonical_edges=store.current("canonical_edges"),
        canonical_evidence=t("canonical_evidence"), canonical_node_evidence=t("canonical_node_evidence").distinct(), canonical_edge_evidence=t("canonical_edge_evidence").distinct(),
    )
    return row.crossJoin(t("runs").agg(F.max("run_id").alias("latest_run_id")))


def storage(store) -> DataFrame:
    row = counts(runs=store.rows("runs"), files=store.current("files"), nodes=store.current("nodes"), edges=store.current("edges"), evidence=store.current("evidence"))
    return row.crossJoin(store.rows("runs").agg(F.max("run_id").alias("latest_run_id")))


def by_root(store) -> DataFrame:
    """A row a root: its name, its latest run and the counts of its tables."""
    out = store.projects().select("root_path", F.col("name").alias("repository_name"), F.col("run_id").alias("latest_run_id"), F.lit(KEY_VERSION).alias("graph_key_version"))
    frames = {"runs": store.rows("runs"), **{t: store.current(t) for t in ("files", "nodes", "edges", "evidence")}}
    for name, df in frames.items():
        out = out.join(df.groupBy("root_path").agg(F.count(F.lit(1)).alias(name)), "root_path", "left")
    return out.na.fill(0, list(frames))
