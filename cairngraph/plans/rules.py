"""What each kind of observation means to the graph, as data.

A rule names the nodes and edges that an observation asserts, the metadata that they carry, and how its
target is found. `interpret` applies the rule to one observation and returns plain rows; it sees
nothing but that observation, so interpretation needs no shuffle. All merging is relational
(plans/canonicalize.py).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from cairngraph.functions import keys as K
from cairngraph.functions.keys import KeyProblem

# --- Fixed values: metadata that nodes and edges keep, by kind (`from>to` renames) -------------------

_FILE = "language role content_hash executable generated"
FILE_FIELDS = tuple(_FILE.split())
FILE_CONFLICT_FIELDS = frozenset(FILE_FIELDS) - {"role"}
SECRET_VARIABLE_MARKERS = ("SECRET", "TOKEN", "PASSWORD", "PASS", "KEY", "CREDENTIAL", "AUTH")
HOST_CATEGORIES = ("package-management", "service-management", "system-activation", "filesystem-mutation")

NODE_METADATA = {
    "markdown.document": "doc_path doc_role title frontmatter_present content_hash generated",
    "markdown.heading": "level text anchor base_anchor duplicate_index parent_anchor page_key",
    "markdown.adr_metadata": "adr_number title status date filename_slug heading_anchor metadata_source",
    "markdown.skill_metadata": "skill_name description skill_path frontmatter_keys metadata_source parse_status",
    "config.document": "format parser top_level_type document_role path_count record_count parse_error_count profile document_count duplicate_key_policy",
    "config.path": "format pointer display_path value_type container_type redacted redaction_reason value_summary array_policy item_count value_summaries"
    " stable_member_key profile document_index yaml_tag anchor alias merge_key",
    "html.document": "format parser parser_mode title doctype root_element language parse_warning_count element_count anchor_count",
    "html.element": "format parser parser_mode tag pointer id id_is_unique classes attribute_count child_count text_summary structural_identity content_policy content_length"
    " redacted redaction_reason",
    "html.heading": "format parser parser_mode heading_level source_element_pointer source_element_key id id_is_unique text_summary",
    "xml.document": "format parser safety_mode root_tag root_local_name root_namespace_uri namespace_summary document_role element_count attribute_count reference_count"
    " parse_error_count",
    "xml.element": "format parser safety_mode element_name local_name namespace_uri xml_pointer attribute_count child_count identity_mode role_hint text_summary bean_id"
    " class_name property_name bean_ref maven_group_id maven_artifact_id maven_version redacted redaction_reason",
    "xml.attribute": "format parser safety_mode element_pointer attribute_name local_name namespace_uri semantic_key value_type value_summary redacted redaction_reason",
    "css.document": "format parser parser_mode source_kind rule_count selector_count custom_property_count reference_count parse_error_count",
    "css.rule": "format parser parser_mode rule_pointer rule_type selector_text at_rule_name at_rule_prelude_summary declaration_count custom_property_names reference_count"
    " parent_rule_pointer identity_mode font_family_summary",
    "css.selector": "format parser parser_mode selector_pointer rule_pointer selector_text selector_index classes ids element_names attributes pseudo_classes"
    " pseudo_elements selector_kind",
    "css.custom_property": "format parser parser_mode property_name rule_pointer definition_count value_type value_summary redacted redaction_reason",
    "feed": "feed_format parser parser_mode top_level_type identity_source identity_strength duplicate_identity duplicate_disambiguator title name published_at updated_at"
    " email_redacted",
    "warc": "format warc_version record_count parsed_record_count skipped_record_count routed_payload_count record_type record_ordinal identity_source identity_strength"
    " duplicate_identity duplicate_disambiguator target_uri_summary target_uri_redacted warc_date content_type payload_byte_length extractor_route skip_reason",
    "ruby": "format profile parser qualified_name owner method_name superclass constant_name test_framework route_method route_pattern redacted redaction_reason dynamic"
    " dynamic_reason identity_strength",
    "js": "format profile parser module_system export_kind import_kind local_name exported_name qualified_name function_name class_name method_name component_name"
    " test_framework route_method route_pattern literal_type dynamic dynamic_reason redacted redaction_reason identity_strength",
    "document.file": "format parser byte_count line_count paragraph_count section_count reference_count summary_redacted compiled document_kind template package_byte_count"
    " package_part_count parsed_part_count skipped_part_count total_uncompressed_bytes heading_count table_count sheet_count row_count_summary column_count_summary"
    " formulas_evaluated formula_count",
    "document.section": "format pointer heading_level heading_summary command redacted",
    "document.table": "format parser pointer row_count column_count header_present delimiter display_name formula_count formulas_evaluated redacted",
    "document.sheet": "format parser pointer display_name row_count column_count header_present formula_count formulas_evaluated redacted",
    "document.column": "format pointer column_index column_name_summary type_summary non_empty_count redacted redaction_reason",
    "document.latex_command": "format pointer command argument_summary redacted",
    "email.mailbox": "format parser mailbox_message_count mailbox_message_count_limited mailbox_byte_count mailbox_parse_status mailbox_limit_reason mailbox_digest"
    " identity_strength",
    "email.message": "format parser mailbox_file_key mbox_message_ordinal mbox_message_identity message_id_hash message_id_present message_id_valid date date_parse_status"
    " subject_present subject_hash subject_preview_redacted from_count to_count cc_count bcc_count reply_to_count sender_count return_path_count text_plain_part_count"
    " text_html_part_count attachment_count has_text_plain has_text_html has_attachments has_remote_references redacted redaction_reason identity_strength",
    "email.address": "format parser address_role address_domain address_hash address_display_name_redacted redacted redaction_reason",
    "email.part": "format parser mime_type content_type content_disposition charset transfer_encoding part_index part_path part_depth part_byte_count inline"
    " content_id_present redacted redaction_reason",
    "email.attachment_stub": "format parser part_path content_disposition attachment_filename_redacted attachment_filename_hash attachment_mime_type attachment_byte_count"
    " inline content_id_present redacted redaction_reason",
    "email.thread_hint": "format parser thread_hint_kind reference_kind referenced_message_id_hash not_fetched identity_strength",
}

EDGE_METADATA = {
    "shell.source": "source>sources resolved_path>resolved_paths",
    "python.import": "imported_module>imported_modules resolution>resolutions",
    "nix.import": "import_path>imports resolved_path>resolved_paths syntax>syntaxes",
    "nix.output": "flake_ref>flake_refs system>systems attr_path>attr_paths output_kind>output_kinds",
    "nix.exposes": "flake_ref>flake_refs system>systems name>apps program>programs program_path>program_paths",
    "markdown.definition": "doc_role>doc_roles title>titles anchor>anchors adr_number>adr_numbers skill_name>skill_names",
    "markdown.link": "link_text>link_texts raw_target>raw_targets link_syntax>syntaxes resolved_path>resolved_paths resolved_anchor>resolved_anchors"
    " resolution_reason>resolution_reasons",
    "config.definition": "format>formats document_role>document_roles pointer>pointers value_type>value_types",
    "config.reference": "reference_kind>reference_kinds raw_key>raw_keys raw_value_summary>raw_value_summaries resolution_reason>resolution_reasons pointer>pointers",
    "html.definition": "format>formats tag>tags pointer>pointers heading_level>heading_levels structural_identity>structural_identity_modes",
    "html.reference": "reference_kind>reference_kinds attribute>attributes raw_value_summary>raw_value_summaries resolution_reason>resolution_reasons tag>tags pointer>pointers"
    " source_element_pointer>source_element_pointers method>methods field_count>field_counts",
    "xml.definition": "format>formats xml_pointer>xml_pointers element_pointer>element_pointers attribute_name>attributes document_role>document_roles role_hint>role_hints",
    "xml.reference": "reference_kind>reference_kinds source_kind>source_kinds raw_value_summary>raw_value_summaries resolution_reason>resolution_reasons"
    " element_pointer>element_pointers attribute_name>attributes",
    "css.definition": "format>formats rule_pointer>rule_pointers selector_pointer>selector_pointers property_name>custom_properties rule_type>rule_types",
    "css.reference": "reference_kind>reference_kinds source_kind>source_kinds raw_value_summary>raw_value_summaries resolution_reason>resolution_reasons"
    " rule_pointer>rule_pointers property_name>properties",
    "css.selector_match": "match_kind>match_kinds css_file>css_files html_file>html_files stylesheet_reference_source>stylesheet_reference_sources scope>scopes"
    " html_pointer>html_pointers",
    "feed.definition": "feed_format identity_source identity_strength duplicate_identity duplicate_disambiguator parser_mode top_level_type",
    "feed.reference": "feed_format scope attribute field rel mime_type length not_fetched target_kind raw_target_summary email_redacted",
    "warc.definition": "format warc_version record_type record_ordinal identity_source identity_strength duplicate_identity extractor_route skip_reason",
    "warc.reference": "reference_kind not_fetched target_kind target_uri_summary target_uri_redacted record_type record_ordinal",
    "ruby.definition": "profile>profiles qualified_name>qualified_names owner>owners method_name>methods constant_name>constants test_framework>test_frameworks"
    " route_method>route_methods route_pattern>route_patterns",
    "ruby.reference": "profile>profiles raw_value_summary>raw_value_summaries reference_kind>reference_kinds resolution_reason>resolution_reasons",
    "js.definition": "profile>profiles module_system>module_systems function_name>functions class_name>classes method_name>methods local_name>locals component_name>components"
    " test_framework>test_frameworks route_method>route_methods route_pattern>route_patterns",
    "js.reference": "profile>profiles raw_value_summary>raw_value_summaries reference_kind>reference_kinds import_kind>import_kinds export_kind>export_kinds"
    " resolution_reason>resolution_reasons dynamic_reason>dynamic_reasons",
    "document.definition": "format>formats pointer>pointers command>commands type_summary>type_summaries document_kind>document_kinds source_part>source_parts",
    "document.reference": "format>formats reference_kind>reference_kinds raw_value_summary>raw_value_summaries resolution_reason>resolution_reasons command>commands",
    "email.definition": "format>formats mailbox_parse_status>mailbox_parse_statuses mailbox_limit_reason>mailbox_limit_reasons content_type>content_types"
    " content_disposition>content_dispositions part_path>part_paths thread_hint_kind>thread_hint_kinds identity_strength>identity_strengths",
    "email.reference": "format>formats address_role>address_roles address_domain>address_domains reference_kind>reference_kinds thread_hint_kind>thread_hint_kinds"
    " raw_value_summary>raw_value_summaries redaction_reason>redaction_reasons",
}

#: Booleans that a reference edge keeps under a name of its own.
EDGE_FLAGS = {
    "markdown.link": "is_image>image_link_observed",
    "config.reference": "redacted>redacted_observed",
    "html.reference": "redacted>redacted_observed",
    "xml.reference": "redacted>redacted_observed",
    "css.reference": "redacted>redacted_observed",
    "css.selector_match": "not_runtime_style>not_runtime_style_observed",
    "js.reference": "not_fetched>not_fetched dynamic>dynamic_observed",
    "document.definition": "template>template_observed",
    "document.reference": "not_fetched>not_fetched redacted>redacted_observed",
    "email.reference": "not_fetched>not_fetched redacted>redacted_observed",
}


# Texts of diagnostics, as stored graphs hold them.
SAYS = {
    "bad_target": "raw target is not a valid canonical key: {}",
    "no_target": "{} observation requires target",
    "dynamic_command": "dynamic shell command represented by placeholder",
    "no_command": "shell.command is missing metadata.command or metadata.argv[0]",
    "dynamic_source": "dynamic shell source represented by placeholder",
    "lost_source": "shell source target could not be resolved",
    "no_operation": "shell.env observation requires operation metadata",
    "dynamic_variable": "dynamic shell environment variable represented by placeholder",
    "no_variable": "shell.env observation requires variable metadata",
    "hidden_value": "secret-prone shell environment value was redacted",
    "no_category": "shell.host_mutation observation requires category metadata",
    "odd_category": "unregistered shell host mutation category: {}",
    "no_module": "python.import observation requires module metadata",
    "dynamic_import": "dynamic nix import represented by placeholder",
    "lost_import": "nix import target could not be resolved",
    "no_output": "{} observation requires system and name",
    "odd_kind": "raw observation kind is not supported: {}",
}


# --- Results of an interpretation ---------------------------------------------------------------


@dataclass
class Meaning:
    """nodes: (key, display name, metadata, link kind); edges: (source, kind, target, metadata);
    diagnostics: (severity, category, message, field, value, placeholder)."""

    nodes: list[tuple[str, str, dict, str]] = field(default_factory=list)
    edges: list[tuple[str, str, str, dict]] = field(default_factory=list)
    diagnostics: list[tuple] = field(default_factory=list)
    evidence: dict | None = None

    def say(self, severity: str, category: str, message: str, where: str, value: object = None, placeholder: str | None = None) -> None:
        self.diagnostics.append((severity, category, message, where, value, placeholder))


def text(m: Mapping, name: str) -> str | None:
    v = m.get(name)
    return v if isinstance(v, str) and v.strip() else None


def kept(m: Mapping, names: str) -> dict:
    return {n: m[n] for n in names.split() if n in m}


def summary(m: Mapping, family: str) -> dict:
    """Edge metadata: renamed fields become one-element lists (texts and numbers), others stay as they are."""
    out = {}
    for pair in EDGE_METADATA.get(family, "").split():
        name, _, new = pair.partition(">")
        v = m.get(name)
        if not new:
            if name in m:
                out[name] = v
        elif (isinstance(v, str) and v) or (isinstance(v, int) and not isinstance(v, bool)):
            out[new] = [v]
    for pair in EDGE_FLAGS.get(family, "").split():
        name, _, new = pair.partition(">")
        if isinstance(m.get(name), bool):
            out[new] = m[name]
    return out


def check_target(o: Mapping, out: Meaning, placeholder: str | None = None) -> bool:
    """Warns of a raw target that is no key; True if it is not."""
    if o["target"] is None:
        return False
    try:
        K.parse(o["target"])
    except KeyProblem as e:
        out.say("warning", e.category, SAYS["bad_target"].format(e), "target", o["target"], placeholder)
        return True
    return False


def named(o: Mapping, target: str) -> str:
    return o["name"] or target.rpartition(":")[2]


# --- Rules by shape ---------------------------------------------------------------------------------

Rule = Callable[[Mapping, Mapping, Meaning], None]


def defines(family: str, node: str | None, target: Callable[[Mapping, Mapping, Meaning], str], source: Callable[[Mapping, Mapping], str] | None = None, display: Callable | None = None) -> Rule:
    """source -defines-> target; the target is observed, the source only inferred."""

    def rule(o: Mapping, m: Mapping, out: Meaning) -> None:
        src = source(o, m) if source else K.file_key(o["path"])
        dst = target(o, m, out)
        out.nodes.append((src, o["path"] if src.startswith("file:") else src.rpartition(":")[2], {}, "inferred_from_edge"))
        out.nodes.append((dst, display(o, m, dst) if display else named(o, dst), kept(m, NODE_METADATA[node]) if node else {}, "observed"))
        out.edges.append((src, "defines", dst, summary(m, f"{family}.definition")))
        out.evidence = m

    return rule


def refers(family: str, domain: str, source: Callable[[Mapping, Mapping], str], edge: str = "references", missing: str = "missing-target", malformed: str = "malformed-target") -> Rule:
    """source -edge-> the raw target, or a placeholder for it."""

    def rule(o: Mapping, m: Mapping, out: Meaning) -> None:
        src = source(o, m)
        if o["target"] is None:
            dst = K.unknown(domain, missing)
            out.say("warning", "missing_required_metadata", SAYS["no_target"].format(o["kind"]), "target", None, dst)
        else:
            placeholder = K.unknown(domain, malformed)
            dst = placeholder if check_target(o, out, placeholder) else o["target"]
        out.nodes.append((src, o["path"] if src.startswith("file:") else src.rpartition(":")[2], {}, "inferred_from_edge"))
        out.nodes.append((dst, dst.rpartition(":")[2], {}, "inferred_from_edge"))
        out.edges.append((src, edge, dst, summary(m, family)))
        out.evidence = m

    return rule


def evidence_only(o: Mapping, m: Mapping, out: Meaning) -> None:
    out.evidence = m


def own_target(build: Callable[[Mapping, Mapping], str]) -> Callable[[Mapping, Mapping, Meaning], str]:
    """Always rebuilt; a bad raw target is only warned of."""

    def target(o: Mapping, m: Mapping, out: Meaning) -> str:
        made = build(o, m)
        check_target(o, out)
        return made

    return target


def given_target(build: Callable[[Mapping, Mapping], str]) -> Callable[[Mapping, Mapping, Meaning], str]:
    """The raw target if it is a key, else rebuilt."""

    def target(o: Mapping, m: Mapping, out: Meaning) -> str:
        if o["target"] is not None and K.is_key(o["target"]):
            return o["target"]
        made = build(o, m)
        check_target(o, out)
        return made

    return target


def required(value: str | None, what: str) -> str:
    if value is None or not value.strip():
        raise KeyProblem(f"{what} is required")
    return value


def key_or(default: Callable[[Mapping, Mapping], str], *namespaces: str, name: str = "source_key") -> Callable[[Mapping, Mapping], str]:
    """metadata[name] if its namespace is allowed (another is an error), else the default."""

    def source(o: Mapping, m: Mapping) -> str:
        given = text(m, name)
        if given is None:
            return default(o, m)
        if K.parse(given)[0] not in namespaces:
            raise KeyProblem(f"{o['kind']} {name} must be one of {', '.join(namespaces)}")
        return given

    return source


def by_path(namespace: str) -> Callable[[Mapping, Mapping], str]:
    return lambda o, m: K.within(namespace, o["path"])


def by_pointer(namespace: str, *names: str) -> Callable[[Mapping, Mapping], str]:
    def build(o: Mapping, m: Mapping) -> str:
        pointer = next((v for v in (text(m, n) for n in names) if v), None) or o["name"]
        return K.within(namespace, o["path"], required(pointer, f"{o['kind']} pointer"))

    return build


# --- Rules of single kinds --------------------------------------------------------------------------


def _file(o: Mapping, m: Mapping, out: Meaning) -> None:
    out.nodes.append((K.file_key(o["path"]), o["path"], kept(m, _FILE), "observed"))
    out.evidence = m


def _edge(out: Meaning, o: Mapping, m: Mapping, kind: str, dst: str, metadata: dict, display: str | None = None) -> None:
    src = K.file_key(o["path"])
    out.nodes += [(src, o["path"], {}, "inferred_from_edge"), (dst, display or dst.rpartition(":")[2], {}, "inferred_from_edge")]
    out.edges.append((src, kind, dst, metadata))


def _command(o: Mapping, m: Mapping, out: Meaning) -> None:
    K.file_key(o["path"])
    argv = m.get("argv") if isinstance(m.get("argv"), list) else None
    name = text(m, "command") or (argv[0] if argv and isinstance(argv[0], str) and argv[0].strip() else None)
    extra = {"argv_examples": [argv]} if argv is not None else {}
    if name:
        dst, display, metadata = K.key("tool", name), name, {"commands": [name]} | extra
    else:
        reason, where, value = text(m, "dynamic_reason"), "metadata.dynamic_reason", m.get("dynamic_reason")
        if reason is None and o["target"] is not None and K.is_key(o["target"]):
            namespace, parts = K.parse(o["target"])
            if namespace == "dynamic" and parts[0] == "tool" and parts[1].strip():
                reason, where, value = parts[1], "target", o["target"]
        if reason:
            dst, display, metadata = K.dynamic("tool", reason), reason, {"dynamic_reasons": [reason]} | extra
            out.say("info", "dynamic_target", SAYS["dynamic_command"], where, value, dst)
        else:
            dst, display, metadata = K.unknown("tool", "missing-command"), "missing-command", {}
            out.say("warning", "missing_required_metadata", SAYS["no_command"], "metadata.command", None, dst)
    check_target(o, out, None if dst.startswith("tool:") else dst)
    _edge(out, o, m, "executes", dst, metadata, display)
    out.evidence = m


def _source(o: Mapping, m: Mapping, out: Meaning) -> None:
    K.file_key(o["path"])
    resolved, reason = text(m, "resolved_path"), text(m, "dynamic_reason")
    if resolved:
        try:
            dst = K.file_key(resolved)
        except KeyProblem as e:
            dst = K.unknown("file", "repo-escaping-source")
            out.say("warning", e.category, str(e), "metadata.resolved_path", resolved, dst)
    elif reason:
        dst = K.dynamic("file", reason)
        out.say("info", "dynamic_target", SAYS["dynamic_source"], "metadata.dynamic_reason", reason, dst)
    else:
        dst = K.unknown("file", "unresolved-shell-source")
        if not check_target(o, out, dst):
            out.say("warning", "unknown_target", SAYS["lost_source"], "target", o["target"], dst)
    _edge(out, o, m, "sources", dst, summary(m, "shell.source"))
    out.evidence = m


def secret_variable(name: str) -> bool:
    return any(s in name.upper() for s in SECRET_VARIABLE_MARKERS)


def _env(o: Mapping, m: Mapping, out: Meaning) -> None:
    K.file_key(o["path"])
    operation = m.get("operation")
    if operation not in ("read", "write"):
        out.say("warning", "missing_required_metadata", SAYS["no_operation"], "metadata.operation", operation)
        return
    variable, reason = text(m, "variable"), text(m, "dynamic_reason")
    if variable:
        dst = K.key("env", variable)
    elif reason:
        dst = K.dynamic("env", reason)
        out.say("info", "dynamic_target", SAYS["dynamic_variable"], "metadata.dynamic_reason", reason, dst)
    else:
        dst = K.unknown("env", "missing-variable")
        out.say("warning", "missing_required_metadata", SAYS["no_variable"], "metadata.variable", m.get("variable"), dst)
    hidden = operation == "write" and variable is not None and "value" in m and secret_variable(variable)
    metadata: dict = {"operations": [operation]}
    if operation == "write":
        if text(m, "scope"):
            metadata["scopes"] = [m["scope"]]
        if hidden:
            metadata["value_redacted"] = True
        elif "value" in m:
            metadata["values"] = [m["value"]]
    if hidden:
        out.say("info", "redacted_value", SAYS["hidden_value"], "metadata.value", None)
    _edge(out, o, m, f"{operation}s_env", dst, metadata)
    out.evidence = {k: v for k, v in m.items() if k != "value"} | {"value_present": True, "value_redacted": True} if hidden else m


def _mutation(o: Mapping, m: Mapping, out: Meaning) -> None:
    K.file_key(o["path"])
    category = text(m, "category")
    if category is None:
        dst = K.unknown("host.category", "missing-host-category")
        out.say("warning", "missing_required_metadata", SAYS["no_category"], "metadata.category", m.get("category"), dst)
    elif category not in HOST_CATEGORIES:
        dst = K.unknown("host.category", f"unregistered-{category}")
        out.say("warning", "unregistered_category", SAYS["odd_category"].format(category), "metadata.category", category, dst)
    else:
        dst = K.key("host.category", category)
    metadata: dict = {}
    if text(m, "tool"):
        metadata["tools"] = [m["tool"]]
    for name, new in (("argv", "argv_examples"), ("effective_argv", "effective_argv_examples")):
        if isinstance(m.get(name), list):
            metadata[new] = [m[name]]
    if isinstance(m.get("privileged"), bool):
        metadata["privileged_observed"] = m["privileged"]
    if text(m, "reason"):
        metadata["reasons"] = [m["reason"]]
    _edge(out, o, m, "mutates_host", dst, metadata)
    out.evidence = m


def _python_definition(o: Mapping, m: Mapping, out: Meaning) -> None:
    src = K.file_key(o["path"])
    level = o["kind"].partition(".")[2]
    module = required(text(m, "module") or (o["name"] if level == "module" else None), "python module")
    name = o["name"] or text(m, "name")
    owner = text(m, "class") or text(m, "class_name")
    if level == "module":
        dst, display = K.key("python.module", module), module
    elif level == "method":
        owner = required(owner, "python class")
        dst, display = K.key("python.method", module, owner, required(name, "python name")), f"{owner}.{name}"
    else:
        dst = K.key(f"python.{level}", module, required(name, "python name"))
        display = name
    out.nodes += [(src, o["path"], {}, "inferred_from_edge"), (dst, display, {}, "observed")]
    metadata = {{"module": "modules", "class": "classes", "function": "functions", "method": "methods"}[level]: [display]}
    out.edges.append((src, "defines", dst, metadata))
    out.evidence = m


def _python_import(o: Mapping, m: Mapping, out: Meaning) -> None:
    module = text(m, "module")
    if module is None:
        out.say("warning", "missing_required_metadata", SAYS["no_module"], "metadata.module", module)
        return
    src, imported = K.key("python.module", module), text(m, "imported_module")
    resolution = m.get("resolution")
    if resolution == "unknown" or imported is None:
        usable = o["target"] is not None and K.is_key(o["target"]) and resolution == "unknown"
        dst = o["target"] if usable else K.unknown("python.module", "missing-module")
    elif resolution == "external":
        dst = K.external("python.module", imported)
    else:
        dst = K.key("python.module", imported)
    out.nodes += [(src, module, {}, "inferred_from_edge"), (dst, dst.rpartition(":")[2], {}, "inferred_from_edge")]
    out.edges.append((src, "imports", dst, summary(m, "python.import")))
    out.evidence = m


def _nix_import(o: Mapping, m: Mapping, out: Meaning) -> None:
    K.file_key(o["path"])
    resolved, reason = text(m, "resolved_path"), text(m, "dynamic_reason")
    if resolved:
        try:
            dst = K.file_key(resolved)
        except KeyProblem as e:
            dst = K.unknown("file", "repo-escaping-nix-import")
            out.say("warning", e.category, str(e), "metadata.resolved_path", resolved, dst)
    elif reason:
        dst = K.dynamic("file", reason)
        out.say("info", "dynamic_target", SAYS["dynamic_import"], "metadata.dynamic_reason", reason, dst)
    else:
        dst = K.unknown("file", "unresolved-nix-import")
        if not check_target(o, out, dst):
            out.say("warning", "unknown_target", SAYS["lost_import"], "target", o["target"], dst)
    _edge(out, o, m, "sources", dst, summary(m, "nix.import"))
    out.evidence = m


def _nix_output(o: Mapping, m: Mapping, out: Meaning) -> None:
    src, name = K.file_key(o["path"]), o["name"] or text(m, "name")
    flake, system = text(m, "flake_ref") or ".", text(m, "system")
    if name is None or system is None:
        dst = K.unknown(o["kind"], "missing-output-identity")
        out.say("warning", "missing_required_metadata", SAYS["no_output"].format(o["kind"]), "metadata.name", name, dst)
    else:
        dst = K.key(o["kind"], flake, system, name)
    metadata = summary(m, "nix.output")
    plural = {"nix.app": "apps", "nix.package": "packages", "nix.devShell": "devShells", "nix.check": "checks"}[o["kind"]]
    if name:
        metadata[plural] = [name]
    out.nodes += [(src, o["path"], {}, "inferred_from_edge"), (dst, name or dst.rpartition(":")[2], {}, "observed")]
    out.edges.append((src, "defines", dst, metadata))
    program = text(m, "program_path")
    if o["kind"] == "nix.app" and program:
        try:
            script = K.file_key(program)
        except KeyProblem as e:
            script = K.unknown("file", "repo-escaping-nix-app-program")
            out.say("warning", e.category, str(e), "metadata.program_path", program, script)
        out.nodes.append((script, script.rpartition(":")[2], {}, "inferred_from_edge"))
        out.edges.append((dst, "exposes_script", script, summary(m, "nix.exposes")))
    out.evidence = m


def _markdown_page(o: Mapping, m: Mapping, out: Meaning) -> None:
    page = text(m, "page_key") or K.within("doc.page", o["path"])
    K.parse(page)
    names = {"markdown.frontmatter": (("keys", "frontmatter_keys"), ("parse_status", "frontmatter_parse_statuses")), "markdown.code_fence": (("language", "code_fence_languages"), ("closed", "code_fence_closed_observed"))}
    metadata = {}
    for name, new in names[o["kind"]]:
        if name in m:
            v = m[name]
            metadata[new] = v if isinstance(v, (bool, list)) else [v]
    out.nodes.append((page, o["path"], metadata, "observed"))
    out.evidence = m


_DOCUMENT_PARTS = {
    "document.text_section": "section", "document.latex_section": "section", "document.odf_text": "section", "document.table_document": "table", "document.odf_table": "table",
    "document.odf_sheet": "sheet", "document.table_column": "column", "document.odf_column": "column", "document.latex_command": "latex_command",
}


def _document(o: Mapping, m: Mapping, out: Meaning) -> None:
    src, doc = K.file_key(o["path"]), K.within("document.file", o["path"])
    metadata = summary(m, "document.definition")
    out.nodes += [(src, o["path"], {}, "inferred_from_edge"), (doc, o["path"], kept(m, NODE_METADATA["document.file"]), "observed")]
    out.edges.append((src, "defines", doc, metadata))
    if part := _DOCUMENT_PARTS.get(o["kind"]):
        pointer = required(text(m, "pointer") or o["name"], f"{o['kind']} pointer")
        dst = K.within(f"document.{part}", o["path"], pointer)
        display = text(m, "display_name") or text(m, "heading_summary") or text(m, "column_name_summary") or o["name"] or pointer
        out.nodes.append((dst, display, kept(m, NODE_METADATA[f"document.{part}"]), "observed"))
        out.edges.append((doc, "defines", dst, metadata))
    check_target(o, out)
    out.evidence = m


def _feed(o: Mapping, m: Mapping, out: Meaning) -> None:
    document = K.within("feed.document", o["path"])
    src = K.file_key(o["path"]) if o["kind"] == "feed.document" else key_or(lambda *_: document, "feed.document", "feed.channel", "feed.item")(o, m)
    dst = document if o["kind"] == "feed.document" else o["target"]
    if dst is None or K.parse(dst)[0] != o["kind"]:
        raise KeyProblem(f"{o['kind']} observation requires a {o['kind']} target")
    out.nodes += [(src, o["path"] if src.startswith("file:") else src.rpartition(":")[2], {}, "inferred_from_edge"), (dst, text(m, "title") or named(o, dst), kept(m, NODE_METADATA["feed"]), "observed")]
    out.edges.append((src, "defines", dst, summary(m, "feed.definition")))
    item = text(m, "item_key")
    if o["kind"] in ("feed.author", "feed.category") and item:
        out.edges.append((item, "references", dst, summary(m, "feed.reference")))
        out.nodes.append((item, item.rpartition(":")[2], {}, "inferred_from_edge"))
    out.evidence = m


def _warc_reference(o: Mapping, m: Mapping, out: Meaning) -> None:
    src = key_or(lambda o, m: K.within("warc.document", o["path"]), "warc.document", "warc.record")(o, m)
    dst = K.unknown("warc.reference", "missing-target") if o["target"] is None else o["target"]
    K.parse(dst)
    out.nodes += [(src, src.rpartition(":")[2], {}, "inferred_from_edge"), (dst, dst.rpartition(":")[2], {}, "inferred_from_edge")]
    out.edges.append((src, "references", dst, summary(m, "warc.reference")))
    out.evidence = m


def _needs_target(namespace: str | None = None) -> Callable[[Mapping, Mapping], str]:
    def build(o: Mapping, m: Mapping) -> str:
        raise KeyProblem(f"{o['kind']} observation requires a target{f' in {namespace}' if namespace else ''}")

    return build


def _markdown_source(o: Mapping, m: Mapping) -> str:
    anchor = text(m, "source_anchor")
    return K.within("doc.section", o["path"], anchor) if anchor else K.within("doc.page", o["path"])


def _email_target(o: Mapping, m: Mapping) -> str:
    if o["kind"] == "email.mailbox":
        return K.within("email.mailbox", o["path"])
    if o["kind"] == "email.message":
        return K.within("email.message", o["path"], f"{text(m, 'identity_strength') or 'structural'}:{text(m, 'message_id_hash') or o['source_id']}")
    pointer = text(m, "part_path") or text(m, "thread_hint_kind") or o["name"]
    return K.key(o["kind"], required(text(m, "source_key"), f"{o['kind']} source_key"), required(pointer, f"{o['kind']} pointer"))


def _email_name(o: Mapping, m: Mapping, key: str) -> str:
    if o["kind"] == "email.mailbox" and isinstance(m.get("mailbox_message_count"), int):
        return f"email mailbox ({m['mailbox_message_count']} messages)"
    if o["kind"] == "email.message" and text(m, "message_id_hash"):
        return f"email message {m['message_id_hash'][:12]}"
    return text(m, "part_path") or text(m, "thread_hint_kind") or named(o, key)


def _email_address(o: Mapping, m: Mapping, out: Meaning) -> None:
    src = key_or(_needs_target("email.message"), "email.message", "email.mailbox", "email.part")(o, m)
    dst = o["target"] if o["target"] is not None else K.key("email.address", f"addrhash:{required(text(m, 'address_hash'), 'email.address address_hash')}")
    if K.parse(dst)[0] != "email.address":
        raise KeyProblem("email.address target must be email.address")
    out.nodes += [(src, src.rpartition(":")[2], {}, "inferred_from_edge"), (dst, text(m, "address_domain") or named(o, dst), kept(m, NODE_METADATA["email.address"]), "observed")]
    out.edges.append((src, "references", dst, summary(m, "email.reference")))
    out.evidence = m


RULES: dict[str, Rule] = {
    "file": _file,
    "shell.command": _command,
    "shell.source": _source,
    "shell.env": _env,
    "shell.host_mutation": _mutation,
    **{f"python.{k}": _python_definition for k in ("module", "class", "function", "method")},
    "python.import": _python_import,
    "nix.import": _nix_import,
    **{f"nix.{k}": _nix_output for k in ("app", "package", "devShell", "check")},
    "markdown.document": defines("markdown", "markdown.document", own_target(by_path("doc.page")), display=lambda o, m, k: text(m, "title") or o["path"]),
    "markdown.heading": defines(
        "markdown", "markdown.heading", own_target(lambda o, m: K.within("doc.section", o["path"], required(text(m, "anchor"), "markdown.heading anchor"))),
        display=lambda o, m, k: text(m, "text") or o["name"] or m["anchor"],
    ),
    "markdown.adr_metadata": defines(
        "markdown", "markdown.adr_metadata", own_target(lambda o, m: K.key("doc.adr", required(text(m, "adr_number") or o["name"], "ADR number"))),
        display=lambda o, m, k: text(m, "title") or text(m, "adr_number") or o["name"],
    ),
    "markdown.skill_metadata": defines(
        "markdown", "markdown.skill_metadata", own_target(lambda o, m: K.key("doc.skill", required(text(m, "skill_name") or o["name"], "skill name"))),
        display=lambda o, m, k: text(m, "skill_name") or o["name"],
    ),
    "markdown.frontmatter": _markdown_page,
    "markdown.code_fence": _markdown_page,
    "markdown.link": refers("markdown.link", "external.url", key_or(_markdown_source, "doc.page", "doc.section"), "links_to", "missing-markdown-link-target", "malformed-markdown-link"),
    "config.document": defines("config", "config.document", own_target(by_path("config.document")), display=lambda o, m, k: text(m, "document_role") or o["path"]),
    "config.path": defines(
        "config", "config.path", own_target(by_pointer("config.path", "pointer")), source=key_or(by_path("config.document"), "config.document", "config.path", "file", name="parent_key"),
        display=lambda o, m, k: text(m, "pointer") or o["name"],
    ),
    "config.reference": refers("config.reference", "config.reference", key_or(by_path("config.document"), "config.document", "config.path")),
    "html.document": defines("html", "html.document", given_target(by_path("html.document"))),
    "html.element": defines("html", "html.element", given_target(by_pointer("html.element", "pointer")), source=key_or(by_path("html.document"), "html.document", "html.element")),
    "html.heading": defines("html", "html.heading", given_target(by_pointer("html.element", "source_element_pointer", "pointer")), source=key_or(by_path("html.document"), "html.document", "html.element")),
    **{f"html.{k}": refers("html.reference", "html.reference", key_or(by_path("html.document"), "html.document", "html.element", "html.anchor")) for k in ("link", "asset", "form")},
    "xml.document": defines("xml", "xml.document", given_target(by_path("xml.document"))),
    "xml.element": defines("xml", "xml.element", given_target(by_pointer("xml.element", "xml_pointer")), source=key_or(by_path("xml.document"), "xml.document", "xml.element")),
    "xml.attribute": defines("xml", "xml.attribute", given_target(_needs_target("xml.attribute")), source=key_or(by_path("xml.document"), "xml.document", "xml.element")),
    "xml.reference": refers("xml.reference", "xml.reference", key_or(by_path("xml.document"), "xml.document", "xml.element", "xml.attribute")),
    "css.document": defines("css", "css.document", given_target(by_path("css.document"))),
    "css.rule": defines("css", "css.rule", given_target(by_pointer("css.rule", "rule_pointer")), source=key_or(by_path("css.document"), "css.document", "css.rule")),
    "css.selector": defines("css", "css.selector", given_target(by_pointer("css.selector", "selector_pointer")), source=key_or(by_path("css.document"), "css.document", "css.rule")),
    "css.custom_property": defines("css", "css.custom_property", given_target(by_pointer("css.custom_property", "property_name")), source=key_or(by_path("css.document"), "css.document", "css.rule")),
    "css.reference": refers("css.reference", "css.reference", key_or(by_path("css.document"), "css.document", "css.rule", "css.custom_property")),
    "css.selector_match": refers("css.selector_match", "css.selector_match", key_or(by_path("css.document"), "css.selector"), "styles"),
    **{f"feed.{k}": _feed for k in ("document", "channel", "item", "author", "category")},
    **{f"feed.{k}": refers("feed.reference", "feed.reference", key_or(by_path("feed.document"), "feed.document", "feed.channel", "feed.item")) for k in ("link", "enclosure")},
    "warc.document": defines("warc", "warc", given_target(by_path("warc.document"))),
    "warc.record": defines("warc", "warc", given_target(_needs_target("warc.record")), source=key_or(by_path("warc.document"), "warc.document")),
    "warc.reference": _warc_reference,
    **{k: _document for k in ("document.text_document", "document.latex_document", "document.odf_document", *_DOCUMENT_PARTS)},
    "document.reference": refers("document.reference", "document.reference", key_or(by_path("document.file"), "document.file", "document.section", "document.table", "document.column", "document.sheet")),
    **{
        f"ruby.{k}": defines("ruby", "ruby", given_target(by_path("ruby.file") if k == "file" else _needs_target(f"ruby.{k}")), source=key_or(lambda o, m: K.file_key(o["path"]), "file", "ruby.file", "ruby.module", "ruby.class", "ruby.test_case"))
        for k in ("file", "module", "class", "method", "singleton_method", "constant", "test_case", "test_method", "route")
    },
    **{f"ruby.{k}": refers("ruby.reference", "ruby.reference", key_or(by_path("ruby.file"), "ruby.file", "ruby.module", "ruby.class", "ruby.method")) for k in ("reference",)},
    **{
        f"js.{k}": defines("js", "js", given_target(by_path("js.file") if k == "file" else by_path("js.module") if k == "module" else _needs_target(f"js.{k}")), source=key_or(lambda o, m: K.file_key(o["path"]), "file", "js.file", "js.module", "js.class", "js.test_suite"))
        for k in ("file", "module", "function", "class", "method", "variable", "component", "test_suite", "test_case", "route")
    },
    **{f"js.{k}": refers("js.reference", "js.reference", key_or(by_path("js.module"), "js.file", "js.module", "js.function", "js.class", "js.component")) for k in ("reference",)},
    **{
        f"email.{k}": defines("email", f"email.{k}", given_target(_email_target), source=key_or(lambda o, m: K.file_key(o["path"]), "file", "email.mailbox", "email.message", "email.part"), display=_email_name)
        for k in ("mailbox", "message", "part", "attachment_stub", "thread_hint")
    },
    "email.address": _email_address,
    "email.reference": refers("email.reference", "email.reference", key_or(lambda o, m: K.file_key(o["path"]), "file", "email.message", "email.part")),
    **{
        k: evidence_only
        for k in (
            "config.jsonl_record config.parse_error html.parse_error xml.parse_error css.declaration css.parse_error feed.content feed.parse_error warc.header warc.payload"
            " warc.parse_error document.parse_error email.header email.parse_error ruby.require ruby.include ruby.extend ruby.dsl ruby.gem_dependency ruby.vagrant_config ruby.parse_error"
            " js.import js.export js.hook js.test_expectation js.interface js.type_alias js.enum js.parse_error ecosystem.config_profile ecosystem.package ecosystem.script"
            " ecosystem.dependency ecosystem.tool ecosystem.framework_hint ecosystem.reference ecosystem.redaction ecosystem.parse_error npm.package npm.script npm.dependency"
            " typescript.config typescript.reference angular.project angular.target jest.config nest.config playwright.config terraform.file terraform.block terraform.provider"
            " terraform.resource terraform.data_source terraform.module terraform.variable terraform.output terraform.local terraform.backend terraform.required_provider"
            " terraform.required_version terraform.reference terraform.moved terraform.import terraform.check terraform.removed terraform.parse_error terraform.redaction"
            " kubernetes.resource argocd.application liquibase.changelog liquibase.changeset docker.reference js.framework_profile js.runtime_profile js.package_context"
            " js.route_handler js.middleware js.controller js.provider js.module_binding js.test_config js.dom_selector js.dom_event js.ajax_reference js.server_entrypoint"
            " js.client_entrypoint js.framework_reference node.entrypoint node.export node.require express.app express.router express.route express.middleware"
            " express.error_handler nest.module nest.controller nest.provider nest.route nest.decorator next.route next.page next.api_route next.app_route next.component jest.suite"
            " jest.test jest.expectation jest.mock jquery.selector jquery.event jquery.ajax jquery.plugin_reference"
        ).split()
    },
}


def interpret(o: Mapping) -> Meaning:
    """What one observation (a mapping of the envelope, metadata as canonical JSON) asserts."""
    out = Meaning()
    rule = RULES.get(o["kind"])
    if rule is None:
        out.say("warning", "unsupported_raw_observation_kind", SAYS["odd_kind"].format(o["kind"]), "kind", o["kind"])
        return out
    m = json.loads(o["metadata"] or "{}")
    try:
        rule(o, m, out)
    except KeyProblem as e:
        out = Meaning()
        where, value = ("path", o["path"]) if not _good_path(o["path"]) or o["target"] is None else ("target", o["target"])
        out.say("error", e.category, str(e), where, value)
    return out


def _good_path(path: str) -> bool:
    try:
        K.file_key(path)
    except KeyProblem:
        return False
    return True
