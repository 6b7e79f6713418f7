"""Configuration files: JSON, JSONC, JSON lines, TOML, property lists and XML, requirements and HCL.

One `config.document` a file, one `config.path` an object member under its RFC 6901 pointer, references
out of values. Members whose name is secret keep no value.
"""

from __future__ import annotations

import json
import plistlib
import re
import tomllib
from collections.abc import Iterator
from xml.etree import ElementTree

from cairngraph.functions import keys as K
from cairngraph.operators import yaml_lite
from cairngraph.operators.base import Context, observation, redact_url, reference_target, secret_name, summary
from cairngraph.operators.hcl import Block
from cairngraph.operators.hcl import parse as parse_hcl

NAME = "cairn-config"
SAFETY = "pre-scan-no-doctype-entity-no-external-resources"
STABLE = ("name", "id", "key", "project")
_ENV = ("env", "environment", "envvars")


def value_type(v: object) -> str:
    return "null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object" if isinstance(v, dict) else "string"


def value_summary(v: object) -> str | None:
    if isinstance(v, (dict, list)):
        return None
    s = v if isinstance(v, str) else json.dumps(v, default=str)
    return redact_url(s) if len(s) <= 120 and s.isprintable() else f"<string:{len(s)}>"


def pointer(parts: list[str]) -> str:
    return "".join("/" + p.replace("~", "~0").replace("/", "~1") for p in parts)


def without_comments(content: str) -> str:
    """JSONC as JSON: comments and commas before a closing bracket dropped, outside of strings."""
    tokens = re.compile(r'"(?:[^"\\]|\\.)*"|//[^\n]*|/\*.*?\*/', re.S)
    plain = tokens.sub(lambda m: m[0] if m[0][0] == '"' else " " * (not m[0].startswith("//")), content)
    return re.sub(r'("(?:[^"\\]|\\.)*")|,(\s*[}\]])', lambda m: m[1] or m[2], plain)


def stable_members(items: list) -> list[tuple[str, object]] | None:
    """Members of an array that have a unique name, id, key or project; None for other arrays."""
    if not items or not all(isinstance(i, dict) for i in items):
        return None
    for k in STABLE:
        names = [i.get(k) for i in items]
        if all(isinstance(n, str) and n for n in names) and len(set(names)) == len(names):
            return [(f"{k}={n}", i) for n, i in zip(names, items, strict=True)]
    return None


def walk(value: object, parts: list[str], arrays: bool) -> Iterator[tuple[list[str], object, object]]:
    """(pointer parts, value, its container) of all object members, depth first."""
    members = list(value.items()) if isinstance(value, dict) else (stable_members(value) or []) if arrays and isinstance(value, list) else []
    for k, v in members:
        here = [*parts, str(k)]
        yield here, v, value
        yield from walk(v, here, arrays)


def role(path: str) -> str:
    name = path.rpartition("/")[2].lower()
    known = {"package.json": "package", "pyproject.toml": "package", "tsconfig.json": "typescript", "angular.json": "angular", "composer.json": "package", "cargo.toml": "package"}
    if name in known:
        return known[name]
    return "lock" if "lock" in name else "log" if name.endswith(".jsonl") else "settings" if "settings" in name else "config"


def members(path: str, value: object, fmt: str, parser: str, arrays: bool, confidence: str = "extracted", line: int | None = None, suffix: str = "", **extra: object) -> list[dict]:
    out, refs = [], []
    document = K.within("config.document", path)
    for parts, v, container in walk(value, [], arrays):
        p = pointer(parts)
        hidden = any(secret_name(x) for x in parts)
        shown = None if hidden or isinstance(v, (dict, list)) else value_summary(v)
        more: dict = {"array_policy": "summary-only", "item_count": len(v)} if isinstance(v, list) and not (arrays and stable_members(v)) else {}
        out.append(observation("config.path", path, f"config-path:{p}{suffix}", NAME, confidence, line=line, name=p, target=K.within("config.path", path, p), container_type=value_type(container), display_path=p, format=fmt,
                               pointer=p, redacted=hidden, redaction_reason="secret-prone-key" if hidden else None, value_summary=shown, value_type=value_type(v), parser=parser, **more, **extra))
        if isinstance(v, str) and not hidden and (found := _reference(path, parts, v)):
            target, kind, reason = found
            refs.append(observation("config.reference", path, f"config-reference:{p}{suffix}", NAME, line=line, name=p, target=target, format=fmt, pointer=p, raw_key=parts[-1], raw_value_summary=value_summary(v), redacted=False,
                                    reference_kind=kind, resolution_reason=reason, source_key=K.within("config.path", path, p), source_document_key=document))
    return out + refs


def _reference(path: str, parts: list[str], v: str) -> tuple[str, str, str] | None:
    if any(p.lower() in _ENV for p in parts[:-1]):
        return K.key("env", parts[-1]), "env", "environment-member"
    if m := re.fullmatch(r"\$\{?([A-Za-z_]\w*)\}?", v):
        return K.key("env", m[1]), "env", "environment-variable"
    if re.match(r"(?i)https?://", v):
        return K.key("external.url", redact_url(v)), "external.url", "url-literal"
    if parts[-1].lower() in ("command", "cmd", "executable", "program") and re.fullmatch(r"[\w.-]+", v):
        return K.key("tool", v), "tool", "tool-key"
    if v.startswith(("./", "../", "/")) or ("/" in v and re.fullmatch(r"[\w.@$/{}-]+\.\w{1,8}", v)):
        return reference_target(path, v)
    return None


def _document(path: str, fmt: str, parser: str, value: object, found: list[dict], confidence: str = "extracted", **extra: object) -> dict:
    paths = sum(o["kind"] == "config.path" for o in found)
    return observation("config.document", path, "config-document", NAME, confidence, target=K.within("config.document", path), document_role=role(path), format=fmt, parser=parser, path_count=paths,
                       top_level_type=extra.pop("top_level_type", None) or value_type(value), parse_error_count=extra.pop("parse_error_count", 0), **extra)


def _error(path: str, fmt: str, kind: str, message: str, line: int | None = None, recovered: bool = False, family: str = "config") -> dict:
    return observation(f"{family}.parse_error", path, f"{family}-parse-error:{kind}:{line or 0}", NAME, "unknown", line=line, format=fmt, error_kind=kind, message_summary=message[:160], recovered=recovered)


def structured(path: str, content: str, fmt: str) -> Iterator[dict]:
    """JSON, JSONC and TOML."""
    try:
        value = tomllib.loads(content) if fmt == "toml" else json.loads(without_comments(content) if fmt == "jsonc" else content)
    except (ValueError, RecursionError) as e:
        yield _error(path, fmt, f"malformed-{fmt}", str(e), getattr(e, "lineno", None))
        return
    parser = "tomllib" if fmt == "toml" else "stdlib-json"
    found = members(path, value, fmt, parser, fmt == "toml")
    yield _document(path, fmt, parser, value, found)
    yield from found
    if path.rpartition("/")[2] == "package.json" and isinstance(value, dict):
        yield from npm(path, value)
    if path.rpartition("/")[2] == "pyproject.toml":
        yield from pyproject(path, value)
    if path.endswith(".tf.json") and isinstance(value, dict):
        yield from terraform_json(path, value)
    yield from profiles(path, value)


def yaml(path: str, content: str) -> Iterator[dict]:
    try:
        values = list(yaml_lite.documents(content))
    except yaml_lite.YamlProblem as e:
        yield _error(path, "yaml", "malformed-yaml", str(e), e.lineno)
        return
    found = [o for i, v in enumerate(values) for o in members(path, v, "yaml", "conservative-yaml", True, suffix=f":document-{i}" if len(values) > 1 else "", document_index=i)]
    yield _document(path, "yaml", "conservative-yaml", values[0] if values else None, found, document_count=len(values), duplicate_key_policy="error")
    yield from found
    for i, v in enumerate(values):
        for o in profiles(path, v):
            yield o | {"source_id": f"{o['source_id']}:document-{i}"} if len(values) > 1 else o


# Configurations known by their file names.
TOOL_CONFIGS = {"jest.config.json": "jest.config", "nest-cli.json": "nest.config", "playwright.config.json": "playwright.config"}
PROFILES = {
    "package.json": "package_json", "pyproject.toml": "python", "angular.json": "angular", "jest.config.json": "jest_config", "nest-cli.json": "nest_config",
    "playwright.config.json": "playwright_config",
}
#: Packages that tell of a framework.
FRAMEWORKS = {
    "@angular/core": "angular", "@nestjs/core": "nestjs", "@playwright/test": "playwright", "express": "express", "jest": "jest", "jquery": "jquery", "next": "next", "react": "react",
    "typescript": "typescript", "vue": "vue",
}


def profile_of(path: str, value: dict) -> str | None:
    """The kind of configuration that a document is, by its name or by what it declares."""
    name = path.rpartition("/")[2]
    if name in PROFILES:
        return PROFILES[name]
    if re.match(r"tsconfig.*\.json$", name):
        return "typescript_config"
    if name.endswith(".tf.json"):
        return "terraform_json"
    if value.get("openapi") or value.get("swagger"):
        return "openapi"
    if isinstance(value.get("databaseChangeLog"), list):
        return "liquibase"
    if isinstance(value.get("apiVersion"), str) and isinstance(value.get("kind"), str):
        return "argocd" if value["apiVersion"].startswith("argoproj.io/") else "kubernetes_json"
    return None


def profiles(path: str, value: object) -> Iterator[dict]:
    """Facts of well-known kinds of configuration, whatever the format they are written in."""
    if not isinstance(value, dict):
        return
    make = lambda kind, source, /, **kw: observation(kind, path, source, NAME, "extracted", **kw)
    known = profile_of(path, value)
    if known:
        yield make("ecosystem.config_profile", f"config-profile:{known}", name=known, profile=known, raw_profile_only=True)
    if tool := TOOL_CONFIGS.get(path.rpartition("/")[2]):
        yield make(tool, tool.replace(".", "-"), name=path.rpartition("/")[2], declared_sections=sorted(map(str, value)), raw_profile_only=True)
    if value.get("openapi") or value.get("swagger"):
        yield from openapi(path, value)
    meta = value.get("metadata") if isinstance(value.get("metadata"), dict) else {}
    if isinstance(value.get("apiVersion"), str) and isinstance(value.get("kind"), str):
        name = str(meta.get("name") or "unnamed")
        argo = value["apiVersion"].startswith("argoproj.io/")
        fields = {"api_version": value["apiVersion"], "resource_kind": value["kind"], "namespace": meta.get("namespace")}
        if argo and value["kind"] == "Application":
            source = (value.get("spec") or {}).get("source") if isinstance(value.get("spec"), dict) else None
            fields |= {"repo_url": redact_url(str(source["repoURL"])) if isinstance(source, dict) and source.get("repoURL") else None, "not_fetched": True}
        yield make("argocd.application" if argo and value["kind"] == "Application" else "kubernetes.resource", f"kubernetes:{value['kind']}:{name}", name=name, **fields)
    if isinstance(value.get("databaseChangeLog"), list):
        yield make("liquibase.changelog", "liquibase-changelog", name=path.rpartition("/")[2], executed=False)
        for i, c in enumerate(value["databaseChangeLog"]):
            if isinstance(c, dict) and isinstance(c.get("changeSet"), dict):
                yield make("liquibase.changeset", f"liquibase-changeset:{i}", name=str(c["changeSet"].get("id")), author=str(c["changeSet"].get("author")))
    for parts, v, _ in walk(value, [], True):
        if parts[-1] == "image" and isinstance(v, str) and re.fullmatch(r"[\w./:@-]+", v):
            yield make("docker.reference", f"docker-image:{pointer(parts)}", name=v, target=K.external("docker.image", v), not_fetched=True)
    if path.endswith("angular.json") and isinstance(value.get("projects"), dict):
        for n, p in value["projects"].items():
            yield make("angular.project", f"angular-project:{n}", name=n)
            targets = (p.get("architect") or p.get("targets") or {}) if isinstance(p, dict) else {}
            yield from (make("angular.target", f"angular-target:{n}:{t}", name=t, project=n) for t in targets)
    if re.match(r"tsconfig.*\.json$", path.rpartition("/")[2]):
        yield make("typescript.config", "typescript-config", name=path.rpartition("/")[2])
        base = value.get("extends")
        if isinstance(base, str):
            yield make("typescript.reference", "typescript-extends", name=base, target=reference_target(path, base)[0] if base.startswith(".") else K.external("js.package", base), reference_kind="extends")


def lines(path: str, content: str) -> Iterator[dict]:
    """JSON lines; bad lines are recovered from."""
    found, records, errors, kinds = [], [], [], set()
    for n, line in enumerate(content.splitlines(), 1):
        if not line.strip():
            continue
        try:
            value = json.loads(line)
        except ValueError as e:
            errors.append(_error(path, "jsonl", "malformed-jsonl-line", str(e), n, True))
            continue
        kinds.add(value_type(value))
        names = list(value) if isinstance(value, dict) else []
        records.append(observation("config.jsonl_record", path, f"jsonl-record:{n}", NAME, "extracted", line=n, format="jsonl", line_number=n, record_index=len(records), safe_keys=sorted(x for x in names if not secret_name(x)), redacted_keys=sorted(x for x in names if secret_name(x)), top_level_type=value_type(value)))
        found += members(path, value, "jsonl", "stdlib-json", False, line=n, suffix=f":record-{len(records) - 1}")
    kind = kinds.pop() if len(kinds) == 1 and not errors else "mixed-jsonl"
    yield _document(path, "jsonl", "stdlib-json", None, found, "heuristic" if errors else "extracted", record_count=len(records), parse_error_count=len(errors), top_level_type=kind)
    yield from [*records, *found, *errors]


def unsafe_xml(content: str) -> bool:
    return bool(re.search(r"(?i)<!doctype|<!entity", content)) or any(not m[1].lower().startswith("xml") for m in re.finditer(r"<\?([\w-]+)", content))


def xml(path: str, content: str) -> Iterator[dict]:
    plist = path.endswith(".plist")
    safe = re.sub(r"(?i)<!DOCTYPE plist[^>\[]*>", "", content) if plist else content
    if unsafe_xml(safe):
        yield _error(path, "plist-xml" if plist else "xml", "unsafe-xml", "DOCTYPE, ENTITY or processing instruction", family="config" if plist else "xml")
        return
    try:
        if plist:
            value = plistlib.loads(safe.encode())
            found = members(path, value, "plist-xml", "stdlib-elementtree-safe", True, safety_mode=SAFETY)
            yield _document(path, "plist-xml", "stdlib-elementtree-safe", value, found, safety_mode=SAFETY)
            yield from found
            return
        root = ElementTree.fromstring(safe.encode())
    except Exception as e:  # expat and plistlib raise many kinds for bad input
        yield _error(path, "plist-xml" if plist else "xml", "malformed-xml", str(e), family="config" if plist else "xml")
        return
    yield from _elements(path, root)


def _elements(path: str, root: ElementTree.Element) -> Iterator[dict]:
    make = lambda kind, source, /, **kw: observation(f"xml.{kind}", path, source, NAME, kw.pop("confidence", "extracted"), format="xml", parser="stdlib-elementtree-safe", safety_mode=SAFETY, **kw)
    local = lambda t: t.rpartition("}")[2]
    space = lambda t: t[1:].partition("}")[0] if t.startswith("{") else None
    out, refs, attributes = [], [], 0
    todo = [(root, f"/{local(root.tag)}")]
    while todo:
        e, p = todo.pop()
        key, kids, seen = K.within("xml.element", path, p), list(e), {}
        text = summary(e.text or "")
        hidden = secret_name(local(e.tag)) and text is not None
        out.append(make("element", f"xml-element:{p}", name=p, target=key, element_name=e.tag, local_name=local(e.tag), namespace_uri=space(e.tag), xml_pointer=p, attribute_count=len(e.attrib), child_count=len(kids),
                        identity_mode="pointer", text_summary=None if hidden else text, redacted=hidden, redaction_reason="secret-prone-key" if hidden else None))
        for a, v in e.attrib.items():
            attributes += 1
            secret = secret_name(local(a))
            target = K.key("xml.attribute", K.file_key(path), p, local(a))
            out.append(make("attribute", f"xml-attribute:{p}:{local(a)}", name=local(a), target=target, source_key=key, element_pointer=p, attribute_name=a, local_name=local(a), namespace_uri=space(a), value_type="string",
                            value_summary=None if secret else value_summary(v), redacted=secret, redaction_reason="secret-prone-key" if secret else None))
            if not secret and (found := _reference(path, [local(a)], v)):
                refs.append(make("reference", f"xml-reference:{p}:{local(a)}", confidence="heuristic", name=p, target=found[0], source_key=key, element_pointer=p, attribute_name=local(a), reference_kind=found[1], resolution_reason=found[2], raw_value_summary=value_summary(v), source_kind="attribute", redacted=False))
        for k in kids:
            n = seen[k.tag] = seen.get(k.tag, 0) + 1
            seen[k.tag] = n
        count: dict = {}
        placed = []
        for k in kids:
            count[k.tag] = count.get(k.tag, 0) + 1
            placed.append((k, f"{p}/{local(k.tag)}" + (f"[{count[k.tag]}]" if seen[k.tag] > 1 else "")))
        todo += reversed(placed)
    elements = sum(o["kind"] == "xml.element" for o in out)
    yield make("document", "xml-document", target=K.within("xml.document", path), root_tag=root.tag, root_local_name=local(root.tag), root_namespace_uri=space(root.tag), document_role=role(path), element_count=elements, attribute_count=attributes, reference_count=len(refs), parse_error_count=0)
    yield from out + refs


_REQUIREMENT = re.compile(r"^([A-Za-z0-9][\w.-]*)(?:\[([^\]]*)\])?\s*((?:[<>=!~]=?[^;#\s]+\s*,?\s*)*)(?:;\s*([^#]+))?")


def requirements(path: str, content: str) -> Iterator[dict]:
    make = lambda kind, source, line, /, **kw: observation(f"python.{kind}", path, source, NAME, "extracted", line=line, source_format="python-requirements", **kw)
    yield observation("python.package_file", path, "package-file", NAME, "extracted", file_family="requirements", source_format="python-requirements")
    flags = {"-r": "include_file", "--requirement": "include_file", "-c": "constraint_file", "--constraint": "constraint_file", "-e": "editable_local_path", "--editable": "editable_local_path", "-i": "index_url", "--index-url": "index_url", "--extra-index-url": "extra_index_url", "-f": "find_links", "--find-links": "find_links"}
    for n, raw in enumerate(content.splitlines(), 1):
        line = re.split(r"(?:^|\s)#", raw)[0].strip()
        if not line:
            continue
        word, _, rest = line.replace("=", " ", 1).partition(" ") if line.startswith("--") else line.partition(" ")
        if word in flags:
            target, _, _ = reference_target(path, rest.strip())
            yield make("reference", f"reference:{n}", n, name=redact_url(rest.strip()), target=target, reference_kind=flags[word], not_fetched=True)
            if redact_url(rest) != rest:
                yield make("redaction", f"redaction:{n}", n, redaction_reason="credentialed-index-url", not_fetched=True)
        elif re.match(r"(?i)(git\+|https?:)", line):
            kind = "vcs_url" if line.startswith("git+") else "direct_url"
            yield make("reference", f"reference:{n}", n, name=redact_url(line), target=K.key("external.url", redact_url(line)), reference_kind=kind, not_fetched=True)
        elif m := _REQUIREMENT.match(line):
            yield make("requirement", f"requirement:{n}:{m[1].lower()}", n, name=m[1], extras=[x.strip() for x in (m[2] or "").split(",") if x.strip()], version_constraint=m[3].strip() or None, marker=(m[4] or "").strip() or None, direct_url="@" in line or None)
        else:
            yield make("parse_error", f"parse-error:{n}", n, error_kind="malformed-requirement", recovered=True)


def pyproject(path: str, value: dict) -> Iterator[dict]:
    """What a pyproject.toml declares: project, dependencies and their groups, entry points, build system, tools."""
    make = lambda kind, source, /, **kw: observation(f"python.{kind}", path, source, NAME, "extracted", source_format="pyproject.toml", raw_profile_only=True, **kw)
    table = lambda of, name: of[name] if isinstance(of.get(name), dict) else {}
    plain = lambda v: value_summary(v) if isinstance(v, str) else None
    project, build = table(value, "project"), table(value, "build-system")

    def needed(items: object, group: str) -> Iterator[dict]:
        for i, item in enumerate(items if isinstance(items, list) else []):
            m = _REQUIREMENT.match(item.strip()) if isinstance(item, str) else None
            if m is None:
                yield make("parse_error", f"python-parse-error:{group}:{i}", error_kind="malformed-pyproject-dependency" if isinstance(item, str) else "unsupported-pyproject-dependency", recovered=True)
                continue
            direct = re.search(r"@\s*(\S+)", item)
            extras = [x.strip() for x in (m[2] or "").split(",") if x.strip()]
            yield make("requirement", f"requirement:{group}:{i}:{m[1].lower()}", name=m[1], dependency_group=group, extras=extras, version_constraint=m[3].strip() or None, marker=(m[4] or "").strip() or None, direct_url=bool(direct) or None)
            if direct:
                url = redact_url(direct[1])
                yield make("reference", f"reference:{group}:{i}", name=url, target=K.key("external.url", url), reference_kind="vcs_url" if url.startswith("git+") else "direct_url", not_fetched=True)

    if project:
        optional = table(project, "optional-dependencies")
        yield make(
            "pyproject", "python-pyproject", name=plain(project.get("name")) or "pyproject.toml", project_name=plain(project.get("name")), project_version=plain(project.get("version")),
            dependency_count=len(project["dependencies"]) if isinstance(project.get("dependencies"), list) else 0, dynamic_metadata=[x for x in project.get("dynamic") or [] if isinstance(x, str)] or None,
            optional_dependency_groups=sorted(optional) or None,
        )
        yield from needed(project.get("dependencies"), "project.dependencies")
        for group in sorted(optional):
            where = f"project.optional-dependencies.{group}"
            yield make("dependency_group", f"python-dependency-group:{group}", name=group, dependency_group=where, optional_group=group, dependency_count=len(optional[group]) if isinstance(optional[group], list) else 0)
            yield from needed(optional[group], where)
        named = {f"project.{n}": table(project, n) for n in ("scripts", "gui-scripts")} | {f"project.entry-points.{n}": table(table(project, "entry-points"), n) for n in sorted(table(project, "entry-points"))}
        for group, points in named.items():
            for n in sorted(points):
                yield make("entry_point", f"python-entry-point:{group}:{n}", name=n, entry_point_group=group, entry_point_name=n, entry_point_target=plain(points[n]))
    if build:
        yield make("build_system", "python-build-system", name=plain(build.get("build-backend")) or "build-system", build_backend=plain(build.get("build-backend")), requires_count=len(build["requires"]) if isinstance(build.get("requires"), list) else 0)
        yield from needed(build.get("requires"), "build-system.requires")
    for n in sorted(table(value, "tool")):
        yield make("tool_config", f"python-tool-config:{n}", name=n, tool_name=n, tool_section=f"tool.{n}")
    for group in sorted(table(value, "dependency-groups")):
        yield from needed(value["dependency-groups"][group], f"dependency-groups.{group}")


_TF_JSON = {"provider": "provider", "variable": "variable", "output": "output", "module": "module", "resource": "resource", "data": "data_source", "check": "check"}


def terraform_json(path: str, value: dict) -> Iterator[dict]:
    """Terraform written as JSON: the same facts as of its own language."""
    make = lambda kind, source, /, **kw: observation(f"terraform.{kind}", path, source, NAME, "extracted", profile="terraform_json", **kw)
    table = lambda of, name: of[name] if isinstance(of.get(name), dict) else {}
    yield make("file", "terraform-file", file_family="tf", variant="tf.json", declared_sections=sorted(map(str, value)))
    own = table(value, "terraform")
    if isinstance(own.get("required_version"), str):
        yield make("required_version", "terraform-required-version", version_constraint=own["required_version"])
    for n, p in sorted(table(own, "required_providers").items()):
        yield from provider(make, path, n, p if isinstance(p, dict) else {"version": p}, None)
    for n in sorted(table(own, "backend")):
        yield make("backend", f"terraform-backend:{n}", name=n, backend_type=n)
    for n in sorted(table(value, "locals")):
        yield make("local", f"terraform-local:{n}", name=n, redacted=secret_name(n) or None)
    for block, kind in _TF_JSON.items():
        for a, body in sorted(table(value, block).items()):
            labels = [[a, b] for b in sorted(body)] if block in ("resource", "data") and isinstance(body, dict) else [[a]]
            for label in labels:
                yield make(kind, f"terraform-{block}:{'.'.join(label)}", name=".".join(label), block_type=block, labels=label)
            if block == "module" and isinstance(body, dict) and isinstance(body.get("source"), str):
                yield module_source(make, path, body["source"], f"terraform-reference:{a}", None)


def provider(make, path: str, name: str, fields: dict, line: int | None) -> Iterator[dict]:
    """A required provider, and the registry address that it names."""
    text = lambda n: fields[n] if isinstance(fields.get(n), str) else None
    yield make("required_provider", f"terraform-required-provider:{name}", line=line, name=name, provider_source=text("source"), version_constraint=text("version"))
    if text("source"):
        yield make("reference", f"terraform-provider-source:{name}", line=line, name=fields["source"], target=K.external("terraform.provider", fields["source"]), reference_kind="provider_source", not_fetched=True)


def module_source(make, path: str, value: str, source: str, line: int | None) -> dict:
    local = value.startswith(".")
    target = reference_target(path, value)[0] if local else K.external("terraform.module", redact_url(value))
    return make("reference", source, line=line, name=redact_url(value), target=target, reference_kind="module_source_local" if local else "module_source", not_fetched=not local)


def npm(path: str, value: dict) -> Iterator[dict]:
    make = lambda kind, source, /, **kw: observation(f"npm.{kind}", path, source, NAME, "extracted", format="json", **kw)
    yield make("package", "npm-package", name=value.get("name"), package_version=value.get("version"), private=value.get("private"), module_type=value.get("type"))
    for group in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies"):
        for n, v in (value.get(group) or {}).items() if isinstance(value.get(group), dict) else ():
            yield make("dependency", f"npm-dependency:{group}:{n}", name=n, dependency_group=group, version_constraint=redact_url(str(v)))
            if n in FRAMEWORKS:
                yield observation("ecosystem.framework_hint", path, f"framework-hint:{group}:{n}", NAME, "extracted", name=FRAMEWORKS[n], framework=FRAMEWORKS[n], package_name=n, dependency_group=group)
    for n, v in (value.get("scripts") or {}).items() if isinstance(value.get("scripts"), dict) else ():
        yield make("script", f"npm-script:{n}", name=n, command_summary=value_summary(str(v)), executed=False)


#: Paths of a document that are described one by one; a diagnostic tells of more.
MOST_PATHS = 128
_VERBS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")


def openapi(path: str, value: dict) -> Iterator[dict]:
    make = lambda kind, source, /, **kw: observation(f"openapi.{kind}", path, source, NAME, "extracted", **kw)
    yield make("document", "openapi-document", spec_family="openapi3" if value.get("openapi") else "swagger2", spec_version=str(value.get("openapi") or value.get("swagger")))
    info = value.get("info") if isinstance(value.get("info"), dict) else {}
    yield make("info", "openapi-info", name=info.get("title"), api_version=info.get("version"))
    for i, s in enumerate(value.get("servers") or []):
        if isinstance(s, dict) and isinstance(s.get("url"), str):
            yield make("server", f"openapi-server:{i}", name=redact_url(s["url"]), not_fetched=True)
    if isinstance(value.get("paths"), dict) and len(value["paths"]) > MOST_PATHS:
        yield make("parse_error", "openapi-parse-error:path-limit", error_kind="openapi-path-limit", path_count=len(value["paths"]), kept=MOST_PATHS, recovered=True)
    for where, item in list((value.get("paths") or {}).items())[:MOST_PATHS]:
        yield make("path", f"openapi-path:{where}", name=where, path_template=where)
        for verb in _VERBS if isinstance(item, dict) else ():
            op = item.get(verb)
            if not isinstance(op, dict):
                continue
            at = f"{verb}:{where}"
            yield make("operation", f"openapi-operation:{at}", name=op.get("operationId") or at, method=verb.upper(), path_template=where, tags=op.get("tags"))
            for p in op.get("parameters") or []:
                if isinstance(p, dict) and p.get("name"):
                    yield make("parameter", f"openapi-parameter:{at}:{p['name']}", name=p["name"], location=p.get("in"), required=p.get("required"))
            if "requestBody" in op:
                yield make("request_body", f"openapi-request-body:{at}", media_types=sorted((op["requestBody"].get("content") or {}) if isinstance(op["requestBody"], dict) else []))
            for status in op.get("responses") or {}:
                yield make("response", f"openapi-response:{at}:{status}", name=str(status), status_code=str(status))
    parts = value.get("components") if isinstance(value.get("components"), dict) else {"schemas": value.get("definitions") or {}}
    for group, items in parts.items():
        for n in items if isinstance(items, dict) else ():
            kind = {"schemas": "schema", "securitySchemes": "security_scheme"}.get(group, "component")
            yield make(kind, f"openapi-{group}:{n}", name=n, component_group=group)
    for t in value.get("tags") or []:
        if isinstance(t, dict) and t.get("name"):
            yield make("tag", f"openapi-tag:{t['name']}", name=t["name"])
    for parts_, v, _ in walk(value, [], False):
        if parts_[-1] in ("example", "examples", "default"):
            yield make("example", f"openapi-example:{pointer(parts_)}", name=pointer(parts_), value_type=value_type(v), example_kind=parts_[-1], redacted=True)
            yield make("redaction", f"openapi-redaction:{pointer(parts_)}", name=pointer(parts_), redaction_reason="openapi-example-summary-only")
        if parts_[-1] == "$ref" and isinstance(v, str):
            scope = "internal" if v.startswith("#") else "remote" if re.match(r"(?i)https?:", v) else "local_file"
            yield make("reference", f"openapi-reference:{pointer(parts_)}", name=redact_url(v), reference_scope=scope, not_fetched=scope != "internal")


#: Blocks of a file that are described; a diagnostic tells of more.
MOST_BLOCKS = 256
_HCL_KINDS = {"provider": "provider", "resource": "resource", "data": "data_source", "module": "module", "variable": "variable", "output": "output", "moved": "moved", "import": "import", "check": "check", "removed": "removed"}


def hcl(path: str, content: str, most_blocks: int = MOST_BLOCKS) -> Iterator[dict]:
    """Terraform: top-level blocks with their labels; tfvars without values."""
    make = lambda kind, source, /, **kw: observation(f"terraform.{kind}", path, source, NAME, kw.pop("confidence", "heuristic"), **kw)
    root, balanced = parse_hcl(content)
    line = lambda at: content.count("\n", 0, at) + 1
    if path.endswith(".tfvars"):
        yield make("file", "terraform-file", confidence="extracted", file_family="tfvars")
        for a in root.attributes:
            yield make("variable", f"tfvars:{a.name}", line=line(a.at), name=a.name, profile="terraform_tfvars", redacted=True)
            yield make("redaction", f"tfvars-redaction:{a.name}", line=line(a.at), name=a.name, redaction_reason="tfvars-sensitive-by-default")
        return
    yield make("file", "terraform-file", confidence="extracted", file_family="tf")
    if not balanced:
        yield make("parse_error", "terraform-parse-error", confidence="unknown", error_kind="unbalanced-braces", recovered=True)
    for n, b in enumerate(root.blocks):
        if n >= most_blocks:
            yield make("parse_error", "terraform-parse-error:block-limit", confidence="unknown", error_kind="terraform-block-limit", recovered=True)
            break
        yield make(_HCL_KINDS.get(b.type) or "block", f"terraform-{b.type}:{'.'.join(b.labels) or n}", line=line(b.at), name=".".join(b.labels) or b.type, block_type=b.type, labels=b.labels)
        if b.type == "terraform":
            yield from _settings(make, path, b, line)
        for a in b.attributes if b.type == "locals" else ():
            yield make("local", f"terraform-local:{a.name}", line=line(a.at), name=a.name, redacted=secret_name(a.name) or None)
        for a in b.strings():
            at = line(a.at)
            if secret_name(a.name):
                yield make("redaction", f"terraform-redaction:{at}:{a.name}", line=at, field_name=a.name, redaction_reason="secret-prone-terraform-attribute")
            elif b.type == "module" and a.name == "source" and a in b.attributes:
                yield module_source(make, path, a.text, f"terraform-reference:{at}", at)


def _settings(make, path: str, block: Block, line) -> Iterator[dict]:
    """The inside of a `terraform` block: the version asked for, providers and the backend."""
    if (a := block.attribute("required_version")) and a.text is not None:
        yield make("required_version", "terraform-required-version", line=line(a.at), version_constraint=a.text)
    for b in block.blocks:
        if b.type == "backend" and b.labels:
            yield make("backend", f"terraform-backend:{b.labels[0]}", line=line(b.at), name=b.labels[0], backend_type=b.labels[0])
        for p in b.attributes if b.type == "required_providers" else ():
            fields = {f.name: f.text for f in p.fields.values() if f.text is not None} if p.text is None else {"version": p.text}
            yield from provider(make, path, p.name, fields, line(p.at))


def extract(path: str, content: str, context: Context) -> Iterator[dict]:
    name = path.rpartition("/")[2]
    suffix = name.rpartition(".")[2].lower()
    if re.match(r"(requirements(-[\w.-]+)?|dev-requirements|test-requirements)\.txt$", name):
        yield from requirements(path, content)
    elif suffix in ("json", "jsonc", "toml"):
        yield from structured(path, content, suffix)
    elif suffix == "jsonl":
        yield from lines(path, content)
    elif suffix in ("yaml", "yml"):
        yield from yaml(path, content)
    elif suffix in ("plist", "xml"):
        yield from xml(path, content)
    elif suffix in ("tf", "tfvars"):
        yield from hcl(path, content)
