"""JavaScript and TypeScript: imports, exports, definitions, routes, tests and frameworks.

Patterns look at masked text (js_lexer), so nothing is found in strings, comments, templates, regular expressions or the text of
elements; what a string says is read from the same place of the original. Scopes tell which class a method belongs to and which
suite a test."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from cairngraph.functions import keys as K
from cairngraph.operators.base import Context, observation, redact_url, resolve
from cairngraph.operators.js_lexer import masked, scopes

NAME = "cairn-javascript"
MOST_BYTES, MOST_OF_KIND = 512 << 10, 100
#: Kinds that MOST_OF_KIND holds for: what frameworks add. Imports, exports and definitions have no limit.
FRAMEWORK = ("express.", "jest.", "jquery.", "js.framework_reference", "nest.", "next.", "node.")
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts", ".json")
_FROM = re.compile(
    r"^[ \t]*(import|export)\b(?:\s+type\b)?((?:(?!\b(?:import|export|const|let|var|class|function)\b)[\w$*{},\s])*?)\bfrom\s*(['\"])( +)\3|^[ \t]*import\s*(['\"])( +)\5", re.M
)
_REQUIRE = re.compile(r"\brequire\(\s*(?:(['\"])([^'\"]+)\1|([^)]*))\)")
_DYNAMIC = re.compile(r"\bimport\(\s*(?:(['\"])([^'\"]+)\1|([^)]*))\)")
_TEST = re.compile(r"^\s*(describe|it|test)(?:\.\w+)?\(\s*(['\"`])(.*?)\2")
_METHOD = re.compile(r"\s*(?:(?:static|async|public|private|protected|override|get|set)\s+|\*\s*)*(#?[\w$]+)\s*(?:<[^>(]*>)?\(")
_NO_METHOD = frozenset("if for while switch catch function return super new await typeof throw".split())
_FETCH = re.compile(r"\b(fetch|axios\.get)\s*\(\s*(['\"])( +)\2")
_SCRIPTS = re.compile(r"\bimportScripts\s*\(\s*(['\"])( +)\1")
_ELEMENT_ROUTE = re.compile(r"<Route\b[^>]*?\bpath\s*=\s*(['\"])( +)\1")
_OBJECT_ROUTE = re.compile(r"\bpath\s*:\s*(['\"])( +)\1")
_TEMPLATE_URL = re.compile(r"\b(templateUrl|styleUrls?)\s*:\s*(?:\[\s*)?(['\"])( +)\2")
_NEXT_METHOD = re.compile(r"\s*export\s+(?:async\s+)?function\s+(GET|POST|PUT|PATCH|DELETE|OPTIONS|HEAD)\s*\(")
_EXPRESS = re.compile(r"\b(\w+)\.(get|post|put|patch|delete|options|head|all)\(\s*(['\"`])([^'\"`]*)\3")
_NEST = re.compile(r"^\s*@(Get|Post|Put|Patch|Delete|Options|Head|All|Controller|Module|Injectable)\(\s*(?:['\"]([^'\"]*)['\"])?")


def specifier(path: str, value: str, context: Context) -> tuple[str, str]:
    """(key, reason): local files by probing extensions and index files, packages, urls."""
    if re.match(r"(?i)https?:", value):
        return K.key("external.url", redact_url(value)), "external-url"
    if not value.startswith((".", "/")):
        return K.external("js.package", "/".join(value.split("/")[: 2 if value.startswith("@") else 1])), "package"
    inside = resolve(path, value)
    if inside is None:
        return K.unknown("file", "repo-escaping-import"), "repo-escaping"
    tried = [inside, *(inside + e for e in EXTENSIONS), *(re.sub(r"\.[mc]?js$", e, inside) for e in (".ts", ".tsx", ".mts", ".cts")), *(f"{inside}/index{e}" for e in EXTENSIONS)]
    found = next((t for t in tried if t in context.paths), None)
    return (K.file_key(found), "local-file") if found else (K.unknown("file", "missing-import"), "missing-file")


def profile(path: str, content: str) -> str:
    name = path.rpartition("/")[2]
    checks = (
        ("next", re.search(r"(^|/)(pages|app)/", path) and re.search(r"next/|getServerSideProps|NextResponse", content)), ("jest", re.search(r"\.(test|spec)\.", name)), ("nestjs", "@nestjs/" in content),
        ("jquery", re.search(r"\bjQuery\b|\$\(\s*['\"(d]", content)), ("express", re.search(r"['\"]express['\"]", content)), ("node", content.startswith("#!") and "node" in content.split("\n", 1)[0]),
        ("angular", "@angular/" in content), ("react", re.search(r"['\"]react['\"]", content)), ("vue", re.search(r"['\"]vue['\"]", content)), ("config", ".config." in name), ("frontend_asset", path.startswith("public/")),
    )
    return next((p for p, hit in checks if hit), "typescript" if re.search(r"\.[mc]?tsx?$", name) else "javascript")


def module_system(content: str) -> str:
    esm, cjs = bool(re.search(r"(?m)^\s*(import|export)\b", content)), bool(re.search(r"\brequire\(|module\.exports|\bexports\.", content))
    return "mixed" if esm and cjs else "esm" if esm else "commonjs" if cjs else "script"


def next_route(path: str) -> tuple[str, str] | None:
    """(kind, route) of a Next.js file."""
    m = re.search(r"(?:^|/)(pages|app)/(.*)\.[mc]?[jt]sx?$", path)
    if not m:
        return None
    parts = m[2].split("/")
    if m[1] == "app":
        if parts[-1] not in ("page", "route"):
            return None
        where = [p for p in parts[:-1] if not p.startswith(("(", "@"))]
        return ("page" if parts[-1] == "page" else "app_route"), "/" + "/".join(where)
    if parts[-1].startswith("_"):
        return None
    where = parts[:-1] if parts[-1] == "index" else parts
    return ("api_route" if parts[0] == "api" else "page"), "/" + "/".join(where)


def extract(path: str, content: str, context: Context) -> Iterator[dict]:
    small = len(content) <= MOST_BYTES
    mask = masked(content, not re.search(r"\.[mc]?ts$", path)) if small else ""
    prof, system = profile(path, content), module_system(mask)
    module = K.within("js.module", path)
    seen: Counter = Counter()
    make = lambda kind, source, n, /, **kw: observation(kind, path, source, NAME, kw.pop("confidence", "heuristic"), line=n, format="javascript", profile=prof, parser="lexical", **kw)
    if not small:
        yield make("js.parse_error", "js-parse-error:size", None, confidence="unknown", error_kind="file-size-limit", recovered=False)
        return
    yield make("js.file", "js-file", None, target=K.within("js.file", path), module_system=system, confidence="extracted")
    yield make("js.module", "js-module", None, target=module, source_key=K.within("js.file", path), module_system=system)
    limited = False
    for o in _facts(make, path, content, mask, context, module, prof):
        seen[o["kind"]] += 1
        if not o["kind"].startswith(FRAMEWORK) or seen[o["kind"]] <= MOST_OF_KIND:
            yield o
        elif not limited:
            limited = True
            yield make("js.parse_error", "js-parse-error:limit", None, confidence="unknown", error_kind="framework-observation-limit", recovered=True)


# jQuery's own methods, which are no plugins.
_JQUERY_EVENTS = "on one click dblclick change submit ready keyup keydown keypress mouseenter mouseleave focus blur scroll resize hover"
_JQUERY_OWN = frozenset((
    _JQUERY_EVENTS + " addClass after ajax animate append appendTo attr before children closest contents css data delay detach each empty end eq fadeIn fadeOut filter find first get getJSON has height"
    " hide html index insertAfter insertBefore is last length load map next not off offset outerHeight outerWidth parent parents position prepend prev prop remove removeAttr removeClass replaceWith"
    " scrollTop serialize show siblings slice slideDown slideToggle slideUp stop text toggle toggleClass trigger unbind val width wrap"
).split())


def _jquery(make, path: str, line: str, raw: str, n: int, context: Context) -> Iterator[dict]:
    """Selectors, events, requests and plugins of a masked line; each also as a fact of the document that it touches."""
    said = lambda m, g: raw[m.start(g) : m.end(g)] if m[g] else None

    def both(kind: str, generic: str, at: object, /, **kw: object) -> Iterator[dict]:
        yield make(f"jquery.{kind}", f"jquery-{kind}:{n}:{at}", n, **kw)
        yield make(f"js.{generic}", f"js-{generic}:{n}:{at}", n, framework="jquery", **kw)

    for m in re.finditer(r"(?:\$|jQuery)\(\s*(['\"])([^'\"]+)\1", line):
        yield from both("selector", "dom_selector", m.start(), name=said(m, 2)[:120])
    for m in re.finditer(rf"\.({_JQUERY_EVENTS.replace(' ', '|')})\(\s*(?:(['\"])([^'\"]+)\2)?", line):
        event = said(m, 3) if m[1] in ("on", "one") and m[3] else m[1]
        yield from both("event", "dom_event", m.start(), name=event, event_name=event, event_method=m[1])
    for m in re.finditer(r"(?:\$|jQuery)\.(ajax|get|post|getJSON)\(\s*(?:(['\"])([^'\"]+)\2|\{.*?\burl\s*:\s*(['\"])([^'\"]+)\4)?", line):
        url = said(m, 3) or said(m, 5)
        target, reason = specifier(path, url, context) if url else (K.dynamic("js.reference", "computed-url"), "dynamic")
        yield from both("ajax", "ajax_reference", m.start(), name=m[1], target=target, ajax_method=m[1], url_summary=redact_url(url)[:160] if url else None, resolution_reason=reason, not_fetched=True)
    for m in re.finditer(r"(?:\$|jQuery)\([^)]*\)\.(\w+)\(|(?:\$|jQuery)\.fn\.(\w+)\s*=", line):
        if (m[1] or m[2]) not in _JQUERY_OWN:
            yield make("jquery.plugin_reference", f"jquery-plugin:{n}:{m.start()}", n, name=m[1] or m[2], plugin_name=m[1] or m[2], not_executed=True)


def _modules(make, path: str, content: str, mask: str, context: Context, module: str, seen: set[int]) -> Iterator[dict]:
    """Imports and re-exports, over as many lines as they take; seen: gets their lines."""
    for m in _FROM.finditer(mask):
        group = 4 if m[3] else 6
        value, n = content[m.start(group) : m.end(group)], mask.count("\n", 0, m.start()) + 1
        seen.update(range(n, n + m[0].count("\n") + 1))
        kind = "export" if m[1] == "export" else "import"
        target, reason = specifier(path, value, context)
        facts = {"raw_value_summary": redact_url(value), "reference_kind": "module", "resolution_reason": reason, f"{kind}_kind": "re-export" if kind == "export" else "static"}
        yield make(f"js.{kind}", f"js-{kind}:{n}:{value}", n, name=value, target=target, source_key=module, **facts)
        yield make("js.reference", f"js-reference:{n}:{value}", n, name=value, target=target, source_key=module, not_fetched=True, **facts)


def _facts(make, path: str, content: str, mask: str, context: Context, module: str, prof: str) -> Iterator[dict]:
    suites: list[tuple[int, str]] = []  # how deep each open suite was named, and its key
    if found := next_route(path) if prof == "next" else None:
        yield make(f"next.{found[0]}", "next-route", None, name=found[1], route_pattern=found[1])
        yield make("js.route", f"js-route:{found[1]}", None, name=found[1], target=K.key("js.route", module, found[1]), source_key=module, route_pattern=found[1])
    modules: set[int] = set()
    imports = list(_modules(make, path, content, mask, context, module, modules))
    open_scopes, original = scopes(mask), content.split("\n")
    for n, line in enumerate(mask.split("\n"), 1):
        while imports and imports[0]["start_line"] == n:
            yield imports.pop(0)
        if not line.strip():
            continue
        raw, scope = original[n - 1], open_scopes[n - 1]
        said = lambda m, g: raw[m.start(g) : m.end(g)] if m[g] is not None else None  # noqa: B023, E731
        inside = scope[-1] if scope else ("module", None)
        while suites and suites[-1][0] >= len(scope):
            suites.pop()
        suite = suites[-1][1] if suites else None
        for pattern, what in ((_REQUIRE, "require"), (_DYNAMIC, "dynamic-import")):
            for m in pattern.finditer(line):
                value = said(m, 2)
                target, reason = specifier(path, value, context) if value else (K.dynamic("js.import", "computed-specifier"), "dynamic")
                facts = {"import_kind": what, "resolution_reason": reason, "dynamic": not value, "reference_kind": "module"}
                for kind in ("import", "reference"):
                    yield make(f"js.{kind}", f"js-{kind}-{what}:{n}:{value or 'dynamic'}", n, name=value or what, target=target, source_key=module, **facts)
                if what == "require" and prof in ("node", "express"):
                    yield make("node.require", f"node-require:{n}", n, name=value)
        if (m := re.match(r"\s*export\s+(default\s+)?(?:async\s+)?(function\*?|class|const|let|var|interface|type|enum)?\s*([\w$]+)?", line)) and n not in modules:
            name = m[3] or "default"
            yield make("js.export", f"js-export:{n}:{name}", n, name=name, target=K.key("js.variable", module, name), source_key=module, export_kind="default" if m[1] else "named")
        for m in re.finditer(r"\bmodule\.exports\s*=(?!=)|(?<!module\.)\bexports\.([\w$]+)\s*=(?!=)", line):
            yield make("node.export", f"node-export:{n}:{m[1] or 'module'}", n, name=m[1] or "module.exports", source_key=module, export_kind="exports.name" if m[1] else "module.exports", exported_name=m[1], module_system="commonjs")
        if m := re.match(r"\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\*?\s+([\w$]+)", line):
            kind = "component" if prof == "react" and m[1][0].isupper() else "function"
            yield make(f"js.{kind}", f"js-{kind}:{m[1]}:{n}", n, name=m[1], target=K.key(f"js.{kind}", module, m[1]), source_key=module, **{f"{kind}_name": m[1]})
        elif m := re.match(r"\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([\w$]+)(?:\s*<[^{]*?>)?(?:\s+extends\s+([\w$.]+))?", line):
            yield make("js.class", f"js-class:{m[1]}:{n}", n, name=m[1], target=K.key("js.class", module, m[1]), source_key=module, class_name=m[1], superclass=m[2])
            if m[2] in ("Component", "PureComponent", "React.Component", "React.PureComponent"):
                yield make("js.component", f"js-component:{m[1]}:{n}", n, name=m[1], target=K.key("js.component", module, m[1]), source_key=module, component_name=m[1])
        elif m := re.match(r"\s*(?:export\s+)?(interface|enum|type)\s+([\w$]+)", line):
            yield make({"interface": "js.interface", "enum": "js.enum", "type": "js.type_alias"}[m[1]], f"js-{m[1]}:{m[2]}:{n}", n, name=m[2])
        elif m := re.match(r"(?:export\s+)?(?:const|let|var)\s+([\w$]+)\s*(?::[^=]+)?=\s*(async\s*)?(\(|function\b|[\w$]+\s*=>)?", line):
            if m[3] and ("=>" in line or "function" in line):
                kind = "component" if prof == "react" and m[1][0].isupper() else "function"
            else:
                kind = "variable"
            yield make(f"js.{kind}", f"js-{kind}:{m[1]}:{n}", n, name=m[1], target=K.key(f"js.{kind}", module, m[1]), source_key=module, **{"local_name" if kind == "variable" else f"{kind}_name": m[1]})
        elif inside[0] == "class" and inside[1] and (m := _METHOD.match(line)) and m[1] not in _NO_METHOD and ("{" in line[m.end() :] or not line.rstrip().endswith(";")):
            owner = inside[1]
            yield make("js.method", f"js-method:{owner}.{m[1]}:{n}", n, name=m[1], target=K.key("js.method", K.key("js.class", module, owner), m[1]), source_key=module, class_name=owner, method_name=m[1])
        if m := _TEST.match(line):
            name = said(m, 3)
            if m[1] == "describe":
                key = K.key("js.test_suite", module, name or "suite")
                yield make("js.test_suite", f"js-suite:{n}", n, name=name, target=key, source_key=suite or module, test_framework="jest")
                yield make("jest.suite", f"jest-suite:{n}", n, name=name)
                suites.append((len(scope), key))
            else:
                yield make("js.test_case", f"js-test:{n}", n, name=name, target=K.key("js.test_case", suite or module, name or "test"), source_key=suite or module, test_framework="jest")
                yield make("jest.test", f"jest-test:{n}", n, name=name)
        if k := len(re.findall(r"\bexpect\(", line)):
            yield make("js.test_expectation", f"js-expect:{n}", n, expectation_count=k)
            matchers = re.findall(r"\)\s*(?:\.not)?\.(to\w+)\(", line)
            yield make("jest.expectation", f"jest-expect:{n}", n, name="expect", expectation_count=k, matchers=matchers, test_framework="jest", source_key=suite or module)
        for i, m in enumerate(re.finditer(r"\b(?:jest|vi)\.(mock|fn|spyOn)\(", line)):
            yield make("jest.mock", f"jest-mock:{n}:{i}", n, name=m[1], mock_kind=m[1], test_framework="jest")
        for m in _FETCH.finditer(line):
            target, reason = specifier(path, said(m, 3), context)
            if target.startswith("external.url:"):
                yield make("js.reference", f"js-fetch:{n}:{m.start()}", n, name=m[1], target=target, source_key=module, reference_kind=m[1], raw_value_summary=redact_url(said(m, 3)), resolution_reason=reason, not_fetched=True)
        for m in _SCRIPTS.finditer(line):
            target, reason = specifier(path, said(m, 2), context)
            yield make("js.reference", f"js-scripts:{n}:{m.start()}", n, name="importScripts", target=target, source_key=module, reference_kind="importScripts", raw_value_summary=redact_url(said(m, 2)), resolution_reason=reason, not_fetched=True)
        for m in _TEMPLATE_URL.finditer(line) if prof == "angular" else ():
            target, reason = specifier(path, said(m, 3), context)
            yield make("js.reference", f"js-template:{n}:{m.start()}", n, name=m[1], target=target, source_key=module, reference_kind=m[1], raw_value_summary=redact_url(said(m, 3)), resolution_reason=reason)
        routes = [said(m, 2) for p in (_ELEMENT_ROUTE, _OBJECT_ROUTE) if prof == "react" or p is _OBJECT_ROUTE and prof in ("angular", "vue") for m in p.finditer(line)]
        for i, route in enumerate(r for r in routes if "${" not in r):
            yield make("js.route", f"js-route:{n}:{i}", n, name=route, target=K.key("js.route", module, route), source_key=module, route_pattern=route, route_framework=prof)
        if found and found[0] == "app_route" and (m := _NEXT_METHOD.match(line)):
            yield make("next.route", f"next-route:{n}:{m[1]}", n, name=f"{m[1]} {found[1]}", http_method=m[1], route_method=m[1], route_pattern=found[1])
            yield make("js.route", f"js-route:{n}:{m[1]}", n, name=f"{m[1]} {found[1]}", target=K.key("js.route", module, f"{m[1]} {found[1]}"), source_key=module, route_method=m[1], route_pattern=found[1])
        if prof == "express":
            for m in _EXPRESS.finditer(line):
                where = said(m, 4)
                yield make("express.route", f"express-route:{n}:{m[2]}", n, name=f"{m[2].upper()} {where}", route_method=m[2].upper(), route_pattern=where, receiver=m[1])
                yield make("js.route", f"js-route:{n}:{m[2]}", n, name=f"{m[2].upper()} {where}", target=K.key("js.route", module, f"{m[2].upper()} {where}"), source_key=module, route_method=m[2].upper(), route_pattern=where)
            if m := re.search(r"(\w+)\s*=\s*express(\.Router)?\(\)", line):
                yield make("express.router" if m[2] else "express.app", f"express-app:{n}", n, name=m[1])
            if m := re.search(r"\b(\w+)\.use\((.*)$", line):
                yield make("express.middleware", f"express-middleware:{n}", n)
                if re.search(r"(?:function\s*\w*\s*)?\(?\s*(?:err|error)\s*,\s*\w+\s*,\s*\w+\s*,\s*\w+\s*\)", m[2]) or re.search(r"\b\w*[eE]rror\w*[hH]andler\b", m[2]):
                    yield make("express.error_handler", f"express-error-handler:{n}", n, name="use", receiver=m[1])
        for i, m in enumerate(re.finditer(r"@(\w+)\(([^)]*)\)", line) if prof == "nestjs" else ()):
            yield make("nest.decorator", f"nest-decorator:{n}:{i}", n, name=m[1], decorator_name=m[1], decorator_args_summary=said(m, 2).strip()[:160] or None)
        if prof == "nestjs" and (m := _NEST.match(line)):
            kind = {"Controller": "controller", "Module": "module", "Injectable": "provider"}.get(m[1], "route")
            where = said(m, 2)
            yield make(f"nest.{kind}", f"nest-{kind}:{n}", n, name=where or m[1], route_pattern=where, route_method=m[1].upper() if kind == "route" else None)
        if prof == "jquery":
            yield from _jquery(make, path, line, raw, n, context)
        if prof == "react" and (m := re.search(r"\b(use[A-Z]\w*)\(", line)):
            yield make("js.hook", f"js-hook:{n}:{m[1]}", n, name=m[1])
        for name in dict.fromkeys(re.findall(r"\b(?:process|import\.meta)\.env\.(\w+)", line)):
            yield make("js.framework_reference", f"js-env:{n}:{name}", n, name=name, reference_kind="environment")
    if m := re.search(r"//[#@]\s*sourceMappingURL=(\S+)", content):
        data = m[1].startswith("data:")
        target = K.unknown("js.reference", "data-url-redacted") if data else specifier(path, m[1] if m[1].startswith((".", "/", "http")) else "./" + m[1], context)[0]
        yield make("js.reference", "js-source-map", content.count("\n", 0, m.start()) + 1, name="source-map", target=target, source_key=module, reference_kind="source_map", not_fetched=True)
