"""Python sources by their syntax tree (parsed, never run): modules, imports, classes, functions, methods,
tests and web routes."""

from __future__ import annotations

import ast
from collections.abc import Iterator

from cairngraph.functions import keys as K
from cairngraph.operators.base import Context, observation, secret_name

NAME = "cairn-python"
ROOTS = ("src/main/python", "src/test/python", "src/test/unit/python", "src/test/int/python", "src")
MOST = 512
_HTTP = frozenset("get post put delete patch head options route websocket".split())


def module_of(path: str, roots: tuple[str, ...] = ROOTS) -> tuple[str, str | None]:
    """(module, the root it is in): `__init__` names its package."""
    root = next((r for r in roots if path.startswith(r + "/")), None)
    inner = path[len(root) + 1 :] if root else path
    parts = inner.removesuffix(".py").split("/")
    if parts[-1] == "__init__" and len(parts) > 1:
        parts.pop()
    return ".".join(parts), root


def import_candidates(module: str, is_package: bool, node: ast.Import | ast.ImportFrom) -> list[tuple[list[str], int, str, str | None]]:
    """For each imported name: modules to try in order, the level, the name and its alias."""
    if isinstance(node, ast.Import):
        return [([a.name], 0, a.name, a.asname) for a in node.names]
    base = node.module or ""
    if node.level:
        parts = module.split(".") if is_package else module.split(".")[:-1]
        up = node.level - 1
        parts = parts[: len(parts) - up] if up <= len(parts) else []
        base = ".".join([*parts, *([node.module] if node.module else [])])
    return [([f"{base}.{a.name}" if base else a.name, base], node.level, a.name, a.asname) for a in node.names]


def _decorators(node: ast.AST) -> list[str]:
    return [ast.unparse(d)[:120] for d in getattr(node, "decorator_list", [])]


def _routes(node: ast.AST) -> Iterator[tuple[str, str, str | None, int]]:
    """(receiver, verb, path, line) of decorators like @app.get("/x")."""
    for d in getattr(node, "decorator_list", []):
        if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and isinstance(d.func.value, ast.Name) and d.func.attr in _HTTP:
            where = d.args[0].value if d.args and isinstance(d.args[0], ast.Constant) and isinstance(d.args[0].value, str) else None
            yield d.func.value.id, d.func.attr, where, d.lineno


def _looks_like_test(path: str) -> bool:
    name = path.rpartition("/")[2]
    return "test" in path.split("/")[:-1] or "tests" in path.split("/")[:-1] or name.startswith("test_") or name.endswith(("_test.py", ".test.py")) or ".unit.test." in name


def extract(path: str, content: str, context: Context) -> Iterator[dict]:
    module, root = module_of(path)
    make = lambda kind, source, node=None, /, **kw: observation(
        f"python.{kind}", path, source, NAME, kw.pop("confidence", "extracted"), line=getattr(node, "lineno", None), end=getattr(node, "end_lineno", None), module=module, **kw
    )
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError) as e:
        yield observation("python.parse_error", path, "parse-error", NAME, "unknown", line=getattr(e, "lineno", None) or None, module=module, error_kind="syntax-error", message_summary=str(e)[:160])
        return
    lines = max(1, content.count("\n") + (not content.endswith("\n")))
    yield observation("python.module", path, f"module:{module}", NAME, "extracted", line=1, end=lines, name=module, target=K.key("python.module", module), module=module, package_root=root, parser="ast")
    package = path.endswith("/__init__.py")
    framework = set()
    for node in tree.body:
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            for tried, level, name, alias in import_candidates(module, package, node):
                local = next((t for t in tried if t in context.modules), None)
                found = local or (tried[-1] if not level else None) or tried[0]
                resolution = "local" if local else "unknown" if level else "external"
                target = K.key("python.module", found) if local else K.unknown("python.module", "missing-module") if level else K.external("python.module", found)
                framework |= {found.split(".")[0]} & {"flask", "fastapi", "django", "unittest", "pytest"}
                yield make("import", f"import:{node.lineno}:{found}", node, name=found, target=target, imported_names=[name], imported_module=None if resolution == "unknown" else found, alias=alias, level=level, resolution=resolution)
        elif isinstance(node, ast.ClassDef):
            bases = [ast.unparse(b)[:120] for b in node.bases]
            yield make("class", f"class:{node.lineno}:{node.name}", node, name=node.name, target=K.key("python.class", module, node.name), bases=bases, decorators=_decorators(node))
            for m in node.body:
                if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    target = K.key("python.method", module, node.name, m.name)
                    yield make("method", f"method:{m.lineno}:{node.name}.{m.name}", m, name=m.name, target=target, **{"class": node.name, "async": isinstance(m, ast.AsyncFunctionDef)}, decorators=_decorators(m))
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            target = K.key("python.function", module, node.name)
            yield make("function", f"function:{node.lineno}:{node.name}", node, name=node.name, target=target, **{"async": isinstance(node, ast.AsyncFunctionDef)}, decorators=_decorators(node))
    extra = [list(_tests(make, tree, path)) if _looks_like_test(path) else [], list(_web(make, tree, framework, path.rpartition("/")[2] == "settings.py"))]
    for found in extra:
        yield from found[:MOST]
    if any(len(found) > MOST for found in extra):
        yield observation("python.parse_error", path, "parse-error:observation-limit", NAME, "unknown", module=module, error_kind="python-observation-limit", recovered=True)


def _tests(make, tree: ast.Module, path: str) -> Iterator[dict]:
    yield make("test_file", "test-file", None, name=path.rpartition("/")[2])
    for node in tree.body:
        if isinstance(node, ast.ClassDef):
            case = any("TestCase" in ast.unparse(b) for b in node.bases)
            if case:
                yield make("unittest_case", f"unittest-case:{node.name}", node, name=node.name)
            if case or node.name.startswith("Test"):
                for m in node.body:
                    if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef)) and m.name.startswith("test"):
                        yield make("test_method" if case else "pytest_test", f"test-method:{node.name}.{m.name}", m, name=m.name, **{"class": node.name})
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            marks = _decorators(node)
            if any("fixture" in d for d in marks):
                yield make("pytest_fixture", f"fixture:{node.name}", node, name=node.name)
            elif node.name.startswith("test"):
                yield make("pytest_test", f"pytest-test:{node.name}", node, name=node.name)
                yield from (make("test_parametrize", f"parametrize:{node.name}:{i}", node, name=node.name) for i, d in enumerate(marks) if "parametrize" in d)
    found = sum(isinstance(n, ast.Assert) or isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr.startswith("assert") for n in ast.walk(tree))
    if found:
        yield make("test_assertion", "assertions", None, assertion_count=found)


_APPS = {"Flask": "flask_app", "Blueprint": "flask_blueprint", "FastAPI": "fastapi_app", "APIRouter": "fastapi_router"}


def _django_urls(make, patterns: list[ast.expr]) -> Iterator[dict]:
    """URL patterns, the views that they name, and the modules that they include."""
    for i, call in enumerate(patterns):
        if not isinstance(call, ast.Call) or not call.args:
            continue
        where = call.args[0].value if isinstance(call.args[0], ast.Constant) else None
        view = call.args[1] if len(call.args) > 1 else None
        included = isinstance(view, ast.Call) and ast.unparse(view.func).rpartition(".")[2] == "include"
        kind = "include" if included else ast.unparse(call.func).rpartition(".")[2]
        shown = None if view is None or included else ast.unparse(view.func if isinstance(view, ast.Call) else view)[:160]
        yield make("django_urlpattern", f"django-urlpattern:{i}", call, name=where, route_pattern=where, dynamic=where is None, urlpattern_kind=kind, view_name=shown, framework="django")
        if shown:
            yield make("django_view", f"django-view:{i}", call, name=shown, target=K.external("python.view", shown), view_name=shown, urlpattern_kind=kind, framework="django")
            yield make("reference", f"django-view-reference:{i}", call, name=shown, target=K.external("python.view", shown), reference_kind="django_urlpattern_view", framework="django")
        if included and view.args and isinstance(view.args[0], ast.Constant) and isinstance(view.args[0].value, str):
            yield make("reference", f"django-include:{i}", call, name=view.args[0].value, target=K.external("python.module", view.args[0].value), reference_kind="django_include", framework="django")


def _dependencies(node: ast.FunctionDef | ast.AsyncFunctionDef) -> Iterator[tuple[ast.Call, str, str | None]]:
    """Depends(x) and Security(x) among a function's defaults and decorators: the call, its kind and x."""
    a = node.args
    given = [*a.defaults, *(d for d in a.kw_defaults if d), *(k.value for d in node.decorator_list if isinstance(d, ast.Call) for k in d.keywords if k.arg == "dependencies")]
    for call in (c for g in given for c in ast.walk(g) if isinstance(c, ast.Call)):
        kind = ast.unparse(call.func).rpartition(".")[2]
        if kind in ("Depends", "Security"):
            yield call, kind, ast.unparse(call.args[0])[:160] if call.args else None


def _web(make, tree: ast.Module, framework: set[str], settings: bool = False) -> Iterator[dict]:
    kinds: dict[str, str] = {}
    for node in tree.body:
        if isinstance(node, ast.Assign) and isinstance(node.value, ast.Call) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name):
            called = ast.unparse(node.value.func).rpartition(".")[2]
            if called in _APPS:
                kinds[node.targets[0].id] = _APPS[called]
                yield make(_APPS[called], f"{_APPS[called]}:{node.targets[0].id}", node, name=node.targets[0].id, framework=_APPS[called].split("_")[0])
        if isinstance(node, (ast.Assign, ast.AnnAssign)):
            names = [t.id for t in (node.targets if isinstance(node, ast.Assign) else [node.target]) if isinstance(t, ast.Name)]
            if "urlpatterns" in names and isinstance(node.value, (ast.List, ast.Tuple)):
                yield from _django_urls(make, node.value.elts)
            for n in names if settings else ():
                if n.isupper():
                    hidden = secret_name(n)
                    yield make("django_setting_reference", f"django-setting:{n}", node, name=n, setting_name=n, redacted=hidden, framework="django")
                    if hidden:
                        yield make("redaction", f"django-redaction:{n}", node, name=n, field_name=n, redaction_reason="secret-like-django-setting", framework="django")
    for node in ast.walk(tree):
        for receiver, verb, where, _ in _routes(node):
            app = kinds.get(receiver) or ("fastapi_app" if "fastapi" in framework else "flask_app" if "flask" in framework else None)
            if app:
                kind = "flask_route" if app.startswith("flask") else "fastapi_route"
                yield make(kind, f"{kind}:{getattr(node, 'name', '')}:{node.lineno}:{verb}", node, name=getattr(node, "name", None), route_method=verb.upper(), route_pattern=where, dynamic=where is None, framework=app.split("_")[0])
        if "fastapi" in framework and isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            for i, (call, kind, what) in enumerate(_dependencies(node)):
                yield make("fastapi_dependency", f"fastapi-dependency:{node.name}:{node.lineno}:{i}", call, name=what or kind, handler_name=node.name, dependency_name=what, dependency_kind=kind, framework="fastapi")
                if what:
                    yield make("reference", f"fastapi-dependency-reference:{node.name}:{node.lineno}:{i}", call, name=what, target=K.external("python.dependency", what), reference_kind="fastapi_dependency", framework="fastapi")
        if isinstance(node, ast.ClassDef) and any(ast.unparse(b).endswith("AppConfig") for b in node.bases):
            yield make("django_app", f"django-app:{node.name}", node, name=node.name, class_name=node.name, framework="django")
        if isinstance(node, ast.ClassDef) and "django" in framework and any(ast.unparse(b).endswith("models.Model") for b in node.bases):
            yield make("django_model", f"django-model:{node.name}", node, name=node.name, framework="django")
