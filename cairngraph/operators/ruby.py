"""Ruby sources: scopes, definitions, constants, requires, gems, rake tasks, routes and tests.

Statements are those of the masked text (ruby_lexer), so nothing is found in strings, heredocs, percent literals or comments. A
stack pairs each `end` with the word that it closes; modifiers and endless methods open nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from cairngraph.functions import keys as K
from cairngraph.operators.base import Context, observation, redact_url, resolve, secret_name, slug
from cairngraph.operators.ruby_lexer import block_words, masked

NAME = "cairn-ruby"
MOST_BYTES = 512 << 10
_VISIBILITY = r"(?:(?:private|public|protected|private_class_method|module_function)\s+)*"
_VERB = re.compile(r"^(get|post|put|patch|delete|head|options)\s+[\"']([^\"']+)[\"']")


def profile(path: str, content: str) -> str:
    name = path.rpartition("/")[2]
    known = {"Gemfile": "gemfile", "Rakefile": "rake", "Vagrantfile": "vagrant"}
    if name in known:
        return known[name]
    if name.endswith((".gemspec", ".rake")):
        return "gemspec" if name.endswith(".gemspec") else "rake"
    for mark, p in (("Minitest", "minitest"), ("minitest", "minitest"), ("Sinatra", "sinatra"), ("sinatra", "sinatra"), ("Hanami", "hanami")):
        if mark in content:
            return p
    return "test" if name.endswith("_test.rb") or name.startswith("test_") else "ruby"


def _statements(content: str) -> Iterator[tuple[int, str, str]]:
    """(line, masked statement, its original) of all statements, a line's parted at semicolons."""
    for n, (line, raw) in enumerate(zip(masked(content).split("\n"), content.split("\n"), strict=True), 1):
        at = 0
        for part in line.split(";"):
            inner = part.strip()
            if inner:
                start = at + len(part) - len(part.lstrip())
                yield n, inner, raw[start : start + len(inner)]
            at += len(part) + 1


def extract(path: str, content: str, context: Context) -> Iterator[dict]:
    prof = profile(path, content)
    file = K.within("ruby.file", path)
    make = lambda kind, source, n, /, **kw: observation(f"ruby.{kind}", path, source, NAME, kw.pop("confidence", "heuristic"), line=n, format="ruby", profile=prof, parser="lexical", **kw)
    if len(content) > MOST_BYTES:
        yield make("parse_error", "ruby-parse-error:size", None, confidence="unknown", error_kind="file-size-limit", recovered=False)
        return
    yield make("file", "ruby-file", None, target=file, confidence="extracted")
    stack: list[tuple[str, str | None, str | None]] = []  # (what, qualified name, key)
    for n, line, raw in _statements(content):
        said = lambda m, g: raw[m.start(g) : m.end(g)]  # noqa: B023, E731
        scope = next((q for w, q, _ in reversed(stack) if w in ("module", "class") and q), None)
        owner = next((k for *_, k in reversed(stack) if k), file)
        opened: tuple[str, str | None, str | None] | None = None  # what the first word that opens a block is
        if m := re.match(r"(module|class)\s+([A-Z][\w:]*)(?:\s*<\s*([\w:]+))?", line):
            name = f"{scope}::{m[2]}" if scope else m[2]
            key = K.key(f"ruby.{m[1]}", name)
            test = m[1] == "class" and m[3] and "Test" in m[3]
            yield make(m[1], f"ruby-{m[1]}:{name}", n, name=name, target=key, source_key=owner, qualified_name=name, superclass=m[3])
            if test:
                yield make("test_case", f"ruby-test-case:{name}", n, name=name, target=K.key("ruby.test_case", file, name), source_key=owner, test_framework="minitest", qualified_name=name)
            opened = (m[1], name, key)
        elif m := re.match(_VISIBILITY + r"def\s+(self\.)?(\w+(?:[?!]|=(?=\())?|\[\]=?|[=<>+*/%!~^&|-]+@?)", line):
            kind = "singleton_method" if m[1] or next((w for w, *_ in reversed(stack) if w in ("module", "class", "singleton")), None) == "singleton" else "method"
            holder = scope or "Object"
            yield make(kind, f"ruby-{kind}:{holder}.{m[2]}:{n}", n, name=m[2], target=K.key(f"ruby.{kind}", holder, m[2]), source_key=owner, owner=holder, method_name=m[2], qualified_name=f"{holder}{'.' if m[1] else '#'}{m[2]}")
            if m[2].startswith("test_"):
                yield make("test_method", f"ruby-test-method:{holder}.{m[2]}", n, name=m[2], target=K.key("ruby.test_method", K.key("ruby.test_case", file, holder), m[2]), source_key=owner, method_name=m[2], test_framework="minitest")
            opened = ("def", None, None)
        elif re.match(r"class\s*<<", line):
            opened = ("singleton", None, None)
        elif m := re.match(r"([A-Z][A-Z0-9_]+)\s*=(?!=)", line):
            hidden = secret_name(m[1])
            yield make("constant", f"ruby-constant:{scope or ''}:{m[1]}", n, name=m[1], target=K.key("ruby.constant", scope or "Object", m[1]), source_key=owner, constant_name=m[1], redacted=hidden, redaction_reason="secret-prone-key" if hidden else None)
        elif m := re.match(r"(require_relative|require|load)\s*\(?\s*([\"'])( +)\2", line):
            name = said(m, 3)
            inside = resolve(path, name) if m[1] == "require_relative" else None
            inside = inside and (inside if inside.endswith(".rb") else inside + ".rb")
            dynamic = "#{" in name
            target = K.dynamic("ruby.require", "interpolated-require") if dynamic else K.file_key(inside) if inside else K.unknown("file", "repo-escaping-require") if m[1] == "require_relative" else K.external("ruby.gem", name)
            for kind in ("require", "reference"):
                yield make(kind, f"ruby-{kind}:{n}:{slug(name)}", n, name=name, target=target, source_key=file, reference_kind=m[1], raw_value_summary=name, resolution_reason="dynamic" if dynamic else "local-file" if inside else "external")
        elif m := re.match(r"(?:\w+\.)?(gem|add_dependency|add_runtime_dependency|add_development_dependency)\s*\(?\s*[\"']( +)[\"'](.*)", line):
            gem, rest = said(m, 2), said(m, 3)
            for kind in ("gem_dependency", "reference"):
                yield make(kind, f"ruby-{kind}:{gem}:{n}", n, name=gem, target=K.external("ruby.gem", gem), source_key=file, reference_kind=m[1], raw_value_summary=redact_url(rest.strip(", ") or gem)[:120])
        elif prof == "rake" and (m := re.match(r"(task|namespace|desc)\s*\(?\s*[:\"']?([\w:-]+)", raw)):
            yield make("dsl", f"ruby-dsl:{m[1]}:{n}", n, name=m[2], dsl_name=m[1])
        elif prof == "vagrant" and (m := re.match(r"(\w+)\.vm\.(\w+)", line)):
            yield make("vagrant_config", f"ruby-vagrant:{n}", n, name=m[2], setting=m[2])
        elif (m := _VERB.match(raw)) and prof in ("sinatra", "hanami"):
            yield make("route", f"ruby-route:{m[1]}:{m[2]}", n, name=f"{m[1].upper()} {m[2]}", target=K.key("ruby.route", file, f"{m[1].upper()} {m[2]}"), source_key=owner, route_method=m[1].upper(), route_pattern=m[2])
        elif m := re.match(r"(describe|it)\s*\(?\s*[\"']([^\"']+)[\"']", raw):
            kind = "test_case" if m[1] == "describe" else "test_method"
            case = next((k for w, _, k in reversed(stack) if w == "describe"), None)
            key = K.key("ruby.test_case", file, m[2]) if kind == "test_case" else K.key("ruby.test_method", case or K.key("ruby.test_case", file, "top"), m[2])
            yield make(kind, f"ruby-{kind}:{n}", n, name=m[2], target=key, source_key=file, test_framework="minitest-spec", identity_strength="structural")
            opened = ("describe" if kind == "test_case" else "block", None, key if kind == "test_case" else None)
        for word in block_words(line):
            if word != "end":
                stack.append(opened or ("block", None, None))
                opened = None
            elif stack:
                stack.pop()
    if stack:
        yield make("parse_error", "ruby-parse-error:unclosed", None, confidence="unknown", error_kind="unclosed-scope", dynamic=False, recovered=True)
