"""Nix files by pattern: imports, flake outputs with the scripts that apps run, and other relative paths."""

from __future__ import annotations

import re
from collections.abc import Iterator

from cairngraph.functions import keys as K
from cairngraph.operators.base import Context, observation, resolve, slug

NAME = "cairn-nix"
_IMPORT = re.compile(r"\bimport\s+(\(?\s*)(\.{1,2}/[\w./-]+|\$\{[^}]*\}\S*)")
_LIST = re.compile(r"\bimports\s*=\s*\[([^\]]*)\]", re.S)
_OUTPUT = re.compile(r"\b(apps|packages|devShells|checks)\.([\w-]+|\$\{[^}]+\})\.([\w-]+|\"[^\"]+\")\s*=")
_PATH = re.compile(r"(?<![\w/.\"$}])\.{1,2}/[\w./-]+")
KIND = {"apps": "app", "packages": "package", "devShells": "devShell", "checks": "check"}


def program(block: str) -> tuple[str, str | None, str] | None:
    """(raw, path inside the flake, resolution) of an app's program."""
    m = re.search(r"program\s*=\s*(.+?);", block, re.S)
    if not m:
        return None
    raw = m[1].strip()
    for pattern in (r'"\$\{self\}/([^"$]+)"', r"toString\s+\(?\.?/?([\w./-]+)\)?", r'"\./([^"$]+)"', r"\./([\w./-]+)"):
        if found := re.search(pattern, raw):
            return raw, found[1].strip("/"), "local"
    return raw, None, "interpolated" if "${" in raw else "external"


def extract(path: str, content: str, context: Context) -> Iterator[dict]:
    line = lambda at: content.count("\n", 0, at) + 1
    used: list[tuple[int, int]] = []
    make = lambda kind, source, n, /, **kw: observation(f"nix.{kind}", path, source, NAME, line=n, **kw)

    def imported(at: int, raw: str, syntax: str) -> dict:
        inside = None if "$" in raw else resolve(path, raw)
        resolution = "dynamic" if "$" in raw else "local" if inside else "escape"
        target = K.file_key(inside) if inside else K.dynamic("file", "interpolated-nix-import") if "$" in raw else K.unknown("file", "repo-escaping-nix-import")
        return make("import", f"nix-import:{line(at)}:{slug(raw)}", line(at), target=target, import_path=raw, resolved_path=inside, resolution=resolution, syntax=syntax, dynamic_reason="interpolated-nix-import" if "$" in raw else None)

    for m in _IMPORT.finditer(content):
        used.append(m.span(2))
        yield imported(m.start(2), m[2], "import-expression")
    for block in _LIST.finditer(content):
        for m in _PATH.finditer(block[1]):
            at = block.start(1) + m.start()
            used.append((at, at + len(m[0])))
            yield imported(at, m[0], "imports-list")
    if path.rpartition("/")[2] == "flake.nix":
        found = list(_OUTPUT.finditer(content))
        for i, m in enumerate(found):
            end = found[i + 1].start() if i + 1 < len(found) else len(content)
            kind, system, name = KIND[m[1]], m[2], m[3].strip('"')
            extra: dict = {}
            if kind == "app" and (p := program(content[m.end() : end])):
                extra = {"app": name, "program": p[0], "program_path": p[1], "program_resolution": p[2]}
                used.append((m.end(), end))
            yield make(kind, f"nix-{kind}:{system}:{name}", line(m.start()), end=line(max(m.start(), end - 1)), name=name, target=K.key(f"nix.{kind}", context.flake_ref, system, name), attr_path=f"{m[1]}.{system}.{name}", flake_ref=context.flake_ref,
                       name_=None, output_kind=kind, system=system, **extra)
    for m in _PATH.finditer(content):
        if not any(a <= m.start() < b for a, b in used):
            inside = resolve(path, m[0])
            target = K.file_key(inside) if inside else K.unknown("file", "repo-escaping-nix-path")
            yield make("path_ref", f"nix-path:{line(m.start())}:{slug(m[0])}", line(m.start()), target=target, path_ref=m[0], resolved_path=inside, resolution="local" if inside else "escape")
