"""Plain text, CSV and TSV tables, LaTeX, and OpenDocument packages."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from cairngraph.functions import keys as K
from cairngraph.operators.base import URL, Context, observation, redact_url, resolve, secret_name, secret_text, slug, summary

NAME = "cairn-documents"
PARSER = "stdlib-document-conservative"
# Limits of tables and packages.
MOST_ROWS = 2000
ODF_BYTES, ODF_INFLATED, ODF_PARTS, ODF_RATIO = 50 << 20, 100 << 20, 2000, 100
ODF_READ = ("content.xml", "styles.xml", "meta.xml", "META-INF/manifest.xml")
_PATH = re.compile(r"(?<![\w/])(?:\.{1,2}/)?(?:[\w.-]+/)+[\w.-]+\.\w+|(?<![\w/])\.{1,2}/[\w.-]+")
LATEX_LEVELS = {"part": 1, "chapter": 2, "section": 3, "subsection": 4, "subsubsection": 5, "paragraph": 6}


def cell_type(v: str) -> str:
    v = v.strip()
    if not v:
        return "empty"
    if v.lower() in ("true", "false"):
        return "boolean"
    for kind, pattern in (("integer", r"[+-]?\d+"), ("decimal", r"[+-]?\d+\.\d+"), ("date-like", r"\d{4}-\d{2}-\d{2}.*"), ("url-like", r"https?://.*")):
        if re.fullmatch(pattern, v):
            return kind
    return "text"


def column_type(values: list[str]) -> str:
    kinds = {t for t in map(cell_type, values) if t != "empty"}
    return kinds.pop() if len(kinds) == 1 else "mixed" if kinds else "empty"


def looks_like_header(header: list[str], rows: list[list[str]]) -> bool:
    """Distinct non-empty texts above rows: a header."""
    return bool(header) and bool(rows) and len(set(header)) == len(header) and all(cell_type(h) == "text" for h in header)


def references(path: str, line: str, n: int, first: int, source: str, fmt: str, context: Context) -> list[dict]:
    """URLs, then paths outside them; none in a line with a secret marker."""
    if secret_text(line):
        return []
    found = [(m.start(), "url", m[0].rstrip(".,;")) for m in URL.finditer(line)]
    rest = URL.sub(lambda m: " " * len(m[0]), line)
    found += [(m.start(), "path", m[0].rstrip(".,;")) for m in _PATH.finditer(rest)]
    out = []
    for i, (_, kind, value) in enumerate(found):
        if kind == "url":
            target, reason = K.key("external.url", redact_url(value)), "url-literal"
        else:
            inside = resolve(path, value) or None
            inside = inside if inside in context.paths else value if value in context.paths else inside
            target = K.file_key(inside) if inside else K.unknown("file", "repo-escaping-reference")
            reason = "local-file" if inside in context.paths else "path-literal" if inside else "repo-escaping-reference"
        out.append(observation("document.reference", path, f"document-reference:{n}:{first + i}", NAME, line=n, target=target, format=fmt, not_fetched=True, raw_value_summary=redact_url(value)[:160], redacted=redact_url(value) != value, reference_kind=kind, resolution_reason=reason, source_key=source))
    return out


def _all_references(path: str, lines: list[str], source: str, fmt: str, context: Context) -> list[dict]:
    out: list[dict] = []
    for n, line in enumerate(lines, 1):
        out += references(path, line, n, len(out), source, fmt, context)
    return out


def text(path: str, content: str, context: Context) -> Iterator[dict]:
    doc, lines = K.within("document.file", path), content.splitlines()
    sections = [(n, len(m[1]), m[2].strip()) for n, x in enumerate(lines, 1) if (m := re.match(r"(#{1,6})\s+(.+)", x))]
    refs = _all_references(path, lines, doc, "text", context)
    hidden = secret_text(content)
    yield observation("document.text_document", path, "text-document", NAME, "extracted", target=doc, format="text", parser=PARSER, byte_count=len(content.encode()), line_count=len(lines),
                      paragraph_count=len([p for p in re.split(r"\n\s*\n", content) if p.strip()]), section_count=len(sections), reference_count=len(refs), summary=None if hidden else summary(content), summary_redacted=hidden)
    for i, (n, level, heading) in enumerate(sections, 1):
        pointer = f"/sections/{i}-{slug(heading)}"
        secret = secret_text(heading)
        yield observation("document.text_section", path, f"text-section:{pointer}", NAME, line=n, name=pointer, target=K.within("document.section", path, pointer), format="text", pointer=pointer, heading_level=level,
                          heading_summary="[redacted]" if secret else summary(heading), document_key=doc, redacted=secret)
    yield from refs


def table(path: str, content: str, context: Context, delimiter: str = ",", fmt: str = "csv") -> Iterator[dict]:
    rows = []
    for row in csv.reader(io.StringIO(content), delimiter=delimiter):
        if row:
            rows.append(row)
        if len(rows) > MOST_ROWS:
            break
    wrong = lambda kind, message: observation("document.parse_error", path, f"document-parse-error:{kind}", NAME, "unknown", format=fmt, parser="stdlib-csv", error_kind=kind, message_summary=message, recovered=False)
    if not rows:
        yield wrong("empty-table", "table has no rows")
        return
    if len({len(r) for r in rows}) > 1:
        yield wrong("ragged-table", "rows have different numbers of cells")
        return
    cut = len(rows) > MOST_ROWS
    rows = rows[:MOST_ROWS]
    header = looks_like_header(rows[0], rows[1:])
    names = rows[0] if header else [f"column-{i + 1}" for i in range(len(rows[0]))]
    data = rows[1:] if header else rows
    key, doc = K.within("document.table", path, "/table"), K.within("document.file", path)
    yield observation("document.table_document", path, "document-table", NAME, "extracted", target=key, column_count=len(names), delimiter="\\t" if delimiter == "\t" else delimiter, document_key=doc, format=fmt,
                      header_present=header, parser="stdlib-csv", pointer="/table", row_count=len(data), row_limit_reached=cut or None)
    hidden = {i for i, n in enumerate(names) if header and (secret_name(n) or "account" in n.lower())}
    for i, n in enumerate(names):
        values, pointer = [r[i] for r in data], f"/table/columns/{slug(n).replace('-', '_') if header else n}"
        yield observation("document.table_column", path, f"document-column:{pointer}", NAME, "extracted", name=pointer, target=K.within("document.column", path, pointer), column_index=i, format=fmt, pointer=pointer,
                          table_key=key, column_name_summary="[redacted]" if i in hidden else n, non_empty_count=sum(bool(v.strip()) for v in values), redacted=i in hidden,
                          redaction_reason="secret-prone-column-name" if i in hidden else None, type_summary="redacted" if i in hidden else column_type(values))
    count = 0
    for n, row in enumerate(data, 2 if header else 1):
        got = references(path, " ".join(v for i, v in enumerate(row) if i not in hidden), n, count, key, fmt, context)
        count += len(got)
        yield from got


def without_comments(line: str) -> str:
    """LaTeX: up to a percent sign with an even number of backslashes before it."""
    m = re.match(r"(?:[^%\\]|\\.)*", line)
    return m[0] if m else line


def latex(path: str, content: str, context: Context) -> Iterator[dict]:
    doc, lines = K.within("document.file", path), [without_comments(x) for x in content.splitlines()]
    sections, commands = [], []
    seen: dict[str, int] = {}
    for n, line in enumerate(lines, 1):
        for m in re.finditer(r"\\([A-Za-z]+)\*?(?:\[[^\]]*\])?\{([^{}]*)\}", line):
            if m[1] in LATEX_LEVELS:
                sections.append((n, m[1], m[2]))
            elif m[1] in ("ref", "cite", "label", "input", "include", "includegraphics", "url", "href", "bibliography"):
                seen[m[1]] = seen.get(m[1], 0) + 1
                commands.append((n, m[1], m[2], f"/commands/{m[1]}:{seen[m[1]]}"))
    refs = _all_references(path, lines, doc, "latex", context)
    yield observation("document.latex_document", path, "latex-document", NAME, "extracted", target=doc, command_count=len(commands), compiled=False, format="latex", line_count=len(lines), parser=PARSER, reference_count=len(refs), section_count=len(sections))
    for i, (n, command, heading) in enumerate(sections, 1):
        pointer = f"/sections/{i}-{slug(heading)}"
        yield observation("document.latex_section", path, f"latex-section:{pointer}", NAME, line=n, name=pointer, target=K.within("document.section", path, pointer), command=command, document_key=doc, format="latex",
                          heading_level=LATEX_LEVELS[command], heading_summary="[redacted]" if secret_text(heading) else summary(heading), pointer=pointer, redacted=secret_text(heading))
    for n, command, argument, pointer in commands:
        yield observation("document.latex_command", path, f"latex-command:{pointer}", NAME, line=n, name=pointer, target=K.within("document.latex_command", path, pointer), argument_summary=summary(argument), command=command, document_key=doc, format="latex", pointer=pointer, redacted=False)
    yield from refs


_OFFICE = {p: f"{{urn:oasis:names:tc:opendocument:xmlns:{p}:1.0}}" for p in ("text", "table", "office")}


def odf(path: str, content: bytes, context: Context) -> Iterator[dict]:
    fmt = path.rpartition(".")[2].lower()
    wrong = lambda kind, message: observation("document.parse_error", path, f"document-parse-error:{kind}", NAME, "unknown", format=fmt, parser=PARSER, error_kind=kind, message_summary=message, recovered=False)
    if len(content) > ODF_BYTES:
        yield wrong("package-size-limit", "ODF package is too large")
        return
    try:
        box = zipfile.ZipFile(io.BytesIO(content))
    except (zipfile.BadZipFile, ValueError):
        yield wrong("malformed-zip", "ODF package is not a valid ZIP archive")
        return
    parts = box.infolist()
    if any(p.filename.startswith("/") or ".." in p.filename.split("/") for p in parts):
        yield wrong("path-traversal", "ODF package has a part outside of it")
    elif len(parts) > ODF_PARTS or sum(p.file_size for p in parts) > ODF_INFLATED or any(p.file_size > ODF_RATIO * max(1, p.compress_size) and p.file_size > 1 << 20 for p in parts):
        yield wrong("package-limit", "ODF package exceeds a limit")
    else:
        yield from _odf_parts(path, content, box, parts, fmt, wrong, context)


def _odf_parts(path: str, content: bytes, box: zipfile.ZipFile, parts: list, fmt: str, wrong, context: Context) -> Iterator[dict]:
    trees = {}
    for p in parts:
        if p.filename in ODF_READ:
            raw = box.read(p)
            if b"<!DOCTYPE" in raw or b"<!ENTITY" in raw:
                yield wrong("dangerous-xml", f"ODF part {p.filename} contains disallowed XML constructs")
                return
            try:
                trees[p.filename] = ElementTree.fromstring(raw)
            except ElementTree.ParseError:
                yield wrong("malformed-xml", f"ODF part {p.filename} is not well-formed XML")
                return
    body = trees.get("content.xml")
    if body is None:
        yield wrong("missing-content", "ODF package has no content.xml")
        return
    T, B = _OFFICE["text"], _OFFICE["table"]
    doc = K.within("document.file", path)
    heads = [(int(h.get(f"{T}outline-level", "1")), "".join(h.itertext())) for h in body.iter(f"{T}h")]
    paragraphs = ["".join(p.itertext()) for p in body.iter(f"{T}p")]
    tables = [(t.get(f"{B}name", f"table-{i}"), [["".join(c.itertext()) for c in r.iter(f"{B}table-cell")] for r in t.iter(f"{B}table-row")]) for i, t in enumerate(body.iter(f"{B}table"), 1)]
    sheet = fmt in ("ods", "ots")
    refs = _all_references(path, paragraphs, doc, fmt, context)
    formulas = sum(c.get(f"{B}formula") is not None for c in body.iter(f"{B}table-cell"))
    yield observation("document.odf_document", path, "odf-document", NAME, "extracted", target=doc, document_kind=fmt, format=fmt, formula_count=formulas, formulas_evaluated=False, heading_count=len(heads),
                      package_byte_count=len(content), package_part_count=len(parts), paragraph_count=len(paragraphs), parsed_part_count=len(trees), parser=PARSER, reference_count=len(refs),
                      sheet_count=len(tables) if sheet else 0, table_count=0 if sheet else len(tables), skipped_part_count=len(parts) - len(trees), template=fmt in ("ott", "ots"),
                      total_uncompressed_bytes=sum(p.file_size for p in parts))
    for i, (level, heading) in enumerate(heads, 1):
        pointer = f"/sections/{slug(heading)}"
        yield observation("document.odf_text", path, f"odf-heading:{i}", NAME, "extracted", name=pointer, target=K.within("document.section", path, pointer), document_key=doc, format=fmt, heading_level=level,
                          heading_summary=summary(heading), parser=PARSER, pointer=pointer, redacted=False, source_part="content.xml")
    for name, rows in tables:
        kind = "sheet" if sheet else "table"
        pointer = f"/{kind}s/{slug(name)}"
        width = max((len(r) for r in rows), default=0)
        header = bool(rows) and looks_like_header(rows[0], rows[1:])
        yield observation(f"document.odf_{kind}", path, f"odf-{kind}:{pointer}", NAME, "extracted", name=pointer, target=K.within(f"document.{kind}", path, pointer), document_key=doc, display_name=name, format=fmt,
                          parser=PARSER, pointer=pointer, row_count=len(rows), column_count=width, header_present=header, formula_count=formulas, formulas_evaluated=False, redacted=False)
        for c in range(width):
            label = rows[0][c] if header else f"column-{c + 1}"
            where, values = f"{pointer}/columns/{slug(label)}", [r[c] for r in rows[header:] if c < len(r)]
            hidden = header and secret_name(label)
            yield observation("document.odf_column", path, f"odf-column:{where}", NAME, "extracted", name=where, target=K.within("document.column", path, where), column_index=c, format=fmt, pointer=where,
                              column_name_summary="[redacted]" if hidden else label, non_empty_count=sum(bool(v.strip()) for v in values), redacted=hidden, redaction_reason="secret-prone-column-name" if hidden else None,
                              type_summary="redacted" if hidden else column_type(values))
    yield from refs


def extract(path: str, content: str, context: Context) -> Iterator[dict]:
    if path.endswith((".csv", ".tsv")):
        yield from table(path, content, context, *((",", "csv") if path.endswith(".csv") else ("\t", "tsv")))
    elif path.endswith((".tex", ".latex")):
        yield from latex(path, content, context)
    else:
        yield from text(path, content, context)
