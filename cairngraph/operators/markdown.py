"""Markdown: front matter, headings with their anchors, code fences, links, decision records and skills."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

from cairngraph.functions import keys as K
from cairngraph.operators.base import Context, observation, resolve, secret_name, slug

NAME = "cairn-markdown"
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")
_HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_INLINE = re.compile(r"(!?)\[([^\]]*)\]\(\s*<?([^)\s>]*)>?(?:\s+[\"'][^)]*)?\)")
_REFERENCE = re.compile(r"(!?)\[([^\]]+)\]\[([^\]]*)\]")
_DEFINITION = re.compile(r"^ {0,3}\[([^\]]+)\]:\s*<?(\S+?)>?(?:\s|$)")
_AUTO = re.compile(r"<(https?://[^>\s]+)>")


def anchor(text: str) -> str:
    kept = "".join(c for c in text.strip().lower() if c.isalnum() or c in " -_\t")
    return re.sub(r"\s", "-", kept)


def headings(content: str) -> list[dict]:
    """level, text, anchor, base_anchor, duplicate_index, parent_anchor and line, outside fences and front matter."""
    out: list[dict] = []
    seen: dict[str, int] = {}
    fence = ""
    for n, line in enumerate(content.splitlines(), 1):
        if m := _FENCE.match(line):
            if not fence:
                fence = m[1]
            elif m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                fence = ""
            continue
        if fence or n <= frontmatter_end(content) or not (m := _HEADING.match(line)) or not (m[2] or "").strip():
            continue
        base = anchor(m[2])
        k = seen.get(base, 0)
        seen[base] = k + 1
        level = len(m[1])
        parent = next((h["anchor"] for h in reversed(out) if h["level"] < level), None)
        out.append({"level": level, "text": m[2].strip(), "anchor": f"{base}-{k}" if k else base, "base_anchor": base, "duplicate_index": k, "parent_anchor": parent, "line": n})
    return out


def frontmatter_end(content: str) -> int:
    """The line of the closing `---`, 0 without front matter."""
    lines = content.splitlines()
    if not lines or lines[0].strip() != "---":
        return 0
    return next((n for n, x in enumerate(lines[1:], 2) if x.strip() == "---"), 0)


def frontmatter(content: str) -> dict | None:
    end = frontmatter_end(content)
    if not end:
        return None
    values, hidden, status = {}, [], "parsed"
    for line in content.splitlines()[1 : end - 1]:
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        key, colon, value = line.partition(":")
        if not colon or line[:1] in " \t-":
            status = "partial"
        elif secret_name(key):
            hidden.append(key.strip())
        else:
            values[key.strip()] = value.strip().strip("\"'")
    return {"keys": sorted([*values, *hidden]), "values": values, "redacted_keys": sorted(hidden), "parse_status": status, "end": end}


def link_target(path: str, raw: str, context: Context) -> dict:
    """target key, reason and what it resolved to."""
    bad = lambda reason, key=None: {"target": key or K.unknown("external.url", reason), "resolution_reason": reason}
    if not raw:
        return bad("empty-target")
    if "{{" in raw or "{%" in raw or "${" in raw:
        return bad("template-target", K.dynamic("external.url", "template-target"))
    if re.search(r"%(?![0-9A-Fa-f]{2})", raw):
        return bad("malformed-percent-escape")
    if re.match(r"(?i)(https?|mailto):", raw):
        return {"target": K.key("external.url", raw), "resolution_reason": "external-url", "resolved_target_kind": "external.url"}
    where, _, mark = raw.partition("#")
    where, mark = unquote(where), unquote(mark)
    inside = path if not where else resolve(path, where)
    if inside is None:
        return bad("repo-escaping-link", K.unknown("file", "repo-escaping-link"))
    found: dict = {"resolved_path": inside}
    if mark and mark in context.anchors.get(inside, frozenset()):
        return found | {"target": K.within("doc.section", inside, mark), "resolved_anchor": mark, "resolved_target_kind": "doc.section", "resolution_reason": "local-anchor"}
    if inside.endswith((".md", ".markdown")) and (inside in context.paths or inside == path):
        return found | {"target": K.within("doc.page", inside), "resolved_target_kind": "doc.page", "resolution_reason": "missing-anchor" if mark else "local-page"}
    if inside in context.paths:
        return found | {"target": K.file_key(inside), "resolved_target_kind": "file", "resolution_reason": "local-file"}
    return found | {"target": K.unknown("file", "missing-link-target"), "resolution_reason": "missing-file"}


def _role(path: str) -> str:
    name = path.rpartition("/")[2].lower()
    if name.startswith("readme"):
        return "readme"
    return "adr" if "/adr/" in f"/{path}" else "skill" if name == "skill.md" else "documentation"


def extract(path: str, content: str, context: Context) -> Iterator[dict]:
    make = lambda kind, source, confidence="extracted", /, **kw: observation(f"markdown.{kind}", path, source, NAME, confidence, **kw)
    page, front, found = K.within("doc.page", path), frontmatter(content), headings(content)
    title = (front or {}).get("values", {}).get("title") or (found[0]["text"] if found else None)
    yield make("document", "markdown-document", target=page, doc_path=path, doc_role=_role(path), title=title, frontmatter_present=front is not None)
    if front:
        yield make("frontmatter", "frontmatter", "heuristic", line=1, end=front["end"], keys=front["keys"], values=front["values"], redacted_keys=front["redacted_keys"], parse_status=front["parse_status"], page_key=page)
    for h in found:
        rest = {k: v for k, v in h.items() if k != "line"}
        yield make("heading", f"heading:{h['anchor']}", line=h["line"], name=h["text"], target=K.within("doc.section", path, h["anchor"]) if h["anchor"] else None, page_key=page, **rest)
    section = lambda n: next((h["anchor"] for h in reversed(found) if h["line"] <= n and h["anchor"]), None)
    yield from _fences_and_links(make, path, content, context, section, page)
    if m := re.match(r"(\d{3,})[-_](.+)\.m(?:d|arkdown)$", path.rpartition("/")[2]) if _role(path) == "adr" else None:
        status = re.search(r"(?im)^\W*status\W+(\w[\w ]*)", content)
        date = re.search(r"(?im)^\W*date\W+(\d{4}-\d{2}-\d{2})", content)
        yield make("adr_metadata", "adr-metadata", name=m[1], target=K.key("doc.adr", m[1]), adr_number=m[1], title=re.sub(r"^ADR[ -]*\d*[:.\s-]*", "", title or m[2]), status=status and status[1].strip(), date=date and date[1], filename_slug=m[2], metadata_source="heading")
    if _role(path) == "skill":
        values = (front or {}).get("values", {})
        name = values.get("name") or path.split("/")[-2] if "/" in path else values.get("name")
        if name:
            yield make("skill_metadata", "skill-metadata", "heuristic", name=name, target=K.key("doc.skill", name), skill_name=name, description=values.get("description"), skill_path=path, frontmatter_keys=(front or {}).get("keys", []), metadata_source="frontmatter" if front else "path", parse_status=(front or {}).get("parse_status"))


def _fences_and_links(make, path: str, content: str, context: Context, section, page: str) -> Iterator[dict]:
    lines = content.splitlines()
    defined = {m[1].lower(): m[2] for line in lines if (m := _DEFINITION.match(line))}
    fence, opened, info, count = "", 0, "", 0
    end = frontmatter_end(content)
    for n, line in enumerate(lines, 1):
        if n <= end:
            continue
        if m := _FENCE.match(line):
            if not fence:
                fence, opened, info = m[1], n, m[2].strip()
            elif m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                yield _fence(make, opened, n, fence, info, True, section(opened), page, count)
                fence, count = "", count + 1
            continue
        if fence or _DEFINITION.match(line):
            continue
        plain = re.sub(r"`[^`]*`", lambda m: " " * len(m[0]), line)
        links = [(m.start(), m[1] == "!", m[2], m[3], "inline") for m in _INLINE.finditer(plain)]
        links += [(m.start(), m[1] == "!", m[2], defined[(m[3] or m[2]).lower()], "reference") for m in _REFERENCE.finditer(plain) if (m[3] or m[2]).lower() in defined]
        links += [(m.start(), False, m[1], m[1], "autolink") for m in _AUTO.finditer(plain)]
        for i, (_, image, shown, raw, syntax) in enumerate(sorted(links)):
            found = link_target(path, raw, context)
            at = section(n)
            source = K.within("doc.section", path, at) if at else page
            yield make("link", f"link:{n}:{i}:{slug(raw)[:60]}", line=n, name=shown or raw, target=found.pop("target"), is_image=image, link_text=shown, raw_target=raw, link_syntax=syntax, source_key=source, source_anchor=at, **found)
    if fence:
        yield _fence(make, opened, len(lines), fence, info, False, section(opened), page, count)


def _fence(make, start: int, end: int, fence: str, info: str, closed: bool, at: str | None, page: str, count: int) -> dict:
    language = info.split()[0] if info.split() else None
    return make("code_fence", f"code-fence:{start}:{count}", line=start, end=end, name=language, closed=closed, fence=fence[:3], fence_length=len(fence), info_string=info, language=language, section_anchor=at, page_key=page)
