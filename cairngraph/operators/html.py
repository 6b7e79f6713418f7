"""HTML by a recovering parser: elements with pointers, headings, links, assets and forms. Nothing is rendered."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

from cairngraph.functions import keys as K
from cairngraph.operators.base import Context, observation, reference_target, secret_name, summary

NAME = "cairn-html"
PARSER, MODE = "stdlib-htmlparser", "static-recovering-no-render-no-js"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASSETS = {"img": "src", "script": "src", "link": "href", "source": "src", "video": "src", "audio": "src", "iframe": "src", "embed": "src", "object": "data"}


@dataclass
class Element:
    tag: str
    pointer: str
    line: int
    attributes: dict[str, str]
    children: Counter = field(default_factory=Counter)
    child_count: int = 0
    text: list[str] = field(default_factory=list)
    parent: Element | None = None


class Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.top = Element("", "", 0, {})
        self.stack, self.elements, self.problems, self.doctype = [self.top], [], [], None

    def handle_decl(self, decl: str) -> None:
        if decl.lower().startswith("doctype"):
            self.doctype = decl

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        parent = self.stack[-1]
        parent.child_count += 1
        parent.children[tag] += 1
        n = parent.children[tag]
        e = Element(tag, f"{parent.pointer}/{tag}" + (f"[{n}]" if n > 1 else ""), self.getpos()[0], {k: v or "" for k, v in attrs}, parent=parent)
        self.elements.append(e)
        if tag not in VOID:
            self.stack.append(e)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.stack.pop()

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.stack) - 1, 0, -1) if self.stack[i].tag == tag), None)
        if at is None:
            if tag not in VOID:
                self.problems.append(("unmatched-end-tag", tag, self.getpos()[0]))
            return
        self.problems += [("unclosed-element", e.tag, e.line) for e in self.stack[at + 1 :]]
        del self.stack[at:]

    def handle_data(self, data: str) -> None:
        if data.strip() and not any(e.tag in ("script", "style") for e in self.stack):
            e: Element | None = self.stack[-1]
            while e is not None and e is not self.top:
                e.text.append(data)
                e = e.parent


def parsed(content: str) -> Tree:
    t = Tree()
    t.feed(content)
    t.close()
    t.problems += [("unclosed-element", e.tag, e.line) for e in t.stack[1:]]
    return t


def _hidden(e: Element) -> bool:
    return e.attributes.get("type", "").lower() == "password" or any(secret_name(e.attributes.get(a, "")) for a in ("name", "id") if e.attributes.get(a))


def link_key(path: str, value: str, ids: Counter) -> tuple[str, str, str]:
    if value.startswith("#"):
        mark = value[1:]
        if not mark:
            return K.within("html.document", path), "html.document", "empty-fragment"
        if ids[mark] == 1:
            return K.within("html.anchor", path, mark), "html.anchor", "same-document-fragment"
        return K.unknown("html.anchor", "ambiguous-fragment" if ids[mark] else "missing-fragment"), "unknown", "ambiguous-fragment" if ids[mark] else "missing-fragment"
    return reference_target(path, value, "{{")


def extract(path: str, content: str, context: Context) -> Iterator[dict]:
    t = parsed(content)
    ids = Counter(e.attributes["id"] for e in t.elements if e.attributes.get("id"))
    make = lambda kind, source, /, **kw: observation(f"html.{kind}", path, source, NAME, kw.pop("confidence", "heuristic"), format="html", parser=PARSER, parser_mode=MODE, **kw)
    key = lambda e: K.within("html.element", path, e.pointer)
    title = next((summary("".join(e.text)) for e in t.elements if e.tag == "title"), None)
    root = t.elements[0] if t.elements else None
    document = K.within("html.document", path)
    yield make("document", "html-document", target=document, title=title, doctype=t.doctype, root_element=root.tag if root else None, language=root.attributes.get("lang") if root else None,
               element_count=len(t.elements), anchor_count=len(ids), parse_warning_count=len(t.problems))
    for e in t.elements:
        hidden = _hidden(e)
        i = e.attributes.get("id") or None
        yield make("element", f"html-element:{e.pointer}", line=e.line, name=e.pointer, target=key(e), tag=e.tag, pointer=e.pointer, id=None if hidden else i, id_is_unique=ids[i] == 1 if i and not hidden else None,
                   classes=e.attributes.get("class", "").split() or None, attribute_count=len(e.attributes), child_count=e.child_count, text_summary=None if hidden else summary(" ".join(e.text)),
                   structural_identity="document-pointer-with-sibling-indexes", redacted=True if hidden else None, redaction_reason="secret-prone-html-attribute" if hidden else None)
    for e in t.elements:
        if len(e.tag) == 2 and e.tag[0] == "h" and e.tag[1] in "123456":
            i = e.attributes.get("id") or None
            target = K.within("html.anchor", path, i) if i and ids[i] == 1 else key(e)
            yield make("heading", f"html-heading:{e.pointer}", line=e.line, name=e.pointer, target=target, heading_level=int(e.tag[1]), source_element_pointer=e.pointer, source_element_key=key(e), id=i,
                       id_is_unique=ids[i] == 1 if i else None, text_summary=summary(" ".join(e.text)))
        kind, name = ("link", "href") if e.tag in ("a", "area") else ("form", "action") if e.tag == "form" else ("asset", ASSETS.get(e.tag))
        value = e.attributes.get(name or "")
        if name is None or value is None:
            continue
        target, what, reason = link_key(path, value, ids)
        fields = {"field_count": sum(x.tag in ("input", "select", "textarea", "button") and x.pointer.startswith(e.pointer + "/") for x in t.elements), "method": (e.attributes.get("method") or "get").lower()} if kind == "form" else {}
        yield make(kind, f"html-{kind}:{e.pointer}:{name}", line=e.line, name=e.pointer, target=target, attribute=name, tag=e.tag, pointer=e.pointer, source_element_pointer=e.pointer, source_key=key(e),
                   raw_value_summary=summary(value, 120), reference_kind=what, resolution_reason=reason, redacted=False, rel=e.attributes.get("rel"), **fields)
    for n, (what, tag, line) in enumerate(t.problems):
        yield make("parse_error", f"html-parse-error:{n}", confidence="unknown", line=line, error_kind=what, tag=tag, recovered=True)
