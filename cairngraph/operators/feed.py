"""RSS, Atom and JSON feeds: channel, items, links, enclosures, authors and categories. Content is only summarised."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime
from xml.etree import ElementTree

from cairngraph.functions import keys as K
from cairngraph.operators.base import Context, observation, redact_url, reference_target, secret_text, summary
from cairngraph.operators.config import unsafe_xml

NAME = "cairn-feed"
MODE = "stdlib-elementtree-prescan-no-external-entities"


def date(v: str | None) -> str | None:
    """RFC 822 or ISO, as UTC."""
    if not v or not v.strip():
        return None
    for read in (datetime.fromisoformat, parsedate_to_datetime):
        try:
            d = read(v.strip())
        except (ValueError, TypeError):
            continue
        return (d if d.tzinfo else d.replace(tzinfo=UTC)).astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    return None


def without_tags(v: str) -> str:
    return re.sub(r"(?s)<[^>]*>", " ", re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", " ", v))


def _read_xml(content: str) -> tuple[str, dict, list[dict]] | None:
    root = ElementTree.fromstring(content.encode())
    name = lambda e: e.tag.rpartition("}")[2].lower()
    kids = lambda e, n: [k for k in e if name(k) == n]
    text = lambda e, *ns: next((t for n in ns for k in kids(e, n) if (t := "".join(k.itertext()).strip())), None)
    if name(root) == "rss":
        fmt, top = "rss", next(iter(kids(root, "channel")), None)
        items = kids(top, "item") if top is not None else []
    elif name(root) == "feed":
        fmt, top, items = "atom", root, kids(root, "entry")
    elif name(root) == "rdf":
        fmt, top, items = "rss", next(iter(kids(root, "channel")), None), kids(root, "item")
    else:
        return None
    if top is None:
        return None

    def one(e: ElementTree.Element) -> dict:
        links = [(k.get("href") or (k.text or "").strip(), k.get("rel") or ("alternate" if fmt == "atom" else None), k.get("type"), "href" if k.get("href") else None) for k in kids(e, "link")]
        enclosed = [(k.get("url") or "", k.get("type"), k.get("length")) for k in kids(e, "enclosure")] + [(h, t, None) for h, r, t, _ in links if r == "enclosure"]
        authors = [text(k, "name") or "".join(k.itertext()).strip() for n in ("author", "creator") for k in kids(e, n)]
        categories = [k.get("term") or "".join(k.itertext()).strip() for n in ("category", "subject") for k in kids(e, n)]
        return {"id": text(e, "guid", "id"), "title": text(e, "title"), "links": [x for x in links if x[0] and x[1] != "enclosure"], "enclosures": [x for x in enclosed if x[0]], "authors": [a for a in authors if a], "categories": [c for c in categories if c],
                "published": date(text(e, "pubdate", "published", "date")), "updated": date(text(e, "updated", "lastbuilddate")), "content": [(n, t) for n in ("description", "summary", "content", "encoded") if (t := text(e, n))]}

    return fmt, one(top), [one(i) for i in items]


def _read_json(content: str) -> tuple[str, dict, list[dict]] | None:
    v = json.loads(content)
    if not isinstance(v, dict) or "jsonfeed" not in str(v.get("version", "")):
        return None
    people = lambda o: [a.get("name") for a in [*(o.get("authors") or []), *([o["author"]] if isinstance(o.get("author"), dict) else [])] if isinstance(a, dict) and a.get("name")]
    link = lambda o, *ns: [(o[n], r, None, n) for n, r in ns if isinstance(o.get(n), str) and o[n]]
    top = {"id": v.get("feed_url"), "title": v.get("title"), "links": link(v, ("home_page_url", "alternate"), ("feed_url", "self")), "enclosures": [], "authors": people(v), "categories": [], "published": None, "updated": None, "content": []}
    items = [{"id": str(i["id"]) if i.get("id") is not None else None, "title": i.get("title"), "links": link(i, ("url", "alternate"), ("external_url", "related")),
              "enclosures": [(a.get("url"), a.get("mime_type"), a.get("size_in_bytes")) for a in i.get("attachments") or [] if isinstance(a, dict) and a.get("url")], "authors": people(i), "categories": list(i.get("tags") or []),
              "published": date(i.get("date_published")), "updated": date(i.get("date_modified")), "content": [(n, i[n]) for n in ("summary", "content_text", "content_html") if isinstance(i.get(n), str)]} for i in v.get("items") or [] if isinstance(i, dict)]
    return "json-feed", top, items


def identity(item: dict, ordinal: int) -> tuple[str, str, str]:
    """(identity, where it is from, how strong)."""
    if item["id"]:
        return f"id:{item['id']}", "id", "strong"
    if item["links"]:
        return f"link:{item['links'][0][0]}", "link", "strong"
    if item["title"] and (when := item["published"] or item["updated"]):
        return f"title-date:{item['title']}:{when}", "title-date", "weak"
    return f"ordinal:{ordinal}", "ordinal", "structural"


def extract(path: str, content: str, context: Context) -> Iterator[dict]:
    wrong = lambda kind, message: observation("feed.parse_error", path, f"feed-parse-error:{kind}", NAME, "unknown", error_kind=kind, message_summary=message, recovered=False)
    is_json = path.endswith(".json")
    if not is_json and unsafe_xml(content):
        yield wrong("unsafe-xml", "DOCTYPE, ENTITY or processing instruction")
        return
    try:
        read = _read_json(content) if is_json else _read_xml(content)
    except (ElementTree.ParseError, ValueError) as e:
        yield wrong("malformed-feed", str(e)[:160])
        return
    if read is None:
        yield wrong("not-a-feed", "no known feed format")
        return
    fmt, top, items = read
    make = lambda kind, source, /, **kw: observation(f"feed.{kind}", path, source, NAME, "extracted", feed_format=fmt, **kw)
    document = K.within("feed.document", path)
    yield make("document", "feed-document", name=path.rpartition("/")[2], target=document, parser=NAME, parser_mode=MODE, top_level_type=fmt)
    self_link = next((x[0] for x in top["links"] if x[1] == "self"), None)
    first = self_link or (top["links"][0][0] if top["links"] else None)
    mark, source, strength = (f"self:{self_link}", "self-link", "strong") if self_link else (f"link:{first}", "link", "strong") if first else (f"title:{top['title']}", "title", "weak") if top["title"] else ("ordinal:1", "ordinal", "structural")
    channel = K.key("feed.channel", document, mark)
    yield make("channel", "feed-channel", name=top["title"], target=channel, document_key=document, source_key=document, identity_source=source, identity_strength=strength, title=top["title"], updated_at=top["updated"] or top["published"])
    yield from _parts(make, path, top, channel, "channel", "channel", None)
    marks = [identity(i, n) for n, i in enumerate(items, 1)]
    times = Counter(m[0] for m in marks)
    seen: Counter = Counter()
    for n, (item, (mark, source, strength)) in enumerate(zip(items, marks, strict=True), 1):
        twice = times[mark] > 1
        if twice:
            seen[mark] += 1
            mark = f"{mark}:duplicate-{seen[mark]}"
        key = K.key("feed.item", channel, mark)
        yield make("item", f"feed-item:{n}", name=item["title"], target=key, channel_key=channel, source_key=channel, identity_source=source, identity_strength=strength, duplicate_identity=True if twice else None,
                   duplicate_disambiguator=mark.rpartition(":")[2] if twice else None, title=item["title"], published_at=item["published"], updated_at=item["updated"])
        yield from _parts(make, path, item, key, f"item:{n}", "item", channel)


def _parts(make, path: str, item: dict, key: str, at: str, scope: str, channel: str | None) -> Iterator[dict]:
    for i, (href, rel, mime, attribute) in enumerate(item["links"]):
        target, kind, _ = reference_target(path, href)
        yield make("link", f"feed-link:{at}:{i}", name=redact_url(href), target=target, attribute=attribute, rel=rel, mime_type=mime, not_fetched=True, raw_target_summary=redact_url(href)[:160], scope=scope, source_key=key, target_kind=kind)
    for i, (href, mime, length) in enumerate(item["enclosures"]):
        target, kind, _ = reference_target(path, href)
        yield make("enclosure", f"feed-enclosure:{at}:{i}", name=redact_url(href), target=target, mime_type=mime, length=length, not_fetched=True, raw_target_summary=redact_url(href)[:160], scope=scope, source_key=key, target_kind=kind)
    for i, a in enumerate(item["authors"]):
        hidden = "@" in a
        shown = re.sub(r"\S+@\S+", "<redacted>", a).strip("() ") if hidden else a
        owner = channel or key
        yield make("author", f"feed-author:{at}:{i}", name=shown, target=K.key("feed.author", owner, shown), channel_key=owner, source_key=owner, item_key=key if channel else None, email_redacted=hidden)
    for i, c in enumerate(item["categories"]):
        owner = channel or key
        yield make("category", f"feed-category:{at}:{i}", name=c, target=K.key("feed.category", owner, c), channel_key=owner, source_key=owner, item_key=key if channel else None)
    for i, (kind, text) in enumerate(item["content"]):
        hidden = secret_text(text)
        yield make("content", f"feed-content:{at}:{i}", content_kind=kind, content_policy="summarized-not-rendered", item_key=key, original_length=len(text), redacted=hidden, value_summary=None if hidden else summary(without_tags(text)))
