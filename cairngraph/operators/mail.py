"""Mail: messages, mailboxes, parts and attachments. Bodies, subjects and addresses are only hashed or counted."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from email import message_from_bytes, policy
from email.headerregistry import BaseHeader
from email.message import EmailMessage
from email.utils import getaddresses
from functools import lru_cache

from cairngraph.functions import keys as K
from cairngraph.operators.base import Context, observation, redact_url
from cairngraph.operators.feed import date

NAME = "cairn-email"
PARSER = "stdlib-email"
# Limits of mailboxes and messages.
MOST_BYTES, MOST_MESSAGES, MOST_PARTS = 10 << 20, 1000, 200
ROLES = ("from", "to", "cc", "bcc", "reply-to", "sender", "return-path")

#: Longest header that a process remembers: a message's are asked for again and again, and many messages share theirs.
MEMO_CHARACTERS = 500
_remembered = lru_cache(4096)(policy.default.header_factory)


def _header(name: str, value: str) -> BaseHeader:
    return (_remembered if len(value) <= MEMO_CHARACTERS else policy.default.header_factory)(name, value)


POLICY = policy.default.clone(header_factory=_header)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogateescape")).hexdigest()


def normal_address(address: str) -> str | None:
    local, at, domain = address.strip().rpartition("@")
    return f"{local.lower()}@{domain.lower()}" if at and local and domain else None


def _identity(m: EmailMessage, raw: bytes) -> tuple[str, str | None]:
    """(strength, hash): of the one valid message id, else of the structure."""
    ids = [i for i in (m.get_all("message-id") or []) if re.fullmatch(r"\s*<[^<>\s]+@[^<>\s]+>\s*", str(i))]
    if len(ids) == 1 and len(m.get_all("message-id") or []) == 1:
        return "message", sha(str(ids[0]).strip())
    parts = [str(m.get(h, "")) for h in ("date", "from", "to")]
    return "structural", sha("|".join([*parts, str(len(raw))]))


def message(path: str, raw: bytes, fmt: str, ordinal: int | None = None) -> Iterator[dict]:
    make = lambda kind, source, /, **kw: observation(f"email.{kind}", path, source, NAME, kw.pop("confidence", "extracted"), format=fmt, parser=PARSER, **kw)
    tag = f":{ordinal}" if ordinal else ""
    if len(raw) > MOST_BYTES:
        yield make("parse_error", f"email-parse-error{tag}:size", confidence="unknown", error_kind="message-size-limit", recovered=True)
        return
    m = message_from_bytes(raw, policy=POLICY)
    if not list(m.keys()):
        yield make("parse_error", f"email-parse-error{tag}:malformed", confidence="unknown", error_kind="malformed-message", recovered=True)
        return
    strength, digest = _identity(m, raw)
    key = K.within("email.message", path, f"{strength}:{digest}")
    parts = [p for p in m.walk() if not p.is_multipart()]
    kinds = [p.get_content_type() for p in parts]
    attached = [p for p in parts if p.get_content_disposition() == "attachment" or p.get_filename()]
    everyone = {r: [a for _, a in getaddresses([str(v) for v in m.get_all(r) or []])] for r in ROLES}
    subject = str(m["subject"]) if m["subject"] is not None else None
    when = date(str(m["date"])) if m["date"] else None
    mailbox = K.within("email.mailbox", path) if fmt == "mbox" else None
    yield make("message", f"email-message{tag}:{digest[:16]}", name="email message", target=key, source_key=mailbox, mailbox_file_key=K.file_key(path) if mailbox else None, mbox_message_ordinal=ordinal,
               mbox_message_identity=f"{strength}:{digest}" if ordinal else None, message_id_hash=digest if strength == "message" else None, message_id_present=m["message-id"] is not None, message_id_valid=strength == "message",
               date=when, date_parse_status="parsed" if when else "missing" if m["date"] is None else "malformed", subject_present=subject is not None, subject_hash=sha(subject) if subject else None,
               **{f"{r.replace('-', '_')}_count": len(v) for r, v in everyone.items()}, text_plain_part_count=kinds.count("text/plain"), text_html_part_count=kinds.count("text/html"), attachment_count=len(attached),
               has_text_plain="text/plain" in kinds, has_text_html="text/html" in kinds, has_attachments=bool(attached), redacted=True, redaction_reason="email-content-omitted", identity_strength="message_id" if strength == "message" else strength)
    for role, addresses in everyone.items():
        for a in addresses:
            if normal := normal_address(a):
                h = sha(normal)
                yield make("address", f"email-address{tag}:{role}:{h[:16]}", target=K.key("email.address", f"addrhash:{h}"), source_key=key, address_role=role, address_hash=h, address_domain=normal.rpartition("@")[2], redacted=True, redaction_reason="address-hashed", not_fetched=True)
    for i, p in enumerate(parts[:MOST_PARTS], 1):
        where, body = f"/parts/{i}", p.get_payload(decode=True) or b""
        kind = "attachment_stub" if p in attached else "part"
        pointer = f"/attachments/{i}" if kind == "attachment_stub" else where
        name = p.get_filename()
        extra = {"attachment_byte_count": len(body), "attachment_filename_hash": sha(name) if name else None, "attachment_mime_type": p.get_content_type()} if kind == "attachment_stub" else {"part_byte_count": len(body), "charset": p.get_content_charset(), "part_index": i, "mime_type": p.get_content_type()}
        yield make(kind, f"email-{kind}{tag}:{i}", name=pointer, target=K.key(f"email.{kind}", key, pointer), source_key=key, part_path=where, content_type=p.get_content_type(), content_disposition=p.get_content_disposition(),
                   inline=p.get_content_disposition() == "inline", content_id_present=p["content-id"] is not None, redacted=True, redaction_reason="body-content-omitted", **extra)
    if len(parts) > MOST_PARTS:
        yield make("parse_error", f"email-parse-error{tag}:parts", confidence="unknown", error_kind="part-count-limit", recovered=True)
    for hint, header in (("in_reply_to", "in-reply-to"), ("references", "references")):
        for i, ref in enumerate(re.findall(r"<[^<>\s]+>", str(m.get(header, ""))), 1):
            yield make("thread_hint", f"email-thread{tag}:{hint}:{i}", name=hint, target=K.key("email.thread_hint", key, f"/thread/{hint}/{i}"), source_key=key, thread_hint_kind=hint, reference_kind=hint, referenced_message_id_hash=sha(ref), identity_strength="message-id-reference", not_fetched=True)
    for i, url in enumerate(re.findall(r"<(https?://[^<>\s]+)>", str(m.get("list-unsubscribe", ""))), 1):
        yield make("reference", f"email-reference{tag}:{i}", target=K.key("external.url", redact_url(url)), source_key=key, reference_kind="list_unsubscribe", raw_value_summary=redact_url(url)[:160], not_fetched=True, redacted=redact_url(url) != url)
    for i, d in enumerate(m.defects):
        yield make("parse_error", f"email-parse-error{tag}:defect:{i}", confidence="unknown", error_kind=f"malformed-{type(d).__name__}", recovered=True)


def unescaped(body: bytes) -> bytes:
    """A message of a mailbox without the mark before its lines that look like separators."""
    return re.sub(rb"(?m)^>(>*From )", rb"\1", body)


def mbox(path: str, content: bytes) -> Iterator[dict]:
    make = lambda kind, source, /, **kw: observation(f"email.{kind}", path, source, NAME, kw.pop("confidence", "extracted"), format="mbox", parser=PARSER, **kw)
    starts = [m.end() for m in re.finditer(rb"(?m)^From [^\n]*\n", content)]
    heads = [m.start() for m in re.finditer(rb"(?m)^From [^\n]*\n", content)]
    status, reason = "parsed", None
    if content.strip() and (not heads or content[: heads[0]].strip()):
        status = "malformed"
        yield make("parse_error", "email-parse-error:mbox", confidence="unknown", error_kind="mbox-missing-from-separator", recovered=bool(heads))
    if len(starts) > MOST_MESSAGES:
        status, reason = "limited", "message-count-limit"
        yield make("parse_error", "email-parse-error:mbox-limit", confidence="unknown", error_kind="mbox-message-count-limit", recovered=True)
    n = min(len(starts), MOST_MESSAGES)
    yield make("mailbox", "email-mailbox", name="email mailbox", target=K.within("email.mailbox", path), mailbox_message_count=n, mailbox_message_count_limited=len(starts) > MOST_MESSAGES, mailbox_byte_count=len(content),
               mailbox_parse_status=status, mailbox_limit_reason=reason, mailbox_digest=hashlib.sha256(content).hexdigest(), identity_strength="file_key")
    for i in range(n):
        yield from message(path, unescaped(content[starts[i] : heads[i + 1] if i + 1 < len(heads) else len(content)]), "mbox", i + 1)


def extract(path: str, content: bytes, context: Context) -> Iterator[dict]:
    yield from mbox(path, content) if path.endswith(".mbox") else message(path, content, "eml")
