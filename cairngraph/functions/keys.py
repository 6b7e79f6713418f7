"""Canonical keys: `namespace:segment:segment`, file keys `file:part/part`.

Plain Python functions for parsers and rules, and Column functions that build the same keys inside
the JVM. Segments are UTF-8 with everything but A-Z a-z 0-9 - . _ ~ percent-encoded in upper case.
"""

from __future__ import annotations

import hashlib
import json
import re
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_VERSION = 1

# Segments that each namespace has, by their number.
ARITY = {
    n: k
    for k, names in {
        1: "tool env host.category python.module doc.page doc.adr doc.skill external.url config.document css.document html.document xml.document"
        " feed.document warc.document document.file ruby.file ruby.module ruby.class js.file js.module email.mailbox email.address",
        2: "python.class python.function nix.output doc.section config.path css.rule css.selector css.custom_property html.element html.anchor xml.element"
        " feed.channel feed.item feed.author feed.category warc.record document.section document.table document.sheet document.column document.latex_command"
        " ruby.method ruby.singleton_method ruby.constant ruby.test_case ruby.test_method ruby.route js.function js.class js.method js.variable js.component"
        " js.test_suite js.test_case js.route email.message email.part email.attachment_stub email.thread_hint dynamic external unknown",
        3: "python.method nix.app nix.package nix.devShell nix.check xml.attribute",
    }.items()
    for n in names.split()
}

_PLAIN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~")
_IS_PLAIN = re.compile(r"[A-Za-z0-9._~-]+").fullmatch  # most segments are, and are their own encoding
_HEX = frozenset("0123456789ABCDEF")
EMPTY_JSON_SHA256 = hashlib.sha256(b"{}").hexdigest()


# What is wrong with a key, as diagnostics say it.
PROBLEMS = {
    "no_segment": "canonical key segment is required",
    "bad_escape": "malformed percent escape",
    "lower_escape": "percent escapes must use uppercase hex digits",
    "bad_text": "percent-encoded segment is not valid UTF-8",
    "no_path": "file path is required",
    "absolute_path": "file path must not be absolute",
    "escaping_path": "file path must not escape the repository",
    "no_string": "canonical key must be a string",
    "no_key": "canonical key is required",
    "no_separator": "canonical key must include a namespace separator",
    "no_key_path": "file key requires a path",
    "empty_component": "file key path must not contain empty components",
    "not_normal": "file key path must be normalized",
    "escaping_key": "file key path must not escape the repository",
}


class KeyProblem(ValueError):
    """A key that cannot be built or read; category is that of its diagnostic."""

    def __init__(self, message: str, category: str = "invalid_canonical_key") -> None:
        super().__init__(message)
        self.category = category


def encode(segment: str) -> str:
    if not isinstance(segment, str) or not segment:
        raise KeyProblem(PROBLEMS["no_segment"])
    return segment if _IS_PLAIN(segment) else quote(segment, safe="-._~")


def decode(segment: str) -> str:
    if not segment:
        raise KeyProblem(PROBLEMS["no_segment"])
    if _IS_PLAIN(segment):
        return segment
    out, i = bytearray(), 0
    while i < len(segment):
        c = segment[i]
        if c == "%":
            pair = segment[i + 1 : i + 3]
            if len(pair) < 2:
                raise KeyProblem(PROBLEMS["bad_escape"], "malformed_percent_escape")
            if pair != pair.upper():
                raise KeyProblem(PROBLEMS["lower_escape"], "malformed_percent_escape")
            if not set(pair) <= _HEX:
                raise KeyProblem(PROBLEMS["bad_escape"], "malformed_percent_escape")
            out.append(int(pair, 16))
            i += 3
        elif c in _PLAIN:
            out.append(ord(c))
            i += 1
        else:
            raise KeyProblem(f"reserved character {c!r} must be percent-encoded", "malformed_percent_escape")
    try:
        return out.decode()
    except UnicodeDecodeError as e:
        raise KeyProblem(PROBLEMS["bad_text"], "malformed_percent_escape") from e


def normal_path(path: str) -> list[str]:
    """The parts of a path inside the repository; [`.`] for its top."""
    if not isinstance(path, str) or not path:
        raise KeyProblem(PROBLEMS["no_path"])
    path = path.replace("\\", "/")
    if path.startswith("/"):
        raise KeyProblem(PROBLEMS["absolute_path"])
    parts: list[str] = []
    for p in path.split("/"):
        if p == "..":
            if not parts:
                raise KeyProblem(PROBLEMS["escaping_path"], "repo_escaping_path")
            parts.pop()
        elif p not in ("", "."):
            parts.append(p)
    return parts or ["."]


def file_key(path: str) -> str:
    return "file:" + "/".join(map(encode, normal_path(path)))


def key(namespace: str, *segments: str) -> str:
    if ARITY[namespace] != len(segments):
        raise KeyProblem(f"{namespace} keys require {ARITY[namespace]} segments")
    return ":".join([namespace, *map(encode, segments)])


def within(namespace: str, path_or_key: str, *rest: str) -> str:
    """A key whose first segment is a file key (given as such, or as a path)."""
    parent = path_or_key
    if parent.startswith("file:"):
        parse(parent)
    else:
        parent = file_key(parent)
    return key(namespace, parent, *rest)


def dynamic(domain: str, reason: str) -> str:
    return key("dynamic", domain, reason)


def external(domain: str, name: str) -> str:
    return key("external", domain, name)


def unknown(domain: str, reason: str) -> str:
    return key("unknown", domain, reason)


def parse(text: str) -> tuple[str, tuple[str, ...]]:
    """(namespace, decoded segments), or KeyProblem."""
    if not isinstance(text, str):
        raise KeyProblem(PROBLEMS["no_string"])
    if not text:
        raise KeyProblem(PROBLEMS["no_key"])
    namespace, colon, rest = text.partition(":")
    if not colon:
        raise KeyProblem(PROBLEMS["no_separator"])
    if namespace == "file":
        if not rest:
            raise KeyProblem(PROBLEMS["no_key_path"])
        raw = rest.split("/")
        if "" in raw:
            raise KeyProblem(PROBLEMS["empty_component"])
        parts = tuple(map(decode, raw))
        if parts != (".",) and "." in parts:
            raise KeyProblem(PROBLEMS["not_normal"])
        if ".." in parts:
            raise KeyProblem(PROBLEMS["escaping_key"], "repo_escaping_path")
        return namespace, parts
    if namespace not in ARITY:
        raise KeyProblem(f"unknown canonical key namespace: {namespace}")
    raw = rest.split(":")
    if len(raw) != ARITY[namespace]:
        raise KeyProblem(f"{namespace} keys require {ARITY[namespace]} segments")
    return namespace, tuple(map(decode, raw))


def is_key(text: str | None) -> bool:
    try:
        parse(text)
    except KeyProblem:
        return False
    return True


def edge_key(source: str, kind: str, target: str) -> str:
    """Edges have no identity besides version, ends and kind."""
    body = {"graph_key_version": KEY_VERSION, "identity_metadata": {}, "kind": kind, "source_key": source, "target_key": target}
    return "canonical-edge:" + hashlib.sha256(canonical_json(body).encode()).hexdigest()


_CANONICAL = json.JSONEncoder(sort_keys=True, separators=(",", ":"))


def canonical_json(value: object) -> str:
    """Sorted keys, ASCII escapes, no blanks: what hashes are taken of."""
    return _CANONICAL.encode(value)


# --- Column functions -----------------------------------------------------------------------


def encode_col(c: Column | str) -> Column:
    """encode() inside the JVM: url_encode with its form-encoding habits undone."""
    c = F.col(c) if isinstance(c, str) else c
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def key_col(namespace: str, *segments: Column) -> Column:
    if ARITY[namespace] != len(segments):
        raise KeyProblem(f"{namespace} keys require {ARITY[namespace]} segments")
    return F.concat_ws(":", F.lit(namespace), *(encode_col(s) for s in segments))


def normal_path_col(path: Column) -> Column:
    """The normal parts of a path as an array; null where it is empty, absolute or escapes."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    folded = F.aggregate(
        parts,
        F.struct(F.lit(True).alias("ok"), F.array().cast("array<string>").alias("p")),
        lambda a, p: F.when(
            p == "..",
            F.struct((a["ok"] & (F.size(a["p"]) > 0)).alias("ok"), F.slice(a["p"], F.lit(1), F.greatest(F.size(a["p"]) - 1, F.lit(0))).alias("p")),
        ).otherwise(F.struct(a["ok"].alias("ok"), F.concat(a["p"], F.array(p)).alias("p"))),
        lambda a: F.when(a["ok"], F.when(F.size(a["p"]) > 0, a["p"]).otherwise(F.array(F.lit(".")))),
    )
    return F.when((path != "") & ~F.replace(path, F.lit("\\"), F.lit("/")).startswith("/"), folded)


def file_key_col(path: Column | str) -> Column:
    path = F.col(path) if isinstance(path, str) else path
    return F.concat(F.lit("file:"), F.array_join(F.transform(normal_path_col(path), lambda p: encode_col(p)), "/"))


def edge_key_col(source: Column, kind: Column, target: Column) -> Column:
    """Keys hold no quote, backslash or non-ASCII character, so their JSON form is themselves."""
    body = F.concat(
        F.lit(f'{{"graph_key_version":{KEY_VERSION},"identity_metadata":{{}},"kind":"'), kind, F.lit('","source_key":"'), source, F.lit('","target_key":"'), target, F.lit('"}')
    )
    return F.concat(F.lit("canonical-edge:"), F.sha2(body, 256))


def kind_of_key(k: Column) -> Column:
    return F.substring_index(k, ":", 1)


def name_of_key(k: Column) -> Column:
    """The last segment, still encoded."""
    return F.substring_index(k, ":", -1)
