"""A conservative YAML reader: block mappings and sequences, plain and quoted scalars, literal and folded
text, one-line flow collections, comments, several documents. Anything else is an error with its line: tags
that make objects, merge keys, complex keys and tabs for indentation are not interpreted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

# Limits of a file.
MOST_BYTES, MOST_DOCUMENTS, MOST_NODES, MOST_DEPTH = 1 << 20, 64, 25_000, 64

_KEY = re.compile(r"""((?:"(?:[^"\\]|\\.)*")|(?:'(?:[^']|'')*')|[^\s#&*!|>@`"'{}\[\],?:-][^#]*?|-[^\s#][^#]*?|[?:][^\s#][^#]*?)\s*:(?=\s|$)""")


class YamlProblem(ValueError):
    def __init__(self, line: int, message: str) -> None:
        super().__init__(f"line {line}: {message}")
        self.lineno = line


def _comment_off(s: str) -> str:
    """The line without a comment that is not inside quotes."""
    quote = ""
    for i, c in enumerate(s):
        if quote:
            if c == quote and not (quote == '"' and s[i - 1] == "\\"):
                quote = ""
        elif c in "\"'":
            quote = c if i == 0 or s[i - 1] in " [{,:-\t" else ""
        elif c == "#" and (i == 0 or s[i - 1] in " \t"):
            return s[:i].rstrip()
    return s.rstrip()


class _Reader:
    def __init__(self, lines: list[tuple[int, int, str]]) -> None:
        self.lines, self.at, self.nodes = lines, 0, 0

    def fail(self, message: str) -> YamlProblem:
        n = self.lines[min(self.at, len(self.lines) - 1)][0] if self.lines else 1
        return YamlProblem(n, message)

    def block(self, indent: int, depth: int) -> object:
        if depth > MOST_DEPTH:
            raise self.fail("too deep")
        _, here, text = self.lines[self.at]
        if text.startswith("- ") or text == "-":
            return self.sequence(here, depth)
        if _KEY.match(text):
            return self.mapping(here, depth)
        parts = []
        while self.at < len(self.lines) and self.lines[self.at][1] >= indent:
            parts.append(self.lines[self.at][2])
            self.at += 1
        return self.scalar(" ".join(parts))

    def count(self) -> None:
        self.nodes += 1
        if self.nodes > MOST_NODES:
            raise self.fail("too many nodes")

    def sequence(self, indent: int, depth: int) -> list:
        out: list = []
        while self.at < len(self.lines) and self.lines[self.at][1] == indent and (self.lines[self.at][2].startswith("- ") or self.lines[self.at][2] == "-"):
            n, _, text = self.lines[self.at]
            self.count()
            rest = text[1:].lstrip()
            if not rest:
                self.at += 1
                out.append(self.block(indent + 1, depth + 1) if self.deeper(indent) else None)
            elif _KEY.match(rest) or rest.startswith("- "):
                inner = indent + len(text) - len(rest)
                self.lines[self.at] = (n, inner, rest)
                out.append(self.block(inner, depth + 1))
            else:
                out.append(self.value(rest, indent))
        if self.at < len(self.lines) and self.lines[self.at][1] > indent:
            raise self.fail("unexpected indentation")
        return out

    def deeper(self, indent: int, same_list: bool = False) -> bool:
        if self.at >= len(self.lines):
            return False
        _, here, text = self.lines[self.at]
        return here > indent or (same_list and here == indent and (text.startswith("- ") or text == "-"))

    def mapping(self, indent: int, depth: int) -> dict:
        out: dict = {}
        while self.at < len(self.lines) and self.lines[self.at][1] == indent:
            text = self.lines[self.at][2]
            m = _KEY.match(text)
            if not m:
                if text.startswith("- "):
                    break
                raise self.fail("not a mapping entry")
            self.count()
            k, rest = str(self.scalar(m[1])), text[m.end() :].strip()
            if k in out:
                raise self.fail(f"duplicate key {k!r}")
            if k == "<<":
                raise self.fail("merge keys are not interpreted")
            if not rest or re.fullmatch(r"&[\w-]+", rest):
                self.at += 1
                out[k] = self.block(indent if not self.deeper(indent) else indent + 1, depth + 1) if self.deeper(indent, True) else None
            else:
                out[k] = self.value(rest, indent)
        if self.at < len(self.lines) and self.lines[self.at][1] > indent:
            raise self.fail("unexpected indentation")
        return out

    def value(self, rest: str, indent: int) -> object:
        """The value that begins on this line; moves past it."""
        if m := re.fullmatch(r"([|>])([+-]?\d?|\d?[+-]?)", rest):
            self.at += 1
            got: list[tuple[int, str]] = []
            while self.at < len(self.lines) and (self.lines[self.at][1] > indent or not self.lines[self.at][2]):
                got.append(self.lines[self.at][1:])
                self.at += 1
            base = min((i for i, t in got if t), default=0)
            rows = [" " * (i - base) + t if t else "" for i, t in got]
            return ("\n" if m[1] == "|" else " ").join(rows)
        self.at += 1
        parts = [rest]
        while self.at < len(self.lines) and self.lines[self.at][1] > indent and not _open_flow(rest) and rest[0] not in "\"'":
            if _KEY.match(self.lines[self.at][2]):
                raise self.fail("a mapping cannot follow a scalar")
            parts.append(self.lines[self.at][2])
            self.at += 1
        while _open_flow(" ".join(parts)) and self.at < len(self.lines):
            parts.append(self.lines[self.at][2])
            self.at += 1
        return self.scalar(" ".join(parts))

    def scalar(self, s: str) -> object:
        s = re.sub(r"^&[\w-]+\s+", "", s.strip())
        if s.startswith(("!!python", "!!ruby", "!!java")) or re.match(r"![A-Za-z]", s):
            raise self.fail("tags are not interpreted")
        s = re.sub(r"^!!(str|int|float|bool|null)\s+", "", s)
        if s.startswith(("[", "{")):
            got, rest = self.flow(s)
            if rest.strip():
                raise self.fail("text after a flow collection")
            return got
        if s.startswith('"'):
            if not re.fullmatch(r'"(?:[^"\\]|\\.)*"', s):
                raise self.fail("unclosed quote")
            return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda m: {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}.get(m[1], chr(int(m[1][1:], 16)) if m[1][0] == "u" and len(m[1]) == 5 else m[1]), s[1:-1])
        if s.startswith("'"):
            if not re.fullmatch(r"'(?:[^']|'')*'", s):
                raise self.fail("unclosed quote")
            return s[1:-1].replace("''", "'")
        if s in ("", "~", "null", "Null", "NULL"):
            return None
        if s.lower() in ("true", "false"):
            return s.lower() == "true"
        if re.fullmatch(r"[+-]?\d+", s):
            return int(s)
        if re.fullmatch(r"[+-]?(\d+\.\d*|\.\d+)([eE][+-]?\d+)?", s):
            return float(s)
        return s

    def flow(self, s: str) -> tuple[object, str]:
        close, out, s = "]" if s[0] == "[" else "}", [], s[1:].lstrip()
        while not s.startswith(close):
            if not s:
                raise self.fail("unclosed flow collection")
            self.count()
            key = None
            if close == "}":
                m = re.match(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,{}\[\]:]+)\s*(?::\s*|(?=[,}]))""", s)
                if not m:
                    raise self.fail("not a flow mapping")
                key, s = str(self.scalar(m[1])), s[m.end() :]
            if s[:1] in "[{" and s:
                v, s = self.flow(s)
            else:
                m = re.match(r"""\s*("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,\[\]{}]*)""", s)
                v, s = self.scalar(m[1]), s[m.end() :]
            out.append((key, v))
            s = s.lstrip()
            if s.startswith(","):
                s = s[1:].lstrip()
            elif not s.startswith(close):
                raise self.fail("unclosed flow collection")
        return (dict(out) if close == "}" else [v for _, v in out]), s[1:]


def _open_flow(s: str) -> bool:
    if s[:1] not in ("[", "{"):
        return False
    bare = re.sub(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'", "", s)
    return bare.count("[") + bare.count("{") > bare.count("]") + bare.count("}")


def documents(content: str) -> Iterator[object]:
    if len(content) > MOST_BYTES:
        raise YamlProblem(1, "file is too large")
    docs: list[list[tuple[int, int, str]]] = [[]]
    literal: int | None = None
    for n, raw in enumerate(content.splitlines(), 1):
        if re.match(r"---(\s|$)", raw):
            docs.append([])
            raw = "    " + raw[3:] if raw[3:].strip() and not raw[3:].strip().startswith("#") else ""
            literal = None
        if raw.startswith(("...", "%")) and literal is None:
            continue
        indent = len(raw) - len(raw.lstrip(" "))
        if literal is not None and (not raw.strip() or indent > literal):
            docs[-1].append((n, indent, raw.strip(" ")))
            continue
        literal = None
        text = _comment_off(raw.strip(" "))
        if text.startswith("\t"):
            raise YamlProblem(n, "tab in indentation")
        if text:
            docs[-1].append((n, indent, text))
            if re.search(r"(?:^|[:-]\s+)[|>][+-]?\d?$", text):
                literal = indent
    if len(docs) > MOST_DOCUMENTS + 1:
        raise YamlProblem(1, "too many documents")
    for lines in docs:
        while lines and not lines[-1][2]:
            lines.pop()
        if lines:
            r = _Reader(lines)
            value = r.block(lines[0][1], 0)
            if r.at < len(lines):
                raise r.fail("unexpected text")
            yield value
