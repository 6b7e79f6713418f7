"""Ruby as masked text: of the same length, line by line, with comments gone and strings, heredocs, percent literals and regular
expressions emptied (their quotes stay), and the words that open and close blocks.

What a pattern finds in the masked text is code; the value of a string that it finds stands at the same place of the original.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

_WORD = re.compile(r"[A-Za-z_]\w*[?!]?|\d[\w.]*|@{1,2}\w+|\$\w+")
_HEREDOC = re.compile(r"<<([~-]?)(?:([\"'`])([^\"'`\n]+)\2|([A-Z_]\w*))")
_PERCENT = re.compile(r"%[wWiIqQrsx]?([^\w\s])")
_CLOSING = {"(": ")", "[": "]", "{": "}", "<": ">"}
#: Words after which an expression begins.
EXPRESSION_AFTER = frozenset("if unless while until and or not return then do else elsif when in case begin yield puts print raise".split())


class Mask:
    """One pass over a text. `value` tells whether what was read last is a value: a slash divides it, a percent sign takes its rest."""

    def __init__(self, text: str) -> None:
        self.text, self.at, self.value = text, 0, False
        self.out = list(text)
        self.heredocs: list[tuple[str, bool]] = []  # terminators of heredocs that begin after this line, and whether these may be indented

    def blank(self, start: int, end: int) -> None:
        for i in range(start, min(end, len(self.out))):
            if self.out[i] != "\n":
                self.out[i] = " "

    def run(self) -> str:
        while self.at < len(self.text):
            self._token()
        return "".join(self.out)

    def _line_end(self, at: int) -> int:
        end = self.text.find("\n", at)
        return len(self.text) if end < 0 else end

    def _token(self) -> None:
        text, i = self.text, self.at
        c = text[i]
        if i == 0 or text[i - 1] == "\n":
            if text.startswith("=begin", i):
                end = re.compile(r"^=end.*$", re.M).search(text, i)
                return self._skip(end.end() if end else len(text))
            if text.startswith("__END__", i) and text[i : self._line_end(i)].strip() == "__END__":
                return self._skip(len(text))
        if c == "\n":
            self.at, self.value = i + 1, False
            self._bodies()
        elif c.isspace():
            self.at += 1
        elif c == "#":
            self._skip(self._line_end(i))
        elif c in "\"'`":
            self._literal(i + 1, c, c, c != "'")
        elif (m := _HEREDOC.match(text, i)) and (m[1] or not self.value):
            self.heredocs.append((m[3] or m[4], bool(m[1])))
            self.blank(i + 2, m.end())
            self.at, self.value = m.end(), True
        elif c == "%" and (m := _PERCENT.match(text, i)) and (not self.value or self._argument(i, m.end())):
            self._literal(m.end(), m[1], _CLOSING.get(m[1], m[1]), m[0][1] not in "qwis")
        elif c == "/" and (not self.value or self._argument(i, i + 1)):
            self._literal(i + 1, "/", "/", True)
        elif c == "?" and not self.value and i + 1 < len(text) and not text[i + 1].isspace() and not re.match(r"\w\w", text[i + 1 : i + 3]):
            self.blank(i + 1, i + 2)
            self.at, self.value = i + 2, True
        elif m := _WORD.match(text, i):
            self.at, self.value = m.end(), m[0] not in EXPRESSION_AFTER or text[i - 1 : i] in (".", ":")
        else:
            self.at, self.value = i + 1, c in ")]}"

    def _argument(self, start: int, after: int) -> bool:
        """A blank before and none after: what begins is an argument, as in `puts /x/`."""
        return self.text[start - 1 : start].isspace() and not self.text[after : after + 1].isspace() and self.text[after : after + 1] != "="

    def _skip(self, end: int) -> None:
        self.blank(self.at, end)
        self.at = end

    def _literal(self, start: int, opening: str, closing: str, escapes: bool) -> None:
        end = self._end_of(start, opening, closing, escapes)
        self.blank(start, end)
        self.at, self.value = min(end + 1, len(self.text)), True

    def _end_of(self, start: int, opening: str, closing: str, interpolates: bool) -> int:
        """Where a literal closes; nested brackets of its own kind count, and the code of `#{ }` is passed over."""
        i, depth = start, 0
        while i < len(self.text):
            c = self.text[i]
            if c == "\\":
                i += 1
            elif interpolates and self.text.startswith("#{", i):
                i = self._end_of_code(i + 2)
            elif c == closing:
                if depth == 0:
                    return i
                depth -= 1
            elif c == opening:
                depth += 1
            i += 1
        return len(self.text)

    def _end_of_code(self, start: int) -> int:
        i, depth = start, 0
        while i < len(self.text):
            c = self.text[i]
            if c in "\"'`":
                j = i + 1
                while j < len(self.text) and self.text[j] != c:
                    j += 2 if self.text[j] == "\\" else 1
                i = j
            elif c == "{":
                depth += 1
            elif c == "}":
                if depth == 0:
                    return i
                depth -= 1
            i += 1
        return len(self.text)

    def _bodies(self) -> None:
        """The bodies of the heredocs of the line that has ended."""
        for word, indented in self.heredocs:
            while self.at < len(self.text):
                end = self._line_end(self.at)
                line = self.text[self.at : end].rstrip("\r")
                self.blank(self.at, end)
                self.at = min(end + 1, len(self.text))
                if (line.strip() if indented else line) == word:
                    break
        self.heredocs = []


def masked(text: str) -> str:
    return Mask(text).run()


_TOKEN = re.compile(r"[A-Za-z_]\w*[?!]?(?::(?!:))?|[^\s\w]|\d\w*")
# Words that open a block wherever they stand, those that do so where a statement or an expression begins (behind one
# they modify it), and those whose `do` belongs to them.
OPENS = frozenset(("module", "class", "def", "case", "begin"))
OPENS_OR_MODIFIES = frozenset(("if", "unless", "while", "until"))
LOOPS = frozenset(("while", "until", "for"))
_BEGINS_AFTER = frozenset("= ( [ { , ; | & ! ? : < > + - * / then do else begin and or not when in".split())
_ENDLESS = re.compile(r"def\s+(?:self\.)?\w+[?!]?\s*(?:\([^)]*\))?\s*=\s")


def block_words(statement: str) -> Iterator[str]:
    """The words of a masked statement that open a block, and `end` for each that closes one."""
    before, loop = ";", False
    for m in _TOKEN.finditer(statement):
        word = m[0]
        member = before in (".", "::") or (before == ":" and statement[m.start() - 1 : m.start()] == ":")
        if not member and not word.endswith(":"):
            if word == "end":
                yield "end"
            elif word in OPENS or word == "for":
                loop = loop or word == "for"
                if before != "def" and not (word == "def" and _ENDLESS.match(statement, m.start())):
                    yield word
            elif word in OPENS_OR_MODIFIES and before in _BEGINS_AFTER:
                loop = loop or word in LOOPS
                yield word
            elif word == "do":
                if not loop:
                    yield "do"
                loop = False
        before = word
