"""JavaScript and TypeScript as masked text: of the same length, line by line, with what is no code made blank.

Comments, regular expressions and the text of JSX elements go whole; strings and templates keep their quotes and lose what is
between them, but for the code in a template's `${ }`. What a pattern finds in the masked text is code, and the
value of a string that it finds stands at the same place of the original.
"""

from __future__ import annotations

import re

# Words after which a slash begins a regular expression, and those whose parentheses hold a condition.
BEFORE_REGEX = frozenset("return typeof case in of delete void throw new do else yield await instanceof default".split())
CONDITION = frozenset(("if", "while", "for", "with"))
_WORD = re.compile(r"[A-Za-z_$][\w$]*")
_NUMBER = re.compile(r"\d[\w.]*")
_JSX_START = re.compile(r"<(?:>|[A-Za-z][\w.:-]*(?=[\s/>]))")
_GENERIC = re.compile(r"<\s*[A-Z]\w*\s*(?:,|\bextends\b)")
_JSX_CLOSE = re.compile(r"</\s*[\w.:-]*\s*>")


class Mask:
    """One pass over a text. `value` tells whether what was read last is a value, after which a slash divides and `<` compares."""

    def __init__(self, text: str, jsx: bool) -> None:
        self.text, self.jsx, self.at = text, jsx, 0
        self.out = list(text)
        self.value, self.word = False, ""
        self.last = ";"  # the last character of code
        self.parens: list[str] = []  # the word before each open parenthesis
        self.braces: list[str] = []  # what each open brace is: block, object, template or jsx

    def blank(self, start: int, end: int) -> None:
        for i in range(start, min(end, len(self.out))):
            if self.out[i] != "\n":
                self.out[i] = " "

    def run(self) -> str:
        while self.at < len(self.text):
            self.step()
        return "".join(self.out)

    def step(self) -> None:
        """One token of code."""
        start = self.at
        self._token()
        if not self.out[start].isspace():
            self.last = self.out[start] if self.at == start + 1 else "a"

    def _token(self) -> None:
        text, i = self.text, self.at
        c = text[i]
        if c.isspace():
            self.at += 1
        elif text.startswith("//", i):
            end = text.find("\n", i)
            self._skip(len(text) if end < 0 else end)
        elif text.startswith("/*", i):
            end = text.find("*/", i + 2)
            self._skip(len(text) if end < 0 else end + 2)
        elif c in "'\"":
            self._string(c)
        elif c == "`":
            self.at += 1
            self._template()
        elif m := _WORD.match(text, i):
            self.at, self.word, self.value = m.end(), m[0], m[0] not in BEFORE_REGEX
        elif m := _NUMBER.match(text, i):
            self.at, self.word, self.value = m.end(), "", True
        elif c == "/" and not self.value and self._regex():
            self.value, self.word = True, ""
        elif c == "<" and self.jsx and not self.value and _JSX_START.match(text, i) and not _GENERIC.match(text, i):
            self._element()
            self.value, self.word = True, ""
        else:
            self._punctuation(c)

    def _skip(self, end: int) -> None:
        self.blank(self.at, end)
        self.at = end

    def _punctuation(self, c: str) -> None:
        self.at += 1
        if c == "(":
            self.parens.append(self.word)
            self.value = False
        elif c == ")":
            self.value = (self.parens.pop() if self.parens else "") not in CONDITION
        elif c == "{":
            self.braces.append("object" if not self.value and self.last in "=(,:?[&|" else "block")
            self.value = False
        elif c == "}":
            kind = self.braces.pop() if self.braces else "block"
            self.value = kind == "object"
            if kind == "template":
                self.blank(self.at - 1, self.at)
                self._template()
        elif c == "]":
            self.value = True
        elif self.text.startswith(("++", "--"), self.at - 1):
            self.at += 1  # before or after a value: what stood before still says
        else:
            self.value = False
        self.word = ""

    def _string(self, quote: str) -> None:
        i = start = self.at + 1
        while i < len(self.text) and self.text[i] not in (quote, "\n"):
            i += 2 if self.text[i] == "\\" else 1
        self.blank(start, i)
        self.at, self.value, self.word = min(i + 1, len(self.text)), True, ""

    def _template(self) -> None:
        """From within a template to its end, or into the code of a `${`."""
        i = start = self.at
        while i < len(self.text):
            if self.text[i] == "\\":
                i += 2
            elif self.text[i] == "`":
                self.blank(start, i)
                self.at, self.value, self.word = i + 1, True, ""
                return
            elif self.text.startswith("${", i):
                self.blank(start, i + 2)
                self.braces.append("template")
                self.at, self.value, self.word = i + 2, False, ""
                return
            else:
                i += 1
        self._skip(len(self.text))

    def _regex(self) -> bool:
        """A regular expression that begins here and ends on its line; else the slash divides."""
        i, in_class = self.at + 1, False
        while i < len(self.text) and self.text[i] != "\n":
            c = self.text[i]
            if c == "\\":
                i += 1
            elif c == "[":
                in_class = True
            elif c == "]":
                in_class = False
            elif c == "/" and not in_class:
                end = _WORD.match(self.text, i + 1)
                self._skip(end.end() if end else i + 1)
                return True
            i += 1
        return False

    # --- JSX ----------------------------------------------------------------------------------------

    def _element(self) -> None:
        """A JSX element, its children and what is nested in them."""
        depth = 0
        while self.at < len(self.text):
            if m := _JSX_CLOSE.match(self.text, self.at):
                self._skip(m.end())
                depth -= 1
            elif _JSX_START.match(self.text, self.at):
                depth += self._tag()
            elif self.text[self.at] == "{":
                self._braced()
            else:
                self._skip(self.at + 1)  # text of the element
            if depth <= 0:
                return

    def _tag(self) -> int:
        """An opening tag; 0 if it closes itself."""
        self.at = _JSX_START.match(self.text, self.at).end()
        if self.text[self.at - 1] == ">":
            return 1
        while self.at < len(self.text):
            c = self.text[self.at]
            if c == ">":
                self.at += 1
                return 1
            if self.text.startswith("/>", self.at):
                self.at += 2
                return 0
            if c in "'\"":
                i = self.text.find(c, self.at + 1)
                i = len(self.text) if i < 0 else i
                self.blank(self.at + 1, i)
                self.at = i + 1
            elif c == "{":
                self._braced()
            else:
                self.at += 1
        return 0

    def _braced(self) -> None:
        """The code in braces of an element."""
        self.braces.append("jsx")
        level = len(self.braces)
        self.at, self.value, self.word = self.at + 1, False, ""
        while self.at < len(self.text) and len(self.braces) >= level:
            self.step()


def masked(text: str, jsx: bool = True) -> str:
    try:
        return Mask(text, jsx).run()
    except RecursionError:  # elements nested some hundred deep: read as if there were none
        return Mask(text, False).run()


#: An opening or closing brace, and the heads of what braces may belong to.
_SCOPE = re.compile(r"[{}]|\bclass\b\s*([A-Za-z_$][\w$]*)?|\bfunction\b\s*\*?\s*([A-Za-z_$][\w$]*)?|=>")


def scopes(mask: str) -> list[tuple[tuple[str, str | None], ...]]:
    """For each line, what is open where it begins: (class, name), (function, name) or (block, None), outermost first."""
    out: list[tuple[tuple[str, str | None], ...]] = []
    stack: list[tuple[str, str | None]] = []
    coming: tuple[str, str | None] | None = None
    for line in mask.split("\n"):
        out.append(tuple(stack))
        for m in _SCOPE.finditer(line):
            if m[0] == "{":
                stack.append(coming or ("block", None))
                coming = None
            elif m[0] == "}":
                if stack:
                    stack.pop()
            elif m[0].startswith("class"):
                coming = ("class", m[1])
            elif m[0] == "=>":
                coming = ("function", None)
            else:
                coming = ("function", m[2])
        if coming and coming[0] == "function" and line.rstrip().endswith(";"):
            coming = None
    return out
