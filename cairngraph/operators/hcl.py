"""The structure of HCL: attributes and blocks by recursive descent.

Quoted templates (with `${ }` and `%{ }` nested in them), heredocs and comments are read as such, so a brace or a bracket in them
closes nothing. Expressions are passed over; what is kept of one is its text if it is a quoted string, and the attributes of an object.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_NAME = re.compile(r"[A-Za-z_][\w-]*")
_HEREDOC = re.compile(r"<<(-?)([A-Za-z_][\w-]*)[ \t]*\r?\n")
_BLANK = re.compile(r"(?:\s|#[^\n]*|//[^\n]*|/\*.*?(?:\*/|\Z))+", re.S)
#: Blocks in blocks that are followed; what lies deeper is passed over.
DEEPEST = 100


@dataclass
class Attribute:
    name: str
    at: int
    text: str | None = None  # of a quoted string, what stands between the quotes
    fields: dict[str, Attribute] = field(default_factory=dict)  # of an object


@dataclass
class Block:
    type: str
    at: int
    labels: list[str]
    attributes: list[Attribute] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)

    def attribute(self, name: str) -> Attribute | None:
        return next((a for a in self.attributes if a.name == name), None)

    def strings(self):
        """Every attribute with a quoted string, here, in objects and in inner blocks, in order of the text."""
        found = []
        todo = [*self.attributes]
        while todo:
            a = todo.pop()
            todo += a.fields.values()
            if a.text is not None:
                found.append(a)
        for b in self.blocks:
            found += b.strings()
        return sorted(found, key=lambda a: a.at)


class Reader:
    def __init__(self, text: str) -> None:
        self.text, self.at, self.balanced = text, 0, True

    def root(self) -> Block:
        root = Block("", 0, [])
        while self.at < len(self.text):
            self._body(root, 0)
            if self.at < len(self.text):  # a brace too many
                self.balanced = False
                self.at += 1
        return root

    def _blank(self) -> None:
        if m := _BLANK.match(self.text, self.at):
            self.at = m.end()

    def _body(self, block: Block, depth: int) -> None:
        """Up to the brace that closes the block, or the end."""
        while True:
            self._blank()
            if self.at >= len(self.text) or self.text[self.at] == "}":
                return
            if m := _NAME.match(self.text, self.at):
                self.at = m.end()
                self._entry(block, m[0], m.start(), depth)
            elif self.text[self.at] == '"':
                self._quoted()
            else:
                self.at += 1

    def _entry(self, block: Block, name: str, at: int, depth: int) -> None:
        """What follows a name: `= expression`, or labels and a block."""
        labels = []
        while True:
            self._blank_on_line()
            c = self.text[self.at : self.at + 1]
            if c == "=" and not labels and self.text[self.at + 1 : self.at + 2] != "=":
                self.at += 1
                block.attributes.append(self._value(Attribute(name, at), depth))
                return
            if c == '"':
                labels.append(self._quoted())
            elif c == "{":
                self.at += 1
                inner = Block(name, at, labels)
                if depth < DEEPEST:
                    self._body(inner, depth + 1)
                    block.blocks.append(inner)
                else:
                    self._nested("}")
                self._close()
                return
            elif m := _NAME.match(self.text, self.at):
                labels.append(m[0])
                self.at = m.end()
            else:
                return

    def _close(self) -> None:
        if self.at < len(self.text):
            self.at += 1
        else:
            self.balanced = False

    def _blank_on_line(self) -> None:
        while self.at < len(self.text) and self.text[self.at] in " \t":
            self.at += 1

    def _value(self, a: Attribute, depth: int) -> Attribute:
        self._blank_on_line()
        start = self.at
        if self.text.startswith('"', start):
            text = self._quoted()
            end = self.at
            self._expression()
            a.text = text if not self._rest(end).strip() else None
        elif self.text.startswith("{", start) and depth < DEEPEST:
            self.at += 1
            self._object(a, depth + 1)
            self._close()
            self._expression()
        else:
            self._expression()
        return a

    def _rest(self, start: int) -> str:
        return _BLANK.sub("", self.text[start : self.at])

    def _object(self, a: Attribute, depth: int) -> None:
        """The fields of an object, up to its brace."""
        while True:
            self._blank()
            if self.at >= len(self.text) or self.text[self.at] == "}":
                return
            at = self.at
            if m := _NAME.match(self.text, self.at):
                name, self.at = m[0], m.end()
            elif self.text[self.at] == '"':
                name = self._quoted()
            else:
                self._token()
                continue
            self._blank_on_line()
            if self.text[self.at : self.at + 1] in ("=", ":") and self.text[self.at + 1 : self.at + 2] not in ("=", ">"):
                self.at += 1
                a.fields[name] = self._value(Attribute(name, at), depth)

    def _expression(self) -> None:
        """To where an expression ends: its line, a comma, or the bracket around it."""
        while self.at < len(self.text):
            c = self.text[self.at]
            if c in "\n,}])":
                return
            if c == "#" or self.text.startswith("//", self.at):
                end = self.text.find("\n", self.at)
                self.at = len(self.text) if end < 0 else end
            else:
                self._token()

    def _token(self) -> None:
        """One token of an expression, with all that its brackets hold."""
        text, c = self.text, self.text[self.at]
        if c == '"':
            self._quoted()
        elif m := _HEREDOC.match(text, self.at):
            end = re.compile(rf"^[ \t]*{re.escape(m[2])}[ \t]*\r?$" if m[1] else rf"^{re.escape(m[2])}[ \t]*\r?$", re.M).search(text, m.end())
            self.at = end.end() if end else len(text)
        elif text.startswith("/*", self.at):
            end = text.find("*/", self.at + 2)
            self.at = len(text) if end < 0 else end + 2
        elif c in "([{":
            self.at += 1
            self._nested({"(": ")", "[": "]", "{": "}"}[c])
            self._close()
        else:
            self.at += 1

    def _nested(self, closing: str) -> None:
        waiting = [closing]
        while self.at < len(self.text):
            c = self.text[self.at]
            if c == waiting[-1]:
                if len(waiting) == 1:
                    return
                waiting.pop()
                self.at += 1
            elif c in "([{":
                waiting.append({"(": ")", "[": "]", "{": "}"}[c])
                self.at += 1
            elif m := _BLANK.match(self.text, self.at):
                self.at = m.end()
            else:
                self._token()

    def _quoted(self) -> str:
        """A quoted template; what stands between its quotes."""
        start = self.at = self.at + 1
        while self.at < len(self.text):
            c = self.text[self.at]
            if c == "\\":
                self.at += 2
            elif self.text.startswith(("$${", "%%{"), self.at):
                self.at += 3
            elif self.text.startswith(("${", "%{"), self.at):
                self.at += 2
                self._nested("}")
                self.at += 1
            elif c in '"\n':
                break
            else:
                self.at += 1
        out = self.text[start : self.at]
        if self.text[self.at : self.at + 1] == '"':
            self.at += 1
        return out


def parse(text: str) -> tuple[Block, bool]:
    """The attributes and blocks of a file, and whether all that opens closes."""
    reader = Reader(text)
    try:
        return reader.root(), reader.balanced
    except RecursionError:  # templates within templates, some hundred deep
        return Block("", 0, []), False
