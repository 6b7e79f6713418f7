"""License scans by template-markup matching.

A template is wording with two kinds of markup: `<<optional>> ... <<end>>` may be absent, and
`<<var;max=N>>` stands for at most N words of any kind. It compiles to an automaton over words; a text
holds the license where the automaton reaches its end, which needs every mandatory word exactly.
The words that every match begins with are its anchor: only places where they stand are tried.

Defined cases: a null text is an empty one; a text without a match has no labels and score 0; rows
are judged alone, so null or repeated ids and equal texts need no care; texts of any length are read whole; other columns are ignored; a kept column that is called like an
output comes back as `<name>_kept`; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairngraph.llm.common import alnum_words, map_arrow, renamed, texts

# Phrases of the base rule and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    " <<optional>>(the \"Software\")<<end>>, to deal in the Software without restriction, including without limitation the rights to use,"
    " copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software"
    " is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<optional>>(including the"
    " next paragraph)<<end>> shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT"
    " WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE"
    " AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;max=20>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF"
    " CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"
)
_ISC = (
    "Permission to use, copy, modify, and<<optional>>/or<<end>> distribute this software for any purpose with or without fee is hereby"
    " granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND"
    " <<var;max=20>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO"
    " EVENT SHALL <<var;max=20>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM"
    " LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH"
    " THE USE OR PERFORMANCE OF THIS SOFTWARE"
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted <<optional>>(subject to the limitations"
    " in the disclaimer below)<<end>> provided that the following conditions are met: <<var;max=1>> Redistributions of source code must retain the"
    " above copyright notice, this list of conditions and the following disclaimer. <<var;max=1>> Redistributions in binary form must reproduce"
    " the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with"
    " the distribution."
)
_BSD_ADVERTISING = (
    " <<var;max=1>> All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by <<var;max=20>>"
)
_BSD_NAMES = (
    " <<var;max=1>> Neither the name of <<var;max=20>> nor the names of <<var;max=4>> contributors may be used to endorse or promote products derived from this software without specific"
    " prior written permission."
)
_BSD_DISCLAIMER = (
    " <<optional>>NO EXPRESS OR IMPLIED LICENSES TO ANY PARTY'S PATENT RIGHTS ARE GRANTED BY THIS LICENSE.<<end>>"
    " THIS SOFTWARE IS PROVIDED BY <<var;max=20>> \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED"
    " WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;max=20>> BE LIABLE FOR ANY DIRECT,"
    " INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;"
    " LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,"
    " OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"
)
_ZLIB = (
    "This software is provided <<optional>>'as-is'<<end>>, without any express or implied warranty. In no event will the authors be held liable for any damages arising from"
    " the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely,"
    " subject to the following restrictions: <<var;max=1>> The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use"
    " this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. <<var;max=1>> Altered source versions must be plainly marked as"
    " such, and must not be misrepresented as being the original software. <<var;max=1>> This notice may not be removed or altered from any source distribution"
)
_BOOST = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the"
    " \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the"
    " Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction"
    " and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works"
    " are solely in the form of machine-executable object code generated by a source language processor"
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source"
    " code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"
)
_MPL = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at <<var;max=6>>"
)
_EPL = (
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License <<optional>>v<<end>> <<optional>>v.<<end>> 2.0 which <<optional>>accompanies this"
    " distribution, and<<end>> is available at"
)
_GPL = (
    "redistribute it and/or modify it under the terms of the GNU FAMILY General Public License as published by the Free"
    " Software Foundation<<optional>>; either<<end>> version VERSION <<optional>>of the License<<end>><<optional>>, or (at your option) any later version<<end>>."
    " <<var;max=8>> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY"
    " or FITNESS FOR A PARTICULAR PURPOSE. See the GNU FAMILY General Public License for more details. You should have received a copy of the GNU FAMILY General"
    " Public License along with <<var;max=8>> <<optional>>if not, see <<var;max=8>><<end>> <<optional>>if not, write to the Free Software"
    " Foundation, Inc., <<var;max=16>><<end>>"
)



def _gpl(family: str, version: str) -> str:
    return _GPL.replace("FAMILY", family).replace("VERSION", version)


#: Terms of the Creative Commons licenses, and their names.
_CREATIVE_COMMONS = {
    "cc-by-4.0": "Attribution", "cc-by-sa-4.0": "Attribution-ShareAlike", "cc-by-nd-4.0": "Attribution-NoDerivatives", "cc-by-nc-4.0": "Attribution-NonCommercial",
    "cc-by-nc-sa-4.0": "Attribution-NonCommercial-ShareAlike", "cc-by-nc-nd-4.0": "Attribution-NonCommercial-NoDerivatives",
}

#: Markup of well-known licenses and notices: mit-text, isc-text, bsd-N-clause and zlib are whole licenses with all their conditions and
#: disclaimers (boost and unlicense their grants), gpl, lgpl, agpl, mpl and epl the notices that their stewards ask for; `licensed under`
#: lines are short notices, complete as they stand.
TEMPLATES = (
    ("mit-text", _MIT.replace("NONINFRINGEMENT", "NON-INFRINGEMENT")),
    ("mit-text", _MIT),
    ("isc-text", _ISC.replace("DISCLAIMS", "DISCLAIM")),
    ("isc-text", _ISC),
    ("bsd-2-clause", _BSD + _BSD_DISCLAIMER),
    ("bsd-3-clause", _BSD + _BSD_NAMES + _BSD_DISCLAIMER),
    ("bsd-4-clause", _BSD + _BSD_ADVERTISING + _BSD_NAMES + _BSD_DISCLAIMER),
    ("zlib", _ZLIB),
    ("boost-1.0", _BOOST),
    ("boost-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("unlicense", _UNLICENSE),
    ("mpl-2.0", _MPL),
    ("epl-2.0", _EPL),
    ("cc0-1.0", "<<optional>>licensed<<end>> <<optional>>released<<end>> <<optional>>dedicated<<end>> under <<optional>>the<<end>> CC0 1.0 Universal"),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 <<optional>>(the \"License\"); you may not use <<var;max=4>> except in compliance with"
        " the License <<optional>>You may obtain a copy of the License at <<var;max=12>> Unless required by applicable law or agreed to in writing,"
        " software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or"
        " implied. See the License for the specific language governing permissions and limitations under the License<<end>><<end>>",
    ),
    ("gpl-3.0", _gpl("", "3")),
    ("gpl-2.0", _gpl("", "2")),
    ("lgpl-3.0", _gpl("Lesser", "3")),
    ("lgpl-2.1", _gpl("Lesser", "2.1")),
    ("agpl-3.0", _gpl("Affero", "3")),
    ("gpl-3.0", "licensed under the <<optional>>terms of the<<end>> GNU General Public License, <<optional>>as published by the Free Software Foundation,<<end>> <<optional>>either<<end>> version 3"),
    ("gpl-2.0", "licensed under the <<optional>>terms of the<<end>> GNU General Public License, <<optional>>as published by the Free Software Foundation,<<end>> <<optional>>either<<end>> version 2"),
    ("cc-by-nc-4.0", "licensed under <<optional>>a<<end>> <<optional>>the<<end>> CC BY-NC 4.0"),
    ("cc-by-4.0", "licensed under <<optional>>a<<end>> <<optional>>the<<end>> CC BY 4.0"),
    *((label, f"licensed under <<optional>>a<<end>> <<optional>>the<<end>> Creative Commons {name} 4.0 International <<optional>>Public<<end>> License") for label, name in _CREATIVE_COMMONS.items()),
    ("mit-notice", "<<optional>>licensed<<end>> <<optional>>released<<end>> under the MIT license"),
)

ANY = b"*"


@dataclass
class Automaton:
    """Words to states: edges[state] is [(word or ANY, next)], free[state] the states reachable without a word."""

    label: str
    edges: list[list[tuple[bytes, int]]] = field(default_factory=lambda: [[]])
    free: list[list[int]] = field(default_factory=lambda: [[]])
    anchor: tuple[bytes, ...] = ()

    def state(self) -> int:
        self.edges.append([])
        self.free.append([])
        return len(self.edges) - 1

    def seal(self) -> Automaton:
        self.end = len(self.edges) - 1
        self.closed = []
        for s in range(len(self.edges)):
            seen, todo = {s}, [s]
            while todo:
                for t in self.free[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            self.closed.append(frozenset(seen))
        firsts = self.closed[0]
        run, s = [], 0
        if firsts == {0}:
            while len(self.edges[s]) == 1 and self.edges[s][0][0] != ANY and len(self.closed[s]) == 1:
                run.append(self.edges[s][0][0])
                s = self.edges[s][0][1]
        self.anchor = tuple(run)
        self.starts = frozenset(w for f in firsts for w, _ in self.edges[f])
        return self

    def match(self, words: Sequence[bytes], at: int) -> int | None:
        """End of the longest match that begins at word `at`, or None."""
        now, best, i = self.closed[0], None, at
        while now:
            if self.end in now:
                best = i
            if i == len(words):
                break
            w = words[i]
            now = frozenset(t for s in now for x, y in self.edges[s] if x == w or x == ANY for t in self.closed[y])
            i += 1
        return best


def compile_template(label: str, markup: str) -> Automaton:
    a, now, open_at = Automaton(label), 0, []
    for mark, plain in re.findall(r"<<([^>]*)>>|((?:(?!<<).)+)", markup, re.S):
        if mark == "optional":
            open_at.append(now)
        elif mark == "end":
            a.free[open_at.pop()].append(now)
        elif mark:
            entry = now
            exits = [entry]
            for _ in range(int(re.search(r"max=(\d+)", mark)[1])):
                nxt = a.state()
                a.edges[now].append((ANY, nxt))
                now = nxt
                exits.append(now)
            for s in exits[:-1]:
                a.free[s].append(now)
        else:
            for w in alnum_words(plain.encode()):
                nxt = a.state()
                a.edges[now].append((w, nxt))
                now = nxt
    if open_at:
        raise ValueError(f"{label}: <<optional>> without <<end>>")
    return a.seal()


@cache
def _compiled(templates: tuple[tuple[str, str], ...]) -> tuple[Automaton, ...]:
    return tuple(compile_template(*t) for t in templates)


def find(words: Sequence[bytes], automaton: Automaton, joined: bytes | None = None) -> list[tuple[int, int]]:
    """All (start, end) in words; joined: the words with one space before, between and after them."""
    joined = b" " + b" ".join(words) + b" " if joined is None else joined
    heads = [b" " + b" ".join(automaton.anchor) + b" "] if automaton.anchor else [b" " + w + b" " for w in sorted(automaton.starts)]
    out, starts = [], set()
    for head in heads:
        i, word, seen = joined.find(head), 0, 0
        while i >= 0:
            word += joined.count(b" ", seen, i)
            seen = i
            starts.add(word)
            i = joined.find(head, i + 1)
    for s in sorted(starts):
        if (e := automaton.match(words, s)) is not None and e > s:
            out.append((s, e))
    return out


def scan(text: bytes | None, phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES) -> dict:
    """Matches of one text: base and template spans as (label, first word, end word), and the digest of them."""
    words = alnum_words(text or b"")
    joined = b" " + b" ".join(words) + b" "
    base = [(p.label, *x) for p in _compiled(tuple((label, phrase) for phrase, label in phrases)) for x in find(words, p, joined)]
    own = [(t.label, *x) for t in _compiled(tuple(templates)) for x in find(words, t, joined)]
    under = set()
    for _, s, e in base + own:
        under.update(range(s, e))
    return {
        "n_words": len(words),
        "base": base,
        "matches": own,
        "score": len(under) / len(words) if words else 0.0,
    }


SPAN = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))


def licenses(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """The kept columns, n_words, base and matches (arrays of label, first, end in words) and score: the
    share of the words that lie in a match."""
    phrases, templates = tuple(phrases), tuple(templates)
    src = df.select(F.col(f"`{text}`").cast("string").alias("__text"), *renamed(keep, ("n_words", "base", "matches", "score")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(t, phrases, templates) for t in texts(batch, 0)]
            spans = lambda k: pa.array([[dict(zip(("label", "first", "end"), s, strict=True)) for s in f[k]] for f in found], SPAN)
            cols = [pa.array([f["n_words"] for f in found], pa.int64()), spans("base"), spans("matches"), pa.array([f["score"] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *cols], [*batch.schema.names[1:], "n_words", "base", "matches", "score"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[1:])
    span = "array<struct<label: string, first: bigint, end: bigint>>"
    return map_arrow(src, run, f"{kept}{', ' * bool(kept)}n_words bigint, base {span}, matches {span}, score double")
