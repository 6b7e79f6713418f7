"""Personal data: detection and surrogate generation.

Every detected entity gets a replacement of its own type and format, keyed so that nobody without the
key can tell which. Numbers (cards, phones, national ids, IBANs, addresses of machines) go through a
keyed Feistel permutation of their own digits, so different numbers never meet, and get the check
digits that their format asks for; separators, country codes and first digits stay, and a national id is
permuted again until it is one that may be given out. Names and mail addresses are spelled from a keyed hash in
syllables of the name's script. A word of a name has one stem wherever it stands, which keeps coreference over
titles, combinations and texts (Mrs Ada Kahn, Dr Kahn); a given name's ending shows the gender, which one text tells
for all its mentions, by a title or a known given name. A name's words are replaced wherever they stand in the same
text, with or without a title.

Hashed surrogates could meet. The distinct entities of the whole corpus are therefore gathered (in a
table, by key), their surrogates compared with each other and with the real entities, and the
spelling made one syllable longer until none meet. What the texts need afterwards is only that one number, so
nothing is broadcast or joined. A permuted number may equal another real one, but that is replaced too, and by
another, so the texts that come out keep all distinct.

Defined cases: a null text stays null and an empty one empty, without entities; entities that overlap: the
first kind in KINDS wins; null and repeated ids stay separate rows; other columns pass through `keep`;
long digit runs that are no valid card (Luhn) stay as they are; an empty table gives an empty result; a kept
column that is called like an output comes back as `<name>_kept`.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairngraph.llm.common import drop, map_arrow, renamed, texts, written

KINDS = ("email", "iban", "card", "ssn", "ip", "phone", "name")
#: A deployment passes its own.
KEY = b"cairngraph surrogate key"
LEAST_SYLLABLES, MOST_SYLLABLES = 3, 14

# Titles by gender, and given names that show a name without a title.
TITLES = {
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "Sir", "господин", "Κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Sra", "Señorita", "Doña", "госпожа", "Κυρία"),
    "n": ("Dr", "Prof", "Professor", "Doctor", "Mx"),
}
GIVEN = {
    "m": ("James", "John", "Robert", "Michael", "William", "David", "Thomas", "Hans", "Klaus", "Jürgen", "Pierre", "Jacques", "Carlos", "José", "Juan", "Иван", "Сергей"),
    "f": ("Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Susan", "Anna", "Ursula", "Heike", "Marie", "Camille", "María", "Carmen", "Lucía", "Анна", "Мария"),
}
#: (consonants, vowels, endings of given names by gender) of each script.
SCRIPTS = {
    "latin": ("bdfglmnprstvz", "aeiou", {"m": ("or", "us", "en"), "f": ("a", "ine", "elle"), "n": ("is", "e")}),
    "cyrillic": ("бвгдзклмнпрст", "аеиоу", {"m": ("ор", "ий", "ан"), "f": ("а", "ина", "ия"), "n": ("ик",)}),
    "greek": ("βγδζκλμνπρστφ", "αεηιο", {"m": ("ος", "ης"), "f": ("α", "η"), "n": ("ι",)}),
}

_EMAIL = re.compile(r"[\w.%+-]*[\w%+-]@(?:[\w-]+\.)+[^\W\d_]{2,}")
_DIGITS = re.compile(r"[+(]?\d[\d+(). -]{5,}\d")
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NUMBERS = (
    ("card", re.compile(r"(?<![\d.-])(?:\d{13,19}|\d{4}(?P<s>[ -])\d{4}(?P=s)\d{4}(?P=s)\d{1,7}|\d{4}(?P<t>[ -])\d{6}(?P=t)\d{5})(?![\d-])")),
    ("ssn", re.compile(r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])")),
    ("ip", re.compile(rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)")),
    ("phone", re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,5}){1,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}(?P<p>[-.])\d{3}(?P=p)\d{4})(?!\d)")),
)
_IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
_NAME_WORD = r"[^\W\d_a-zà-öø-ÿα-ωа-я]\w*(?:[-'’]\w+)*"
_TITLE_GENDER = {t: g for g, ts in TITLES.items() for t in ts}
_GIVEN_GENDER = {n: g for g, ns in GIVEN.items() for n in ns}
#: A title and up to three words, or a known given name and one or two words.
_NAME = re.compile(
    rf"\b(?:(?P<title>{'|'.join(sorted(_TITLE_GENDER, key=len, reverse=True))})\.?[ \xa0](?P<a>{_NAME_WORD}(?:[ \xa0]{_NAME_WORD}){{0,2}})"
    rf"|(?:{'|'.join(sorted(_GIVEN_GENDER, key=len, reverse=True))})(?:[ \xa0]{_NAME_WORD}){{1,2}})"
)
_WORD = re.compile(rf"\b{_NAME_WORD}")
_GAP = re.compile(r"[ \xa0]")


def luhn(digits: str) -> bool:
    return _luhn_sum(digits) % 10 == 0


def _luhn_sum(digits: str) -> int:
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


class Names:
    """What the names of one text tell: which words are surnames or given names, and of what gender."""

    def __init__(self, text: str) -> None:
        self.found: list[tuple[int, int]] = []
        self.roles: dict[str, str] = {}
        self.genders: dict[str, str] = {}
        for m in _NAME.finditer(text):
            start = m.start("a") if m["title"] else m.start()
            self.found.append((start, m.end()))
            *given, last = _GAP.split(text[start : m.end()])
            self.roles.setdefault(last, "surname")
            for word in given:
                self.roles.setdefault(word, "given")
            if given:
                told = _TITLE_GENDER[m["title"]] if m["title"] else "n"
                for word, sort in [*((w, _GIVEN_GENDER.get(w, "n")) for w in given), (given[0], told)]:
                    if self.genders.get(word.lower(), "n") == "n":
                        self.genders[word.lower()] = sort
        if self.roles:  # and the same words wherever else they stand
            ends = {e for s, e in self.found}
            at = [s for s, _ in self.found]
            for m in _WORD.finditer(text):
                k = bisect.bisect_right(at, m.start()) - 1
                if m[0] in self.roles and len(m[0]) > 2 and m.end() not in ends and not (k >= 0 and m.start() < self.found[k][1]):
                    self.found.append(m.span())

    def parts(self, words: Sequence[str]) -> list[tuple[str, str]]:
        *given, last = words
        kind = lambda w: f"given_{self.genders.get(w.lower(), 'n')}"
        alone = not given and self.roles.get(last) == "given"
        return [*((kind(w), w.lower()) for w in given), (kind(last) if alone else "surname", last.lower())]


def detect(text: str, names: Names | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities, in order, without overlaps; names: those of the text, if known."""
    found: list[tuple[int, int, str]] = []
    if "@" in text:
        found += [(*m.span(), "email") for m in _EMAIL.finditer(text)]
    for m in _IBAN.finditer(text):
        compact = m[0].replace(" ", "")
        if 15 <= len(compact) <= 34 and _mod97(compact) == 1:
            found.append((*m.span(), "iban"))
    for run in _DIGITS.finditer(text):
        a, b = run.span()
        for kind, pattern in _NUMBERS:
            for m in pattern.finditer(text, max(0, a - 1), min(len(text), b + 2)):
                if (kind != "card" or luhn(re.sub(r"\D", "", m[0]))) and (kind != "phone" or 7 <= sum(map(str.isdigit, m[0])) <= 15):
                    found.append((*m.span(), kind))
    found += [(s, e, "name") for s, e in (Names(text) if names is None else names).found]
    rank = {k: n for n, k in enumerate(KINDS)}
    taken: list[tuple[int, int, str]] = []  # in order, without overlaps
    for s in sorted(set(found), key=lambda x: (rank[x[2]], x[0] - x[1], x)):
        k = bisect.bisect_left(taken, s)
        if (k == 0 or taken[k - 1][1] <= s[0]) and (k == len(taken) or s[1] <= taken[k][0]):
            taken.insert(k, s)
    return taken


class Surrogates:
    """Keyed replacements; width: syllables of hashed ones."""

    def __init__(self, key: bytes = KEY, width: int = LEAST_SYLLABLES) -> None:
        self.key, self.width = hashlib.blake2b(key).digest(), width
        self.memo: dict[tuple[str, str], str] = {}

    def _number(self, *what: object) -> int:
        return int.from_bytes(hashlib.blake2b(repr(what).encode(), key=self.key, digest_size=16).digest(), "big")

    def permuted(self, kind: str, digits: str) -> str:
        """A keyed permutation of the digit strings of this length: an alternating Feistel network."""
        n = len(digits)
        if n < 2:
            return digits if not n else str((int(digits) + self._number(kind, "one")) % 10)
        u = n // 2
        a, b = digits[:u], digits[u:]
        for r in range(10):
            a, b = b, str((int(a) + self._number(kind, n, r, b)) % 10 ** len(a)).zfill(len(a))
        return a + b

    def _address(self, value: str) -> str:
        """A permutation of the IPv4 addresses that keeps private ones private and public ones public."""
        x = int.from_bytes(bytes(map(int, value.split("."))), "big")
        private = lambda v: v >> 24 in (10, 127) or v >> 20 == 0xAC1 or v >> 16 == 0xC0A8
        kept = private(x)
        while True:
            a, b = x >> 16, x & 0xFFFF
            for r in range(8):
                a, b = b, a ^ (self._number("ip", r, b) & 0xFFFF)
            x = a << 16 | b
            if private(x) == kept:
                return ".".join(map(str, x.to_bytes(4, "big")))

    def syllables(self, script: str, *what: object) -> str:
        consonants, vowels, _ = SCRIPTS[script]
        x, out = self._number(self.width, *what), []
        for _ in range(self.width):
            x, i = divmod(x, len(consonants))
            x, j = divmod(x, len(vowels))
            out.append(consonants[i] + vowels[j])
        return "".join(out)

    def part(self, kind: str, value: str) -> str:
        """The surrogate of a normal form: kind is one of the number kinds, email, surname or given_<gender>."""
        if (kind, value) not in self.memo:
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[kind, value] = self._made(kind, value)
        return self.memo[kind, value]

    def _made(self, kind: str, value: str) -> str:
        if kind == "card":
            body = value[0] + self.permuted("card", value[1:-1])
            return body + str(-_luhn_sum(body + "0") % 10)
        if kind == "ssn":
            while True:  # the walk along the permutation's cycle is a permutation of the ids that may be given out
                value = self.permuted("ssn", value)
                if value[:3] not in ("000", "666") and value[0] != "9" and value[3:5] != "00" and value[5:] != "0000":
                    return value
        if kind == "phone":
            code = (1 if value[1:2] in "17" else 2) if value[:1] == "+" else 0
            digits = value.lstrip("+")
            return ("+" if code else "") + digits[:code] + self.permuted("phone", digits[code:])
        if kind == "ip":
            return self._address(value)
        if kind == "iban":
            digits = iter(self.permuted("iban", re.sub(r"\D", "", value[4:])))
            body = "".join(next(digits) if c.isdigit() else c for c in value[4:])
            return f"{value[:2]}{98 - _mod97(f'{value[:2]}00{body}'):02d}{body}"
        if kind == "email":
            local, _, domain = value.rpartition("@")
            host, _, top = domain.rpartition(".")
            n = self._number("digits", value)
            tail = re.sub(r"\d", lambda m: str((int(m[0]) + n) % 10), re.sub(r"[^\W\d_]+", "", local))
            return f"{self.syllables('latin', 'local', value)}{tail}@{self.syllables('latin', 'host', host)}.{top}"
        script = "cyrillic" if re.search("[а-яё]", value) else "greek" if re.search("[α-ωά-ώ]", value) else "latin"
        if kind == "surname":
            return self.syllables(script, "surname", value)
        endings = SCRIPTS[script][2][kind[-1]]
        return self.syllables(script, "given", value)[:-1] + endings[self._number("ending", value) % len(endings)]


def normal_forms(text: str, start: int, end: int, kind: str, names: Names) -> list[tuple[str, str]]:
    """The parts of an entity that have surrogates of their own: (kind, normal form)."""
    raw = text[start:end]
    if kind == "name":
        return names.parts(_GAP.split(raw))
    if kind in ("card", "ssn"):
        return [(kind, re.sub(r"\D", "", raw))]
    if kind == "phone":
        return [(kind, ("+" if raw[0] == "+" else "") + re.sub(r"\D", "", raw))]
    return [(kind, raw.replace(" ", "") if kind == "iban" else raw.lower() if kind == "email" else raw)]


def _cased(like: str, word: str) -> str:
    return word.upper() if len(like) > 1 and like.isupper() else word[:1].upper() + word[1:]


def replacement(text: str, start: int, end: int, kind: str, by: Surrogates, names: Names) -> str:
    raw = text[start:end]
    new = [by.part(k, v) for k, v in normal_forms(text, start, end, kind, names)]
    if kind == "name":
        gaps = _GAP.findall(raw)
        words = [_cased(old, w) for old, w in zip(_GAP.split(raw), new, strict=True)]
        return words[0] + "".join(g + w for g, w in zip(gaps, words[1:], strict=True))
    if kind in ("card", "ssn", "phone", "iban"):
        fresh = iter(new[0].lstrip("+"))
        return "".join(next(fresh) if c.isalnum() else c for c in raw)
    return new[0]


def rewritten(text: str, by: Surrogates) -> tuple[str, list[tuple[int, int, str, str]]]:
    """The text with surrogates, and (start, end, kind, surrogate) of what was replaced, in the old text."""
    out, at, spans = [], 0, []
    names = Names(text)
    for s, e, kind in detect(text, names):
        new = replacement(text, s, e, kind, by, names)
        out += [text[at:s], new]
        spans.append((s, e, kind, new))
        at = e
    return "".join([*out, text[at:]]), spans


def entities(df: DataFrame, text: str = "text") -> DataFrame:
    """The distinct (kind, value) of all texts, values in normal form."""
    src = df.select(F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {x for t in texts(batch, 0) if t for u in [t.decode("utf-8", "replace")] for n in [Names(u)] for s in detect(u, n) for x in normal_forms(u, *s, n)}
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string())], ["kind", "value"])

    return map_arrow(src, run, "kind string, value string").distinct()


def safe_width(df: DataFrame, text: str = "text", key: bytes = KEY) -> int:
    """The least number of syllables at which no two entities of the corpus share a surrogate and no hashed surrogate
    is a real entity."""
    found, at = written(entities(df, text), "entities")
    for width in range(LEAST_SYLLABLES, MOST_SYLLABLES + 1):
        made, made_at = written(_with_surrogates(found, key, width), "surrogates")
        sort = F.substring_index("kind", "_", 1)  # given names of any gender must differ
        shared = made.groupBy(sort.alias("sort"), "surrogate").agg(F.min("value").alias("least"), F.max("value").alias("most")).where("least <> most").limit(1)
        hashed = made.where(sort.isin("email", "surname", "given")).select(sort.alias("sort"), F.lower("surrogate").alias("value"))
        real = hashed.join(found.select(sort.alias("sort"), "value"), ["sort", "value"], "left_semi").limit(1)
        clash = shared.count() + real.count()
        drop(df.sparkSession, made_at)
        if not clash:
            drop(df.sparkSession, at)
            return width
    raise RuntimeError("surrogates still collide at MOST_SYLLABLES")


def _with_surrogates(found: DataFrame, key: bytes, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = Surrogates(key, width)
        for batch in batches:
            new = [by._made(k, v) for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], ["kind", "value", "surrogate"])

    return map_arrow(found.select("kind", "value"), run, "kind string, value string, surrogate string")


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("surrogate", pa.string())]))


def pseudonymised(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), key: bytes = KEY, width: int | None = None) -> DataFrame:
    """The kept columns, new_text and entities: what was replaced, as array<struct<start, end, kind, surrogate>> in
    characters of the old text. Runs that share a key agree on the surrogates if they share a width; unless given, it is
    the least that is safe for df."""
    width = safe_width(df, text, key) if width is None else width
    src = df.select(F.col(f"`{text}`").cast("string").alias("__text"), *renamed(keep, ("new_text", "entities")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = Surrogates(key, width)
        for batch in batches:
            done = [(None, []) if t is None else rewritten(t.decode("utf-8", "replace"), by) for t in texts(batch, 0)]
            spans = [[dict(zip(("start", "end", "kind", "surrogate"), s, strict=True)) for s in d[1]] for d in done]
            cols = [pa.array([d[0] for d in done], pa.string()), pa.array(spans, _SPAN)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *cols], [*batch.schema.names[1:], "new_text", "entities"])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in src.schema.fields[1:])
    return map_arrow(src, run, f"{kept}new_text string, entities array<struct<start: bigint, end: bigint, kind: string, surrogate: string>>")
