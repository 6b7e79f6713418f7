"""Quality rules by repetition coverage.

The words of many texts are laid end to end as integers; a Rabin-Karp polynomial over them gives the
hash of every n-gram as a difference of prefix sums, so one numpy expression hashes all windows of a
length. Windows with equal hashes inside one text are checked word by word, then marked, and the
characters under the marks are summed. Repeated lines are measured the same way by their characters.

Defined cases: a null or empty text has no words and fails; a row keeps its doc_id whatever it is
(null and repeated ids included), as no step compares rows; other columns are ignored; a kept column that is called like an output comes back as
`<name>_kept`; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairngraph.llm.common import blank_words, map_arrow, renamed, texts

#: n-gram length: percent of a text's word characters that may lie inside repeated n-grams.
COVERAGE_LIMITS = {5: 20, 6: 18, 7: 16, 8: 14, 9: 12, 10: 10}
#: Percent of the characters of lines that may lie in repeated lines.
LINE_LIMIT = 30
SYMBOLS = b"#*$%&|<>"
#: Words handled at once; a longer text is handled alone.
CHUNK_WORDS = 250_000

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: spreads small integers over 64 bits."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    if n:
        p[0] = 1
    return np.multiply.accumulate(p)


class Windows:
    """Hashes of all n-grams of several texts laid end to end; words are integers."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray) -> None:
        self.ids, self.doc = ids, doc
        h = _mixed(ids.astype(np.uint64))
        self.sums = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum(h * _powers(_BASE, len(ids)), out=self.sums[1:])
        self.back = _powers(_BASE_INVERSE, len(ids))

    def repeated(self, n: int, at: np.ndarray | None = None) -> np.ndarray:
        """Starts, among `at`, of the n-grams that occur at least twice in their text."""
        if at is None:
            at = np.arange(max(0, len(self.ids) - n + 1))
        at = at[at + n <= len(self.ids)]
        at = at[self.doc[at] == self.doc[at + n - 1]]
        keys = (self.sums[at + n] - self.sums[at]) * self.back[at] + _mixed(self.doc[at].astype(np.uint64))
        s = np.sort(keys)
        twice = np.unique(s[1:][s[1:] == s[:-1]])
        if not len(twice):
            return at[:0]
        k = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
        hit = twice[k] == keys
        at, k = at[hit], k[hit]
        first = np.full(len(twice), len(self.ids), np.int64)
        np.minimum.at(first, k, at)
        like = first[k]
        same = self.doc[at] == self.doc[like]
        for j in range(n):
            same &= self.ids[at + j] == self.ids[like + j]
        if same.all():
            return at
        rows = np.column_stack([self.doc[at], *(self.ids[at + j] for j in range(n))])  # two n-grams share a hash
        _, group, sizes = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        return at[sizes[group.ravel()] > 1]

    def covered(self, starts: np.ndarray, n: int) -> np.ndarray:
        """Whether each word lies in one of the n-grams that begin at starts."""
        edge = np.zeros(len(self.ids) + 1, np.int32)
        edge[starts] += 1
        edge[starts + n] -= 1
        return np.cumsum(edge[:-1]) > 0


def _line_counts(text: bytes) -> tuple[int, int, int]:
    """Lines with a word that equal an earlier one, characters of lines that occur twice or more, of all."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    seen = Counter(lines)
    chars = sum(len(x.decode("utf-8", "replace")) for x in lines)
    if len(seen) == len(lines):
        return 0, 0, chars
    again = sum(len(x.decode("utf-8", "replace")) * k for x, k in seen.items() if k > 1)
    return len(lines) - len(seen), again, chars


def measure(docs: Sequence[bytes | None], lengths: Sequence[int] = tuple(COVERAGE_LIMITS)) -> dict[str, np.ndarray]:
    """Counts per text: words, word_chars, symbols, dup_lines, repeat_words (5-grams), dup_line_chars,
    line_chars, and chars_<n> for each n-gram length."""
    n = len(docs)
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    split = [blank_words(t or b"") for t in docs]
    sizes = np.array([len(w) for w in split], np.int64)
    ids = np.fromiter((i for w in split for i in map(number.__getitem__, w)), np.int64, int(sizes.sum()))
    del split
    width = np.fromiter((len(w.decode("utf-8", "replace")) for w in number), np.int64, len(number))[ids]
    doc = np.repeat(np.arange(n), sizes)
    add = lambda x: np.bincount(doc, weights=x, minlength=n).astype(np.int64)
    lines = [_line_counts(t or b"") for t in docs]
    out = {
        "words": sizes,
        "word_chars": add(width),
        "symbols": np.array([sum(map((t or b"").count, (SYMBOLS[i : i + 1] for i in range(len(SYMBOLS))))) for t in docs], np.int64),
        "dup_lines": np.array([x[0] for x in lines], np.int64),
        "dup_line_chars": np.array([x[1] for x in lines], np.int64),
        "line_chars": np.array([x[2] for x in lines], np.int64),
    }
    w = Windows(ids, doc)
    shorter = None
    for k in sorted({5, *lengths}):  # a repeated n-gram begins with a repeated shorter one
        shorter = w.repeated(k, shorter)
        mark = w.covered(shorter, k)
        if k == 5:
            out["repeat_words"] = add(mark)
        if k in lengths:
            out[f"chars_{k}"] = add(width * mark)
    return out


def _chunks(docs: list[bytes | None]) -> Iterator[list[bytes | None]]:
    now: list[bytes | None] = []
    size = 0
    for t in docs:
        now.append(t)
        size += len(t or b"")
        if size >= 6 * CHUNK_WORDS:
            yield now
            now, size = [], 0
    if now:
        yield now


def repetition(
    df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), limits: dict[int, int] | None = None, line_limit: int = LINE_LIMIT
) -> DataFrame:
    """The kept columns, the counts of measure() and two verdicts: base_failed and kept."""
    limits = dict(COVERAGE_LIMITS if limits is None else limits)
    lengths = tuple(sorted(limits))
    names = ["words", "word_chars", "symbols", "dup_lines", "repeat_words", "dup_line_chars", "line_chars", *(f"chars_{k}" for k in lengths)]
    src = df.select(F.col(f"`{text}`").cast("string").alias("__text"), *renamed(keep, (*names, "base_failed", "kept")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [measure(c, lengths) for c in _chunks(texts(batch, 0))]
            if parts:
                cols = [pa.array(np.concatenate([p[x] for p in parts])) for x in names]
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], *cols], [*batch.schema.names[1:], *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[1:]), *(f"{x} bigint" for x in names)])
    out = map_arrow(src, run, schema)
    failed = (F.col("words") < 10) | (100 * F.col("repeat_words") > 20 * F.col("words"))
    over = 100 * F.col("dup_line_chars") > line_limit * F.col("line_chars")
    for k, p in limits.items():
        over = over | (100 * F.col(f"chars_{k}") > p * F.col("word_chars"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~over)
