"""Packing by concatenating and cutting.

First pass: each task tokenises its texts, writes the ids as 16-bit integers to the shared folder and
notes where each document starts within the task's own run of ids. The totals of the partitions (one
number each) are summed up on the driver: their prefix sums are the partitions' global offsets.
Second pass: every document then knows its place in the one long sequence, and is cut at the
multiples of the window; a row is one piece, and the piece that reaches a window's end is its boundary
record. No shuffle is needed, and no task holds more than a batch of documents.

Tokens: the vocabulary's rules never join characters across ASCII white space, so a text's ids are
those of its blank-separated chunks, one after another, and each distinct chunk is encoded once a
process (a memo is emptied when it is full). Nor do they join letters with the ASCII punctuation after
them, so a plain word's ids serve all its punctuated forms. New words are encoded many at a time, one
a line; the id that ends a word tells where to part them. Tests compare this with encoding whole texts.

Padding: only the last sequence is shorter than the window; it is padded to the window unless its
length is a power of two, so padding is below one window in all.

Defined cases: a null or empty text is the end id alone; repeated and null doc_ids are packed like any other row; rows
keep the scan's order; other columns are ignored; an empty table gives no piece.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cairngraph.llm.common import map_arrow, texts, written

WINDOW = 4096
END_ID = 2
VOCABULARY = "word_bpe_49k.json"
#: Chunks, and words without their punctuation, that a process remembers; the longest that it does.
MEMO, MEMO_WORDS, MEMO_BYTES = 700_000, 800_000, 64
#: Words encoded in one call, and text bytes handled at once.
TOGETHER, BLOCK_BYTES = 128, 4 << 20

_PLAIN = re.compile(rb"([A-Za-z\x80-\xff]+)([^A-Za-z0-9\x80-\xff']*)")
#: The ASCII punctuation that may follow a plain word.
_AFTER = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b != 39)


class Encoder(dict):
    """Chunk bytes to its ids as 16-bit little-endian bytes."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        if max(vocabulary.values()) >= 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.last = np.zeros(1 << 16, bool)
        self.last[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.words: dict[bytes, bytes] = {b"": b""}

    def whole(self, chunk: bytes) -> bytes:
        return np.array(self.tokenizer.encode(chunk.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u2").tobytes()

    def __missing__(self, chunk: bytes) -> bytes:  # too long for the memo
        return self.whole(chunk)

    def learn(self, chunks: Iterable[bytes]) -> None:
        """Fills the memo for all the chunks that are short enough."""
        parts: dict[bytes, tuple[bytes, bytes]] = {}
        for c in chunks:
            if len(c) > MEMO_BYTES:
                continue
            if (w := c.rstrip(_AFTER)).isalpha():  # ASCII letters, as most are: what the pattern says, told faster
                parts[c] = w.lower(), c[len(w) :]
            elif (m := _PLAIN.fullmatch(c)) and (w := m[1].decode("utf-8", "replace")).isalpha() and w[-1] < "\u0250" and w[-1].lower().isalpha():
                parts[c] = m[1].lower(), m[2]
            else:
                self[c] = self.whole(c)
        if len(self.words) + len(parts) > MEMO_WORDS:
            self.words = {b"": b""}
        words = self.words
        new = list({w for w, _ in parts.values()} - words.keys())
        groups = [new[i : i + TOGETHER] for i in range(0, len(new), TOGETHER)]
        lines = [b"\n".join(g).decode("utf-8", "replace") for g in groups]
        for group, got in zip(groups, self.tokenizer.encode_batch_fast(lines, add_special_tokens=False), strict=True):
            ids = np.array(got.ids, "<u2")
            ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
            if len(ends) == len(group):
                raw = ids.tobytes()
                words.update(zip(group, (raw[2 * a : 2 * b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))
            else:  # a word that the rules part
                words.update((w, self.whole(w)) for w in group)
        for c, (w, rest) in parts.items():
            if rest not in words:
                words[rest] = self.whole(rest)
            self[c] = words[w] + words[rest]

    def many(self, texts: Iterable[bytes | None]) -> list[bytes]:
        split = [(t or b"").split() for t in texts]
        distinct = set().union(*split)
        new = distinct - self.keys()
        if len(self) + len(new) > MEMO:
            self.clear()
            new = distinct
        if new:
            self.learn(new)
        return [b"".join(map(self.__getitem__, w)) for w in split]


def _blocks(found: list[bytes | None]) -> Iterator[list[bytes | None]]:
    a = size = 0
    for b, t in enumerate(found, 1):
        size += len(t or b"")
        if size >= BLOCK_BYTES or b == len(found):
            yield found[a:b]
            a, size = b, 0


@cache
def encoder(path: str) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Encoder(path)


def padded(length: int, window: int = WINDOW) -> int:
    """The length of a sequence after padding."""
    return length if length and length & (length - 1) == 0 else window


def tokens(df: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """part, start (within the partition's run of ids), id and ids (16-bit) of every row."""
    path = path or public_tokenizers.path(VOCABULARY)
    src = df.select(F.col(text).cast("string").alias("__text"), F.col(doc_id).cast("long").alias("id"))
    end = np.array([end_id], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, enc = TaskContext.get().partitionId(), 0, encoder(path)
        for batch in batches:
            ids = [x + end for block in _blocks(texts(batch, 0)) for x in enc.many(block)]
            starts = list(accumulate((len(x) // 2 for x in ids), initial=at))
            at = starts.pop()
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()), batch.column(1), pa.array(ids, pa.binary())], ["part", "start", "id", "ids"]
            )

    return map_arrow(src, run, "part int, start bigint, id bigint, ids binary")


def pieces(start: int, ids: bytes, window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
    """(start in the document, length, crc32, sequence, offset) of a document whose first id is number
    `start` of all."""
    wide = np.frombuffer(ids, "<u2").astype("<u4")
    at = 0
    while at < len(wide):
        sequence, offset = divmod(start + at, window)
        n = min(window - offset, len(wide) - at)
        yield at, n, zlib.crc32(wide[at : at + n].tobytes()), sequence, offset
        at += n


def packed(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and boundary
    (the piece ends its sequence's window)."""
    held, _ = written(tokens(df, doc_id, text, path, end_id), "tokens")
    totals = held.groupBy("part").agg(F.max(F.col("start") + F.length("ids") / 2).cast("long").alias("n")).collect()  # a row a partition
    parts = sorted((r.part, r.n) for r in totals)
    base = dict(zip((p for p, _ in parts), accumulate((n for _, n in parts), initial=0), strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, start, who, ids = (c.to_pylist() for c in batch.columns)
            rows = [(w, a, n, crc, len(x) // 2, s, o, o + n == window) for p, b, w, x in zip(part, start, who, ids, strict=True) for a, n, crc, s, o in pieces(base[p] + b, x, window)]
            cols = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:-1]), pa.array(cols[-1], pa.bool_())], names)

    names = [doc_id, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "boundary"]
    return map_arrow(held, run, ", ".join(f"`{n}` bigint" for n in names[:-1]) + ", boundary boolean")
