"""Cross-tokenizer alignment in relational steps: tokens are exploded with their places, windowed sums of their lengths say
where each starts, tokens of both kinds are brought together by equal starts, running counts of these cuts number the groups, and the
tokens that cover a start are the links.

Both tokenizers cut before every blank or line feed that follows no white space (no entry of either has such a place inside
it), so a text is a sequence of segments that are tokenised, and aligned, by themselves. A task takes its texts in blocks: of each
it hands on the tokens of the distinct segments, and every document as a list of them. One exchange deals both by
block; the segments are aligned where they lie, and the documents look up what became of theirs. A word that stands in all documents is
aligned once a block.

Where a token ends the next one starts, so cuts are found by starts as well as by ends. A link is a stretch of bytes that two
tokens share, and each starts where one of its two tokens does: the range join of overlapping tokens is a last-value window over the
starts, linear even in a text without blanks. How many documents hold a pair of ids linked is counted over all rows; the counts
are at most one for each two ids of the vocabularies, and go back to the rows by a broadcast below BROADCAST_PAIRS pairs and by a
shuffled join beyond it.

Defined cases: a null or empty text, and one whose tokens' bytes are not a blank and the text, has no tokens: zeros and an empty
digest; special tokens' strings are plain text; texts of any length are read whole; every row counts as a document, repeated ones
too; ids stay what they are, null included; other columns are ignored, whatever they are called; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairngraph.llm.common import BATCH_ROWS, map_arrow, written

A_VOCABULARY, B_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A pair of ids as one number: a * B_IDS + b, below 2^31 for these vocabularies.
B_IDS = 1 << 15
#: Pairs up to which their counts are broadcast (16 bytes each).
BROADCAST_PAIRS = 1 << 20
#: Characters of text that make a block; segments that are handed on together.
BLOCK_BYTES, CODED_TOGETHER = 10 << 20, 1 << 13
#: Partitions of the exchange for each of the session's: a task sorts a block or two at a time.
PARTITIONS = 4
#: Stands for an id where no token of a kind starts.
NO_ID = (1 << 16) - 1
#: A's special token: its string in a text is plain text.
SPECIAL = b"<|endoftext|>"
#: What stands before an id: first of a segment, first of B in a group, first of a group, any other.
_MARKS = (b"", b"|", b";", b",")
#: Segments whose links are gathered at once.
BLOCK_SEGMENTS = 1 << 16

# White space as Unicode has it; Python's and Java's own classes differ from one another.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SEGMENT_CUT = rf"(?<=[^{_SPACE}])(?=[ \n])"
_CUT, _RARE, _PLAIN = re.compile(SEGMENT_CUT), re.compile(rf"[{_SPACE}][ \n]"), re.compile(r"[ \n][^ \n]*")


def segments(text: str) -> list[str]:
    """The segments of a blank and the text."""
    text = " " + text
    return _CUT.split(text) if _RARE.search(text) else _PLAIN.findall(text)


def keys(text: str) -> list[str]:
    """The segments of a blank and the text, the blank before a word left out: what segment_of makes of each is the segment."""
    if not _RARE.search(" " + text):
        return text.replace("\n", " \n").split(" ")
    return [s if s[0] == "\n" or " " in s[1:] or "\n" in s[1:] else s[1:] for s in segments(text)]


def segment_of(key: str) -> str:
    return key if key.startswith((" ", "\n")) else " " + key


class Numbered(dict[str, int]):
    """Numbers keys as they are asked for first."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


class Pair:
    """Both tokenizers and the bytes of their entries. A's file is a byte-level one: its ids are the ranks of its merges, so a
    quicker reader of ranks gives the same ids."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece

        with open(a_path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        alphabet = _byte_alphabet()
        ranks = {bytes(alphabet[c] for c in t): i for t, i in vocabulary.items() if all(c in alphabet for c in t)}
        reader = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for t, i in ranks.items() if t != SPECIAL}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        piece = self.b.id_to_piece
        b_bytes = {i: bytes([int(piece(i)[1:-1], 16)]) if self.b.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())}
        if max(b_bytes) >= B_IDS or max(ranks.values()) >= NO_ID or (max(ranks.values()) + 1) * B_IDS > 1 << 31 or max(map(len, (*ranks, *b_bytes.values()))) > 255:
            raise ValueError("pairs of ids must fit 31 bits, and sizes 8")
        self.a = reader.encode_ordinary
        self.a_bytes, self.b_bytes = {i: t for t, i in ranks.items()}, b_bytes
        self.a_sizes, self.b_sizes = (np.array([len(x.get(i, b"")) for i in range(max(x) + 1)], np.uint8) for x in (self.a_bytes, self.b_bytes))
        self.blank = self.b.piece_to_id("▁")

    def coded(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(how many places each segment has, their tokens): at place k the k-th tokens of A and B as one number, from its lowest
        bit A's id, B's id (16 bits each), A's size and B's (8 bits each), sizes of 0 where one has no such token. A segment has no
        places if the bytes of its tokens are not the segment's. The tokenizer B adds a blank of its own: it takes the place of
        the segment's, or is dropped before a line feed, with which no entry joins it."""
        raw = [p.encode() for p in parts]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        b = self.b.encode([p[1:] if p[0] == " " else p for p in parts], num_threads=1)
        b = [(x or [self.blank]) if p[0] == " " else x[1:] for p, x in zip(parts, b, strict=True)]
        sides = [(*self._together(parts, raw, length), self.a_bytes, self.a_sizes), (*_flat(b), self.b_bytes, self.b_sizes)]
        good = np.logical_and(*(_same(raw, length, *side) for side in sides))
        n = np.where(good, np.maximum(sides[0][1], sides[1][1]), 0)
        first = np.cumsum(n) - n
        tokens = np.zeros(n.sum(), np.int64)
        for (ids, held, _, sizes), low, high in zip(sides, (0, 16), (32, 40), strict=True):
            own = np.repeat(good, held)
            at = (np.arange(len(ids)) + np.repeat(first - (np.cumsum(held) - held), held))[own]
            tokens[at] |= (ids[own] << low) | (sizes[ids[own]].astype(np.int64) << high)
        return n, tokens

    def _together(self, parts: list[str], raw: list[bytes], length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of all segments, and how many each has. As A cuts before the blank or line feed of a segment unless white space
        stands before it, all segments that do not end with white space are read as one text."""
        apart = [p[-1].isspace() for p in parts]
        if not any(apart):
            ids = np.array(self.a("".join(parts)), np.int64)
            ends, of_parts = np.cumsum(self.a_sizes[ids], dtype=np.int64), np.cumsum(length)
            last = np.searchsorted(ends, of_parts)
            if len(ends) and ends[-1] == of_parts[-1] and (ends[last] == of_parts).all():
                return ids, np.diff(last, prepend=-1)
        elif not all(apart):
            which = np.array(apart)
            found: list[list[int]] = [[]] * len(parts)
            for some in (np.flatnonzero(~which), np.flatnonzero(which)):
                ids, n = self._together([parts[i] for i in some], [raw[i] for i in some], length[some])
                for i, x in zip(some.tolist(), np.split(ids, np.cumsum(n)[:-1]), strict=True):
                    found[i] = x.tolist()
            return _flat(found)
        return _flat([self.a(p) for p in parts])


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, n.sum()), n


def _same(raw: list[bytes], length: np.ndarray, ids: np.ndarray, n: np.ndarray, entries: dict[int, bytes], sizes: np.ndarray) -> np.ndarray:
    """Which segments the bytes of their tokens give again: all are compared at once, and one by one only if that tells a
    difference."""
    said = [entries[t] for t in ids.tolist()]
    to = np.cumsum(n)
    told = np.append(0, np.cumsum(sizes[ids], dtype=np.int64))
    if (told[to] - told[to - n] == length).all() and b"".join(said) == b"".join(raw):
        return np.ones(len(raw), bool)
    return np.array([b"".join(said[j - k : j]) == p for p, j, k in zip(raw, to.tolist(), n.tolist(), strict=True)])


@cache
def pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def _byte_alphabet() -> dict[str, int]:
    """Byte-level entries write printable bytes as themselves and the others, in order, as characters from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}


class Block:
    """The texts of a block: the tokens of its distinct segments, and its documents as lists of these."""

    def __init__(self, number: int) -> None:
        self.number, self.size = number, 0
        self.segments = Numbered()
        self.ids: list[pa.Scalar] = []
        self.refs: list[bytes] = []

    def add(self, who: pa.Scalar, text: str | None, squeeze: zstandard.ZstdCompressor) -> None:
        found = keys(text) if text else []
        self.ids.append(who)
        self.refs.append(squeeze.compress(np.fromiter(map(self.segments.__getitem__, found), np.int32, len(found)).tobytes()))
        self.size += len(text or "")

    def batches(self, both: Pair, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        """block, seg and tokens of each segment, as Pair.coded has them; then block, id and refs of each document."""
        known = list(self.segments)
        self.segments.clear()  # the documents are numbered
        for i in range(0, len(known), CODED_TOGETHER):
            n, tokens = both.coded([segment_of(k) for k in known[i : i + CODED_TOGETHER]])
            offsets = pa.array(np.append(0, np.cumsum(n)), pa.int32())
            yield self._batch(range(i, i + len(n)), pa.ListArray.from_arrays(offsets, pa.array(tokens)), pa.nulls(len(n), kind), pa.nulls(len(n), pa.binary()))
        for i in range(0, len(self.ids), BATCH_ROWS):
            ids = pa.array([x.as_py() for x in self.ids[i : i + BATCH_ROWS]], kind)
            yield self._batch([None] * len(ids), pa.nulls(len(ids), pa.list_(pa.int64())), ids, pa.array(self.refs[i : i + BATCH_ROWS], pa.binary()))

    def _batch(self, seg: Iterable[int | None], *columns: pa.Array) -> pa.RecordBatch:
        seg = pa.array(list(seg), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([self.number] * len(seg), pa.int64()), seg, *columns], ["block", "seg", "tokens", "id", "refs"])


def coded(df: DataFrame, doc_id: str, text: str, a_path: str, b_path: str) -> DataFrame:
    """block and, of its distinct segments, seg and tokens; of its documents id and refs."""
    at, body = F.col(f"`{doc_id}`"), F.col(f"`{text}`").cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, squeeze = pair(a_path, b_path), zstandard.ZstdCompressor(level=1)
        number = TaskContext.get().partitionId() << 32
        block, kind = Block(number), None
        for batch in batches:
            kind = batch.column(0).type
            for who, t in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                block.add(who, t, squeeze)
                if block.size >= BLOCK_BYTES:
                    yield from block.batches(both, kind)
                    number += 1
                    block = Block(number)
        if block.ids:
            yield from block.batches(both, kind)

    kind = df.schema[doc_id].dataType.simpleString()
    return map_arrow(df.select(at.alias("id"), body.alias("text")), run, f"block bigint, seg int, tokens array<bigint>, id {kind}, refs binary")


def aligned_segments(tokens: DataFrame) -> DataFrame:
    """A row for each place of a segment of the block where a token starts, in order: block, seg, number of the alignment group, pair
    (of the tokens that lie over the place) and here (1 if A's starts here, 2 if B's does, 3 if both do; 0, and no pair, for a segment
    without tokens). All steps group by block, by which tokens is dealt, and sort what they bring together: nothing is shuffled again."""
    each = tokens.select("block", "seg", F.posexplode_outer("tokens").alias("at", "token"))
    bits = lambda c, low, n: F.shiftright(c, low).bitwiseAND(F.lit((1 << n) - 1))
    sums = Window.partitionBy("block", "seg").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)

    size = [bits(F.col("token"), low, 8) for low in (32, 40)]
    starts = [(F.sum(n).over(sums) - n).alias(f"start_{side}") for side, n in enumerate(size)]
    both = each.select("block", "seg", "token", *starts)
    # A start and the ids of A and B that start there as one number. Where both do at the same place of their lists, that is one row.
    known = [F.when(n > 0, bits(F.col("token"), 16 * side, 16)).otherwise(NO_ID) for side, n in enumerate(size)]
    row = lambda start, a, b: F.shiftleft(F.col(start), 32) + F.shiftleft(a, 16) + b
    none, met = F.lit(NO_ID).cast("long"), (size[0] > 0) & (size[1] > 0) & (F.col("start_0") == F.col("start_1"))
    first = F.when(F.col("token").isNull(), F.lit(-1).cast("long")).when(met, row("start_0", *known)).when(size[0] > 0, row("start_0", known[0], none))
    second = F.when((size[1] > 0) & ~met, row("start_1", none, known[1]))
    one = both.select("block", "seg", F.explode(F.array(first, second)).alias("x")).where(F.col("x").isNotNull())
    order = Window.partitionBy("block", "seg").orderBy("x")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    start = lambda c: F.shiftright(c, 32)
    last = lambda low: F.last(F.when(bits(F.col("x"), low, 16) != NO_ID, F.col("x")), True).over(so_far)
    # The last row of a start knows the tokens of both kinds that lie over it.
    over = one.select("block", "seg", "x", F.lead("x").over(order).alias("next"), last(16).alias("a"), last(0).alias("b"))
    over = over.where(F.col("next").isNull() | (start("next") != start("x")))
    here = sum(F.when(start(c) == start("x"), k).otherwise(0) for c, k in (("a", 1), ("b", 2)))
    over = over.select("block", "seg", "x", here.alias("here"), (bits(F.col("a"), 16, 16) * F.lit(B_IDS) + bits(F.col("b"), 0, 16)).cast("int").alias("pair"))
    number = F.count(F.when(F.col("here") == 3, 1)).over(so_far)
    return over.select("block", "seg", number.cast("int").alias("number"), F.col("here").cast("int").alias("here"), F.coalesce("pair", F.lit(0)).alias("pair"))


@cache
def _said() -> list[bytes]:
    """What is written for an id behind each mark."""
    return [m + b"%d" % i for m in _MARKS for i in range(1 << 16)]


class Aligned:
    """What became of the segments of one block, from the rows of aligned_segments."""

    def __init__(self, rows: pa.Table) -> None:
        numbers = lambda n: rows.column(n).combine_chunks().to_numpy()
        seg, group, here, pairs = (numbers(n) for n in ("seg", "number", "here", "pair"))
        if len(seg) and (np.diff(seg) < 0).any():
            order = np.argsort(seg, kind="stable")
            seg, group, here, pairs = (x[order] for x in (seg, group, here, pairs))
        self.starts = np.flatnonzero(np.diff(seg, prepend=-1))
        ends = np.append(self.starts[1:], len(seg)) if len(seg) else self.starts
        count = lambda x: np.add.reduceat(x.astype(np.int64), self.starts) if len(seg) else np.zeros(0, np.int64)
        self.n_a, self.n_b, self.n_links = count(here & 1), count(here >> 1), ends - self.starts
        self.n_groups = group[ends - 1].astype(np.int64) if len(seg) else np.zeros(0, np.int64)
        self.pairs, self.good = pairs, self.n_a > 0
        self.texts: list[bytes] = []
        for i in range(0, len(ends), CODED_TOGETHER):
            own = slice(self.starts[i], ends[min(i + CODED_TOGETHER, len(ends)) - 1])
            self.texts += self._texts(pairs[own], here[own], group[own], ends[i : i + CODED_TOGETHER] - own.start)

    @staticmethod
    def _texts(pairs: np.ndarray, here: np.ndarray, group: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The groups of each segment as `a1,a2|b1;a3|b2,b3`. A token's place is told by how many are in groups before its own, and
        for B's how many of A are in its own."""
        which = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        nth = np.cumsum((np.diff(which, prepend=0) != 0) | (np.diff(group, prepend=group[:1]) != 0))
        a, b = np.flatnonzero(here & 1), np.flatnonzero(here & 2)
        of_a, of_b = (np.bincount(nth[x], minlength=nth[-1] + 1) for x in (a, b))
        to_a, to_b = np.arange(len(a)) + (np.cumsum(of_b) - of_b)[nth[a]], np.arange(len(b)) + np.cumsum(of_a)[nth[b]]
        at, ids, side = (np.empty(len(a) + len(b), np.int64) for _ in range(3))
        for to, x, k, own in ((to_a, a, 0, pairs[a] // B_IDS), (to_b, b, 1, pairs[b] & (B_IDS - 1))):
            at[to], ids[to], side[to] = x, own, k
        new_segment, new_group, new_side = (np.diff(x, prepend=-1) != 0 for x in (which[at], nth[at], side))
        mark = np.where(new_segment, 0, np.where(new_side, np.where(side == 1, 1, 2), np.where(new_group, 2, 3)))
        said = list(map(_said().__getitem__, (mark << 16 | ids).tolist()))
        to = np.cumsum(np.bincount(which[at], minlength=len(ends))).tolist()
        return [b"".join(said[i:j]) for i, j in zip([0, *to], to, strict=False)]

    def links(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in which, pair) of every link of these segments."""
        n = self.n_links[which]
        of = np.repeat(np.arange(len(which)), n)
        at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + self.starts[which][of]
        return of, self.pairs[at]


_DOCUMENT = "id {id}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<int>, counts array<int>"


def _documents(rows: pa.Table, found: pa.Table, whole: bool) -> Iterator[pa.Table]:
    """The documents of one block, some at a time."""
    known, plain = Aligned(found), zstandard.ZstdDecompressor()
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "counts"]
    held: list[np.ndarray] = []
    first = size = 0

    def some(until: int) -> pa.Table:
        which = np.concatenate(held)
        n, doc = len(held), np.repeat(np.arange(len(held)), [len(x) for x in held])
        total = lambda x: np.bincount(doc, weights=x[which], minlength=n).astype(np.int64)  # noqa: E731  below 2^53
        of, pairs = known.links(which)
        both, count = np.unique(doc[of] * (1 << 31) + pairs, return_counts=True)
        offsets = pa.array(np.searchsorted(both >> 31, np.arange(n + 1)), pa.int32())
        said = [b";".join([known.texts[i] for i in x.tolist()]) for x in held]
        told = [("" if not x else x.decode() if whole else hashlib.sha256(x).hexdigest()) for x in said]
        lists = (pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in (both & ((1 << 31) - 1), count))
        numbers = (pa.array(total(x)) for x in (known.n_a, known.n_b, known.n_groups, known.n_links))
        return pa.Table.from_arrays([rows.column("id").slice(first, until - first).combine_chunks(), *numbers, pa.array(told, pa.string()), *lists], names)

    refs = rows.column("refs")
    for i, x in enumerate(refs):
        own = np.frombuffer(plain.decompress(x.as_py()), np.int32)
        held.append(own if known.good[own].all() else own[:0])
        size += len(own)
        if size >= BLOCK_SEGMENTS or i + 1 == len(refs):
            yield some(i + 1)
            held, first, size = [], i + 1, 0


def _above(dealt: DataFrame, condition: Column) -> DataFrame:
    """Rows of dealt, picked after its exchange. A plain filter, and the columns that are not asked for, would be taken out below
    it, which makes two exchanges of one, and two runs of what feeds it; a condition that is not deterministic and names all
    columns stays where it is."""
    every = F.greatest(*(F.col(c).isNull() for c in dealt.columns), F.lit(False))
    return dealt.where(F.when(F.monotonically_increasing_id() >= 0, condition).otherwise(every))


def documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", a_path: str | None = None, b_path: str | None = None, whole: bool = False) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, groups_sha256 (whole: the groups themselves, `a1,a2|b1;a3|b2,b3`), pairs (distinct
    pairs of ids that are linked, a * B_IDS + b) and counts (links of each) of every row."""
    spark = df.sparkSession
    a_path, b_path = a_path or public_tokenizers.path(A_VOCABULARY), b_path or public_tokenizers.path(B_VOCABULARY)
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = coded(df, doc_id, text, a_path, b_path).repartition(parts * PARTITIONS, "block")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.concat_tables(list(_documents(left, right, whole)))

    kind = df.schema[doc_id].dataType.simpleString()
    docs = _above(dealt, F.col("seg").isNull()).select("block", "id", "refs")
    tokens = _above(dealt, F.col("seg").isNotNull())
    return docs.groupBy("block").cogroup(aligned_segments(tokens).groupBy("block")).applyInArrow(run, _DOCUMENT.format(id=kind))


def pair_counts(docs: DataFrame) -> DataFrame:
    """pair, count (documents that hold it linked) and best (no pair of its A id has more)."""
    counts = docs.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("count"))
    of_a = Window.partitionBy(F.floor(F.col("pair") / B_IDS))
    return counts.select("pair", "count", (F.col("count") == F.max("count").over(of_a)).alias("best"))


def alignment(df: DataFrame, doc_id: str = "doc_id", text: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best (links whose count is the highest of their A id), count_sum (over links) and
    groups_sha256 of every row."""
    docs, _ = written(documents(df, doc_id, text, a_path, b_path).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts, _ = written(pair_counts(docs), "pairs")
    if counts.count() <= BROADCAST_PAIRS:
        counts = F.broadcast(counts)
    held = docs.select("row", F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.counts").cast("long").alias("n"))
    sums = held.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return docs.join(sums, "row", "left").select(F.col("id").alias(doc_id), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
