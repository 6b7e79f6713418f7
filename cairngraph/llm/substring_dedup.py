"""Substring dedup: Rabin-Karp hashes of every window of consecutive words, counted in Spark; the repeated windows of a
document merge into maximal removal intervals.

The rows are dealt once into groups by their id. A task hashes every window of its rows and hands on, for each group and
hash, the least and the greatest id that holds it, packed into one row a bucket and block: a passage that a third of all
documents share costs two entries a group. Buckets are places of the shuffle; there the entries are told apart again and
a window over (hash, bucket) finds the least id of the whole corpus. What repeats goes back to the groups that
hold a greater id, where the rows meet it (the first exchange is used again), hash their windows once more and drop the words
that a repeated window covers. The texts are shuffled once, and each window once.

Hashes are polynomials modulo 2^31 - 1: two make the 62-bit hash, a third the bucket, so that with b buckets two
different windows are taken for one with a probability of 1 in b * 2^62.

Defined cases: a null or empty text has no words; fewer words than a window: nothing goes; a null id is neither smaller nor
larger than another, so such a row loses nothing and takes nothing from others; rows of one id take nothing from each other
(repeated rows stay as they are); texts of any length are hashed whole; other columns are ignored, whatever they are called;
ids are cast to long, and one that is no number fails; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairngraph.llm.common import blank_words, map_arrow, texts

WINDOW = 50
#: Modulus, and the bases of the two hashes and of the bucket's.
PRIME, BASES = (1 << 31) - 1, (1_103_515_245, 1_220_703_125, 1_664_525_039)
#: Groups of rows for each partition; windows that a task holds before it hands them on; words hashed at once.
GROUPS_A_PARTITION, HELD_WINDOWS, HELD_WORDS = 16, 1 << 20, 1 << 17
#: Distinct words whose hash a process remembers.
MEMO_WORDS = 1 << 20

_P, _BITS = np.uint64(PRIME), np.uint64(31)


class Letters(dict):
    """Word to its XXH64, each distinct word hashed once until the memo is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = x = xxhash.xxh64_intdigest(word)
        return x


def _folded(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1, up to one modulus too much."""
    x = (x & _P) + (x >> _BITS)
    return (x & _P) + (x >> _BITS)


def polynomial(letters: np.ndarray, base: int, window: int) -> np.ndarray:
    """The polynomial hash of every window of letters (below 2^31): hashes of 1, 2, 4, ... letters are put together from
    two of half the length, and the window from those that its length is made of."""
    if len(letters) < window:
        return np.zeros(0, np.uint64)
    n, part, size, out, left = len(letters) - window + 1, letters, 1, None, window
    parts = []
    while size <= window:
        if window & size:
            parts.append((size, part))
        if 2 * size <= window:
            part = _folded(part[:-size] * np.uint64(pow(base, size, PRIME)) + part[size:])
        size *= 2
    at = 0
    for size, part in reversed(parts):
        left -= size
        term = part[at : at + n] * np.uint64(pow(base, left, PRIME))
        out = _folded(term) if out is None else _folded(out + term)
        at += size
    return np.where(out >= _P, out - _P, out)


def window_hashes(words: np.ndarray, window: int, buckets: int = 0) -> tuple[np.ndarray, np.ndarray | None]:
    """The 62-bit hash (as a signed long) of every window of the words' 64-bit hashes, and its bucket, if asked for."""
    low, high = words & _P, (words >> _BITS) & _P
    h = (polynomial(low, BASES[0], window) << _BITS) | polynomial(high, BASES[1], window)
    place = (polynomial(high, BASES[2], window) % np.uint64(buckets)).astype(np.int64) if buckets else None
    return h.view(np.int64), place


def hashed(found: Iterable[bytes | None], letters: Letters) -> Iterator[tuple[list[int], list[list[bytes]], np.ndarray]]:
    """(places, words, all words' hashes in a row) of blocks of texts."""
    at: list[int] = []
    split: list[list[bytes]] = []
    size = 0
    for i, text in enumerate(found):
        at.append(i)
        split.append(blank_words(text or b""))
        size += len(split[-1])
        if size >= HELD_WORDS:
            yield at, split, np.fromiter((letters[w] for ws in split for w in ws), np.uint64, size)
            at, split, size = [], [], 0
    if at:
        yield at, split, np.fromiter((letters[w] for ws in split for w in ws), np.uint64, size)


def own_windows(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, start) of the windows that lie within one document of several in a row."""
    counts = np.maximum(lengths - window + 1, 0)
    of = np.repeat(np.arange(len(lengths)), counts)
    first = np.cumsum(lengths) - lengths
    before = np.cumsum(counts) - counts
    return of, np.arange(counts.sum()) - before[of] + first[of]


def least_and_greatest(group: np.ndarray, who: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of the least and the greatest id of every (group, hash), in order of group and id."""
    order = np.lexsort((who, group))
    kept = []
    for part in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
        by_hash = part[np.argsort(h[part], kind="stable")]  # part is in order of the ids, and equal hashes stay so
        new = np.flatnonzero(np.diff(h[by_hash], prepend=h[by_hash[:1]] - 1))
        least, greatest = by_hash[new], by_hash[np.append(new[1:], len(by_hash)) - 1]
        kept.append(np.concatenate([least, greatest[who[greatest] > who[least]]]))
    places = np.concatenate(kept)
    return places[np.lexsort((who[places], group[places]))]


def _entries(rows: DataFrame, window: int, buckets: int) -> DataFrame:
    """bucket, hashes and ids: the packed entries of a block of rows(grp, id, text)."""

    def packed(group: list[np.ndarray], who: list[np.ndarray], h: list[np.ndarray], place: list[np.ndarray]) -> pa.RecordBatch:
        group, who, h, place = (np.concatenate(x) for x in (group, who, h, place))
        keep = least_and_greatest(group, who, h)
        order = keep[np.argsort(place[keep], kind="stable")]
        at = place[order]
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        ends = pa.array(np.append(starts, len(at)), pa.int32())
        lists = (pa.ListArray.from_arrays(ends, pa.array(x[order], pa.int64())) for x in (h, who))
        return pa.RecordBatch.from_arrays([pa.array(at[starts], pa.int32()), *lists], ["bucket", "hashes", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, held, size = Letters(), ([], [], [], []), 0
        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            groups, ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for at, split, words in hashed(texts(batch, 2), letters):
                of, start = own_windows(np.array([len(w) for w in split]), window)
                if not len(of):
                    continue
                h, place = window_hashes(words, window, buckets)
                rows = np.array(at)[of]
                for column, x in zip(held, (groups[rows], ids[rows], h[start], place[start]), strict=True):
                    column.append(x)
                size += len(of)
                if size >= HELD_WINDOWS:
                    yield packed(*held)
                    held, size = ([], [], [], []), 0
        if size:
            yield packed(*held)

    return map_arrow(rows, run, "bucket int, hashes array<bigint>, ids array<bigint>")


def _cleaned(rows: pa.Table, repeated: pa.Table, window: int) -> pa.Table:
    """The rows of one group, without the words that its repeated windows cover."""
    h, first = (repeated.column(k).combine_chunks().to_numpy(zero_copy_only=False) for k in (1, 2))
    h, where = np.unique(h, return_index=True)
    first = first[where]
    ids = rows.column(1).to_pylist()
    letters = Letters()
    n_words, n_removed, spans, kept = [], [], [], []
    for at, split, words in hashed(rows.column(2).cast(pa.binary()).to_pylist(), letters):
        lengths = np.array([len(w) for w in split])
        covered = np.zeros(len(words) + 1, np.int64)
        of, start = own_windows(lengths, window)
        if len(of) and len(h):
            who = np.array([-(1 << 63) if ids[i] is None else ids[i] for i in at])[of]
            own = window_hashes(words, window)[0][start]
            place = np.minimum(np.searchsorted(h, own), len(h) - 1)
            start = start[(h[place] == own) & (first[place] < who)]
            np.add.at(covered, start, 1)
            np.add.at(covered, start + window, -1)
        gone = np.cumsum(covered[:-1]) > 0
        ends = np.cumsum(lengths)
        for ws, b, n in zip(split, (ends - lengths).tolist(), lengths.tolist(), strict=True):
            mask = gone[b : b + n]
            n_words.append(n)
            if not mask.any():
                n_removed.append(0)
                spans.append([])
                kept.append(b" ".join(ws))
                continue
            edges = np.flatnonzero(np.diff(mask, prepend=False, append=False)).tolist()
            cut = list(zip(edges[::2], edges[1::2], strict=True))
            n_removed.append(int(mask.sum()))
            spans.append([{"start": a, "end": e} for a, e in cut])
            bounds = [0, *edges, n]
            kept.append(b" ".join(w for a, e in zip(bounds[::2], bounds[1::2], strict=True) for w in ws[a:e]))
    return pa.table({
        "id": rows.column(1), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
        "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept": pa.array(kept, pa.binary()).cast(pa.string()),
    })


def without_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, removed (maximal intervals of words, ends exclusive) and kept (the other words, joined by
    one space) of every row. A word is removed if it lies in a window of words that also starts in a row of a smaller id."""
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    groups = parts * GROUPS_A_PARTITION
    group = lambda at: F.pmod(F.xxhash64(at), F.lit(groups)).cast("int")
    at, body = F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`").cast("string")
    # A null id says nothing of where its row goes; the text does, as it would otherwise make one group of all of them.
    rows = df.select(F.when(at.isNotNull(), group(at)).otherwise(group(body)).alias("grp"), at.alias("id"), body.alias("text")).repartition(parts, "grp")
    entry = _entries(rows, window, parts).repartitionById(parts, "bucket")
    each = entry.select("bucket", "ids", F.posexplode("hashes").alias("at", "hash")).select("bucket", "hash", F.get("ids", F.col("at")).alias("id"))
    same = Window.partitionBy("hash", "bucket")
    counted = each.select("hash", "id", F.min("id").over(same).alias("first"), F.count(F.lit(1)).over(same).alias("n"))
    repeated = counted.where((F.col("n") > 1) & (F.col("id") > F.col("first"))).select(group(F.col("id")).alias("grp"), "hash", "first")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return _cleaned(left, right, window)

    found = rows.groupBy("grp").cogroup(repeated.groupBy("grp")).applyInArrow(
        run, "id bigint, n_words bigint, n_removed bigint, removed array<struct<start:bigint,end:bigint>>, kept string"
    )
    return found.withColumnRenamed("id", doc_id)
