"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Every run of ten item words is a pattern; a shorter item is one pattern. Text and patterns are
normalised to words with one space before, between and after them, so a match starts and ends at
words. Each text is scanned once; matches mark the words they cover, and a word's place in the
original text is known from its number.

The items must fit the automaton: `MAX_PATTERN_WORDS` words of patterns an automaton is the checked
bound (about 340 bytes a word in each Python worker). Larger item sets are dealt into blocks, equal texts once and long ones in pieces: one automaton and one scan of
all rows a block, with the marks so far written to the shared folder in between, so that no task ever holds more than one block.

Defined cases: a null text has no words and is clean; texts of any length are read whole; a null or wordless item gives no pattern; a null item_id counts
as an item named by the empty string; items are told apart by id, and equal ones under several ids all count; repeated
doc_ids stay separate rows; other columns are ignored; no items: every text is clean; a kept column that is called like
an output comes back as `<name>_kept`; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairngraph.llm.common import alnum_words, beside, kept_with_text, map_arrow, texts, written

WINDOW = 10
MAX_PATTERN_WORDS = 1_000_000
#: A long item is cut into pieces of a PIECES-th of an automaton.
PIECES = 16
#: The words of a text whose A-Z are not lower-cased yet.
_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010FFFF]+")


#: The automaton of the block that this process scans for, by the block's digest: tasks come with blocks of their own.
_ready: dict[str, ahocorasick.Automaton] = {}


class Items:
    """Patterns of a block of items; their automaton is made on first use in a process, and serves all tasks that follow there."""

    def __init__(self, rows: Sequence[tuple[tuple[str, ...], bytes]], window: int = WINDOW) -> None:
        """rows: (ids, text)"""
        self.rows, self.window = list(rows), window
        self.digest = hashlib.sha256(repr((self.rows, window)).encode()).hexdigest()

    def ready(self) -> ahocorasick.Automaton:
        if self.digest not in _ready:
            owners: dict[str, tuple[int, set[int]]] = {}
            for i, (_, text) in enumerate(self.rows):
                words = alnum_words(text)
                for k in range(max(1, len(words) - self.window + 1)) if words else ():
                    run = words[k : k + self.window]
                    owners.setdefault(_line(run), (len(run), set()))[1].add(i)
            automaton = ahocorasick.Automaton()
            for p, (n, who) in owners.items():
                automaton.add_word(p, (n, tuple(who)))
            automaton.make_automaton()
            _ready.clear()  # one block at a time
            _ready[self.digest] = automaton
        return _ready[self.digest]

    def scan(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], set[int]]:
        """Number of words, merged hit runs as (first word, end word), and the items met."""
        automaton = self.ready()
        words = alnum_words(text or b"")
        runs: list[tuple[int, int]] = []
        items: set[int] = set()
        if not len(automaton) or not words:
            return len(words), runs, items
        line = _line(words)
        spaces, at = 0, 0
        for last, (n, who) in automaton.iter(line):
            items.update(who)
            spaces += line.count(" ", at, last)  # those before the one that ends the match: words so far
            at = last
            start = spaces - n
            while runs and runs[-1][1] >= start:
                start = min(start, runs.pop()[0])
            runs.append((start, spaces))
        return len(words), runs, items


def _line(words: Sequence[bytes]) -> str:
    """A character for each byte, so that any bytes can be matched."""
    return (b" " + b" ".join(words) + b" ").decode("latin-1")


def original_offsets(text: str, runs: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as (start, end) in the text's characters."""
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in runs]


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _parted(items: DataFrame, item_id: str, text: str, window: int, most: int) -> tuple[DataFrame, int]:
    """(ids, t, part): the distinct item texts with their ids, long ones cut into pieces that share window - 1 words, and into
    how many parts they are dealt. A piece has about most / PIECES pattern words at most; hashed into small buckets, they
    fill one part after the other up to `most`."""
    piece = max(1, most // (PIECES * window) - window)
    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    texts_ = rows.groupBy("t").agg(F.sort_array(F.collect_set("i")).alias("ids"))
    words = F.filter(F.split("t", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != "")
    windows = F.greatest(F.size("w") - window + 1, F.lit(1))
    starts = F.sequence(F.lit(0), windows - 1, F.lit(piece))
    cut = texts_.withColumn("w", words).where(F.size("w") > 0).select("ids", F.explode(F.transform(starts, lambda p: F.slice("w", p + 1, F.lit(piece + window - 1)))).alias("w"))
    cut = cut.select("ids", F.array_join("w", " ").alias("t"), (F.size("w") * window).cast("long").alias("n"))
    total = cut.agg(F.sum("n")).first()[0] or 0
    buckets = PIECES * -(-total // most) if total > most else 1
    bucket = F.pmod(F.xxhash64("t"), F.lit(buckets)).cast("int")
    part, room, part_of = -1, 0, [0] * buckets
    for r in cut.groupBy(bucket.alias("b")).agg(F.sum("n").alias("n")).orderBy("b").collect():  # PIECES rows a part
        if part < 0 or r.n > room:
            part, room = part + 1, most
        room -= r.n
        part_of[r.b] = part
    return cut.select("ids", "t", F.get(F.array(*map(F.lit, part_of)), bucket).alias("part")), max(part, 0) + 1


def _scanned(state: DataFrame, block: Items, at: int, kept: Sequence[int], width: int, last: bool) -> DataFrame:
    """state: width columns c0, c1, ... (the text is c<at>), then n_words, runs and items of earlier blocks, if any.
    The last block's scan gives the kept columns and the results."""
    resumed, through = len(state.columns) > width, list(kept) if last else list(range(width))
    names = [f"c{i}" for i in through]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = list(zip(batch.column(width + 1).to_pylist(), batch.column(width + 2).to_pylist(), strict=True)) if resumed else None
            n_words, hits, found, spans = [], [], [], []
            for j, t in enumerate(texts(batch, at)):
                n, runs, who = block.scan(t)
                met = [x for i in who for x in block.rows[i][0]]
                if old:
                    runs, met = _merged(runs + [(r["start"], r["end"]) for r in old[j][0]]), met + old[j][1]
                n_words.append(n)
                hits.append(sum(b - a for a, b in runs))
                found.append(sorted(set(met)))
                shown = original_offsets(t.decode("utf-8", "replace"), runs) if last and runs else runs
                spans.append([{"start": a, "end": b} for a, b in shown])
            cols = [pa.array(n_words, pa.int64()), *([pa.array(hits, pa.int64())] if last else []), *([] if last else [pa.array(spans, _RUNS)]), pa.array(found, pa.list_(pa.string())), *([pa.array(spans, _RUNS)] if last else [])]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in through), *cols], [*names, *results])

    results = ["n_words", "n_hit", "items", "spans"] if last else ["n_words", "runs", "items"]
    kinds = dict(n_words="bigint", n_hit="bigint", items="array<string>", spans="array<struct<start: bigint, end: bigint>>", runs="array<struct<start: bigint, end: bigint>>")
    fields = [f"c{i} {state.schema[i].dataType.simpleString()}" for i in through] + [f"{r} {kinds[r]}" for r in results]
    return map_arrow(state, run, ", ".join(fields))


def contamination(
    df: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    keep: Sequence[str] | None = None, window: int = WINDOW, max_pattern_words: int = MAX_PATTERN_WORDS,
) -> DataFrame:
    """The kept columns (the id unless named), n_words, n_hit, n_items, items (sorted item ids), spans (start
    and end of each hit run in the text's characters) and contaminated."""
    src, at, kept = kept_with_text(df, text, [doc_id] if keep is None else keep)
    names = src.columns
    state = src.toDF(*(f"c{i}" for i in range(len(names))))
    parted, parts = _parted(items, item_id, item_text, window, max_pattern_words)
    for k in range(parts):  # one, unless the items exceed the automaton's bound
        block = Items([(tuple(r.ids), r.t.encode()) for r in parted.where(F.col("part") == k).collect()], window)
        state = _scanned(state, block, at, kept, len(names), k == parts - 1)
        if k < parts - 1:
            state, _ = written(state, "contamination")
    own = ("n_words", "n_hit", "items", "spans", "n_items", "contaminated")
    shown = beside([names[i] for i in kept], own)
    out = state.select(*(F.col(f"c{i}").alias(n) for i, n in zip(kept, shown, strict=True)), *own[:4])
    return out.withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", F.col("n_hit") > 0)


def clean(df: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of df without a hit; columns stay as they are."""
    mine = df.select(*(F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(df.columns)))
    at = f"c{df.columns.index(text)}"
    found = contamination(mine, items, doc_id, at, item_id, item_text, mine.columns)
    return found.where(~F.col("contaminated")).select(*(F.col(f"c{n}").alias(c) for n, c in enumerate(df.columns)))


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def items_digest(column: str = "items") -> F.Column:
    return F.sha2(F.array_join(column, ","), 256)

