"""Mailboxes of any size, read by ranges of bytes.

Spark parts a mailbox into ranges, and a task puts the lines of its ranges together to pieces: a message that begins and ends in a
range is one, and so are the lines before a range's first separator, which go to a message that an earlier range began, and those from
its last separator on. The separators of a range are counted where it lies, and a prefix sum
over the ranges of a file numbers its messages, so every message has one owner, however many ranges it spans. One exchange brings the
pieces of a message together; of messages above the limit only sizes are gathered, the bytes are not.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairngraph.functions import keys as K
from cairngraph.operators import mail
from cairngraph.operators.base import OBSERVATIONS
from cairngraph.shared import shared_folder
from cairngraph.sources.numbering import numbered_by

_NAMES = [f.split()[0] for f in OBSERVATIONS.split(",")]
_INTS = {"schema_version", "start_line", "end_line"}


#: Pieces that a task holds before it hands them on, and the bytes of them.
AT_ONCE, BYTES_AT_ONCE = 1000, 8 << 20
#: Tasks a core that put pieces together: with more ranges than that, a task takes several, one after another.
RANGES_A_CORE = 16


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, range (its first byte) and line (bytes, without its line feed) of mailboxes, in order within a range."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.col("value").cast("binary").alias("line"))


def cut(rows: Iterable[tuple[str, int, bytes]], most_bytes: int) -> Iterator[tuple[str, int, int, int, bytes | None]]:
    """(file, range, k, size, content) of the pieces of (file, range, line): k is the separator of the range that a piece begins with, from
    1, or 0; the separator is not part of it. No content above most_bytes."""
    place, k, size, held, kept = None, 0, 0, [], 0
    for file, begin, line in rows:
        starts, here = line.startswith(b"From "), (file, begin)
        if starts or here != place:
            if place is not None:
                yield *place, k, size, b"".join(held) if kept == size else None
            k = 0 if not starts else k + 1 if here == place else 1
            place, size, held, kept = here, 0, [], 0
        if not starts:
            size += len(line) + 1
            if size <= most_bytes:
                held += (line, b"\n")
                kept = size
            else:
                held = []
    if place is not None:
        yield *place, k, size, b"".join(held) if kept == size else None


def pieces(spark: SparkSession, path: str, most_bytes: int = mail.MOST_BYTES) -> DataFrame:
    """file, range, k, size and content of all pieces (see cut)."""

    def handed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "range", "k", "size", "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        each = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for piece in cut(each, most_bytes):
            rows.append(piece)
            held += len(piece[4] or b"")
            if len(rows) >= AT_ONCE or held >= BYTES_AT_ONCE:
                yield handed(rows)
                rows, held = [], 0
        if rows:
            yield handed(rows)

    each_task = lines(spark, path).coalesce(spark.sparkContext.defaultParallelism * RANGES_A_CORE)  # keeps the order within a range
    return each_task.mapInArrow(run, "file string, range bigint, k bigint, size bigint, content binary")


def _ranges(spark: SparkSession, path: str) -> DataFrame:
    """file, range and base (messages of the file that begin before the range). Written once, so that its size, a row a range, is known."""
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    counted = lines(spark, path).groupBy("file", "range").agg(F.count_if(F.substring("line", 1, 5) == F.lit(b"From ")).alias("n"))
    rows, at = counted.select("file", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), shared_folder(spark, "ranges")
    rows.write.parquet(at)
    return spark.read.schema(rows.schema).parquet(at)


def messages(spark: SparkSession, path: str, most_bytes: int = mail.MOST_BYTES) -> DataFrame:
    """file, message (from 1), size and pieces (their bytes in order; null above most_bytes) of all messages."""
    placed = pieces(spark, path, most_bytes).join(_ranges(spark, path), ["file", "range"]).withColumn("message", F.col("base") + F.col("k")).where("message > 0")
    whole = placed.withColumn("total", F.sum("size").over(Window.partitionBy("file", "message")))
    held = F.collect_list(F.when(F.col("total") <= most_bytes, F.struct("range", "content")))
    bodies = whole.groupBy("file", "message").agg(F.max("total").alias("size"), F.transform(F.array_sort(held), lambda x: x["content"]).alias("pieces"))
    return bodies.select("file", "message", "size", F.when(F.col("size") <= most_bytes, F.col("pieces")).alias("pieces"))


def observations(spark: SparkSession, path: str, most_bytes: int = mail.MOST_BYTES) -> DataFrame:
    """The observations of every message of the mailboxes: what the whole file's extractor tells of them, without its limits on bytes
    and messages of a mailbox. seq: the message, then the place in it."""
    found = messages(spark, path, most_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for file, n, parts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                raw = b"x" * (mail.MOST_BYTES + 1) if parts is None else mail.unescaped(b"".join(parts))
                for k, o in enumerate(mail.message(file, raw, "mbox", n)):
                    rows.append(o | {"metadata": K.canonical_json(o["metadata"]), "message": n, "seq": k})
            columns = [pa.array([r[c] for r in rows], pa.int32() if c in _INTS else pa.string()) for c in _NAMES]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([r[c] for r in rows], pa.int64()) for c in ("message", "seq"))], [*_NAMES, "message", "seq"])

    return found.select(F.regexp_replace("file", "^.*/", "").alias("file"), "message", "pieces").mapInArrow(run, f"{OBSERVATIONS}, message bigint, seq bigint")


def loadable(spark: SparkSession, path: str, run_id: int = 1) -> DataFrame:
    """The observations in the order of files and messages, as a store loads them."""
    rows = numbered_by(observations(spark, path), "path", "message", "seq")
    return rows.select(F.lit(run_id).cast("long").alias("run_id"), "ordinal", *_NAMES)
