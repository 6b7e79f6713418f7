"""Shared plumbing of the corpus operators: tables, the shared folder, word rules, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Maps A-Z to a-z and every ASCII byte that is no letter or digit to a space; bytes above 0x7F stay.
ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alnum_words(text: bytes) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z."""
    return text.translate(ALNUM).split()


def blank_words(text: bytes) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+`: bytes.split() splits at exactly these six bytes."""
    return text.split()


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder below spark.checkpoint.dir or, where that is unset, the context's checkpoint folder: every executor
    and the driver reach it. On one machine only (master local) a folder of this machine may stand in for them."""
    context = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not top and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    top = top or f"{tempfile.gettempdir()}/checkpoints"
    return f"{top.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, compression: str = "zstd") -> tuple[DataFrame, str]:
    """Writes df as Parquet into the shared folder and reads it again: lineage is cut, and a lost
    executor costs nothing that was written."""
    spark = df.sparkSession
    path = shared_folder(spark, what)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Deletes folders that no later step reads."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def texts(batch: pa.RecordBatch, column: str | int = "text") -> list[bytes | None]:
    """The column's UTF-8 bytes, null as None."""
    i = batch.schema.get_field_index(column) if isinstance(column, str) else column
    a = batch.column(i)
    if pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type):
        return a.cast(pa.large_binary()).to_pylist()
    return a.cast(pa.binary()).to_pylist()


#: Rows that JVM and Python exchange at a time: with whole texts in them, what bounds a task's memory.
BATCH_ROWS = 1000


def map_arrow(
    df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """mapInArrow for columns of any name, dots included (Spark's own looks its input up by name); f sees and gives the
    names as they are. Batches of the session are made no larger than BATCH_ROWS."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    names, out = df.columns, T.StructType.fromDDL(schema)
    plain = [f"c{n}" for n in range(len(out))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in f(b.rename_columns(names) for b in batches):
            yield batch.rename_columns(plain)

    given = df.toDF(*(f"c{n}" for n in range(len(names))))
    made = given.mapInArrow(run, T.StructType([T.StructField(p, x.dataType) for p, x in zip(plain, out.fields, strict=True)]))
    return made.toDF(*out.names)


def beside(keep: Sequence[str], outputs: Iterable[str]) -> list[str]:
    """Names of kept columns beside an operator's own: one that an output is called by is returned as `<name>_kept`."""
    taken, names = {*outputs}, []
    for c in keep:
        while c in taken:
            c += "_kept"
        taken.add(c)
        names.append(c)
    return names


def renamed(keep: Sequence[str], outputs: Iterable[str]) -> list[Column]:
    """The kept columns under the names of beside()."""
    return [F.col(f"`{c}`").alias(n) for c, n in zip(keep, beside(keep, outputs), strict=True)]


def kept_with_text(df: DataFrame, text: str, keep: Sequence[str]) -> tuple[DataFrame, int, list[int]]:
    """(frame, place of the text, places of the kept columns); a text that is kept is sent only once."""
    keep = list(df.columns) if list(keep) == ["*"] else list(keep)
    cols = [F.col(f"`{c}`") for c in keep]
    if text in keep and dict(df.dtypes)[text] == "string":
        return df.select(*cols), keep.index(text), list(range(len(keep)))
    return df.select(F.col(f"`{text}`").cast("string").alias("__text"), *cols), 0, list(range(1, len(keep) + 1))
