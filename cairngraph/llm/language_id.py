"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features: code-point n-grams of length 1 to 4 of the lower-cased text with every run of other than
letters made one space, hashed into BUCKETS; TF is 1 + log(count), IDF from all rows that may be trained on,
vectors have length one. Training: follow-the-regularised-leader (per-coordinate step sizes, L1 and L2
penalties, so rare buckets keep weight zero) over a bounded sample of labelled rows; then one
temperature is fitted on a part of the sample left out of training, so that scores are calibrated.

Bounds: at most MAX_TRAIN rows in expectation, shared evenly by languages, are featurised on the
executors and sent to the driver as sparse counts, with all their features: 6 bytes a bucket, so 192 KB at most however long the
text (texts of the usual length: some 6 KB). Prediction reads every whole text with all its features.

Defined cases: a letter is what Unicode calls one (categories L): digits and other numbers (`½`, `Ⅷ`) are none. A null
text or one without letters is `und` with score 0; a null label takes no part
in training; without any labelled row every text is `und` with score 0; one label only: that label
with score 1; rows are predicted alone, so null and repeated ids need no care; other columns are ignored; a kept column that is called like an output comes back
as `<name>_kept`; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairngraph.llm.common import beside, kept_with_text, map_arrow, texts

LENGTHS = (1, 2, 3, 4)
BUCKETS = 1 << 15
#: Labelled rows to train on, all languages together (the documented bound).
MAX_TRAIN = 3000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.002, 0.001
#: Every so many rows of the sample one is kept for the temperature.
HELD_FOR_TEMPERATURE = 5
UNDETERMINED = "und"

_OTHER = re.compile(r"[\W\d_]+")


@cache
def _numbers() -> np.ndarray:
    """Which code points are numbers that neither `\\W` nor `\\d` takes, yet no letters."""
    return np.fromiter((c.isalnum() and not c.isalpha() for c in map(chr, range(0x110000))), bool, 0x110000)


def _points(text: str) -> np.ndarray:
    """Code points of the lower-cased text, with a space for every run of other than letters."""
    points = np.frombuffer(_OTHER.sub(" ", text.lower()).encode("utf-32-le", "surrogatepass"), np.uint32)
    number = _numbers()[points]
    if number.any():
        points = np.where(number, np.uint32(32), points)
        points = points[np.append(True, (points[1:] != 32) | (points[:-1] != 32))]
    if len(points) and points[0] == 32:
        points = points[1:]
    return points[:-1] if len(points) and points[-1] == 32 else points


def counts(text: bytes | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Buckets and their counts; None without a letter."""
    if not text:
        return None
    points = _points(text.decode("utf-8", "replace"))
    if not len(points):
        return None
    points = np.concatenate([[32], points, [32]]).astype(np.uint32)
    h = np.zeros(len(points), np.uint32)
    hashed = []
    for n in range(1, max(LENGTHS) + 1):
        h = (h[: max(0, len(points) - n + 1)] * np.uint32(0x01000193)) ^ points[n - 1 :]
        if n in LENGTHS:
            hashed.append(((h + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(17))
    total = np.bincount(np.concatenate(hashed), minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at, total[at]


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray  # BUCKETS x labels
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = (1 + np.log(n)) * self.idf[at]
        size = np.sqrt((x * x).sum())
        return (x / size if size else x).astype(np.float32)

    def logits(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.vector(at, n) @ self.weights[at] + self.bias

    def predict(self, text: bytes | None) -> tuple[str, float]:
        if not self.labels or (c := counts(text)) is None:
            return UNDETERMINED, 0.0
        p = _softmax(self.logits(*c) / self.temperature)
        k = int(p.argmax())
        return self.labels[k], float(p[k])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], frequencies: tuple[int, np.ndarray], epochs: int = EPOCHS) -> Model:
    """rows: (label, buckets, counts), in a fixed order; frequencies: those of the corpus that rows are drawn from."""
    labels = sorted({r[0] for r in rows})
    total, seen = frequencies
    idf = (np.log((1 + total) / (1 + seen)) + 1).astype(np.float32)
    k = len(labels)
    model = Model(labels, idf, np.zeros((BUCKETS, k), np.float32), np.zeros(k, np.float32))
    if k < 2:
        return model
    place = {x: i for i, x in enumerate(labels)}
    held = [r for i, r in enumerate(rows) if i % HELD_FOR_TEMPERATURE == 0]
    train = [r for i, r in enumerate(rows) if i % HELD_FOR_TEMPERATURE]
    if not train:
        train, held = rows, rows
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(train)):
            y, at, c = train[i]  # vectors are made anew each time: kept, they would take several times the counts' space
            at, x = np.append(at.astype(np.int64), BUCKETS), np.append(model.vector(at, c), 1.0)
            w = _ftrl(z[at], n[at])
            g = np.outer(x, _softmax(x @ w) - np.eye(k)[place[y]])
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    w = _ftrl(z, n)
    model.weights, model.bias = w[:-1].astype(np.float32), w[-1].astype(np.float32)
    model.temperature = _temperature([(model.logits(at, c), place[y]) for y, at, c in held])
    return model


def _ftrl(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _temperature(held: list[tuple[np.ndarray, int]]) -> float:
    """The temperature of least log loss, by golden section over its logarithm."""
    zs, ys = np.array([h[0] for h in held], float), np.array([h[1] for h in held])

    def loss(log_t: float) -> float:
        s = zs / np.exp(log_t)
        s -= s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(ys)), ys]).mean())

    a, b, r = np.log(0.05), np.log(5.0), (5**0.5 - 1) / 2
    for _ in range(50):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def sample(df: DataFrame, label: str = "lang", text: str = "text", salt: str = "doc_id", most: int = MAX_TRAIN) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """Features of a sample of the labelled rows of df, `most` in all, spread evenly over the labels. Whether a row is
    drawn depends on a hash of its salt column only. Ordered by that hash."""
    rows = df.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("y"), F.col(text).cast("string").alias("t"), F.xxhash64(F.col(salt).cast("string"), F.lit("sample")).alias("h"))
    sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "y").limit(most).collect()}
    if not sizes:
        return []
    each = max(1, most // len(sizes))
    share = F.create_map(*(x for y, n in sizes.items() for x in (F.lit(y), F.lit(min(1.0, each / n)))))
    drawn = rows.where((F.pmod("h", F.lit(1 << 20)) / float(1 << 20)) < F.element_at(share, F.col("y")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counts(t) for t in texts(batch, 1)]
            raw = [None if f is None else f[0].astype("<u2").tobytes() + f[1].astype("<u4").tobytes() for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(raw, pa.binary())], ["y", "h", "f"])

    got = map_arrow(drawn, run, "y string, h bigint, f binary").where("f IS NOT NULL").toArrow().sort_by([("h", "ascending"), ("f", "ascending")])
    out = []
    for y, f in zip(got.column("y").to_pylist(), got.column("f").to_pylist(), strict=True):
        n = len(f) // 6
        out.append((y, np.frombuffer(f, "<u2", n), np.frombuffer(f, "<u4", n, 2 * n)))
    return out


def document_frequencies(df: DataFrame, label: str = "lang", text: str = "text") -> tuple[int, np.ndarray]:
    """The number of labelled rows with features, and of those with each bucket. A task hands on one row a bucket."""
    rows = df.where(F.col(label).isNotNull()).select(F.col(text).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS + 1, np.int64)  # the last: rows
        for batch in batches:
            for t in texts(batch, 0):
                if (c := counts(t)) is not None:
                    seen[c[0]] += 1
                    seen[BUCKETS] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], ["bucket", "n"])

    got = map_arrow(rows, run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(BUCKETS + 1, np.int64)
    seen[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return int(seen[BUCKETS]), seen[:BUCKETS]


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text leaves 2 when divided by 4; a null id is held out too, as nothing tells otherwise."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(True))


def predictions(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, lang_pred and score of every row."""
    src, at, kept = kept_with_text(df, text, keep)
    shared = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS x labels weights, whatever the corpus
    names = beside([src.columns[i] for i in kept], ("lang_pred", "score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = [m.predict(t) for t in texts(batch, at)]
            cols = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *cols], [*names, "lang_pred", "score"])

    fields = "".join(f"`{n}` {src.schema[i].dataType.simpleString()}, " for n, i in zip(names, kept, strict=True))
    return map_arrow(src, run, f"{fields}lang_pred string, score double")


def trained(df: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "lang", most: int = MAX_TRAIN) -> Model:
    """A model of the rows that are not held out."""
    rows = df.where(~held_out(doc_id))
    return fit(sample(rows, label, text, doc_id, most), document_frequencies(rows, label, text))


#: A document is rejected when its language is undetermined or its calibrated score is lower than this.
LEAST_SCORE = 0.5


def with_known_language(df: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "lang", least: float = LEAST_SCORE) -> DataFrame:
    """The rows of df whose language the model tells; columns stay as they are."""
    found = predictions(df, trained(df, doc_id, text, label), text, ("*",))
    found = found.toDF(*(f"c{n}" for n in range(len(df.columns))), "__lang", "__score")
    kept = found.where((F.col("__lang") != UNDETERMINED) & (F.col("__score") >= least))
    return kept.select(*(F.col(f"c{n}").alias(c) for n, c in enumerate(df.columns)))
