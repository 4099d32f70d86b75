"""Quality scores from document statistics.

Statistics of a text (shares of character kinds, word lengths, repetition) are
standardised and mapped by random Fourier features, whose inner products
approximate a Gaussian kernel.  Each partition sums its part of the normal
equations; the sums give a ridge regression on the labels, and an isotonic fit
turns its value into the share of good documents at that value.

The matrices that meet on the driver have a fixed size (``FOURIER`` squared, at
most ``SLOTS`` of them), as has the calibration table (``BINS`` rows).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanac.llm.text import grams, slices, word_hashes, word_spans
from almanac.session import cut_lineage

FOURIER = 384
WIDTH = 1.0  # kernel width in units of the root of the number of statistics
RIDGE = 1e-3  # per training row
BINS = 400
SLOTS = 16
THRESHOLD = 0.3

_KINDS = {  # shares of bytes
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "line": b"\n", "space": b" \t\r\x0b\x0c", "stop": b".",
    "comma": b",;:", "bang": b"!?", "bar": b"|", "symbol": b"#$%&*+=@^~_\\", "bracket": b"<>()[]{}/", "quote": b"\"'`-",
}
NAMES = [*_KINDS, "wide", "log_bytes", "log_words", "word_size", "word_spread", "short_words", "long_words", "plain_words",
         "distinct_words", "top_word", "same_as_before", "distinct_trigrams", "line_words", "distinct_lines"]


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of ``NAMES`` for each text; all zero for a text without words."""
    n = len(off) - 1
    out = np.zeros((n, len(NAMES)))
    size = np.diff(off)
    if not len(data):
        return out
    col = 0

    def shares(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[off[1:]] - total[off[:-1]]) / np.maximum(size, 1)

    for kind in _KINDS.values():
        table = np.zeros(256, bool)
        table[np.frombuffer(kind, np.uint8)] = True
        out[:, col] = shares(table[data])
        col += 1
    out[:, col] = shares(data >= 128)
    s, e, words = word_spans(data, off)
    count = np.diff(words)
    out[:, col + 1], out[:, col + 2] = np.log1p(size), np.log1p(count)
    col += 3
    if not len(s):
        out[:] = 0
        return out
    length = (e - s).astype(float)
    letter = np.zeros(256, bool)
    letter[ord("a"):ord("z") + 1] = letter[ord("A"):ord("Z") + 1] = letter[128:] = True
    last = data[e - 1]

    def means(x: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(x)])
        return (total[words[1:]] - total[words[:-1]]) / np.maximum(count, 1)

    mean = means(length)
    for x in (mean, np.sqrt(np.maximum(means(length ** 2) - mean ** 2, 0)), means(length <= 3), means(length >= 12), means(letter[last])):
        out[:, col] = x
        col += 1
    h, _ = word_hashes(data, off, lower=True)
    same = np.zeros(len(h))
    same[1:] = h[1:] == h[:-1]
    g, at = grams(h, words, 3)
    cut = np.searchsorted(at, words)
    line = np.concatenate([[0], np.cumsum(data == 10)])
    number = line[s]  # the line that a word stands in
    for k in range(n):
        a, b = words[k], words[k + 1]
        if a == b:
            out[k] = 0
            continue
        _, times = np.unique(h[a:b], return_counts=True)
        mine = number[a:b] - number[a]
        starts = np.flatnonzero(np.diff(mine, prepend=-1))
        lines = np.add.reduceat(h[a:b] * (2 * np.arange(b - a, dtype=np.uint64) - 2 * np.repeat(starts, np.diff([*starts, b - a])).astype(np.uint64) + np.uint64(1)), starts)
        tri = g[cut[k]:cut[k + 1]]
        out[k, col:] = (len(times) / (b - a), times.max() / (b - a), same[a + 1:b].mean() if b - a > 1 else 0.0,
                        len(np.unique(tri)) / len(tri) if len(tri) else 1.0, np.log1p((b - a) / len(starts)), len(np.unique(lines)) / len(starts))
    return out


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``stats`` (array of ``NAMES``) of every row; null texts count as empty."""
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    schema = T.StructType([T.StructField("_id", src.schema["_id"].dataType), T.StructField("stats", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in slices(batch.column(1)):
                x = statistics(data, off)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), flat], ["_id", "stats"])

    return src.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


@dataclass
class QualityModel:
    """Fitted scorer; all parts have a fixed size."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    edges: np.ndarray  # values of the regression ...
    shares: np.ndarray  # ... and the calibrated score there

    def features(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(11)
        d = len(NAMES)
        turn = rng.standard_normal((d, FOURIER)) / (WIDTH * np.sqrt(d))
        shift = rng.uniform(0, 2 * np.pi, FOURIER)
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / FOURIER) * np.cos(z @ turn + shift), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.edges, self.shares)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, len(NAMES))


def _normal_equations(train: DataFrame, model: QualityModel) -> tuple[np.ndarray, int]:
    """Sum of the outer products of (features, label) over all rows, and the row count."""
    size = FOURIER + 2

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((size, size)), 0
        for batch in batches:
            if batch.num_rows:
                z = np.hstack([model.features(_matrix(batch.column(0))), batch.column(1).to_numpy(zero_copy_only=False)[:, None]])
                total += z.T @ z
                n += len(z)
        if n:
            yield pa.RecordBatch.from_pydict({"slot": [TaskContext.get().partitionId() % SLOTS], "n": [n], "total": [total.tobytes()]})

    def add(table: pa.Table) -> pa.Table:
        total = sum((np.frombuffer(x.as_py()) for x in table.column("total")), np.zeros(size * size))
        return pa.table({"slot": table.column("slot").slice(0, 1), "n": [sum(table.column("n").to_pylist())], "total": [total.tobytes()]})

    schema = "slot long, n long, total binary"
    rows = train.select("stats", "label").mapInArrow(part, schema).groupBy("slot").applyInArrow(add, schema).collect()
    total = sum((np.frombuffer(r["total"]).reshape(size, size) for r in rows), np.zeros((size, size)))
    return total, sum(r["n"] for r in rows)


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted least-squares fit that never falls (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for v, w in zip(value, weight, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks[-1]
            a[0] = (a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1])
            a[1] += b[1]
            a[2] += b[2]
    return np.concatenate([np.full(int(k), v) for v, _, k in blocks]) if blocks else np.empty(0)


def fit(train: DataFrame) -> QualityModel:
    """Fit on rows (stats, label 0/1).  Without rows, or with one label only,
    every score is the (smoothed) share of good rows."""
    d = len(NAMES)
    row = train.select(F.count(F.lit(1)).alias("n"), F.avg("label").alias("y"),
                       *[f(F.get("stats", F.lit(k))).alias(f"{name}{k}") for k in range(d) for name, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    flat = (row["y"] * row["n"] + 0.5) / (row["n"] + 1) if row["n"] else 0.5
    mean = np.array([row[f"m{k}"] or 0.0 for k in range(d)])
    scale = np.array([row[f"s{k}"] or 0.0 for k in range(d)])
    model = QualityModel(mean, np.where(scale > 1e-9, scale, 1.0), np.zeros(FOURIER + 1), np.array([0.0, 1.0]), np.array([flat, flat]))
    if not row["n"] or row["y"] in (0.0, 1.0):
        return model
    total, n = _normal_equations(train, model)
    left = total[:-1, :-1] + RIDGE * n * np.diag([*np.ones(FOURIER), 0.0])
    model.weights = np.linalg.solve(left, total[:-1, -1])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bin_ = np.clip((model.raw(_matrix(batch.column(0))) + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(bin_), batch.column(1)], ["bin", "label"])

    table = (train.select("stats", "label").mapInArrow(binned, "bin long, label double")
             .groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("y")).orderBy("bin").collect())
    n = np.array([r["n"] for r in table], float)
    good = np.array([r["y"] for r in table])
    model.edges = (np.array([r["bin"] for r in table]) + 0.5) * 2 / BINS - 0.5
    model.shares = np.clip(isotonic(good / n, n), 0.0, 1.0)
    return model


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality", keep: Sequence[str] = ()) -> DataFrame:
    """``id_col``, the columns of ``keep``, ``held_out``, ``score``, ``predicted`` of every row of ``docs``.

    The statistics are written once to the shared folder and read by the fit
    and the scoring.  Labels that are null, or of ids that are not in ``docs``,
    are not learned from; a repeated label counts as often as it stands there.
    A row without an id gets a score and is not held out.
    """
    row = F.struct(id_col, *keep).alias("_row")
    stats = cut_lineage(document_statistics(docs.select(row, text_col), "_row", text_col).select("_row.*", "stats"), "statistics")
    known = labels.where(F.col(label_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col), F.col(label_col).cast("double").alias("label"))
    model = fit(cut_lineage(stats.join(known, id_col).select("stats", "label"), "training"))
    rows = stats.select(row, "stats")
    schema = T.StructType([rows.schema["_row"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch.column(1))))], ["_row", "score"])

    return (rows.mapInArrow(run, schema).select("_row.*", "score")
            .select(id_col, *keep, F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), "score")
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))
