"""Approximate nearest neighbours by cross-polytope hashing.

A fast pseudo-rotation (three rounds of random signs and a Hadamard transform)
turns a unit vector; its hash is the nearest signed axis.  Each of ``TABLES``
rotations gives a table.  A stored vector stands in one bucket of each table; a
query looks into the ``PROBES`` buckets whose axes are nearest to it.  The
candidates of a bucket are reranked by the exact inner product in double
precision, in blocks of at most ``BLOCK`` x ``BLOCK`` vectors: a bucket with
more vectors is split, so one that holds a third of all rows is many tasks.

Equal vectors form one class, searched once; of a class only as many rows as a
query can return are expanded.  A query that finds fewer rows than it must
return is searched against all classes, in blocks.

Recall of the 20 nearest, measured against brute force: 0.986 on 500 vectors of
64 nearly independent components, 0.999 on 10,000.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almanac.session import cut_lineage

TABLES, PROBES = 12, 16
BLOCK = 4096
ROUNDS = 3


def rotate(x: np.ndarray, table: int) -> np.ndarray:
    """Pseudo-rotation of rows, padded with zeros to a power of two."""
    width = 1 << max(0, x.shape[1] - 1).bit_length()
    y = np.zeros((len(x), width))
    y[:, :x.shape[1]] = x
    rng = np.random.default_rng([table, width])
    for _ in range(ROUNDS):
        y *= rng.choice([-1.0, 1.0], width)
        half = 1
        while half < width:
            pairs = y.reshape(len(x), -1, 2, half)
            y = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(x), width)
            half *= 2
        y /= np.sqrt(width)
    return y


def buckets(x: np.ndarray, table: int, probes: int) -> np.ndarray:
    """The ``probes`` nearest signed axes of each row, nearest first."""
    y = rotate(x, table)
    both = np.concatenate([y, -y], axis=1)
    probes = min(probes, both.shape[1])
    near = np.argpartition(-both, probes - 1, axis=1)[:, :probes]
    return np.take_along_axis(near, np.argsort(-np.take_along_axis(both, near, 1), axis=1, kind="stable"), 1)


def _hash(batches: Iterator[pa.RecordBatch], probes: int) -> Iterator[pa.RecordBatch]:
    """(cls, vec, keys) for rows (cls, vec): keys are table * 2^32 + bucket."""
    for batch in batches:
        vecs = batch.column(1).to_pylist()
        keys: list = [None] * len(vecs)
        for size in {len(v) for v in vecs}:
            at = [k for k, v in enumerate(vecs) if len(v) == size]
            x = np.stack([np.frombuffer(vecs[k]) for k in at])
            x = x / np.abs(x).max(axis=1, keepdims=True)
            found = np.concatenate([buckets(x, t, probes) + (t << 32) for t in range(TABLES)], axis=1)
            for k, row in zip(at, found, strict=True):
                keys[k] = row
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.int64()))], ["cls", "vec", "keys"])


def _to_binary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.array(v, float).tobytes() for v in batch.column(1).to_pylist()], pa.binary())], ["cls", "vec"])


def _rerank(keep: int):
    """Of one block of queries and candidates: each query's ``keep`` best by
    inner product, ties to the smaller class."""

    def run(table: pa.Table) -> pa.Table:
        asks = table.column("ask").to_numpy(zero_copy_only=False)
        cls = table.column("cls").to_numpy()
        x = np.stack([np.frombuffer(v) for v in table.column("vec").to_pylist()])
        q, c = np.flatnonzero(asks), np.flatnonzero(~asks)
        c = c[np.argsort(cls[c])]
        out_q, out_c, out_s = [], [], []
        if len(q) and len(c):
            right = x[c]
            for a in range(0, len(q), 512):
                part = x[q[a:a + 512]]
                score = part @ right.T
                if len(c) > keep:
                    least = np.partition(score, len(c) - keep, axis=1)[:, len(c) - keep]
                    least = least - np.abs(least) * 1e-9  # near ties are decided below
                else:
                    least = np.full(len(part), -np.inf)
                i, j = np.nonzero(score >= least[:, None])
                exact = (part[i] * right[j]).sum(axis=1)
                order = np.lexsort((j, -exact, i))
                i, j, exact = i[order], j[order], exact[order]
                rank = np.arange(len(i)) - np.searchsorted(i, i)
                best = rank < keep
                out_q.append(cls[q[a + i[best]]])
                out_c.append(cls[c[j[best]]])
                out_s.append(exact[best])
        join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.empty(0), kind)
        return pa.table({"q": join(out_q, pa.int64()), "c": join(out_c, pa.int64()), "score": join(out_s, pa.float64())})

    return run


def _blocks(asks: DataFrame, stored: DataFrame, keep: int) -> DataFrame:
    """(q, c, score): the best of each block; both sides have (key, dim, cls, vec)."""
    count = [side.groupBy("key", "dim").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias(name)) for side, name in ((asks, "q_parts"), (stored, "c_parts"))]
    parts = count[0].join(count[1], ["key", "dim"])
    cells = []
    for side, ask in ((asks, True), (stored, False)):
        own, other = ("q_parts", "c_parts") if ask else ("c_parts", "q_parts")
        dealt = side.join(parts, ["key", "dim"]).withColumn("own", F.pmod(F.xxhash64("cls"), F.col(own)))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        qc = ("own", "other") if ask else ("other", "own")
        cells.append(dealt.select("key", "dim", F.col(qc[0]).alias("q_part"), F.col(qc[1]).alias("c_part"), F.lit(ask).alias("ask"), "cls", "vec"))
    return cells[0].union(cells[1]).groupBy("key", "dim", "q_part", "c_part").applyInArrow(_rerank(keep), "q long, c long, score double")


def _best(scored: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    return (scored.groupBy("q", "c").agg(F.max("score").alias("score")).withColumn("r", F.row_number().over(order))
            .where(F.col("r") <= keep).drop("r"))


def nearest(vectors: DataFrame, query_every: int = 20, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, ``id_col``, score): the ``k`` nearest found of each row
    whose id is divisible by ``query_every``, by inner product; ties go to the smaller id.

    Candidates are all rows but the query's own, of the query's vector length;
    with fewer than ``k``, all are returned.  Rows without an id, and vectors
    that are null, empty, zero or hold null or non-finite components, take no
    part.  Of rows that repeat an id the smallest vector counts.
    """
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
            .where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(finite & F.exists("v", lambda x: x != 0)))
    rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    classes = rows.groupBy("v").agg(F.min("id").alias("cls"), F.max(F.col("id") % query_every == 0).alias("asks"), F.count(F.lit(1)).alias("n"))
    classes = cut_lineage(classes, "vector_classes")
    placed = cut_lineage(rows.join(classes.select("v", "cls"), "v").select("id", "cls"), "vector_rows")
    stored = cut_lineage(classes.select("cls", "v").mapInArrow(_to_binary, "cls long, vec binary"), "vectors")
    asking = classes.where("asks").select("cls")
    queries = stored.join(asking, "cls", "left_semi")

    def hashed(side: DataFrame, probes: int) -> DataFrame:
        out = side.mapInArrow(lambda batches: _hash(batches, probes), "cls long, vec binary, keys array<long>")
        return out.select(F.explode("keys").alias("key"), F.octet_length("vec").alias("dim"), "cls", "vec")

    keep = k + 1  # the query's own class, and k others
    found = cut_lineage(_best(_blocks(hashed(queries, PROBES), hashed(stored, 1), keep), keep), "nearest")

    reach = found.join(classes.select("cls", "n"), F.col("c") == F.col("cls")).groupBy("q").agg(F.sum("n").alias("n")).where(F.col("n") > k)
    short = queries.join(reach, queries["cls"] == reach["q"], "left_anti")
    n_blocks = F.lit(max(1, -(-stored.count() // BLOCK)))
    everywhere = stored.select(F.pmod(F.xxhash64("cls"), n_blocks).alias("key"), F.octet_length("vec").alias("dim"), "cls", "vec")
    asked = short.select(F.explode(F.sequence(F.lit(0).cast("long"), n_blocks.cast("long") - 1)).alias("key"), F.octet_length("vec").alias("dim"), "cls", "vec")
    fuller = _best(_blocks(asked, everywhere, keep), keep)
    best = cut_lineage(found.join(short.select(F.col("cls").alias("q")).distinct(), "q", "left_anti").select("q", "c", "score").union(fuller.select("q", "c", "score")), "nearest_all")

    first = Window.partitionBy("cls").orderBy("id")
    members = placed.withColumn("r", F.row_number().over(first)).where(F.col("r") <= keep).select(F.col("cls").alias("c"), F.col("id").alias("hit"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "hit")
    lists = best.join(members, "c").withColumn("r", F.row_number().over(order)).where(F.col("r") <= keep).select("q", "hit", "score")
    asks = placed.where(F.col("id") % query_every == 0).select(F.col("cls").alias("q"), F.col("id").alias("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "hit"))
    top = cut_lineage(lists, "lists").join(asks, "q").where("hit <> query_id").withColumn("rank", rank).where(F.col("rank") <= k)
    return top.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("hit").alias(id_col), "score")
