"""Benchmark decontamination by n-gram seeds and local alignment.

Every run of ``SEED`` words of a test item is a seed, however frequent: an exact
copy raises the counts of the very runs that an edited copy keeps.  A bitmap of a
fixed size, with one bit per hash bucket of the seeds, goes to all tasks; what
passes it in the documents is joined with the seeds exactly.

A seed hit fixes a diagonal between item and document.  Around it a
Smith-Waterman alignment of words (match 2, mismatch and gap -1) is scored
against the item's best possible score, so edited and paraphrased copies count
as long as their order survives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanac.llm import bitmap
from almanac.llm.text import grams, plain_words, slices
from almanac.session import cut_lineage

SEED = 3  # words; items with fewer words cannot be told from chance and take no part
BITS = 24  # the bitmap has 2 ** BITS bits (2 MiB), however large the benchmark
REGION = 64  # diagonals that share one alignment window
MATCH, MISS, GAP = 2, -1, -1
THRESHOLD = 0.5
CELLS = 1 << 20  # cells of one row of a batched alignment


def _item_words(items: DataFrame) -> DataFrame:
    """(item, words): word hashes as binary; items without an id or with too few words are left out."""
    schema = T.StructType([T.StructField("item", items.schema["item"].dataType), T.StructField("words", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in slices(batch.column(1)):
                h, words = plain_words(data, off)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([h[words[k]:words[k + 1]].tobytes() for k in range(b - a)], pa.binary())], ["item", "words"])

    return items.mapInArrow(run, schema).where(F.col("item").isNotNull() & (F.octet_length("words") >= 8 * SEED))


def _item_grams(words: DataFrame) -> DataFrame:
    """(item, at, gram) of every run of ``SEED`` words of the items."""
    schema = T.StructType([words.schema["item"], T.StructField("at", T.LongType()), T.StructField("gram", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                h = np.frombuffer(batch.column(1)[k].as_py(), np.uint64)
                g, at = grams(h, np.array([0, len(h)]), SEED)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([k] * len(g), pa.int64())), pa.array(at), pa.array(g.view(np.int64))], ["item", "at", "gram"])

    return words.mapInArrow(run, schema)


def _hits(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """(id, pos, gram) of every run of the documents that passes the bitmap."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)
    schema = T.StructType([docs.schema["id"], T.StructField("pos", T.LongType()), T.StructField("gram", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in slices(batch.column(1)):
                h, words = plain_words(data, off)
                g, at = grams(h, words, SEED)
                found = np.flatnonzero(bitmap.passes(sent.value, g, BITS))
                row = np.searchsorted(words, at[found], "right") - 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(row)), pa.array(at[found] - words[row]), pa.array(g[found].view(np.int64))], ["id", "pos", "gram"])

    return docs.mapInArrow(run, schema)


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> np.ndarray:
    """Smith-Waterman score of each (item, window) pair of word-hash arrays as a
    share of the item's best possible score."""
    out = np.zeros(len(items))
    order = np.argsort([len(w) for w in windows], kind="stable")
    first = 0
    while first < len(order):
        # pairs of similar size share a batch of at most CELLS cells a row
        take = order[first:first + max(1, CELLS // max(1, len(windows[order[min(len(order), first + 512) - 1]])))][:512]
        first += len(take)
        rows, cols = max(len(items[k]) for k in take), max(len(windows[k]) for k in take)
        item = np.zeros((len(take), rows), np.uint64)
        win = np.ones((len(take), cols), np.uint64)
        blank_i, blank_w = np.ones((len(take), rows), bool), np.ones((len(take), cols), bool)
        for x, k in enumerate(take):
            item[x, :len(items[k])], blank_i[x, :len(items[k])] = items[k], False
            win[x, :len(windows[k])], blank_w[x, :len(windows[k])] = windows[k], False
        best = np.zeros(len(take), np.int32)
        above = np.zeros((len(take), cols + 1), np.int32)
        ramp = -GAP * np.arange(cols + 1, dtype=np.int32)
        for r in range(rows):
            same = (win == item[:, r, None]) & ~blank_w & ~blank_i[:, r, None]
            here = np.zeros_like(above)
            here[:, 1:] = np.maximum(above[:, :-1] + np.where(same, MATCH, MISS), above[:, 1:] + GAP)
            np.maximum(here, 0, out=here)
            here = np.maximum.accumulate(here + ramp, axis=1) - ramp  # gaps along the window
            best = np.maximum(best, here.max(axis=1))
            above = here
        out[take] = best / (MATCH * np.array([max(1, len(items[k])) for k in take]))
    return out


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(``id_col``, ``item_col``, ``score``, ``first_word``): the pairs of
    document and item whose alignment score reaches the threshold, one row each
    with the best score and the first word of the window that has it.

    Null texts have no words; rows without an id, and items with fewer than
    ``SEED`` words, match nothing; rows that repeat an id count as one document.
    Other columns are ignored.
    """
    src = docs.select(F.col(id_col).alias("id"), F.lower(text_col).cast("binary").alias("text")).where("id IS NOT NULL")
    words = cut_lineage(_item_words(items.select(F.col(item_col).alias("item"), F.lower(item_text_col).cast("binary").alias("text"))), "items")
    item_grams = cut_lineage(_item_grams(words), "item_grams")
    hits = cut_lineage(_hits(src, bitmap.build(item_grams, "gram", BITS)), "hits")

    spots = (hits.join(item_grams, "gram").select("id", "item", F.floor((F.col("pos") - F.col("at")) / REGION).alias("region")).distinct())
    # of one document: as many as it has seed hits
    spots = (spots.join(words.withColumnRenamed("words", "want").dropDuplicates(["item", "want"]), "item")
             .groupBy("id").agg(F.collect_list(F.struct("item", "region", "want")).alias("spots")))
    joined = src.join(cut_lineage(spots, "spots"), "id")

    schema = T.StructType([src.schema["id"], words.schema["item"], T.StructField("score", T.DoubleType()), T.StructField("first_word", T.LongType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, spots = batch.column("id").to_pylist(), batch.column("spots")
            for a, b, data, off in slices(batch.column("text")):
                h, first = plain_words(data, off)
                rows, want, have = [], [], []
                for k in range(a, b):
                    mine = h[first[k - a]:first[k - a + 1]]
                    for s in spots[k].as_py():
                        item = np.frombuffer(s["want"], np.uint64)
                        start = max(0, s["region"] * REGION - len(item) // 2)
                        window = mine[start:(s["region"] + 1) * REGION + len(item) + len(item) // 2]
                        if np.isin(item, window).sum() < threshold * len(item):
                            continue  # every other word costs its match: the score cannot reach the threshold
                        rows.append((ids[k], s["item"], start))
                        want.append(item)
                        have.append(window)
                scores = align(want, have)
                keep = [k for k in range(len(rows)) if scores[k] >= threshold]
                yield pa.RecordBatch.from_arrays([
                    pa.array([rows[k][0] for k in keep], batch.schema.field("id").type), pa.array([rows[k][1] for k in keep], batch.column("spots").type.value_type.field("item").type),
                    pa.array(scores[keep]), pa.array([rows[k][2] for k in keep], pa.int64())], ["id", "item", "score", "first_word"])

    return (joined.mapInArrow(score, schema).groupBy("id", "item")
            .agg(F.max("score").alias("score"), F.min_by("first_word", F.struct(-F.col("score"), F.col("first_word"))).alias("first_word"))
            .select(F.col("id").alias(id_col), F.col("item").alias(item_col), "score", "first_word"))
