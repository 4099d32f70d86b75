"""Removal of repeated passages by minimiser-partitioned windows of ``window`` words.

The dealt method, suffixes partitioned by prefixes of varying length with maximal
repeats read off a suffix tree, is replaced: what is removed are the words of
repeated windows of one fixed length, and equal windows can be met without any
suffix order.  There are no suffix prefixes, no LCP and no maximal repeats here.

1. Each window is named by its *anchor*, the smallest hash among its
   ``ANCHOR``-word runs; equal windows have equal anchors.  A map-side combined
   aggregate finds the anchors that occur in more than one document; a bitmap
   of fixed size takes them to all tasks, and only windows that pass go on.
2. Anchors are dealt into memory-sized groups by their remainder modulo the
   number of groups, which follows the number of windows.  An anchor with more windows than a
   group may hold gets a longer name, by document, and so several groups.
3. A task sorts one group's windows by their words; a node is a run of equal
   ones.  Occurrences in a document above the node's smallest are repeats.
4. For anchors that were cut by document, only each node's smallest
   occurrence in each part goes on, and a small aggregate merges the nodes.  The
   windows of one anchor in one document stay in one task.

Windows of one anchor that follow each other travel as one run of word codes,
so a word is sent a few times at most, not ``window`` times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanac.llm import bitmap
from almanac.llm.text import grams, mix, slices, word_hashes, word_spans
from almanac.session import cut_lineage

ANCHOR = 5
BITS = 25  # the bitmap has 2 ** BITS bits (4 MiB)
CODE = 6  # bytes of a word's code
GROUP = 200_000  # windows of one subtree
RUN = 64  # windows that travel together at most
HOT = 1 << 16  # anchors that may be named longer; the rest share groups

_U = np.uint64


def _anchors(h: np.ndarray, words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of every window and its anchor."""
    _, at = grams(h, words, window)
    n = len(h) - ANCHOR + 1
    if not len(at):
        return at, np.empty(0, np.uint64)
    g = np.zeros(n, np.uint64)
    for k in range(ANCHOR):
        g *= _U(0xA24BAED4963EE407)
        g += h[k:k + n]
    g = mix(g)
    spread = window - ANCHOR + 1
    least = g[:n - spread + 1].copy()
    for k in range(1, spread):
        np.minimum(least, g[k:k + len(least)], out=least)
    return at, least[at]


def _runs(at: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of consecutive windows with one anchor, at most ``RUN`` long."""
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    fresh = np.ones(len(at), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(fresh)
    place = np.arange(len(at)) - np.repeat(first, np.diff([*first, len(at)]))
    first = np.flatnonzero(place % RUN == 0)
    return first, np.append(first[1:], len(at)) - 1


def _emit_anchors(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, off in slices(batch.column(1)):
            h, words = word_hashes(data, off, lower=False)
            at, anchor = _anchors(h, words, window)
            first, last = _runs(at, anchor)
            row = np.searchsorted(words, at[first], "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(anchor[first].view(np.int64)), batch.column(0).slice(a, b - a).take(pa.array(row)), pa.array(last - first + 1)], ["anchor", "doc", "n"])


def _emit_runs(batches: Iterator[pa.RecordBatch], window: int, shared, groups: int, hot) -> Iterator[pa.RecordBatch]:
    """(grp, part, split, doc, start, words) of the runs whose anchor passes the bitmap."""
    bits, (names, parts) = shared.value, hot.value
    for batch in batches:
        for a, b, data, off in slices(batch.column(1)):
            h, words = word_hashes(data, off, lower=False)
            at, anchor = _anchors(h, words, window)
            keep = bitmap.passes(bits, anchor, BITS)
            at, anchor = at[keep], anchor[keep]
            first, last = _runs(at, anchor)
            row = np.searchsorted(words, at[first], "right") - 1
            doc = batch.column(0).slice(a, b - a).take(pa.array(row))
            name = anchor[first]
            if len(names):
                place = np.minimum(np.searchsorted(names, name), len(names) - 1)
                many = np.where(names[place] == name, parts[place], 1)
            else:
                many = np.ones(len(name), np.int64)
            part = (mix(doc.to_numpy(zero_copy_only=False).view(np.uint64)) % many.astype(np.uint64)).astype(np.int64)
            code = np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, 8 - CODE:]).tobytes()
            cut = [code[CODE * p:CODE * (q + window)] for p, q in zip(at[first].tolist(), at[last].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array((name % _U(groups)).astype(np.int64)), pa.array(part), pa.array(many > 1), doc,
                                              pa.array(at[first] - words[row]), pa.array(cut, pa.binary())], ["grp", "part", "split", "doc", "start", "words"])


def _subtree(window: int):
    """Deep nodes of one group: repeats as (doc, start, end), and for split
    anchors each node's smallest occurrence in this part, with the node's words."""

    def run(table: pa.Table) -> pa.Table:
        raw = table.column("words").to_pylist()
        size = np.array([len(r) // CODE for r in raw])
        code = np.zeros((int(size.sum()), 8), np.uint8)
        flat = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, CODE)
        code[:, :CODE] = flat
        code = code.view(np.uint64).ravel()
        begin = np.concatenate([[0], np.cumsum(size)])
        n = size - window + 1
        run_of = np.repeat(np.arange(len(raw)), n)
        inner = np.arange(len(run_of)) - np.repeat(np.cumsum(n) - n, n)
        at = begin[run_of] + inner
        doc = table.column("doc").to_numpy()[run_of]
        start = table.column("start").to_numpy()[run_of] + inner
        split = table.column("split").to_numpy(zero_copy_only=False)[run_of]

        order = np.lexsort([code[at + k] for k in range(window - 1, -1, -1)])
        apart = np.zeros(len(order), bool)  # whether a window leaves its left neighbour above the full depth
        apart[:1] = True
        for k in range(window):
            column = code[at[order] + k]
            apart[1:] |= column[1:] != column[:-1]
        node = np.cumsum(apart) - 1
        least = np.minimum.reduceat(doc[order], np.flatnonzero(apart)) if len(order) else doc
        smallest = np.empty(len(order), doc.dtype)
        smallest[order] = least[node] if len(order) else least

        gone = doc > smallest
        key = np.lexsort((start[gone], doc[gone]))
        d, s = doc[gone][key], start[gone][key]
        fresh = np.ones(len(d), bool)
        fresh[1:] = (d[1:] != d[:-1]) | (s[1:] > s[:-1] + window)
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(d)) - 1 if len(d) else first
        open_ = np.flatnonzero(split & ~gone)
        names = [b"".join(flat[at[k]:at[k] + window]) for k in open_.tolist()]
        return pa.table({
            "doc": pa.array(np.concatenate([d[first], doc[open_]]), pa.int64()),
            "a": pa.array(np.concatenate([s[first], start[open_]]), pa.int64()),
            "b": pa.array(np.concatenate([s[last] + window if len(d) else s, start[open_] + window]), pa.int64()),
            "node": pa.array([None] * len(first) + names, pa.binary()),
        })

    return run


def repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, a, b): word ranges, possibly overlapping, that windows cover whose
    words also start in a document with a smaller id."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("binary").alias("text")).where("doc IS NOT NULL")
    anchors = src.mapInArrow(lambda batches: _emit_anchors(batches, window), "anchor long, doc long, n long")
    shared = cut_lineage(anchors.groupBy("anchor").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.sum("n").alias("n"))
                         .where("lo < hi").select("anchor", "n"), "anchors")
    total = shared.agg(F.sum("n")).first()[0] or 0
    hot = shared.where(F.col("n") > GROUP).orderBy(F.desc("n")).limit(HOT).toArrow()
    names = hot.column("anchor").to_numpy().view(np.uint64)
    parts = -(-hot.column("n").to_numpy() // GROUP)
    order = np.argsort(names)
    sent = spark.sparkContext.broadcast(bitmap.build(shared, "anchor", BITS))
    sent_hot = spark.sparkContext.broadcast((names[order], parts[order]))
    groups = max(1, -(-total // GROUP))

    schema = "grp long, part long, split boolean, doc long, start long, words binary"
    runs = src.mapInArrow(lambda batches: _emit_runs(batches, window, sent, groups, sent_hot), schema)
    found = cut_lineage(runs.groupBy("grp", "part").applyInArrow(_subtree(window), "doc long, a long, b long, node binary"), "nodes")
    open_ = found.where("node IS NOT NULL")
    least = open_.groupBy("node").agg(F.min("doc").alias("least"))
    merged = open_.join(least, "node").where(F.col("doc") > F.col("least"))
    return found.where("node IS NULL").select("doc", "a", "b").union(merged.select("doc", "a", "b"))


def without_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_words``, ``n_removed``, ``kept`` (the words that stay, joined by one space) of every row.

    A null text has no words.  Rows without an id lose nothing and are not
    looked into for repeats; rows that repeat an id are taken to repeat the
    text.  Of equal windows in one document none goes on account of the other.
    Other columns are ignored.
    """
    gone = repeats(docs, window, id_col, text_col).groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("gone"))
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    joined = src.join(cut_lineage(gone, "repeats"), F.col("id").cast("long") == F.col("doc"), "left").select("id", "text", "gone")
    schema = T.StructType([src.schema["id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = batch.column(2)
            for a, b, data, off in slices(batch.column(1)):
                s, e, words = word_spans(data, off)
                stay = np.ones(len(s), bool)
                for k in range(a, b):
                    for r in gone[k].as_py() or ():
                        stay[words[k - a] + r["a"]:words[k - a] + r["b"]] = False
                total = np.concatenate([[0], np.cumsum(stay)])
                raw = data.tobytes()
                kept = []
                for k in range(b - a):
                    w0, w1 = words[k], words[k + 1]
                    if total[w1] - total[w0] == w1 - w0:
                        kept.append(b" ".join(raw[off[k]:off[k + 1]].split()))
                    else:
                        live = np.flatnonzero(stay[w0:w1]) + w0
                        kept.append(b" ".join([raw[x:y] for x, y in zip(s[live].tolist(), e[live].tolist(), strict=True)]))
                n, left = np.diff(words), total[words[1:]] - total[words[:-1]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), pa.array(n - left), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(run, schema).withColumnRenamed("id", id_col)
