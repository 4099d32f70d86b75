"""Near-duplicate documents: MinHash bands propose, odd sketches screen, full sets confirm.

Every document becomes a set of word shingles.  ``SAMPLES`` MinHash values are
cut into bands; documents that agree on a band are candidates.  The same
samples are folded into an *odd sketch*, a bitmap in which each (sample, value)
flips one bit: the bits in which two sketches differ count the samples in which
the documents differ, and for high similarities the estimate is precise.  A
candidate pair whose difference is beyond what the threshold allows (five
standard deviations) is dropped; all others are decided exactly on the full sets.

No group is ever expanded into all its pairs:

1. documents with equal sets are one class;
2. in each band bucket every class is compared with the bucket's *head*, the
   class that meets most others over all its buckets (of a group of edited
   copies, the original), and the confirmed links are joined into components;
3. only classes that are still in another component than a bucket's head are
   compared with all classes that the head met, in blocks: a task holds a part of
   them and a part of the group, counts common shingles through an inverted index and
   emits links between different components only, never the pairs.

After step 3 any two classes of a bucket are in one component or were compared,
so no link that a band proposed is lost.  With five samples in a band and forty
bands a pair of similarity 0.8 is proposed with probability 1 - 1.2e-7.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanac.llm.graph import components, joined
from almanac.llm.text import grams, mix, slices, word_hashes
from almanac.operators import lookup
from almanac.session import cut_lineage

BANDS, ROWS = 40, 5
SAMPLES = BANDS * ROWS
SKETCH_LONGS = 8
SKETCH_BITS = 64 * SKETCH_LONGS
GROUP_SHINGLES = 400_000  # shingles that one confirming task holds at a time
BLOCK_SHINGLES = 100_000  # shingles of one side of a block

_U = np.uint64
_FACTORS = np.random.default_rng(7).integers(1, 2**63, SAMPLES, dtype=np.uint64) * _U(2) + _U(1)


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct n-word shingles of each text; a text of fewer words is one shingle."""
    h, words = word_hashes(data, off, lower=True)
    g, at = grams(h, words, n)
    cut = np.searchsorted(at, words)
    out = []
    for k in range(len(words) - 1):
        size = words[k + 1] - words[k]
        if 0 < size < n:
            whole, _ = grams(h[words[k]:words[k + 1]], np.array([0, size]), int(size))
            out.append(mix(whole + _U(size)))
        else:
            out.append(np.unique(g[cut[k]:cut[k + 1]]))
    return out


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and odd sketches (as 64-bit integers) of non-empty sets."""
    every = np.concatenate(sets)
    start = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    least = np.empty((SAMPLES, len(sets)), np.uint64)
    for k in range(SAMPLES):
        x = every * _FACTORS[k]
        x ^= x >> _U(32)
        least[k] = np.minimum.reduceat(x, start)
    keys = np.empty((len(sets), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(sets), b + 1, np.uint64)
        for r in range(ROWS):
            key = mix(key * _U(0xA24BAED4963EE407) + least[b * ROWS + r])
        keys[:, b] = key
    bit = mix(least + np.arange(SAMPLES, dtype=np.uint64)[:, None] * _U(0x9FB21C651E98DF25)) % _U(SKETCH_BITS)
    cell = (np.arange(len(sets)) * SKETCH_BITS + bit.astype(np.int64)).ravel()
    odd = (np.bincount(cell, minlength=len(sets) * SKETCH_BITS) & 1).astype(np.uint8)
    return keys.view(np.int64), np.packbits(odd.reshape(len(sets), -1), axis=1).view(np.int64)


def _fingerprint(s: np.ndarray) -> bytes:
    return np.array([len(s), s.sum(), np.bitwise_xor.reduce(mix(s))], np.uint64).tobytes()


def _sign(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, off in slices(batch.column(1)):
            sets = shingle_sets(data, off, n)
            full = [s for s in sets if len(s)]
            keys, sketch = signatures(full) if full else (np.empty((0, BANDS), np.int64), np.empty((0, SKETCH_LONGS), np.int64))
            some = np.array([len(s) > 0 for s in sets])
            row = np.cumsum(some) - 1
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(a, b - a),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([_fingerprint(s) if len(s) else None for s in sets], pa.binary()),
                pa.array([keys[row[k]] if some[k] else None for k in range(len(sets))], pa.list_(pa.int64())),
                pa.array([sketch[row[k]] if some[k] else None for k in range(len(sets))], pa.list_(pa.int64())),
            ], ["id", "n", "print", "bands", "sketch"])


def sketch_limit(num: int, den: int) -> int:
    """Bits in which the sketches of sets of similarity num/den or more differ,
    at five standard deviations of both the samples and the folding."""
    share, m = num / den, SKETCH_BITS

    def expect(apart: float) -> float:
        return m / 2 * (1 - (1 - 2 / m) ** (2 * apart))

    apart = SAMPLES * (1 - share)
    slope = expect(apart + 1) - expect(apart)
    spread = slope**2 * SAMPLES * share * (1 - share) + 2 * (2 * apart) ** 2 / m
    return math.ceil(expect(apart) + 5 * math.sqrt(spread))


def _differ(a: str, b: str) -> Column:
    return sum((F.bit_count(F.get(F.col(a), F.lit(k)).bitwiseXOR(F.get(F.col(b), F.lit(k)))) for k in range(SKETCH_LONGS)), F.lit(0))


def _near(num: int, den: int) -> Column:
    """What any pair of the threshold fulfils: alike sizes and sketches."""
    return (F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num) & (_differ("sketch_a", "sketch_b") <= sketch_limit(num, den))


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """(id, set) of texts: the name of the class and its shingles, sorted."""
    for batch in batches:
        for _, _, data, off in slices(batch.column(0)):
            full = [s for s in shingle_sets(data, off, n) if len(s)]
            full = [np.sort(s) for s in full]
            yield pa.RecordBatch.from_arrays([pa.array([_fingerprint(s) for s in full], pa.binary()), pa.array([s.tobytes() for s in full], pa.binary())], ["id", "set"])


def _confirm(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b, n_b) whose full sets have 100 * |a & b| >= threshold * |a | b|.

    A task gets one ``a`` and a part of its ``b``: a class with very many
    candidates is split by the number of their shingles.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.sum("n_b") / GROUP_SHINGLES).alias("parts"))
    dealt = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), F.col("b").alias("id"))
    heads = parts.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("a").alias("id"))
    rows = dealt.union(heads).join(sets, "id").select("a", "part", "id", "set")

    def decide(key: tuple, table: pa.Table) -> pa.Table:
        a = key[0].as_py()
        ids, every = table.column("id").to_pylist(), [np.frombuffer(x.as_py(), np.uint64) for x in table.column("set")]
        head = every[ids.index(a)]
        linked = []
        for x, s in zip(ids, every, strict=True):
            both = len(np.intersect1d(head, s, assume_unique=True))
            if x != a and both * den >= num * (len(head) + len(s) - both):
                linked.append(x)
        return pa.table({"a": pa.array([a] * len(linked), pa.binary()), "b": pa.array(linked, pa.binary())})

    return rows.groupBy("a", "part").applyInArrow(decide, "a binary, b binary")


def _blocks(group: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between classes of one group (head, id, comp, apart, sketch, rows, cols)
    of which at least one is apart and whose components differ.

    Only the classes that are apart are compared with all: they, and all of the group, are dealt into ``rows`` and ``cols`` parts
    of about ``BLOCK_SHINGLES`` shingles, and a task gets one part of each.  What travels are sets, once
    for every part of the other side; where few are apart, that is once.  Sketches rule
    out most pairs; the others are counted exactly.
    """
    def side(name: str, own: str, other: str, rows: DataFrame) -> DataFrame:
        at = {own: F.pmod(F.xxhash64("id"), F.col(own)), other: F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))}
        return rows.select("head", at["rows"].alias("i"), at["cols"].alias("j"), F.lit(name).alias("side"), "id", "comp", "apart", "sketch")

    cells = side("row", "rows", "cols", group.where("apart")).unionByName(side("col", "cols", "rows", group)).join(sets, "id")
    limit = sketch_limit(num, den)

    def decide(key: tuple, table: pa.Table) -> pa.Table:
        ids = table.column("id").to_pylist()
        left, right = ([k for k, x in enumerate(table.column("side").to_pylist()) if x == name] for name in ("row", "col"))
        every = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("set")]
        comp = table.column("comp").to_pylist()
        name = {c: k for k, c in enumerate(dict.fromkeys(comp))}
        comp = np.array([name[c] for c in comp], np.int64)
        apart = table.column("apart").to_numpy(zero_copy_only=False)
        sketch = np.array(table.column("sketch").to_pylist(), np.int64).reshape(len(ids), -1).view(np.uint64)
        size = np.array([len(s) for s in every])
        tops = np.arange(len(name))

        def find(c: int) -> int:
            while tops[c] != c:
                tops[c] = tops[tops[c]]
                c = tops[c]
            return c

        left, right = np.array(left, np.int64), np.array(right, np.int64)
        order = np.argsort(tokens := np.concatenate([every[k] for k in right]), kind="stable")
        tokens, owner = tokens[order], np.repeat(np.arange(len(right)), size[right])[order]
        out = []
        for x in left:
            differ = np.bitwise_count(sketch[right] ^ sketch[x]).sum(axis=1)
            maybe = (differ <= limit) & (comp[right] != comp[x]) & (np.minimum(size[right], size[x]) * den >= np.maximum(size[right], size[x]) * num)
            for y in np.flatnonzero(maybe & apart[right]):  # a pair that is apart on both sides is met twice
                maybe[y] = ids[x] < ids[right[y]]
            if not maybe.any():
                continue
            lo, hi = np.searchsorted(tokens, every[x], "left"), np.searchsorted(tokens, every[x], "right")
            reach = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange((hi - lo).sum())
            both = np.bincount(owner[reach], minlength=len(right))
            for y in np.flatnonzero(maybe & (both * den >= num * (size[right] + size[x] - both))):
                cx, cy = find(comp[x]), find(comp[right[y]])
                if cx != cy:
                    tops[max(cx, cy)] = min(cx, cy)
                    out.append((ids[x], ids[right[y]]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([y for _, y in out], pa.binary())})

    return cells.groupBy("head", "i", "j").applyInArrow(decide, "a binary, b binary")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, num: int = 80, den: int = 100,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_shingles``, ``component_id``, ``kept`` for every row.

    Words are runs outside ``\\x20 \\x09-\\x0D`` after lower-casing A-Z.  Rows
    are linked if the similarity of their shingle sets is num / den or more;
    ``component_id`` is the smallest id reachable over links.  A null or empty
    text, or one without words, has an empty set and is linked with nothing.
    Rows without an id get a null component and are kept; rows that repeat an
    id count as one document with all their texts: a link of any of them is a link of the document.
    Other columns are ignored.

    Classes of equal sets are named by a fingerprint of the set, so an id that heads two of them
    mixes nothing up.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = src.schema["id"].dataType
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("id", kind), T.StructField("n", T.LongType()), T.StructField("print", T.BinaryType()),
                           T.StructField("bands", longs), T.StructField("sketch", longs)])
    signed = cut_lineage(src.mapInArrow(lambda batches: _sign(batches, shingle_words), schema), "signatures")

    # rows of equal sets have equal sizes, bands and sketches: any of them stands for the class
    named = signed.where("n > 0 AND id IS NOT NULL")
    classes = cut_lineage(named.groupBy("print").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("n", "bands", "sketch")]), "classes")
    sketches = classes.select(F.col("print").alias("id"), "n", "sketch")

    bands = classes.select(F.explode("bands").alias("key"), F.col("print").alias("id"))
    shared = bands.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo < hi").select("key", "size")
    met = cut_lineage(bands.join(shared, "key"), "met")
    degree = cut_lineage(met.groupBy("id").agg(F.sum("size").alias("degree")).join(classes.select(F.col("print").alias("id"), "first"), "id"), "degrees")
    members = cut_lineage(met.select("key", "id").join(degree.select("id", "degree"), "id"), "members")
    heads = members.groupBy("key").agg(F.max_by("id", F.struct("degree", "id")).alias("head"))
    # a class meets a head in up to all bands: one row of the two
    headed = cut_lineage(members.select("key", "id").join(heads, "key").select("head", "id").distinct(), "headed")
    held = src.join(degree.select(F.col("first").alias("id")), "id", "left_semi").select("text")
    sets = cut_lineage(held.mapInArrow(lambda batches: _sets(batches, shingle_words), "id binary, set binary")
                       .join(degree.select("id"), "id", "left_semi").groupBy("id").agg(F.first("set").alias("set")), "sets")
    sides = [sketches.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab"]

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Links among the pairs (a, b); alike pairs only reach the full sets."""
        alike = pairs.join(sides[0], "a").join(sides[1], "b").where(_near(num, den)).select("a", "b", "n_b")
        return _confirm(cut_lineage(alike, "alike"), sets, num, den)

    def placed(labels: DataFrame) -> DataFrame:
        """Classes with their head, their component, and whether it is another than their head's."""
        known = lookup.light(labels)
        of_head = known.select(F.col("node").alias("head"), F.col("comp").alias("head_comp"))
        return (headed.join(known.withColumnRenamed("node", "id"), "id", "left").join(of_head, "head", "left")
                .select("head", "id", F.coalesce("comp", "id").alias("comp"), (F.coalesce("comp", "id") != F.coalesce("head_comp", "head")).alias("apart")))

    stars = headed.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"))
    # classes of one document are linked by it
    several = named.groupBy("id").agg(F.min("print").alias("a"), F.max("print").alias("_top")).where("a < _top").select("id", "a")
    one_document = named.join(several, "id").select("a", F.col("print").alias("b")).where("a <> b")
    labels = components(confirmed(stars).union(one_document))

    group = cut_lineage(placed(labels).join(sketches, "id"), "groups")
    apart_n = F.sum(F.when(F.col("apart"), F.col("n")))
    open_heads = cut_lineage(group.groupBy("head").agg(
        F.ceil(apart_n / BLOCK_SHINGLES).alias("rows"), F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("cols"), F.count(F.lit(1)).alias("members")).where("rows > 0"), "open-heads")
    if not open_heads.isEmpty():
        group = lookup.attach(group, open_heads, ["head"], "members", how="inner")
        labels = joined(labels, _blocks(cut_lineage(group, "open-groups"), sets, num, den))

    # a class without a link is its own component
    grouped = cut_lineage(classes.select(F.col("print").alias("node"), "first", "copies").join(lookup.light(labels), "node", "left"), "placed")
    least = grouped.where("comp IS NOT NULL").groupBy("comp").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("members"))
    placed_class = (lookup.attach(grouped, cut_lineage(least, "components"), ["comp"], "members")
                    .select(F.col("node").alias("print"), F.coalesce("component_id", "first").alias("component_id"), "copies"))
    # empty rows and rows without an id wait for no class
    out = lookup.attach(signed.select("id", "n", "print"), cut_lineage(placed_class, "placed_classes"), ["print"], "copies")
    return (out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                       F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))))
