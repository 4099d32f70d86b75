"""Alignment of two tokenizers over the same bytes.

A text's bytes are cut where a token of A and a token of B both end; the tokens between
two cuts are a group.  Inside a group every end of either side starts a new stretch of
bytes, and each stretch is one A-B pair that overlaps: the links.

Nearly all groups are one token of A against the token of B with the same bytes.  An
array from each A id to that B id is made once per worker, and such a group is counted as one
step in a vector as long as A's vocabulary.  Only the links of the other groups
become (A id, B id) pairs, counted in each task and shuffled as sums.

Corpus counts come back to the documents the same way: the vector, with the commonest pairs
(no more than ``HOT``, by a share of all links), is sent to every task; the remaining pairs of
the documents meet their counts in a join, where no pair holds more than one part in
``HOT`` of the links.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanac.llm.text import slices
from almanac.session import arrow_rows, cut_lineage

HOT = 1 << 16  # a pair with more than 1 / HOT of all links is looked up, not joined
SLICE_BYTES = 1 << 18  # text that is aligned at a time
PENDING = 1 << 19  # pair sums that a task holds before it passes them on
ARROW_ROWS = 512  # documents in an Arrow batch that goes to a worker
SUM_ROWS = 1 << 13  # pair sums in an Arrow batch that comes back
LONG_PIECE = 512  # a piece as long goes through the file's own library, whose time does not grow with its square


def _byte_of_letter() -> dict[str, int]:
    """Byte that each printable character of a byte-level vocabulary stands for: printable
    Latin-1 bytes are themselves, the others follow 255 in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def run_counts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and how often each occurs."""
    v = np.sort(values)
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.empty(0, np.int64)
    return v[first], np.diff(np.append(first, len(v)))


def add_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of several counts."""
    keys, n = np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


# The byte-level tokenizer's pattern, and the first characters of Unicode, whose classes
# are the same in all versions.  Texts with others go through the file's own library.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_OTHER = re.compile("[^\x00-ɏ]")
_WHITE = re.compile(rf"\s{{{LONG_PIECE}}}")


def merge_ranks(spec: dict, tokenize, tokens: list[bytes]):
    """The fast encoder of a byte-level file, or None if it could differ from the file's own merges.

    The fast one joins neighbours whose bytes are a token, lowest id first.  That is the file's order of
    merges if ids grow with the merges, and its choice if every token, by itself, encodes to
    itself: then two neighbours that make up a token can only be the two that its merge joins.
    """
    model, steps = spec["model"], spec["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or spec["normalizer"] is not None or steps.get("type") != "ByteLevel" or not steps.get("use_regex", True) or steps.get("add_prefix_space"):
        return None
    vocab = model["vocab"]
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if any(x >= y for x, y in zip(made, made[1:], strict=False)) or any([t.id for t in tokenize(s)] != [k] for s, k in vocab.items()):
        return None
    import tiktoken
    return tiktoken.Encoding("merges", pat_str=PATTERN, mergeable_ranks={tokens[k]: k for k in vocab.values()}, special_tokens={})


class Side:
    """The tokens of one vocabulary: bytes, lengths, and ids as text."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.names = np.array([str(k) for k in range(len(tokens))], object)


class Pair:
    """Both tokenizers, and for each A id the B id with the same bytes (-1: none)."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self._a = Tokenizer.from_file(path_a)
        self._a.encode_special_tokens = True  # their strings in a text are ordinary text
        self._a.no_truncation()
        self._a.no_padding()
        self._b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = _byte_of_letter()
        size = self._a.get_vocab_size(with_added_tokens=True)
        strings = [self._a.id_to_token(k) or "" for k in range(size)]
        self.a = Side([bytes(map(letters.__getitem__, s)) if all(c in letters for c in s) else s.encode() for s in strings])
        self.b = Side([bytes([int(self._b.id_to_piece(k)[3:5], 16)]) if self._b.is_byte(k) else self._b.id_to_piece(k).replace("▁", " ").encode()
                       for k in range(self._b.get_piece_size())])
        self._fast = merge_ranks(json.loads(self._a.to_str()), self._a.model.tokenize, self.a.tokens)
        first = {}
        for k, t in enumerate(self.b.tokens):
            if t not in first or self._b.is_byte(first[t]):  # a whole piece rather than a byte
                first[t] = k
        self.same = np.array([first.get(t, -1) for t in self.a.tokens], np.int64)

    def _encode_a(self, text: str) -> list[int]:
        if self._fast is None or _OTHER.search(text) or max(map(len, text.split()), default=0) >= LONG_PIECE or _WHITE.search(text):
            return self._a.encode(text, add_special_tokens=False).ids
        return self._fast.encode_ordinary(text)

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and B of each text; none where the bytes of either are not a space and the text."""
        ids_a = [self._encode_a(" " + t) for t in texts]
        ids_b = self._b.encode(texts, num_threads=1)
        a, b = self.a.tokens.__getitem__, self.b.tokens.__getitem__
        for k, t in enumerate(texts):
            want = b" " + t.encode()
            if not t or b"".join(map(a, ids_a[k])) != want or b"".join(map(b, ids_b[k])) != want:
                ids_a[k], ids_b[k] = [], []
        return ids_a, ids_b


@lru_cache(maxsize=2)
def load(path_a: str, path_b: str) -> Pair:
    """One pair of tokenizers per Python worker."""
    return Pair(path_a, path_b)


@dataclass
class Aligned:
    """Some documents, one after the other: ``*_at`` are the documents' bounds in the arrays."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    groups: list[str]  # `a1,a2|b1;a3|b2,b3`
    regular: np.ndarray  # A ids of groups that the array of equal tokens covers
    regular_at: np.ndarray
    links: np.ndarray  # pairs of all other groups: A id * size of B + B id
    links_at: np.ndarray


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(x) for x in ids], np.int64)
    return np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum())), n


def _bounds(n: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(n)])


def align_ids(ids_a: list[list[int]], ids_b: list[list[int]], a: Side, b: Side, same: np.ndarray) -> Aligned:
    """Groups and links of documents whose two token lists have the same bytes.

    The documents are laid end to end: the end of each is an end on both sides, so
    no group crosses it.  Ends are marks on the bytes; a running count of marks turns a byte into
    the token or group that it lies in.
    """
    (ta, n_a), (tb, n_b) = _flat(ids_a), _flat(ids_b)
    end_a, end_b = np.cumsum(a.lengths[ta]), np.cumsum(b.lengths[tb])
    size = int(end_a[-1]) + 1 if len(end_a) else 1
    mark_a, mark_b = np.zeros(size, bool), np.zeros(size, bool)
    mark_a[end_a] = mark_b[end_b] = True
    both = mark_a & mark_b
    before = np.cumsum(both, dtype=np.int32)
    before -= both  # groups that end before a byte
    n_all = int(both.sum())
    group_a, group_b = before[end_a], before[end_b]
    size_a, size_b = np.bincount(group_a, minlength=n_all), np.bincount(group_b, minlength=n_all)
    at_a, at_b = _bounds(n_a), _bounds(n_b)
    doc_end = np.concatenate([[0], end_a])[at_a]  # bytes before and behind each document
    group_at = np.concatenate([before, [n_all]])[doc_end + 1]

    # tokens in the order of the text form: a group's A tokens, then its B tokens
    before_a, before_b = _bounds(size_a), _bounds(size_b)
    text = np.empty(2 * (len(ta) + len(tb)), object)
    place_a, place_b = np.arange(len(ta)) + before_b[group_a], np.arange(len(tb)) + before_a[group_b + 1]
    text[2 * place_a], text[2 * place_b] = a.names[ta], b.names[tb]
    text[2 * place_a + 1] = _SIGNS[both[end_a] * 1]
    text[2 * place_b + 1] = _SIGNS[both[end_b] * 2]
    cut = 2 * (at_a + at_b)
    parts = text.tolist()
    groups = ["".join(parts[x:y - 1]) if y > x else "" for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    first_a, first_b = ta[before_a[:-1]], tb[before_b[:-1]]
    single = (size_a == 1) & (size_b == 1) & (same[first_a] == first_b)
    ends = np.flatnonzero(mark_a | mark_b)
    ends = ends[~single[before[ends]]]
    link_a = (np.cumsum(mark_a, dtype=np.int32) - mark_a)[ends]
    link_b = (np.cumsum(mark_b, dtype=np.int32) - mark_b)[ends]
    return Aligned(n_a, n_b, np.diff(group_at), groups, first_a[single], _bounds(single)[group_at],
                   ta[link_a] * len(b.tokens) + tb[link_b], np.searchsorted(ends, doc_end, "right"))


_SIGNS = np.array([",", "|", ";"], object)


def _counts(values: np.ndarray, at: np.ndarray, limit: int) -> tuple[pa.Array, pa.Array]:
    """Per document, the distinct values (below ``limit``) and how often each occurs."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    keys, n = run_counts(doc * limit + values)
    off = pa.array(np.searchsorted(keys, np.arange(len(at)) * limit).astype(np.int32))
    return pa.ListArray.from_arrays(off, pa.array(keys % limit)), pa.ListArray.from_arrays(off, pa.array(n))


_LISTS = pa.list_(pa.int64())
_FIELDS = {"n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "groups": pa.string(), "regular": _LISTS, "regular_n": _LISTS, "links": _LISTS, "links_n": _LISTS}


def _align(path_a: str, path_b: str):
    """Arrow map from (row, id, text): a row per document, and the task's sums by pair in rows without a ``row``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = load(path_a, path_b)
        size_a, size_b = len(both.a.tokens), len(both.b.tokens)
        vector = np.zeros(size_a, np.int64)
        held, pending = [], 0
        names, kinds = [], []

        def sums(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(n), SUM_ROWS):
                some = n[k:k + SUM_ROWS]
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(some), kind) for kind in kinds), pa.array(keys[k:k + SUM_ROWS]), pa.array(some)], names)

        for batch in batches:
            names = [*batch.schema.names[:2], *_FIELDS, "pair", "pair_n"]
            kinds = [*batch.schema.types[:2], *_FIELDS.values()]
            for x, y, _, _ in slices(batch.column(2), SLICE_BYTES):
                texts = [t or "" for t in batch.column(2).slice(x, y - x).to_pylist()]
                found = align_ids(*both.encode(texts), both.a, both.b, both.same)
                made = [pa.array(found.n_a), pa.array(found.n_b), pa.array(found.n_groups), pa.array(found.groups, pa.string()),
                        *_counts(found.regular, found.regular_at, size_a), *_counts(found.links, found.links_at, size_a * size_b)]
                yield pa.RecordBatch.from_arrays([*(c.slice(x, y - x) for c in batch.columns[:2]), *made, *[pa.nulls(y - x, pa.int64())] * 2], names)
                vector += np.bincount(found.regular, minlength=size_a)
                held.append(run_counts(found.links))
                pending += len(held[-1][0])
                if pending >= PENDING:
                    held = [add_counts(held)]
                    pending = 0
                    if len(held[0][0]) >= PENDING:
                        yield from sums(*held.pop())
        if kinds:
            used = np.flatnonzero(vector)
            yield from sums(used * size_b + both.same[used], vector[used])
            if held:
                yield from sums(*add_counts(held))

    return run


def _lookup(vector: tuple[np.ndarray, np.ndarray], hot: tuple[np.ndarray, np.ndarray, np.ndarray]):
    """Arrow map: what the sent counts say of each document, and the pairs that are left."""
    total, best = vector
    pairs, pair_total, pair_best = (np.concatenate([[none], x]) for none, x in zip((-1, 0, 0), hot, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ids, n, links, m in zip(*(batch.column(j).to_numpy(zero_copy_only=False) for j in (1, 2, 3, 4)), strict=True):
                at = np.minimum(np.searchsorted(pairs, links), len(pairs) - 1)
                here = pairs[at] == links
                rows.append((int(n @ best[ids] + (m * pair_best[at])[here].sum()), int(n @ total[ids] + (m * pair_total[at])[here].sum()), links[~here], m[~here]))
            made = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.int64(), pa.int64(), _LISTS, _LISTS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["row", "n_best", "count_sum", "links", "links_n"])

    return run


@dataclass
class Alignment:
    """What an alignment of a corpus leaves in the shared folder.

    ``documents``: ``row`` (a key of its own), the id column, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups``.
    ``pairs``: ``a``, ``b``, ``n`` (links of the corpus), ``best`` (no A id has more with this B id).
    ``scores``: ``row``, ``n_best``, ``count_sum`` of the documents that have tokens.
    """

    documents: DataFrame
    pairs: DataFrame
    scores: DataFrame


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> Alignment:
    """Align A (a byte-level ``tokenizers`` file) and B (a sentencepiece model) on every row.

    A reads a space and the text, B the text (it puts the space itself).  Texts that are null or
    empty, or whose tokens do not give back their bytes, have no tokens.  Rows are told apart by a
    key of their own, so null and repeated ids, and repeated texts, are rows like any other;
    other columns are ignored.  Whole texts are encoded, a slice of ``SLICE_BYTES`` (or one longer
    text) at a time; batches of ``ARROW_ROWS`` documents and ``SUM_ROWS`` sums pass between Spark and its workers.
    """
    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    lists = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("_id", src.schema["_id"].dataType)])
    for name, kind in _FIELDS.items():
        schema.add(name, lists if kind == _LISTS else T.StringType() if kind == pa.string() else T.LongType())
    with arrow_rows(docs.sparkSession, ARROW_ROWS):
        table = cut_lineage(src.mapInArrow(_align(path_a, path_b), schema.add("pair", "long").add("pair_n", "long")), "alignment")
    rows = table.where(F.col("row").isNotNull())

    counted = cut_lineage(table.where(F.col("pair").isNotNull()).groupBy("pair").agg(F.sum("pair_n").alias("n")), "pair-counts")
    both = load(path_a, path_b)
    same, size_b = both.same, len(both.b.tokens)
    b_of = F.col("pair") % size_b
    top = counted.groupBy(b_of.alias("b")).agg(F.max("n").alias("top"))  # no more rows than B has ids
    pairs = cut_lineage(counted.withColumn("b", b_of).join(F.broadcast(top), "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best")), "pairs")

    equal = docs.sparkSession.createDataFrame(pa.table({"pair": np.flatnonzero(same >= 0) * size_b + same[same >= 0]}))  # no more rows than A has ids
    found = pairs.join(F.broadcast(equal), "pair", "left_semi").toArrow()
    ids = found.column("pair").to_numpy() // size_b
    total, best = np.zeros(len(same), np.int64), np.zeros(len(same), np.int64)
    total[ids], best[ids] = found.column("n").to_numpy(), found.column("best").to_numpy()
    all_links = pairs.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * F.lit(HOT) > F.lit(all_links)
    common = pairs.where(is_hot).orderBy("pair").toArrow()  # fewer rows than HOT
    hot = tuple(common.column(c).to_numpy().astype(np.int64) for c in ("pair", "n", "best"))

    with arrow_rows(docs.sparkSession, ARROW_ROWS):
        looked = cut_lineage(rows.where(F.col("n_a") > 0).select("row", "regular", "regular_n", "links", "links_n")
                             .mapInArrow(_lookup((total, best), hot), "row long, n_best long, count_sum long, links array<long>, links_n array<long>"), "looked-up")
    left = looked.select("row", F.explode(F.arrays_zip("links", "links_n")).alias("x")).select("row", F.col("x.links").alias("pair"), F.col("x.links_n").alias("m"))
    rest = (left.join(pairs.where(~is_hot), "pair")
            .select("row", (F.col("m") * F.col("best").cast("long")).alias("n_best"), (F.col("m") * F.col("n")).alias("count_sum")))
    scores = looked.select("row", "n_best", "count_sum").unionByName(rest).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    documents = rows.select("row", F.col("_id").alias(id_col), "n_a", "n_b", "n_groups", (F.col("n_a") + F.col("n_b") - F.col("n_groups")).alias("n_links"), "groups")
    return Alignment(documents, pairs.select(F.floor(F.col("pair") / size_b).alias("a"), b_of.alias("b"), "n", "best"), scores)
