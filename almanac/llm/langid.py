"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent n-grams, in order.  A
document's own list is compared with each profile: every n-gram adds how far
its place is out of place, or the largest such distance if the profile lacks it, and
the language of the smallest sum wins.

n-grams are the runs of one to three symbols inside a word of letters, where a word
has one boundary symbol on each side.  Three code points fit one integer, so the
n-grams are counted exactly, and integers sort as their texts do.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanac.session import cut_lineage

PROFILE = 1000  # n-grams of a language's profile
DOCUMENT = 400  # n-grams of a document's list
LANGUAGES = 256  # languages compared in one pass: bounds what every task is sent
PIECE = 1 << 20  # symbols of a text that are looked at together
PENDING = 1 << 21  # counts that a task holds before it adds them up
FLUSH = 1 << 19  # added-up counts that a task holds

_BITS = 21  # of a code point


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.array([unicodedata.category(chr(k))[0] == "L" for k in range(sys.maxunicode + 1)], bool)


def _symbols(text: str) -> Iterator[np.ndarray]:
    """Letters with the boundary symbol 1 on both sides of each word, cut between words into
    pieces of about ``PIECE`` symbols; words that are neighbours share a boundary."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    at = 0
    while at < len(points):
        end = at + PIECE
        if end < len(points):  # a word is never cut
            rest = letter[end:]
            end += int(np.argmin(rest)) if not rest.all() else len(rest)
        part, own = points[at:end], letter[at:end]
        at = end
        if own.any():
            sym = np.ones(len(part) + 2, np.uint64)
            sym[1:-1][own] = part[own]
            word = sym > 1
            near = word.copy()
            near[1:] |= word[:-1]
            near[:-1] |= word[1:]
            yield sym[near]


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text's words, ascending, and how often each occurs.

    An n-gram is its symbols from the highest bits down, with 0 behind its end; the
    boundary by itself is none.
    """
    total = np.empty(0, np.uint64), np.empty(0, np.int64)
    for sym in _symbols(text):
        word = sym > 1
        one = sym << np.uint64(2 * _BITS)
        two = one[:-1] | sym[1:] << np.uint64(_BITS)
        three = two[:-1] | sym[2:]
        grams = np.concatenate([one[word], two[word[:-1] | word[1:]], three[word[1:-1]]])
        found = np.unique(grams, return_counts=True)
        total = merged([total, found]) if len(total[0]) else found
    return total


def merged(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of several counts."""
    kinds, inverse = np.unique(np.concatenate([c[0] for c in counts]), return_inverse=True)
    n = np.zeros(len(kinds), np.int64)
    np.add.at(n, inverse, np.concatenate([c[1] for c in counts]))
    return kinds, n


def ranked(kinds: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by their symbols."""
    return kinds[np.argsort(-n, kind="stable")[:size]]


class Profiles:
    """The profiles of some languages, as places by n-gram."""

    def __init__(self, languages: list[str], grams: list[np.ndarray], absent: int):
        self.languages = languages
        self.absent = absent  # distance of an n-gram that a profile lacks
        self.known = np.unique(np.concatenate(grams)) if grams else np.empty(0, np.uint64)
        self.places = np.full((len(languages), len(self.known) + 1), -1, np.int64)
        for k, g in enumerate(grams):
            self.places[k, np.searchsorted(self.known, g)] = np.arange(len(g))

    def distances(self, own: np.ndarray) -> np.ndarray:
        """Out-of-place distance of a document's list to each language."""
        at = np.searchsorted(self.known, own)
        at[at == len(self.known)] = 0
        at = np.where(self.known[at] == own, at, len(self.known))
        place = self.places[:, at]
        return np.where(place < 0, self.absent, np.abs(place - np.arange(len(own)))).sum(1)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of all rows of a task, counted before they are shuffled."""
    have: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, counts in have.items():
            kinds, n = merged(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(kinds.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])
        have.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            counts = ngram_counts(text.as_py())
            have.setdefault(lang.as_py(), []).append(counts)
            size += len(counts[0])
            if size >= PENDING:
                for name in have:
                    have[name] = [merged(have[name])]
                size = sum(len(c[0][0]) for c in have.values())
                if size >= FLUSH:
                    yield from flush()
                    size = 0
    yield from flush()


def learn(train: DataFrame, size: int = PROFILE) -> DataFrame:
    """``lang``, ``gram``, ``place`` (from 0): the profile of each language of (lang, text).

    Counts cover all rows with a language and a text.  A language whose texts hold no letter
    has no profile and is not learned.
    """
    src = train.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).dropna()
    counts = src.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < size).select("lang", "gram", "place")


def held_out(id_col: str = "doc_id"):
    """Rows that are never learned from; a null id counts as an empty one."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _compare(docs: DataFrame, profiles: Profiles, list_size: int, id_type: T.DataType) -> DataFrame:
    """Best language so far and the two smallest distances, after the languages of ``profiles``."""
    schema = (T.StructType([T.StructField("_id", id_type)]).add("_out", "boolean").add("_text", "string").add("_lang", "string")
              .add("_first", "long").add("_second", "long").add("_size", "long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, lang, first, second in zip(*(batch.column(j).to_pylist() for j in (2, 3, 4, 5)), strict=True):
                own = ranked(*ngram_counts(text or ""), list_size)
                if len(own):
                    d = profiles.distances(own)
                    order = np.argsort(d, kind="stable")
                    for k in order[:2].tolist():
                        new = int(d[k])
                        if first is None or new < first:
                            lang, first, second = profiles.languages[k], new, first
                        elif second is None or new < second:
                            second = new
                rows.append((lang, first, second, len(own)))
            made = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *made], schema.fieldNames())

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             profile_size: int = PROFILE, list_size: int = DOCUMENT) -> DataFrame:
    """``id_col``, ``held_out``, ``lang_pred``, ``score`` and ``margin`` of every row.

    Profiles are learned from the rows that are not held out and have a language and a
    text; the prediction reads the text alone.  ``score`` is one minus the distance as a share of the
    largest possible one, ``margin`` the lead over the second language as a share of its
    distance.  Null texts and texts without a letter are ``und`` with score 0, as is
    every text if nothing could be learned; equally near languages go by name.  Repeated
    ids and texts are judged row by row; other columns are ignored.

    Languages are compared in blocks of ``LANGUAGES``, so what a task is sent stays
    bounded however many there are; each block is one more map over the rows, none a shuffle.
    """
    texts = docs.select(F.col(id_col).alias("_id"), held_out(id_col).alias("_out"), F.col(text_col).cast("string").alias("_text"), F.col(lang_col).alias("_lang"))
    profiles = cut_lineage(learn(texts.where(~F.col("_out")).select(F.col("_lang").alias("lang"), F.col("_text").alias("text")), profile_size), "profiles")
    absent = max(profile_size, list_size)
    id_type = texts.schema["_id"].dataType
    none = F.lit(None)
    found = texts.select("_id", "_out", "_text", none.cast("string").alias("_lang"), none.cast("long").alias("_first"), none.cast("long").alias("_second"), F.lit(0).cast("long").alias("_size"))
    last = None
    while True:
        names = profiles.select("lang").distinct() if last is None else profiles.where(F.col("lang") > last).select("lang").distinct()
        block = [r["lang"] for r in names.orderBy("lang").limit(LANGUAGES).collect()]
        if not block:
            break
        rows = profiles.where(F.col("lang").between(block[0], block[-1])).orderBy("lang", "place").toArrow()
        lang, gram = np.array(rows.column("lang").to_pylist(), object), rows.column("gram").to_numpy().view(np.uint64)
        found = _compare(found, Profiles(block, [gram[lang == x] for x in block], absent), list_size, id_type)
        last = block[-1]
    score = F.when(F.col("_lang").isNull(), F.lit(0.0)).otherwise(1 - F.col("_first") / (F.col("_size") * absent))
    margin = F.when(F.col("_second") > 0, 1 - F.col("_first") / F.col("_second")).otherwise(F.lit(0.0))
    return found.select(F.col("_id").alias(id_col), F.col("_out").alias("held_out"), F.coalesce("_lang", F.lit("und")).alias("lang_pred"), score.alias("score"), margin.alias("margin"))
