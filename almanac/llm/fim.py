"""Fill-in-middle transformation by rotating blocks inside one buffer.

A text is scanned once for its units (runs of ASCII letters, and every other
character).  Two cuts at unit boundaries split it into prefix, middle and
suffix; the sentinels are inserted into a bytearray, and the blocks change places
by three reversals (each block by itself, then both together).  Restoring finds the
sentinels in the output, undoes the rotation and takes the sentinels out.

All work is on UTF-8 bytes: a unit starts at a byte that is no continuation byte,
so no cut splits a character.  A text that holds a sentinel stays plain, and no
sentinel arises where a piece meets one (each begins with ``<`` and ends with ``>``),
so the first occurrence of a sentinel in an output is the inserted one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARK = 3  # bytes of a sentinel
OUT_BYTES = 8 << 20  # bytes of text in one Arrow batch that goes back to the JVM

_LETTER = np.zeros(256, bool)
_LETTER[ord("A"):ord("Z") + 1] = _LETTER[ord("a"):ord("z") + 1] = True
_START = (np.arange(256) & 0xC0) != 0x80  # first bytes of characters


def unit_starts(data: bytes) -> np.ndarray:
    """Byte offset of each unit ``[A-Za-z]+|[^A-Za-z]``, left to right."""
    raw = np.frombuffer(data, np.uint8)
    letter = _LETTER[raw]
    inner = letter.copy()
    inner[1:] &= letter[:-1]
    inner[:1] = False
    return np.flatnonzero(_START[raw] & ~inner)


def draws(key: str, seed: int) -> list[int]:
    """Four unsigned 32-bit numbers that depend on the seed and the document's id only."""
    h = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(h[k:k + 8], 16) for k in range(0, 32, 8)]


def rotate(buf: bytearray, a: int, m: int, b: int) -> None:
    """Exchange the neighbouring blocks [a, m) and [m, b) in place."""
    for x, y in ((a, m), (m, b), (a, b)):
        buf[x:y] = buf[x:y][::-1]


def arrange(data: bytes, first: int, second: int, form: str) -> bytearray:
    """``data`` cut at the bytes ``first`` <= ``second``, in the order of ``form``."""
    buf = bytearray(data)
    buf[second:second] = SUFFIX
    buf[first:first] = MIDDLE
    buf[0:0] = PREFIX
    middle, suffix = first + MARK, second + 2 * MARK
    rotate(buf, middle if form == "psm" else 0, suffix, len(buf))
    return buf


def restore_bytes(output: bytes, form: str) -> bytes:
    """The text that ``output`` was made of."""
    if form == "plain":
        return output
    buf = bytearray(output)
    end = len(buf)
    start = buf.index(SUFFIX) if form == "psm" else 0
    turn = buf.index(MIDDLE if form == "psm" else PREFIX)
    rotate(buf, start, turn, end)
    suffix = start + end - turn
    middle = start if form == "psm" else buf.index(MIDDLE)
    for at in (suffix, middle, 0):
        del buf[at:at + MARK]
    return bytes(buf)


def transform_bytes(data: bytes, key: str, seed: int, plain: int, spm: int) -> tuple[int, str, int | None, int | None, bytes]:
    """Units, form, characters of prefix and middle, and output of one text."""
    starts = unit_starts(data)
    n = len(starts)
    h1, h2, h3, h4 = draws(key, seed)
    if not n or h3 % 100 >= 100 - plain or PREFIX in data or SUFFIX in data or MIDDLE in data:
        return n, "plain", None, None, data
    form = "spm" if h4 % 100 < spm else "psm"
    cuts = [int(starts[k]) if k < n else len(data) for k in sorted((h1 % (n + 1), h2 % (n + 1)))]
    begins = _START[np.frombuffer(data, np.uint8)]
    return n, form, int(begins[:cuts[0]].sum()), int(begins[cuts[0]:cuts[1]].sum()), bytes(arrange(data, *cuts, form))


def _by_row(make: Callable[..., tuple], fields: list[tuple[str, pa.DataType]]) -> Callable:
    """Arrow map that applies ``make`` to the values of each row behind the first column, which is kept."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, first, size = [], 0, 0
            for k, values in enumerate(zip(*(c for c in batch.columns[1:]), strict=True)):
                rows.append(make(*(v.as_py() for v in values)))
                size += len(rows[-1][-1])
                if size >= OUT_BYTES or k + 1 == batch.num_rows:
                    made = [pa.array([r[j] for r in rows], kind) for j, (_, kind) in enumerate(fields)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(rows)), *made], ["_id", *(name for name, _ in fields)])
                    rows, first, size = [], k + 1, 0
    return run


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain: int = 10, spm: int = 20) -> DataFrame:
    """``id_col``, ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` of every row.

    ``plain`` of 100 documents stay as they are, ``spm`` of 100 of the others put
    the suffix first; the choices hang on ``seed`` and the id alone, so rows that repeat an id
    are cut by the same draws and a lost task makes the same rows again.  A null text counts as
    empty and is plain, a null id draws as an empty one.  Map-only, whole
    texts; other columns are ignored, so their names cannot clash.
    """
    src = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_key"),
                      F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("_text"))
    schema = T.StructType([T.StructField("_id", src.schema["_id"].dataType)]).add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("_out", "binary")
    fields = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("_out", pa.binary())]
    out = src.mapInArrow(_by_row(lambda key, data: transform_bytes(data, key, seed, plain, spm), fields), schema)
    return out.select(F.col("_id").alias(id_col), "n", "form", "prefix_chars", "middle_chars", F.col("_out").cast("string").alias("output"))


def restore(made: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``restored``, the text rebuilt from ``output`` and ``form`` alone.

    Null output or form counts as an empty plain text.
    """
    src = made.select(F.struct(*keep).alias("_id"), F.coalesce(F.col("output").cast("binary"), F.lit(b"")).alias("_text"), F.coalesce("form", F.lit("plain")).alias("_form"))
    schema = T.StructType([T.StructField("_id", src.schema["_id"].dataType)]).add("_out", "binary")
    out = src.mapInArrow(_by_row(lambda data, form: (restore_bytes(data, form),), [("_out", pa.binary())]), schema)
    return out.select("_id.*", F.col("_out").cast("string").alias("restored"))
