"""BPE encoding and decoding by a dynamic programme over prefixes.

BPE's result for a prefix of a word decides all that the word's later symbols
need: the *last token* of each prefix is unique.  The encoder reads a word
through an automaton over the vocabulary whose suffix links list every token
that ends at the current symbol.  A token ``t`` of length k is the last token
of prefix i exactly if the last token of prefix i - k and ``t`` are compatible,
that is, if encoding the two side by side leaves both whole.  Following the
stored tokens back from the word's end gives the ids.

Compatibility of two tokens is decided on their *spines*: as merges happen,
the symbol left of the boundary walks up the right edge of the first token's
merge tree and the symbol right of it up the left edge of the second's.  The
tokens are compatible if no merge across the boundary ever comes before the
next step of either walk.

The file read is a tokenizers JSON with the layout of ``word_bpe_49k.json``:
NFC, white space to one space, lower case; split into contractions, letter
runs, single digits and runs of other characters; bytes as printable
characters; word ends marked ``</w>``; special strings cut out of the raw text;
no decoder, so decoding joins the token strings with one space.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

END = "\0"  # marks a word's end in the automaton; no byte is written as this character
NEVER = 1 << 60
CACHE_WORDS = 150_000  # entries of one of the two generations of each per-worker cache
OUT_BYTES = 8 << 20  # bytes of ids and text in one Arrow batch that goes back to the JVM

# White space of the tokenizer's pattern language; str.split() would also take \x1c-\x1f.
_WS = "\t-\r \x85\xa0  -     　"


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where it is
    printable Latin-1, else the next free one from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(rest)) for b in range(256)]


class Remembered(dict):
    """A dict that computes missing values.  When full it becomes the older
    generation, from which entries still in use come back."""

    def __init__(self, make, size: int = CACHE_WORDS):
        super().__init__()
        self.make, self.size, self.older = make, size, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class PrefixBpe:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or model["end_of_word_suffix"] != "</w>" or spec["decoder"]:
            raise ValueError(f"{path} is not a word-end BPE file of the layout that this encoder reads")
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self._packed = {i: i.to_bytes(4, "little") for i in self.strings}
        bare = [b for b in byte_letters() if not {b, b + "</w>"} <= set(self.vocab)]
        if bare:  # every prefix of a word must have a last token
            raise ValueError(f"{path} has no token of its own for {len(bare)} bytes")
        self._cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._letters = byte_letters()
        self._pieces = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_WS}\p{{L}}\p{{N}}]+")
        self._words = regex.compile(f"[^{_WS}]+")
        self._build(model["merges"])
        self._pair_ok = Remembered(lambda pair: self._meet(pair >> 32, pair & 0xFFFFFFFF)[0] == NEVER, 4 * CACHE_WORDS)
        self._piece = Remembered(self._encode_piece)
        self.word_ids = Remembered(self._encode_word)

    def _build(self, merges: list) -> None:
        self.rank: dict[tuple[int, int], int] = {}
        made: dict[int, tuple[int, int, int]] = {}
        for r, m in enumerate(merges):
            a, b = m if isinstance(m, list) else m.split(" ")
            pair = self.vocab[a], self.vocab[b]
            token = self.vocab[a + b]
            self.rank.setdefault(pair, r)
            made.setdefault(token, (*pair, r))
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._left: dict[int, list[tuple[int, int]]] = {}
        whole: set[int] = set()
        auto = ahocorasick.Automaton()
        for text, t in sorted(self.vocab.items(), key=lambda x: made.get(x[1], (0, 0, -1))[2]):
            if t in made:
                a, b, r = made[t]
                self._right[t] = [*self._right[b][:-1], (b, r), (t, NEVER)]
                self._left[t] = [*self._left[a][:-1], (a, r), (t, NEVER)]
                # a token takes part only if its own text encodes to it alone
                if not (a in whole and b in whole and self._meet(a, b) == (r, True)):
                    continue
            else:
                self._right[t] = self._left[t] = [(t, NEVER)]
            whole.add(t)
            plain = text.removesuffix("</w>") if len(text) > 4 else text
            auto.add_word(plain + END * (plain != text), (t, len(plain)))
        auto.make_automaton()
        self._auto = auto

    def _meet(self, t1: int, t2: int) -> tuple[int, bool]:
        """The rank of the first merge across the boundary of two tokens (NEVER:
        none), and whether both were complete by then."""
        xs, ys, i, j = self._right[t1], self._left[t2], 0, 0
        rank = self.rank
        while True:
            (x, up_x), (y, up_y) = xs[i], ys[j]
            m = rank.get((x, y), NEVER)
            if m < up_x and m <= up_y:
                return m, up_x == up_y == NEVER
            if up_x == up_y == NEVER:
                return NEVER, True
            if up_x <= up_y:
                i += 1
            else:
                j += 1

    def _encode_piece(self, piece: str) -> bytes:
        letters = piece if piece.isascii() and piece.isprintable() else "".join(map(self._letters.__getitem__, piece.encode()))
        n = len(letters)
        last, size = [0] * (n + 1), [0] * (n + 1)
        ok = self._pair_ok
        for at, (token, k) in self._auto.iter(letters + END):
            end = at + 1
            if end >= n:
                if end == n:
                    continue  # the last symbol counts only together with the word's end
                end = n
            if size[end]:
                continue
            if end == k or ok[last[end - k] << 32 | token]:
                last[end], size[end] = token, k
        out, end = [], n
        while end:
            out.append(last[end])
            end -= size[end]
        out.reverse()
        return b"".join([self._packed[t] for t in out])

    def _encode_word(self, word: str) -> bytes:
        if word.isalpha():
            return self._piece[word]
        if word[-1] in ".," and word[:-1].isalpha():
            return self._piece[word[:-1]] + self._piece[word[-1]]
        return b"".join([self._piece[p] for p in self._pieces.findall(word)])

    def _split(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # lower case by character, whatever stands after it
                text = text.replace("Σ", "σ")
        text = text.lower()
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
            return self._words.findall(text)
        return text.split()

    def encode_ids(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self._cut is None or not any(s in text for s in self.special):
            return b"".join(map(self.word_ids.__getitem__, self._split(text)))
        ids = []
        for part in self._cut.split(text):
            if part in self.special:
                ids.append(self._packed[self.special[part]])
            else:
                ids += map(self.word_ids.__getitem__, self._split(part))
        return b"".join(ids)

    def encode(self, text: str) -> tuple[bytes, str]:
        """The ids of a text, and the text that they decode to."""
        ids = self.encode_ids(text)
        return ids, self.decode(ids)

    def plain_ids(self, text: str) -> bytes:
        """Ids of a text in which special strings are ordinary text."""
        return b"".join(map(self.word_ids.__getitem__, self._split(text)))

    def decode(self, ids: bytes) -> str:
        """Token strings joined with one space; ids outside the vocabulary are left out."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        try:
            return " ".join(map(self.strings.__getitem__, numbers))
        except KeyError:
            return " ".join([self.strings[i] for i in numbers if i in self.strings])


@lru_cache(maxsize=2)
def load(path: str) -> PrefixBpe:
    """One encoder per file and Python worker."""
    return PrefixBpe(path)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ids`` (binary, little-endian uint32) and ``decoded`` of every row.

    Map-only: no row leaves its partition, whole texts are encoded, and a batch
    that goes back to the JVM is cut at ``OUT_BYTES``.  A null text counts as
    empty (no ids, empty text); null and repeated ids pass through; other
    columns are ignored, so their names cannot clash.
    """
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    id_type = src.schema["_id"].dataType
    schema = T.StructType([T.StructField("_id", id_type), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            ids, out, first, size = [], [], 0, 0
            keys, texts = batch.column(0), batch.column(1)
            for k in range(batch.num_rows):
                a, b = bpe.encode(texts[k].as_py() or "")
                ids.append(a)
                out.append(b)
                size += len(a) + len(b)
                if size >= OUT_BYTES or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([keys.slice(first, len(ids)), pa.array(ids, pa.binary()), pa.array(out, pa.string())], ["_id", "ids", "decoded"])
                    ids, out, first, size = [], [], k + 1, 0

    return src.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
