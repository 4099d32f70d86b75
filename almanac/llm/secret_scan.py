"""Secret scans over an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its content.  The
ledger holds, for each blob, the rule versions that it was scanned under and
the spans found.  A scan reads only blobs with a rule version that the ledger
lacks, appends what it finds, and joins the findings back to all paths and
versions that hold the blob.  Copies, however many, are scanned once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanac.session import cut_lineage

SPANS = "array<struct<rule: string, start: long, end: long>>"
LEDGER = f"blob string, rules array<string>, spans {SPANS}"


@dataclass(frozen=True)
class Rule:
    """A pattern over ASCII bytes.  ``needs``: lower-case literals of which any
    match has one (none: always searched); ``least``: characters that ``group``
    must have at least."""

    kind: str
    version: int
    pattern: bytes
    needs: tuple[bytes, ...] = ()
    group: int = 0
    least: int = 0

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# A private key: through its END line, unless another key begins before it; without one, over what
# looks like its body: header lines, long runs of base64, and lines of nothing but base64.
_BREAK = rb"""(?:[\s>|"'+,]|\\[nrt])"""
_KEY = (rb"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:(?!-----BEGIN )[\s\S])*?-----END [A-Z ]*PRIVATE KEY-----"
        rb"|(?:" + _BREAK + rb"*+(?:Proc-Type|DEK-Info):[^\n]*+)*+"
        rb"(?:" + _BREAK + rb"*+[A-Za-z0-9+/]{16,}+={0,2}+|\s*\n[\x20\t>|]*+[A-Za-z0-9+/]+={0,2}[\x20\t\r]*+(?=\n|\Z)|" + _BREAK + rb"*+[A-Za-z0-9+/]++={1,2}+)*+)")

# Fixed patterns: the first three are the base kinds, the others what the scan adds.
# pem names the line that begins a key, private the key itself.
RULES = (
    Rule("assign", 1, rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", (b"passw", b"secret", b"token", b"api"), 2, 6),
    Rule("access", 1, rb"AKIA[A-Z0-9]+", (b"akia",), 0, 20),
    Rule("hex", 1, rb"[0-9a-f]{24,}"),  # the same spans as [0-9a-f]+ of 24 or more
    Rule("pem", 1, rb"-----BEGIN [A-Z ]*PRIVATE KEY-----", (b"-----begin",)),
    Rule("forge", 1, rb"gh[pousr]_[A-Za-z0-9]{36,}", (b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_")),
    Rule("jwt", 1, rb"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}", (b"eyj",)),
    Rule("private", 1, _KEY, (b"-----begin",)),
)
BASE = ("assign", "access", "hex")
_HEX = bytes(ord("x") if chr(b) in "0123456789abcdef" else ord(" ") for b in range(256))


def find(text: bytes, rules: tuple[Rule, ...] = RULES) -> list[tuple[str, int, int]]:
    """(rule key, start, end) in code points, by start and then by the rules' order."""
    low = text.lower()
    found = []
    for order, rule in enumerate(rules):
        if rule.needs and not any(n in low for n in rule.needs):
            continue
        if rule.kind == "hex" and b"x" * 24 not in text.translate(_HEX):
            continue
        for m in re.finditer(rule.pattern, text):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                found.append((m.start(), order, m.end(), rule.key))
    if found and not text.isascii():
        at, chars, last = {}, 0, 0
        for p in sorted({p for f in found for p in (f[0], f[2])}):  # matches begin and end at ASCII bytes
            chars += len(text[last:p].decode(errors="replace"))
            at[p], last = chars, p
        found = [(at[s], o, at[e], k) for s, o, e, k in found]
    return [(key, start, end) for start, _, end, key in sorted(found)]


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES,
         path_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings, entries): ``path``, ``blob``, ``spans`` of every row of
    ``versions``, and the rows that the ledger gains (written to the shared
    folder; append them to the ledger for the next scan).

    A row is one version of one path.  A null text counts as empty; null and
    repeated paths pass through; other columns are ignored.
    """
    spark = versions.sparkSession
    src = versions.select(F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    keyed = src.select("path", blob_of(F.col("text")).alias("blob"))
    old = ledger if ledger is not None else spark.createDataFrame([], LEDGER)
    every = F.array(*[F.lit(r.key) for r in rules])
    known = old.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("known"))
    unseen = (keyed.groupBy("blob").agg(F.min("path").alias("first")).join(known, "blob", "left")
              .select("blob", "first", F.array_except(every, F.coalesce("known", F.array().cast("array<string>"))).alias("todo"))
              .where(F.size("todo") > 0))
    at = src["path"].eqNullSafe(F.col("first")) & (blob_of(src["text"]) == F.col("u_blob"))
    todo = (src.join(unseen.withColumnRenamed("blob", "u_blob"), at)
            .select(F.col("u_blob").alias("blob"), "todo", F.col("text").cast("binary").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            spans = []
            for k in range(batch.num_rows):
                keys = set(batch.column(1)[k].as_py())
                spans.append([dict(zip(("rule", "start", "end"), f, strict=True)) for f in find(batch.column(2)[k].as_py() or b"", tuple(r for r in rules if r.key in keys))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, kind)], ["blob", "rules", "spans"])

    # rows that repeat path and text are scanned more than once and entered once
    entries = cut_lineage(todo.mapInArrow(run, LEDGER).dropDuplicates(["blob", "rules"]), "ledger")
    # a blob has one entry for each scan that added rule versions; spans of older versions are left out
    current = (old.union(entries).groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("all"))
               .select("blob", F.array_sort(F.transform(F.filter("all", lambda s: F.array_contains(every, s["rule"])), lambda s: F.struct(
                   s["start"].alias("start"), F.array_position(every, s["rule"]).alias("no"), s["end"].alias("end"), s["rule"].alias("rule")))).alias("sorted"))
               .select("blob", F.transform("sorted", lambda s: F.struct(F.substring_index(s["rule"], "@", 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans")))
    return keyed.join(current, "blob", "left").select("path", "blob", "spans"), entries


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each run of overlapping spans replaced by ``mark``."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark))).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.char_length(text))))
