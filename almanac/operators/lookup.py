"""Joining rows to a table with one row per key, where a key may hold most rows.

An equi-join deals rows by key, so a key with a third of the rows makes one task
with a third of the rows.  Here the table carries how many rows each key has: keys
above one part in ``HOT`` of all rows, of which there are fewer than ``HOT``, are sent to
every task; the rows of all other keys are dealt by key, and rows that have their
values already are dealt by a hash of the row.  A table of at most ``HOT`` keys goes to every task whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT = 1 << 14


def light(table: DataFrame) -> DataFrame:
    """A written table, marked to go to every task whole if it has ``HOT`` rows at most."""
    return F.broadcast(table) if table.count() <= HOT else table


def attach(df: DataFrame, table: DataFrame, keys: Sequence[str], count: str, how: str = "left") -> DataFrame:
    """``df`` with the columns of ``table`` behind ``keys`` and ``count``.

    ``table`` has one row per key and should be written (``cut_lineage``): it is read
    three times, and its size on disk lets the planner broadcast it whole if it is small.
    Rows whose key is null or missing get nulls (``left``) or go (``inner``).  Map columns of ``df`` do
    not take part in the row hash.
    """
    values = [c for c in table.columns if c not in (*keys, count)]
    if table.count() <= HOT:
        return df.join(F.broadcast(table.select(*keys, *values)), list(keys), how).select(*df.columns, *values)
    total = table.select(F.sum(count)).scalar()
    is_hot = F.col(count) * F.lit(HOT) > total
    hot = table.where(is_hot).select(*keys, F.struct(*values).alias("_hot"))
    cold = table.where(~is_hot).select(*keys, F.lit(0).cast("long").alias("_salt"), F.struct(*values).alias("_cold"))
    plain = [c for c, t in df.dtypes if "map<" not in t]
    waits = F.col("_hot").isNull()
    for k in keys:
        waits = waits & F.col(k).isNotNull()
    salt = F.when(waits, F.lit(0).cast("long")).otherwise(1 + F.pmod(F.xxhash64(*plain), F.lit(1 << 20)))
    out = df.join(F.broadcast(hot), list(keys), "left").withColumn("_salt", salt).join(cold, [*keys, "_salt"], "left")
    if how == "inner":
        out = out.where(F.col("_hot").isNotNull() | F.col("_cold").isNotNull())
    return out.select(*df.columns, *[F.coalesce(F.col(f"_hot.{v}"), F.col(f"_cold.{v}")).alias(v) for v in values])


def key_counts(df: DataFrame, keys: Sequence[str], count: str = "_count") -> DataFrame:
    """Rows of each key without nulls, combined in each task before they are shuffled."""
    return df.select(*keys).dropna().groupBy(*keys).agg(F.count(F.lit(1)).alias(count))
