"""Registry of catalogue queries (driver contract) and output helpers.

Each query is ``fn(spark, sf_dir) -> DataFrame``.  Queries with an SQL
equivalent register it next to the function; the SQL runs in DuckDB on the
same parquet tables as the oracle.

Output conventions shared by both sides so that results compare by value:
doubles are rounded with ``floor(x * 1e6 + 0.5) / 1e6`` (identical IEEE
arithmetic in both engines, unlike ``round`` at decimal ties), dates are
rendered as ``yyyy-MM-dd`` strings, counts are BIGINT.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c: str | Column) -> Column:
    """Round a double to 1e-6 the same way as the SQL ``r6``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c.cast("double") * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)


def ds(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.date_format(c, "yyyy-MM-dd")


def rounded(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Apply ``r6`` to the given (default: all double/float) columns."""
    if cols is None:
        cols = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: r6(c) for c in cols})


def sql_r6(expr: str) -> str:
    return f"(floor(CAST({expr} AS DOUBLE) * 1e6 + 0.5e0) / 1e6)"
