"""Scans and sinks.

Parquet is the default storage; CSV appears only where the reference hands
files over as CSV (wide sales, calendar, prices, submission).  Every reader
takes an explicit schema or a column list so that the scan prunes columns.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str,
               columns: Iterable[str] | None = None) -> DataFrame:
    """Parquet scan of one test table, optionally column-pruned."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if columns is not None:
        df = df.select(*columns)
    return df


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str,
             date_format: str = "yyyy-MM-dd") -> DataFrame:
    """CSV with header and an explicit schema (no inference)."""
    return (spark.read.schema(schema).option("header", True)
            .option("dateFormat", date_format).csv(path))


def write_stage(df: DataFrame, path: str, sample: int | None = None) -> str:
    """Stage hand-over as parquet; sampled variants under ``sample=n``."""
    target = path if sample is None else f"{path.rstrip('/')}/sample={sample}"
    df.write.mode("overwrite").parquet(target)
    return target


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> str:
    """CSV sink with header, no index column.

    ``single_file`` coalesces to one task; only for result tables whose size
    is bounded (a submission has one row per series).
    """
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).csv(path)
    return path


def metadata_table(spark: SparkSession, rows: list[tuple[str, str, str, str]]) -> DataFrame:
    """Column metadata (variable, status, modeltype, h_dep) as a table."""
    schema = "variable string, status string, modeltype string, h_dep string"
    return spark.createDataFrame(rows, schema)


def ready_columns(meta: DataFrame) -> DataFrame:
    """The ``status = 'ready'`` filter of the metadata sheet."""
    return meta.where(F.col("status") == "ready")


def sample_series(df: DataFrame, id_col: str, n: int, seed: int = 1) -> DataFrame:
    """Keep ``n`` whole series, chosen by a seeded hash of the id.

    Deterministic under recomputation: the choice is a pure function of
    (id, seed).  The n chosen ids form a bounded table that is semi-joined
    back, so the sample never passes through the driver.
    """
    from almanac.operators.sampling import hash_order
    ids = (df.select(id_col).distinct()
           .withColumn("_h", hash_order([id_col], seed))
           .orderBy("_h", id_col).limit(n).select(id_col))
    return df.join(ids, id_col, "left_semi")
