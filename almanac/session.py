"""Session construction and shared-storage helpers.

Everything in the library takes a ``SparkSession`` from the caller; this module
only builds one for tests, the bench and the driver smoke check, and resolves
the shared folder used to cut lineage.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Settings the operators rely on.  AQE re-plans joins and coalesces shuffle
# partitions at run time; skew-join splitting handles a hot key on either side.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # A local session runs its tasks in the driver; the default heap of 1 GB does not last for the whole test suite.
    "spark.driver.memory": "4g",
}


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app_name: str = "almanac", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    ``spark.checkpoint.dir`` is left alone when the cluster sets it; only an
    unset value gets a scratch folder (local tests).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder that ``spark.checkpoint.dir`` names.

    Only a ``local`` session, whose driver is its one executor, gets a scratch
    folder when the setting is missing; on a cluster that is an error, since a
    folder of one machine would hold only that machine's part of a table.
    """
    cdir = spark.conf.get("spark.checkpoint.dir", None)
    if not cdir:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        cdir = tempfile.mkdtemp(prefix="almanac-")
        spark.conf.set("spark.checkpoint.dir", cdir)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(cdir)
    return cdir


def cut_lineage(df: DataFrame, name: str | None = None, schema: StructType | None = None) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and read it back.

    Used between long stages (panel -> features -> models) so that a lost
    executor recomputes from the written table, not from the raw scan.  The
    parquet copy keeps column statistics, so later scans still prune and push
    filters down.  ``schema`` reads the table as other types that are stored alike
    (a struct of a vector's parts as vectors).
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tables/{name or 'stage'}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Within the block, Arrow batches sent to Python hold ``most`` rows at most.

    Such a batch stands once in the executor and once in its Python worker, so for long
    texts its rows decide what both need.  Only plans that run inside the block are affected.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(min(int(old), most) if int(old) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(key, old)


@contextmanager
def small_batches(spark: SparkSession, most: int) -> Iterator[None]:
    """``arrow_rows``, and tables are read in batches of ``most`` rows at most: for rows of some hundred KB each."""
    key = "spark.sql.parquet.columnarReaderBatchSize"
    old = spark.conf.get(key)
    spark.conf.set(key, str(min(int(old), most)))
    try:
        with arrow_rows(spark, most):
            yield
    finally:
        spark.conf.set(key, old)
