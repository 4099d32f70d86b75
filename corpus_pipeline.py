"""Training-data pipeline over ``documents``: five stages, each written as Parquet and read again.

1. ``quality``: documents that the classifier rejects go;
2. ``near_dedup``: one document of each group of near-duplicates stays (five-word
   shingles, similarity 0.8), the one with the smallest id;
3. ``decontaminate``: documents that hold a benchmark item, whole or edited, go;
4. ``secrets``: found secrets are replaced by a mark, all documents stay;
5. ``bpe``: token ids.

Stages 1 to 4 return the columns of ``documents``, whatever they are called.  Null texts
count as empty.  Stages 1 to 3 decide on rows, not on ids: a row is named by its id and its text, so
a rejected text takes no other text of its id with it, and rows without an id are judged like
all others.  Rows that repeat id and text are one document; near-deduplication leaves one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm import bpe, decontam, neardup, quality, secret_scan
from almanac.llm.queries import TOKENIZER
from almanac.session import cut_lineage
from almanac.sources.tables import read_table


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    while name in docs.columns:
        name = "_" + name
    return name


def _named(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a column that names a row by its id (none: last) and its text."""
    name = _fresh(docs, "_row")
    text = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    return docs.withColumn(name, F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), text.alias("text"))), name


def _without(docs: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    return docs.join(gone.select(row).distinct(), row, "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, row = _named(docs)
    scores = quality.quality_scores(rows, read_table(spark, sf_dir, "labels", ["doc_id", "quality"]), keep=[row])
    return _without(rows, row, scores.where("predicted = 0")).select(docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, row = _named(docs)
    groups = cut_lineage(neardup.near_duplicates(rows, id_col=row), "near-duplicates")
    kept = _without(rows, row, groups.where(~F.col("kept")))
    # few rows repeat id and text: only they are dealt by their name to leave one of each
    again = groups.where("n_shingles > 0").groupBy(row).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(row)
    single = _without(kept, row, again)
    one = kept.join(again, row, "left_semi").dropDuplicates([row])
    return single.unionByName(one).select(docs.columns)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, row = _named(docs)
    found = decontam.contaminated(rows, read_table(spark, sf_dir, "benchmark", ["item_id", "text"]), id_col=row)
    return _without(rows, row, found).select(docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path, blob, spans = (_fresh(docs, name) for name in ("_path", "_blob", "_spans"))
    found, _ = secret_scan.scan(docs)
    found = (found.where(F.size("spans") > 0).dropDuplicates(["path", "blob"])
             .select(F.col("path").alias(path), F.col("blob").alias(blob), F.col("spans").alias(spans)))
    same = docs["doc_id"].eqNullSafe(found[path]) & (secret_scan.blob_of(docs["text"]) == found[blob])
    clean = F.when(F.col(spans).isNotNull(), secret_scan.redact(F.col("text"), F.col(spans))).otherwise(F.col("text"))
    return (docs.join(found, same, "left").withColumn("text", clean)
            .withColumn("n_chars", F.when(F.col(spans).isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs, TOKENIZER).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("decontaminate", decontaminate_stage), ("secrets", secrets_stage), ("bpe", bpe_stage)]

#: The classifier's scores have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; what each returns is written to the shared folder and read by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
