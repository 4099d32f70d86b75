"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.operators import lookup
from almanac.session import cut_lineage


SMALL_FILES = 4  # tasks that write the labels of a small graph


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``comp`` (smallest node reachable) for every node of the edges (a, b).

    Rounds of "take the smallest label among the neighbours and the label of one's
    label", each written to the shared folder, until no label changes.
    Stars and cliques end after one round; doubling keeps chains short too.
    Neighbour labels are reduced by a map-side minimum, so a node with very
    many edges is not gathered in one task.  Few labels are looked up without a
    shuffle and written by few tasks.
    """
    ways = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
    both = cut_lineage(edges.where("a <> b").select(F.inline(ways)).distinct(), "edges")
    few = both.count() <= 2 * lookup.HOT

    def beside(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if few else table

    def written(table: DataFrame) -> DataFrame:
        return cut_lineage(table.coalesce(SMALL_FILES) if few else table, "labels")

    labels = written(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("least"))
                     .select("node", F.least("node", "least").alias("comp")))
    while True:
        near = both.join(beside(labels.withColumnRenamed("node", "dst")), "dst").groupBy(F.col("src").alias("node")).agg(F.min("comp").alias("near"))
        above = labels.select(F.col("node").alias("comp"), F.col("comp").alias("above"))
        jumped = labels.join(beside(above), "comp", "left").select("node", F.col("comp").alias("old"), F.coalesce("above", "comp").alias("above"))
        stepped = written(near.join(beside(jumped), "node").select("node", "old", F.least("old", "near", "above").alias("comp")))
        labels = stepped.select("node", "comp")
        if stepped.where("old <> comp").isEmpty():
            return labels


def joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The labels of ``components`` after more edges (a, b) between components.

    Only components that an edge touches are gone through again.
    """
    known = lookup.light(labels)
    ends = edges
    for x in "ab":
        ends = ends.join(known.select(F.col("node").alias(x), F.col("comp").alias(f"comp_{x}")), x, "left")
    between = cut_lineage(ends.select(F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b")).distinct(), "between")
    if between.isEmpty():
        return labels
    merged = components(between).select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    # a node without an edge before is its own component
    fresh = merged.select(F.col("comp").alias("node"), "comp").join(known, "node", "left_anti")
    return cut_lineage(labels.union(fresh).join(lookup.light(merged), "comp", "left").select("node", F.coalesce("top", "comp").alias("comp")), "labels")
