"""Running sums over a global order without a single-partition window.

Ranks (W11), AUC (A12), ROC/PR curves (E5, E9, E10), the empirical CDF (A29)
and exact quantiles (X1, A24, X6, E7, E8) all need, for every distinct value,
the totals of all smaller (or larger) values.  ``Window.orderBy`` without a
partition would move every row to one task.  Instead:

1. pre-aggregate to one row per (group, value) - map-side partial
   aggregation, so a value held by a third of all rows is one row;
2. deal these rows by range of (group, value) into ``n_buckets`` slices and write
   them with their slice;
3. slice totals -> exclusive offsets by a window over the (few) slices;
4. running sum inside each slice + the slice offset.

Slices only balance the work: results are exact wherever the slices' bounds
lie, and the slices are written, so a lost task recomputes the same values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def default_buckets(df: DataFrame) -> int:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(2, n)


def cumulative(df: DataFrame, value: str | Column, sums: Mapping[str, Column],
               by: Sequence[str] = (), descending: bool = False,
               n_buckets: int | None = None) -> DataFrame:
    """One row per (by, value) with the aggregates in ``sums`` plus

    * ``cum_<name>``: running total over all values up to and including this
      one in the requested order (within the group),
    * ``tot_<name>``: the group total.

    ``value`` must be numeric; its column in the output is ``value``.

    The aggregate is written once to the shared folder; the slice totals and the
    result read that table, so the input is scanned once.
    """
    from almanac.session import cut_lineage
    by = list(by)
    vcol = F.col(value) if isinstance(value, str) else value
    agg = (df.where(vcol.isNotNull())
           .groupBy(*by, vcol.cast("double").alias("value"))
           .agg(*[c.alias(n) for n, c in sums.items()]))
    key = (-F.col("value")) if descending else F.col("value")
    ranged = agg.withColumn("__k", key).repartitionByRange(n_buckets or default_buckets(df), *map(F.col, by), F.col("__k"))
    agg = cut_lineage(ranged.withColumn("__b", F.spark_partition_id()), "value_counts")

    names = list(sums)
    tot = agg.groupBy(*by, "__b").agg(*[F.sum(n).alias(f"_t_{n}") for n in names])
    w_before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    w_group = Window.partitionBy(*by)
    off = tot.select(*by, "__b",
                     *[F.coalesce(F.sum(f"_t_{n}").over(w_before), F.lit(0)).alias(f"_o_{n}") for n in names],
                     *[F.sum(f"_t_{n}").over(w_group).alias(f"tot_{n}") for n in names])
    w_run = Window.partitionBy(*by, "__b").orderBy("__k").rowsBetween(Window.unboundedPreceding, 0)
    out = agg.join(off, [*by, "__b"])
    out = out.withColumns({f"cum_{n}": F.col(f"_o_{n}") + F.sum(n).over(w_run) for n in names})
    return out.drop("__k", "__b", *[f"_o_{n}" for n in names])


def average_rank_table(df: DataFrame, col: str, by: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """Distinct values with their average rank (ties share the mean of
    their positions, 1-based): ``below + (n + 1) / 2``."""
    c = cumulative(df, col, {"_n": F.count(F.lit(1))}, by=by)
    return c.select(*by, F.col("value").alias(col),
                    (F.col("cum__n") - F.col("_n") + (F.col("_n") + F.lit(1)) / F.lit(2.0)).alias(out))


def with_average_rank(df: DataFrame, col: str, by: Sequence[str] = (), out: str | None = None) -> DataFrame:
    """Attach the average rank of ``col`` to every row (join on the value)."""
    out = out or f"{col}_rank"
    ranks = average_rank_table(df, col, by, out).withColumnRenamed(col, "_v")
    return (df.withColumn("_v", F.col(col).cast("double"))
            .join(ranks, [*by, "_v"], "left").drop("_v"))


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation (pandas/numpy default,
    Spark ``percentile``, DuckDB ``quantile_cont``), without holding a
    group's values in one buffer.

    Output: by..., prob, quantile.  Position h = (n - 1) * p (0-based); the
    values at floor(h) and ceil(h) are located from the cumulative counts.
    """
    by = list(by)
    c = cumulative(df, col, {"_n": F.count(F.lit(1))}, by=by)
    probs_arr = F.array(*[F.lit(float(p)) for p in probs])
    c = c.withColumn("_lo_pos", F.col("cum__n") - F.col("_n"))  # first 0-based position of this value
    # positions (floor and ceil of h) that fall on this value
    pos = F.transform(probs_arr, lambda p: F.struct(
        p.alias("p"),
        F.floor((F.col("tot__n") - 1) * p).alias("lo"),
        F.ceil((F.col("tot__n") - 1) * p).alias("hi"),
        ((F.col("tot__n") - 1) * p).alias("h")))
    hits = F.filter(pos, lambda s: ((s["lo"] >= F.col("_lo_pos")) & (s["lo"] < F.col("cum__n")))
                    | ((s["hi"] >= F.col("_lo_pos")) & (s["hi"] < F.col("cum__n"))))
    e = c.select(*by, "value", "_lo_pos", "cum__n", F.explode(hits).alias("s"))
    is_lo = (F.col("s.lo") >= F.col("_lo_pos")) & (F.col("s.lo") < F.col("cum__n"))
    is_hi = (F.col("s.hi") >= F.col("_lo_pos")) & (F.col("s.hi") < F.col("cum__n"))
    g = e.groupBy(*by, F.col("s.p").alias("prob")).agg(
        F.max(F.when(is_lo, F.col("value"))).alias("_vlo"),
        F.max(F.when(is_hi, F.col("value"))).alias("_vhi"),
        F.first("s.h").alias("_h"), F.first("s.lo").alias("_l"))
    frac = F.col("_h") - F.col("_l")
    return g.select(*by, "prob", (F.col("_vlo") + frac * (F.col("_vhi") - F.col("_vlo"))).alias("quantile"))


def global_row_number(df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), out: str = "rank",
                      n_parts: int | None = None) -> DataFrame:
    """``row_number() over (partition by by order by order)`` without sorting
    a whole group in one task, for composite (e.g. numeric then string) keys.

    The rows are range-partitioned on (by, order) - ties inside a group are
    split by the later keys - and sorted, and their partition and place in it are
    written once with the rows to the shared checkpoint folder, so every later use
    sees the same assignment and no row is dealt again.  Per-(partition, group) counts
    give each partition's offset (a window over at most ``n_parts`` rows per group); the rank is
    the offset plus the place among the group's rows of the partition.  Ranks of
    rows that the order does not tell apart are arbitrary.
    """
    from almanac.operators.lookup import light
    from almanac.session import cut_lineage
    nb = n_parts or default_buckets(df)
    keys = [*[F.col(b) for b in by], *order]
    ranged = df.repartitionByRange(nb, *keys).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id())
    ranged = cut_lineage(ranged.withColumns({"__pid": F.shiftright("__id", 33), "__at": F.col("__id").bitwiseAND((1 << 33) - 1)}).drop("__id"), "ranged")
    cnt = ranged.groupBy("__pid", *by).agg(F.count(F.lit(1)).alias("__c"), F.min("__at").alias("__first"))
    w = Window.partitionBy(*by).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    off = cnt.select("__pid", *by, (F.coalesce(F.sum("__c").over(w), F.lit(0)) - F.col("__first") + 1).alias("__off"))
    off = light(cut_lineage(off, "offsets"))  # a row for each partition and group that lies in it
    return (ranged.join(off, ["__pid", *by]).withColumn(out, F.col("__off") + F.col("__at"))
            .drop("__pid", "__at", "__off"))
