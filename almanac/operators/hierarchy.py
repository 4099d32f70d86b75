"""Hierarchical aggregation and the weighted, scaled error.

Looping over 12 aggregation levels would scan the panel 12 times, and grouping
sets copy every row 12 times before they add anything up.  Here the levels form a
lattice: the finest one is added up from the rows, every other one from the
smallest finer level, so all but the first step work on node tables.

Dimensions absent from a level are null in its rows, so tables keyed by
(level, dims) are joined with null-safe equality (J4).  That join is between
two aggregates whose size is the number of hierarchy nodes (not the number of
rows), and still plans as a hash join.

Skew: sums are combined in each task before the shuffle, and the total is
added up from the few rows of the level below it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# The 12 aggregation levels of the evaluation metric
# ---------------------------------------------------------------------------
LEVELS = {
    1: [],
    2: ["state_id"], 3: ["store_id"], 4: ["cat_id"], 5: ["dept_id"],
    6: ["state_id", "cat_id"], 7: ["state_id", "dept_id"],
    8: ["store_id", "cat_id"], 9: ["store_id", "dept_id"],
    10: ["item_id"], 11: ["item_id", "state_id"], 12: ["item_id", "store_id"],
}
DIMS = ["state_id", "store_id", "cat_id", "dept_id", "item_id"]


#: What each dimension decides: a row's item has one department, a store one state.
IMPLIED = {"item_id": ["dept_id", "cat_id"], "dept_id": ["cat_id"], "store_id": ["state_id"]}


def closure(dims: Sequence[str], implied: Mapping[str, Sequence[str]] = IMPLIED) -> set[str]:
    """The dimensions and all that they decide."""
    return set(dims).union(*[implied.get(d, ()) for d in dims])


def finer_level(level: int, levels: Mapping[int, list[str]] = LEVELS, implied: Mapping[str, Sequence[str]] = IMPLIED) -> int | None:
    """The coarsest other level that decides all of this level's dimensions: the one with the fewest
    dimensions decided, then the largest of them left over last (None: only the rows themselves)."""
    own = closure(levels[level], implied)
    finer = [m for m in levels if m != level and own < closure(levels[m], implied)]
    return min(finer, key=lambda m: (len(closure(levels[m], implied)), m)) if finer else None


def level_aggregate(df: DataFrame, sums: Mapping[str, Column], extra_keys: Sequence[str] = (), levels: Mapping[int, list[str]] = LEVELS,
                    dims: Sequence[str] = DIMS, implied: Mapping[str, Sequence[str]] = IMPLIED) -> DataFrame:
    """A4: sums at every level, each level added up from the smallest finer one.

    Only the finest level reads the rows; a level with few nodes reads a table with a few more, so the
    rows are not copied per level.  ``sums`` are aggregates that add up (sums and counts);
    ``extra_keys`` (e.g. ``date``) belong to every level.  The dimensions must form a hierarchy as
    ``implied`` says.  Output: level, dims (null outside the level), extra keys, sums.
    """
    done: dict[int, DataFrame] = {}

    def table(level: int) -> DataFrame:
        if level not in done:
            source = finer_level(level, levels, implied)
            keys = [d for d in dims if d in closure(levels[level], implied)] + list(extra_keys)
            if source is None:
                done[level] = df.groupBy(*keys).agg(*[c.alias(n) for n, c in sums.items()])
            else:
                done[level] = table(source).groupBy(*keys).agg(*[F.sum(n).alias(n) for n in sums])
        return done[level]

    types = dict(df.dtypes)
    parts = []
    for level, used in levels.items():
        own = [F.col(d) if d in used else F.lit(None).cast(types[d]).alias(d) for d in dims]
        parts.append(table(level).select(F.lit(level).alias("level"), *own, *extra_keys, *sums))
    return reduce(DataFrame.unionByName, parts)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """J4 join that keeps one copy of each key column."""
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                     *[c for c in right.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])


def rmse(y: str | Column, yhat: str | Column) -> Column:
    """sqrt(mean((y - yhat)^2)); pairs with a null are skipped."""
    y = F.col(y) if isinstance(y, str) else y
    yhat = F.col(yhat) if isinstance(yhat, str) else yhat
    return F.sqrt(F.avg(F.pow(y - yhat, 2)))


def level_sales_weight(panel: DataFrame, where: Column | None = None) -> DataFrame:
    """A5: each node's share of total sales over the weight period, / 12.

    The total is a scalar subquery (one aggregate row, inlined by the
    planner), not a cross join.
    """
    src = panel.where(where if where is not None else F.col("myfold") == "test")
    total = src.select(F.sum("sales")).scalar()
    nlev = len(LEVELS)
    return (level_aggregate(src, {"sales": F.sum("sales")})
            .withColumn("sales", F.coalesce("sales", F.lit(0.0)) / F.nullif(F.lit(float(nlev)) * total, F.lit(0.0))))


def level_rmse(df: DataFrame, y: str, yhat: str, out: str = "rmse",
               date_col: str = "date") -> DataFrame:
    """Two-stage level error.

    Stage 1 sums y and yhat per (node, date) up the hierarchy (all-null sums
    count as 0, as in pandas); stage 2 takes the RMSE over dates per node.
    """
    daily = level_aggregate(df, {"_y": F.sum(y), "_yhat": F.sum(yhat)}, extra_keys=[date_col])
    zero = F.lit(0.0)
    return daily.groupBy("level", *DIMS).agg(rmse(F.coalesce("_y", zero), F.coalesce("_yhat", zero)).alias(out))


def level_rmse_denom(panel: DataFrame) -> DataFrame:
    """Naive one-day-lag RMSE per node over training days from first sale."""
    src = panel.where((F.col("fold") == "train") & (F.col("date") >= F.col("min_date")))
    return level_rmse(src, "demand", "lagdemand", out="rmse_denom")


def help_table(panel: DataFrame) -> DataFrame:
    """The reference's ``df_help``: (level, dims, rmse_denom, sales weight)."""
    return null_safe_join(level_rmse_denom(panel), level_sales_weight(panel),
                          ["level", *DIMS], "left")


def wrmsse(holdout: DataFrame, helper: DataFrame, y: str = "demand", yhat: str = "yhat") -> DataFrame:
    """Per-node ``sales * rmse / rmse_denom``.

    Zero denominators give null (the reference would give infinity); they are
    skipped by the sums built on top.
    """
    err = level_rmse(holdout, y, yhat)
    return (null_safe_join(err, helper, ["level", *DIMS], "left")
            .withColumn("wrmsse", F.col("sales") * F.col("rmse") / F.nullif(F.col("rmse_denom"), F.lit(0.0))))


def wrmsse_by_level(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("level").agg(F.sum("wrmsse").alias("wrmsse"), F.count(F.lit(1)).alias("n_nodes"))


def wrmsse_total(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.sum("wrmsse").alias("wrmsse"), F.count(F.lit(1)).alias("n_nodes"))
