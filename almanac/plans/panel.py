"""Entry A: build the enriched panel and its feature tables.

Stages (each a DataFrame -> DataFrame step, no actions):

1. ``base_panel``: dense (series, day) panel + calendar (J1, broadcast: one
   row per day) + weekly prices (J2) + flags (P3-P7).
2. ``weighted_panel``: lag demand, first sale date, sales and RMSE weights
   (A10) as window aggregates over the series partitioning - the reference's
   aggregate-then-join-back (J3) without a second shuffle.
3. ``final_panel``: null rules (P10), per-series statistics (A2), date parts
   (F6), keep rule (P13).
4. ``ts_features`` / ``sameweekday_features``: W3-W5 and W7 in one window
   block each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almanac.operators import timeseries as ts
from almanac.operators.calendar import enrich_calendar
from almanac.sources import fixtures as fx

CAL_DROP = ["weekday", "month", "year", "event_name_1", "event_type_1", "event_name_2", "event_type_2"]


def calendar_table(spark: SparkSession, spec: fx.PanelSpec) -> DataFrame:
    return enrich_calendar(fx.raw_calendar(fx.calendar_dates(spark, spec), spec))


def price_table(daily: DataFrame, spec: fx.PanelSpec) -> DataFrame:
    """8-row rolling mean price (min_periods=1) and the ratio to it."""
    p = fx.weekly_prices(daily, spec).where(F.col("sell_price").isNotNull())
    w = Window.partitionBy("store_id", "item_id").orderBy("wm_yr_wk").rowsBetween(-7, 0)
    return p.withColumn("price_ratio_to_8week_rolling", F.col("sell_price") / F.nullif(F.avg("sell_price").over(w), F.lit(0.0)))


def prices_by_week(prices: DataFrame) -> DataFrame:
    """Per series: the first priced week, and one (sell_price, ratio) for each
    week from there on.  Prices are carried forward, so the weeks are gap-free;
    an array is bounded by the calendar span."""
    entry = F.struct("wm_yr_wk", F.struct("sell_price", "price_ratio_to_8week_rolling").alias("p"))
    return (prices.withColumn("id", fx.series_id(F.col("item_id"), F.col("store_id")))
            .groupBy("id").agg(F.array_sort(F.collect_list(entry)).alias("_w"))
            .select("id", F.col("_w")[0]["wm_yr_wk"].alias("first_week"), F.col("_w.p").alias("by_week")))


def base_panel(spark: SparkSession, sf_dir: str, spec: fx.PanelSpec | None = None,
               materialize: bool = True) -> DataFrame:
    """Dense panel + calendar + prices + flags.

    One pass over the fact table (``daily_sales_table``) beside its bounds; a
    day takes its price by position from the series' weeks, so the dense panel
    is never shuffled for the price join and leaves this step partitioned by
    ``id``.  The calendar (one row per day) is broadcast.
    """
    spec = spec or fx.panel_spec(spark, sf_dir)
    daily = fx.daily_sales_table(spark, sf_dir, materialize)
    prices = price_table(daily, spec)
    panel = fx.sales_panel(spark, sf_dir, spec, daily, weekly={"_price": prices_by_week(prices)})
    panel = panel.withColumns({"sell_price": F.col("_price.sell_price"),
                               "price_ratio_to_8week_rolling": F.col("_price.price_ratio_to_8week_rolling")}) \
        .drop("_price")
    cal = calendar_table(spark, spec).drop(*CAL_DROP)
    df = panel.join(F.broadcast(cal.drop("d")), "date", "left")
    return df.withColumns({
        # P4 tri-state indicator
        "anydemand": F.when(F.col("demand") > 0, 1).when(F.col("demand").isNotNull(), 0),
        # P5 null indicator
        "sell_price_isna": F.col("sell_price").isNull().cast("int"),
        # P6 null-safe product
        "sales": F.coalesce(F.col("demand") * F.col("sell_price"), F.lit(0.0)),
        # P7 own state's snap flag
        "snap": fx.snap_of_state(F.col("state_id")),
        # F1 strip last "_" token
        "id_copy": F.regexp_replace("id", "_[^_]*$", ""),
    }).drop("snap_a", "snap_b", "snap_c")


def weighted_panel(df: DataFrame) -> DataFrame:
    """A1/A10 weights as window aggregates over ``partitionBy(id)``."""
    w_all = Window.partitionBy("id")
    df = ts.with_day_number(df)
    df = df.withColumns({
        "min_date": F.min(F.when(F.col("anydemand") == 1, F.col("date"))).over(w_all),
        "weight_sales": F.sum(F.when(F.col("myfold") == "test", F.col("sales"))).over(w_all),
        "lagdemand": ts.lag_days("demand", 1),
    })
    in_train = (F.col("fold") == "train") & (F.col("date") >= F.col("min_date"))
    mse = F.avg(F.when(in_train, F.pow(F.col("demand") - F.col("lagdemand"), 2))).over(w_all)
    df = df.withColumn("weight_rmse", F.lit(1.0) / F.nullif(F.sqrt(mse), F.lit(0.0)))
    return df.withColumn("weight_all", F.col("weight_sales") * F.col("weight_rmse"))


def weighted_panel_table(spark: SparkSession, sf_dir: str, spec: fx.PanelSpec | None = None) -> DataFrame:
    """The weighted panel written once to the shared checkpoint folder, for
    plans that read it from several branches (help table, holdout, truth):
    the windows run once instead of once per branch, and a lost executor
    recomputes from the written table."""
    from almanac.session import cut_lineage
    return cut_lineage(weighted_panel(base_panel(spark, sf_dir, spec)), "weighted_panel")


def null_rules(df: DataFrame) -> DataFrame:
    """P10: no demand where there is no price, or on Christmas (null-safe mask)."""
    mask = (F.col("sell_price_isna") == 1) | F.coalesce(F.col("holiday_name") == "Christmas", F.lit(False))
    return df.withColumns({c: F.when(~mask, F.col(c)) for c in ("demand", "anydemand")})


def series_stats(df: DataFrame, col: str = "demand", by: str = "id") -> DataFrame:
    """A2 as windows over the series partitioning: mean, sd (ddof 1), median,
    q99 and IQR (exact percentiles, linear interpolation).  A series holds at
    most one row per day, so the exact percentile buffers are bounded."""
    w = Window.partitionBy(by)
    q = F.percentile(F.col(col), F.array(F.lit(0.25), F.lit(0.75), F.lit(0.99))).over(w)
    return (df.withColumn("_q", q)
            .withColumns({
                f"{col}_mean": F.avg(col).over(w),
                f"{col}_sd": F.stddev_samp(col).over(w),
                f"{col}_median": F.median(col).over(w),
                f"{col}_upperlimit": F.col("_q")[2],
                f"{col}_iqr": F.col("_q")[1] - F.col("_q")[0],
            }).drop("_q"))


def date_parts(df: DataFrame, date_col: str = "date") -> DataFrame:
    """Monday=0 weekday, weekend flag, day of month/year, ISO week, month, year."""
    d = F.col(date_col)
    return df.withColumns({
        "dayofweek": F.weekday(d),
        "weekend": F.weekday(d).isin(5, 6).cast("int"),
        "dayofmonth": F.dayofmonth(d),
        "dayofyear": F.dayofyear(d),
        "week": F.weekofyear(d),
        "month": F.month(d),
        "year": F.year(d),
    })


def final_panel(spark: SparkSession, sf_dir: str, spec: fx.PanelSpec | None = None,
                keep_rule: bool = True) -> DataFrame:
    df = weighted_panel(base_panel(spark, sf_dir, spec))
    df = date_parts(series_stats(null_rules(df)))
    if keep_rule:
        df = keep_final_rows(df)
    return df


def keep_final_rows(df: DataFrame) -> DataFrame:
    """Train rows with demand, or any test row."""
    return df.where(((F.col("fold") == "train") & F.col("demand").isNotNull()) | (F.col("fold") == "test"))


def ts_features(df: DataFrame) -> DataFrame:
    """The reference's ``df_tsfe``: lags 0-6 of demand and snap, rolling weeks.

    Expects ``_dayno`` (``with_day_number``) and ``snap``; keeps (id, date).
    """
    out = ts.add_rolling_weeks(ts.add_lags(df))
    feats = [c for c in out.columns if c.startswith(("demand_lag", "snap_lag"))
             or c.endswith("week")]
    return out.select("id", "date", *feats)


def sameweekday_features(df: DataFrame) -> DataFrame:
    """The reference's ``df_tsfe_sameweekday`` (W4 + strict W5)."""
    out = ts.add_samesnap(ts.add_sameweekday(df))
    feats = [c for c in out.columns if "_sameweekday" in c]
    return out.select("id", "date", *feats)


def feature_input(spark: SparkSession, sf_dir: str, spec: fx.PanelSpec | None = None) -> DataFrame:
    """Dense panel after the null rules, with weekday and day number: the
    input of every time-series feature (the reference computes its features
    on this, before dropping rows)."""
    df = null_rules(base_panel(spark, sf_dir, spec))
    df = df.select("id", *fx.HIERARCHY, "date", "fold", "myfold", "snap", "demand",
                   F.weekday("date").alias("dayofweek"))
    return ts.with_day_number(df)


STAT_NAMES = ("mean", "sd", "median", "upperlimit", "iqr")


def series_stats_table(df: DataFrame, col: str = "demand", by: str = "id") -> DataFrame:
    """A2 as one aggregate per series (the table the reference joins back)."""
    q = F.percentile(F.col(col), F.array(F.lit(0.25), F.lit(0.75), F.lit(0.99)))
    return (df.groupBy(by).agg(F.avg(col).alias(f"{col}_mean"), F.stddev_samp(col).alias(f"{col}_sd"),
                               F.median(col).alias(f"{col}_median"), q.alias("_q"))
            .withColumns({f"{col}_upperlimit": F.col("_q")[2],
                          f"{col}_iqr": F.col("_q")[1] - F.col("_q")[0]})
            .drop("_q"))


def rounded_stats(df: DataFrame, col: str = "demand") -> DataFrame:
    from almanac.plans.registry import r6
    return df.withColumns({f"{col}_{s}": r6(f"{col}_{s}") for s in STAT_NAMES})
