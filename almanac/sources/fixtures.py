"""Sales panel, calendar and weekly prices derived from the test tables.

The reference reads a wide daily sales sheet, a calendar and a weekly price
list.  Here the same three inputs are derived from ``lineitem`` joined with its
dimensions (FIXTURES.md section 2): a series is (item, store), a day's demand is
the shipped quantity.  All three are plain DataFrames; nothing is collected.

Scale notes
-----------
* The panel spans the whole shipdate range of the table, and a horizon of
  unknown days behind it.  The bounds are one aggregate of one column.
* ``nation``/``region`` are dimension tables with a fixed row count (25 / 5 by
  the schema's definition) and are broadcast explicitly.  ``part`` and
  ``supplier`` grow with the data; their join strategy is left to the planner
  (size-checked broadcast under ``autoBroadcastJoinThreshold``, else a
  shuffle join that AQE can still convert or split when skewed).
* The dense grid is produced per series: every sale day opens a run of days up
  to the day before the next sale, and all runs are expanded in one linear
  pass, so no cross join is needed and no group is larger than the calendar
  span.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almanac.sources.tables import read_table

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for equal results)
# ---------------------------------------------------------------------------
# Events whose second slot overrides the first one (event name and type).
EVENT2_OVERRIDES = ["Easter", "Cinco De Mayo"]
# Event names that count as holidays.
HOLIDAYS = ["ValentinesDay", "StPatricksDay", "Easter", "Mother's day", "Father's day",
            "IndependenceDay", "Halloween", "Thanksgiving", "Christmas", "NewYear"]

# ---------------------------------------------------------------------------
# Fixture rules of this repository (FIXTURES.md 2.4), not from the reference
# ---------------------------------------------------------------------------
# month-day -> (event_name_1, event_type_1)
EVENTS_BY_MONTH_DAY = {
    "01-01": ("NewYear", "National"),
    "02-14": ("ValentinesDay", "Cultural"),
    "03-17": ("StPatricksDay", "Cultural"),
    "07-04": ("IndependenceDay", "National"),
    "10-31": ("Halloween", "Cultural"),
    "11-11": ("VeteransDay", "National"),
    "12-25": ("Christmas", "National"),
}
ORTHODOX_EASTER_DATES = ["1995-04-23", "1996-04-14", "1997-04-27", "1998-04-19", "1999-04-11", "2000-04-30", "2001-04-15"]
EASTER_DATES = ["1995-04-16", "1996-04-07", "1997-03-30", "1998-04-12", "1999-04-04", "2000-04-23", "2001-04-15"]
# region name -> which snap flag applies to its stores
SNAP_FLAG_BY_STATE = {"AFRICA": "snap_a", "AMERICA": "snap_a", "ASIA": "snap_b",
                      "EUROPE": "snap_b", "MIDDLE EAST": "snap_c"}

HIERARCHY = ["item_id", "dept_id", "cat_id", "store_id", "state_id"]


HORIZON = 28      # unknown days behind the last known one, and days of the inner test
UTIL_DAYS = 182   # first days, burned for encoding (P12)


@dataclass(frozen=True)
class PanelSpec:
    """Date span and fold cuts of the panel (ISO dates; null without rows)."""

    start: str | None             # first ship date
    end: str | None               # last ship date + HORIZON
    test_start: str | None        # outer test: the appended days, demand unknown
    inner_test_start: str | None  # myfold = test: the last HORIZON known days
    util_before: str | None       # rows burned for encoding (P12)


def panel_spec(spark: SparkSession, sf_dir: str) -> PanelSpec:
    """The span of ``lineitem``'s ship dates with the horizon appended."""
    row = (read_table(spark, sf_dir, "lineitem", ["l_shipdate"])
           .agg(F.to_date(F.min("l_shipdate")).alias("lo"), F.to_date(F.max("l_shipdate")).alias("hi")).first())
    if row["lo"] is None:
        return PanelSpec(None, None, None, None, None)

    def day(base, days):
        return (base + _dt.timedelta(days=days)).isoformat()

    return PanelSpec(day(row["lo"], 0), day(row["hi"], HORIZON), day(row["hi"], 1), day(row["hi"], 1 - HORIZON), day(row["lo"], UTIL_DAYS))


def _d(s: str | None) -> Column:
    return F.to_date(F.lit(s))


def week_start(d: Column | str) -> Column:
    """Monday of the date's week (``date_trunc('week')`` without a detour
    through session-time-zone timestamps)."""
    d = F.col(d) if isinstance(d, str) else d
    return F.date_sub(d, F.weekday(d))


def keyed_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All line items that have a ship date, with their series dimensions.

    Columns: date, id, item_id, dept_id, cat_id, store_id, state_id,
    qty (DECIMAL(18,2)), price_sum (DECIMAL(18,2)).
    """
    li = (read_table(spark, sf_dir, "lineitem",
                     ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"])
          .where(F.col("l_shipdate").isNotNull()))
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_type", "p_size"])
    supp = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_nationkey"])
    geo = (read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"])
           .join(F.broadcast(read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])),
                 F.col("n_regionkey") == F.col("r_regionkey"))
           .select("n_nationkey", F.col("n_name").alias("store_id"), F.col("r_name").alias("state_id")))
    dept = F.concat(F.col("p_type"), F.lit("_"),
                    F.when(F.col("p_size") <= 25, F.lit("1")).otherwise(F.lit("2")))
    item = F.concat(dept, F.lit("_"), (F.col("p_partkey") % 2).cast("string"))
    out = (li.join(part, F.col("l_partkey") == F.col("p_partkey"))
           .join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
           .join(F.broadcast(geo), F.col("s_nationkey") == F.col("n_nationkey"))
           .select(F.to_date("l_shipdate").alias("date"),
                   item.alias("item_id"), dept.alias("dept_id"), F.col("p_type").alias("cat_id"),
                   "store_id", "state_id",
                   F.col("l_quantity").cast("decimal(18,2)").alias("qty"),
                   F.col("l_extendedprice").cast("decimal(18,2)").alias("price_sum")))
    return out.withColumn("id", series_id(F.col("item_id"), F.col("store_id")))


def series_id(item: Column, store: Column, suffix: str = "evaluation") -> Column:
    return F.concat(item, F.lit("_"), store, F.lit("_" + suffix))


def daily_sales(keyed: DataFrame) -> DataFrame:
    """A1: shipped quantity and value per (series, day); partial sums are
    combined map-side, so a hot series never reaches one task as raw rows.
    The hierarchy columns depend on the id only and ride along with first()."""
    return (keyed.groupBy("id", "date")
            .agg(*[F.first(c).alias(c) for c in HIERARCHY],
                 F.sum("qty").alias("qty"), F.sum("price_sum").alias("price_sum")))


def daily_sales_table(spark: SparkSession, sf_dir: str, materialize: bool = True) -> DataFrame:
    """The one pass over ``lineitem``: daily aggregates, written once to the
    shared checkpoint folder so that the panel, the prices and every other
    consumer read this (series x sale-day) table instead of re-scanning and
    re-joining the fact table."""
    from almanac.session import cut_lineage
    daily = daily_sales(keyed_lineitem(spark, sf_dir))
    return cut_lineage(daily, "daily_sales") if materialize else daily


def calendar_from_span(start: Column, end: Column, df: DataFrame) -> DataFrame:
    """One row per day between two date expressions evaluated over ``df``.

    ``df`` is aggregated to a single row (bounds), then exploded, so the
    calendar is derived from data on the executors.
    """
    bounds = df.agg(start.alias("_s"), end.alias("_e"))
    return bounds.select(F.explode(F.sequence("_s", "_e")).alias("date"))


def calendar_dates(spark: SparkSession, spec: PanelSpec) -> DataFrame:
    """The panel's calendar: every day of the span."""
    return spark.range(1).select(F.explode(F.sequence(_d(spec.start), _d(spec.end))).alias("date"))


def raw_calendar(dates: DataFrame, spec: PanelSpec) -> DataFrame:
    """Calendar sheet columns before enrichment (the reference's calendar.csv).

    Columns: date, d, wm_yr_wk (Monday of the week), weekday, month, year,
    event_name_1, event_type_1, event_name_2, event_type_2, snap_a/b/c.
    """
    md = F.date_format("date", "MM-dd")
    name1 = F.lit(None).cast("string")
    type1 = F.lit(None).cast("string")
    for k, (n, t) in EVENTS_BY_MONTH_DAY.items():
        name1 = F.when(md == k, F.lit(n)).otherwise(name1)
        type1 = F.when(md == k, F.lit(t)).otherwise(type1)
    is_orth = F.col("date").isin([F.to_date(F.lit(x)) for x in ORTHODOX_EASTER_DATES])
    name1 = F.when(is_orth, F.lit("OrthodoxEaster")).otherwise(name1)
    type1 = F.when(is_orth, F.lit("Religious")).otherwise(type1)
    is_easter = F.col("date").isin([F.to_date(F.lit(x)) for x in EASTER_DATES])
    dom = F.dayofmonth("date")
    return dates.select(
        "date",
        F.concat(F.lit("d_"), (F.datediff("date", _d(spec.start)) + 1).cast("string")).alias("d"),
        week_start("date").alias("wm_yr_wk"),
        F.weekday("date").alias("weekday"),
        F.month("date").alias("month"),
        F.year("date").alias("year"),
        name1.alias("event_name_1"), type1.alias("event_type_1"),
        F.when(is_easter, F.lit("Easter")).alias("event_name_2"),
        F.when(is_easter, F.lit("Cultural")).alias("event_type_2"),
        (dom <= 10).cast("int").alias("snap_a"),
        ((dom % 2 == 1) & (dom <= 15)).cast("int").alias("snap_b"),
        dom.between(5, 14).cast("int").alias("snap_c"),
    )


def weekly_prices(daily: DataFrame, spec: PanelSpec) -> DataFrame:
    """Average unit price per (store, item, week), dense over the weeks of the
    window and carried forward (W1); null before a series' first sale.

    The quotient of the two decimal sums is left unrounded.  Built from the
    daily aggregate (already one row per series and day), so the price table
    costs a shuffle of (series x weeks) rows, not of line items.
    """
    wk = (daily.withColumn("wm_yr_wk", week_start("date"))
          .groupBy("store_id", "item_id", "wm_yr_wk")
          .agg(F.sum("price_sum").alias("_p"), F.sum("qty").alias("_q"))
          .select("store_id", "item_id", "wm_yr_wk",
                  (F.col("_p").cast("double") / F.nullif(F.col("_q").cast("double"), F.lit(0.0)))
                  .alias("_price")))
    first_wk = week_start(_d(spec.start))
    last_wk = week_start(_d(spec.end))
    grid = (daily.select("store_id", "item_id").distinct()
            .select("store_id", "item_id",
                    F.explode(F.sequence(first_wk, last_wk, F.expr("INTERVAL 7 DAYS"))).alias("wm_yr_wk")))
    w = (Window.partitionBy("store_id", "item_id").orderBy("wm_yr_wk")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (grid.join(wk, ["store_id", "item_id", "wm_yr_wk"], "left")
            .withColumn("sell_price", F.last("_price", ignorenulls=True).over(w))
            .drop("_price"))


def sales_panel(spark: SparkSession, sf_dir: str, spec: PanelSpec | None = None,
                daily: DataFrame | None = None, weekly: dict[str, DataFrame] | None = None) -> DataFrame:
    """P1 + P2 + J3: the long panel, one row per (series, day) of the span.

    Each series' sale days (at most one per calendar day, so bounded by the
    span, not by the data volume) are sorted; each opens a run of days that
    ends before the next one, and ``inline`` expands all runs: linear in the
    number of days.  No join against a separate grid: the panel leaves this
    step hash-partitioned by ``id``, which every later series window reuses
    without another shuffle.

    ``weekly`` = {name: table keyed by id with columns ``first_week`` and
    ``by_week``, an array with one entry for each week from there on}: a day
    takes the entry of its week by position.

    demand is 0 on known days without shipments and null in the appended
    horizon.  Columns: id, hierarchy, d, date, demand, fold, myfold (+ weekly
    values).
    """
    spec = spec or panel_spec(spark, sf_dir)
    daily = daily if daily is not None else daily_sales_table(spark, sf_dir)
    per = (daily.groupBy("id")
           .agg(*[F.first(c).alias(c) for c in HIERARCHY],
                F.array_sort(F.collect_list(F.struct("date", "qty"))).alias("_sales")))
    weekly = weekly or {}
    for name, tbl in weekly.items():
        per = per.join(tbl.select("id", F.col("first_week").alias(f"_f_{name}"), F.col("by_week").alias(f"_a_{name}")), "id", "left")
    start, end = _d(spec.start), _d(spec.end)
    # a first run without a sale, where the series starts later than the span
    lead_in = F.when(F.col("_sales")[0]["date"] > start, F.array(F.struct(start.alias("date"), F.lit(0).cast("decimal(28,2)").alias("qty"))))
    per = per.withColumn("_sales", F.transform("_sales", lambda s: F.struct(s["date"].alias("date"), s["qty"].cast("decimal(28,2)").alias("qty"))))
    per = per.withColumn("_sales", F.concat(F.coalesce(lead_in, F.slice("_sales", 1, 0)), F.col("_sales")))

    def day(d, sale):
        fields = [d.alias("date"), F.when(d == sale["date"], sale["qty"]).alias("_q")]
        for name in weekly:
            week = F.floor(F.datediff(d, F.col(f"_f_{name}")) / 7).cast("int")
            fields.append(F.get(F.col(f"_a_{name}"), week).alias(name))
        return F.struct(*fields)

    def run(sale, k):
        after = F.coalesce(F.date_sub(F.get(F.col("_sales"), k + 1)["date"], 1), end)
        return F.transform(F.sequence(sale["date"], after), lambda d: day(d, sale))

    grid = per.select("id", *HIERARCHY, F.inline(F.flatten(F.transform("_sales", run))))
    known = F.col("date") < _d(spec.test_start)
    panel = grid.select(
        "id", *HIERARCHY,
        F.concat(F.lit("d_"), (F.datediff("date", start) + 1).cast("string")).alias("d"),
        "date",
        F.when(known, F.coalesce(F.col("_q"), F.lit(0)).cast("double")).alias("demand"),
        *weekly)
    return add_folds(panel, spec)


def add_folds(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Fold (train/test) and myfold (train/test/null) by date cut."""
    return df.withColumns({
        "fold": F.when(F.col("date") >= _d(spec.test_start), "test").otherwise("train"),
        "myfold": F.when(F.col("date") >= _d(spec.test_start), F.lit(None).cast("string"))
                   .when(F.col("date") >= _d(spec.inner_test_start), "test").otherwise("train"),
    })


def util_fold(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Burn early rows for encoding (myfold 'util') and map folds to flags."""
    util = F.when(F.col("date") < _d(spec.util_before), F.lit("util")).otherwise(F.col("myfold"))
    return (df.withColumn("myfold", util)
            .withColumn("encode_flag", F.when(F.col("myfold") == "util", 1).otherwise(0))
            .withColumn("fold_num", F.when(F.col("fold") == "train", 0).otherwise(1)))


def snap_of_state(state: Column) -> Column:
    """The snap flag of a row's own state (three flags -> one)."""
    out = F.lit(None).cast("int")
    for st, flag in SNAP_FLAG_BY_STATE.items():
        out = F.when(state == st, F.col(flag)).otherwise(out)
    return out
