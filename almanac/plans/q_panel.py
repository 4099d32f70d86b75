"""Catalogue: panel construction, calendar and price queries (steps 1-2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.operators.calendar import enrich_calendar
from almanac.plans import panel as pl
from almanac.plans import sqlfrag as q
from almanac.plans.registry import ds, r6, register, sql_r6
from almanac.sources import fixtures as fx
from almanac.sources.tables import read_table



# --- panel_dense: P1, P2, J1, P11-P13, A1 -----------------------------------
@register("panel_dense", sql=f"""
WITH {q.PANEL[1:]}
SELECT id, item_id, dept_id, cat_id, store_id, state_id, d, CAST(date AS VARCHAR) AS date,
       demand, fold, myfold
FROM panel
""")
def panel_dense(spark, sf_dir):
    p = fx.sales_panel(spark, sf_dir)
    return p.select("id", *fx.HIERARCHY, "d", ds("date").alias("date"), "demand", "fold", "myfold")


# --- calendar_fill_distance: W1, W2, P5, P8 ---------------------------------
CAL_COLS = ["event_name", "event_type", "event", "next_event", "prev_event",
            "days_before_event", "days_after_event", "holiday_name", "holiday",
            "next_holiday", "prev_holiday", "days_before_holiday", "days_after_holiday",
            "snap_a", "snap_b", "snap_c", "weekday"]


@register("calendar_fill_distance", sql=f"""
WITH lspan AS (
  SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date
  FROM (SELECT CAST(min(l_shipdate) AS DATE) AS a, CAST(max(l_shipdate) AS DATE) AS b FROM lineitem)
), {q.raw_calendar_sql('lspan')[1:]}, {q.ENRICH[1:]}
SELECT CAST(date AS VARCHAR) AS date, CAST(wm_yr_wk AS VARCHAR) AS wm_yr_wk, {', '.join(CAL_COLS)}
FROM calendar
""")
def calendar_fill_distance(spark, sf_dir):
    """Calendar over the whole ship-date span of ``lineitem`` (grows with it)."""
    li = read_table(spark, sf_dir, "lineitem", ["l_shipdate"])
    dates = fx.calendar_from_span(F.min("l_shipdate").cast("date"), F.max("l_shipdate").cast("date"), li)
    cal = enrich_calendar(fx.raw_calendar(dates, fx.panel_spec(spark, sf_dir)))
    return cal.select(ds("date").alias("date"), ds("wm_yr_wk").alias("wm_yr_wk"), *CAL_COLS)


# --- price_ratio_8wk: W6, J2, W1 --------------------------------------------
@register("price_ratio_8wk", sql=f"""
WITH {q.KEYED[1:]}, {q.PRICES[1:]}
SELECT store_id, item_id, CAST(wm_yr_wk AS VARCHAR) AS wm_yr_wk,
       {sql_r6('sell_price')} AS sell_price,
       {sql_r6('price_ratio_to_8week_rolling')} AS price_ratio_to_8week_rolling
FROM prices
""")
def price_ratio_8wk(spark, sf_dir):
    p = pl.price_table(fx.daily_sales_table(spark, sf_dir), fx.panel_spec(spark, sf_dir))
    return p.select("store_id", "item_id", ds("wm_yr_wk").alias("wm_yr_wk"),
                    r6("sell_price").alias("sell_price"),
                    r6("price_ratio_to_8week_rolling").alias("price_ratio_to_8week_rolling"))


# --- panel_flags: P3-P7, P10, P12, F1-F4, F6, F7, F11 -----------------------
@register("panel_flags", sql=f"""
WITH {q.BASE_PANEL[1:]},
fl AS (
  SELECT *,
    (sell_price_isna = 1 OR COALESCE(holiday_name = 'Christmas', FALSE)) AS mask
  FROM bp
)
SELECT id, CAST(date AS VARCHAR) AS date, id_copy, snap, anydemand AS anydemand_raw,
       CASE WHEN NOT mask THEN demand END AS demand,
       CASE WHEN NOT mask THEN anydemand END AS anydemand,
       sell_price_isna, {sql_r6('sales')} AS sales, event, holiday,
       isodow(date) - 1 AS dayofweek, CAST(isodow(date) - 1 IN (5, 6) AS INTEGER) AS weekend,
       day(date) AS dayofmonth, dayofyear(date) AS dayofyear, week(date) AS week,
       month(date) AS month, year(date) AS year,
       CASE WHEN date < {q.UTIL_BEFORE} THEN 'util' ELSE myfold END AS myfold,
       CASE WHEN date < {q.UTIL_BEFORE} THEN 1 ELSE 0 END AS encode_flag,
       CASE WHEN fold = 'train' THEN 0 ELSE 1 END AS fold_num,
       substring(cat_id, 1, 1) AS cat_initial,
       CASE WHEN length(CAST(month(date) AS VARCHAR)) < 2 THEN lpad(CAST(month(date) AS VARCHAR), 2, '0')
            ELSE CAST(month(date) AS VARCHAR) END AS month_pad,
       CAST(date + 28 AS VARCHAR) AS date_plus_28,
       date_diff('day', {q.START}, date) AS days_since_start
FROM fl
""")
def panel_flags(spark, sf_dir):
    from almanac.functions import columns as fc
    spec = fx.panel_spec(spark, sf_dir)
    b = pl.base_panel(spark, sf_dir, spec).withColumn("anydemand_raw", F.col("anydemand"))
    b = fx.util_fold(pl.date_parts(pl.null_rules(b)), spec)
    return b.select(
        "id", ds("date").alias("date"), "id_copy", "snap", "anydemand_raw", "demand", "anydemand",
        "sell_price_isna", r6("sales").alias("sales"), "event", "holiday",
        "dayofweek", "weekend", "dayofmonth", "dayofyear", "week", "month", "year",
        "myfold", "encode_flag", "fold_num",
        fc.prefix("cat_id", 1).alias("cat_initial"),
        fc.zfill(F.col("month").cast("string"), 2).alias("month_pad"),
        ds(F.date_add("date", 28)).alias("date_plus_28"),
        F.datediff("date", F.to_date(F.lit(spec.start))).alias("days_since_start"))
