"""Catalogue: series statistics and time-series features (step 3)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from almanac.operators import timeseries as ts
from almanac.plans import panel as pl
from almanac.plans import sqlfrag as q
from almanac.plans.registry import ds, r6, register, sql_r6
from almanac.sources import fixtures as fx
from almanac.sources.tables import read_table



# --- first_sale_date: A1, J3 ------------------------------------------------
@register("first_sale_date", sql=f"""
WITH {q.BASE_PANEL[1:]}
SELECT id, CAST(min(CASE WHEN anydemand = 1 THEN date END) AS VARCHAR) AS min_date,
       {sql_r6("sum(CASE WHEN myfold = 'test' THEN sales END)")} AS weight_sales,
       CAST(sum(anydemand) AS BIGINT) AS n_sale_days
FROM bp GROUP BY id
""")
def first_sale_date(spark, sf_dir):
    b = pl.base_panel(spark, sf_dir)
    return b.groupBy("id").agg(
        ds(F.min(F.when(F.col("anydemand") == 1, F.col("date")))).alias("min_date"),
        r6(F.sum(F.when(F.col("myfold") == "test", F.col("sales")))).alias("weight_sales"),
        F.sum("anydemand").cast("long").alias("n_sale_days"))


# --- series_stats: A2 -------------------------------------------------------
@register("series_stats", sql=f"""
WITH {q.FEATURE_PANEL[1:]}
SELECT id, {sql_r6('avg(demand)')} AS demand_mean, {sql_r6('stddev_samp(demand)')} AS demand_sd,
       {sql_r6('median(demand)')} AS demand_median,
       {sql_r6('quantile_cont(demand, 0.99)')} AS demand_upperlimit,
       {sql_r6('quantile_cont(demand, 0.75) - quantile_cont(demand, 0.25)')} AS demand_iqr
FROM fp GROUP BY id
""")
def series_stats(spark, sf_dir):
    df = pl.feature_input(spark, sf_dir)
    return pl.rounded_stats(pl.series_stats_table(df, "demand", "id"))


# --- lags_0_6: J5, W7 -------------------------------------------------------
_LAG_SQL = ", ".join(
    f"{c} AS {c}_lag0" if k == 0 else f"lag({c}, {k}) OVER (PARTITION BY id ORDER BY date) AS {c}_lag{k}"
    for c in ("demand", "snap") for k in range(7))


@register("lags_0_6", sql=f"""
WITH {q.FEATURE_PANEL[1:]}
SELECT id, CAST(date AS VARCHAR) AS date, {_LAG_SQL} FROM fp
""")
def lags_0_6(spark, sf_dir):
    f = pl.feature_input(spark, sf_dir)
    out = ts.add_lags(f, ("demand", "snap"), range(7))
    return out.select("id", ds("date").alias("date"),
                      *[f"{c}_lag{k}" for c in ("demand", "snap") for k in range(7)])


# --- rolling_weeks: W3 ------------------------------------------------------
def _roll_sql(col, agg, days, part="id"):
    fn = {"mean": "avg", "max": "max", "min": "min"}[agg]
    return (f"{fn}({col}) OVER (PARTITION BY {part} ORDER BY date "
            f"RANGE BETWEEN INTERVAL {days - 1} DAY PRECEDING AND CURRENT ROW)")


_ROLL = [("demand", a, w) for w in (1, 2, 4, 12, 48) for a in ("mean", "max", "min")] + \
        [("snap", "mean", 1), ("snap", "mean", 2)]


@register("rolling_weeks", sql=f"""
WITH {q.FEATURE_PANEL[1:]}
SELECT id, CAST(date AS VARCHAR) AS date,
       {', '.join(f"{sql_r6(_roll_sql(c, a, 7 * w))} AS {c}_{a}{w}week" for c, a, w in _ROLL)}
FROM fp
""")
def rolling_weeks(spark, sf_dir):
    f = pl.feature_input(spark, sf_dir)
    out = ts.add_rolling_weeks(f)
    cols = [f"{c}_{a}{w}week" for c, a, w in _ROLL]
    return out.select("id", ds("date").alias("date"), *[r6(c).alias(c) for c in cols])


# --- rolling_sameweekday: W4 ------------------------------------------------
_SWD = [(a, w) for w in (2, 4, 12, 48) for a in ("mean", "max", "min")]


@register("rolling_sameweekday", sql=f"""
WITH {q.FEATURE_PANEL[1:]}
SELECT id, CAST(date AS VARCHAR) AS date,
       {', '.join(f"{sql_r6(_roll_sql('demand', a, 7 * w, 'id, dayofweek'))} AS demand_{a}{w}week_sameweekday" for a, w in _SWD)}
FROM fp
""")
def rolling_sameweekday(spark, sf_dir):
    f = pl.feature_input(spark, sf_dir)
    out = ts.add_sameweekday(f)
    cols = [f"demand_{a}{w}week_sameweekday" for a, w in _SWD]
    return out.select("id", ds("date").alias("date"), *[r6(c).alias(c) for c in cols])


# --- rolling_samesnap: W5, P19 ----------------------------------------------
def _snap_sql(w, s):
    m = (f"avg(demand) OVER (PARTITION BY id, dayofweek, snap ORDER BY date "
         f"ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)")
    return f"{sql_r6(f'CASE WHEN snap = {s} THEN {m} END')} AS demand_mean{w}week_sameweekday_samesnap{s}"


@register("rolling_samesnap", sql=f"""
WITH {q.FEATURE_PANEL[1:]}
SELECT id, CAST(date AS VARCHAR) AS date, snap,
       {', '.join(_snap_sql(w, s) for w in (2, 4, 12, 48) for s in (0, 1))}
FROM fp
""")
def rolling_samesnap(spark, sf_dir):
    f = pl.feature_input(spark, sf_dir)
    out = ts.add_samesnap(f)
    cols = [f"demand_mean{w}week_sameweekday_samesnap{s}" for w in (2, 4, 12, 48) for s in (0, 1)]
    return out.select("id", ds("date").alias("date"), "snap", *[r6(c).alias(c) for c in cols])


# --- horizon_join: J6-J8, P19, P13 ------------------------------------------
H = 28
HW = ts.week_rounded(H)


@register("horizon_join", sql=f"""
WITH {q.FEATURE_PANEL[1:]},
f1 AS (
  SELECT *,
    {_roll_sql('demand', 'mean', 7)} AS demand_mean1week,
    {_roll_sql('demand', 'mean', 28)} AS demand_mean4week,
    {_roll_sql('demand', 'max', 28, 'id, dayofweek')} AS demand_max4week_sameweekday,
    CASE WHEN snap = 0 THEN avg(demand) OVER (PARTITION BY id, dayofweek, snap ORDER BY date
         ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) END AS s0,
    CASE WHEN snap = 1 THEN avg(demand) OVER (PARTITION BY id, dayofweek, snap ORDER BY date
         ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) END AS s1
  FROM fp
),
f2 AS (
  SELECT id, date, fold, demand, snap,
    lag(demand, {H}) OVER (PARTITION BY id ORDER BY date) AS demand_lag0,
    lag(demand_mean1week, {H}) OVER (PARTITION BY id ORDER BY date) AS demand_mean1week,
    lag(demand_mean4week, {H}) OVER (PARTITION BY id ORDER BY date) AS demand_mean4week,
    lag(demand_max4week_sameweekday, {HW}) OVER (PARTITION BY id ORDER BY date) AS demand_max4week_sameweekday,
    lag(s0, {HW}) OVER (PARTITION BY id ORDER BY date) AS s0,
    lag(s1, {HW}) OVER (PARTITION BY id ORDER BY date) AS s1
  FROM f1
)
SELECT id, CAST(date AS VARCHAR) AS date, demand, snap,
       {sql_r6('demand_lag0')} AS demand_lag0, {sql_r6('demand_mean1week')} AS demand_mean1week,
       {sql_r6('demand_mean4week')} AS demand_mean4week,
       {sql_r6('demand_max4week_sameweekday')} AS demand_max4week_sameweekday,
       {sql_r6('CASE WHEN snap = 0 THEN s0 ELSE s1 END')} AS demand_mean4week_sameweekday_samesnap
FROM f2
WHERE (fold = 'train' AND demand IS NOT NULL) OR fold = 'test'
""")
def horizon_join(spark, sf_dir):
    """Features known ``H`` days before the target day, joined to it.

    Horizon-free features are computed once; the shift is a ``lag`` in the same
    series partitioning (no join, no extra shuffle).  Same-weekday features move
    by whole weeks; the same-snap mean is picked by the target day's flag.
    """
    f = pl.feature_input(spark, sf_dir)
    f = ts.add_rolling_weeks(f, {"demand": {1: ("mean",), 4: ("mean",)}})
    f = ts.add_sameweekday(f, weeks=(4,), aggs=("max",))
    f = ts.add_samesnap(f, weeks=(4,))
    f = f.withColumn("demand_lag0", F.col("demand"))
    f = ts.shift_forward(f, H, ["demand_lag0", "demand_mean1week", "demand_mean4week"])
    stem = "demand_mean4week_sameweekday_samesnap"
    f = ts.shift_forward(f, HW, ["demand_max4week_sameweekday", f"{stem}0", f"{stem}1"])
    f = ts.pick_by_flag(pl.keep_final_rows(f), stem)
    return f.select("id", ds("date").alias("date"), "demand", "snap",
                    *[r6(c).alias(c) for c in ("demand_lag0", "demand_mean1week", "demand_mean4week",
                                                "demand_max4week_sameweekday", stem)])


# --- events on a regular grid: W13, W14 -------------------------------------
_HOURLY = """
h AS (SELECT event_type, date_trunc('hour', ts) AS slot, sum(value) AS value FROM events GROUP BY ALL),
grid AS (
  SELECT k.event_type, unnest(generate_series((SELECT min(slot) FROM h), (SELECT max(slot) FROM h),
                                              INTERVAL 1 HOUR)) AS slot
  FROM (SELECT DISTINCT event_type FROM h) k
),
g AS (SELECT grid.event_type, grid.slot, h.value FROM grid LEFT JOIN h USING (event_type, slot))"""


def _hr(lo, hi):
    a = f"INTERVAL {lo} HOUR PRECEDING" if lo > 0 else ("CURRENT ROW" if lo == 0 else f"INTERVAL {-lo} HOUR FOLLOWING")
    b = "CURRENT ROW" if hi == 0 else f"INTERVAL {hi} HOUR FOLLOWING"
    return f"avg(value) OVER (PARTITION BY event_type ORDER BY slot RANGE BETWEEN {a} AND {b})"


def _hourly(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events", ["event_type", "ts", "value"])
    g = ts.regular_grid(ev, "event_type", "ts", "value", step="hour", agg="sum")
    return g.withColumn("_step", ts.step_number(F.col("slot"), "hour"))


def _hw(lo, hi):
    return Window.partitionBy("event_type").orderBy("_step").rangeBetween(lo, hi)


@register("regularise_roll_backward", sql=f"""
WITH {_HOURLY[1:]}
SELECT event_type, strftime(slot, '%Y-%m-%d %H:%M:%S') AS slot, {sql_r6('value')} AS value,
       {sql_r6(_hr(2, 0))} AS roll_backward_3h
FROM g
""")
def regularise_roll_backward(spark, sf_dir):
    g = _hourly(spark, sf_dir)
    return g.select("event_type", F.date_format("slot", "yyyy-MM-dd HH:mm:ss").alias("slot"),
                    r6("value").alias("value"), r6(F.avg("value").over(_hw(-2, 0))).alias("roll_backward_3h"))


@register("roll_forward_incl_excl", sql=f"""
WITH {_HOURLY[1:]}
SELECT event_type, strftime(slot, '%Y-%m-%d %H:%M:%S') AS slot,
       {sql_r6(_hr(0, 2))} AS roll_forward_inclusive, {sql_r6(_hr(-1, 3))} AS roll_forward_exclusive
FROM g
""")
def roll_forward_incl_excl(spark, sf_dir):
    g = _hourly(spark, sf_dir)
    return g.select("event_type", F.date_format("slot", "yyyy-MM-dd HH:mm:ss").alias("slot"),
                    r6(F.avg("value").over(_hw(0, 2))).alias("roll_forward_inclusive"),
                    r6(F.avg("value").over(_hw(1, 3))).alias("roll_forward_exclusive"))


# --- daily grid: W15, W16 ---------------------------------------------------
_DAILY = """
dd AS (SELECT event_type, CAST(ts AS DATE) AS slot, sum(value) AS value FROM events GROUP BY ALL),
grid AS (
  SELECT k.event_type, CAST(unnest(generate_series((SELECT min(slot) FROM dd), (SELECT max(slot) FROM dd),
                                                   INTERVAL 1 DAY)) AS DATE) AS slot
  FROM (SELECT DISTINCT event_type FROM dd) k
),
g AS (SELECT grid.event_type, grid.slot, dd.value FROM grid LEFT JOIN dd USING (event_type, slot))"""


def _daily(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events", ["event_type", "ts", "value"])
    return ts.regular_grid(ev, "event_type", "ts", "value", step="day", agg="sum")


@register("weekly_anchor_roll", sql=f"""
WITH {_DAILY[1:]}
SELECT event_type, CAST(slot AS VARCHAR) AS slot, {sql_r6('value')} AS value,
       {sql_r6('avg(value) OVER (PARTITION BY event_type ORDER BY slot ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)')} AS prev3_mean
FROM g WHERE isodow(slot) = 1
""")
def weekly_anchor_roll(spark, sf_dir):
    """Monday-anchored weekly series, mean of the previous three weeks."""
    g = _daily(spark, sf_dir).where(F.weekday("slot") == 0)
    w = Window.partitionBy("event_type").orderBy("slot").rowsBetween(-3, -1)
    return g.select("event_type", ds("slot").alias("slot"), r6("value").alias("value"),
                    r6(F.avg("value").over(w)).alias("prev3_mean"))


@register("weekday_lag_roll", sql=f"""
WITH {_DAILY[1:]}
SELECT event_type, CAST(slot AS VARCHAR) AS slot,
       {sql_r6('avg(value) OVER (PARTITION BY event_type, isodow(slot) ORDER BY slot ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)')} AS sameweekday_prev3_mean
FROM g
""")
def weekday_lag_roll(spark, sf_dir):
    """Mean of the values 7, 14 and 21 days earlier (same weekday)."""
    g = _daily(spark, sf_dir)
    w = Window.partitionBy("event_type", F.weekday("slot")).orderBy("slot").rowsBetween(-3, -1)
    return g.select("event_type", ds("slot").alias("slot"),
                    r6(F.avg("value").over(w)).alias("sameweekday_prev3_mean"))
