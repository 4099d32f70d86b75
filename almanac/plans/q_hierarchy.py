"""Catalogue: hierarchy levels, weights, WRMSSE, submission and holdout (steps 4-5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.operators import hierarchy as hy
from almanac.plans import forecast as fc
from almanac.plans import panel as pl
from almanac.plans import sqlfrag as q
from almanac.plans.registry import register, rounded, sql_r6
from almanac.sources import fixtures as fx

DIMS = ", ".join(hy.DIMS)


def _wp(spark, sf_dir):
    return pl.weighted_panel_table(spark, sf_dir)


def help_ctes() -> str:
    """Oracle CTEs sw (sales weight), dn (rmse denominator), help."""
    return f"""
sw_src AS (SELECT * FROM wp WHERE myfold = 'test'),
sw AS ({q.level_union('sw_src', "COALESCE(SUM(sales), 0) / (12 * (SELECT SUM(sales) FROM sw_src)) AS sales")}),
dn_src AS (SELECT * FROM wp WHERE fold = 'train' AND date >= min_date),
dd AS ({q.level_union('dn_src', "COALESCE(SUM(demand), 0) AS y, COALESCE(SUM(lagdemand), 0) AS yh", ['date'])}),
dn AS (SELECT level, {DIMS}, sqrt(avg(pow(y - yh, 2))) AS rmse_denom FROM dd GROUP BY level, {DIMS}),
help AS (SELECT dn.*, sw.sales FROM dn LEFT JOIN sw ON {q.ns_join('dn', 'sw')})"""


def nodes_ctes(hold: str) -> str:
    """Oracle CTEs ld/lr (level RMSE of a holdout CTE) and nodes (per-node WRMSSE)."""
    return f"""
ld AS ({q.level_union(hold, "COALESCE(SUM(demand), 0) AS y, COALESCE(SUM(yhat), 0) AS yh", ['date'])}),
lr AS (SELECT level, {DIMS}, sqrt(avg(pow(y - yh, 2))) AS rmse FROM ld GROUP BY level, {DIMS}),
nodes AS (
  SELECT lr.*, help.rmse_denom, help.sales,
         help.sales * lr.rmse / NULLIF(help.rmse_denom, 0) AS wrmsse
  FROM lr LEFT JOIN help ON {q.ns_join('lr', 'help')}
)"""


HOLD = f"""
ho AS (SELECT *, lag(demand, 28) OVER (PARTITION BY id ORDER BY date) AS yhat FROM wp),
hold AS (SELECT * FROM ho WHERE myfold = 'test')"""


# --- level_sums_12: A3, A4, U2 ----------------------------------------------
@register("level_sums_12", sql=f"""
WITH {q.WEIGHTED_PANEL[1:]},
lv AS ({q.level_union('wp', "COALESCE(SUM(demand), 0) AS demand, SUM(sales) AS sales, COUNT(*) AS n_rows")})
SELECT level, {DIMS}, {sql_r6('demand')} AS demand, {sql_r6('sales')} AS sales, n_rows FROM lv
""")
def level_sums_12(spark, sf_dir):
    wp = _wp(spark, sf_dir)
    out = hy.level_aggregate(wp, {"demand": F.sum("demand"), "sales": F.sum("sales"), "n_rows": F.count(F.lit(1))})
    return rounded(out.withColumn("demand", F.coalesce("demand", F.lit(0.0))), ["demand", "sales"])


# --- level_sales_weight: A3, A5 ---------------------------------------------
@register("level_sales_weight", sql=f"""
WITH {q.WEIGHTED_PANEL[1:]}, {help_ctes()[1:]}
SELECT level, {DIMS}, {sql_r6('sales')} AS sales FROM sw
""")
def level_sales_weight(spark, sf_dir):
    return rounded(hy.level_sales_weight(_wp(spark, sf_dir)), ["sales"])


# --- level_rmse_denom: A7 ---------------------------------------------------
@register("level_rmse_denom", sql=f"""
WITH {q.WEIGHTED_PANEL[1:]}, {help_ctes()[1:]}
SELECT level, {DIMS}, {sql_r6('rmse_denom')} AS rmse_denom FROM dn
""")
def level_rmse_denom(spark, sf_dir):
    return rounded(hy.level_rmse_denom(_wp(spark, sf_dir)), ["rmse_denom"])


# --- series_rmse_weight: A10, P28 -------------------------------------------
@register("series_rmse_weight", sql=f"""
WITH {q.WEIGHTED_PANEL[1:]},
sw1 AS (SELECT DISTINCT id, weight_sales, weight_rmse, weight_sales * weight_rmse AS weight_all FROM wp)
SELECT id, {sql_r6('weight_sales')} AS weight_sales, {sql_r6('weight_rmse')} AS weight_rmse,
       {sql_r6('weight_all')} AS weight_all,
       {sql_r6('weight_rmse / (SELECT min(weight_rmse) FROM sw1)')} AS weight_rmse_norm,
       {sql_r6('sqrt(weight_sales)')} AS weight_sales_sqrt
FROM sw1
""")
def series_rmse_weight(spark, sf_dir):
    per = (_wp(spark, sf_dir).groupBy("id")
           .agg(F.first("weight_sales").alias("weight_sales"), F.first("weight_rmse").alias("weight_rmse"),
                F.first("weight_all").alias("weight_all")))
    lo = per.select(F.min("weight_rmse")).scalar()
    out = per.withColumns({"weight_rmse_norm": F.col("weight_rmse") / lo,
                           "weight_sales_sqrt": F.sqrt("weight_sales")})
    return rounded(out)


# --- wrmsse_by_level / wrmsse_total: A6, A8, A9, J4 --------------------------
@register("wrmsse_by_level", sql=f"""
WITH {q.WEIGHTED_PANEL[1:]}, {help_ctes()[1:]}, {HOLD[1:]}, {nodes_ctes('hold')[1:]}
SELECT level, {sql_r6('sum(wrmsse)')} AS wrmsse, COUNT(*) AS n_nodes FROM nodes GROUP BY level
""")
def wrmsse_by_level(spark, sf_dir):
    wp = _wp(spark, sf_dir)
    nodes = hy.wrmsse(fc.naive_forecast(wp).where(F.col("myfold") == "test"), hy.help_table(wp))
    return rounded(hy.wrmsse_by_level(nodes), ["wrmsse"])


@register("wrmsse_total", sql=f"""
WITH {q.WEIGHTED_PANEL[1:]}, {help_ctes()[1:]}, {HOLD[1:]}, {nodes_ctes('hold')[1:]}
SELECT {sql_r6('sum(wrmsse)')} AS wrmsse, COUNT(*) AS n_nodes FROM nodes
""")
def wrmsse_total(spark, sf_dir):
    wp = _wp(spark, sf_dir)
    nodes = hy.wrmsse(fc.naive_forecast(wp).where(F.col("myfold") == "test"), hy.help_table(wp))
    return rounded(hy.wrmsse_total(nodes), ["wrmsse"])


# --- submission_pivot: A23, U3, J11, P18, P20 -------------------------------
_FCOLS = ", ".join(f"COALESCE(max(CASE WHEN k = {i} THEN round_even(yhat, 5) END), 0) AS F{i}" for i in range(1, 29))


@register("submission_pivot", sql=f"""
WITH {q.BASE_PANEL[1:]},
fpn AS (
  SELECT id, date, fold, sell_price_isna,
         CASE WHEN NOT (sell_price_isna = 1 OR COALESCE(holiday_name = 'Christmas', FALSE)) THEN demand END AS demand
  FROM bp
),
pr AS (
  SELECT id, date, fold, sell_price_isna,
         lag(demand, 28) OVER (PARTITION BY id ORDER BY date) AS yraw
  FROM fpn
),
t AS (
  SELECT id, date_diff('day', {q.TEST_START}, date) + 1 AS k,
         CASE WHEN sell_price_isna = 1 OR yraw < 0 THEN 0.0001 ELSE yraw END AS yhat
  FROM pr WHERE fold = 'test'
),
wide AS (SELECT id, {_FCOLS} FROM t GROUP BY id),
both_ids AS (
  SELECT id, {', '.join(f'F{i}' for i in range(1, 29))} FROM wide
  UNION ALL
  SELECT replace(id, 'evaluation', 'validation') AS id, {', '.join(f'F{i}' for i in range(1, 29))} FROM wide
),
tmpl AS (
  SELECT id FROM series UNION ALL SELECT regexp_replace(id, 'evaluation$', 'validation') FROM series
)
SELECT tmpl.id, {', '.join(f'COALESCE(F{i}, 0) AS F{i}' for i in range(1, 29))}
FROM tmpl LEFT JOIN both_ids USING (id)
""")
def submission_pivot(spark, sf_dir):
    b = pl.null_rules(pl.base_panel(spark, sf_dir))
    pred = fc.naive_forecast(b).where(F.col("fold") == "test")
    pred = pred.withColumn("yhat", fc.floor_prediction(F.col("yhat"), F.col("sell_price_isna")))
    series = b.select("id").distinct()
    return fc.to_submission(pred, fx.panel_spec(spark, sf_dir).test_start, template=fc.id_template(series))


# --- holdout_eval: E22, S3, S4 ----------------------------------------------
@register("holdout_eval", sql=f"""
WITH {q.WEIGHTED_PANEL[1:]}, {help_ctes()[1:]}, {HOLD[1:]},
subm AS (
  SELECT regexp_replace(id, 'evaluation', 'validation') AS id, date, round_even(yhat, 5) AS yhat FROM hold
),
hl AS (
  SELECT regexp_replace(s.id, '_[^_]*$', '') AS id_copy, s.date, s.yhat
  FROM subm s WHERE COALESCE(s.yhat, 0) <> 0
),
ho2 AS (
  SELECT hl.yhat, w.demand, w.date, {', '.join('w.' + d for d in hy.DIMS)}
  FROM hl LEFT JOIN wp w ON w.id_copy = hl.id_copy AND w.date = hl.date
), {nodes_ctes('ho2')[1:]}
SELECT {sql_r6('sqrt(avg(pow(yhat - demand, 2)))')} AS rmse, {sql_r6('avg(yhat)')} AS yhat_mean,
       {sql_r6('avg(demand)')} AS demand_mean, {sql_r6('avg(demand) / avg(yhat)')} AS ratio,
       COUNT(*) AS n_rows, (SELECT {sql_r6('sum(wrmsse)')} FROM nodes) AS wrmsse
FROM ho2
""")
def holdout_eval(spark, sf_dir):
    return rounded(fc.holdout_eval(spark, sf_dir))
