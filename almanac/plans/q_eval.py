"""Catalogue: univariate importance and evaluation tables (step 8) and the
forecast summaries of step 5 (E1-E13, E15, E21, A13, A30, W12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.operators import evaluation as ev
from almanac.operators import stats as st
from almanac.plans import forecast as fc
from almanac.plans import panel as pl
from almanac.plans import sqlfrag as q
from almanac.plans.q_hierarchy import HOLD
from almanac.plans.q_stats import CLASS_SQL, CLASSES, SCORED_SQL, class_probs, scored_docs
from almanac.plans.registry import ds, register, rounded, sql_r6
from almanac.sources.tables import read_table

QS = "[" + ", ".join(str(i / 10) for i in range(11)) + "]"


def _union(parts):
    return "\nUNION ALL\n".join(parts)


def _rank(expr, part):
    return f"(rank() OVER (PARTITION BY {part} ORDER BY {expr}) + (count(*) OVER (PARTITION BY {part}, {expr}) - 1) / 2.0)"


def _auc_from(rk_cte, y, r, by):
    return (f"SELECT {by}, (sum(CASE WHEN {y} = 1 THEN {r} END) - sum({y}) * (sum({y}) + 1) / 2.0) "
            f"/ NULLIF(sum({y}) * (count(*) - sum({y})), 0) AS auc FROM {rk_cte} GROUP BY {by}")


def levels_sql(src: str, metr: list[str], cate: list[str], target: str) -> str:
    """CTE lv(variable, level, y): numeric features in exact quantile bins."""
    parts = []
    for c in metr:
        parts.append(
            f"SELECT '{c}' AS variable, CASE WHEN {c} IS NULL THEN '(Missing)' ELSE 'q' || lpad(CAST(1 + "
            f"len(list_filter(e[2:len(e) - 1], lambda x: x < {c})) AS VARCHAR), 2, '0') END AS level, {target} AS y "
            f"FROM {src}, (SELECT list_sort(list_distinct(quantile_cont({c}, {QS}))) AS e FROM {src}) qq")
    for c in cate:
        parts.append(f"SELECT '{c}' AS variable, CAST({c} AS VARCHAR) AS level, {target} AS y FROM {src} WHERE {c} IS NOT NULL")
    return "lv AS (" + _union(parts) + ")"


def importance_class_sql(prefix: str, src: str, metr, cate, target) -> str:
    return f"""
WITH {prefix}, {levels_sql(src, metr, cate, target)},
sc AS (SELECT variable, y, avg(CAST(y AS DOUBLE)) OVER (PARTITION BY variable, level) AS score FROM lv),
rk AS (SELECT variable, y, {_rank('score', 'variable')} AS r FROM sc),
a AS ({_auc_from('rk', 'y', 'r', 'variable')})
SELECT variable, {sql_r6('auc')} AS importance FROM a
"""


# --- importance_class: E1 -----------------------------------------------------
@register("importance_class", sql=importance_class_sql(SCORED_SQL[1:], "sd", ["n_chars"], ["lang", "source"], "quality"))
def importance_class(spark, sf_dir):
    d = scored_docs(spark, sf_dir)
    return rounded(ev.importance_class(d, ["n_chars", "lang", "source"], "quality"))


# --- fold_dependency: E4 ------------------------------------------------------
_FOLD_SRC = ("od AS (SELECT o_totalprice, o_orderpriority, "
             "CASE WHEN year(o_orderdate) >= 2000 THEN 1 ELSE 0 END AS fold_num FROM orders)")


@register("fold_dependency", sql=importance_class_sql(_FOLD_SRC, "od", ["o_totalprice"], ["o_orderpriority"], "fold_num"))
def fold_dependency(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders", ["o_totalprice", "o_orderpriority", "o_orderdate"]).withColumn(
        "fold_num", (F.year("o_orderdate") >= 2000).cast("int"))
    return rounded(ev.importance_class(o, ["o_totalprice", "o_orderpriority"], "fold_num"))


# --- importance_multi: E2, J9 -------------------------------------------------
_MULTI_SRC = "om AS (SELECT o_totalprice, o_orderpriority, o_orderstatus FROM orders)"


@register("importance_multi", sql=f"""
WITH {_MULTI_SRC}, {levels_sql('om', ['o_totalprice'], ['o_orderpriority'], 'o_orderstatus')},
cls AS (SELECT DISTINCT y AS class FROM lv),
sc AS (SELECT lv.variable, lv.level, lv.y, c.class,
              avg(CASE WHEN lv.y = c.class THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY lv.variable, lv.level, c.class) AS score
       FROM lv CROSS JOIN cls c),
rk AS (SELECT variable, class, CASE WHEN y = class THEN 1 ELSE 0 END AS yy, {_rank('score', 'variable, class')} AS r FROM sc),
a AS ({_auc_from('rk', 'yy', 'r', 'variable, class')})
SELECT variable, {sql_r6('avg(auc)')} AS importance FROM a GROUP BY variable
""")
def importance_multi(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders", ["o_totalprice", "o_orderpriority", "o_orderstatus"])
    return rounded(ev.importance_multiclass(o, ["o_totalprice", "o_orderpriority"], "o_orderstatus"))


# --- importance_regr: E3 ------------------------------------------------------
REGR_CATE = ["o_orderpriority", "c_mktsegment", "o_orderstatus"]
REGR_METR = ["c_acctbal", "c_nationkey"]
_REGR_SRC = ("dr AS (SELECT o_totalprice AS y, o_orderpriority, o_orderstatus, c_mktsegment, c_acctbal, c_nationkey "
             "FROM orders JOIN customer ON o_custkey = c_custkey)")


def _regr_sql():
    parts = [f"SELECT '{c}' AS variable, y, CASE WHEN {c} IS NOT NULL THEN avg(y) OVER (PARTITION BY {c}) END AS s FROM dr"
             for c in REGR_CATE]
    parts += [f"SELECT '{c}' AS variable, y, CAST({c} AS DOUBLE) AS s FROM dr" for c in REGR_METR]
    return f"""{_REGR_SRC}, lv AS ({_union(parts)}),
rk AS (SELECT variable, {_rank('y', 'variable')} AS ry, {_rank('s', 'variable')} AS rs
       FROM lv WHERE y IS NOT NULL AND s IS NOT NULL),
imp AS (SELECT variable, abs(corr(ry, rs)) AS importance FROM rk GROUP BY variable)"""


def _regr_input(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders", ["o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus"])
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey"])
    return o.join(c, o.o_custkey == c.c_custkey)


@register("importance_regr", sql=f"WITH {_regr_sql()}\nSELECT variable, {sql_r6('importance')} AS importance FROM imp")
def importance_regr(spark, sf_dir):
    d = _regr_input(spark, sf_dir)
    return rounded(ev.importance_regression(d, REGR_CATE + REGR_METR, "o_totalprice"))


# --- importance_table: W12, E15, F13, T1, T4 -----------------------------------
@register("importance_table", sql=f"""
WITH {_regr_sql()},
t AS (SELECT variable, importance,
             100 * importance / (SELECT max(importance) FROM imp) AS importance_scaled,
             100 * sum(importance) OVER (ORDER BY importance DESC, variable ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
               / (SELECT sum(importance) FROM imp) AS importance_cum,
             100 * importance / (SELECT sum(importance) FROM imp) AS importance_sumnormed,
             row_number() OVER (ORDER BY importance DESC, variable) AS rank FROM imp)
SELECT variable, {sql_r6('importance')} AS importance, {sql_r6('importance_scaled')} AS importance_scaled,
       {sql_r6('importance_cum')} AS importance_cum, {sql_r6('importance_sumnormed')} AS importance_sumnormed, rank,
       CASE WHEN importance_scaled > -1e-9 AND importance_scaled <= 10 THEN 'low'
            WHEN importance_scaled > 10 AND importance_scaled <= 50 THEN 'medium'
            WHEN importance_scaled > 50 AND importance_scaled <= 100.000000001 THEN 'high' END AS band,
       CAST(rank <= 3 AS INTEGER) AS top
FROM t
""")
def importance_table(spark, sf_dir):
    imp = ev.importance_regression(_regr_input(spark, sf_dir), REGR_CATE + REGR_METR, "o_totalprice")
    out = ev.importance_table(imp, top_n=3)
    return rounded(out, ["importance", "importance_scaled", "importance_cum", "importance_sumnormed"])


@register("top_feature_levels", sql=f"""
WITH {_regr_sql()},
top AS (SELECT variable FROM imp ORDER BY importance DESC, variable LIMIT 3),
l AS ({_union([f"SELECT '{c}' AS variable, {c} AS level, y FROM dr" for c in REGR_CATE])})
SELECT variable, level, count(*) AS n, {sql_r6('avg(y)')} AS target_mean FROM l JOIN top USING (variable) WHERE level IS NOT NULL GROUP BY variable, level
""")
def top_feature_levels(spark, sf_dir):
    """T4: mean target by level, of the categorical features among the three most important ones."""
    d = _regr_input(spark, sf_dir)
    table = ev.importance_table(ev.importance_regression(d, REGR_CATE + REGR_METR, "o_totalprice"), top_n=3)
    long = st.long_form(d, REGR_CATE, "string", keys=["o_totalprice"]).where(F.col("value").isNotNull())
    out = ev.top_rows(long, table).groupBy("variable", F.col("value").alias("level"))
    return rounded(out.agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("target_mean")), ["target_mean"])


# --- roc_curve / pr_curve / precision_vs_tested / average_precision: E5, E9, E10
_CURVE = f"""
WITH {SCORED_SQL[1:]},
g AS (SELECT score, CAST(sum(quality) AS DOUBLE) AS pos, CAST(sum(1 - quality) AS DOUBLE) AS neg FROM sd GROUP BY score),
c AS (SELECT score, pos, sum(pos) OVER (ORDER BY score DESC) AS cp, sum(neg) OVER (ORDER BY score DESC) AS cn,
             sum(pos) OVER () AS tp, sum(neg) OVER () AS tn FROM g)"""


@register("roc_curve", sql=_CURVE + f"""
SELECT {sql_r6('score')} AS threshold, {sql_r6('cn / tn')} AS fpr, {sql_r6('cp / tp')} AS tpr FROM c
""")
def roc_curve(spark, sf_dir):
    return rounded(ev.roc_curve(scored_docs(spark, sf_dir), "quality", "score"))


@register("pr_curve", sql=_CURVE + f"""
SELECT {sql_r6('score')} AS threshold, {sql_r6('cp / (cp + cn)')} AS precision, {sql_r6('cp / tp')} AS recall FROM c
""")
def pr_curve(spark, sf_dir):
    c = ev.pr_curve(scored_docs(spark, sf_dir), "quality", "score")
    return rounded(c.select("threshold", "precision", "recall"))


@register("precision_vs_tested", sql=_CURVE + f"""
SELECT {sql_r6('score')} AS threshold, {sql_r6('cp / (cp + cn)')} AS precision,
       {sql_r6('(cp + cn) / (tp + tn)')} AS pct_tested FROM c
""")
def precision_vs_tested(spark, sf_dir):
    c = ev.pr_curve(scored_docs(spark, sf_dir), "quality", "score")
    return rounded(c.select("threshold", "precision", "pct_tested"))


@register("average_precision", sql=_CURVE + f"""
SELECT {sql_r6('sum(pos / tp * cp / (cp + cn))')} AS average_precision FROM c
""")
def average_precision(spark, sf_dir):
    return rounded(ev.average_precision(scored_docs(spark, sf_dir), "quality", "score"))


# --- confusion / class_metrics / topk_accuracy / accuracy: E6, E12, E13, A13 ---
_PRED = f"""
WITH {CLASS_SQL},
pr AS (SELECT o_orderkey, y, class AS pred FROM
       (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY p DESC, class) AS r FROM cp) WHERE r = 1)"""


def _labels(spark, sf_dir):
    probs = class_probs(spark, sf_dir)
    pred = ev.predicted_class(probs, "o_orderkey")
    lab = probs.select("o_orderkey", "y").distinct().join(pred, "o_orderkey")
    return probs, lab


@register("confusion", sql=_PRED + f"""
SELECT y, {', '.join(f"count(CASE WHEN pred = '{c}' THEN 1 END) AS \"{c}\"" for c in CLASSES)},
       count(*) AS n_true, {sql_r6('count(*) / (SELECT count(*) FROM pr)')} AS pct_true
FROM pr GROUP BY y
""")
def confusion(spark, sf_dir):
    _, lab = _labels(spark, sf_dir)
    return rounded(ev.confusion(lab, "y", "pred", CLASSES), ["pct_true"])


@register("class_metrics", sql=_PRED + f""",
tp AS (SELECT y AS class, count(*) AS tp FROM pr WHERE y = pred GROUP BY y),
nt AS (SELECT y AS class, count(*) AS n_true FROM pr GROUP BY y),
np AS (SELECT pred AS class, count(*) AS n_pred FROM pr GROUP BY pred),
rk AS (SELECT class, CASE WHEN y = class THEN 1 ELSE 0 END AS yy, {_rank('p', 'class')} AS r FROM cp),
au AS ({_auc_from('rk', 'yy', 'r', 'class')}),
m AS (SELECT COALESCE(nt.class, np.class) AS class, COALESCE(n_true, 0) AS n_true, COALESCE(n_pred, 0) AS n_pred,
             COALESCE(tp, 0) AS tp FROM nt FULL OUTER JOIN np ON nt.class = np.class
             LEFT JOIN tp ON tp.class = COALESCE(nt.class, np.class))
SELECT m.class, n_true, n_pred, {sql_r6('tp / NULLIF(n_pred, 0)')} AS precision, {sql_r6('tp / NULLIF(n_true, 0)')} AS recall,
       {sql_r6('2 * (tp / NULLIF(n_pred, 0)) * (tp / NULLIF(n_true, 0)) / NULLIF(tp / NULLIF(n_pred, 0) + tp / NULLIF(n_true, 0), 0)')} AS f1,
       {sql_r6('au.auc')} AS auc
FROM m LEFT JOIN au ON au.class = m.class
""")
def class_metrics(spark, sf_dir):
    probs, lab = _labels(spark, sf_dir)
    return rounded(ev.class_metrics(lab, probs, "o_orderkey", "y", "pred"))


@register("topk_accuracy", sql=f"""
WITH {CLASS_SQL},
rk AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY p DESC, class) AS r FROM cp),
h AS (SELECT o_orderkey, y, {', '.join(f'max(CASE WHEN class = y AND r <= {k} THEN 1 ELSE 0 END) AS acc_top{k}' for k in (1, 2, 3))}
      FROM rk GROUP BY o_orderkey, y)
SELECT y, {', '.join(f"{sql_r6(f'avg(acc_top{k})')} AS acc_top{k}" for k in (1, 2, 3))} FROM h GROUP BY y
""")
def topk_accuracy(spark, sf_dir):
    probs, lab = _labels(spark, sf_dir)
    return rounded(ev.topk_accuracy(probs, lab, "o_orderkey", "y"))


@register("accuracy", sql=_PRED + f"""
SELECT {sql_r6('avg(CASE WHEN y = pred THEN 1.0 ELSE 0.0 END)')} AS accuracy FROM pr
""")
def accuracy(spark, sf_dir):
    _, lab = _labels(spark, sf_dir)
    return rounded(lab.agg(st.accuracy(lab, "y", "pred").alias("accuracy")))


@register("class_residuals", sql=f"""
WITH {CLASS_SQL},
r AS (SELECT y, 1 - p AS residual FROM cp WHERE class = y),
q AS (SELECT y, quantile_cont(residual, 0.25) AS q1, quantile_cont(residual, 0.5) AS median, quantile_cont(residual, 0.75) AS q3 FROM r GROUP BY y)
SELECT r.y, {', '.join(f"{sql_r6(c)} AS {c}" for c in ('q1', 'median', 'q3'))}, {sql_r6('avg(residual)')} AS mean,
       {sql_r6('min(CASE WHEN residual >= q1 - 1.5 * (q3 - q1) THEN residual END)')} AS whisker_lo,
       {sql_r6('max(CASE WHEN residual <= q3 + 1.5 * (q3 - q1) THEN residual END)')} AS whisker_hi, count(*) AS n
FROM r JOIN q ON q.y = r.y GROUP BY r.y, q1, median, q3
""")
def class_residuals(spark, sf_dir):
    """Residuals of class predictions, 1 - p(true class), as box statistics by true class."""
    r = ev.class_residuals(class_probs(spark, sf_dir), "y")
    return rounded(st.box_stats(r, "residual", ["y"]), ["q1", "median", "q3", "mean", "whisker_lo", "whisker_hi"])


# --- calibration: E7, E8 ------------------------------------------------------
_CAL_EDGES = [i * (1.0 + ev.CALIB_EPS) / 5 for i in range(1, 5)]


@register("calibration_width", sql=f"""
WITH {SCORED_SQL[1:]}
SELECT {' + '.join(f'CAST(score >= {e!r} AS INTEGER)' for e in _CAL_EDGES)} AS bin,
       {sql_r6('avg(score)')} AS p_mean, {sql_r6('avg(CAST(quality AS DOUBLE))')} AS y_mean, count(*) AS n
FROM sd GROUP BY ALL
""")
def calibration_width(spark, sf_dir):
    out = ev.calibration_uniform(scored_docs(spark, sf_dir), "quality", "score", 5)
    return rounded(out.withColumn("bin", F.col("bin").cast("int")), ["p_mean", "y_mean"])


@register("calibration_quantile", sql=f"""
WITH {CLASS_SQL},
d AS (SELECT class, p, CASE WHEN y = class THEN 1.0 ELSE 0.0 END AS yy FROM cp),
e AS (SELECT class, quantile_cont(p, {QS}) AS e FROM d GROUP BY class)
SELECT d.class, len(list_filter(e.e[2:10], lambda x: x <= d.p)) AS bin,
       {sql_r6('avg(p)')} AS p_mean, {sql_r6('avg(yy)')} AS y_mean, count(*) AS n
FROM d JOIN e ON d.class = e.class GROUP BY ALL
""")
def calibration_quantile(spark, sf_dir):
    d = class_probs(spark, sf_dir).withColumn("yy", (F.col("y") == F.col("class")).cast("double"))
    out = ev.calibration_quantile(d, "yy", "p", 10, by=["class"])
    return rounded(out.withColumn("bin", F.col("bin").cast("long")), ["p_mean", "y_mean"])


@register("calibration_decile", sql=f"""
WITH li AS (SELECT l_extendedprice AS y, l_quantity * 1000 * (1 - l_discount) AS yhat FROM lineitem),
b AS (SELECT y, yhat, 'q' || lpad(CAST(1 + len(list_filter(e[2:len(e) - 1], lambda x: x < yhat)) AS VARCHAR), 2, '0') AS bin
      FROM li, (SELECT list_sort(list_distinct(quantile_cont(yhat, {QS}))) AS e FROM li) qq)
SELECT bin, {sql_r6('avg(yhat)')} AS yhat_mean, {sql_r6('avg(y)')} AS y_mean, count(*) AS n FROM b GROUP BY bin
""")
def calibration_decile(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem", ["l_extendedprice", "l_quantity", "l_discount"]).select(
        F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1000 * (1 - F.col("l_discount"))).alias("yhat"))
    return rounded(ev.calibration_decile(li, "y", "yhat", 10))


# --- forecast summaries: E11, E21, A30, J16, T2 --------------------------------
@register("residual_table", sql=f"""
WITH {q.WEIGHTED_PANEL[1:]}, {HOLD[1:]},
h2 AS (SELECT demand, yhat FROM hold WHERE demand IS NOT NULL AND yhat IS NOT NULL),
b AS (SELECT demand, yhat, 'q' || lpad(CAST(1 + len(list_filter(e[2:len(e) - 1], lambda x: x < yhat)) AS VARCHAR), 2, '0') AS bin
      FROM h2, (SELECT list_sort(list_distinct(quantile_cont(yhat, {QS}))) AS e FROM h2) qq)
SELECT bin, {sql_r6('avg(yhat)')} AS yhat_mean, {sql_r6('avg(demand - yhat)')} AS resid_mean,
       {sql_r6('avg(abs(demand - yhat))')} AS abs_resid_mean, count(*) AS n
FROM b GROUP BY bin
""")
def residual_table(spark, sf_dir):
    return rounded(ev.residual_table(fc.holdout_frame(spark, sf_dir), "demand", "yhat", 10))


@register("mean_by_date", sql=f"""
WITH {q.WEIGHTED_PANEL[1:]}, {HOLD[1:]}
SELECT CAST(date AS VARCHAR) AS date, state_id, {sql_r6('avg(demand)')} AS y_mean, {sql_r6('avg(yhat)')} AS yhat_mean
FROM hold GROUP BY date, state_id
""")
def mean_by_date(spark, sf_dir):
    h = fc.holdout_frame(spark, sf_dir)
    out = ev.mean_by_date(h, "demand", "yhat", segment="state_id")
    return rounded(out.withColumn("date", ds("date")))


@register("forecast_bias", sql=f"""
WITH {q.WEIGHTED_PANEL[1:]}, {HOLD[1:]},
t AS (SELECT id, avg(yhat) AS yhat_mean, avg(demand) AS y_mean FROM hold GROUP BY id),
tr AS (SELECT id, avg(demand) AS y_train_mean FROM wp WHERE myfold = 'train' GROUP BY id),
b AS (SELECT t.*, tr.y_train_mean, yhat_mean - y_mean AS bias FROM t LEFT JOIN tr ON t.id = tr.id
      ORDER BY bias DESC NULLS LAST, id LIMIT 20)
SELECT id, {sql_r6('yhat_mean')} AS yhat_mean, {sql_r6('y_mean')} AS y_mean,
       {sql_r6('y_train_mean')} AS y_train_mean, {sql_r6('bias')} AS bias FROM b
""")
def forecast_bias(spark, sf_dir):
    """Top-20 over-forecast series (a top-k report)."""
    wp = pl.weighted_panel_table(spark, sf_dir)
    test = fc.naive_forecast(wp).where(F.col("myfold") == "test")
    train = wp.where(F.col("myfold") == "train")
    return rounded(ev.forecast_bias(test, train, "id", "demand", "yhat", top_n=20))
