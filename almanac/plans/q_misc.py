"""Catalogue: reshape and stage round trips, series diagnostics (the
reference's commented-out analyses, step 11) and the contribution ledger."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from almanac.operators import interpret as ip
from almanac.operators import ordered as od
from almanac.operators import timeseries as ts
from almanac.plans import panel as pl
from almanac.plans import sqlfrag as q
from almanac.plans.registry import ds, register, rounded, sql_r6
from almanac.session import ensure_checkpoint_dir
from almanac.sources import fixtures as fx
from almanac.sources.tables import read_csv, read_table, write_csv, write_stage



def _union(parts):
    return "\nUNION ALL\n".join(parts)


# --- panel_melt_roundtrip: P2, A23, U5 ----------------------------------------
@register("panel_melt_roundtrip", sql="""
WITH c AS (SELECT o_orderpriority, year(o_orderdate) AS year, month(o_orderdate) AS month, count(*) AS n
           FROM orders GROUP BY ALL),
py AS (SELECT DISTINCT o_orderpriority, year FROM c),
m AS (SELECT unnest(range(1, 13)) AS month)
SELECT py.o_orderpriority, py.year, CAST(m.month AS INTEGER) AS month, c.n
FROM py CROSS JOIN m LEFT JOIN c ON c.o_orderpriority = py.o_orderpriority AND c.year = py.year AND c.month = m.month
""")
def panel_melt_roundtrip(spark, sf_dir):
    """Counts per (priority, year, month) pivoted to a wide year x 12-month
    sheet (explicit pivot values) and melted back, keeping the empty months."""
    o = read_table(spark, sf_dir, "orders", ["o_orderpriority", "o_orderdate"])
    c = o.groupBy("o_orderpriority", F.year("o_orderdate").alias("year"),
                  F.month("o_orderdate").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    wide = c.groupBy("o_orderpriority", "year").pivot("month", list(range(1, 13))).agg(F.first("n"))
    long = wide.unpivot(["o_orderpriority", "year"], [str(i) for i in range(1, 13)], "month", "n")
    return long.withColumn("month", F.col("month").cast("int"))


# --- stage_roundtrip: S1, S2, S5, S7, S9, P9, P14, F5, F8 -----------------------
@register("stage_roundtrip", sql=f"""
SELECT o_orderstatus AS status, count(*) AS n, {sql_r6('sum(o_totalprice)')} AS total,
       {sql_r6('avg(sqrt(o_totalprice))')} AS mean_sqrt, {sql_r6('avg(ln(o_totalprice + 1))')} AS mean_log,
       {sql_r6('avg(exp(-o_totalprice / 100000.0))')} AS mean_exp,
       {sql_r6('max(abs(o_totalprice - 100000.0))')} AS max_abs_dev,
       {sql_r6('avg(pow(o_totalprice / 1000.0, 2))')} AS mean_sq,
       count(CASE WHEN contains(o_orderpriority, 'URGENT') THEN 1 END) AS n_urgent
FROM orders WHERE o_totalprice > 1000 AND o_orderdate >= TIMESTAMP '1996-01-01'
GROUP BY o_orderstatus
""")
def stage_roundtrip(spark, sf_dir):
    """orders -> parquet hand-over -> CSV sink -> CSV scan with an explicit
    schema -> query-string filter, rename, math.  Files go to the shared
    checkpoint folder (``spark.checkpoint.dir``), never a machine-local one."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stage/{uuid.uuid4().hex}"
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderstatus", "o_totalprice",
                                             "o_orderdate", "o_orderpriority"])
    pq = write_stage(o, f"{base}/orders_parquet", sample=None)
    write_csv(spark.read.parquet(pq), f"{base}/orders_csv")
    schema = ("o_orderkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string")
    back = read_csv(spark, f"{base}/orders_csv", schema)
    d = (back.where("o_totalprice > 1000 AND o_orderdate >= '1996-01-01'")
         .withColumnRenamed("o_orderstatus", "status").drop("o_orderkey"))
    p = F.col("o_totalprice")
    return rounded(d.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.sum(p).alias("total"), F.avg(F.sqrt(p)).alias("mean_sqrt"),
        F.avg(F.log(p + 1)).alias("mean_log"), F.avg(F.exp(-p / 100000.0)).alias("mean_exp"),
        F.max(F.abs(p - 100000.0)).alias("max_abs_dev"), F.avg(F.pow(p / 1000.0, 2)).alias("mean_sq"),
        F.count(F.when(F.col("o_orderpriority").contains("URGENT"), 1)).alias("n_urgent")))


# --- daily mean series (known days) -------------------------------------------
def daily_mean(spark, sf_dir):
    p = fx.sales_panel(spark, sf_dir).where(F.col("fold") == "train")
    return p.groupBy("date").agg(F.avg("demand").alias("x"))


DAILY_SQL = q.PANEL + f""",
dm AS (SELECT date, avg(demand) AS x FROM panel WHERE date < {q.TEST_START} GROUP BY date)"""

MAX_LAG = 40


# --- acf: W17 -----------------------------------------------------------------
@register("acf", sql=f"""
WITH {DAILY_SQL[1:]},
c AS (SELECT x - (SELECT avg(x) FROM dm) AS z, {', '.join(f'lag(x, {k}) OVER (ORDER BY date) - (SELECT avg(x) FROM dm) AS z{k}' for k in range(1, MAX_LAG + 1))} FROM dm),
s AS (SELECT sum(z * z) AS c0, {', '.join(f'sum(z * z{k}) AS c{k}' for k in range(1, MAX_LAG + 1))} FROM c)
{_union([f"SELECT {k} AS k, {sql_r6(f'c{k} / c0')} AS acf FROM s" for k in range(1, MAX_LAG + 1)])}
""")
def acf(spark, sf_dir):
    """Autocorrelation of the daily mean demand for lags 1..40.  The series has
    one row per day, so its ordering window is bounded by the calendar."""
    d = daily_mean(spark, sf_dir)
    mean = d.select(F.avg("x")).scalar()
    w = Window.orderBy("date")
    d = d.select((F.col("x") - mean).alias("z"),
                 *[(F.lag("x", k).over(w) - mean).alias(f"z{k}") for k in range(1, MAX_LAG + 1)])
    s = d.agg(F.sum(F.col("z") * F.col("z")).alias("c0"),
              *[F.sum(F.col("z") * F.col(f"z{k}")).alias(f"c{k}") for k in range(1, MAX_LAG + 1)])
    long = s.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col(f"c{k}") / F.col("c0")).alias("acf"))
                                        for k in range(1, MAX_LAG + 1)])).alias("s")).select("s.*")
    return rounded(long)


def pacf_from_acf(rho: list[float]) -> list[float]:
    """Partial autocorrelations from autocorrelations (Durbin-Levinson);
    runs on the 40 numbers of ``acf``, not on data."""
    out, phi = [], []
    for k in range(1, len(rho) + 1):
        if k == 1:
            a = rho[0]
            phi = [a]
        else:
            num = rho[k - 1] - sum(phi[j] * rho[k - 2 - j] for j in range(k - 1))
            den = 1 - sum(phi[j] * rho[j] for j in range(k - 1))
            a = num / den
            phi = [phi[j] - a * phi[k - 2 - j] for j in range(k - 1)] + [a]
        out.append(a)
    return out


def _seasonal_sql(src: str, out: str, p: int) -> str:
    """CTEs that take the seasonal part of period p off the series x of a CTE."""
    h = p // 2
    frame = f"(ORDER BY date ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)"
    return f"""
{out}_r AS (SELECT date, x, (row_number() OVER (ORDER BY date) - 1) % {p} AS ph, CASE WHEN count(x) OVER {frame} = {p} THEN avg(x) OVER {frame} END AS t FROM {src}),
{out}_p AS (SELECT ph, avg(x - t) AS a FROM {out}_r GROUP BY ph),
{out} AS (SELECT r.date, r.x - (p.a - (SELECT avg(a) FROM {out}_p)) AS x FROM {out}_r r JOIN {out}_p p USING (ph))"""


def less_seasonal(d, p: int):
    """The series without its seasonal part of period p: phase means of what a centred moving average leaves,
    centred to sum zero."""
    h = p // 2
    w = Window.orderBy("date")
    fw = w.rowsBetween(-h, h)
    d = d.select("date", "x", ((F.row_number().over(w) - 1) % p).alias("_ph"), F.when(F.count("x").over(fw) == p, F.avg("x").over(fw)).alias("_t"))
    ph = d.groupBy("_ph").agg(F.avg(F.col("x") - F.col("_t")).alias("_a"))
    centre = ph.select(F.avg("_a")).scalar()
    return d.join(F.broadcast(ph), "_ph").select("date", (F.col("x") - (F.col("_a") - centre)).alias("x"))  # p rows


@register("pacf", sql=f"""
WITH RECURSIVE {DAILY_SQL[1:]},{_seasonal_sql('dm', 'd7', 7)},{_seasonal_sql('d7', 'd61', 61)},
s AS ({_union([f"SELECT '{name}' AS series, date, x FROM {src}" for name, src in (('raw', 'dm'), ('less7', 'd7'), ('less7_61', 'd61'))])}),
z AS (SELECT series, date, x - avg(x) OVER (PARTITION BY series) AS z FROM s),
lagged AS (SELECT series, z, {', '.join(f'lag(z, {k}) OVER w AS z{k}' for k in range(1, MAX_LAG + 1))} FROM z WINDOW w AS (PARTITION BY series ORDER BY date)),
acf AS (SELECT series, count(*) AS n, [{', '.join(f'sum(z * z{k}) / sum(z * z)' for k in range(1, MAX_LAG + 1))}] AS rho FROM lagged GROUP BY series),
rhos AS (SELECT series, 'plain' AS kind, rho FROM acf
         UNION ALL SELECT series, 'adjusted', list_transform(range(1, {MAX_LAG + 1}), lambda k: rho[k] * n / (n - k)) FROM acf),
dl(series, kind, rho, k, phi, a) AS (
  SELECT series, kind, rho, 1, [rho[1]], rho[1] FROM rhos
  UNION ALL
  SELECT series, kind, rho, k + 1, list_append(list_transform(range(1, k + 1), lambda j: phi[j] - b * phi[k + 1 - j]), b), b
  FROM (SELECT *, (rho[k + 1] - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * rho[k + 1 - j])))
                  / (1 - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * rho[j]))) AS b FROM dl WHERE k < {MAX_LAG}))
SELECT p.series, CAST(p.k AS INTEGER) AS k, {sql_r6('p.rho[p.k]')} AS acf, {sql_r6('p.a')} AS pacf, {sql_r6('q.a')} AS pacf_adjusted
FROM dl p JOIN dl q ON q.series = p.series AND q.k = p.k WHERE p.kind = 'plain' AND q.kind = 'adjusted'
""")
def pacf(spark, sf_dir):
    """Autocorrelations and partial autocorrelations of the daily mean demand for lags 1..40: as it is, without
    the weekly seasonality, and without the 61-day one of what is left.  ``pacf_adjusted`` starts
    from autocovariances divided by their own number of terms."""
    raw = daily_mean(spark, sf_dir)
    d7 = less_seasonal(raw, 7)
    parts = [d.select(F.lit(name).alias("series"), "date", "x") for name, d in (("raw", raw), ("less7", d7), ("less7_61", less_seasonal(d7, 61)))]
    s = ts.autocorrelations(parts[0].unionByName(parts[1]).unionByName(parts[2]), "x", "date", MAX_LAG, ["series"])
    adjusted = F.transform("rho", lambda r, i: r * F.col("n") / (F.col("n") - i - 1))
    zipped = F.arrays_zip(F.col("rho").alias("acf"), ts.pacf("rho", MAX_LAG).alias("pacf"), ts.pacf(adjusted, MAX_LAG).alias("pacf_adjusted"))
    out = s.select("series", F.posexplode(zipped).alias("i", "_v")).select("series", (F.col("i") + 1).alias("k"), "_v.*")
    return rounded(out)


# --- seasonal_decompose: W18 ---------------------------------------------------
def _decomp_sql(p):
    h = p // 2
    return (f"CASE WHEN count(x) OVER (ORDER BY date ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING) = {p} "
            f"THEN avg(x) OVER (ORDER BY date ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING) END AS t{p}")


@register("seasonal_decompose", sql=f"""
WITH {DAILY_SQL[1:]},
r AS (SELECT date, x, row_number() OVER (ORDER BY date) - 1 AS i, {_decomp_sql(7)}, {_decomp_sql(61)} FROM dm),
p7 AS (SELECT i % 7 AS ph, avg(x - t7) AS a FROM r GROUP BY 1),
p61 AS (SELECT i % 61 AS ph, avg(x - t61) AS a FROM r GROUP BY 1),
s AS (SELECT r.*, p7.a - (SELECT avg(a) FROM p7) AS s7, p61.a - (SELECT avg(a) FROM p61) AS s61
      FROM r JOIN p7 ON p7.ph = r.i % 7 JOIN p61 ON p61.ph = r.i % 61)
SELECT CAST(date AS VARCHAR) AS date, {sql_r6('t7')} AS trend7, {sql_r6('s7')} AS seasonal7, {sql_r6('x - t7 - s7')} AS resid7,
       {sql_r6('t61')} AS trend61, {sql_r6('s61')} AS seasonal61, {sql_r6('x - t61 - s61')} AS resid61
FROM s
""")
def seasonal_decompose(spark, sf_dir):
    """Additive decomposition with periods 7 and 61: centred moving average
    (null at the edges), phase means of the detrended series centred to sum
    zero, residual."""
    d = daily_mean(spark, sf_dir)
    w = Window.orderBy("date")
    d = d.withColumn("i", F.row_number().over(w) - 1)
    for p in (7, 61):
        h = p // 2
        fw = w.rowsBetween(-h, h)
        d = d.withColumn(f"t{p}", F.when(F.count("x").over(fw) == p, F.avg("x").over(fw)))
        ph = d.groupBy((F.col("i") % p).alias(f"_ph{p}")).agg(F.avg(F.col("x") - F.col(f"t{p}")).alias(f"_a{p}"))
        centre = ph.select(F.avg(f"_a{p}")).scalar()
        d = (d.withColumn(f"_ph{p}", F.col("i") % p).join(ph, f"_ph{p}")
             .withColumn(f"s{p}", F.col(f"_a{p}") - centre))
    return rounded(d.select(ds("date").alias("date"),
                            F.col("t7").alias("trend7"), F.col("s7").alias("seasonal7"),
                            (F.col("x") - F.col("t7") - F.col("s7")).alias("resid7"),
                            F.col("t61").alias("trend61"), F.col("s61").alias("seasonal61"),
                            (F.col("x") - F.col("t61") - F.col("s61")).alias("resid61")))


# --- smoothed_category_mean: A28 ------------------------------------------------
@register("smoothed_category_mean", sql=f"""
WITH {q.BASE_PANEL[1:]},
m AS (SELECT store_id, date, avg(demand) AS mean FROM bp
      WHERE sell_price IS NOT NULL AND demand IS NOT NULL GROUP BY store_id, date)
SELECT store_id, CAST(date AS VARCHAR) AS date, {sql_r6('mean')} AS mean,
       {sql_r6("CASE WHEN count(mean) OVER (PARTITION BY store_id ORDER BY date RANGE BETWEEN INTERVAL 59 DAY PRECEDING AND CURRENT ROW) >= 60 THEN avg(mean) OVER (PARTITION BY store_id ORDER BY date RANGE BETWEEN INTERVAL 59 DAY PRECEDING AND CURRENT ROW) END")} AS smooth60,
       {sql_r6("CASE WHEN count(mean) OVER (PARTITION BY store_id ORDER BY date RANGE BETWEEN INTERVAL 89 DAY PRECEDING AND CURRENT ROW) >= 90 THEN avg(mean) OVER (PARTITION BY store_id ORDER BY date RANGE BETWEEN INTERVAL 89 DAY PRECEDING AND CURRENT ROW) END")} AS smooth90
FROM m
""")
def smoothed_category_mean(spark, sf_dir):
    """Mean demand per (store, day) where a price exists, smoothed over 60 and
    90 calendar days with a minimum-count gate."""
    b = pl.base_panel(spark, sf_dir).where(F.col("sell_price").isNotNull() & F.col("demand").isNotNull())
    m = ts.with_day_number(b.groupBy("store_id", "date").agg(F.avg("demand").alias("mean")))
    out = m
    for days in (60, 90):
        w = Window.partitionBy("store_id").orderBy(ts.DAYNO).rangeBetween(-(days - 1), 0)
        out = out.withColumn(f"smooth{days}", F.when(F.count("mean").over(w) >= days, F.avg("mean").over(w)))
    return rounded(out.select("store_id", ds("date").alias("date"), "mean", "smooth60", "smooth90"))


# --- zero_share: A32 --------------------------------------------------------------
@register("zero_share", sql=f"""
WITH {q.BASE_PANEL[1:]}
SELECT {sql_r6('avg(CASE WHEN demand = 0 THEN 1.0 ELSE 0.0 END)')} AS zero_share,
       {sql_r6('avg(CASE WHEN demand = 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE sell_price IS NOT NULL)')} AS zero_share_priced
FROM bp WHERE demand IS NOT NULL
""")
def zero_share(spark, sf_dir):
    b = pl.base_panel(spark, sf_dir).where(F.col("demand").isNotNull())
    z = (F.col("demand") == 0).cast("double")
    return rounded(b.agg(F.avg(z).alias("zero_share"),
                         F.avg(F.when(F.col("sell_price").isNotNull(), z)).alias("zero_share_priced")))


# --- contribution_ledger / contribution_check: E17, E18, J15, W9, W10, F10, F12, P29
LEDGER_FEATURES = ["price", "acctbal", "nation"]
# Parameters of the linear class scores used as the ledger fixture
LEDGER_COEFS = {"F": {"price": 0.8, "acctbal": -0.3, "nation": 0.5},
                "O": {"price": -0.4, "acctbal": 0.6, "nation": -0.2},
                "P": {"price": 0.1, "acctbal": 0.2, "nation": 0.9}}
LEDGER_INTERCEPTS = {"F": 0.1, "O": -0.2, "P": 0.05}


def _ledger_input(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_totalprice"])
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_acctbal", "c_nationkey"])
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("row_id"), (F.col("o_totalprice") / 1.5e5).alias("price"),
        (F.col("c_acctbal") / 7e3).alias("acctbal"), (F.col("c_nationkey") / 23.0).alias("nation"))


def _baseline(x):
    """Feature means rounded to 1e-9, so that the oracle reproduces the
    baseline bit for bit (summation order differs between engines)."""
    return {f: x.select(F.floor(F.avg(f) * 1e9 + 0.5) / 1e9).scalar() for f in LEDGER_FEATURES}


def _ledger_sql():
    src = ("x AS (SELECT o_orderkey AS row_id, o_totalprice / 1.5e5 AS price, c_acctbal / 7e3 AS acctbal, "
           "c_nationkey / 23.0 AS nation FROM orders JOIN customer ON o_custkey = c_custkey)")
    mean = {f: f"(SELECT floor(avg({f}) * 1e9 + 0.5e0) / 1e9 FROM x)" for f in LEDGER_FEATURES}
    parts = []
    for t, cf in LEDGER_COEFS.items():
        icpt = f"{LEDGER_INTERCEPTS[t]!r}" + "".join(f" + {cf[f]!r} * {mean[f]}" for f in LEDGER_FEATURES)
        parts.append(f"SELECT row_id, '{t}' AS target, 'intercept' AS variable, {icpt} AS shap_value, "
                     f"CAST(NULL AS DOUBLE) AS variable_value FROM x")
        for f in LEDGER_FEATURES:
            parts.append(f"SELECT row_id, '{t}', '{f}', {cf[f]!r} * ({f} - {mean[f]}), CAST({f} AS DOUBLE) FROM x")
    targets = list(LEDGER_COEFS)
    nr = len(LEDGER_FEATURES) + 1
    wide = ", ".join(f"max(CASE WHEN target = '{t}' THEN shap_value END) AS sv_{t}" for t in targets)
    order = "PARTITION BY row_id, target ORDER BY flag_intercept DESC, abs(shap_value) DESC, variable"
    # running sums written out left to right (Spark's running window sum adds
    # sequentially; a segment-tree window would associate differently)
    piv = ", ".join([f"max(CASE WHEN rank = {r} THEN shap_value END) AS a{r}" for r in range(1, nr + 1)] +
                    [f"max(CASE WHEN rank = {r} THEN sv_{t} END) AS {t}{r}" for t in targets for r in range(1, nr + 1)])

    def run(prefix):
        return "CASE rank " + " ".join(
            f"WHEN {r} THEN " + " + ".join(f"p.{prefix}{i}" for i in range(1, r + 1)) for r in range(1, nr + 1)) + " END"
    den = " + ".join(f"exp({run(t)})" for t in targets)
    own = "CASE c2.target " + " ".join(f"WHEN '{t}' THEN exp({run(t)}) / ({den})" for t in targets) + " END"
    return f"""{src},
c0 AS ({_union(parts)}),
c AS (SELECT *, CAST(variable = 'intercept' AS INTEGER) AS flag_intercept FROM c0),
w AS (SELECT row_id, variable, {wide} FROM c0 GROUP BY row_id, variable),
c2 AS (SELECT c.*, {', '.join(f'w.sv_{t}' for t in targets)}, row_number() OVER ({order}) AS rank
       FROM c JOIN w USING (row_id, variable)),
p AS (SELECT row_id, target, {piv} FROM c2 GROUP BY row_id, target),
led AS (
  SELECT c2.row_id, c2.target, c2.variable, c2.shap_value, c2.variable_value, c2.flag_intercept,
         abs(c2.shap_value) AS abs_shap_value, {run('a')} AS shap_value_cum, c2.rank, {own} AS yhat
  FROM c2 JOIN p ON p.row_id = c2.row_id AND p.target = c2.target
)"""


@register("contribution_ledger", sql=f"""
WITH {_ledger_sql()}
SELECT row_id, target, variable, {sql_r6('shap_value')} AS shap_value, {sql_r6('variable_value')} AS variable_value,
       flag_intercept, {sql_r6('abs_shap_value')} AS abs_shap_value, {sql_r6('shap_value_cum')} AS shap_value_cum,
       rank, {sql_r6('yhat')} AS yhat
FROM led
""")
def contribution_ledger(spark, sf_dir):
    x = _ledger_input(spark, sf_dir)
    con = ip.linear_contributions(x.repartition(od.default_buckets(x), "row_id"), "row_id", LEDGER_FEATURES, LEDGER_COEFS, LEDGER_INTERCEPTS, _baseline(x))
    led = ip.ledger(con, "row_id", "MULTICLASS", targets=list(LEDGER_COEFS))
    return rounded(led.select("row_id", "target", "variable", "shap_value", "variable_value", "flag_intercept",
                              "abs_shap_value", "shap_value_cum", F.col("rank").cast("long"), "yhat"),
                   ["shap_value", "variable_value", "abs_shap_value", "shap_value_cum", "yhat"])


def _scores_sql():
    sc = {t: f"{LEDGER_INTERCEPTS[t]!r}" + "".join(f" + {cf[f]!r} * {f}" for f in LEDGER_FEATURES)
          for t, cf in LEDGER_COEFS.items()}
    den = " + ".join(f"exp({s})" for s in sc.values())
    return _union([f"SELECT row_id, '{t}' AS target, exp({s}) / ({den}) AS p FROM x" for t, s in sc.items()])


@register("contribution_check", sql=f"""
WITH {_ledger_sql()},
pr AS ({_scores_sql()}),
last AS (SELECT * FROM led QUALIFY rank = max(rank) OVER (PARTITION BY row_id, target))
SELECT last.target, count(*) AS n_rows,
       CAST(sum(CASE WHEN abs(last.yhat - pr.p) <= 1e-8 + 1e-5 * abs(pr.p) THEN 0 ELSE 1 END) AS BIGINT) AS n_mismatch
FROM last JOIN pr ON pr.row_id = last.row_id AND pr.target = last.target GROUP BY last.target
""")
def contribution_check(spark, sf_dir):
    """Ledger end points against the model's own softmax probabilities."""
    x = _ledger_input(spark, sf_dir)
    con = ip.linear_contributions(x.repartition(od.default_buckets(x), "row_id"), "row_id", LEDGER_FEATURES, LEDGER_COEFS, LEDGER_INTERCEPTS, _baseline(x))
    led = ip.ledger(con, "row_id", "MULTICLASS", targets=list(LEDGER_COEFS))
    scores = {t: F.lit(LEDGER_INTERCEPTS[t]) + sum((F.lit(cf[f]) * F.col(f) for f in LEDGER_FEATURES), F.lit(0.0))
              for t, cf in LEDGER_COEFS.items()}
    den = None
    for s in scores.values():
        den = F.exp(s) if den is None else den + F.exp(s)
    pred = x.select("row_id", F.explode(F.array(*[F.struct(F.lit(t).alias("target"), (F.exp(s) / den).alias("p"))
                                                  for t, s in scores.items()])).alias("s")).select("row_id", "s.*")
    return ip.ledger_check(led, pred, "row_id").withColumn("n_mismatch", F.col("n_mismatch").cast("long"))
