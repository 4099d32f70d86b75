"""Entry B without a learner: naive forecasts, submission reshaping and the
holdout evaluation (M7 scaffolding, A23, U3, J11, P18, P20, E22).

A fitted model plugs in by supplying a ``yhat`` column instead of the naive
``lag`` forecast; everything downstream (floor, pivot, template join,
evaluation) is the same plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.operators import hierarchy as hy
from almanac.operators import timeseries as ts
from almanac.plans import panel as pl
from almanac.sources import fixtures as fx

HORIZON = fx.HORIZON


def floor_prediction(yhat: Column, no_price: Column, floor: float = 0.0001) -> Column:
    """P20: tiny positive forecast when there is no price or the model is negative."""
    return F.when((no_price == 1) | (yhat < 0), F.lit(floor)).otherwise(yhat)


def naive_forecast(df: DataFrame, lag: int = HORIZON, col: str = "demand") -> DataFrame:
    """yhat = value ``lag`` days earlier (dense panel: a lag in the series window)."""
    if ts.DAYNO not in df.columns:
        df = ts.with_day_number(df)
    return df.withColumn("yhat", ts.lag_days(col, lag))


def to_submission(pred: DataFrame, first_day: str, horizon: int = HORIZON, digits: int = 5,
                  template: DataFrame | None = None) -> DataFrame:
    """A23 + U3 + J11 + P18: pivot days to F1..Fh, duplicate rows for both id
    suffixes, align with the template ids and fill gaps with 0.

    ``pivot`` gets its value list explicitly, so no extra distinct job runs.
    Result size is one row per series and suffix.
    """
    k = F.datediff(F.col("date"), F.to_date(F.lit(first_day))) + 1
    wide = (pred.withColumn("k", k).where(F.col("k").between(1, horizon))
            .groupBy("id").pivot("k", list(range(1, horizon + 1)))
            .agg(F.max(F.bround("yhat", digits))))
    wide = wide.withColumnsRenamed({str(i): f"F{i}" for i in range(1, horizon + 1)})
    both = wide.withColumn("id", F.explode(F.array(
        F.col("id"), F.regexp_replace("id", "evaluation", "validation"))))
    if template is not None:
        both = template.select("id").join(both, "id", "left")
    return both.fillna(0.0)


def id_template(series: DataFrame) -> DataFrame:
    """All ids in both suffixes, derived from the series table."""
    return series.select(F.explode(F.array(
        F.col("id"), F.regexp_replace("id", "evaluation$", "validation"))).alias("id"))


def from_submission(sub: DataFrame, first_day: str, horizon: int = HORIZON,
                    suffix: str = "_validation") -> DataFrame:
    """P2 + S4: melt F1..Fh back to (id, date, yhat) for one id suffix, with the
    suffix stripped (F1)."""
    long = sub.where(F.col("id").endswith(suffix)).unpivot(
        "id", [f"F{i}" for i in range(1, horizon + 1)], "k", "yhat")
    day = F.date_add(F.to_date(F.lit(first_day)), F.regexp_replace("k", "F", "").cast("int") - 1)
    return long.select(F.regexp_replace("id", "_[^_]*$", "").alias("id_copy"), day.alias("date"), "yhat")


def holdout_frame(spark: SparkSession, sf_dir: str, spec: fx.PanelSpec | None = None) -> DataFrame:
    """Weighted panel with a naive t-28 forecast, restricted to the inner test fold."""
    wp = pl.weighted_panel_table(spark, sf_dir, spec)
    return naive_forecast(wp).where(F.col("myfold") == "test")


def holdout_eval(spark: SparkSession, sf_dir: str, spec: fx.PanelSpec | None = None) -> DataFrame:
    """Submission round trip and scoring on the inner test fold.

    Submission of a naive forecast -> melt -> drop zero forecasts -> join truth
    and ids -> RMSE, means, ratio and WRMSSE over the 12 levels.
    """
    spec = spec or fx.panel_spec(spark, sf_dir)
    wp = pl.weighted_panel_table(spark, sf_dir, spec)
    pred = naive_forecast(wp)
    sub = to_submission(pred.where(F.col("myfold") == "test"), spec.inner_test_start)
    long = from_submission(sub, spec.inner_test_start).where(F.col("yhat") != 0)
    truth = wp.select("id_copy", "date", "demand", *fx.HIERARCHY)
    ho = long.join(truth, ["id_copy", "date"], "left")
    nodes = hy.wrmsse(ho, hy.help_table(wp))
    total = nodes.select(F.sum("wrmsse")).scalar()
    return ho.agg(
        hy.rmse("yhat", "demand").alias("rmse"),
        F.avg("yhat").alias("yhat_mean"),
        F.avg("demand").alias("demand_mean"),
        (F.avg("demand") / F.nullif(F.avg("yhat"), F.lit(0.0))).alias("ratio"),
        F.count(F.lit(1)).alias("n_rows"),
    ).withColumn("wrmsse", total)
