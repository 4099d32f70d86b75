"""End-to-end properties of the panel, hierarchy and ledger plans."""

import math
from datetime import date, timedelta

from pyspark.sql import functions as F

from almanac.operators import hierarchy as hy
from almanac.operators import interpret as ip
from almanac.plans import forecast as fc
from almanac.plans import panel as pl
from almanac.sources import fixtures as fx
from tests.conftest import SF_SMALL


def test_panel_is_dense_and_keyed(spark):
    p = pl.base_panel(spark, SF_SMALL)
    n_series = p.select("id").distinct().count()
    spec = fx.panel_spec(spark, SF_SMALL)
    days = (date.fromisoformat(spec.end) - date.fromisoformat(spec.start)).days + 1
    assert p.count() == n_series * days and n_series > 0 and days > fx.HORIZON
    assert p.groupBy("id", "date").count().where("count > 1").count() == 0


def test_level_weights_sum_to_one(spark):
    wp = pl.weighted_panel(pl.base_panel(spark, SF_SMALL))
    w = hy.level_sales_weight(wp)
    assert math.isclose(w.agg(F.sum("sales")).first()[0], 1.0, rel_tol=1e-9)
    assert sorted(r[0] for r in w.select("level").distinct().collect()) == list(range(1, 13))
    per_level = w.groupBy("level").agg(F.sum("sales").alias("s")).collect()
    assert all(math.isclose(r["s"], 1 / 12, rel_tol=1e-9) for r in per_level)


def test_wrmsse_is_zero_for_perfect_forecast(spark):
    wp = pl.weighted_panel(pl.base_panel(spark, SF_SMALL))
    hold = wp.where(F.col("myfold") == "test").withColumn("yhat", F.col("demand"))
    nodes = hy.wrmsse(hold, hy.help_table(wp))
    assert abs(hy.wrmsse_total(nodes).first()["wrmsse"] or 0.0) < 1e-12


def test_submission_round_trip(spark):
    wp = pl.weighted_panel(pl.base_panel(spark, SF_SMALL))
    pred = fc.naive_forecast(wp).where(F.col("myfold") == "test")
    first_day = fx.panel_spec(spark, SF_SMALL).inner_test_start
    sub = fc.to_submission(pred, first_day)
    back = fc.from_submission(sub, first_day, suffix="_evaluation")
    a = pred.select(F.regexp_replace("id", "_[^_]*$", "").alias("id_copy"), "date",
                    F.coalesce(F.bround("yhat", 5), F.lit(0.0)).alias("yhat"))
    assert a.exceptAll(back).count() == 0 and back.exceptAll(a).count() == 0


def test_ledger_ends_at_the_prediction(spark):
    df = spark.createDataFrame([(1, 0.5, 2.0), (2, -1.0, 0.3), (3, 2.0, -0.7)], "rid int, a double, b double")
    coefs = {"t0": {"a": 1.5, "b": -0.5}, "t1": {"a": -0.2, "b": 0.8}}
    icpt = {"t0": 0.3, "t1": -0.1}
    con = ip.linear_contributions(df, "rid", ["a", "b"], coefs, icpt)
    led = ip.ledger(con, "rid", "REGR").toPandas()
    last = led.sort_values("rank").groupby(["rid", "target"]).tail(1).set_index(["rid", "target"])
    for r in df.collect():
        for t, cf in coefs.items():
            exp = icpt[t] + cf["a"] * r["a"] + cf["b"] * r["b"]
            assert math.isclose(last.loc[(r["rid"], t), "yhat"], exp, rel_tol=1e-12, abs_tol=1e-12)
    assert (led.groupby(["rid", "target"])["rank"].max() == 3).all()


def test_prefix_predictions_equal_model_transform(spark):
    import numpy as np
    from almanac.operators import modeling as md
    rng = np.random.default_rng(5)
    rows = [(float(a), float(b), float(2 * a - b + rng.normal(0, 0.1))) for a, b in rng.normal(size=(300, 2))]
    df = md.assemble(spark.createDataFrame(rows, "a double, b double, label double"), ["a", "b"])
    m = md.gbt_regressor(n_trees=6, depth=3).fit(df)
    pp = md.prefix_predictions(m, m.transform(df), [3, 6]).toPandas()
    assert np.allclose(pp["yhat_6"], pp["prediction"], atol=1e-9)
    assert not np.allclose(pp["yhat_3"], pp["prediction"])


def test_direct_forecast_one_row_per_series_and_horizon(spark):
    import __spark_entry__ as entry
    out = entry.queries()["forecast_direct"](spark, SF_SMALL).toPandas()
    assert out.groupby(["id", "horizon"]).size().eq(1).all()
    assert set(out.horizon) == set(range(1, fx.HORIZON + 1)) and out.yhat.notna().all()
    assert out.groupby("horizon")["date"].nunique().eq(1).all()
    first_day = date.fromisoformat(fx.panel_spec(spark, SF_SMALL).test_start)
    assert all(d == str(first_day + timedelta(h - 1)) for h, d in zip(out.horizon, out.date, strict=True))


def test_forecast_direct_and_grid_are_complete():
    from almanac.plans import q_models as qm
    assert qm.DIRECT_H == list(range(1, 29)) and qm.SPLITS == 5
    assert {k: len({p[k] for p in qm.GRID}) for k in qm.GRID[0]} == {"depth": 2, "min_rows": 2, "subsample": 2} and len(qm.GRID) == 8


def test_grid_best_row_is_refitted(spark, monkeypatch):
    import __spark_entry__ as entry
    from almanac.operators import modeling as md
    from almanac.plans import q_models as qm
    monkeypatch.setattr(qm, "GRID", md.product_grid({"depth": [1, 3]}))
    monkeypatch.setattr(qm, "SIZES", [1, 3])
    monkeypatch.setattr(qm, "SPLITS", 2)
    out = entry.queries()["grid_best_refit"](spark, SF_SMALL).collect()
    assert out and all(r.yhat is not None for r in out) and len({r.o_orderkey for r in out}) == len(out)
    assert {(r.params, r.n_trees) for r in out} <= {(md.params_key(p), n) for p in qm.GRID for n in qm.SIZES}
