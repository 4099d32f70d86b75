"""Rows that once gave wrong results or errors."""

import math

import pytest
from pyspark.sql import functions as F

from almanac.operators import evaluation as ev
from almanac.operators import interpret as ip
from almanac.operators import modeling as md
from almanac.operators import ordered as od
from almanac.operators import sampling as sp
from almanac.operators import stats as st
from almanac.operators import timeseries as ts


@pytest.mark.parametrize("n", [1, 2, 3, 7, 12])
def test_trailing_means_add_only_the_frame(spark, n):
    values = [1e16, 0.1, 0.2, 0.3, 0.1, 0.1, None, 2.5, float("nan"), 1.0, 4.0, 0.25, None, None, 3.0]
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate(values)], f"id string, {ts.DAYNO} int, x double")
    rows = ts.add_trailing(df, [("m", "x", n, "mean")], ["id"]).orderBy(ts.DAYNO).collect()
    for k, r in enumerate(rows):
        frame = [v for v in values[max(0, k - n + 1):k + 1] if v is not None]
        want = sum(frame) / len(frame) if frame else None
        if want is None:
            assert r.m is None
        elif math.isnan(want):
            assert math.isnan(r.m)
        else:
            assert r.m == pytest.approx(want, rel=1e-12)


def test_permutation_returns_each_row_and_value_once(spark):
    df = spark.createDataFrame([(k // 2, float(k), "r%d" % k) for k in range(100)], "key int, x double, name string").repartition(5)
    out = ip.permute_column(df, "x", "key").collect()
    assert sorted(r.name for r in out) == sorted("r%d" % k for k in range(100))
    assert sorted(r.x for r in out) == [float(k) for k in range(100)]
    assert [r.x for r in sorted(out, key=lambda r: r.name)] != [r.x for r in sorted(df.collect(), key=lambda r: r.name)]


def test_long_keys_keep_their_digits(spark):
    df = spark.createDataFrame([(2**60 + k, k) for k in range(20)], "key long, x int")
    assert sorted(r.x for r in ip.permute_column(df, "x", "key").collect()) == list(range(20))


def test_one_class_has_null_rates(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, s double")
    assert {r.fpr for r in ev.roc_curve(df, "y", "s").collect()} == {None}
    none = spark.createDataFrame([(0, 0.5), (0, 0.7)], "y int, s double")
    assert {r.recall for r in ev.pr_curve(none, "y", "s").collect()} == {None}
    assert ev.average_precision(none, "y", "s").first()["average_precision"] is None


def test_constant_column_falls_into_one_bin(spark):
    df = spark.createDataFrame([(3.0,), (3.0,), (None,)], "x double")
    assert [(r.bin, r.n) for r in st.histogram(df, "x").collect()] == [(1, 2)]
    whole = spark.createDataFrame([(3,), (3,)], "x int")
    assert [(r.bin, r.n) for r in st.histogram(whole, "x").collect()] == [(1, 2)]


def test_no_importance_at_all(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", 0.0)], "variable string, importance double")
    rows = ev.importance_table(df).orderBy("rank").collect()
    assert [(r.variable, r.importance_scaled, r.importance_cum) for r in rows] == [("a", 0.0, None), ("b", 0.0, None)]


def test_best_row_reads_the_cv_summary(spark):
    rows = [("p1", s, n, t, "rmse", v) for s in (0, 1) for n, v in ((3, 2.0), (6, 1.0)) for t in ("train", "test")]
    rows += [("p2", s, n, t, "rmse", v) for s in (0, 1) for n, v in ((3, 1.0), (6, 5.0)) for t in ("train", "test")]
    summary = md.cv_summary(spark.createDataFrame(rows, md.CV_SCHEMA))
    assert {"mean_test_rmse", "std_train_rmse"} <= set(summary.columns)
    best = md.best_row(summary, md.Scorer("rmse", None, False)).first()
    assert (best.params, best.n_trees, best.mean_test_rmse) == ("p1", 6, 1.0)
    assert md.best_row(summary, md.Scorer("rmse", None, True)).first().mean_test_rmse == 5.0


def test_softmax_of_large_scores(spark):
    rows = [(1, t, v, x) for t, a, b in (("u", 900.0, 50.0), ("v", 890.0, 45.0)) for v, x in (("intercept", a), ("f", b))]
    out = ip.ledger(spark.createDataFrame(rows, "row int, target string, variable string, shap_value double"), "row", "MULTICLASS").collect()
    last = {r.target: r.yhat for r in out if r["rank"] == 2}
    assert last["u"] == pytest.approx(1 / (1 + math.exp(-15))) and last["u"] + last["v"] == pytest.approx(1)


def test_slices_do_not_change_running_sums(spark):
    df = spark.createDataFrame([(float(k % 37),) for k in range(500)], "x double")
    want = None
    for n in (2, 5, 64, 200):
        got = sorted((r.value, r.cum_n) for r in od.cumulative(df, "x", {"n": F.count(F.lit(1))}, n_buckets=n).collect())
        want = want or got
        assert got == want
    assert want[-1][1] == 500


def test_poisson_walk_has_no_cap():
    import numpy as np
    h = np.random.default_rng(0).integers(-2**62, 2**62, 200)
    draws = sp._poisson_inverse_cdf(np.full(200, 1000.0), h)
    assert abs(draws.mean() - 1000) < 10 and 20 < draws.std() < 45


def test_panel_covers_every_line_item(spark):
    from almanac.sources import fixtures as fx
    from tests.conftest import SF_SMALL
    spec = fx.panel_spec(spark, SF_SMALL)
    panel = fx.sales_panel(spark, SF_SMALL, spec)
    got = panel.agg(F.sum("demand").alias("q"), F.min("date").cast("string").alias("lo"), F.max("date").cast("string").alias("hi"),
                    F.count("demand").alias("known"), F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids")).first()
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").agg(F.sum("l_quantity").alias("q")).first()
    assert got.q == pytest.approx(float(li.q)) and (got.lo, got.hi) == (spec.start, spec.end)
    assert got.n - got.known == fx.HORIZON * got.ids
