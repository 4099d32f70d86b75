"""Learners' frames, scorers, the stacked grid scores, permutation importance and partial dependence against brute force."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from almanac.operators import evaluation as ev
from almanac.operators import interpret as ip
from almanac.operators import lookup
from almanac.operators import modeling as md
from almanac.operators import sampling as sp
from almanac.operators import timeseries as ts
from almanac.operators import transformers as tf
from almanac.session import cut_lineage
from tests.conftest import SF_SMALL


def brute_auc(y, s):
    pos, neg = [b for a, b in zip(y, s, strict=True) if a], [b for a, b in zip(y, s, strict=True) if not a]
    return np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg]) if pos and neg else None


# -- frames -----------------------------------------------------------------------------


def test_shifted_rows_equal_lags(spark):
    rows = [(i, d, float(10 * (i == "a") + d), d % 2) for i in "ab" for d in range(12)]
    df = spark.createDataFrame(rows, f"id string, {ts.DAYNO} int, x double, flag int").withColumn("grp", F.upper("id")).repartition(3)
    series = ts.series_table(df, ["x", "flag"], ["grp"])
    out = ts.shifted_rows(series, [ts.DAYNO, "flag"], {"x": 3}, ["grp"]).collect()
    assert sorted((r.id, r.grp, r[ts.DAYNO], r.flag, r.x) for r in out) == [(i, i.upper(), d, d % 2, float(10 * (i == "a") + d - 3) if d >= 3 else None) for i in "ab" for d in range(12)]
    own = ts.shifted_rows(series, [ts.DAYNO], {"x": lambda d: d[ts.DAYNO] - 1}, where=lambda d, i: d["flag"] == 1).collect()
    assert sorted((r.id, r[ts.DAYNO], r.x) for r in own) == [(i, d, float(10 * (i == "a") + 1)) for i in "ab" for d in range(12) if d % 2]


def test_encoded_categories_split_by_sets_of_levels(spark):
    rng = np.random.default_rng(3)
    rows = [(f"k{k}", float(v), float(10 * (k in (1, 4, 5)) + v)) for k, v in zip(rng.integers(0, 40, 800), rng.normal(size=800), strict=True)]
    df = spark.createDataFrame(rows, "c string, x double, label double").withColumn("encode_flag", F.lit(1))
    enc = tf.TargetRankEncoder(["c"], "encode_flag", "label").fit(df)
    n = enc.ranks.count()
    assert n > 32  # more levels than the learner's usual number of bins
    d = enc.transform(df).withColumn("c_ENCODED", md.rank_index("c_ENCODED", n))
    assert d.agg(F.min("c_ENCODED"), F.max("c_ENCODED"), F.count_distinct("c_ENCODED")).first()[:] == (0.0, n - 1.0, n)
    m = md.gbt_regressor(2, 2, levels={"c_ENCODED": n}).fit(md.assemble(d, ["x", "c_ENCODED"], levels={"c_ENCODED": n}))
    assert re.search(r"feature 1 in \{", m.toDebugString)
    plain = md.gbt_regressor(2, 2).fit(md.assemble(d, ["x", "c_ENCODED"]))
    assert not re.search(r"feature 1 in \{", plain.toDebugString)


def test_sums_encode_like_rows(spark):
    rows = [("a", 1, 2.0), ("a", 1, 4.0), ("b", 1, 1.0), ("b", 0, 9.0), ("c", 0, 5.0), ("d", 1, 3.5), ("d", 1, None)]
    df = spark.createDataFrame(rows, "c string, f int, y double")
    plain = tf.TargetRankEncoder(["c"], "f", "y").fit(df).ranks.select("value", "rank", "target_mean")
    sums = df.groupBy("c", "f").agg(F.sum("y").alias("s"), F.count("y").alias("n"))
    summed = tf.TargetRankEncoder(["c"], "f", "s", weight="n").fit(sums).ranks.select("value", "rank", "target_mean")
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, summed.collect())) and plain.count() == 4


def test_fits_run_side_by_side_and_keep_their_order():
    import threading
    seen = set()
    gate = threading.Barrier(3, timeout=20)

    def job(k):
        seen.add(threading.get_ident())
        if k < 3:
            gate.wait()
        return k
    assert md.fit_all([lambda k=k: job(k) for k in range(7)], workers=3) == list(range(7)) and len(seen) == 3


# -- scorers ------------------------------------------------------------------------------


def test_scorers_of_all_tasks(spark):
    rng = np.random.default_rng(1)
    n = 120
    y, s = rng.integers(0, 2, n), np.round(rng.random(n), 1)
    df = spark.createDataFrame([(k % 2, float(a), float(b)) for k, (a, b) in enumerate(zip(y, s, strict=True))], "g int, y double, p double")
    got = {(r.g, r.scorer): r.value for r in md.score_table(df, "y", "p", md.SCORERS["CLASS"], ["g"]).collect()}
    for g in (0, 1):
        assert math.isclose(got[g, "auc"], brute_auc(y[g::2], s[g::2])) and math.isclose(got[g, "acc"], np.mean((s[g::2] > 0.5) == y[g::2]))
    c = rng.integers(0, 3, n)
    probs = np.round(rng.dirichlet([1, 1, 1], n), 1)
    df = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(c, probs, strict=True)], "y int, p array<double>")
    aucs = [brute_auc(c == k, probs[:, k]) for k in range(3)]
    assert math.isclose(md.SCORERS["MULTICLASS"][0].value(df, "y", "p"), np.mean(aucs))
    assert math.isclose(md.SCORERS["MULTICLASS"][1].value(df, "y", "p"), np.mean(probs.argmax(1) == c))
    assert math.isclose(md.WEIGHTED_AUC.value(df, "y", "p"), np.average(aucs, weights=np.bincount(c)))
    own = md.Scorer("mae", lambda d, a, b, by: d.groupBy(*by).agg(F.avg(F.abs(F.col(a) - F.col(b))).alias("value")), False)
    frame = spark.createDataFrame([(1.0, 2.0), (3.0, 3.5)], "y double, p double")
    assert {r.scorer: r.value for r in md.score_table(frame, "y", "p", [own, md.SCORERS["REGR"][2]]).collect()} == {"mae": 0.75, "rmse": math.sqrt(0.625)}


def test_auc_is_null_without_a_class(spark):
    df = spark.createDataFrame([(0, [0.2, 0.5, 0.3]), (1, [0.1, 0.8, 0.1])], "y int, p array<double>")
    assert md.SCORERS["MULTICLASS"][0].value(df, "y", "p") is None


def cv_frame(spark, classes):
    rng = np.random.default_rng(7)
    rows = []
    for k in range(240):
        a, b = rng.normal(), float(rng.integers(0, 4))
        y = float(a + b + rng.normal() > 1.5) if classes else float(np.round(a + b, 1))
        rows.append((k, "train" if k % 4 else "test", y, float(a), b))
    df = md.assemble(spark.createDataFrame(rows, "id int, fold string, label double, a double, b double"), ["a", "b"])
    return cut_lineage(sp.cv_split(df, ["id"], n_splits=2).select("id", "split", "role", "label", "features"))


@pytest.mark.parametrize("task", ["REGR", "CLASS"])
def test_stacked_scores_equal_scores_one_by_one(spark, task):
    folds = cv_frame(spark, task == "CLASS")
    grid = md.product_grid({"depth": [1, 2]})
    make = md.gbt_classifier if task == "CLASS" else md.gbt_regressor
    preds = cut_lineage(md.grid_predictions(folds, grid, [1, 3], make))
    got = {(*[r[k] for k in md.CV_KEYS], r.scorer): r.value for r in md.stacked_scores(preds, folds, task).collect()}
    want = md.score_table(preds, "label", "yhat", md.SCORERS[task], md.CV_KEYS).collect()
    assert len(got) == len(want) == 2 * 2 * 2 * 2 * len(md.SCORERS[task])
    assert all(math.isclose(got[(*[r[k] for k in md.CV_KEYS], r.scorer)], r.value, rel_tol=1e-9) for r in want)


def test_prefixes_of_a_classifier(spark):
    folds = cv_frame(spark, True).where("role = 'train'")
    m = md.gbt_classifier(4, 2).fit(folds)
    out = md.prefix_predictions(m, md.p_class1(m.transform(folds)), [2, 4]).toPandas()
    assert np.allclose(out["yhat_4"], out["p"]) and not np.allclose(out["yhat_2"], out["p"])


def test_facets_and_runs(spark):
    rows = [(md.params_key({"depth": d, "sub": s}), k, 3, t, "spear", float(d + s + k + (t == "train"))) for d in (1, 2) for s in (0.5, 1.0) for k in (0, 1) for t in ("train", "test")]
    out = {(r.parameter, r.value): (r.train, r.test) for r in md.facet_means(spark.createDataFrame(rows, md.CV_SCHEMA), "spear").collect()}
    assert out == {("depth", "1"): (3.25, 2.25), ("depth", "2"): (4.25, 3.25), ("sub", "0.5"): (3.5, 2.5), ("sub", "1.0"): (4.0, 3.0)}
    runs = spark.createDataFrame([("m", 0, 1.0), ("m", 1, 3.0), ("k", 0, 5.0)], "model string, run int, test_score double")
    assert sorted(tuple(r) for r in md.run_lines(runs).collect()) == [(0, "k", 5.0, 0.0), (0, "m", 1.0, -1.0), (1, "m", 3.0, 1.0)]


# -- permutation importance and partial dependence -------------------------------------------


def score_rows(spark):
    rng = np.random.default_rng(11)
    rows = [(k, float(a), "xyz"[c], float(2 * a + c + rng.normal(0, 0.1))) for k, (a, c) in enumerate(zip(rng.integers(0, 5, 90), rng.integers(0, 3, 90), strict=True))]
    return spark.createDataFrame(rows, "id int, a double, c string, y double"), rows


def test_permutation_is_shared_and_scored_at_once(spark):
    df, rows = score_rows(spark)
    score = lambda a, c: 2 * a + "xyz".index(c)
    calls = []

    def predict(d):
        calls.append(1)
        return d.withColumn("yhat", 2 * F.col("a") + F.instr(F.lit("xyz"), F.col("c")) - 1)
    pear = md.SCORERS["REGR"][1]
    got = {r.variable: (r.score_orig, r.importance) for r in ip.permutation_importance(df, ["a", "c"], "id", "y", predict, pear).collect()}
    assert len(calls) == 1
    h = {r.id: r.h for r in df.select("id", sp.hash_order(["id"], 42).alias("h")).collect()}
    moved = sorted(rows, key=lambda r: (h[r[0]], r[0]))
    y = [r[3] for r in rows]
    orig = np.corrcoef(y, [score(r[1], r[2]) for r in rows])[0, 1]
    for v, p in (("a", [score(m[1], r[2]) for r, m in zip(rows, moved, strict=True)]), ("c", [score(r[1], m[2]) for r, m in zip(rows, moved, strict=True)])):
        assert math.isclose(got[v][0], orig) and math.isclose(got[v][1], max(0, orig - np.corrcoef(y, p)[0, 1]))


def test_partial_dependence_over_distinct_rows(spark):
    df, rows = score_rows(spark)
    seen = []

    def predict(d):
        seen.append(d.count())
        x = F.col("a") * (F.instr(F.lit("xyz"), F.col("c")))
        return d.withColumn("yhat", F.array(x, -x))
    grid = ip.dependence_grid(df, "c")
    out = {(r.value, r.target): r.yhat_mean for r in ip.partial_dependence(df, "c", ["a"], grid, predict, ["u", "v"]).collect()}
    assert seen == [5 * 3]
    for k, level in enumerate("xyz"):
        want = np.mean([r[1] * (k + 1) for r in rows])
        assert math.isclose(out[level, "u"], want) and math.isclose(out[level, "v"], -want)
    quantiles = {r.value for r in ip.dependence_grid(df, "a", [0.0, 0.5, 1.0]).collect()}
    assert quantiles == set(np.quantile([r[1] for r in rows], [0, 0.5, 1]))


# -- others -----------------------------------------------------------------------------------


@pytest.mark.parametrize("hot", [1, lookup.HOT])
def test_random_imputation_keeps_every_row_once(spark, monkeypatch, hot):
    monkeypatch.setattr(lookup, "HOT", hot)
    rows = [(1, 5.0), (1, None), (1, None), (2, 7.0), (None, None), (3, None), (3, 9.0), (4, 5.0)]
    df = spark.createDataFrame(rows, "k int, x double").withColumn("name", F.monotonically_increasing_id())
    out = tf.random_impute(df, "x", "k").collect()
    assert len(out) == len({r.name for r in out}) == len(rows)
    assert all(r.x in (5.0, 7.0, 9.0) for r in out) and sorted(r.x for r in out if r.k in (2, 4)) == [5.0, 7.0]
    assert len({r.x for r in out if r.k == 1 and r.name not in [q.name for q in df.where("x IS NOT NULL").collect()]}) == 1


def test_pacf_equals_the_plain_recursion(spark):
    from almanac.plans.q_misc import pacf_from_acf
    rng = np.random.default_rng(2)
    x = np.cumsum(rng.normal(size=120))
    df = spark.createDataFrame([("s", k, float(v)) for k, v in enumerate(x)] + [("one", 0, 1.0)], "g string, t int, x double")
    got = {r.g: r for r in ts.autocorrelations(df, "x", "t", 12, ["g"]).withColumn("pacf", ts.pacf("rho", 12)).collect()}
    z = x - x.mean()
    rho = [float((z[k:] * z[:-k]).sum() / (z * z).sum()) for k in range(1, 13)]
    assert np.allclose(got["s"].rho, rho) and np.allclose(got["s"].pacf, pacf_from_acf(rho)) and got["s"].n == 120
    assert set(got["one"].rho) == {None}


def test_class_residuals(spark):
    df = spark.createDataFrame([(1, "a", "a", 0.7), (1, "a", "b", 0.3), (2, "b", "a", 0.9), (2, "b", "b", 0.1)], "id int, y string, class string, p double")
    assert {r.id: round(r.residual, 9) for r in ev.class_residuals(df, "y").collect()} == {1: 0.3, 2: 0.9}


def test_bootstrap_by_group_keeps_each_groups_size(spark, monkeypatch):
    monkeypatch.setattr(lookup, "HOT", 2)
    df = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END g")
    n = {r.g: r["count"] for r in sp.weighted_bootstrap(df, ["id"], by=["g"]).groupBy("g").count().collect()}
    assert abs(n["a"] / 1000 - 1) < 0.15 and abs(n["b"] / 2000 - 1) < 0.1


def test_cv_splits_read_the_orders_from_one_slim_table(spark, monkeypatch):
    from almanac.plans import q_models as qm

    class Split(Exception):
        pass

    def split(df, *_, **__):
        raise Split(df.columns, df.inputFiles())

    monkeypatch.setattr(sp, "cv_split", split)
    with pytest.raises(Split) as found:
        qm.cv_compare(spark, SF_SMALL)
    columns, files = found.value.args
    assert columns == ["o_orderkey", "fold", "label", "features"]
    assert files and all("/cv-orders-" in f for f in files)
