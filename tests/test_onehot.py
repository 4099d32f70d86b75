"""One-hot vectors with levels as a table, contributions by position, and lookups with hot keys."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from almanac.operators import interpret as ip
from almanac.operators import lookup
from almanac.operators import transformers as tf
from almanac.session import cut_lineage

ROWS = [(1, 0.5, "a", "x", 1.0), (2, 0.0, "b", "x", 2.0), (3, -1.5, "a", "y", 0.0), (4, 2.0, "c", "y", 5.0), (5, 0.0, "a", "x", 1.5)]


def table(spark):
    return spark.createDataFrame(ROWS, "id int, m double, c string, d string, y double")


def test_sparse_vectors(spark):
    df = table(spark)
    model = tf.SparseMatrixBuilder(["m"], ["c", "d"]).fit(df)
    assert [(r.position, r.variable, r.value) for r in model.position_map().orderBy("position").collect()] == [
        (0, "m", None), (1, "c", "a"), (2, "c", "b"), (3, "c", "c"), (4, "d", "x"), (5, "d", "y")]
    got = {r.id: r.features for r in model.transform(df).collect()}
    assert got[1].size == 6 and got[1].indices.tolist() == [0, 1, 4] and got[1].values.tolist() == [0.5, 1.0, 1.0]
    assert got[2].indices.tolist() == [2, 4]  # a zero is not stored
    active = tf.active_positions(model.transform(df), ["id"]).where("id = 4").orderBy("position").collect()
    assert [(r.position, r.x) for r in active] == [(0, 2.0), (3, 1.0), (5, 1.0)]
    only = tf.SparseMatrixBuilder(["m", "y"], []).fit(df).transform(df)
    assert {r.id: r.features.toArray().tolist() for r in only.collect()}[4] == [2.0, 5.0]


@pytest.mark.parametrize("level", ["zz", None])
def test_unknown_levels_raise(spark, level):
    model = tf.SparseMatrixBuilder(["m"], ["c"]).fit(table(spark))
    with pytest.raises(Exception, match="c: level not in the reference data"):
        model.transform(spark.createDataFrame([(1.0, level)], "m double, c string")).collect()


def test_a_million_levels(spark):
    n = 1_000_000
    df = spark.range(n).select("id", F.lit(1.0).alias("m"), F.concat(F.lit("k"), F.col("id").cast("string")).alias("c"))
    model = tf.SparseMatrixBuilder(["m"], ["c"]).fit(df)
    assert model.size == n + 1
    out = tf.active_positions(model.transform(df), ["id"]).where("position > 0").join(model.position_map(), "position")
    row = out.agg(F.count("*").alias("n"), F.count_distinct("position").alias("k"), F.sum((F.col("value") != F.concat(F.lit("k"), F.col("id").cast("string"))).cast("int")).alias("wrong")).first()
    assert (row.n, row.k, row.wrong) == (n, n, 0)


@pytest.mark.parametrize("hot", [1, 3, 1 << 14])
def test_lookup_with_hot_keys(spark, monkeypatch, hot):
    monkeypatch.setattr(lookup, "HOT", hot)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keys = ["a"] * 50 + ["b"] * 5 + ["c", None, "zz", "zz"]
        df = spark.createDataFrame([(k, i, {"m": i}) for i, k in enumerate(keys)], "k string, i int, extra map<string,int>")
        counts = lookup.key_counts(df, ["k"], "n").where("k <> 'zz'")
        values = cut_lineage(counts.withColumns({"v": F.upper("k"), "w": F.when(F.col("k") != "c", F.lit(1))}))
        left = sorted((r.i, r.k, r.v, r.w) for r in lookup.attach(df, values, ["k"], "n").collect())
        known = {"a": ("A", 1), "b": ("B", 1), "c": ("C", None)}
        assert left == [(i, k, *known.get(k, (None, None))) for i, k in enumerate(keys)]
        inner = lookup.attach(df, values, ["k"], "n", how="inner")
        assert sorted(r.i for r in inner.collect()) == [i for i, k in enumerate(keys) if k in known]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def fitted(spark, targets):
    df = table(spark)
    model = tf.SparseMatrixBuilder(["m"], ["c", "d"]).fit(df)
    rows = model.transform(df)
    return rows, model, *ip.marginal_model(rows, targets)


def test_marginal_model(spark):
    _, model, coefs, intercepts = fitted(spark, {"y": F.col("y")})
    x = np.array([[r[1], *(float(r[2] == v) for v in "abc"), *(float(r[3] == v) for v in "xy")] for r in ROWS])
    y = np.array([r[4] for r in ROWS])
    want = [np.cov(x[:, k], y, bias=True)[0, 1] / x[:, k].var() for k in range(6)]
    got = {r.position: r for r in coefs.collect()}
    assert np.allclose([got[k].coef for k in range(6)], want) and np.allclose([got[k]["mean"] for k in range(6)], x.mean(0))
    assert math.isclose(intercepts.first().intercept, y.mean() - float(np.dot(want, x.mean(0))), abs_tol=1e-6)


@pytest.mark.parametrize("task", ["REGR", "CLASS", "MULTICLASS"])
@pytest.mark.parametrize("rescale", [False, True])
def test_ledgers_end_at_the_prediction(spark, task, rescale):
    names = {"REGR": ["y"], "CLASS": ["1"], "MULTICLASS": ["a", "b", "c"]}[task]
    targets = {t: F.col("y") if task == "REGR" else (F.col("y") > 1).cast("int") if task == "CLASS" else (F.col("c") == t).cast("int") for t in names}
    rows, model, coefs, intercepts = fitted(spark, targets)
    prior = {"0": 0.5, "1": 2.0, "a": 3.0, "b": 0.5, "c": 1.0} if rescale else None
    con = ip.linear_contributions_onehot(rows, "id", coefs, intercepts, model.position_map(), ["m"], ["c", "d"])
    led = ip.ledger(con, "id", task, prior).toPandas()
    assert len(led) == len(ROWS) * len(names) * 4 and (led.groupby(["id", "target"])["rank"].max() == 4).all()
    b = {r.target: r.intercept for r in intercepts.collect()}
    w = {(r.target, r.position): r.coef for r in coefs.collect()}
    last = led.sort_values("rank").groupby(["id", "target"]).tail(1).set_index(["id", "target"])["yhat"]
    for r in rows.collect():
        s = {t: b[t] + sum(w[t, int(i)] * v for i, v in zip(r.features.indices, r.features.values, strict=True)) for t in names}
        if task == "CLASS":
            p = 1 / (1 + math.exp(-s["1"]))
            s = {"1": p * 2 / (p * 2 + (1 - p) * 0.5) if rescale else p}
        elif task == "MULTICLASS":
            e = {t: math.exp(v) * (prior[t] if rescale else 1) for t, v in s.items()}
            s = {t: v / sum(e.values()) for t, v in e.items()}
        for t in names:
            assert math.isclose(last[r.id, t], s[t], rel_tol=1e-9, abs_tol=1e-9)
    values = led[(led.variable == "c")].groupby("id")["variable_level"].first()
    assert values.to_dict() == {r[0]: r[2] for r in ROWS}


def test_contributions_from_elsewhere_are_summed_by_variable(spark):
    con = spark.createDataFrame([(1, "t", 0, 1.0), (1, "t", 1, 0.5), (1, "t", 2, -2.0), (2, "t", 2, 4.0), (2, "t", 9, 7.0)], "id int, target string, position int, shap_value double")
    names = spark.createDataFrame([(0, "m", None), (1, "c", "a"), (2, "c", "b")], "position int, variable string, value string")
    got = sorted(tuple(r) for r in ip.sum_positions(con, ["id"], names).collect())
    assert got == [(1, "t", "c", -1.5), (1, "t", "m", 1.0), (2, "t", "c", 4.0)]
