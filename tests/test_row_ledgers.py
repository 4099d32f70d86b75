"""Ledgers of rows that are dealt by key once."""

import math

from pyspark.sql import functions as F

from almanac.operators import interpret as ip
from almanac.operators import transformers as tf

COEFS = {"t0": {"a": 0.5, "b": -1.0}, "t1": {"a": 2.0, "b": 0.25}}
ICPT = {"t0": 0.3, "t1": -0.1}


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_a_ledger_keeps_dealt_rows_where_they_are(spark):
    df = spark.createDataFrame([(k, (k * 7 % 11) / 3, float(k % 4)) for k in range(30)], "rid int, a double, b double")
    con = ip.linear_contributions(df.repartition(4, "rid"), "rid", ["a", "b"], COEFS, ICPT, {"a": F.lit(1.0), "b": F.lit(1.5)})
    led = ip.ledger(con, "rid", "MULTICLASS", targets=["t0", "t1"])
    assert shuffles(led) == 1
    last = {(r.rid, r.target): r.yhat for r in led.where("rank = 3").collect()}
    for r in df.collect():
        s = {t: ICPT[t] + c["a"] * r.a + c["b"] * r.b for t, c in COEFS.items()}
        for t in s:
            assert math.isclose(last[r.rid, t], math.exp(s[t]) / sum(map(math.exp, s.values())), rel_tol=1e-12)


def test_keyed_contributions_equal_those_by_position(spark):
    rows = [(k, float(k % 5), "xyz"[k % 3], float(k % 7)) for k in range(40)] + [(3, 3.0, "x", 3.0)]  # a key that comes twice
    df = spark.createDataFrame(rows, "id int, a double, c string, y double")
    model = tf.SparseMatrixBuilder(["a"], ["c"]).fit(df)
    x = model.transform(df)
    coefs, icpt = ip.marginal_model(x, {"y": F.col("y"), "z": -F.col("y") * F.col("a")})
    args = (x, "id", coefs, icpt, model.position_map(), ["a"], ["c"])
    con, targets = ip.keyed_contributions_onehot(*args)

    def table(d):
        return {(r.id, r.target, r.variable): (r.shap_value, r.variable_value, r.variable_level) for r in d.collect()}
    got, want = table(con), table(ip.linear_contributions_onehot(*args))
    assert targets == ["y", "z"] and got.keys() == want.keys() and len(got) == 40 * 2 * 3
    assert all(math.isclose(got[k][0], want[k][0], abs_tol=1e-12) and got[k][1:] == want[k][1:] for k in want)
