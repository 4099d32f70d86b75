"""Predictions and lookups that stay cheap per row."""

from pyspark.sql import functions as F

from almanac.operators import interpret as ip
from almanac.operators import lookup
from almanac.operators import modeling as md
from almanac.session import cut_lineage


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_softmax_beside_the_rows_equals_the_written_out_one(spark):
    rows = [(0, 1.0, -2.0, 0.5), (1, 800.0, 799.0, -800.0), (2, None, 1.0, 2.0), (3, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double")
    scores, prior = {t: F.col(t) for t in "abc"}, {"a": 0.5, "b": 2.0, "c": 1.25}
    for p in (None, prior):
        each = ip.rescaled_softmax(scores, p)
        want = df.select("k", F.array(*[each[t] for t in "abc"]).alias("w"))
        got = ip.with_softmax(df, scores, p)
        assert got.columns == [*df.columns, "yhat"]
        assert got.join(want, "k").where(~F.col("yhat").eqNullSafe(F.col("w"))).count() == 0


def test_multiclass_auc_makes_the_predictions_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def probs(x):
        calls.add(1)
        return [x, 1 - x]

    df = spark.createDataFrame([(i, i % 2, i / 10) for i in range(10)], "k int, y int, x double").withColumn("p", probs("x"))
    scorer = next(s for s in md.SCORERS["MULTICLASS"] if s.name == "auc")
    both = scorer.fn(df, "y", "p", []).collect()
    assert calls.value == 10
    assert abs(both[0]["value"] - 0.4) < 1e-12
    plain = df.withColumn("p", F.array(F.coalesce("x", F.lit(0.0)), F.lit(0.5)))  # an array that is never null
    assert "size(" not in plan_of(scorer.fn(plain, "y", "p", []))
    assert "size(" not in plan_of(md._each_class(plain, "y", "p", []))


def test_a_small_table_is_looked_up_without_dealing_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "z")], "k int, v string")
    table = cut_lineage(spark.createDataFrame([("a", 3, 1.5), ("b", 1, None)], "v string, n long, x double"))
    got = lookup.attach(df, table, ["v"], "n")
    assert "_salt" not in plan_of(got)
    assert sorted(map(tuple, got.collect())) == [(1, "a", 1.5), (2, "a", 1.5), (3, None, None), (4, "z", None)]
    assert sorted(map(tuple, lookup.attach(df, table, ["v"], "n", how="inner").collect())) == [(1, "a", 1.5), (2, "a", 1.5)]
