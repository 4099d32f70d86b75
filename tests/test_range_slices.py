"""Running sums over slices dealt by range, and bins read column by column."""

from pyspark.sql import functions as F

from almanac.operators import evaluation as ev
from almanac.operators import ordered as od
from almanac.plans.catalogue import QUERIES


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_running_sums_find_slices_without_a_search_per_value(spark):
    rows = [(g, float(v)) for g in "ab" for v in [3, 1, 2, 2, float("nan"), -0.0, 0.0]]
    df = spark.createDataFrame(rows, "g string, x double")
    got = od.cumulative(df, "x", {"n": F.count(F.lit(1))}, by=["g"], n_buckets=3)
    assert "percentile_approx" not in plan_of(got) and "__bounds" not in plan_of(got)
    table = sorted((r.g, str(r.value + 0.0), r.n, r.cum_n, r.tot_n) for r in got.collect())
    one = [("0.0", 2, 2, 7), ("1.0", 1, 3, 7), ("2.0", 2, 5, 7), ("3.0", 1, 6, 7), ("nan", 1, 7, 7)]
    assert table == [(g, *r) for g in "ab" for r in one]


def test_quantile_bins_read_a_column_at_a_time(spark, tmp_path):
    rows = [(float(i % 7), float(i), 0.1 * (i % 3) if i % 5 else None) for i in range(40)]
    spark.createDataFrame(rows, "l_quantity double, l_extendedprice double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = QUERIES["quantile_bins"](spark, str(tmp_path))
    assert "explode" not in plan_of(out)
    n = {r["variable"]: r["n"] for r in out.groupBy("variable").agg(F.sum("n").alias("n")).collect()}
    assert n == {"l_quantity": 40, "l_extendedprice": 40, "l_discount": 32}


def test_levels_of_a_multiclass_target_are_counted_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def as_read(x):
        calls.add(1)
        return x

    df = spark.createDataFrame([("xyz"[i % 3], "ab"[i % 2]) for i in range(12)], "v string, t string").withColumn("v", as_read("v"))
    assert ev.importance_multiclass(df, ["v"], "t").collect()[0]["variable"] == "v"
    assert calls.value == 12
