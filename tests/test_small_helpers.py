"""Helpers that no catalogue query calls by themselves."""

import datetime as dt

from pyspark.sql import functions as F

from almanac.functions import columns as fc
from almanac.operators import evaluation as ev
from almanac.operators import stats as st
from almanac.operators import timeseries as ts
from almanac.operators import transformers as tf
from almanac.sources import tables


def test_text_columns(spark):
    df = spark.createDataFrame([("a_b_c",), ("abc",), (None,)], "x string")
    rows = df.select(fc.strip_last_token("x").alias("s"), fc.replace("x", "b", "--").alias("r"), fc.contains("x", "_b").alias("c")).collect()
    assert [tuple(r) for r in rows] == [("a_b", "a_--_c", True), ("abc", "a--c", False), (None, None, None)]


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert [r.x for r in df.select(fc.nan_to_null("x").alias("x")).collect()] == [1.0, None, None]


def test_convert_and_apply_types(spark):
    df = spark.createDataFrame([(1, 2.5, "7"), (None, float("nan"), None)], "a long, b double, c string")
    out = tf.convert(df, ["a", "b"], "string")
    assert [tuple(r) for r in out.collect()] == [("1", "2.5", "7"), (None, None, None)]
    plan = [(r.variable, r.spark_type) for r in st.narrow_types_plan(df.limit(1)).collect()]
    narrowed = st.apply_types(df, plan)
    assert dict(narrowed.dtypes) == {"a": "tinyint", "b": "double", "c": "string"}
    assert narrowed.first().a == 1


def test_auc_summary(spark):
    metrics = spark.createDataFrame([("u", 0.5, 1), ("v", 1.0, 3)], "class string, auc double, n_true long")
    row = ev.auc_summary(metrics).first()
    assert row.auc_mean == 0.75 and row.auc_weighted == 0.875


def test_horizon_join_equals_the_shift_on_a_dense_panel(spark):
    days = [("s", dt.date(2001, 1, 1) + dt.timedelta(days=k), float(k * k)) for k in range(20)]
    df = ts.with_day_number(spark.createDataFrame(days, "id string, date date, x double"))
    shifted = ts.shift_forward(df, 5, ["x"]).select("date", "x")
    joined = ts.horizon_join(df.select("id", "date"), df.select("id", "date", "x"), 5).select("date", "x")
    assert sorted(map(str, shifted.collect())) == sorted(map(str, joined.collect()))


def test_stages_and_metadata(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2001, 2, 3), 1)], "d date, x int")
    assert tables.write_stage(df, f"{tmp_path}/t", sample=10).endswith("sample=10")
    assert spark.read.parquet(f"{tmp_path}/t").first()["sample"] == 10
    tables.write_csv(df, f"{tmp_path}/c", single_file=True)
    assert tables.read_csv(spark, f"{tmp_path}/c", "d date, x int").first().d == dt.date(2001, 2, 3)
    meta = tables.metadata_table(spark, [("a", "ready", "m", "h"), ("b", "open", "m", "h")])
    assert [r.variable for r in tables.ready_columns(meta).collect()] == ["a"]


def test_final_panel_and_feature_tables(spark):
    from almanac.plans import panel as pl
    from tests.conftest import SF_SMALL
    final = pl.final_panel(spark, SF_SMALL)
    assert final.where("fold = 'train' AND demand IS NULL").isEmpty() and not final.where("fold = 'test'").isEmpty()
    few = pl.feature_input(spark, SF_SMALL).where(F.col("id").isin([r.id for r in final.select("id").distinct().limit(2).collect()]))
    plain, same_day = pl.ts_features(few), pl.sameweekday_features(few)
    assert {"id", "date", "demand_lag6", "demand_mean4week"} <= set(plain.columns) and any("samesnap" in c for c in same_day.columns)
    assert plain.count() == same_day.count() == few.count()
