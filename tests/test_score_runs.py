"""Ranked class scores, row numbers and vectors that deal rows once and run compiled."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from almanac.operators import interpret as ip
from almanac.operators import modeling as md
from almanac.operators import ordered as od
from almanac.operators import sampling as sp
from almanac.operators import stats as st
from almanac.operators import transformers as tf


def plan_of(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("by", [[], ["g"], ["g", "v"]])
def test_class_aucs_equal_those_of_all_rows_in_one_ranking(spark, monkeypatch, by):
    r, nan = random.Random(1), float("nan")
    score = lambda: r.choice([0.1, 0.25, 0.0, -0.0, nan, None, r.random(), float("inf")])
    rows = [(r.choice(["a", "b", None]), r.choice([1.5, nan, None, 0.0]), r.choice([0, 1, 2, None, 5]),
             r.choice([None, [], [score() for _ in range(r.choice([2, 3]))], [score(), score(), score()]])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, v double, y int, p array<double>").repartition(5)
    monkeypatch.setattr(st, "RUN", 512), monkeypatch.setattr(st, "ROW", 32), monkeypatch.setattr(st, "MARK", 8), monkeypatch.setattr(st, "SLICE", 32)
    key = lambda x: tuple(map(str, x[:-1]))
    want = {key(x): x[-1] for x in st.auc(md._each_class(df, "y", "p", by), "_is", "_p", [*by, "class"]).collect()}
    assert len(want) > 2
    assert {key(x): x[-1] for x in st.class_aucs(df, "y", "p", by).collect()} == want


def test_multiclass_auc_ranks_runs_of_scores_not_rows(spark):
    df = spark.range(2000).select((F.col("id") % 3).cast("int").alias("y"), F.array(*[(F.col("id") * k % 7 / 7).cast("double") for k in (1, 2, 3)]).alias("p"))
    plan = plan_of(md._auc_multi(df, "y", "p"))
    assert "score_slices" in plan and "value_counts" not in plan
    assert [r.n for r in spark.range(0, 10**5, 1, 2).selectExpr("array(id / 1e5D) AS p", "0 AS y").mapInArrow(
        lambda b: st._score_runs(b, [], [], 10**6, 1 << 14, 64), "_class int, _pos binary, _pos_n binary, _neg binary, _neg_n binary, _marks array<double>, _each double")
        .selectExpr("length(_pos) / 8 AS n").collect()] == ([16384.0] * 3 + [848.0]) * 2  # no row of the table holds a whole run
    empty = md._auc_multi(df.where("false"), "y", "p").collect()
    assert [r.value for r in empty] == [None]


def test_row_numbers_of_dealt_rows_need_no_second_sort(spark):
    rows = [(k * 7919 % 500 if k % 50 else None, "abc"[k % 3]) for k in range(500)]
    df = spark.createDataFrame(rows, "k int, g string").repartition(4)
    for by in ([], ["g"]):
        got = od.global_row_number(df, [F.col("k")], by=by, out="n", n_parts=5)
        assert "Window" not in plan_of(got)
        want = df.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("k")))
        assert sorted((str(r.k), r.g, r.n) if r.k is not None else ("", "", r.n) for r in got.collect()) == \
            sorted((str(r.k), r.g, r.n) if r.k is not None else ("", "", r.n) for r in want.collect())


def test_softmax_and_vectors_are_compiled(spark):
    df = spark.createDataFrame([(0.0, 1.5, "a"), (2.0, None, "b")], "m double, n double, c string")
    assert "lambda" not in plan_of(ip.with_softmax(df, {"m": F.col("m"), "n": F.col("n")}, None))
    lines = []
    model = tf.SparseMatrixBuilder(["m", "n"], ["c"]).fit(df)
    with pytest.MonkeyPatch.context() as patch:
        plain = tf.cut_lineage
        patch.setattr(tf, "cut_lineage", lambda d, *a, **k: (lines.append(plan_of(d)), plain(d, *a, **k))[1])
        out = model.transform(df).select("features").collect()
    assert "lambda" not in lines[-1]
    found = [(v.features.size, v.features.indices.tolist(), str(v.features.values.tolist())) for v in out]
    assert sorted(found) == [(4, [0, 1, 3], "[2.0, nan, 1.0]"), (4, [1, 2], "[1.5, 1.0]")]


def test_undersampled_shares_rank_the_rows_once(spark):
    df = spark.createDataFrame([(k, "ab"[k % 3 == 0] if k < 90 else None) for k in range(100)], "k int, c string")
    _, shares = sp.undersample(df, "c", 20, ["k"])
    plan = shares._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # of one ranking: in each task, and of the whole
    got = {r["class"]: (r.b_all, r.b_sample) for r in shares.collect()}
    assert got == {"a": (0.6, 0.4), "b": (0.3, 0.4), None: (0.1, 0.0)}
