"""Levels added up from the smallest finer level, and ranks taken once per column."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from almanac.operators import hierarchy as hy
from almanac.operators import stats as st


def test_levels_read_the_smallest_finer_one():
    source = {lv: hy.finer_level(lv) for lv in hy.LEVELS}
    assert [lv for lv, s in source.items() if s is None] == [12]
    assert all(hy.closure(hy.LEVELS[lv]) < hy.closure(hy.LEVELS[s]) for lv, s in source.items() if s is not None)


def test_level_sums_equal_group_bys(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(400):
        cat, dept, item, state, store = rng.integers(0, 2), rng.integers(0, 2), rng.integers(0, 3), rng.integers(0, 2), rng.integers(0, 2)
        rows.append((f"S{state}", f"S{state}_{store}", f"C{cat}", f"C{cat}_{dept}", f"C{cat}_{dept}_{item}", int(k % 5), None if k % 11 == 0 else float(rng.integers(0, 9))))
    names = [*hy.DIMS, "date", "x"]
    df = spark.createDataFrame(rows, "state_id string, store_id string, cat_id string, dept_id string, item_id string, date int, x double")
    out = hy.level_aggregate(df, {"x": F.sum("x"), "n": F.count(F.lit(1))}, ["date"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan
    got = {(r.level, *[r[d] for d in hy.DIMS], r.date): (r.x, r.n) for r in out.collect()}
    pdf = pd.DataFrame(rows, columns=names)
    want = {}
    for level, used in hy.LEVELS.items():
        for key, g in pdf.groupby([*used, "date"]):
            at = dict(zip([*used, "date"], key, strict=True))
            want[(level, *[at.get(d) for d in hy.DIMS], at["date"])] = (g.x.sum() if g.x.notna().any() else None, len(g))
    assert got == want


@pytest.mark.parametrize("cutoff", [None, 0.3])
def test_spearman_pairs_equal_pandas(spark, cutoff):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 20, 300).astype(float)
    frame = pd.DataFrame({"a": a, "b": a + rng.normal(0, 3, 300).round(), "c": rng.integers(0, 4, 300).astype(float), "d": np.where(rng.random(300) < 0.2, np.nan, -a)})
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in frame.to_numpy()]
    got = {(r.var1, r.var2): r.abs_spearman for r in st.spearman_pairs(spark.createDataFrame(rows, "a double, b double, c double, d double"), list("abcd"), cutoff).collect()}
    rho = frame.corr(method="spearman").abs()
    keep = [c for c in "abcd" if cutoff is None or rho[c].drop(c).max() > cutoff]
    want = {(x, y): rho.loc[x, y] for i, x in enumerate("abcd") for y in "abcd"[i + 1:] if x in keep and y in keep}
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)


def test_dropped_columns(spark):
    df = spark.createDataFrame([(1, "x", None, None), (2, "x", None, 1.0), (3, "x", None, None)], "a int, b string, c string, d double")
    assert st.drop_columns(df, df.columns).columns == ["a"]  # d holds one value
    assert st.drop_columns(df, df.columns, one_level=False).columns == ["a", "b", "d"]
    assert st.drop_columns(df, df.columns, max_missing=0.5, one_level=False).columns == ["a", "b"]
