"""Spark catalogue queries against their DuckDB SQL on the sf0.001 tables
(the full catalogue runs with tools/check_oracle.py at sf0.01)."""

import pytest

from tests.conftest import SF_SMALL
from tools.check_oracle import norm, vhash

SUBSET = [
    "panel_dense", "calendar_fill_distance", "price_ratio_8wk", "panel_flags", "series_stats",
    "rolling_weeks", "rolling_samesnap", "horizon_join", "regularise_roll_backward", "weekday_lag_roll",
    "level_sales_weight", "wrmsse_by_level", "submission_pivot", "holdout_eval",
    "profile_columns", "missing_share", "assoc_cramers_v", "spearman_pairs", "auc_ovr", "ecdf",
    "quantile_bins", "target_encode", "impute_median_mean_mode", "sparse_matrix_map",
    "importance_class", "importance_multi", "roc_curve", "class_metrics", "calibration_quantile",
    "panel_melt_roundtrip", "seasonal_decompose", "contribution_ledger",
    "ledger_class", "ledger_multiclass", "ledger_checks", "permutation_multiclass", "dependence_class",
    "pacf", "multiclass_scores", "spearman_cutoff", "feature_lists", "class_residuals", "sparse_matrix_keys",
]


@pytest.mark.parametrize("name", SUBSET)
def test_query_matches_oracle(spark, duck, name):
    import __spark_entry__ as entry
    sdf = entry.queries()[name](spark, SF_SMALL).toPandas()
    ddf = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(sdf.columns) == sorted(ddf.columns)
    assert len(sdf) == len(ddf)
    assert vhash(norm(sdf)) == vhash(norm(ddf))


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_smoke(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 12
    assert {"level", "wrmsse", "n_nodes"} <= set(df.columns)
