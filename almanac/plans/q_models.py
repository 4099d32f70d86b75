"""Catalogue: model fitting, forecasting and model-based interpretation
(step 10: M1-M12, E14, E16, E19, E20, A22).  No SQL oracle: learners differ
from the reference's, so these are rows-only checks plus pytest properties.

Model fits read the full tables; only the ensemble sizes are kept small
(a tuning parameter, not a data cap).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import partial, reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.operators import interpret as ip
from almanac.operators import modeling as md
from almanac.operators import sampling as sp
from almanac.operators import timeseries as ts
from almanac.operators.evaluation import importance_table
from almanac.operators.transformers import TargetRankEncoder
from almanac.plans import forecast as fc
from almanac.plans import panel as pl
from almanac.plans.q_stats import scored_docs
from almanac.plans.registry import ds, register
from almanac.sources import fixtures as fx
from almanac.session import cut_lineage
from almanac.sources.tables import read_table


DAY_FEATURES = ["dayofweek", "snap", "sell_price", "price_ratio_to_8week_rolling", "sell_price_isna",
                "event", "holiday", "days_before_event", "days_after_event"]
TS_FEATURES = ["demand_lag0", "demand_lag6", "demand_mean1week", "demand_mean4week", "demand_mean12week"]
SWD_STEM = "demand_mean4week_sameweekday_samesnap"
SWD_FEATURES = ["demand_mean4week_sameweekday", SWD_STEM]
FEATURES = DAY_FEATURES + TS_FEATURES + SWD_FEATURES
#: Categories of a series, as ranks of their mean demand in the burned year.
CATE_FEATURES = [f"{c}_ENCODED" for c in fx.HIERARCHY]
TREE_FEATURES = FEATURES + CATE_FEATURES
WEEKDAYS = 7


@dataclass(frozen=True)
class HorizonFeatures:
    """Everything that does not depend on the horizon, one row per series (written).

    ``levels`` has the number of levels of each nominal feature.
    """

    series: DataFrame
    levels: dict[str, int]

    def rows(self, shift: int | Callable, weeks: int | Callable, where: Callable, own: Sequence[str] = ("date", "fold", "myfold", "demand"), beside: Sequence[str] = ()) -> DataFrame:
        """Days with the features of ``shift`` days earlier (``weeks``: of whole weeks earlier)."""
        flags = [f"{SWD_STEM}0", f"{SWD_STEM}1"]
        g = ts.shifted_rows(self.series, [*own, *DAY_FEATURES], dict.fromkeys(TS_FEATURES, shift) | dict.fromkeys([SWD_FEATURES[0], *flags], weeks),
                            [*CATE_FEATURES, "w"], where=where, beside=beside)
        return md.assemble(ts.pick_by_flag(g, SWD_STEM).withColumn("label", F.col("demand")), TREE_FEATURES, levels=self.levels)

    def horizon(self, h: int) -> DataFrame:
        """Train days with demand, and all test days, as they are seen h days before."""
        return self.rows(h, ts.week_rounded(h), lambda d, i: (d["fold"] == "test") | d["demand"].isNotNull())

    def drawn(self, h: int) -> DataFrame:
        """The train days of the bootstrap sample, with how often each was drawn, as they are seen h days before."""
        out = self.rows(h, ts.week_rounded(h), lambda d, i: (d["fold"] == "train") & d["demand"].isNotNull() & (F.get(F.col("boot"), i) > 0), ["demand"], ["boot"])
        return out.select("label", "boot", "features")

    def test_days(self, first_day: str) -> DataFrame:
        """Each test day at its own horizon (column ``horizon``): day 1 is seen one day before, day 28 four weeks before."""
        def h(d):
            return F.datediff(d["date"], F.to_date(F.lit(first_day))) + 1
        out = self.rows(h, lambda d: (F.floor((h(d) - 1) / 7).cast("int") + 1) * 7, where=lambda d, i: d["fold"] == "test")
        return out.withColumn("horizon", F.datediff("date", F.to_date(F.lit(first_day))) + 1)


def horizon_features(spark, sf_dir) -> HorizonFeatures:
    """The panel's features, computed and written once as one row per series: a horizon's frame
    is read off that row by position, so neither the panel nor its windows run again
    however many horizons are modelled.

    Categories get the rank of their mean demand (X3), fitted on the burned first year (P12).
    ``boot`` is the row's multiplicity in a bootstrap weighted by the root of the series'
    sales (T6), the same draw for every horizon; ``w`` the weight by inverse error.
    """
    spec = fx.panel_spec(spark, sf_dir)
    b = pl.null_rules(pl.weighted_panel(pl.base_panel(spark, sf_dir)))
    b = b.withColumn("dayofweek", F.weekday("date"))
    f = ts.add_lags(b, ["demand"], [0, 6])
    f = ts.add_rolling_weeks(f, {"demand": {1: ("mean",), 4: ("mean",), 12: ("mean",)}})
    f = ts.add_sameweekday(f, weeks=(4,), aggs=("mean",))
    f = ts.add_samesnap(f, weeks=(4,))
    stems = [SWD_FEATURES[0], f"{SWD_STEM}0", f"{SWD_STEM}1"]
    cols = ["date", "fold", "myfold", "demand", *DAY_FEATURES, *TS_FEATURES, *stems]
    series = cut_lineage(ts.series_table(f.select("id", *fx.HIERARCHY, "weight_rmse", "weight_sales", ts.DAYNO, *cols), cols, [*fx.HIERARCHY, "weight_rmse", "weight_sales"]), "series")

    days = series.select("id", *fx.HIERARCHY, "weight_sales", F.inline(F.transform("days", lambda d: F.struct(d["date"].alias("date"), d["fold"].alias("fold"), d["demand"].alias("demand")))))
    days = cut_lineage(days, "days")  # what the encoder and the bootstrap read of the wide rows
    burned = days.withColumn("encode_flag", (F.col("date") < F.to_date(F.lit(spec.util_before))).cast("int"))
    # a category's mean from its series' sums: no row of the panel is copied per category
    sums = burned.groupBy("id", "encode_flag").agg(*[F.first(c).alias(c) for c in fx.HIERARCHY], F.sum("demand").alias("_s"), F.count("demand").alias("_n"))
    encoder = TargetRankEncoder(list(fx.HIERARCHY), "encode_flag", "_s", weight="_n").fit(sums)
    levels = {f"{r['variable']}_ENCODED": r["n"] for r in encoder.ranks.groupBy("variable").agg(F.count(F.lit(1)).alias("n")).collect()}
    coded = encoder.transform(series).withColumns({c: md.rank_index(c, levels[c]) for c in CATE_FEATURES})

    train = days.where((F.col("fold") == "train") & F.col("demand").isNotNull())
    total = train.agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.sqrt("weight_sales")).alias("w")).first()  # two numbers
    per_row = F.sqrt("weight_sales") * F.lit(total["n"]) / F.nullif(F.lit(total["w"]).cast("double"), F.lit(0.0))
    drawn = days.select("id", "date", sp.poisson_count(F.coalesce(per_row, F.lit(0.0)), ["id", "date"], seed=2).alias("boot"))
    boot = drawn.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("date", F.col("boot").cast("double").alias("boot")))).alias("_boot")).select("id", F.col("_boot.boot").alias("boot"))
    coded = md.normalised_weight(coded, "weight_rmse").join(boot, "id")
    levels["dayofweek"] = WEEKDAYS
    return HorizonFeatures(cut_lineage(coded.select("id", *CATE_FEATURES, "w", "boot", "days"), "features"), levels)


# --- fit_gbt_regr / fit_poisson: M1, M3 ------------------------------------------
@register("fit_gbt_regr")
def fit_gbt_regr(spark, sf_dir):
    """Weighted boosted trees at horizon 28; predictions on the inner test fold."""
    hf = horizon_features(spark, sf_dir)
    fr = hf.horizon(28)
    tr = fr.where((F.col("myfold") == "train") & F.col("demand").isNotNull())
    m = md.gbt_regressor(n_trees=10, depth=4, weight="w", levels=hf.levels).fit(tr)
    te = fr.where(F.col("myfold") == "test")
    return m.transform(te).select("id", ds("date").alias("date"), "demand", F.col("prediction").alias("yhat"))


@register("fit_poisson")
def fit_poisson(spark, sf_dir):
    fr = md.assemble(horizon_features(spark, sf_dir).horizon(28).drop("features"), FEATURES)
    tr = fr.where((F.col("myfold") == "train") & F.col("demand").isNotNull())
    m = md.poisson_glm(0.01).fit(tr)
    te = fr.where(F.col("myfold") == "test")
    return m.transform(te).select("id", ds("date").alias("date"), "demand", F.col("prediction").alias("yhat"))


# --- forecast_single / forecast_direct: M6, M7, U1, P20 ---------------------------
def _fit_drawn(hf, h: int, n_trees: int):
    """Trees on the bootstrap sample at one horizon.  The learner reads its input three times before it keeps its own
    form of it; the rows are expanded once."""
    rows = hf.drawn(h).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return md.gbt_regressor(n_trees=n_trees, depth=4, weight="boot", levels=hf.levels).fit(rows)
    finally:
        rows.unpersist()


@register("forecast_single")
def forecast_single(spark, sf_dir):
    """One model for the whole 28-day test period (horizon 28), floored."""
    hf = horizon_features(spark, sf_dir)
    m = _fit_drawn(hf, 28, 10)
    p = m.transform(hf.rows(28, 28, lambda d, i: d["fold"] == "test"))
    return p.select("id", ds("date").alias("date"),
                    fc.floor_prediction(F.col("prediction"), F.col("sell_price_isna")).alias("yhat"))


DIRECT_H = list(range(1, 29))


@register("forecast_direct")
def forecast_direct(spark, sf_dir):
    """One model per horizon h, fitted on a weighted bootstrap, each scoring only day test_start + h - 1;
    several models are fitted at a time, and the test days of all horizons are one written table."""
    hf = horizon_features(spark, sf_dir)
    models = md.fit_all([lambda h=h: _fit_drawn(hf, h, 5) for h in DIRECT_H])
    test = hf.test_days(fx.panel_spec(spark, sf_dir).test_start)
    test = cut_lineage(test.drop("features"), "test-days")
    parts = []
    for h, m in zip(DIRECT_H, models, strict=True):
        p = m.transform(md.assemble(test.where(F.col("horizon") == h), TREE_FEATURES, levels=hf.levels))
        parts.append(p.select("id", ds("date").alias("date"), "horizon", fc.floor_prediction(F.col("prediction"), F.col("sell_price_isna")).alias("yhat")))
    return reduce(DataFrame.unionByName, parts)


# --- fit_gbt_class / fit_mlp: M2, M5 --------------------------------------------
DOC_CATE = ["lang", "source"]


def _doc_frame(spark, sf_dir):
    """Labelled documents with two categories as ranks, marked nominal, and their numbers of levels."""
    d = scored_docs(spark, sf_dir).withColumns({"label": F.col("quality").cast("double"), "log_chars": F.log1p("n_chars"), "_all": F.lit(1)})
    encoder = TargetRankEncoder(DOC_CATE, "_all", "label", suffix="_idx").fit(d)
    levels = {f"{r['variable']}_idx": r["n"] for r in encoder.ranks.groupBy("variable").agg(F.count(F.lit(1)).alias("n")).collect()}
    d = encoder.transform(d).withColumns({f"{c}_idx": md.rank_index(f"{c}_idx", levels[f"{c}_idx"]) for c in DOC_CATE})
    return md.assemble(d, ["log_chars", *levels], levels=levels), levels


@register("fit_gbt_class")
def fit_gbt_class(spark, sf_dir):
    d, levels = _doc_frame(spark, sf_dir)
    m = md.gbt_classifier(n_trees=10, depth=3, levels=levels).fit(d)
    return md.p_class1(m.transform(d)).select("doc_id", "quality", "p")


@register("fit_mlp")
def fit_mlp(spark, sf_dir):
    d, _ = _doc_frame(spark, sf_dir)
    m = md.mlp(3, (8,), 2, 50).fit(d)
    return md.p_class1(m.transform(d)).select("doc_id", "quality", "p")


# --- fit_lasso: M4 ----------------------------------------------------------------
def order_frame(spark, sf_dir):
    """orders with per-order line aggregates as regression features; key o_orderkey."""
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount"])
    agg = li.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("qty"), F.avg("l_discount").alias("disc"),
                                       F.count(F.lit(1)).alias("n_lines"), F.sum("l_extendedprice").alias("gross"))
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_totalprice", "o_orderdate"])
    d = o.join(agg, o.o_orderkey == agg.l_orderkey).drop("l_orderkey")
    return d.withColumns({"label": F.col("gross") * (1 - F.col("disc")),
                          "fold": F.when(F.year("o_orderdate") >= 2000, "test").otherwise("train")})


ORDER_FEATURES = ["qty", "disc", "n_lines"]


@register("fit_lasso")
def fit_lasso(spark, sf_dir):
    d = md.assemble(order_frame(spark, sf_dir), ORDER_FEATURES)
    m = md.lasso(0.01).fit(d.where(F.col("fold") == "train"))
    return m.transform(d).select("o_orderkey", "label", F.col("prediction").alias("yhat"))


# --- grid_prefix_scores / cv_summary / gengap: M8, A22, E19, M10 -----------------
GRID = md.product_grid({"depth": [2, 4], "min_rows": [1, 10], "subsample": [0.5, 1.0]})
SIZES = [1, 2, 3, 4, 5, 6]
SPLITS = 5
WORKERS = 8


def _cv_folds(d, key: str):
    """Train/test-separated splits, written with what a fit reads."""
    return cut_lineage(sp.cv_split(d.select(key, "fold", "label", "features"), [key], n_splits=SPLITS), "cv_folds")


def _cv_orders(spark, sf_dir):
    """What the folds and fits read of the orders, written."""
    return cut_lineage(md.assemble(order_frame(spark, sf_dir), ORDER_FEATURES).select("o_orderkey", "fold", "label", "features"), "order-frame")


def _cv_table(spark, sf_dir, orders=None):
    folds = _cv_folds(orders if orders is not None else _cv_orders(spark, sf_dir), "o_orderkey")
    return md.grid_prefix_scores(folds, GRID, SIZES, "REGR", workers=WORKERS)


@register("grid_prefix_scores")
def grid_prefix_scores(spark, sf_dir):
    """Grid x split x ensemble size: one fit per grid point and split with the
    largest size, every prefix scored by the REGR scorers.  Fits and scores read cells of binned features."""
    return _cv_table(spark, sf_dir)


@register("cv_summary")
def cv_summary(spark, sf_dir):
    return md.cv_summary(_cv_table(spark, sf_dir))


@register("gengap")
def gengap(spark, sf_dir):
    return md.generalisation_gap(_cv_table(spark, sf_dir))


@register("cv_facets")
def cv_facets(spark, sf_dir):
    """Mean Spearman by each value of each grid parameter and ensemble size."""
    return md.facet_means(_cv_table(spark, sf_dir), "spear")


def _best(summary, task: str, scorer: str):
    best = md.best_row(summary, next(sc for sc in md.SCORERS[task] if sc.name == scorer)).first()
    return best, next(p for p in GRID if md.params_key(p) == best["params"])


@register("grid_best_refit")
def grid_best_refit(spark, sf_dir):
    """The grid's best row by mean test Spearman, refitted on all train orders
    with its parameters and size; predictions of the test orders."""
    d = _cv_orders(spark, sf_dir)
    best, params = _best(md.cv_summary(_cv_table(spark, sf_dir, d)), "REGR", "spear")
    m = md.gbt_regressor(n_trees=best["n_trees"], **params).fit(d.where(F.col("fold") == "train"))
    return m.transform(d.where(F.col("fold") == "test")).select(
        "o_orderkey", "label", F.col("prediction").alias("yhat"), F.lit(best["params"]).alias("params"), F.lit(best["n_trees"]).alias("n_trees"))


def _class_folds(spark, sf_dir):
    d, levels = _doc_frame(spark, sf_dir)
    d = sp.shuffle_split(d, ["doc_id"], 0.2).withColumnRenamed("role", "fold")
    return d, levels


def _class_grid(spark, sf_dir):
    """Frame, levels and CV scores of the grid of boosted classifiers."""
    d, levels = _class_folds(spark, sf_dir)
    make = partial(md.gbt_classifier, levels=levels)
    return d, levels, md.grid_prefix_scores(_cv_folds(d, "doc_id"), GRID, SIZES, "CLASS", make, workers=WORKERS)


@register("grid_class_summary")
def grid_class_summary(spark, sf_dir):
    """The same search for a classifier: AUC and accuracy of every grid point and size."""
    return md.cv_summary(_class_grid(spark, sf_dir)[2])


@register("grid_class_refit")
def grid_class_refit(spark, sf_dir):
    """The classifier grid's best row by mean test AUC, refitted on all train rows; probabilities of the test rows."""
    d, levels, cv = _class_grid(spark, sf_dir)
    best, params = _best(md.cv_summary(cv), "CLASS", "auc")
    m = md.gbt_classifier(n_trees=best["n_trees"], levels=levels, **params).fit(d.where(F.col("fold") == "train"))
    return md.p_class1(m.transform(d.where(F.col("fold") == "test"))).select(
        "doc_id", F.col("label").cast("int").alias("label"), "p", F.lit(best["params"]).alias("params"), F.lit(best["n_trees"]).alias("n_trees"))


# --- cv_compare / model_comparison / learning_curve: M9, E20, M11 ----------------
@register("cv_compare")
def cv_compare(spark, sf_dir):
    """Models compared on the same train/test-separated splits (long form).  The splits read
    the orders several times (totals, order of the hashes, rows), so the aggregate is written once, and slim."""
    d = cut_lineage(md.assemble(order_frame(spark, sf_dir), ORDER_FEATURES).select("o_orderkey", "fold", "label", "features"), "cv-orders")
    folds = cut_lineage(sp.cv_split(d, ["o_orderkey"], n_splits=3), "cv_folds")
    learners = {"lasso": lambda: md.lasso(0.01), "gbt": lambda: md.gbt_regressor(5, 3),
                "poisson": lambda: md.poisson_glm(0.01)}
    runs = [(name, s) for name in learners for s in range(3)]
    models = md.fit_all([lambda name=name, s=s: learners[name]().fit(folds.where((F.col("split") == s) & (F.col("role") == "train"))) for name, s in runs])
    preds = [m.transform(folds.where((F.col("split") == s) & (F.col("role") == "test"))).select(F.lit(name).alias("model"), F.lit(s).alias("run"), "label", "prediction")
             for (name, s), m in zip(runs, models, strict=True)]
    preds = cut_lineage(reduce(DataFrame.unionByName, preds), "cv-predictions")
    scores = md.score_table(preds, "label", "prediction", [sc for sc in md.SCORERS["REGR"] if sc.name != "pear"], ["model", "run"])
    return (scores.groupBy("model", "run").pivot("scorer", ["rmse", "spear"]).agg(F.first("value"))
            .withColumnsRenamed({"rmse": "test_score", "spear": "test_spear"}))


@register("model_comparison")
def model_comparison(spark, sf_dir):
    return md.model_comparison(cut_lineage(cv_compare(spark, sf_dir), "cv-runs"), "model", "test_score")


@register("model_runs")
def model_runs(spark, sf_dir):
    """E20's lines: every run's score for each model."""
    return md.run_lines(cut_lineage(cv_compare(spark, sf_dir), "cv-runs"))


@register("learning_curve")
def learning_curve(spark, sf_dir):
    """Nested training subsets (5% .. 100%) -> train and test score per size; the fits run
    side by side, and all of them are scored in one pass."""
    d = md.assemble(order_frame(spark, sf_dir), ORDER_FEATURES)
    sizes = [round(0.05 + i * 0.95 / 9, 4) for i in range(10)]
    d = cut_lineage(d.withColumn("_u", sp.hash_uniform(["o_orderkey"], 1)).select("o_orderkey", "fold", "label", "features", "_u"), "curve")
    train = d.where(F.col("fold") == "train")
    models = md.fit_all([lambda s=s: md.lasso(0.01).fit(train.where(F.col("_u") <= s)) for s in sizes])
    out = d
    for k, m in enumerate(models):
        out = m.setPredictionCol(f"_p{k}").transform(out)
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("train_size"), F.col(f"_p{k}").alias("p")) for k, s in enumerate(sizes)]))
    out = out.select("fold", "label", "_u", each.alias("s")).select("fold", "label", "_u", "s.*")
    used = (F.col("fold") == "train") & (F.col("_u") <= F.col("train_size"))
    err = F.pow(F.col("label") - F.col("p"), 2)
    return out.groupBy("train_size").agg(F.count(F.when(used, 1)).alias("n_train"), F.sqrt(F.avg(F.when(used, err))).alias("train_rmse"),
                                         F.sqrt(F.avg(F.when(F.col("fold") == "test", err))).alias("test_rmse"))


# --- permutation_importance / partial_dependence: E14, E16 -------------------------
def _fitted_lasso(spark, sf_dir):
    d = order_frame(spark, sf_dir)
    m = md.lasso(0.01).fit(md.assemble(d.where(F.col("fold") == "train"), ORDER_FEATURES))
    return d, lambda x: m.transform(md.assemble(x, ORDER_FEATURES)).withColumn("yhat", F.col("prediction"))


@register("permutation_importance")
def permutation_importance(spark, sf_dir):
    """Score drop (RMSE increase) per permuted feature on the test orders,
    scaled and banded as an importance table."""
    d, predict = _fitted_lasso(spark, sf_dir)
    te = d.where(F.col("fold") == "test")
    rmse = next(sc for sc in md.SCORERS["REGR"] if sc.name == "rmse")
    return importance_table(ip.permutation_importance(te, ORDER_FEATURES, "o_orderkey", "label", predict, rmse))


@register("partial_dependence")
def partial_dependence(spark, sf_dir):
    """Mean prediction with each feature overwritten by its deciles."""
    d, predict = _fitted_lasso(spark, sf_dir)
    parts = [ip.partial_dependence(d, f, [g for g in ORDER_FEATURES if g != f], ip.dependence_grid(d, f, [i / 10 for i in range(11)]), predict) for f in ORDER_FEATURES]
    return reduce(DataFrame.unionByName, parts).select("feature", F.col("value").cast("double").alias("value"), "yhat_mean")
