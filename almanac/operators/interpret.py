"""Model interpretation tables.

Contributions come in as a long table (row_id, target, variable, value);
for linear models they are exact: coef * (x - mean(x)), intercept =
b + sum(coef * mean(x)).  Every window here is partitioned by
(row_id, target), i.e. bounded by the number of features.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions.columns import inv_logit, isclose
from almanac.operators import lookup
from almanac.operators import ordered as od
from almanac.operators.modeling import Scorer
from almanac.operators.sampling import hash_order
from almanac.operators.transformers import active_positions
from almanac.session import cut_lineage


def linear_contributions(df: DataFrame, row_id: str, features: Sequence[str],
                         coefs: dict[str, dict[str, float]], intercepts: dict[str, float],
                         means: dict[str, Column] | None = None) -> DataFrame:
    """Per (row, target, variable) contribution coef * (x - baseline x) and the
    intercept row (b + sum coef * baseline).  The baseline defaults to the
    feature means (scalar subqueries over ``df``).

    ``coefs[target][feature]`` and ``intercepts[target]`` are model
    parameters (bounded by features x targets).
    """
    means = means or {f: df.select(F.avg(f)).scalar() for f in features}
    rows = []
    for t, cf in coefs.items():
        icpt = F.lit(float(intercepts[t]))
        for f in features:
            icpt = icpt + F.lit(float(cf[f])) * means[f]
        rows.append(F.struct(F.lit(t).alias("target"), F.lit("intercept").alias("variable"),
                             icpt.alias("shap_value"), F.lit(None).cast("double").alias("variable_value")))
        for f in features:
            rows.append(F.struct(F.lit(t).alias("target"), F.lit(f).alias("variable"),
                                 (F.lit(float(cf[f])) * (F.col(f) - means[f])).alias("shap_value"),
                                 F.col(f).cast("double").alias("variable_value")))
    return df.select(row_id, F.explode(F.array(*rows)).alias("s")).select(row_id, "s.*")


def marginal_model(df: DataFrame, targets: Mapping[str, Column], features: str = "features", scale: float = 1.0,
                   digits: float = 1e9) -> tuple[DataFrame, DataFrame]:
    """A linear model in closed form: every position's own least-squares slope on each
    target, and the intercept that makes the mean score the mean target.

    Returns (position, target, coef, mean, n) and (target, intercept), both from one pass over
    the entries that the vectors store.  ``scale`` shrinks the slopes; slopes and means are
    rounded to 1 / ``digits``.  A position that never varies has slope 0.
    """
    names = list(targets)
    y = {t: f"_y{k}" for k, t in enumerate(names)}
    d = df.select(features, *[c.cast("double").alias(y[t]) for t, c in targets.items()])
    e = active_positions(d, list(y.values()), features)
    sums = e.groupBy("position").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("_x"), F.sum(F.col("x") * F.col("x")).alias("_xx"),
                                     *[F.sum(F.col("x") * F.col(c)).alias(f"_x{c}") for c in y.values()])
    n_rows = d.select(F.count(F.lit(1)).cast("double")).scalar()
    y_mean = {t: d.select(F.avg(c)).scalar() for t, c in y.items()}
    sums = cut_lineage(sums, "marginals")

    def rounded_at(c: Column) -> Column:
        return F.floor(c * digits + 0.5) / digits

    mean = F.col("_x") / n_rows
    var = F.col("_xx") / n_rows - mean * mean
    rows = F.array(*[F.struct(F.lit(t).alias("target"), F.when(F.col("_var") > 1e-12, (F.col(f"_x{y[t]}") / n_rows - F.col("_mean") * y_mean[t]) / F.col("_var"))
                              .otherwise(F.lit(0.0)).alias("slope")) for t in names])
    long = sums.withColumns({"_mean": mean, "_var": var}).select("position", "n", rounded_at(F.col("_mean")).alias("mean"), F.explode(rows).alias("t"))
    coefs = cut_lineage(long.select("position", F.col("t.target").alias("target"), rounded_at(F.lit(scale) * F.col("t.slope")).alias("coef"), "mean", "n"), "coefs")
    own = F.lit(None).cast("double")
    for t in names:
        own = F.when(F.col("target") == t, y_mean[t]).otherwise(own)
    shift = coefs.groupBy("target").agg(F.sum(F.col("coef") * F.col("mean")).alias("_s"))
    return coefs, cut_lineage(shift.select("target", rounded_at(own - F.col("_s")).alias("intercept")), "intercepts")


def position_contributions(df: DataFrame, keys: Sequence[str], coefs: DataFrame, features: str = "features") -> DataFrame:
    """(keys..., target, position, shap_value) of a linear model at the entries that the
    vectors store: coef * x.  ``coefs`` is (position, target, coef, mean, n)."""
    by_position = coefs.groupBy("position").agg(F.first("n").alias("n"), F.collect_list(F.struct("target", "coef")).alias("_c"))  # a struct per target
    e = lookup.attach(active_positions(df, keys, features), cut_lineage(by_position, "coefs-by-position"), ["position"], "n", how="inner")
    return (e.select(*keys, "position", "x", F.explode("_c").alias("_c"))
            .select(*keys, F.col("_c.target").alias("target"), "position", (F.col("_c.coef") * F.col("x")).alias("shap_value")))


def sum_positions(contrib: DataFrame, keys: Sequence[str], position_map: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Contributions by position summed to (keys..., target, variable).

    ``counts`` (position, n) says how many rows each position has, up to a factor; it is counted if not given.
    """
    counts = counts if counts is not None else lookup.key_counts(contrib, ["position"], "n")
    named = cut_lineage(position_map.select("position", "variable").join(counts, "position"), "positions")
    return (lookup.attach(contrib, named, ["position"], "n", how="inner")
            .groupBy(*keys, "target", "variable").agg(F.sum("shap_value").alias("shap_value")))


def linear_contributions_onehot(df: DataFrame, key: str, coefs: DataFrame, intercepts: DataFrame, position_map: DataFrame,
                                metr: Sequence[str], cate: Sequence[str], features: str = "features") -> DataFrame:
    """Contributions (key, target, variable, shap_value, variable_value, variable_level) of a linear model
    over sparse vectors, one row per variable and one for the intercept.

    A variable's contribution is the sum of coef * (x - mean x) over its positions.  Only the stored entries are
    exploded; what the many empty positions of a one-hot variable contribute, minus the
    sum of coef * mean, is one number per variable and target.  Those numbers are
    attached to the row's own values, so a row has all its variables whether stored or not.
    """
    means = coefs.join(position_map.select("position", "variable"), "position")
    base = means.groupBy("target", "variable").agg(F.sum(F.col("coef") * F.col("mean")).alias("_base"))
    icpt = (intercepts.join(base.groupBy("target").agg(F.sum("_base").alias("_all")), "target", "left")
            .select("target", F.lit("intercept").alias("variable"), (F.col("intercept") + F.coalesce("_all", F.lit(0.0))).alias("_base")))
    base = F.broadcast(base.withColumn("_base", -F.col("_base")).unionByName(icpt))  # a row per variable and target
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    own = [F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("variable_value"), text.alias("variable_level")) for c in metr]
    own += [F.struct(F.lit(c).alias("variable"), none.alias("variable_value"), F.col(c).cast("string").alias("variable_level")) for c in cate]
    own.append(F.struct(F.lit("intercept").alias("variable"), none.alias("variable_value"), text.alias("variable_level")))
    rows = df.select(key, F.explode(F.array(*own)).alias("_v")).select(key, "_v.*").join(base, "variable").withColumnRenamed("_base", "shap_value")
    found = sum_positions(position_contributions(df, [key], coefs, features), [key], position_map, coefs.select("position", "n").distinct())
    found = found.withColumns({"variable_value": none, "variable_level": text})
    return (rows.unionByName(found, allowMissingColumns=True).groupBy(key, "target", "variable")
            .agg(F.sum("shap_value").alias("shap_value"), F.max("variable_value").alias("variable_value"), F.max("variable_level").alias("variable_level")))


def prior_ratio(shares: DataFrame, cls: str = "class") -> dict[str, float]:
    """X11 for one row at a time: b_all / b_sample by class (a row per class)."""
    return {str(r[cls]): r["r"] for r in shares.select(cls, (F.col("b_all") / F.col("b_sample")).alias("r")).collect()}


def rescaled_logit(score: str | Column, prior: Mapping[str, float] | None, positive: str = "1", negative: str = "0") -> Column:
    """Logistic link, with the class shares before undersampling if given."""
    p = inv_logit(score)
    if not prior:
        return p
    up, down = p * F.lit(float(prior[positive])), (1 - p) * F.lit(float(prior[negative]))
    return up / (up + down)


def rescaled_softmax(scores: Mapping[str, Column], prior: Mapping[str, float] | None) -> dict[str, Column]:
    """Softmax over the targets' scores, with the class shares before undersampling if given;
    shifted, so no score overflows."""
    top = F.greatest(*[F.coalesce(s, F.lit(float("-inf"))) for s in scores.values()]) if len(scores) > 1 else next(iter(scores.values()))
    nom = {t: F.exp(s - top) * F.lit(float(prior[t]) if prior else 1.0) for t, s in scores.items()}
    den = None
    for n in nom.values():
        den = n if den is None else den + n
    return {t: n / den for t, n in nom.items()}


def with_softmax(df: DataFrame, scores: Mapping[str, Column], prior: Mapping[str, float] | None, out: str = "yhat") -> DataFrame:
    """``df`` with the array ``out`` of ``rescaled_softmax`` over all targets, in the order of ``scores``.

    The largest score, the numerators and their sum are columns of their own: written out in one expression each would stand
    there dozens of times, in a generated method too long to be compiled.  Functions over the array would be interpreted."""
    names = list(scores)
    nom = [f"_nom_{k}" for k in range(len(names))]
    top = F.greatest(*[F.coalesce(s, F.lit(float("-inf"))) for s in scores.values()]) if len(names) > 1 else scores[names[0]]
    d = df.withColumn("_top", top)
    d = d.withColumns({n: F.exp(scores[t] - F.col("_top")) * F.lit(float(prior[t]) if prior else 1.0) for n, t in zip(nom, names, strict=True)})
    den = F.col(nom[0])
    for n in nom[1:]:
        den = den + F.col(n)
    d = d.withColumn("_den", den).withColumn(out, F.array(*[F.col(n) / F.col("_den") for n in nom]))
    return d.drop("_top", *nom, "_den")


def ledger(contrib: DataFrame, row_id: str, target_type: str = "REGR", prior: Mapping[str, float] | None = None, targets: Sequence[str] | None = None) -> DataFrame:
    """Sort each (row, target) ledger intercept first, then by |value|
    (ties by variable); cumulative value, rank and the prediction after each
    step.  REGR: yhat = cumulative value; CLASS: inv_logit of it;
    MULTICLASS: softmax over targets of every target's cumulative value taken
    in this target's order (J15: other targets' values at the same (row,
    variable) come from a window).  All windows are bounded by a row's entries and keep rows that were dealt by
    ``row_id`` where they are, so a caller who deals the rows before their contributions are made shuffles nothing else.
    ``targets`` saves a pass that lists them.

    ``prior`` (``prior_ratio``) rescales the probabilities of an undersampled fit; CLASS
    names its classes "1" and "0".
    """
    d = contrib.withColumns({
        "flag_intercept": (F.col("variable") == "intercept").cast("int"),
        "abs_shap_value": F.abs("shap_value"),
    })
    w = Window.partitionBy(row_id, "target").orderBy(F.col("flag_intercept").desc(),
                                                     F.col("abs_shap_value").desc(), F.col("variable"))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({"shap_value_cum": F.sum("shap_value").over(run), "rank": F.row_number().over(w)})
    if target_type == "REGR":
        return d.withColumn("yhat", F.col("shap_value_cum"))
    if target_type == "CLASS":
        return d.withColumn("yhat", rescaled_logit("shap_value_cum", prior))
    targets = targets or [r[0] for r in contrib.select("target").distinct().orderBy("target").collect()]  # class list
    beside = Window.partitionBy(row_id, "variable")
    d = d.withColumns({f"_sv_{t}": F.when(F.col(row_id).isNotNull(), F.max(F.when(F.col("target") == t, F.col("shap_value"))).over(beside)) for t in targets})
    each = rescaled_softmax({t: F.sum(f"_sv_{t}").over(run) for t in targets}, prior)
    own = F.lit(None).cast("double")
    for t in targets:
        own = F.when(F.col("target") == t, each[t]).otherwise(own)
    return d.withColumn("yhat", own).drop(*[f"_sv_{t}" for t in targets])


def keyed_contributions_onehot(df: DataFrame, key: str, coefs: DataFrame, intercepts: DataFrame, position_map: DataFrame,
                                metr: Sequence[str], cate: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """``linear_contributions_onehot``, and the targets, with one shuffle.

    The rows are dealt by key once, before anything is added to them; each feature looks up its level's coefficients where the
    row stands, and rows with equal keys are summed.
    """
    bias = {r["target"]: r["intercept"] for r in intercepts.orderBy("target").collect()}  # a row per target
    named = cut_lineage(coefs.join(position_map, "position"), "named-coefs")
    base = {(r["variable"], r["target"]): r["_base"] for r in named.groupBy("variable", "target").agg(F.sum(F.col("coef") * F.col("mean")).alias("_base")).collect()}  # variables x targets
    slope = {(r["variable"], r["target"]): r["coef"] for r in named.where(F.col("value").isNull()).collect()}  # metrics x targets
    d = df.select(key, *metr, *cate).repartition(od.default_buckets(df), F.col(key))
    for c in cate:
        own = (named.where((F.col("variable") == c) & F.col("value").isNotNull()).groupBy(F.col("value").alias("_level"))
               .agg(F.first("n").alias("_n"), F.map_from_entries(F.collect_list(F.struct("target", "coef"))).alias(f"_c_{c}")))
        d = lookup.attach(d.withColumn("_level", F.col(c).cast("string")), cut_lineage(own, "level-coefs"), ["_level"], "_n").drop("_level")
    sums, values = [], []
    for v in (*metr, *cate):
        x = F.coalesce(F.col(v).cast("double"), F.lit(float("nan"))) if v in metr else None
        for k, t in enumerate(bias):
            found = F.when(x != 0, F.lit(slope.get((v, t), 0.0)) * x).otherwise(F.lit(0.0)) if v in metr else F.col(f"_c_{v}")[t]
            sums.append(F.sum(found - F.lit(base.get((v, t), 0.0))).alias(f"_s_{v}_{k}"))
        values.append(F.max(F.col(v).cast("double" if v in metr else "string")).alias(f"_v_{v}"))
    rows = d.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"), *sums, *values)
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    start = [F.lit(b + sum(s for (_, u), s in base.items() if u == t)) * F.col("_rows") for t, b in bias.items()]
    each = [("intercept", none, text, F.array(*start))]
    each += [(v, F.col(f"_v_{v}") if v in metr else none, text if v in metr else F.col(f"_v_{v}"), F.array(*[F.col(f"_s_{v}_{k}") for k in range(len(bias))])) for v in (*metr, *cate)]
    entries = [F.struct(F.lit(t).alias("target"), F.lit(v).alias("variable"), sv[k].alias("shap_value"), x.alias("variable_value"), level.alias("variable_level"))
               for k, t in enumerate(bias) for v, x, level, sv in each]
    return rows.select(key, F.explode(F.array(*entries)).alias("_e")).select(key, "_e.*"), list(bias)


def ledger_check(led: DataFrame, pred: DataFrame, row_id: str, yhat: str = "p") -> DataFrame:
    """The final-rank prediction of each (row, target) against the model
    prediction (numpy ``isclose``); counts per target."""
    last = led.withColumn("_m", F.max("rank").over(Window.partitionBy(row_id, "target"))) \
        .where(F.col("rank") == F.col("_m"))
    j = last.join(pred, [row_id, "target"])
    return j.groupBy("target").agg(F.count(F.lit(1)).alias("n_rows"),
                                   F.sum((~isclose("yhat", yhat)).cast("int")).alias("n_mismatch"))


def linear_scores(df: DataFrame, coefs: DataFrame, intercepts: DataFrame, position_map: DataFrame, metr: Sequence[str], cate: Sequence[str],
                  out: str = "_score") -> tuple[DataFrame, list[str]]:
    """``df`` with a score column per target of a linear model over one-hot features, and the targets:
    the rows keep their place, each categorical feature looks up its level's coefficients."""
    bias = {r["target"]: r["intercept"] for r in intercepts.orderBy("target").collect()}  # a row per target
    named = coefs.join(position_map, "position")
    slope = {(r["variable"], r["target"]): r["coef"] for r in named.where(F.col("value").isNull()).collect()}  # metrics x targets
    for c in cate:
        each = [F.first(F.when(F.col("target") == t, F.col("coef")), ignorenulls=True).alias(f"_c_{c}_{k}") for k, t in enumerate(bias)]
        own = named.where((F.col("variable") == c) & F.col("value").isNotNull()).groupBy(F.col("value").alias("_level")).agg(F.first("n").alias("_n"), *each)
        df = lookup.attach(df.withColumn("_level", F.col(c).cast("string")), cut_lineage(own, "level-coefs"), ["_level"], "_n").drop("_level")
    scores = {}
    for k, (t, b) in enumerate(bias.items()):
        s = F.lit(b)
        for m in metr:
            s = s + F.lit(slope.get((m, t), 0.0)) * F.col(m)
        for c in cate:
            s = s + F.col(f"_c_{c}_{k}")
        scores[f"{out}_{t}"] = s
    return df.withColumns(scores).drop(*[f"_c_{c}_{k}" for c in cate for k in range(len(bias))]), list(bias)


# ---------------------------------------------------------------------------
# Permutation importance; E16: partial dependence
# ---------------------------------------------------------------------------
# ``predict`` takes a frame with the features (and other columns, which it keeps) and adds
# ``yhat``: a number, or for MULTICLASS an array of class probabilities.
Predict = Callable[[DataFrame], DataFrame]
ORIGINAL = ""  # the variant without a permuted feature


def shared_permutation(df: DataFrame, key: str, features: Sequence[str], seed: int = 42) -> DataFrame:
    """Every row with, beside its own features, ``_perm_<feature>`` of the row that takes its
    place in one permutation, the same for all features: the row at position i in key order gets
    the values of the row at position i in hash order.

    Both positions are distributed row numbers; rows with equal keys are told apart by their other columns, and the
    two tables meet once, on the position.
    """
    rest = [c for c in df.columns if c != key]
    own = od.global_row_number(df, [F.col(key), *map(F.col, rest)], out="_pos")
    moved = df.withColumn("_h", hash_order([key], seed))
    moved = od.global_row_number(moved, [F.col("_h"), F.col(key), *map(F.col, rest)], out="_pos")
    return own.join(moved.select("_pos", *[F.col(f).alias(f"_perm_{f}") for f in features]), "_pos").drop("_pos")


def permute_column(df: DataFrame, col: str, key: str, seed: int = 42) -> DataFrame:
    """``shared_permutation`` of one column, in its place."""
    moved = shared_permutation(df.select(key, *[c for c in df.columns if c != key]), key, [col], seed)
    return moved.withColumn(col, F.col(f"_perm_{col}")).select(df.columns)


def permutation_importance(df: DataFrame, features: Sequence[str], key: str, y: str, predict: Predict, scorer: Scorer, seed: int = 42) -> DataFrame:
    """(variable, score_orig, importance): what the score loses when a feature's values are
    permuted, floored at 0.

    The permuted rows are written once; each row then stands for its original and for one variant per
    feature, all variants are predicted as one frame and scored in one pass.
    """
    base = cut_lineage(shared_permutation(df.select(key, y, *features), key, features, seed), "permuted")
    variants = [F.struct(F.lit(v).alias("_variant"), *[F.col(f"_perm_{f}" if f == v else f).alias(f) for f in features]) for v in (ORIGINAL, *features)]
    long = base.select(key, y, F.explode(F.array(*variants)).alias("_v")).select(key, y, "_v.*")
    scores = cut_lineage(scorer.fn(predict(long), y, "yhat", ["_variant"]).select("_variant", "value"), "variant-scores")  # a row per feature
    orig = scores.where(F.col("_variant") == ORIGINAL).select("value").scalar()
    loss = orig - F.col("value") if scorer.greater_is_better else F.col("value") - orig
    return (scores.where(F.col("_variant") != ORIGINAL)
            .select(F.col("_variant").alias("variable"), orig.alias("score_orig"), F.greatest(F.lit(0.0), loss).alias("importance")))


def dependence_grid(df: DataFrame, feature: str, quantiles: Sequence[float] | None = None) -> DataFrame:
    """(value): exact quantiles of a metric, or with ``quantiles`` None the levels of a feature."""
    if quantiles is None:
        return df.select(F.col(feature).alias("value")).dropna().distinct()
    return od.exact_quantiles(df, feature, quantiles).select(F.col("quantile").alias("value")).distinct()


def partial_dependence(df: DataFrame, feature: str, others: Sequence[str], grid: DataFrame, predict: Predict, classes: Sequence[str] | None = None) -> DataFrame:
    """(feature, value, target, yhat_mean): the mean prediction with ``feature`` set to each value of ``grid``.

    The mean over all rows needs each combination of the other features only once, weighted by its rows:
    those are counted first (in each task, before the shuffle), and the copies made for the grid are of
    combinations, not of rows.  Numbers are returned as text in ``value``.  With ``classes``, ``yhat`` is an array
    and each class a target.
    """
    distinct = df.groupBy(*others).agg(F.count(F.lit(1)).cast("double").alias("_w"))
    values = grid.agg(F.array_sort(F.collect_list("value"))).scalar()  # quantiles, or the levels of one feature
    pred = predict(distinct.withColumn(feature, F.explode(values)))
    if classes is None:
        pred = pred.select(feature, "_w", F.lit("target").alias("target"), F.col("yhat").alias("_p"))
    else:
        each = F.explode(F.arrays_zip(F.array(*map(F.lit, classes)).alias("target"), F.col("yhat").alias("_p")))
        pred = pred.select(feature, "_w", each.alias("_e")).select(feature, "_w", "_e.target", "_e._p")
    return (pred.groupBy(feature, "target").agg((F.sum(F.col("_w") * F.col("_p")) / F.sum("_w")).alias("yhat_mean"))
            .select(F.lit(feature).alias("feature"), F.col(feature).cast("string").alias("value"), "target", "yhat_mean"))
