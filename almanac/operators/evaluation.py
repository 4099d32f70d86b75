"""Evaluation and univariate-importance tables.

Curves are built from one row per distinct score with running class counts
(``ordered.cumulative``, descending), so every threshold is kept and nothing
is ordered on a single task.  Univariate importance works on level tables:
rows that share a level share its score, so the AUC of "level mean as score"
is computed from per-level class counts without joining the score back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions.columns import cut
from almanac.operators import lookup
from almanac.operators import ordered as od
from almanac.operators import stats as st
from almanac.operators.transformers import QuantileBinner, bins_by_edges
from almanac.session import cut_lineage

# Sklearn 0.22 calibration edges are linspace(0, 1 + 1e-8, n + 1),
# digitised left-closed; quantile edges get 1e-8 added to the last one.
CALIB_EPS = 1e-8


# ---------------------------------------------------------------------------
# curves
# ---------------------------------------------------------------------------
def _desc_counts(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    return od.cumulative(df.where(F.col(y).isNotNull()), score,
                         {"pos": F.sum(F.col(y).cast("double")),
                          "neg": F.sum(F.lit(1.0) - F.col(y).cast("double"))},
                         by=by, descending=True)


def _share(part: str, total: str) -> Column:
    """part / total; null if the class has no rows."""
    return F.col(part) / F.nullif(F.col(total), F.lit(0.0))


def roc_curve(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """E5: (threshold, fpr, tpr) for every distinct score (no point dropped);
    a rate is null where its class has no rows."""
    c = _desc_counts(df, y, score, by)
    return c.select(*by, F.col("value").alias("threshold"),
                    _share("cum_neg", "tot_neg").alias("fpr"),
                    _share("cum_pos", "tot_pos").alias("tpr"))


def pr_curve(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """E9 + E10: precision, recall and share of rows tested (score >= t)."""
    c = _desc_counts(df, y, score, by)
    n_at = F.col("cum_pos") + F.col("cum_neg")
    return c.select(*by, F.col("value").alias("threshold"),
                    (F.col("cum_pos") / n_at).alias("precision"),
                    _share("cum_pos", "tot_pos").alias("recall"),
                    (n_at / (F.col("tot_pos") + F.col("tot_neg"))).alias("pct_tested"),
                    (_share("pos", "tot_pos") * F.col("cum_pos") / n_at).alias("_ap_term"))


def average_precision(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """AP = sum over thresholds of (R_i - R_{i-1}) * P_i."""
    return pr_curve(df, y, score, by).groupBy(*by).agg(F.sum("_ap_term").alias("average_precision"))


# ---------------------------------------------------------------------------
# Class tables from a long (row, class, p) table
# ---------------------------------------------------------------------------
def predicted_class(probs: DataFrame, row: str, cls: str = "class", p: str = "p") -> DataFrame:
    """argmax per row, ties to the first class."""
    w = Window.partitionBy(row).orderBy(F.col(p).desc(), F.col(cls))
    return probs.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(row, F.col(cls).alias("pred"))


def confusion(labels: DataFrame, y: str, pred: str, classes: Sequence) -> DataFrame:
    """Counts per (true, predicted) as a matrix with every class column
    (explicit pivot values), plus the true-class frequency and share."""
    m = labels.groupBy(y).pivot(pred, list(classes)).agg(F.count(F.lit(1))).fillna(0)
    tot = labels.select(F.count(F.lit(1))).scalar()
    freq = labels.groupBy(y).agg(F.count(F.lit(1)).alias("n_true"))
    return m.join(freq, y).withColumn("pct_true", F.col("n_true") / tot)


def class_metrics(labels: DataFrame, probs: DataFrame, row: str, y: str, pred: str,
                  cls: str = "class", p: str = "p") -> DataFrame:
    """Per class precision, recall, F1 (unrounded), one-vs-rest AUC."""
    tp = labels.where(F.col(y) == F.col(pred)).groupBy(F.col(y).alias(cls)).agg(F.count(F.lit(1)).alias("tp"))
    n_true = labels.groupBy(F.col(y).alias(cls)).agg(F.count(F.lit(1)).alias("n_true"))
    n_pred = labels.groupBy(F.col(pred).alias(cls)).agg(F.count(F.lit(1)).alias("n_pred"))
    d = (probs.select(row, cls, p).join(labels.select(row, y), row)
         .withColumn("_y", (F.col(cls) == F.col(y)).cast("double")))
    aucs = st.auc(d, "_y", p, by=[cls])
    m = (n_true.join(n_pred, cls, "full_outer").join(tp, cls, "left").join(aucs, cls, "left")
         .fillna(0, ["tp", "n_true", "n_pred"]))
    prec = F.col("tp") / F.nullif(F.col("n_pred"), F.lit(0))
    rec = F.col("tp") / F.nullif(F.col("n_true"), F.lit(0))
    return m.select(cls, "n_true", "n_pred", prec.alias("precision"), rec.alias("recall"),
                    (2 * prec * rec / F.nullif(prec + rec, F.lit(0.0))).alias("f1"), "auc")


def auc_summary(metrics: DataFrame) -> DataFrame:
    """Mean AUC and class-frequency-weighted AUC."""
    return metrics.agg(F.avg("auc").alias("auc_mean"),
                       (F.sum(F.col("auc") * F.col("n_true")) / F.sum("n_true")).alias("auc_weighted"))


def topk_accuracy(probs: DataFrame, labels: DataFrame, row: str, y: str, ks: Sequence[int] = (1, 2, 3),
                  cls: str = "class", p: str = "p") -> DataFrame:
    """Per true class, share of rows whose class is among the top-k."""
    w = Window.partitionBy(row).orderBy(F.col(p).desc(), F.col(cls))
    r = probs.select(row, cls, p).withColumn("_rk", F.row_number().over(w)).join(labels.select(row, y), row)
    hit = r.groupBy(row, y).agg(*[F.max(((F.col(cls) == F.col(y)) & (F.col("_rk") <= k)).cast("int"))
                                  .alias(f"acc_top{k}") for k in ks])
    return hit.groupBy(y).agg(*[F.avg(f"acc_top{k}").alias(f"acc_top{k}") for k in ks])


# ---------------------------------------------------------------------------
# calibration
# ---------------------------------------------------------------------------
def calibration_uniform(df: DataFrame, y: str, p: str, n_bins: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """E7 (binary): bins over [0, 1 + 1e-8] left-closed; empty bins dropped."""
    edges = [i * (1.0 + CALIB_EPS) / n_bins for i in range(1, n_bins)]
    b = F.lit(0)
    for e in edges:
        b = b + (F.col(p) >= F.lit(e)).cast("int")
    return (df.groupBy(*by, b.alias("bin"))
            .agg(F.avg(p).alias("p_mean"), F.avg(F.col(y).cast("double")).alias("y_mean"),
                 F.count(F.lit(1)).alias("n")))


def calibration_quantile(df: DataFrame, y: str, p: str, n_bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """E7 (multiclass): edges at exact quantiles of p, last edge + 1e-8,
    left-closed: bin = #(inner edges <= p)."""
    probs = [i / n_bins for i in range(n_bins + 1)]
    q = od.exact_quantiles(df, p, probs, by=by)
    edges = q.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("prob", "quantile"))).alias("_e")) \
        .select(*by, F.transform("_e", lambda s: s["quantile"]).alias("_edges"))
    if by:
        edges = cut_lineage(edges.join(lookup.key_counts(df, list(by)), list(by)), "edges")
        d = lookup.attach(df, edges, list(by), "_count", how="inner")
    else:
        d = df.withColumn("_edges", edges.select("_edges").scalar())
    inner = F.slice(F.col("_edges"), 2, n_bins - 1)
    b = F.size(F.filter(inner, lambda e: e <= F.col(p)))
    return (d.groupBy(*by, b.alias("bin"))
            .agg(F.avg(p).alias("p_mean"), F.avg(F.col(y).cast("double")).alias("y_mean"),
                 F.count(F.lit(1)).alias("n")))


def calibration_decile(df: DataFrame, y: str, yhat: str, n_bins: int = 10) -> DataFrame:
    """E8 (regression): mean y and yhat per exact quantile bin of yhat
    (right-closed, duplicate edges dropped)."""
    m = QuantileBinner([yhat], n_bins, suffix="_bin").fit(df)
    return (m.transform(df).withColumnRenamed(f"{yhat}_bin", "bin").groupBy("bin")
            .agg(F.avg(yhat).alias("yhat_mean"), F.avg(y).alias("y_mean"), F.count(F.lit(1)).alias("n")))


def residual_table(df: DataFrame, y: str, yhat: str, n_bins: int = 10) -> DataFrame:
    """Signed and absolute residual summaries per fitted-value bin."""
    d = df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull())
    m = QuantileBinner([yhat], n_bins, suffix="_bin").fit(d)
    d = m.transform(d).withColumnRenamed(f"{yhat}_bin", "bin")
    res = F.col(y) - F.col(yhat)
    return d.groupBy("bin").agg(F.avg(yhat).alias("yhat_mean"), F.avg(res).alias("resid_mean"),
                                F.avg(F.abs(res)).alias("abs_resid_mean"), F.count(F.lit(1)).alias("n"))


def class_residuals(probs: DataFrame, y: str, cls: str = "class", p: str = "p") -> DataFrame:
    """E11 for classes: one row per row, the residual 1 - p(true class) (0 and more, so also its absolute value).

    ``probs`` is the long (row, class, p) table with the true class ``y``: the row of the true class is
    picked where it stands, no join."""
    return probs.where(F.col(cls) == F.col(y)).withColumn("residual", 1 - F.col(p))


# ---------------------------------------------------------------------------
# Univariate importance
# ---------------------------------------------------------------------------
MISSING = "(Missing)"


def level_long(df: DataFrame, features: Sequence[str], target: str, n_bins: int = 10) -> DataFrame:
    """(variable, level, target) with numeric features cut into exact quantile
    bins (nulls -> "(Missing)") and string features as they are."""
    types = dict(df.dtypes)
    metr = [c for c in features if types[c] != "string"]
    cate = [c for c in features if types[c] == "string"]
    parts = []
    if metr:
        probs = [i / n_bins for i in range(n_bins + 1)]
        lf = st.long_form(df, metr, keys=[target])
        q = od.exact_quantiles(lf, "value", probs, by=["variable"])
        edges = q.groupBy("variable").agg(F.array_sort(F.collect_set("quantile")).alias("_edges"))
        lf = lf.join(F.broadcast(edges), "variable")  # a row per feature
        parts.append(lf.select("variable", F.coalesce(bins_by_edges(F.col("value"), F.col("_edges")),
                                                      F.lit(MISSING)).alias("level"), target))
    if cate:
        lf = st.long_form(df, cate, "string", keys=[target])
        parts.append(lf.select("variable", F.col("value").alias("level"), target))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def importance_class(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """AUC of (mean target of the row's level) per feature."""
    lv = (level_long(df, features, target).where(F.col("level").isNotNull())
          .groupBy("variable", "level")
          .agg(F.sum(F.col(target).cast("double")).alias("pos"),
               F.sum(F.lit(1.0) - F.col(target).cast("double")).alias("neg")))
    lv = lv.withColumn("score", F.col("pos") / (F.col("pos") + F.col("neg")))
    c = od.cumulative(lv, "score", {"pos": F.sum("pos"), "neg": F.sum("neg")}, by=["variable"])
    below = F.col("cum_neg") - F.col("neg")
    return c.groupBy("variable").agg(
        (F.sum(F.col("pos") * (below + F.col("neg") / 2)) /
         F.nullif(F.first("tot_pos") * F.first("tot_neg"), F.lit(0.0))).alias("importance"))


def importance_multiclass(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Mean over classes of the one-vs-rest AUC of the level's class share."""
    lv = level_long(df, features, target).where(F.col("level").isNotNull())
    ct = cut_lineage(lv.groupBy("variable", "level", target).agg(F.count(F.lit(1)).cast("double").alias("n")), "level-counts")  # read three times
    tot = ct.groupBy("variable", "level").agg(F.sum("n").alias("_lt"))
    classes = ct.select(F.col(target).alias("class")).distinct()
    # level x class rows only for observed (level, class) plus zero-share rows:
    # expanded per level from the bounded class list (array, no join)
    cls_arr = classes.agg(F.array_sort(F.collect_set("class")).alias("a")).select("a").scalar()
    grid = tot.select("variable", "level", "_lt", F.explode(cls_arr).alias("class"))
    g = (grid.join(ct.withColumnRenamed(target, "class"), ["variable", "level", "class"], "left")
         .fillna(0.0, ["n"])
         .withColumn("score", F.col("n") / F.col("_lt")))
    c = od.cumulative(g.withColumn("pos", F.col("n")).withColumn("neg", F.col("_lt") - F.col("n")),
                      "score", {"pos": F.sum("pos"), "neg": F.sum("neg")}, by=["variable", "class"])
    below = F.col("cum_neg") - F.col("neg")
    per = c.groupBy("variable", "class").agg(
        (F.sum(F.col("pos") * (below + F.col("neg") / 2)) /
         F.nullif(F.first("tot_pos") * F.first("tot_neg"), F.lit(0.0))).alias("auc"))
    return per.groupBy("variable").agg(F.avg("auc").alias("importance"))


def importance_regression(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """|Spearman| of the target with the level mean (string features) or
    with the raw value (numeric features).

    One pass: every row emits one (feature, level, value) struct per feature;
    level means are an aggregate over (feature, level) joined back (partial
    aggregation, so no level has to fit one task).
    """
    types = dict(df.dtypes)
    cate = [c for c in features if types[c] == "string"]
    arr = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("level"),
                             (F.lit(None).cast("double") if c in cate else F.col(c).cast("double")).alias("num"))
                    for c in features])
    long = (df.where(F.col(target).isNotNull())
            .select(F.col(target).cast("double").alias("_y"), F.explode(arr).alias("s")).select("_y", "s.*"))
    if cate:
        means = (long.where(F.col("variable").isin(cate) & F.col("level").isNotNull())
                 .groupBy("variable", "level").agg(F.avg("_y").alias("_m")))
        long = long.join(means, ["variable", "level"], "left")
        long = long.withColumn("_s", F.when(F.col("variable").isin(cate), F.col("_m")).otherwise(F.col("num")))
    else:
        long = long.withColumn("_s", F.col("num"))
    rho = st.spearman(long, "_y", "_s", by=["variable"])
    return rho.select("variable", F.abs("spearman").alias("importance"))


# ---------------------------------------------------------------------------
# Importance table
# ---------------------------------------------------------------------------
def importance_table(imp: DataFrame, score: str = "importance", top_n: int | None = None) -> DataFrame:
    """Scale to 100 (max), share of the total and cumulative share in descending order, both
    in percent, band (low <= 10 < medium <= 50 < high) and a top-n mask.  The table has one
    row per feature, so its ordering window is over a bounded set.  If no feature
    has any importance, all scale to 0 and the shares are null."""
    kind = dict(imp.dtypes)[score]
    mx = imp.select(F.max(score)).scalar()
    tot = imp.select(F.sum(score)).scalar()
    w = Window.orderBy(F.col(score).desc(), F.col("variable")).rowsBetween(Window.unboundedPreceding, 0)
    out = imp.withColumns({
        "importance_scaled": F.coalesce(100 * F.col(score) / F.nullif(mx, F.lit(0).cast(kind)), F.lit(0.0)),
        "importance_cum": 100 * F.sum(score).over(w) / F.nullif(tot, F.lit(0).cast(kind)),
        "importance_sumnormed": 100 * F.col(score) / F.nullif(tot, F.lit(0).cast(kind)),
        "rank": F.row_number().over(Window.orderBy(F.col(score).desc(), F.col("variable"))),
    })
    out = out.withColumn("band", cut(F.col("importance_scaled"), [-1e-9, 10, 50, 100.0 + 1e-9],
                                     ["low", "medium", "high"]))
    if top_n is not None:
        out = out.withColumn("top", (F.col("rank") <= top_n).cast("int"))
    return out


def top_rows(df: DataFrame, table: DataFrame, variable: str = "variable") -> DataFrame:
    """T4: the rows of ``df`` whose variable is in the top-n mask of ``importance_table``, by a semi join."""
    kept = table.where(F.col("top") == 1).select("variable")  # n rows
    return df.join(F.broadcast(kept), df[variable] == kept["variable"], "left_semi")


# ---------------------------------------------------------------------------
# Forecast summaries
# ---------------------------------------------------------------------------
def mean_by_date(df: DataFrame, y: str, yhat: str, date_col: str = "date",
                 segment: str | None = None) -> DataFrame:
    """Observed and predicted mean per date (and segment)."""
    keys = [date_col] + ([segment] if segment else [])
    return df.groupBy(*keys).agg(F.avg(y).alias("y_mean"), F.avg(yhat).alias("yhat_mean"))


def forecast_bias(test: DataFrame, train: DataFrame, id_col: str, y: str, yhat: str,
                  top_n: int | None = None) -> DataFrame:
    """A30 + J16 + T2: per series mean forecast minus mean actual on the test
    rows, with the training mean; optionally the ``top_n`` most over-forecast."""
    t = test.groupBy(id_col).agg(F.avg(yhat).alias("yhat_mean"), F.avg(y).alias("y_mean"))
    tr = train.groupBy(id_col).agg(F.avg(y).alias("y_train_mean"))
    out = t.join(tr, id_col, "left").withColumn("bias", F.col("yhat_mean") - F.col("y_mean"))
    if top_n is not None:
        out = out.orderBy(F.col("bias").desc_nulls_last(), F.col(id_col)).limit(top_n)
    return out
