"""Feature transformers (X1-X11, P15, P17, P21, P22) as Spark ML Estimator/Model pairs.

``fit`` is the only action: it runs one aggregate job and keeps the fitted
state either as a few driver-side numbers per feature (quantile edges, means,
modes - bounded by the number of features, like Spark's own Imputer or
QuantileDiscretizer) or as a mapping DataFrame (level -> rank / kept level)
whose size is the number of levels, joined back at transform time with the
join strategy left to the planner.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Model
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanac.functions.columns import clip, zfill
from almanac.operators.sampling import hash_order
from almanac.operators import lookup
from almanac.operators import ordered as od
from almanac.operators.stats import long_form
from almanac.session import cut_lineage


class _Est(Estimator):
    def __init__(self):
        super().__init__()


class _Mod(Model):
    def __init__(self):
        super().__init__()


# ---------------------------------------------------------------------------
# Convert
# ---------------------------------------------------------------------------
def convert(df: DataFrame, features: Sequence[str], to: str) -> DataFrame:
    """Cast; string casts keep nulls null (no "nan" text level)."""
    out = df
    for c in features:
        v = F.col(c).cast(to)
        if to == "string":
            v = F.when(F.lower(v) != "nan", v)
        out = out.withColumn(c, v)
    return out


def fill_missing_level(df: DataFrame, features: Sequence[str], label: str = "(Missing)") -> DataFrame:
    """Null category as its own level."""
    return df.fillna(label, list(features))


# ---------------------------------------------------------------------------
# Quantile bins
# ---------------------------------------------------------------------------
def bin_label(idx: Column, prefix: str = "q") -> Column:
    return F.concat(F.lit(prefix), zfill(idx.cast("string"), 2))


class QuantileBinner(_Est):
    """Exact quantile edges (duplicates dropped), right-closed bins, the
    first bin includes the minimum, labels ``q01``..; null stays null.

    Equals pandas ``qcut(x, n, duplicates='drop')``.  Unlike
    ``QuantileDiscretizer`` the edges are exact and bins right-closed.
    """

    def __init__(self, features: Sequence[str], n_bins: int = 10, prefix: str = "q",
                 suffix: str = ""):
        super().__init__()
        self.features, self.n_bins, self.prefix, self.suffix = list(features), n_bins, prefix, suffix

    def edges_table(self, df: DataFrame) -> DataFrame:
        probs = [i / self.n_bins for i in range(self.n_bins + 1)]
        return od.exact_quantiles(long_form(df, self.features), "value", probs, by=["variable"])

    def _fit(self, df: DataFrame) -> "QuantileBinnerModel":
        rows = self.edges_table(df).collect()   # (#features x (n_bins+1)) numbers
        edges: dict[str, list[float]] = {}
        for r in sorted(rows, key=lambda r: (r["variable"], r["prob"])):
            edges.setdefault(r["variable"], [])
            if r["quantile"] is not None and (not edges[r["variable"]] or r["quantile"] != edges[r["variable"]][-1]):
                edges[r["variable"]].append(r["quantile"])
        return QuantileBinnerModel(edges, self.prefix, self.suffix)


class QuantileBinnerModel(_Mod):
    def __init__(self, edges: dict[str, list[float]], prefix: str = "q", suffix: str = ""):
        super().__init__()
        self.edges, self.prefix, self.suffix = edges, prefix, suffix

    def bin_index(self, c: str) -> Column:
        inner = self.edges[c][1:-1]
        idx = F.lit(1)
        for e in inner:
            idx = idx + (F.col(c) > F.lit(e)).cast("int")
        return F.when(F.col(c).isNotNull(), idx)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c + self.suffix: bin_label(self.bin_index(c), self.prefix) for c in self.edges})


def bins_by_edges(value: Column, edges: Column, prefix: str = "q") -> Column:
    """Quantile bin label from an edges array column (``1 + #inner edges < x``)."""
    inner = F.slice(edges, 2, F.size(edges) - 2)
    idx = F.lit(1) + F.size(F.filter(inner, lambda e: e < value))
    return F.when(value.isNotNull(), bin_label(idx, prefix))


# ---------------------------------------------------------------------------
# Lump rare levels; X9: map unseen levels
# ---------------------------------------------------------------------------
class LumpRareLevels(_Est):
    """For columns with more than ``n_top`` levels (null counts as a
    level), keep the ``n_top`` most frequent levels (ties by level) and map
    everything else - null included - to ``other_label``."""

    def __init__(self, features: Sequence[str], n_top: int = 10, other_label: str = "_OTHER_"):
        super().__init__()
        self.features, self.n_top, self.other = list(features), n_top, other_label

    def _fit(self, df: DataFrame) -> "LumpRareLevelsModel":
        lf = long_form(df, self.features, "string")
        cnt = lf.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"))
        nlev = cnt.groupBy("variable").agg(F.count(F.lit(1)).alias("n_levels"))
        toomany = [r["variable"] for r in nlev.where(F.col("n_levels") > self.n_top).collect()]
        w = Window.partitionBy("variable").orderBy(F.col("n").desc(), F.col("value"))
        top = (cnt.where(F.col("value").isNotNull() & F.col("variable").isin(toomany))
               .withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= self.n_top)
               .select("variable", "value"))
        return LumpRareLevelsModel(toomany, top, self.other)


class LumpRareLevelsModel(_Mod):
    def __init__(self, toomany: list[str], top: DataFrame, other: str):
        super().__init__()
        self.toomany, self.top, self.other = toomany, top, other

    def _transform(self, df: DataFrame) -> DataFrame:
        out = df
        for c in self.toomany:
            # at most n_top rows per column: a proven size bound
            keep = F.broadcast(self.top.where(F.col("variable") == c)
                               .select(F.col("value").alias(f"_k_{c}")))
            out = (out.join(keep, F.col(c).cast("string") == F.col(f"_k_{c}"), "left")
                   .withColumn(c, F.when(F.col(f"_k_{c}").isNotNull(), F.col(c).cast("string"))
                               .otherwise(F.lit(self.other)))
                   .drop(f"_k_{c}"))
        return out


class MapUnseenLevels(_Est):
    """Levels not seen at fit (and nulls) become the fitted mode."""

    def __init__(self, features: Sequence[str]):
        super().__init__()
        self.features = list(features)

    def _fit(self, df: DataFrame) -> "MapUnseenLevelsModel":
        lf = long_form(df, self.features, "string").where(F.col("value").isNotNull())
        levels = lf.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"))
        w = Window.partitionBy("variable").orderBy(F.col("n").desc(), F.col("value"))
        modes = {r["variable"]: r["value"] for r in
                 levels.withColumn("_r", F.row_number().over(w)).where("_r = 1").collect()}
        return MapUnseenLevelsModel(levels.select("variable", "value"), modes)


class MapUnseenLevelsModel(_Mod):
    def __init__(self, levels: DataFrame, modes: dict[str, str]):
        super().__init__()
        self.levels, self.modes = levels, modes

    def _transform(self, df: DataFrame) -> DataFrame:
        out = df
        for c, mode in self.modes.items():
            seen = self.levels.where(F.col("variable") == c).select(F.col("value").alias(f"_s_{c}"))
            out = (out.join(seen, F.col(c).cast("string") == F.col(f"_s_{c}"), "left")
                   .withColumn(c, F.when(F.col(f"_s_{c}").isNotNull(), F.col(c).cast("string"))
                               .otherwise(F.lit(mode)))
                   .drop(f"_s_{c}"))
        return out


# ---------------------------------------------------------------------------
# Target encoding by rank
# ---------------------------------------------------------------------------

class TargetRankEncoder(_Est):
    """Level -> rank of its mean target on the flagged rows (descending;
    ties by level); levels without flagged rows rank last; levels unseen at
    fit (and nulls) get the median rank.  Numeric targets use the mean,
    string targets the indicator of the majority class.

    With ``weight``, the rows are sums already: the target is a sum over ``weight`` rows.
    """

    def __init__(self, features: Sequence[str], flag_col: str = "encode_flag", target: str = "target",
                 remove_burned: bool = False, suffix: str = "_ENCODED", weight: str | None = None):
        super().__init__()
        self.features, self.flag_col, self.target = list(features), flag_col, target
        self.remove_burned, self.suffix, self.weight = remove_burned, suffix, weight

    def _fit(self, df: DataFrame) -> "TargetRankEncoderModel":
        is_str = dict(df.dtypes)[self.target] == "string"
        if is_str:
            top = (df.groupBy(self.target).count()
                   .orderBy(F.col("count").desc(), F.col(self.target)).limit(1))
            tmp = (F.col(self.target) == top.select(self.target).scalar()).cast("double")
        else:
            tmp = F.col(self.target).cast("double")
        rows = F.col(self.weight).cast("double") if self.weight else tmp.isNotNull().cast("double")
        d = df.withColumns({"_tmp": tmp, "_rows": rows})
        lf = long_form(d, self.features, "string", keys=["_tmp", "_rows", self.flag_col])
        flagged = F.col(self.flag_col) == 1
        levels = lf.where(F.col("value").isNotNull()).groupBy("variable", "value").agg(
            (F.sum(F.when(flagged, F.col("_tmp"))) / F.nullif(F.sum(F.when(flagged, F.col("_rows"))), F.lit(0.0))).alias("target_mean"))
        # the fitted state: one aggregate job, written once to the shared
        # checkpoint folder and read by the ranking and the transform
        levels = cut_lineage(levels, "target_levels")
        # rank of every level by (mean desc, level), numbered across tasks: a
        # feature may have any number of levels
        med = levels.groupBy("variable").agg(((F.count(F.lit(1)) + 1) / 2.0).alias("median_rank"))
        order = [F.col("target_mean").desc_nulls_last(), F.col("value")]
        ranked = od.global_row_number(levels, order, by=["variable"], out="rank")
        ranks = ranked.join(med, "variable")
        return TargetRankEncoderModel(ranks, self.features, self.flag_col, self.remove_burned, self.suffix)


class TargetRankEncoderModel(_Mod):
    def __init__(self, ranks: DataFrame, features, flag_col, remove_burned, suffix):
        super().__init__()
        self.ranks, self.features, self.flag_col = ranks, features, flag_col
        self.remove_burned, self.suffix = remove_burned, suffix

    def _transform(self, df: DataFrame) -> DataFrame:
        out = df
        for c in self.features:
            m = self.ranks.where(F.col("variable") == c)
            med = m.select(F.first("median_rank")).scalar()
            mp = m.select(F.col("value").alias(f"_v_{c}"), F.col("rank").alias(f"_r_{c}"))
            out = (out.join(mp, F.col(c).cast("string") == F.col(f"_v_{c}"), "left")
                   .withColumn(c + self.suffix, F.coalesce(F.col(f"_r_{c}").cast("double"), med))
                   .drop(f"_v_{c}", f"_r_{c}"))
        if self.remove_burned:
            out = out.where(F.col(self.flag_col) != 1)
        return out


# ---------------------------------------------------------------------------
# Numeric fills and scalers
# ---------------------------------------------------------------------------
class SimpleImputer(_Est):
    """Fill nulls with the exact median, the mean, or the most frequent
    value (ties to the smallest) fitted per feature."""

    def __init__(self, features: Sequence[str], strategy: str = "median"):
        super().__init__()
        self.features, self.strategy = list(features), strategy

    def _fit(self, df: DataFrame) -> "FillModel":
        if self.strategy == "median":
            lf = long_form(df, self.features)
            rows = od.exact_quantiles(lf, "value", [0.5], by=["variable"]).collect()
            vals = {r["variable"]: r["quantile"] for r in rows}
        elif self.strategy == "mean":
            vals = df.agg(*[F.avg(c).alias(c) for c in self.features]).first().asDict()
        else:
            vals = {}
            for c in self.features:
                top = (df.where(F.col(c).isNotNull()).groupBy(c).count()
                       .orderBy(F.col("count").desc(), F.col(c)).limit(1).collect())
                vals[c] = top[0][c] if top else None
        return FillModel(vals)


class FillModel(_Mod):
    def __init__(self, values: dict[str, float]):
        super().__init__()
        self.values = values

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in self.values.items()})


class Winsorizer(_Est):
    """Clip at fitted exact quantiles; ``fresh`` refits on the data being
    transformed.  Nulls stay null."""

    def __init__(self, features: Sequence[str], lower: float | None = None, upper: float | None = None,
                 fresh: bool = False):
        super().__init__()
        self.features, self.lower, self.upper, self.fresh = list(features), lower, upper, fresh

    def bounds(self, df: DataFrame) -> dict[str, dict[float, float]]:
        probs = [p for p in (self.lower, self.upper) if p is not None]
        rows = od.exact_quantiles(long_form(df, self.features), "value", probs, by=["variable"]).collect()
        out: dict[str, dict[float, float]] = {}
        for r in rows:
            out.setdefault(r["variable"], {})[r["prob"]] = r["quantile"]
        return out

    def _fit(self, df: DataFrame) -> "WinsorizerModel":
        return WinsorizerModel(self, None if self.fresh else self.bounds(df))


class WinsorizerModel(_Mod):
    def __init__(self, est: Winsorizer, bounds):
        super().__init__()
        self.est, self.b = est, bounds

    def _transform(self, df: DataFrame) -> DataFrame:
        b = self.b if self.b is not None else self.est.bounds(df)
        lo, hi = self.est.lower, self.est.upper
        return df.withColumns({c: clip(c, b[c].get(lo) if lo is not None else None,
                                       b[c].get(hi) if hi is not None else None) for c in self.est.features})


class ZScaler(_Est):
    """(x - mean) / std with ddof 1; ``fresh`` refits at transform."""

    def __init__(self, features: Sequence[str], fresh: bool = False):
        super().__init__()
        self.features, self.fresh = list(features), fresh

    def moments(self, df):
        r = df.agg(*[F.avg(c).alias(f"m_{c}") for c in self.features],
                   *[F.stddev_samp(c).alias(f"s_{c}") for c in self.features]).first()
        return {c: (r[f"m_{c}"], r[f"s_{c}"]) for c in self.features}

    def _fit(self, df):
        return AffineModel(self, None if self.fresh else self.moments(df))


class MinMaxScaler01(_Est):
    """(x - min) / (max - min) per feature."""

    def __init__(self, features: Sequence[str]):
        super().__init__()
        self.features, self.fresh = list(features), False

    def moments(self, df):
        r = df.agg(*[F.min(c).alias(f"lo_{c}") for c in self.features],
                   *[F.max(c).alias(f"hi_{c}") for c in self.features]).first()
        return {c: (r[f"lo_{c}"], r[f"hi_{c}"] - r[f"lo_{c}"]) for c in self.features}

    def _fit(self, df):
        return AffineModel(self, self.moments(df))


class AffineModel(_Mod):
    """(x - a) / b with fitted (a, b) per feature; b = 0 gives null."""

    def __init__(self, est, ab):
        super().__init__()
        self.est, self.ab = est, ab

    def _transform(self, df):
        ab = self.ab if self.ab is not None else self.est.moments(df)
        return df.withColumns({c: (F.col(c) - F.lit(a)) / F.nullif(F.lit(b), F.lit(0.0))
                               for c, (a, b) in ab.items()})


def log_shift(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """log(x - min(0, min x) + 1); the minimum is a scalar subquery."""
    return df.withColumns({c: F.log(F.col(c) - F.least(F.lit(0.0), df.select(F.min(c)).scalar()) + 1)
                           for c in features})


# ---------------------------------------------------------------------------
# Random imputation
# ---------------------------------------------------------------------------
def random_impute(df: DataFrame, feature: str, key: str, seed: int = 0,
                  ref: DataFrame | None = None) -> DataFrame:
    """Each null gets an observed value of the column drawn uniformly with
    replacement (from ``ref`` if given), by a hash of (key, seed): rows that repeat a key draw alike,
    and every row stays one row.

    No observed value is numbered one by one: the observed values are
    pre-aggregated to (value, count) and numbered by running counts
    (``ordered.cumulative``); a draw idx in [0, m) finds its value as the
    number of value blocks starting at or before idx (a second running count
    over the union of block starts and draws).  Blocks that many draws fall into, and draws that
    many rows share, are looked up without being dealt by key (``lookup``).
    """
    ref = ref if ref is not None else df
    obs = ref.where(F.col(feature).isNotNull())
    blocks = od.cumulative(obs, feature, {"_n": F.count(F.lit(1)), "_one": F.lit(1)})
    # one row per distinct value: start position and ordinal
    blocks = cut_lineage(blocks.select(F.col("value").alias("_val"), (F.col("cum__n") - F.col("_n")).alias("_start"),
                                       F.col("cum__one").cast("long").alias("_ord"), "_n"), "blocks")
    m = obs.select(F.count(F.lit(1))).scalar()
    at = F.when(F.col(feature).isNull(), F.pmod(hash_order([key], seed, feature), m))
    draws = lookup.key_counts(df.select(at.alias("_idx")), ["_idx"], "_rows")
    marks = (blocks.select(F.col("_start").alias("_pos"), F.lit(1.0).alias("_w"), F.lit(0).cast("long").alias("_rows"))
             .unionByName(draws.select(F.col("_idx").alias("_pos"), F.lit(0.0).alias("_w"), "_rows")))
    found = od.cumulative(marks, "_pos", {"_s": F.sum("_w"), "_r": F.sum("_rows")}).where(F.col("_r") > 0).select(
        F.col("value").cast("long").alias("_idx"), F.col("cum__s").cast("long").alias("_ord"), F.col("_r").alias("_rows"))
    values = lookup.attach(found, blocks.select("_ord", "_val", "_n"), ["_ord"], "_n").drop("_ord")
    out = lookup.attach(df.withColumn("_idx", at), cut_lineage(values, "draws"), ["_idx"], "_rows").drop("_idx")
    return out.withColumn(feature, F.coalesce(F.col(feature), F.col("_val").cast(dict(df.dtypes)[feature]))).drop("_val")


# ---------------------------------------------------------------------------
# One-hot + metric feature vector with a position map
# ---------------------------------------------------------------------------
class SparseMatrixBuilder(_Est):
    """Metrics first, then one column per reference level of each
    categorical feature (alphabetical level order; Spark has no row order
    for "first appearance").  Unknown levels and nulls raise, as in the reference.

    The levels are a table from the first to the last step: counted, numbered across
    tasks, written once, and joined to the rows by level.  The driver holds the
    number of positions and nothing that grows with the levels.
    """

    def __init__(self, metr: Sequence[str], cate: Sequence[str], output: str = "features"):
        super().__init__()
        self.metr, self.cate, self.output = list(metr), list(cate), output

    def _fit(self, df: DataFrame) -> "SparseMatrixModel":
        if not self.cate:
            none = df.sparkSession.createDataFrame([], "position int, variable string, value string, n long")
            return SparseMatrixModel(self, none, len(self.metr))
        lf = long_form(df, self.cate, "string").where(F.col("value").isNotNull())
        levels = lf.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"))
        feature = F.array_position(F.array(*map(F.lit, self.cate)), F.col("variable"))
        numbered = od.global_row_number(levels, [feature, F.col("value")], out="position")
        levels = cut_lineage(numbered.select((F.col("position") - 1 + len(self.metr)).cast("int").alias("position"), "variable", "value", "n"), "levels")
        return SparseMatrixModel(self, levels, len(self.metr) + levels.count())


class SparseMatrixModel(_Mod):
    def __init__(self, est: SparseMatrixBuilder, levels: DataFrame, size: int):
        super().__init__()
        self.est, self.levels, self.size = est, levels, size

    def position_map(self) -> DataFrame:
        """(position, variable, value): the metrics, without a value, and every level."""
        spark = self.levels.sparkSession
        metr = spark.createDataFrame(list(enumerate(self.est.metr)), "position int, variable string")
        return metr.withColumn("value", F.lit(None).cast("string")).unionByName(self.levels.select("position", "variable", "value"))

    def _transform(self, df: DataFrame) -> DataFrame:
        """The rows with a sparse vector; they are written once, as a vector's parts, and read as vectors."""
        out = df
        for c in self.est.cate:
            own = self.levels.where(F.col("variable") == c).select(F.col("value").alias("_level"), F.col("position").alias(f"_at_{c}"), "n")
            out = lookup.attach(out.withColumn("_level", F.col(c).cast("string")), own, ["_level"], "n").drop("_level")
        metr = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in self.est.metr]
        unknown = lambda c: F.raise_error(F.concat(F.lit(f"{c}: level not in the reference data: "), F.coalesce(F.col(c).cast("string"), F.lit("null")))).cast("int")
        at = [F.when(x != 0.0, F.array(F.lit(k))).otherwise(F.array().cast("array<int>")) for k, x in enumerate(metr)]  # joined, since functions over an array are interpreted
        values = [F.when(x != 0.0, F.array(x)).otherwise(F.array().cast("array<double>")) for x in metr]
        at.append(F.array(*[F.coalesce(F.col(f"_at_{c}"), unknown(c)) for c in self.est.cate]).cast("array<int>"))
        values.append(F.array(*[F.lit(1.0) for _ in self.est.cate]).cast("array<double>"))
        vector = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(self.size).alias("size"), F.concat(*at).alias("indices"), F.concat(*values).alias("values"))
        out = out.select(*df.columns, vector.alias(self.est.output))
        return cut_lineage(out, "sparse", schema=T.StructType([*df.schema.fields, T.StructField(self.est.output, VectorUDT())]))


def active_positions(df: DataFrame, keys: Sequence[str], features: str = "features") -> DataFrame:
    """(keys..., position, x) of the entries that a sparse vector stores; nothing is made dense."""
    u = F.unwrap_udt(features)
    return df.select(*keys, F.explode(F.arrays_zip(u["indices"].alias("position"), u["values"].alias("x"))).alias("_e")).select(*keys, "_e.position", "_e.x")


# ---------------------------------------------------------------------------
# Generic derived columns; X11: prior rescaling
# ---------------------------------------------------------------------------
def group_derive(df: DataFrame, prefix_of: tuple[str, str] | None = None,
                 count_sum: tuple[Sequence[str], str] | None = None,
                 group_mean: tuple[str, str, str] | None = None) -> DataFrame:
    """First letter of a code, sum of counts + 1, mean of a value per group."""
    out = df
    if prefix_of:
        src, name = prefix_of
        out = out.withColumn(name, F.substring(F.col(src), 1, 1))
    if count_sum:
        cols, name = count_sum
        s = F.lit(1)
        for c in cols:
            s = s + F.col(c).cast("int")
        out = out.withColumn(name, s)
    if group_mean:
        val, grp, name = group_mean
        # W8 group transform as aggregate + join back: the aggregate is
        # combined map-side, so a hot group never lands whole on one task
        m = out.groupBy(grp).agg(F.avg(val).alias(name))
        out = out.join(m, grp, "left")
    return out


def rescale_probabilities(probs: DataFrame, row: str, cls: str, p: str,
                          b_sample: DataFrame, b_all: DataFrame) -> DataFrame:
    """X11: p_k * b_all_k / b_sample_k, renormalised per row.  ``b_*`` are
    (class, share) tables keyed by class (one row per class)."""
    s = b_sample.withColumnRenamed("share", "_bs")
    a = b_all.withColumnRenamed("share", "_ba")
    shares = cut_lineage(s.join(a, cls).join(lookup.key_counts(probs, [cls]), cls), "shares")
    t = lookup.attach(probs, shares, [cls], "_count", how="inner").withColumn("_t", F.col(p) * F.col("_ba") / F.col("_bs"))
    return t.withColumn(p, F.col("_t") / F.sum("_t").over(Window.partitionBy(row))).drop("_t", "_bs", "_ba")
