"""Samples and splits (T5-T11, S8) driven by seeded hashes.

Every random choice is a pure function of (row key, seed), so a recomputed
task draws the same rows and results are reproducible across runs and
cluster sizes.  No operator collects rows or numbers them on one task:
equal-size parts use the distributed running counts of
``ordered.cumulative``; per-class caps use ``row_number() <= n`` which Spark
plans with a map-side group limit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.operators import lookup
from almanac.operators import ordered as od
from almanac.session import cut_lineage

TWO52, TWO53 = 1 << 52, 1 << 53


def hash_order(keys: Sequence[str | Column], seed: int, salt: str = "") -> Column:
    """Integer sort key below 2**52: the first 13 hex digits of the MD5 of
    ``key|...|seed|salt``, which any SQL engine computes alike."""
    cols = [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    text = F.concat_ws("|", *cols, F.lit(str(seed)), F.lit(salt))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def hash_uniform(keys: Sequence[str | Column], seed: int, salt: str = "") -> Column:
    """Uniform [0, 1): ``hash_order`` / 2**52, exact as a double."""
    return hash_order(keys, seed, salt).cast("double") / float(TWO52)


def sql_hash(keys: Sequence[str], seed: int, salt: str = "") -> str:
    """``hash_order`` in SQL."""
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(f'CAST({k} AS VARCHAR)' for k in keys)}, '{seed}', '{salt}')), 1, 13) AS BIGINT)"


def sample_n(df: DataFrame, n: int, keys: Sequence[str], seed: int = 1) -> DataFrame:
    """T5: n rows without replacement (top-n by hash: per-partition top-n then
    a merge of n rows per partition)."""
    return df.withColumn("_h", hash_order(keys, seed)).orderBy("_h", *keys).limit(n).drop("_h")


def shuffle_split(df: DataFrame, keys: Sequence[str], test_size: float = 0.2, seed: int = 1) -> DataFrame:
    """Role 'test' for a hash fraction ``test_size``, else 'train'."""
    return df.withColumn("role", F.when(hash_uniform(keys, seed) < test_size, "test").otherwise("train"))


def train_size_subsets(df: DataFrame, keys: Sequence[str], sizes: Sequence[float], seed: int = 1) -> DataFrame:
    """Nested subsets - a row belongs to every size >= its hash fraction.
    Long output (row..., train_size)."""
    u = hash_uniform(keys, seed)
    arr = F.filter(F.array(*[F.lit(float(s)) for s in sizes]), lambda s: u <= s)
    return df.withColumn("train_size", F.explode(arr))


def undersample(df: DataFrame, target: str, n_max: int, keys: Sequence[str], seed: int = 42):
    """At most ``n_max`` rows per class (chosen by hash).

    Returns (sample, shares) where shares has (class, b_all, b_sample): class
    shares before and after, keyed by class.
    """
    w = Window.partitionBy(target).orderBy(hash_order(keys, seed), *keys)
    s = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n_max).drop("_r")
    before = df.groupBy(target).agg(F.count(F.lit(1)).alias("_nb"))
    after = s.groupBy(F.col(target).alias("_class")).agg(F.count(F.lit(1)).alias("_na"))
    every = Window.partitionBy()  # of one row per class, so that the rows are ranked once
    both = before.join(after, F.col(target).eqNullSafe(F.col("_class")), "left").withColumns({"_tb": F.sum("_nb").over(every), "_ta": F.sum("_na").over(every)})
    own = F.when(F.col(target).isNotNull(), F.col("_na"))
    shares = both.select(F.col(target).alias("class"), (F.col("_nb") / F.col("_tb")).alias("b_all"), (F.coalesce(own, F.lit(0)) / F.col("_ta")).alias("b_sample"))
    return s, shares


def _array_split_part(idx: Column, n: Column, k: int) -> Column:
    """Part of 0-based position ``idx`` when n items are cut like
    ``np.array_split(n, k)`` (the first n % k parts one longer)."""
    q = F.floor(n / k)
    r = n - q * k
    big = r * (q + 1)
    return F.when(idx < big, F.floor(idx / (q + 1))).otherwise(r + F.floor((idx - big) / F.nullif(q, F.lit(0)))).cast("int")


def cv_split(df: DataFrame, keys: Sequence[str], n_splits: int = 5, fold_col: str = "fold",
             seed: int = 42) -> DataFrame:
    """train/test-separated CV.  Rows of each fold are shuffled by hash and
    cut into ``n_splits`` near-equal parts; split i trains on all train rows
    except part i (all of them when n_splits == 1) and tests on test part i.

    Output: rows with ``split`` and ``role`` (long form; a train row appears
    in n_splits - 1 splits).
    """
    d = df.where(F.col(fold_col).isin("train", "test")).withColumn("_h", hash_order(keys, seed))
    total = d.groupBy(fold_col).agg(F.count(F.lit(1)).alias("_tot"))  # two rows
    d = od.global_row_number(d, [F.col("_h"), *map(F.col, keys)], by=[fold_col], out="_idx").join(F.broadcast(total), fold_col)
    part = _array_split_part(F.col("_idx") - 1, F.col("_tot"), n_splits)
    splits = F.array(*[F.lit(i) for i in range(n_splits)])
    train_splits = splits if n_splits == 1 else F.filter(splits, lambda i: i != part)
    s = F.when(F.col(fold_col) == "train", train_splits).otherwise(F.array(part))
    return (d.withColumn("split", F.explode(s))
            .withColumn("role", F.col(fold_col))
            .drop("_h", "_idx", "_tot"))


def _splitmix64(x):
    import numpy as np
    with np.errstate(over="ignore"):
        z = x + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _poisson_inverse_cdf(lam, h):
    """Vectorised Poisson(lam) draws from a per-row 64-bit hash.

    lam is cut into chunks of mean <= 8 (Poisson is additive); chunk j uses
    the uniform splitmix64(h + j), and its count is the inverse CDF found by
    walking the pmf, so no term underflows.  Pure function of (lam, h).
    """
    import numpy as np
    lam = np.nan_to_num(np.asarray(lam, dtype="float64"), nan=0.0)
    hu = np.asarray(h, dtype="int64").view("uint64")
    m = np.maximum(1, np.ceil(lam / 8.0)).astype("int64")
    lc = lam / m
    out = np.zeros(len(lam), dtype="int64")
    for j in range(int(m.max()) if len(m) else 0):
        act = j < m
        u = (_splitmix64(hu + np.uint64(j)) >> np.uint64(11)).astype("float64") / float(TWO53)
        p = np.exp(-lc)
        cdf = p.copy()
        k = np.zeros(len(lam), dtype="int64")
        todo = act & (cdf < u)
        while todo.any():
            k[todo] += 1
            p[todo] = p[todo] * lc[todo] / k[todo]
            cdf[todo] += p[todo]
            todo = todo & (cdf < u) & (p > 0)  # beyond the last term that a double holds the sum no longer grows
        out += np.where(act, k, 0)
    return out


def poisson_count(lam: Column, keys: Sequence[str | Column], seed: int) -> Column:
    """Poisson(lam) multiplicity per row, deterministic in (keys, seed).

    A vectorised pandas UDF (Arrow batches): the inverse CDF walk is a short
    numeric loop that Spark's SQL functions cannot express without nested,
    interpreted higher-order functions.
    """
    from almanac.functions.pandas_udfs import poisson_draw
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return poisson_draw(lam, F.xxhash64(*cols, F.lit(seed), F.lit("boot")))


def weighted_bootstrap(df: DataFrame, keys: Sequence[str], weight: Column | None = None,
                       seed: int = 2, by: Sequence[str] = ()) -> DataFrame:
    """Resample with replacement.  Row multiplicity ~ Poisson with mean
    n * w / sum(w) (per group ``by``), rows repeated by ``explode(sequence)``
    only where the count is positive.  The sample size is random (close to n)."""
    w = weight if weight is not None else F.lit(1.0)
    d = df.withColumn("_w", w.cast("double"))
    totals = [F.count(F.lit(1)).alias("_n"), F.sum("_w").alias("_sw")]
    if by:
        groups = cut_lineage(d.groupBy(*by).agg(*totals, F.count(F.lit(1)).alias("_rows")), "bootstrap-groups")
        d = lookup.attach(d, groups, list(by), "_rows", how="inner")
    else:
        d = d.withColumns({c: d.agg(*totals).select(c).scalar() for c in ("_n", "_sw")})
    d = d.withColumn("_lam", F.col("_n") * F.col("_w") / F.nullif(F.col("_sw"), F.lit(0.0))).drop("_n", "_sw")
    cnt = poisson_count(F.col("_lam"), keys, seed)
    d = d.withColumn("_k", cnt).where(F.col("_k") > 0)
    return d.withColumn("_rep", F.explode(F.sequence(F.lit(1), F.col("_k")))).drop("_w", "_lam", "_k")


def bootstrap_split(df: DataFrame, keys: Sequence[str], n_splits: int = 3, fold_col: str = "fold",
                    seed: int = 42) -> DataFrame:
    """Per split, each side (train / test) resampled with replacement."""
    parts = []
    for i in range(n_splits):
        s = weighted_bootstrap(df.where(F.col(fold_col).isin("train", "test")), keys,
                               seed=seed * (i + 1), by=[fold_col])
        parts.append(s.withColumn("split", F.lit(i)).withColumn("role", F.col(fold_col)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
