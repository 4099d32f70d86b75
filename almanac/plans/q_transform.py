"""Catalogue: feature transformers (step 7) and samples/splits (step 9)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions.columns import inv_logit
from almanac.operators import sampling as sp
from almanac.operators import transformers as tf
from almanac.plans import sqlfrag as sf
from almanac.plans.q_stats import SCORED_SQL, scored_docs
from almanac.plans.registry import r6, register, rounded, sql_r6
from almanac.sources.tables import read_table, sample_series


TRAIN_SIZES = [round(0.05 + i * 0.95 / 9, 4) for i in range(10)]


def _union(parts):
    return "\nUNION ALL\n".join(parts)


# --- quantile_bins: X1 ------------------------------------------------------
QB_COLS = ["l_extendedprice", "l_quantity", "l_discount"]


def _qb_sql(c):
    qs = "[" + ", ".join(str(i / 10) for i in range(11)) + "]"
    return (f"SELECT '{c}' AS variable, "
            f"'q' || lpad(CAST(1 + len(list_filter(q.inner, lambda e: e < {c})) AS VARCHAR), 2, '0') AS bin, "
            f"{c} AS x FROM lineitem, (SELECT e[2:len(e) - 1] AS inner FROM "
            f"(SELECT list_sort(list_distinct(quantile_cont({c}, {qs}))) AS e FROM lineitem)) q "
            f"WHERE {c} IS NOT NULL")


@register("quantile_bins", sql=f"""
WITH b AS ({_union([_qb_sql(c) for c in QB_COLS])})
SELECT variable, bin, count(*) AS n, {sql_r6('min(x)')} AS lo, {sql_r6('max(x)')} AS hi FROM b GROUP BY variable, bin
""")
def quantile_bins(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem", QB_COLS)
    model = tf.QuantileBinner(QB_COLS, 10, suffix="_bin").fit(li)
    out = model.transform(li)
    parts = [out.select(F.lit(c).alias("variable"), F.col(f"{c}_bin").alias("bin"), F.col(c).cast("double").alias("x")) for c in QB_COLS]
    long = reduce(DataFrame.unionByName, parts).where(F.col("x").isNotNull())  # each part reads and bins one column only
    return rounded(long.groupBy("variable", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")), ["lo", "hi"])


# --- lump_rare_levels: X2, T3 ------------------------------------------------
@register("lump_rare_levels", sql="""
WITH top AS (SELECT p_brand FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 10),
l AS (SELECT CASE WHEN p_brand IN (SELECT p_brand FROM top) THEN p_brand ELSE '_OTHER_' END AS p_brand, p_type FROM part)
SELECT p_brand, p_type, count(*) AS n FROM l GROUP BY ALL
""")
def lump_rare_levels(spark, sf_dir):
    p = read_table(spark, sf_dir, "part", ["p_brand", "p_type"])
    m = tf.LumpRareLevels(["p_brand", "p_type"], n_top=10).fit(p)
    return m.transform(p).groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))


# --- map_unseen_levels: X9 ----------------------------------------------------
@register("map_unseen_levels", sql="""
WITH o AS (SELECT strftime(o_orderdate, '%Y-%m') AS ym, o_orderpriority, o_orderdate FROM orders),
fit AS (SELECT * FROM o WHERE o_orderdate < TIMESTAMP '2000-01-01'),
m1 AS (SELECT ym FROM fit GROUP BY ym ORDER BY count(*) DESC, ym LIMIT 1),
m2 AS (SELECT o_orderpriority FROM fit WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
t AS (
  SELECT CASE WHEN ym IN (SELECT ym FROM fit) THEN ym ELSE (SELECT ym FROM m1) END AS ym,
         CASE WHEN o_orderpriority IN (SELECT o_orderpriority FROM fit) THEN o_orderpriority
              ELSE (SELECT o_orderpriority FROM m2) END AS o_orderpriority
  FROM o
)
SELECT ym, o_orderpriority, count(*) AS n FROM t GROUP BY ALL
""")
def map_unseen_levels(spark, sf_dir):
    """Levels fitted on orders before 2000 (order months of later years are
    unseen), applied to all orders."""
    o = read_table(spark, sf_dir, "orders", ["o_orderdate", "o_orderpriority"]).select(
        F.date_format("o_orderdate", "yyyy-MM").alias("ym"), "o_orderpriority", "o_orderdate")
    m = tf.MapUnseenLevels(["ym", "o_orderpriority"]).fit(o.where(F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz")))
    return m.transform(o).groupBy("ym", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


# --- target_encode: X3, J10, J13, P12 ---------------------------------------
def _te_input(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice",
                                             "o_orderstatus", "o_orderdate"])
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment"])
    return (o.join(c, o.o_custkey == c.c_custkey)
            .withColumn("encode_flag", (F.year("o_orderdate") == 1995).cast("int")))


def _te_sql(feature, target, is_class, suffix):
    tmp = (f"CASE WHEN {target} = (SELECT {target} FROM d GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) THEN 1.0 ELSE 0.0 END"
           if is_class else f"CAST({target} AS DOUBLE)")
    return f"""
lv_{suffix} AS (SELECT {feature} AS value, avg(CASE WHEN encode_flag = 1 THEN {tmp} END) AS m
               FROM d WHERE {feature} IS NOT NULL GROUP BY 1),
rk_{suffix} AS (SELECT value, row_number() OVER (ORDER BY m DESC NULLS LAST, value) AS rank,
                      (count(*) OVER () + 1) / 2.0 AS med FROM lv_{suffix})"""


TE = [("c_mktsegment", "o_totalprice", False, "seg_price"), ("o_orderpriority", "o_totalprice", False, "prio_price"),
      ("c_mktsegment", "o_orderstatus", True, "seg_status")]


@register("target_encode", sql=f"""
WITH d AS (SELECT o.o_orderkey, c.c_mktsegment, o.o_orderpriority, o.o_totalprice, o.o_orderstatus,
                  CASE WHEN year(o.o_orderdate) = 1995 THEN 1 ELSE 0 END AS encode_flag
           FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
{','.join(_te_sql(*t)[1:] for t in TE)}
SELECT d.o_orderkey, d.encode_flag,
  {', '.join(f"COALESCE(CAST(rk_{s}.rank AS DOUBLE), (SELECT any_value(med) FROM rk_{s})) AS {s}" for f, _, _, s in TE)}
FROM d {' '.join(f"LEFT JOIN rk_{s} ON rk_{s}.value = d.{f}" for f, _, _, s in TE)}
""")
def target_encode(spark, sf_dir):
    d = _te_input(spark, sf_dir)
    for f, t, _, s in TE:
        m = tf.TargetRankEncoder([f], "encode_flag", t, suffix="__enc").fit(d)
        d = m.transform(d).withColumnRenamed(f + "__enc", s)
    return d.select("o_orderkey", "encode_flag", *[s for *_, s in TE])


# --- imputers and scalers: X4, X6, X7, P17, P21, P22 -------------------------
def injected_customer(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_acctbal", "c_mktsegment"])
    return c.select("c_custkey",
                    F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("c_acctbal"),
                    F.when(F.col("c_custkey") % 11 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))


CUST_SQL = """
ci AS (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS c_acctbal,
              CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer),
st AS (SELECT median(c_acctbal) AS med, avg(c_acctbal) AS mean, stddev_samp(c_acctbal) AS sd,
              min(c_acctbal) AS lo, max(c_acctbal) AS hi,
              quantile_cont(c_acctbal, 0.05) AS w_lo, quantile_cont(c_acctbal, 0.95) AS w_hi FROM ci),
md AS (SELECT c_acctbal AS mode FROM ci WHERE c_acctbal IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
ms AS (SELECT c_mktsegment AS mode FROM ci WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"""

_IMP_COLS = {
    "acct_median": "COALESCE(c_acctbal, med)",
    "acct_mean": "COALESCE(c_acctbal, mean)",
    "acct_mode": "COALESCE(c_acctbal, (SELECT mode FROM md))",
    "acct_wins": "CASE WHEN c_acctbal IS NOT NULL THEN least(greatest(c_acctbal, w_lo), w_hi) END",
    "acct_z": "(c_acctbal - mean) / sd",
    "acct_minmax": "(c_acctbal - lo) / NULLIF(hi - lo, 0)",
    "acct_log": "ln(c_acctbal - least(0.0, lo) + 1)",
}


@register("impute_median_mean_mode", sql=f"""
WITH {CUST_SQL[1:]}
SELECT c_custkey, {', '.join(f"{sql_r6(v)} AS {k}" for k, v in _IMP_COLS.items())},
       COALESCE(c_mktsegment, '(Missing)') AS mkt_filled,
       COALESCE(c_mktsegment, (SELECT mode FROM ms)) AS mkt_mode
FROM ci, st
""")
def impute_median_mean_mode(spark, sf_dir):
    """X4 (median/mean/most frequent), X6 (winsorize 5%/95%), X7 (z-scale),
    P21 (min-max), P22 (log shift) and P17 (missing level) on one table."""
    c = injected_customer(spark, sf_dir)
    a = "c_acctbal"
    c = c.withColumns({k: F.col(a) for k in _IMP_COLS}).withColumns(
        {"mkt_filled": F.col("c_mktsegment"), "mkt_mode": F.col("c_mktsegment")})
    c = tf.SimpleImputer(["acct_median"], "median").fit(c.withColumn("acct_median", F.col(a))).transform(c)
    c = tf.SimpleImputer(["acct_mean"], "mean").fit(c).transform(c)
    c = tf.SimpleImputer(["acct_mode"], "most_frequent").fit(c).transform(c)
    c = tf.Winsorizer(["acct_wins"], 0.05, 0.95).fit(c).transform(c)
    c = tf.ZScaler(["acct_z"]).fit(c).transform(c)
    c = tf.MinMaxScaler01(["acct_minmax"]).fit(c).transform(c)
    c = tf.log_shift(c, ["acct_log"])
    c = tf.fill_missing_level(c, ["mkt_filled"])
    c = tf.SimpleImputer(["mkt_mode"], "most_frequent").fit(c.withColumn("mkt_mode", F.col("c_mktsegment"))) \
        .transform(c)
    return rounded(c.drop(a, "c_mktsegment"), list(_IMP_COLS))


# --- impute_random: X5 -------------------------------------------------------
@register("impute_random", sql=f"""
WITH {CUST_SQL[1:]},
seen AS (SELECT list(c_acctbal ORDER BY c_acctbal) AS v FROM ci WHERE c_acctbal IS NOT NULL)
SELECT c_custkey, coalesce(c_acctbal, v[1 + {sp.sql_hash(["c_custkey"], 0, "c_acctbal")} % len(v)]) AS c_acctbal FROM ci, seen
""")
def impute_random(spark, sf_dir):
    c = injected_customer(spark, sf_dir)
    return tf.random_impute(c, "c_acctbal", "c_custkey", seed=0).select("c_custkey", "c_acctbal")


# --- sparse_matrix_map: X8, J12 ---------------------------------------------
SM_METR = ["p_size", "p_retailprice"]
SM_CATE = ["p_type", "size_band"]


@register("sparse_matrix_map", sql="""
WITH p AS (SELECT p_size, p_retailprice, p_type, CASE WHEN p_size <= 25 THEN 'S' ELSE 'L' END AS size_band FROM part),
m AS (
  SELECT 0 AS grp, 0 AS sub, 'p_size' AS variable, CAST(NULL AS VARCHAR) AS value, (SELECT count(*) FROM p WHERE p_size <> 0) AS nnz
  UNION ALL SELECT 0, 1, 'p_retailprice', NULL, (SELECT count(*) FROM p WHERE p_retailprice <> 0)
  UNION ALL SELECT 1, 0, 'p_type', p_type, count(*) FROM p GROUP BY p_type
  UNION ALL SELECT 2, 0, 'size_band', size_band, count(*) FROM p GROUP BY size_band
)
SELECT CAST(row_number() OVER (ORDER BY grp, sub, value) - 1 AS INTEGER) AS position, variable, value, nnz FROM m
""")
def sparse_matrix_map(spark, sf_dir):
    p = read_table(spark, sf_dir, "part", ["p_size", "p_retailprice", "p_type"]).withColumn(
        "size_band", F.when(F.col("p_size") <= 25, "S").otherwise("L"))
    m = tf.SparseMatrixBuilder(SM_METR, SM_CATE).fit(p)
    nz = tf.active_positions(m.transform(p), []).groupBy("position").agg(F.count(F.lit(1)).alias("nnz"))
    return m.position_map().join(nz, "position", "left").fillna(0, ["nnz"])


@register("sparse_matrix_keys", sql="""
WITH m AS (
  SELECT 0 AS grp, 'o_totalprice' AS variable, CAST(NULL AS VARCHAR) AS value, count(*) FILTER (o_totalprice <> 0) AS nnz FROM orders
  UNION ALL SELECT 1, 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY o_orderpriority
  UNION ALL SELECT 2, 'o_custkey', CAST(o_custkey AS VARCHAR), count(*) FROM orders GROUP BY o_custkey
)
SELECT CAST(row_number() OVER (ORDER BY grp, value) - 1 AS INTEGER) AS position, variable, value, nnz FROM m
""")
def sparse_matrix_keys(spark, sf_dir):
    """One-hot vectors with a feature whose levels grow with the data: the levels stay a table."""
    o = read_table(spark, sf_dir, "orders", ["o_totalprice", "o_orderpriority", "o_custkey"])
    m = tf.SparseMatrixBuilder(["o_totalprice"], ["o_orderpriority", "o_custkey"]).fit(o)
    nz = tf.active_positions(m.transform(o), []).groupBy("position").agg(F.count(F.lit(1)).alias("nnz"))
    return m.position_map().join(nz, "position", "left").fillna(0, ["nnz"])


# --- group_derive: X10, W8 --------------------------------------------------
@register("group_derive", sql=f"""
SELECT l_orderkey, l_linenumber, substring(l_returnflag, 1, 1) AS flag_initial,
       CAST(l_quantity AS INTEGER) + l_linenumber + 1 AS size,
       {sql_r6('avg(l_extendedprice) OVER (PARTITION BY l_orderkey)')} AS price_per_order
FROM lineitem
""")
def group_derive(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_returnflag",
                                                "l_quantity", "l_extendedprice"])
    out = tf.group_derive(li, ("l_returnflag", "flag_initial"), (["l_quantity", "l_linenumber"], "size"),
                          ("l_extendedprice", "l_orderkey", "price_per_order"))
    return out.select("l_orderkey", "l_linenumber", "flag_initial", "size",
                      r6("price_per_order").alias("price_per_order"))


# --- rescale_probabilities: X11, F9, F10 + T7 shares --------------------------
@register("rescale_probabilities", sql=f"""
WITH {SCORED_SQL[1:]},
cp AS (SELECT doc_id, 0 AS class, 1 - score AS p FROM sd UNION ALL SELECT doc_id, 1, score FROM sd),
ba AS (SELECT quality AS class, count(*) / (SELECT count(*) FROM sd) AS b_all, least(count(*), 100) AS ns FROM sd GROUP BY 1),
bs AS (SELECT class, b_all, ns / (SELECT sum(ns) FROM ba) AS b_sample FROM ba),
t AS (SELECT cp.doc_id, cp.class, cp.p * bs.b_all / bs.b_sample AS t FROM cp JOIN bs ON cp.class = bs.class)
SELECT doc_id, class, {sql_r6('t / sum(t) OVER (PARTITION BY doc_id)')} AS p_rescaled,
       {sql_r6('exp(3 * t) / sum(exp(3 * t)) OVER (PARTITION BY doc_id)')} AS softmax,
       {sql_r6('1 / (1 + exp(-(4 * t - 2)))')} AS logistic
FROM t
""")
def rescale_probabilities(spark, sf_dir):
    d = scored_docs(spark, sf_dir)
    _, shares = sp.undersample(d, "quality", 100, ["doc_id"])
    probs = d.select("doc_id", F.explode(F.array(
        F.struct(F.lit(0).alias("class"), (1 - F.col("score")).alias("p")),
        F.struct(F.lit(1).alias("class"), F.col("score").alias("p")))).alias("s")).select("doc_id", "s.*")
    ba = shares.select(F.col("class").cast("int"), F.col("b_all").alias("share"))
    bs = shares.select(F.col("class").cast("int"), F.col("b_sample").alias("share"))
    t = probs.join(ba.withColumnRenamed("share", "_ba"), "class").join(bs.withColumnRenamed("share", "_bs"), "class") \
        .withColumn("t", F.col("p") * F.col("_ba") / F.col("_bs"))
    out = tf.rescale_probabilities(probs, "doc_id", "class", "p", bs, ba).withColumnRenamed("p", "p_rescaled")
    w = Window.partitionBy("doc_id")
    t = t.select("doc_id", "class", (F.exp(3 * F.col("t")) / F.sum(F.exp(3 * F.col("t"))).over(w)).alias("softmax"),
                 inv_logit(4 * F.col("t") - 2).alias("logistic"))
    return rounded(out.join(t, ["doc_id", "class"]), ["p_rescaled", "softmax", "logistic"])


# --- samples and splits (rows-only + property tests) -------------------------
@register("sample_n", sql=f"""
SELECT o_orderkey, o_totalprice FROM orders ORDER BY {sp.sql_hash(["o_orderkey"], 1)}, o_orderkey LIMIT 1000
""")
def sample_n(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_totalprice"])
    return sp.sample_n(o, 1000, ["o_orderkey"], seed=1)


@register("sample_series", sql=f"""
WITH {sf.FEATURE_PANEL[1:]},
few AS (SELECT id FROM (SELECT DISTINCT id FROM fp) ORDER BY {sp.sql_hash(["id"], 1)}, id LIMIT 100)
SELECT id, CAST(date AS VARCHAR) AS date, demand FROM fp WHERE id IN (SELECT id FROM few)
""")
def sample_series_q(spark, sf_dir):
    """Whole series sampled by id hash from the daily panel."""
    from almanac.plans.panel import feature_input
    f = feature_input(spark, sf_dir)
    return sample_series(f.select("id", "date", "demand"), "id", 100, seed=1).select(
        "id", F.date_format("date", "yyyy-MM-dd").alias("date"), "demand")


@register("undersample", sql=f"""
SELECT o_orderkey, o_orderstatus FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {sp.sql_hash(["o_orderkey"], 42)}, o_orderkey) AS r FROM orders)
WHERE r <= 1000
""")
def undersample(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderstatus"])
    s, _ = sp.undersample(o, "o_orderstatus", 1000, ["o_orderkey"])
    return s


@register("cv_split", sql=f"""
WITH o AS (SELECT o_orderkey, CASE WHEN year(o_orderdate) >= 2000 THEN 'test' ELSE 'train' END AS fold FROM orders),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY fold ORDER BY {sp.sql_hash(["o_orderkey"], 42)}, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY fold) AS n FROM o),
parts AS (
  SELECT *, CASE WHEN i < (n % 5) * (n // 5 + 1) THEN i // (n // 5 + 1) ELSE n % 5 + (i - (n % 5) * (n // 5 + 1)) // nullif(n // 5, 0) END AS part FROM numbered)
SELECT o_orderkey, fold, CAST(s AS INTEGER) AS split, fold AS role FROM parts, range(0, 5) t(s) WHERE (fold = 'train') = (s <> part)
""")
def cv_split(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderdate"]).withColumn(
        "fold", F.when(F.year("o_orderdate") >= 2000, "test").otherwise("train"))
    return sp.cv_split(o, ["o_orderkey"], 5).select("o_orderkey", "fold", "split", "role")


@register("bootstrap_split")
def bootstrap_split(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderdate"]).withColumn(
        "fold", F.when(F.year("o_orderdate") >= 2000, "test").otherwise("train"))
    return sp.bootstrap_split(o, ["o_orderkey"], 3).select("o_orderkey", "fold", "split", "role", "_rep")


@register("shuffle_split", sql=f"""
SELECT o_orderkey, CASE WHEN {sp.sql_hash(["o_orderkey"], 1)} / {float(sp.TWO52)} < 0.2 THEN 'test' ELSE 'train' END AS role FROM orders
""")
def shuffle_split(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders", ["o_orderkey"])
    return sp.shuffle_split(o, ["o_orderkey"], 0.2)


@register("weighted_bootstrap")
def weighted_bootstrap(spark, sf_dir):
    """Series-day rows resampled with weight sqrt(weight_sales)."""
    from almanac.plans import panel as pl
    wp = pl.weighted_panel(pl.base_panel(spark, sf_dir)).where(F.col("fold") == "train")
    return sp.weighted_bootstrap(wp.select("id", "date", "demand", "weight_sales"), ["id", "date"],
                                 F.sqrt(F.coalesce(F.col("weight_sales"), F.lit(0.0))), seed=2) \
        .select("id", F.date_format("date", "yyyy-MM-dd").alias("date"), "demand", "_rep")


@register("train_size_subsets", sql=f"""
SELECT o_orderkey, s.s AS train_size FROM orders, (SELECT unnest({TRAIN_SIZES}) AS s) s WHERE {sp.sql_hash(["o_orderkey"], 1)} / {float(sp.TWO52)} <= s.s
""")
def train_size_subsets(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders", ["o_orderkey"])
    return sp.train_size_subsets(o, ["o_orderkey"], TRAIN_SIZES)
