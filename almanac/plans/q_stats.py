"""Catalogue: profiles, association, correlation, AUC and distributions (step 6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.operators import modeling as md
from almanac.operators import stats as st
from almanac.plans.registry import r6, register, rounded, sql_r6
from almanac.session import cut_lineage
from almanac.sources.tables import metadata_table, read_table, ready_columns


def _union(parts):
    return "\nUNION ALL\n".join(parts)


# --- profile_columns: A17 ---------------------------------------------------
LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("profile_columns", sql="SELECT variable, count, " + ", ".join(
    f"{sql_r6(c)} AS {c}" for c in ["mean", "std", "min", "max", "q25", "q50", "q75"]) + " FROM (" + _union([
        f"SELECT '{c}' AS variable, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, "
        f"min({c}) AS min, max({c}) AS max, quantile_cont({c}, 0.25) AS q25, "
        f"quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75 FROM lineitem" for c in LI_NUM]) + ")")
def profile_columns(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem", LI_NUM)
    return rounded(st.profile(li, LI_NUM))


# --- missing_share: A15, A16, P25, P26 --------------------------------------
def injected_orders(spark, sf_dir):
    """orders with injected nulls (FIXTURES 2.5): price null where key % 7 = 0,
    priority null where key % 5 = 0, a 98%-null date and a one-level flag."""
    o = read_table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        "o_orderkey", "o_custkey", "o_orderstatus",
        F.when(k % 7 != 0, F.col("o_totalprice")).alias("o_totalprice"),
        F.when(k % 5 != 0, F.col("o_orderpriority")).alias("o_orderpriority"),
        F.when(k % 50 == 0, F.col("o_orderdate")).alias("o_sparse_date"),
        F.when(F.col("o_totalprice") > -1, F.lit("all")).alias("o_flag"))


INJ_SQL = """
oi AS (
  SELECT o_orderkey, o_custkey, o_orderstatus,
         CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS o_totalprice,
         CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS o_orderpriority,
         CASE WHEN o_orderkey % 50 = 0 THEN o_orderdate END AS o_sparse_date,
         CASE WHEN o_totalprice > -1 THEN 'all' END AS o_flag
  FROM orders
)"""
OI_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority",
           "o_sparse_date", "o_flag"]


@register("missing_share", sql=f"""
WITH {INJ_SQL[1:]}
SELECT variable, {sql_r6('miss_share')} AS miss_share, CAST(miss_share > 0.95 AS INTEGER) AS drop,
       n_unique, CAST(n_unique = 1 AS INTEGER) AS one_level
FROM ({_union([f"SELECT '{c}' AS variable, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS miss_share, "
               f"count(DISTINCT {c}) AS n_unique FROM oi" for c in OI_COLS])})
""")
def missing_share(spark, sf_dir):
    o = injected_orders(spark, sf_dir)
    ms = st.missing_share(o, OI_COLS)
    nu = st.n_unique(o, OI_COLS)
    return rounded(ms.join(nu, "variable"), ["miss_share"])


# --- top_values: A14, T3 ----------------------------------------------------
PART_STR = ["p_brand", "p_type", "p_name"]


@register("top_values", sql=f"""
WITH c AS ({_union([f"SELECT '{c}' AS variable, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM part WHERE {c} IS NOT NULL GROUP BY {c}" for c in PART_STR])}),
r AS (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY n DESC, value) AS rank FROM c)
SELECT variable, value, n, rank FROM r WHERE rank <= 10
""")
def top_values(spark, sf_dir):
    return st.top_values(read_table(spark, sf_dir, "part", PART_STR), PART_STR, 10)


# --- schema_diff: P23, P24, S6, U4, E23 -------------------------------------
# Fixture metadata sheet for the orders table (variable, status, modeltype, h_dep)
ORDERS_META = [("o_orderkey", "ready", "metr", "N"), ("o_custkey", "ready", "cate", "N"),
               ("o_orderstatus", "ready", "cate", "N"), ("o_totalprice", "ready", "metr", "N"),
               ("o_orderpriority", "ready", "cate", "Y"), ("o_comment", "ready", "cate", "N"),
               ("o_shippriority", "draft", "metr", "N")]
ORDERS_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_META_VALUES = ", ".join(f"('{a}', '{b}', '{c}', '{d}')" for a, b, c, d in ORDERS_META)


@register("schema_diff", sql=f"""
WITH meta AS (SELECT * FROM (VALUES {_META_VALUES}) t(variable, status, modeltype, h_dep)),
cols AS (SELECT column_name AS variable FROM (DESCRIBE orders)),
ms AS ({_union([f"SELECT '{c}' AS variable, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS miss_share FROM orders" for c in ORDERS_COLS])})
SELECT COALESCE(m.variable, c.variable) AS variable,
       CAST(m.variable IS NOT NULL AS INTEGER) AS in_meta, CAST(c.variable IS NOT NULL AS INTEGER) AS in_data,
       m.status, m.modeltype, m.h_dep,
       CAST(COALESCE(m.status = 'ready', FALSE) AND c.variable IS NOT NULL AS INTEGER) AS use_feature,
       CASE WHEN m.modeltype = 'metr' AND m.h_dep = 'N' THEN 'metr'
            WHEN m.modeltype = 'cate' AND m.h_dep = 'N' THEN 'cate' END AS feature_list,
       {sql_r6('ms.miss_share')} AS miss_share
FROM meta m FULL OUTER JOIN cols c ON m.variable = c.variable
LEFT JOIN ms ON ms.variable = COALESCE(m.variable, c.variable)
""")
def schema_diff(spark, sf_dir):
    """Columns of the data vs the metadata sheet, both directions (set
    difference as a full outer join of two name tables), with the feature
    lists the sheet implies and each data column's null share."""
    o = read_table(spark, sf_dir, "orders")
    meta = metadata_table(spark, ORDERS_META)
    cols = spark.createDataFrame([(c,) for c in o.columns], "variable string")
    ms = st.missing_share(o).select("variable", "miss_share")
    j = meta.alias("m").join(cols.alias("c"), F.col("m.variable") == F.col("c.variable"), "full_outer")
    var = F.coalesce(F.col("m.variable"), F.col("c.variable"))
    out = j.select(
        var.alias("variable"),
        F.col("m.variable").isNotNull().cast("int").alias("in_meta"),
        F.col("c.variable").isNotNull().cast("int").alias("in_data"),
        "m.status", "m.modeltype", "m.h_dep",
        (F.coalesce(F.col("m.status") == "ready", F.lit(False)) & F.col("c.variable").isNotNull())
        .cast("int").alias("use_feature"),
        F.when((F.col("m.modeltype") == "metr") & (F.col("m.h_dep") == "N"), "metr")
        .when((F.col("m.modeltype") == "cate") & (F.col("m.h_dep") == "N"), "cate").alias("feature_list"))
    return out.join(ms, "variable", "left").withColumn("miss_share", r6("miss_share"))


# --- narrow_types: P15, P16 -------------------------------------------------
def _narrow_sql():
    ints = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    flts = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    parts = [f"SELECT '{c}' AS variable, '{'int' if c in ints else 'float'}' AS kind, "
             f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM lineitem"
             for c in ints + flts]
    it = " ".join(f"WHEN min > {float(lo)} AND max < {float(hi)} THEN '{n}'" for n, _, lo, hi in st.INT_RANGES)
    ft = (f"CASE WHEN min > -{st.FLOAT16_MAX} AND max < {st.FLOAT16_MAX} THEN 'float16' "
          f"WHEN min > -{st.FLOAT32_MAX!r} AND max < {st.FLOAT32_MAX!r} THEN 'float32' ELSE 'float64' END")
    sm = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in [(r[0], r[1]) for r in st.INT_RANGES] +
                  [("float16", "float"), ("float32", "float"), ("float64", "double")])
    return f"""
WITH mm AS ({_union(parts)}),
t AS (SELECT *, CASE WHEN kind = 'int' THEN CASE {it} END ELSE {ft} END AS np_type FROM mm)
SELECT variable, kind, min, max, np_type, CASE np_type {sm} END AS spark_type FROM t
"""


@register("narrow_types", sql=_narrow_sql())
def narrow_types(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    return st.narrow_types_plan(li.drop("l_returnflag", "l_linestatus", "l_shipdate"), float_convert=True)


@register("narrowed_sums", sql=f"""
SELECT count(*) AS n, sum(CAST(l_linenumber AS BIGINT)) AS lines, {sql_r6('sum(CAST(CAST(l_quantity AS FLOAT) AS DOUBLE))')} AS quantity,
       {sql_r6('max(CAST(CAST(l_extendedprice AS FLOAT) AS DOUBLE))')} AS price, 'tinyint' AS line_type, 'float' AS price_type FROM lineitem
""")
def narrowed_sums(spark, sf_dir):
    """The plan of narrow types applied to the table, and totals of the narrowed columns."""
    li = read_table(spark, sf_dir, "lineitem", ["l_linenumber", "l_quantity", "l_extendedprice"])
    plan = [(r["variable"], r["spark_type"]) for r in st.narrow_types_plan(li, float_convert=True).collect()]  # a row per column
    narrow = st.apply_types(li, plan)
    types = dict(narrow.dtypes)
    out = narrow.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_linenumber").cast("long")).alias("lines"), F.sum(F.col("l_quantity").cast("double")).alias("quantity"),
                     F.max(F.col("l_extendedprice").cast("double")).alias("price"))
    return rounded(out, ["quantity", "price"]).withColumns({"line_type": F.lit(types["l_linenumber"]), "price_type": F.lit(types["l_extendedprice"])})


@register("drop_columns", sql=f"""
WITH {INJ_SQL[1:]}
SELECT o_orderkey, o_custkey, o_orderstatus, {sql_r6('o_totalprice')} AS o_totalprice, o_orderpriority FROM oi
""")
def drop_columns(spark, sf_dir):
    """Orders without the column that is null on more than 95 of 100 rows and the one that has one level."""
    o = st.drop_columns(injected_orders(spark, sf_dir), OI_COLS)
    return rounded(o)


# --- feature_lists: S6, P24, E23 ----------------------------------------------
LISTS_META = [("o_totalprice", "ready", "metr", "N"), ("c_acctbal", "ready", "metr", "N"), ("o_flag", "ready", "metr", "N"), ("o_shippriority", "draft", "metr", "N"),
              ("o_orderstatus", "ready", "cate", "N"), ("o_orderpriority", "ready", "cate", "N"), ("o_custkey", "ready", "cate", "N"), ("o_comment", "ready", "cate", "Y")]
LISTS_TOP = 10
_LISTS_SRC = """
fl AS (SELECT o_totalprice, c_acctbal, 1.0 AS o_flag, o_orderstatus, o_orderpriority, CAST(o_custkey AS VARCHAR) AS o_custkey
       FROM orders JOIN customer ON o_custkey = c_custkey)"""


@register("feature_lists", sql=f"""
WITH {_LISTS_SRC[1:]},
meta AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}', '{c}', '{d}')" for a, b, c, d in LISTS_META)}) t(variable, status, modeltype, h_dep)),
ready AS (SELECT variable, modeltype FROM meta WHERE status = 'ready' AND h_dep = 'N'),
k AS ({_union([f"SELECT '{v}' AS variable, count(DISTINCT {v}) AS n FROM fl" for v, s, _, h in LISTS_META if s == 'ready' and h == 'N'])}),
r AS (SELECT ready.*, k.n, modeltype = 'cate' AND n > {LISTS_TOP} AS many FROM ready JOIN k USING (variable))
SELECT 'standard' AS list, 'metr' AS kind, CASE WHEN many THEN variable || '_ENCODED' ELSE variable END AS feature FROM r WHERE modeltype = 'metr' OR many
UNION ALL SELECT 'standard', 'cate', variable FROM r WHERE modeltype = 'cate'
UNION ALL SELECT 'binned', 'cate', variable || '_BINNED' FROM r WHERE modeltype = 'metr' AND n > 1
UNION ALL SELECT 'binned', 'cate', variable FROM r WHERE modeltype = 'cate'
UNION ALL SELECT 'encoded', 'metr', CASE WHEN modeltype = 'cate' THEN variable || '_ENCODED' ELSE variable END FROM r
""")
def feature_lists(spark, sf_dir):
    """The columns that each kind of learner reads, from the ready rows of the metadata sheet and the data's levels."""
    o = read_table(spark, sf_dir, "orders", ["o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority"])
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_acctbal"])
    d = o.join(c, o.o_custkey == c.c_custkey).withColumns({"o_flag": F.lit(1.0), "o_custkey": F.col("o_custkey").cast("string")})
    return st.feature_lists(ready_columns(metadata_table(spark, LISTS_META)).where("h_dep = 'N'"), d, LISTS_TOP)


# --- crosstab_share: A18 ----------------------------------------------------
@register("crosstab_share", sql=f"""
WITH ct AS (SELECT o_orderpriority, o_orderstatus, CAST(count(*) AS DOUBLE) AS n FROM orders
            WHERE o_orderpriority IS NOT NULL AND o_orderstatus IS NOT NULL GROUP BY ALL)
SELECT o_orderpriority, o_orderstatus, n,
       {sql_r6('n / sum(n) OVER (PARTITION BY o_orderpriority)')} AS row_share,
       {sql_r6('n / (SELECT sum(n) FROM ct)')} AS pct_total
FROM ct
""")
def crosstab_share(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders", ["o_orderpriority", "o_orderstatus"])
    return rounded(st.crosstab_long(o, "o_orderpriority", "o_orderstatus"), ["row_share", "pct_total"])


# --- group_share_mean: A21, W8 ----------------------------------------------
@register("group_share_mean", sql=f"""
WITH g AS (SELECT c_mktsegment, count(*) AS n, avg(o_totalprice) AS target_mean
           FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment)
SELECT c_mktsegment, n, {sql_r6('target_mean')} AS target_mean,
       {sql_r6('CAST(n AS DOUBLE) / (SELECT sum(n) FROM g)')} AS share
FROM g
""")
def group_share_mean(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders", ["o_custkey", "o_totalprice"])
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment"])
    d = o.join(c, o.o_custkey == c.c_custkey)
    return rounded(st.group_share_mean(d, "c_mktsegment", "o_totalprice"), ["target_mean", "share"])


# --- two_key_mean: A31 ------------------------------------------------------
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@register("two_key_mean", sql="""
SELECT c_mktsegment, """ + ", ".join(
    f"{sql_r6(f'avg(CASE WHEN o_orderpriority = {chr(39)}{p}{chr(39)} THEN o_totalprice END)')} AS \"{p}\""
    for p in PRIORITIES) + """
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment
""")
def two_key_mean(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders", ["o_custkey", "o_totalprice", "o_orderpriority"])
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment"])
    d = o.join(c, o.o_custkey == c.c_custkey)
    return rounded(st.two_key_matrix(d, "c_mktsegment", "o_orderpriority", "o_totalprice", PRIORITIES))


# --- assoc_contingency / assoc_cramers_v: A19 --------------------------------
ASSOC_COLS = ["p_type", "p_brand", "size_band", "parity"]
ASSOC_SQL_BASE = """
WITH p AS (
  SELECT p_type, p_brand, CASE WHEN p_size <= 25 THEN 'S' ELSE 'L' END AS size_band,
         CASE WHEN p_partkey % 2 = 0 THEN 'even' ELSE 'odd' END AS parity FROM part
),
cells AS (""" + _union([
    f"SELECT '{a}' AS var1, '{b}' AS var2, CAST({a} AS VARCHAR) AS l1, CAST({b} AS VARCHAR) AS l2, "
    f"CAST(count(*) AS DOUBLE) AS o FROM p WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL"
    for i, a in enumerate(ASSOC_COLS) for b in ASSOC_COLS[i + 1:]]) + """),
r AS (SELECT var1, var2, l1, sum(o) AS r FROM cells GROUP BY ALL),
c AS (SELECT var1, var2, l2, sum(o) AS c FROM cells GROUP BY ALL),
d AS (SELECT var1, var2, sum(o) AS n, count(DISTINCT l1) AS k1, count(DISTINCT l2) AS k2 FROM cells GROUP BY ALL),
grid AS (SELECT r.var1, r.var2, r.l1, c.l2, r.r, c.c FROM r JOIN c ON r.var1 = c.var1 AND r.var2 = c.var2),
full_cells AS (
  SELECT g.var1, g.var2, COALESCE(x.o, 0) AS o, g.r * g.c / d.n AS e, d.n, d.k1, d.k2
  FROM grid g JOIN d ON g.var1 = d.var1 AND g.var2 = d.var2
  LEFT JOIN cells x ON x.var1 = g.var1 AND x.var2 = g.var2 AND x.l1 = g.l1 AND x.l2 = g.l2
),
chi AS (
  SELECT var1, var2, any_value(n) AS n, least(any_value(k1), any_value(k2)) AS m,
         sum(CASE WHEN k1 = 2 AND k2 = 2
                  THEN pow(o + least(0.5, abs(e - o)) * sign(e - o) - e, 2) / e
                  ELSE pow(o - e, 2) / e END) AS chi2
  FROM full_cells GROUP BY var1, var2
)"""


@register("assoc_contingency", sql=ASSOC_SQL_BASE + f"""
SELECT var1, var2, {sql_r6('sqrt(chi2 / (n + chi2)) * sqrt(CAST(m AS DOUBLE) / NULLIF(m - 1, 0))')} AS contingency
FROM chi
""")
def assoc_contingency(spark, sf_dir):
    return rounded(st.association(_assoc_input(spark, sf_dir), ASSOC_COLS, "contingency"))


@register("assoc_cramers_v", sql=ASSOC_SQL_BASE + f"""
SELECT var1, var2, {sql_r6('sqrt(chi2 / (n * NULLIF(m - 1, 0)))')} AS cramersv
FROM chi
""")
def assoc_cramers_v(spark, sf_dir):
    return rounded(st.association(_assoc_input(spark, sf_dir), ASSOC_COLS, "cramersv"))


def _assoc_input(spark, sf_dir):
    p = read_table(spark, sf_dir, "part", ["p_partkey", "p_type", "p_brand", "p_size"])
    return p.select("p_type", "p_brand",
                    F.when(F.col("p_size") <= 25, "S").otherwise("L").alias("size_band"),
                    F.when(F.col("p_partkey") % 2 == 0, "even").otherwise("odd").alias("parity"))


# --- spearman_pairs / pearson: A11, A20, W11 ---------------------------------
def _li_nulls(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey"] + LI_NUM)
    return li.withColumn("l_discount", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_discount"))).drop("l_orderkey")


LI_NULLS_SQL = """
li AS (SELECT l_quantity, l_extendedprice, CASE WHEN l_orderkey % 7 <> 0 THEN l_discount END AS l_discount, l_tax
       FROM lineitem)"""
PAIRS = [(a, b) for i, a in enumerate(LI_NUM) for b in LI_NUM[i + 1:]]


def _rank_sql(c):
    return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"


@register("spearman_pairs", sql=f"""
WITH {LI_NULLS_SQL[1:]},
rk AS ({_union([f"SELECT '{a}' AS var1, '{b}' AS var2, {_rank_sql(a)} AS rx, {_rank_sql(b)} AS ry FROM li WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in PAIRS])}),
ms AS ({_union([f"SELECT '{c}' AS col, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS miss FROM li" for c in LI_NUM])})
SELECT var1, var2, {sql_r6('abs(corr(rx, ry))')} AS abs_spearman,
       {sql_r6('any_value(m1.miss)')} AS miss1, {sql_r6('any_value(m2.miss)')} AS miss2
FROM rk JOIN ms m1 ON m1.col = var1 JOIN ms m2 ON m2.col = var2
GROUP BY var1, var2
""")
def spearman_pairs(spark, sf_dir):
    return rounded(st.spearman_pairs(_li_nulls(spark, sf_dir), LI_NUM))


CUTOFF = 0.3
ORDER_NUM = ["qty", "gross", "n_lines", "disc"]
_ORDER_NUM_SQL = """
od AS (SELECT sum(l_quantity) AS qty, CASE WHEN l_orderkey % 5 <> 0 THEN CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) END AS gross,
              CAST(count(*) AS DOUBLE) AS n_lines, floor(avg(l_discount) * 1e6 + 0.5e0) / 1e6 AS disc FROM lineitem GROUP BY l_orderkey)"""
_ORDER_PAIRS = [(a, b) for i, a in enumerate(ORDER_NUM) for b in ORDER_NUM[i + 1:]]


@register("spearman_cutoff", sql=f"""
WITH {_ORDER_NUM_SQL[1:]},
rk AS ({_union([f"SELECT '{a}' AS var1, '{b}' AS var2, {_rank_sql(a)} AS rx, {_rank_sql(b)} AS ry FROM od WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in _ORDER_PAIRS])}),
rho AS (SELECT var1, var2, abs(corr(rx, ry)) AS abs_spearman FROM rk GROUP BY var1, var2),
kept AS (SELECT v FROM (SELECT var1 AS v, abs_spearman FROM rho UNION ALL SELECT var2, abs_spearman FROM rho) GROUP BY v HAVING max(abs_spearman) > {CUTOFF})
SELECT var1, var2, {sql_r6('abs_spearman')} AS abs_spearman FROM rho WHERE var1 IN (SELECT v FROM kept) AND var2 IN (SELECT v FROM kept)
""")
def spearman_cutoff(spark, sf_dir):
    """Pairs of the columns of an order that correlate with some other column above the cutoff."""
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount"])
    gross = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double")
    od = li.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("qty"), F.when(F.col("l_orderkey") % 5 != 0, gross).alias("gross"),
                                      F.count(F.lit(1)).cast("double").alias("n_lines"), r6(F.avg("l_discount")).alias("disc"))
    return rounded(st.spearman_pairs(cut_lineage(od, "orders"), ORDER_NUM, CUTOFF).select("var1", "var2", "abs_spearman"))


@register("pearson", sql=f"""
WITH {LI_NULLS_SQL[1:]}
{_union([f"SELECT '{a}' AS var1, '{b}' AS var2, {sql_r6(f'corr({a}, {b})')} AS pearson FROM li" for a, b in PAIRS])}
""")
def pearson(spark, sf_dir):
    li = _li_nulls(spark, sf_dir)
    row = li.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in PAIRS])
    long = row.unpivot([], [f"{a}|{b}" for a, b in PAIRS], "pair", "pearson")
    return long.select(F.split("pair", r"\|")[0].alias("var1"), F.split("pair", r"\|")[1].alias("var2"),
                       r6("pearson").alias("pearson"))


# --- auc_rank / auc_ovr: A12, W11 ---------------------------------------------
def scored_docs(spark, sf_dir):
    """labels x documents: binary targets with score n_chars / (n_chars + 1000)."""
    lab = read_table(spark, sf_dir, "labels")
    doc = read_table(spark, sf_dir, "documents", ["doc_id", "n_chars", "lang", "source"])
    return (lab.join(doc, "doc_id")
            .withColumn("score", F.col("n_chars") / (F.col("n_chars") + F.lit(1000.0))))


SCORED_SQL = """
sd AS (SELECT l.doc_id, l.quality, l.toxic, d.n_chars, d.lang, d.source,
              d.n_chars / (d.n_chars + 1000.0) AS score
       FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def _auc_sql(src, y, s, extra=""):
    return (f"(SELECT (sum(CASE WHEN {y} = 1 THEN rk END) - sum({y}) * (sum({y}) + 1) / 2.0) "
            f"/ NULLIF(sum({y}) * (count(*) - sum({y})), 0) "
            f"FROM (SELECT {y}, {_rank_sql(s)} AS rk FROM {src} {extra}))")


@register("auc_rank", sql=f"""
WITH {SCORED_SQL[1:]}
SELECT 'quality' AS target, {sql_r6(_auc_sql('sd', 'quality', 'score'))} AS auc
UNION ALL
SELECT 'toxic' AS target, {sql_r6(_auc_sql('sd', 'toxic', 'score'))} AS auc
""")
def auc_rank(spark, sf_dir):
    d = scored_docs(spark, sf_dir)
    long = d.select("score", F.explode(F.array(
        F.struct(F.lit("quality").alias("target"), F.col("quality").alias("y")),
        F.struct(F.lit("toxic").alias("target"), F.col("toxic").alias("y")))).alias("t")).select("score", "t.*")
    return rounded(st.auc(long, "y", "score", by=["target"]))


# orders with rule-based class scores (FIXTURES 2.5): s_j = (key + 3 j) % 7 + 1,
# normalised to sum 1 (the rotation makes the argmax vary between classes)
CLASSES = ["F", "O", "P"]


def class_probs(spark, sf_dir):
    """Long (o_orderkey, y, class, p)."""
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderstatus"])
    s = [((F.col("o_orderkey") + 3 * j) % 7 + 1).cast("double") for j in range(len(CLASSES))]
    tot = s[0] + s[1] + s[2]
    arr = F.array(*[F.struct(F.lit(c).alias("class"), (s[j] / tot).alias("p")) for j, c in enumerate(CLASSES)])
    return o.select("o_orderkey", "o_orderstatus", F.explode(arr).alias("s")).select(
        "o_orderkey", F.col("o_orderstatus").alias("y"), "s.class", "s.p")


_S = [f"CAST((o_orderkey + {3 * j}) % 7 + 1 AS DOUBLE)" for j in range(3)]
CLASS_SQL = "cp AS (" + _union([
    f"SELECT o_orderkey, o_orderstatus AS y, '{c}' AS class, {_S[j]} / ({_S[0]} + {_S[1]} + {_S[2]}) AS p FROM orders"
    for j, c in enumerate(CLASSES)]) + ")"


@register("auc_ovr", sql=f"""
WITH {CLASS_SQL},
per AS ({_union([f"SELECT '{c}' AS class, " + _auc_sql("cp", "yy", "p", f"WHERE class = '{c}'").replace(f"SELECT yy, ", "SELECT CAST(y = class AS INTEGER) AS yy, ") + " AS auc" for c in CLASSES])})
SELECT class, {sql_r6('auc')} AS auc FROM per
UNION ALL SELECT '_macro_', {sql_r6('avg(auc)')} FROM per
""")
def auc_ovr(spark, sf_dir):
    return rounded(st.auc_ovr(class_probs(spark, sf_dir), "o_orderkey", "y"))


@register("multiclass_scores", sql=f"""
WITH {CLASS_SQL},
per AS (SELECT class, (sum(CASE WHEN yy = 1 THEN rk END) - sum(yy) * (sum(yy) + 1) / 2.0) / NULLIF(sum(yy) * (count(*) - sum(yy)), 0) AS auc, sum(yy) AS n_true
        FROM (SELECT class, CAST(y = class AS INTEGER) AS yy, rank() OVER (PARTITION BY class ORDER BY p) + (count(*) OVER (PARTITION BY class, p) - 1) / 2.0 AS rk FROM cp) GROUP BY class),
pr AS (SELECT o_orderkey, y, class AS pred FROM cp QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY p DESC, class) = 1)
SELECT 'auc' AS scorer, {sql_r6('avg(auc)')} AS value FROM per
UNION ALL SELECT 'auc_weighted', {sql_r6('sum(auc * n_true) / sum(n_true)')} FROM per
UNION ALL SELECT 'acc', {sql_r6('avg(CASE WHEN y = pred THEN 1.0 ELSE 0.0 END)')} FROM pr
""")
def multiclass_scores(spark, sf_dir):
    """The MULTICLASS scorers of the registry, and the weighted AUC, over arrays of class probabilities."""
    wide = class_probs(spark, sf_dir).groupBy("o_orderkey", "y").pivot("class", CLASSES).agg(F.first("p"))
    d = wide.select((F.array_position(F.array(*map(F.lit, CLASSES)), F.col("y")) - 1).alias("y"), F.array(*CLASSES).alias("probs"))
    return rounded(md.score_table(d, "y", "probs", [*md.SCORERS["MULTICLASS"], md.WEIGHTED_AUC]))


@register("own_scorer", sql=f"""
WITH {SCORED_SQL[1:]}
SELECT lang, 'brier' AS scorer, {sql_r6('-avg(pow(quality - score, 2))')} AS value FROM sd GROUP BY lang
""")
def own_scorer(spark, sf_dir):
    """A caller's scorer, given as a function, beside the built-in ones: the negative Brier score by language."""
    brier = md.Scorer("brier", lambda df, y, p, by: df.groupBy(*by).agg((-F.avg(F.pow(F.col(y) - F.col(p), 2))).alias("value")), True)
    return rounded(md.score_table(scored_docs(spark, sf_dir), "quality", "score", [brier], ["lang"]))


# --- distributions: A25-A27, A29, A24 ----------------------------------------
@register("histogram_by_class", sql=f"""
WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
h AS (SELECT event_type, least(floor((value - lo) / (hi - lo) * 20.0) + 1, 20) AS bin, count(*) AS n
      FROM events, b WHERE value IS NOT NULL GROUP BY ALL)
SELECT event_type, CAST(bin AS BIGINT) AS bin, n,
       {sql_r6('lo + (bin - 1) * ((hi - lo) / 20)')} AS bin_lo, {sql_r6('lo + bin * ((hi - lo) / 20)')} AS bin_hi
FROM h, b
""")
def histogram_by_class(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events", ["event_type", "value"])
    out = st.histogram(ev, "value", 20, by=["event_type"])
    return rounded(out.withColumn("bin", F.col("bin").cast("long")), ["bin_lo", "bin_hi"])


@register("density_2d", sql="""
WITH e AS (SELECT value AS x, CAST(minute(ts) AS DOUBLE) AS y FROM events),
b AS (SELECT min(x) AS xl, max(x) AS xh, min(y) AS yl, max(y) AS yh FROM e)
SELECT CAST(least(floor((x - xl) / NULLIF((xh - xl) / 10, 0)), 9) AS BIGINT) AS xbin,
       CAST(least(floor((y - yl) / NULLIF((yh - yl) / 10, 0)), 9) AS BIGINT) AS ybin, count(*) AS n
FROM e, b WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL
""")
def density_2d(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events", ["ts", "value"]).select(
        F.col("value").alias("x"), F.minute("ts").cast("double").alias("y"))
    out = st.density_2d(ev, "x", "y", 10, 10)
    return out.select(F.col("xbin").cast("long"), F.col("ybin").cast("long"), "n")


@register("box_stats", sql=f"""
WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
                  quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type)
SELECT e.event_type, {sql_r6('q1')} AS q1, {sql_r6('median')} AS median, {sql_r6('q3')} AS q3,
       {sql_r6('avg(value)')} AS mean,
       {sql_r6('min(CASE WHEN value >= q1 - 1.5 * (q3 - q1) THEN value END)')} AS whisker_lo,
       {sql_r6('max(CASE WHEN value <= q3 + 1.5 * (q3 - q1) THEN value END)')} AS whisker_hi,
       count(value) AS n
FROM events e JOIN q ON e.event_type = q.event_type GROUP BY e.event_type, q1, median, q3
""")
def box_stats(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events", ["event_type", "value"])
    return rounded(st.box_stats(ev, "value", ["event_type"]))


@register("ecdf", sql=f"""
SELECT event_type, value, {sql_r6('ecdf')} AS ecdf FROM (
  SELECT DISTINCT event_type, value, cume_dist() OVER (PARTITION BY event_type ORDER BY value) AS ecdf
  FROM events WHERE value IS NOT NULL)
""")
def ecdf(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events", ["event_type", "value"])
    return rounded(st.ecdf(ev, "value", ["event_type"]), ["ecdf"])


@register("quantile_grid", sql="SELECT variable, prob, " + sql_r6("quantile") + " AS quantile FROM (" + _union([
    f"SELECT '{c}' AS variable, CAST(unnest([{', '.join(str(round(i / 10, 1)) for i in range(11))}]) AS DOUBLE) AS prob, "
    f"unnest(quantile_cont({c}, [{', '.join(str(round(i / 10, 1)) for i in range(11))}])) AS quantile FROM lineitem"
    for c in LI_NUM]) + ")")
def quantile_grid(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem", LI_NUM)
    return rounded(st.quantile_grid(li, LI_NUM, 0.1))
