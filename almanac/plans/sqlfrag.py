"""DuckDB SQL fragments for the oracle side: panel, calendar and prices.

These mirror ``almanac.sources.fixtures`` in plain ANSI SQL (DuckDB dialect)
and are only used by ``oracle_sql()``; the Spark side never runs them.
"""

from __future__ import annotations

from almanac.sources.fixtures import (EASTER_DATES, EVENT2_OVERRIDES, EVENTS_BY_MONTH_DAY, HOLIDAYS, HORIZON,
                                      ORTHODOX_EASTER_DATES, SNAP_FLAG_BY_STATE, UTIL_DAYS)

# the panel's span and cuts, from the ship dates
START = "(SELECT CAST(min(l_shipdate) AS DATE) FROM lineitem)"
END = f"(SELECT CAST(max(l_shipdate) AS DATE) + {HORIZON} FROM lineitem)"
TEST_START = "(SELECT CAST(max(l_shipdate) AS DATE) + 1 FROM lineitem)"
INNER_TEST_START = f"(SELECT CAST(max(l_shipdate) AS DATE) + {1 - HORIZON} FROM lineitem)"
UTIL_BEFORE = f"(SELECT CAST(min(l_shipdate) AS DATE) + {UTIL_DAYS} FROM lineitem)"


def _q(xs) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


def _dq(xs) -> str:
    return ", ".join(f"DATE '{x}'" for x in xs)


DEPT = "p.p_type || '_' || CASE WHEN p.p_size <= 25 THEN '1' ELSE '2' END"

KEYED = f"""
keyed AS (
  SELECT CAST(l.l_shipdate AS DATE) AS date,
         {DEPT} || '_' || CAST(p.p_partkey % 2 AS VARCHAR) AS item_id,
         {DEPT} AS dept_id, p.p_type AS cat_id, n.n_name AS store_id, r.r_name AS state_id,
         CAST(l.l_quantity AS DECIMAL(18,2)) AS qty,
         CAST(l.l_extendedprice AS DECIMAL(18,2)) AS price_sum
  FROM lineitem l
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  WHERE l.l_shipdate IS NOT NULL
),
daily AS (
  SELECT item_id || '_' || store_id || '_evaluation' AS id, item_id, dept_id, cat_id, store_id, state_id,
         date, SUM(qty) AS qty, SUM(price_sum) AS price_sum
  FROM keyed GROUP BY ALL
),
series AS (SELECT DISTINCT id, item_id, dept_id, cat_id, store_id, state_id FROM daily),
days AS (
  SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT {START} AS a, {END} AS b)
)"""

PANEL = KEYED + f""",
panel AS (
  SELECT s.id, s.item_id, s.dept_id, s.cat_id, s.store_id, s.state_id,
         'd_' || CAST(date_diff('day', {START}, d.date) + 1 AS VARCHAR) AS d, d.date,
         CASE WHEN d.date < {TEST_START} THEN CAST(COALESCE(y.qty, 0) AS DOUBLE) END AS demand,
         CASE WHEN d.date >= {TEST_START} THEN 'test' ELSE 'train' END AS fold,
         CASE WHEN d.date >= {TEST_START} THEN NULL
              WHEN d.date >= {INNER_TEST_START} THEN 'test' ELSE 'train' END AS myfold
  FROM series s CROSS JOIN days d
  LEFT JOIN daily y ON y.id = s.id AND y.date = d.date
)"""


def _event_case(col: str) -> str:
    idx = 0 if col == "name" else 1
    whens = " ".join(f"WHEN strftime(date, '%m-%d') = '{k}' THEN '{v[idx]}'"
                     for k, v in EVENTS_BY_MONTH_DAY.items())
    orth = "'OrthodoxEaster'" if col == "name" else "'Religious'"
    return f"CASE WHEN date IN ({_dq(ORTHODOX_EASTER_DATES)}) THEN {orth} {whens} END"


def raw_calendar_sql(days_cte: str = "days") -> str:
    return f"""
rawcal AS (
  SELECT date,
         'd_' || CAST(date_diff('day', {START}, date) + 1 AS VARCHAR) AS d,
         CAST(date_trunc('week', date) AS DATE) AS wm_yr_wk,
         isodow(date) - 1 AS weekday, month(date) AS month, year(date) AS year,
         {_event_case('name')} AS event_name_1,
         {_event_case('type')} AS event_type_1,
         CASE WHEN date IN ({_dq(EASTER_DATES)}) THEN 'Easter' END AS event_name_2,
         CASE WHEN date IN ({_dq(EASTER_DATES)}) THEN 'Cultural' END AS event_type_2,
         CAST(day(date) <= 10 AS INTEGER) AS snap_a,
         CAST(day(date) % 2 = 1 AND day(date) <= 15 AS INTEGER) AS snap_b,
         CAST(day(date) BETWEEN 5 AND 14 AS INTEGER) AS snap_c
  FROM {days_cte}
)"""


def _before(g: str) -> str:
    return (f"CASE WHEN {g} IS NOT NULL THEN count(*) OVER (PARTITION BY year, {g}) "
            f"- row_number() OVER (PARTITION BY year, {g} ORDER BY date) END")


def _after(g: str) -> str:
    return f"CASE WHEN {g} IS NOT NULL THEN row_number() OVER (PARTITION BY year, {g} ORDER BY date) - 1 END"


ENRICH = f"""
cal1 AS (
  SELECT *,
    CASE WHEN event_name_2 IN ({_q(EVENT2_OVERRIDES)}) THEN event_name_2 ELSE event_name_1 END AS event_name,
    CASE WHEN event_name_2 IN ({_q(EVENT2_OVERRIDES)}) THEN event_type_2 ELSE event_type_1 END AS event_type
  FROM rawcal
),
cal2 AS (
  SELECT *,
    CAST(event_name IS NOT NULL AS INTEGER) AS event,
    first_value(event_name IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_event,
    COALESCE(last_value(event_name IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'Unknown') AS prev_event,
    CASE WHEN event_name_2 IN ({_q(HOLIDAYS)}) THEN event_name_2
         WHEN event_name_1 IN ({_q(HOLIDAYS)}) THEN event_name END AS holiday_name
  FROM cal1
),
cal3 AS (
  SELECT *,
    CAST(holiday_name IS NOT NULL AS INTEGER) AS holiday,
    first_value(holiday_name IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_holiday,
    COALESCE(last_value(holiday_name IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'Unknown') AS prev_holiday
  FROM cal2
),
calendar AS (
  SELECT *,
    {_before('next_event')} AS days_before_event,
    {_after('prev_event')} AS days_after_event,
    {_before('next_holiday')} AS days_before_holiday,
    {_after('prev_holiday')} AS days_after_holiday
  FROM cal3
)"""

# calendar over the panel window
CALENDAR = raw_calendar_sql("days") + "," + ENRICH

PRICES = f"""
wkp AS (
  SELECT store_id, item_id, CAST(date_trunc('week', date) AS DATE) AS wm_yr_wk,
         CAST(SUM(price_sum) AS DOUBLE) / NULLIF(CAST(SUM(qty) AS DOUBLE), 0) AS price
  FROM keyed GROUP BY ALL
),
weeks AS (
  SELECT CAST(unnest(generate_series(CAST(date_trunc('week', a) AS DATE), CAST(date_trunc('week', b) AS DATE), INTERVAL 7 DAY)) AS DATE) AS wm_yr_wk
  FROM (SELECT {START} AS a, {END} AS b)
),
pgrid AS (
  SELECT g.store_id, g.item_id, w.wm_yr_wk,
         last_value(p.price IGNORE NULLS) OVER (PARTITION BY g.store_id, g.item_id ORDER BY w.wm_yr_wk
                                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sell_price
  FROM (SELECT DISTINCT store_id, item_id FROM series) g CROSS JOIN weeks w
  LEFT JOIN wkp p ON p.store_id = g.store_id AND p.item_id = g.item_id AND p.wm_yr_wk = w.wm_yr_wk
),
prices AS (
  SELECT store_id, item_id, wm_yr_wk, sell_price,
         sell_price / avg(sell_price) OVER (PARTITION BY store_id, item_id ORDER BY wm_yr_wk
                                            ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS price_ratio_to_8week_rolling
  FROM pgrid WHERE sell_price IS NOT NULL
)"""


BASE_PANEL = PANEL + "," + CALENDAR + "," + PRICES + f""",
bp AS (
  SELECT pn.*, c.wm_yr_wk, c.event_name, c.event_type, c.event, c.next_event, c.prev_event,
         c.days_before_event, c.days_after_event, c.holiday_name, c.holiday, c.next_holiday,
         c.prev_holiday, c.days_before_holiday, c.days_after_holiday,
         pr.sell_price, pr.price_ratio_to_8week_rolling,
         CASE WHEN pn.demand > 0 THEN 1 WHEN pn.demand IS NOT NULL THEN 0 END AS anydemand,
         CAST(pr.sell_price IS NULL AS INTEGER) AS sell_price_isna,
         COALESCE(pn.demand * pr.sell_price, 0.0) AS sales,
         CASE {' '.join(f"WHEN pn.state_id = '{st}' THEN c.{flag}" for st, flag in SNAP_FLAG_BY_STATE.items())} END AS snap,
         regexp_replace(pn.id, '_[^_]*$', '') AS id_copy
  FROM panel pn
  LEFT JOIN calendar c ON c.date = pn.date
  LEFT JOIN prices pr ON pr.store_id = pn.store_id AND pr.item_id = pn.item_id AND pr.wm_yr_wk = c.wm_yr_wk
)"""

# weights (A10) on top of bp, as CTE "wp"
WEIGHTED_PANEL = BASE_PANEL + """,
wp0 AS (
  SELECT *,
    min(CASE WHEN anydemand = 1 THEN date END) OVER (PARTITION BY id) AS min_date,
    sum(CASE WHEN myfold = 'test' THEN sales END) OVER (PARTITION BY id) AS weight_sales,
    lag(demand, 1) OVER (PARTITION BY id ORDER BY date) AS lagdemand
  FROM bp
),
wp AS (
  SELECT *,
    1.0 / NULLIF(sqrt(avg(CASE WHEN fold = 'train' AND date >= min_date
                               THEN pow(demand - lagdemand, 2) END) OVER (PARTITION BY id)), 0) AS weight_rmse
  FROM wp0
)"""

# null rules (P10) + weekday on top of bp, as CTE "fp": the feature input
FEATURE_PANEL = BASE_PANEL + """,
fp AS (
  SELECT id, item_id, dept_id, cat_id, store_id, state_id, date, fold, myfold, snap,
         isodow(date) - 1 AS dayofweek,
         CASE WHEN NOT (sell_price_isna = 1 OR COALESCE(holiday_name = 'Christmas', FALSE))
              THEN demand END AS demand
  FROM bp
)"""


def level_union(src: str, select_aggs: str, extra_keys: list[str] | None = None) -> str:
    """12-level aggregate as a UNION ALL of GROUP BYs (independent of grouping sets)."""
    from almanac.operators.hierarchy import DIMS, LEVELS
    extra = extra_keys or []
    parts = []
    for lvl, used in LEVELS.items():
        dims = ", ".join(d if d in used else f"CAST(NULL AS VARCHAR) AS {d}" for d in DIMS)
        keys = [*used, *extra]
        gb = f" GROUP BY {', '.join(keys)}" if keys else ""
        ex = "".join(f", {e}" for e in extra)
        parts.append(f"SELECT {lvl} AS level, {dims}{ex}, {select_aggs} FROM {src}{gb}")
    return "\nUNION ALL\n".join(parts)


def ns_join(a: str, b: str) -> str:
    from almanac.operators.hierarchy import DIMS
    return " AND ".join([f"{a}.level = {b}.level"] +
                        [f"{a}.{d} IS NOT DISTINCT FROM {b}.{d}" for d in DIMS])
