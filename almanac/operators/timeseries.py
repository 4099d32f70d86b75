"""Date-aligned time-series features over a long panel.

Design
------
All features of one table are window columns over ``partitionBy(id)`` (plus
weekday / snap for the same-weekday families), ordered by an integer day
number.  Catalyst puts every column sharing a partition/order spec into one
``Window`` node, so the whole feature block costs one shuffle by series id and
one sort, instead of the reference's chain of joins of feature blocks.

Range frames (``rangeBetween``) on the day number give calendar semantics
("the last 7 days"), which equals pandas' ``rolling('7D', closed='right')`` and
stays correct when days are missing.  Lags use ``F.lag`` only when the caller
guarantees a gap-free grid (the dense panel); otherwise a one-day range frame.

A series holds at most one row per calendar day, so the largest window
partition is bounded by the calendar span whatever the data volume.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAYNO = "_dayno"


def with_day_number(df: DataFrame, date_col: str = "date") -> DataFrame:
    """Integer day number used by range frames."""
    return df.withColumn(DAYNO, F.unix_date(F.col(date_col).cast("date")))


def _w(partition: Sequence[str], order: str = DAYNO):
    return Window.partitionBy(*partition).orderBy(order)


def lag_days(col: str, k: int, partition: Sequence[str] = ("id",), gap_free: bool = True) -> Column:
    """Value ``k`` days earlier (calendar shift, not row shift).

    ``gap_free`` uses ``lag`` (one row per day guaranteed); otherwise a
    single-day range frame, which is null when that day is missing.
    """
    if k == 0:
        return F.col(col)
    if gap_free:
        return F.lag(col, k).over(_w(partition))
    return F.max(col).over(_w(partition).rangeBetween(-k, -k))


def add_lags(df: DataFrame, cols: Iterable[str] = ("demand", "snap"), ks: Iterable[int] = range(7),
             partition: Sequence[str] = ("id",), gap_free: bool = True) -> DataFrame:
    """``{col}_lag{k}`` for every column and shift."""
    cols, ks = list(cols), list(ks)
    return df.withColumns({f"{c}_lag{k}": lag_days(c, k, partition, gap_free) for c in cols for k in ks})


AGGS = {"mean": F.avg, "max": F.max, "min": F.min}


def rolling_days(col: str, days: int, agg: str = "mean", partition: Sequence[str] = ("id",),
                 following: int = 0) -> Column:
    """Aggregate over the calendar range ``(t - days, t]`` (right-closed).

    ``following`` > 0 shifts the frame end forward (W13).  Spark evaluates a
    moving frame by re-aggregating the whole frame for every row, i.e.
    O(rows x frame); on gap-free grids ``add_trailing`` does the same in
    O(rows x log frame).
    """
    return AGGS[agg](col).over(_w(partition).rangeBetween(-(days - 1), following))


def add_trailing(df: DataFrame, specs: Sequence[tuple[str, str, int, str]],
                 partition: Sequence[str], order: str = DAYNO) -> DataFrame:
    """Trailing aggregates over the last ``n`` rows (current row included) of a
    gap-free ordered partition: ``specs`` = [(out, col, n, agg)], agg in
    mean/max/min, nulls ignored, null when the frame has no value.

    All use a doubling table: level k holds the sum, count or extreme of the
    last 2**k rows, built from level k-1 and its lag by 2**(k-1).

    * mean: the frame is cut into blocks of powers of two that follow each
      other; only values of the frame are added, nothing is taken off, so no
      digits cancel and a NaN reaches only the frames that hold it;
    * max/min: two overlapping blocks.

    Every step is a window over the same partition and order, so the chain
    adds Window operators but no shuffle and no re-sort.
    """
    w = Window.partitionBy(*partition).orderBy(order)
    out: dict[str, Column] = {}
    tmp: list[str] = []
    means = [s for s in specs if s[3] == "mean"]
    for c in sorted({s[1] for s in means}):
        df = df.withColumns({f"_S0_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)), f"_C0_{c}": F.col(c).isNotNull().cast("int")})
        tmp += [f"_S0_{c}", f"_C0_{c}"]
        for lvl in range(1, max(s[2] for s in means if s[1] == c).bit_length()):
            df = df.withColumns({f"_{x}{lvl}_{c}": F.col(f"_{x}{lvl - 1}_{c}") + F.coalesce(F.lag(f"_{x}{lvl - 1}_{c}", 2 ** (lvl - 1)).over(w), F.lit(0))
                                 for x in "SC"})
            tmp += [f"_S{lvl}_{c}", f"_C{lvl}_{c}"]
    for name, c, n, _ in means:
        total = {"S": F.lit(0.0), "C": F.lit(0)}
        back = 0
        for lvl in reversed(range(n.bit_length())):
            if n >> lvl & 1:
                for x in "SC":
                    block = F.col(f"_{x}{lvl}_{c}")
                    total[x] = total[x] + (F.coalesce(F.lag(block, back).over(w), F.lit(0)) if back else block)
                back += 2 ** lvl
        out[name] = total["S"] / F.nullif(total["C"], F.lit(0))
    for agg, comb in (("max", F.greatest), ("min", F.least)):
        sel = [s for s in specs if s[3] == agg]
        for c in sorted({s[1] for s in sel}):
            top = max(int(math.floor(math.log2(s[2]))) for s in sel if s[1] == c)
            prev = c
            for lvl in range(1, top + 1):
                name = f"_{agg}{lvl}_{c}"
                df = df.withColumn(name, comb(F.col(prev), F.lag(prev, 2 ** (lvl - 1)).over(w)))
                tmp.append(name)
                prev = name
            for oname, cc, n, _ in [s for s in sel if s[1] == c]:
                lvl = int(math.floor(math.log2(n)))
                base = c if lvl == 0 else f"_{agg}{lvl}_{c}"
                rest = n - 2 ** lvl
                out[oname] = F.col(base) if rest == 0 else comb(F.col(base), F.lag(base, rest).over(w))
    return df.withColumns(out).drop(*tmp)


def add_rolling_weeks(df: DataFrame, spec: dict[str, dict[int, Sequence[str]]] | None = None,
                      partition: Sequence[str] = ("id",), gap_free: bool = True) -> DataFrame:
    """``{col}_{agg}{w}week`` over calendar weeks.

    Default spec is the reference's: demand mean/max/min over 1, 2, 4, 12 and
    48 weeks; snap mean over 1 and 2 weeks.  On a gap-free daily grid the
    ``7w``-day range is the last ``7w`` rows (``add_trailing``); otherwise a
    range frame on the day number.
    """
    spec = spec or {
        "demand": {w: ("mean", "max", "min") for w in (1, 2, 4, 12, 48)},
        "snap": {1: ("mean",), 2: ("mean",)},
    }
    items = [(f"{c}_{a}{w}week", c, 7 * w, a) for c, by_w in spec.items() for w, aggs in by_w.items() for a in aggs]
    if gap_free:
        return add_trailing(df, items, partition)
    return df.withColumns({o: rolling_days(c, n, a, partition) for o, c, n, a in items})


def add_sameweekday(df: DataFrame, col: str = "demand", weeks: Iterable[int] = (2, 4, 12, 48),
                    aggs: Sequence[str] = ("mean", "max", "min"), id_col: str = "id",
                    dow_col: str = "dayofweek", gap_free: bool = True) -> DataFrame:
    """Same-weekday rolling aggregates, ``{col}_{agg}{w}week_sameweekday``.

    Inside (id, weekday) the rows are 7 days apart, so a ``7w``-day range frame
    holds the last ``w`` same-weekday rows.
    """
    part = (id_col, dow_col)
    items = [(f"{col}_{a}{w}week_sameweekday", col, w, a) for w in weeks for a in aggs]
    if gap_free:
        return add_trailing(df, items, part)
    return df.withColumns({o: rolling_days(c, 7 * n, a, part) for o, c, n, a in items})


def add_samesnap(df: DataFrame, col: str = "demand", weeks: Iterable[int] = (2, 4, 12, 48),
                 id_col: str = "id", dow_col: str = "dayofweek", snap_col: str = "snap") -> DataFrame:
    """Mean of the last ``w`` rows of the same weekday and same snap flag,
    spread to ``..._samesnap0`` / ``..._samesnap1`` (null on rows of the other
    flag).  Row frame with min_periods=1 semantics (avg over available rows).

    Strict variant: only the series' own rows count (SURVEY 7.5).
    """
    weeks = list(weeks)
    items = [(f"_ss{w}", col, w, "mean") for w in weeks]
    df = add_trailing(df, items, (id_col, dow_col, snap_col))
    cols = {}
    for w in weeks:
        for s in (0, 1):
            cols[f"{col}_mean{w}week_sameweekday_samesnap{s}"] = F.when(F.col(snap_col) == s, F.col(f"_ss{w}"))
    return df.withColumns(cols).drop(*[f"_ss{w}" for w in weeks])


def week_rounded(h: int) -> int:
    """Horizon rounded up to whole weeks, ``((h-1)//7+1)*7``."""
    return ((h - 1) // 7 + 1) * 7


def shift_forward(df: DataFrame, h: int, cols: Sequence[str], partition: Sequence[str] = ("id",),
                  gap_free: bool = True) -> DataFrame:
    """J6 without a join: replace each feature by its value ``h`` days earlier.

    On the dense panel this is ``lag(c, h)`` in the same window partitioning as
    the features themselves, so it adds no shuffle.
    """
    return df.withColumns({c: lag_days(c, h, partition, gap_free) for c in cols})


def series_table(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (), id_col: str = "id", order: str = DAYNO) -> DataFrame:
    """One row per series: ``keep`` (the same on all its rows) and ``days``, its rows in
    order as an array of structs.  A series has one row per day of a gap-free grid, so the array
    is bounded by the calendar; a shift by k days is the element k places before."""
    return df.groupBy(id_col).agg(*[F.first(c).alias(c) for c in keep], F.array_sort(F.collect_list(F.struct(order, *cols))).alias("days"))


def shifted_rows(series: DataFrame, own: Sequence[str], shifts: dict[str, int | Callable[[Column], Column]], keep: Sequence[str] = (),
                 id_col: str = "id", where: Callable[[Column, Column], Column] | None = None, beside: Sequence[str] = ()) -> DataFrame:
    """J6/J7 over ``series_table``: rows of ``own`` columns as they are, and each column of ``shifts`` from
    that many days earlier (null before the first day).

    A shift may depend on the row's day (a struct).  Rows come from their series' array: no join,
    window, sort or shuffle, so one table serves any number of horizons.  ``where`` picks days, by
    struct and position, before they are expanded; ``beside`` names arrays of the series with one value per day.
    """
    days = F.col("days")
    at = F.sequence(F.lit(0), F.size(days) - 1)
    if where is not None:
        at = F.filter(at, lambda i: where(F.get(days, i), i))

    def row(i: Column) -> Column:
        d = F.get(days, i)
        back = {c: k(d) if callable(k) else F.lit(k) for c, k in shifts.items()}
        return F.struct(*[d[c].alias(c) for c in own], *[F.get(F.col(c), i).alias(c) for c in beside], *[F.get(days, i - k)[c].alias(c) for c, k in back.items()])

    return series.select(id_col, *keep, F.inline(F.transform(at, row)))


def horizon_join(base: DataFrame, features: DataFrame, h: int, keys: Sequence[str] = ("id",),
                 date_col: str = "date") -> DataFrame:
    """J6/J7 for feature tables from outside: move the feature table forward by
    ``h`` days and left-join on (keys, date).  Both sides are keyed on the same
    columns, so the join is a co-partitioned equi-join.
    """
    moved = features.withColumn(date_col, F.date_add(F.col(date_col), h))
    return base.join(moved, [*keys, date_col], "left")


def pick_by_flag(df: DataFrame, stem: str, flag_col: str = "snap") -> DataFrame:
    """Choose ``{stem}0``/``{stem}1`` by the row's flag, drop both."""
    return (df.withColumn(stem, F.when(F.col(flag_col) == 0, F.col(f"{stem}0"))
                          .otherwise(F.col(f"{stem}1")))
            .drop(f"{stem}0", f"{stem}1"))


def autocorrelations(df: DataFrame, value: str, order: str, lags: int, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, rho) with the autocorrelations of lags 1 .. ``lags`` as an array.  One row per
    step of a series, so the ordering window is bounded by the calendar."""
    by = list(by)
    w = Window.partitionBy(*by).orderBy(order)
    d = df.withColumn("_z", F.col(value) - F.avg(value).over(Window.partitionBy(*by)))
    d = d.select(*by, "_z", *[F.lag("_z", k).over(w).alias(f"_z{k}") for k in range(1, lags + 1)])
    c0 = F.nullif(F.sum(F.col("_z") * F.col("_z")), F.lit(0.0))
    return d.groupBy(*by).agg(F.count("_z").alias("n"), F.array(*[F.sum(F.col("_z") * F.col(f"_z{k}")) / c0 for k in range(1, lags + 1)]).alias("rho"))


def pacf(rho: str | Column, lags: int) -> Column:
    """Partial autocorrelations from autocorrelations, as arrays, by the Durbin-Levinson
    recursion: the coefficients of order k - 1 and their reverse give the next one, and those of order k."""
    rho = F.col(rho) if isinstance(rho, str) else rho
    first = F.slice(rho, 1, 1)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def step(state: Column, k: Column) -> Column:
        phi, before = state["phi"], F.slice(rho, 1, k - 1)
        num = F.get(rho, k - 1) - total(F.zip_with(phi, F.reverse(before), lambda p, r: p * r))
        den = F.lit(1.0) - total(F.zip_with(phi, before, lambda p, r: p * r))
        return F.struct(phi.alias("phi"), state["out"].alias("out"), (num / F.nullif(den, F.lit(0.0))).alias("a"))

    def grow(state: Column) -> Column:
        a = state["a"]
        moved = F.zip_with(state["phi"], F.reverse(state["phi"]), lambda p, q: p - a * q)
        return F.struct(F.concat(moved, F.array(a)).alias("phi"), F.concat(state["out"], F.array(a)).alias("out"), a.alias("a"))

    start = F.struct(first.alias("phi"), first.alias("out"), F.get(rho, 0).alias("a"))
    return F.aggregate(F.sequence(F.lit(2), F.lit(lags)), start, lambda s, k: grow(step(s, k)), lambda s: s["out"]) if lags > 1 else first


def regular_grid(df: DataFrame, key: str, ts_col: str, value_col: str, step: str = "hour",
                 agg: str = "sum", span: str = "global") -> DataFrame:
    """W14 (first half): aggregate onto a regular grid per key, missing steps null.

    ``span='global'`` gives every key the common first..last step (the
    pandas pivot-then-resample behaviour); ``'key'`` uses each key's own span.
    The grid is generated per key with ``explode(sequence(...))`` - the global
    bounds enter as scalar subqueries, so there is no cross join - and
    left-joined with the aggregates on (key, slot).  The slot aggregation is
    algebraic, so a key holding most rows is pre-aggregated per task.
    """
    slot = trunc_ntz(F.col(ts_col), step)
    fn = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min, "count": F.count}[agg]
    vals = df.groupBy(key, slot.alias("slot")).agg(fn(value_col).alias(value_col))
    interval = F.expr({"hour": "INTERVAL 1 HOUR", "minute": "INTERVAL 1 MINUTE",
                       "day": "INTERVAL 1 DAY"}[step])
    if span == "global":
        lo, hi = vals.select(F.min("slot")).scalar(), vals.select(F.max("slot")).scalar()
        grid = vals.select(key).distinct().select(key, F.explode(F.sequence(lo, hi, interval)).alias("slot"))
    else:
        b = vals.groupBy(key).agg(F.min("slot").alias("_a"), F.max("slot").alias("_b"))
        grid = b.select(key, F.explode(F.sequence("_a", "_b", interval)).alias("slot"))
    return grid.join(vals, [key, "slot"], "left")


def trunc_ntz(ts: Column, step: str) -> Column:
    """Truncate a local (NTZ) timestamp to the hour/minute, or to its date,
    with calendar fields only - independent of the session time zone."""
    if step == "day":
        return ts.cast("date")
    minute = F.minute(ts) if step == "minute" else F.lit(0)
    return F.make_timestamp_ntz(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), minute, F.lit(0))


def step_number(ts: Column, step: str) -> Column:
    """Integer step index (days/hours/minutes since epoch) for range frames,
    from calendar fields (no time-zone conversion of local timestamps)."""
    day = F.unix_date(ts.cast("date")).cast("long")
    if step == "day":
        return day
    hours = day * 24 + F.hour(ts)
    return hours if step == "hour" else hours * 60 + F.minute(ts)
