"""Calendar enrichment: event overrides, forward/backward fills, day distances.

The calendar has one row per day, so its size is bounded by the date span, not
by the data volume; the un-partitioned fill windows below therefore run on a
table of a few thousand rows at most (the reference's calendar has 1,969).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.sources.fixtures import EVENT2_OVERRIDES, HOLIDAYS


def forward_fill(col: str, order: str = "date", partition: list[str] | None = None) -> Column:
    """Last non-null value at or before the current row."""
    w = Window.orderBy(order) if not partition else Window.partitionBy(*partition).orderBy(order)
    return F.last(col, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def backward_fill(col: str, order: str = "date", partition: list[str] | None = None) -> Column:
    """First non-null value at or after the current row."""
    w = Window.orderBy(order) if not partition else Window.partitionBy(*partition).orderBy(order)
    return F.first(col, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))


def days_before(group_col: str, by_year: bool = True, order: str = "date") -> Column:
    """Days until the end of the run of rows sharing the coming event.

    The group is (year, next_event) when ``by_year`` (the reference's choice:
    late-December days and a 1 January event share a group); null when the
    coming event is unknown (pandas drops null group keys).
    """
    keys = ["year", group_col] if by_year else [group_col]
    w = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(w)
    rn = F.row_number().over(w.orderBy(order))
    return F.when(F.col(group_col).isNotNull(), n - rn)


def days_after(group_col: str, by_year: bool = True, order: str = "date") -> Column:
    """Days since the start of the run of rows sharing the previous event."""
    keys = ["year", group_col] if by_year else [group_col]
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return F.when(F.col(group_col).isNotNull(), rn - 1)


def enrich_calendar(cal: DataFrame, by_year: bool = True) -> DataFrame:
    """P3/P5/P8 + W1 + W2 over a raw calendar (see ``raw_calendar``).

    Adds event_name, event_type, event, next_event, prev_event,
    days_before_event, days_after_event, holiday_name, holiday, next_holiday,
    prev_holiday, days_before_holiday, days_after_holiday.
    """
    override = F.col("event_name_2").isin(EVENT2_OVERRIDES)
    df = cal.withColumns({
        "event_name": F.when(override, F.col("event_name_2")).otherwise(F.col("event_name_1")),
        "event_type": F.when(override, F.col("event_type_2")).otherwise(F.col("event_type_1")),
    })
    # the holiday test uses the already overridden event_name (reference quirk)
    hol = F.when(F.col("event_name_1").isin(HOLIDAYS), F.col("event_name"))
    hol = F.when(F.col("event_name_2").isin(HOLIDAYS), F.col("event_name_2")).otherwise(hol)
    df = df.withColumns({
        "event": F.col("event_name").isNotNull().cast("int"),
        "next_event": backward_fill("event_name"),
        "prev_event": F.coalesce(forward_fill("event_name"), F.lit("Unknown")),
        "holiday_name": hol,
    })
    df = df.withColumns({
        "holiday": F.col("holiday_name").isNotNull().cast("int"),
        "next_holiday": backward_fill("holiday_name"),
        "prev_holiday": F.coalesce(forward_fill("holiday_name"), F.lit("Unknown")),
    })
    return df.withColumns({
        "days_before_event": days_before("next_event", by_year),
        "days_after_event": days_after("prev_event", by_year),
        "days_before_holiday": days_before("next_holiday", by_year),
        "days_after_holiday": days_after("prev_holiday", by_year),
    })
