"""Deadline calendar: month choice, 42-day grid, rows of a day."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.functions import dates
from tidemark.operators.board import group_rank, row_group

DAY_PREVIEW = 3


def pick_month(rows: DataFrame, as_of_ms: int, zone: str = dates.BOARD_ZONE) -> DataFrame:
    """One row (first_day): month of the earliest live deadline, else of the earliest other one, else of now."""
    as_of = F.lit(as_of_ms).cast("bigint")
    live = row_group(F.col("verificationStatus"), F.col("deadlineEpochMs"), as_of) == S.TIMED_GROUP
    target = F.coalesce(
        F.min(F.when(live, F.col("deadlineEpochMs"))), F.min(F.when(~live, F.col("deadlineEpochMs"))), as_of
    )
    return rows.agg(F.trunc(dates.wall_clock(target, zone).cast("date"), "month").alias("first_day"))


def shifted(months: DataFrame, by: int) -> DataFrame:
    """The month before (-1) or after (+1)."""
    return months.select(F.add_months("first_day", by).alias("first_day"))


def month_grid(months: DataFrame, as_of_ms: int, zone: str = dates.BOARD_ZONE) -> DataFrame:
    """42 days from the Monday on or before the first of the month."""
    start = F.date_sub("first_day", F.weekday("first_day"))
    today = dates.date_key(F.lit(as_of_ms).cast("bigint"), zone)
    cells = months.select("first_day", F.posexplode(F.sequence(start, F.date_add(start, 41))).alias("cell", "day"))
    return cells.select(
        F.col("cell").cast("bigint").alias("cell"),
        F.date_format("day", "yyyy-MM-dd").alias("date_key"),
        (F.month("day") == F.month("first_day")).alias("in_month"),
        (F.date_format("day", "yyyy-MM-dd") == today).alias("is_today"),
    )


def grid_rows(rows: DataFrame, first_day: dt.date, zone: str = dates.BOARD_ZONE) -> DataFrame:
    """Rows of the 42 shown days; the literal range reaches the scan."""
    start = first_day - dt.timedelta(days=first_day.weekday())
    margin = S.MS_PER_DAY
    low = int(dt.datetime.combine(start, dt.time(), dt.timezone.utc).timestamp() * 1000)
    ms = F.col("deadlineEpochMs")
    shown = rows.where((ms >= low - margin) & (ms < low + 42 * S.MS_PER_DAY + margin))
    last = start + dt.timedelta(days=41)
    return shown.withColumn("date_key", dates.date_key(ms, zone)).where(
        F.col("date_key").between(start.isoformat(), last.isoformat())
    )


def _first_day(rows: DataFrame, as_of_ms: int, zone: str) -> dt.date:
    return pick_month(rows, as_of_ms, zone).first()["first_day"]


def month(rows: DataFrame, as_of_ms: int, zone: str = dates.BOARD_ZONE, first_day: dt.date | None = None) -> DataFrame:
    """The grid with the number of rows of each day and how many the preview leaves out."""
    first_day = first_day or _first_day(rows, as_of_ms, zone)
    counts = grid_rows(rows, first_day, zone).groupBy("date_key").agg(F.count("*").alias("n"))
    months = rows.sparkSession.range(1).select(F.lit(first_day).alias("first_day"))
    return month_grid(months, as_of_ms, zone).join(counts, "date_key", "left").select(
        "cell", "date_key", "in_month", "is_today",
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        F.greatest(F.coalesce("n", F.lit(0)) - DAY_PREVIEW, F.lit(0)).cast("bigint").alias("overflow"),
    )


def preview(rows: DataFrame, as_of_ms: int, zone: str = dates.BOARD_ZONE, first_day: dt.date | None = None) -> DataFrame:
    """The first three rows of each shown day by deadline, then board order.

    The rank filter becomes a group limit before the shuffle, so a crowded day moves three rows of each task.
    """
    first_day = first_day or _first_day(rows, as_of_ms, zone)
    day = Window.partitionBy("date_key").orderBy("deadlineEpochMs", group_rank(F.col("rowGroup")), "projectId")
    return (
        grid_rows(rows, first_day, zone)
        .select("date_key", "projectId", "deadlineEpochMs", "rowGroup", "urgency")
        .withColumn("rank", F.row_number().over(day))
        .where(F.col("rank") <= DAY_PREVIEW)
        .withColumn("rank", F.col("rank").cast("bigint"))
    )
