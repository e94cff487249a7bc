"""The board as of a moment: derived columns, labels, filters, order."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.functions import dates, text
from tidemark.operators.positions import with_position


def row_group(status: Column, deadline_ms: Column, as_of: Column) -> Column:
    """``active-timed``, ``active-unknown`` or ``expired``; an open row expires exactly at its deadline."""
    elapsed = (status == S.OPEN) & F.coalesce(deadline_ms <= as_of, F.lit(False))
    return (
        F.when((status == S.EXPIRED) | elapsed, S.EXPIRED_GROUP)
        .when((status == S.UNKNOWN_DEADLINE) | deadline_ms.isNull(), S.UNKNOWN_GROUP)
        .otherwise(S.TIMED_GROUP)
    )


def derive(rows: DataFrame, as_of_ms: int | Column) -> DataFrame:
    """Add ``remainingMs``, ``rowGroup`` and ``urgency`` as of a moment."""
    as_of = as_of_ms if isinstance(as_of_ms, Column) else F.lit(as_of_ms).cast("bigint")
    group = row_group(F.col("verificationStatus"), F.col("deadlineEpochMs"), as_of)
    remaining = F.col("deadlineEpochMs") - as_of
    urgency = (
        F.when(F.col("rowGroup") == S.EXPIRED_GROUP, "expired")
        .when(F.col("rowGroup") == S.UNKNOWN_GROUP, "unknown")
        .otherwise(dates.urgency(F.col("remainingMs")))
    )
    return rows.withColumns({"remainingMs": remaining, "rowGroup": group}).withColumn("urgency", urgency)


def status_label(group: Column) -> Column:
    return F.when(group == S.EXPIRED_GROUP, S.LABEL_ENDED).otherwise(S.LABEL_OPEN)


def expired_text(group: Column) -> Column:
    return F.when(group == S.EXPIRED_GROUP, S.LABEL_ENDED)


def mode_label(mode: Column) -> Column:
    return text.label_of(S.MODE_LABELS, mode)


def fact_label(status: Column) -> Column:
    return text.label_of(S.FACT_LABELS, status)


def source_label(sources: Column) -> Column:
    official = F.exists(sources, lambda source: source["kind"] == "official")
    return F.when(official, S.OFFICIAL_SOURCE_LABEL).otherwise(S.HISTORICAL_SOURCE_LABEL)


def first_official(sources: Column) -> Column:
    """The first official source link, or NULL."""
    return F.try_element_at(F.filter(sources, lambda source: source["kind"] == "official"), F.lit(1))


def detail(rows: DataFrame, zone: str = dates.BOARD_ZONE) -> DataFrame:
    """The detail projection: own description only, first official link, labels, stated deadline precision."""
    described = text.trim_u(F.col("description"))
    return rows.select(
        "projectId",
        F.when((described != "") & (described != text.trim_u(F.col("project"))), described)
        .otherwise(S.NO_DESCRIPTION).alias("description"),
        first_official(F.col("discoverySources"))["url"].alias("officialUrl"),
        source_label(F.col("discoverySources")).alias("sourceLabel"),
        mode_label(F.col("eventArrangement.mode")).alias("modeLabel"),
        fact_label(F.col("logistics.status")).alias("logisticsLabel"),
        dates.official_deadline(F.col("deadlineOriginal"), F.col("deadlineEpochMs"), zone).alias("deadlineText"),
    )


# --------------------------------------------------------------------------- filters
@dataclass(frozen=True)
class BoardFilter:
    """An empty dimension does not restrict; OR inside a dimension, AND across dimensions."""

    query: str = ""
    tags: Sequence[str] = field(default_factory=tuple)
    status: Sequence[str] = field(default_factory=tuple)
    modes: Sequence[str] = field(default_factory=tuple)
    provinces: Sequence[str] = field(default_factory=tuple)


def search_text() -> Column:
    """The searched identity fields joined by a blank; a match may span fields."""
    return F.lower(F.concat_ws(" ", "name", "institute", "project", "eventType"))


def has_any_tag(tags: Sequence[str]) -> Column:
    return F.arrays_overlap(F.col("tags"), text.literal_array(tags))


def matches_query(query: str) -> Column:
    return F.contains(search_text(), F.lower(text.trim_u(F.lit(query))))


def predicate(chosen: BoardFilter, province: str = "resolvedProvince") -> Column:
    """The conjunction of the dimensions in use, cheapest first."""
    tests: list[Column] = []
    if chosen.status:
        tests.append(status_label(F.col("rowGroup")).isin(*chosen.status))
    if chosen.modes:
        tests.append(F.col("eventArrangement.mode").isin(*chosen.modes))
    if chosen.provinces:
        tests.append(F.coalesce(F.col(province).isin(*chosen.provinces), F.lit(False)))
    if chosen.tags:
        tests.append(F.coalesce(has_any_tag(chosen.tags), F.lit(False)))
    if chosen.query.strip():
        tests.append(matches_query(chosen.query))
    return reduce(lambda left, right: left & right, tests, F.lit(True))


def resolve_province(rows: DataFrame, provinces: DataFrame) -> DataFrame:
    """Add ``resolvedProvince``: the row's own province, else the one of its exact school name, else NULL.

    ``provinces`` has one row for each ``name``.  The optimizer broadcasts it when its size allows.
    """
    lookup = provinces.select(F.col("name").alias("_school"), F.col("province").alias("_province"))
    return (
        rows.join(lookup, F.col("name") == F.col("_school"), "left")
        .withColumn("resolvedProvince", F.coalesce(text.non_blank(F.col("province")), F.col("_province")))
        .drop("_school", "_province")
    )


def apply_filter(rows: DataFrame, chosen: BoardFilter, provinces: DataFrame | None = None) -> DataFrame:
    """Rows which pass; the province join is only done when that dimension is in use."""
    if chosen.provinces and "resolvedProvince" not in rows.columns:
        if provinces is None:
            raise ValueError("a province filter needs the province dimension")
        rows = resolve_province(rows, provinces)
    return rows.where(predicate(chosen))


def of_feed(rows: DataFrame, feed_id: str) -> DataFrame:
    """Rows of one feed, a partition filter on stored boards; an unknown feed gives no rows."""
    return rows.where(F.col("feedId") == feed_id)


def point_lookup(rows: DataFrame, project_id: str) -> DataFrame:
    return rows.where(F.col("projectId") == project_id)


# --------------------------------------------------------------------------- order
def group_rank(group: Column) -> Column:
    return F.when(group == S.TIMED_GROUP, 0).when(group == S.UNKNOWN_GROUP, 1).otherwise(2)


def board_order() -> list[Column]:
    """Timed rows by deadline, unknown ones, then expired ones newest first; the key breaks ties."""
    group, ms = F.col("rowGroup"), F.col("deadlineEpochMs")
    return [
        group_rank(group).asc(),
        F.when(group == S.TIMED_GROUP, ms).asc(),
        F.when(group == S.EXPIRED_GROUP, ms).desc_nulls_last(),
        F.col("projectId").asc(),
    ]


def publication_order() -> list[Column]:
    """Open rows by deadline, unknown ones, expired ones; the key breaks ties."""
    status = F.col("verificationStatus")
    rank = F.when(status == S.OPEN, 0).when(status == S.UNKNOWN_DEADLINE, 1).otherwise(2)
    open_ms = F.when(status == S.OPEN, F.coalesce(F.col("deadlineEpochMs"), F.lit(0)))
    return [rank.asc(), open_ms.asc(), F.col("projectId").asc()]


def ranked(rows: DataFrame) -> DataFrame:
    """The whole board in board order with its position as a column."""
    return with_position(rows, board_order())


def next_k(rows: DataFrame, k: int) -> DataFrame:
    """The first k rows of the board (a top-k, not a full sort)."""
    return rows.orderBy(*board_order()).limit(k)
