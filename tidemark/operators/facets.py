"""Counts of the board.  Every facet value appears, also with zero."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.functions import text
from tidemark.operators.board import status_label


def _with_zeros(counts: DataFrame, values: Sequence[str], column: str) -> DataFrame:
    """All enum values with their counts; the enum is one literal array, exploded."""
    enum = counts.sparkSession.range(1).select(
        F.posexplode(text.literal_array(values)).alias("ord", column)
    )
    return enum.join(counts, column, "left").select(
        F.col("ord").cast("bigint").alias("ord"), column, F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def facet(rows: DataFrame, value: Column, values: Sequence[str], column: str) -> DataFrame:
    counts = rows.groupBy(value.alias(column)).agg(F.count("*").alias("n"))
    return _with_zeros(counts, values, column)


def status_facet(rows: DataFrame) -> DataFrame:
    return facet(rows, status_label(F.col("rowGroup")), S.STATUS_TAGS, "status")


def mode_facet(rows: DataFrame) -> DataFrame:
    return facet(rows, F.col("eventArrangement.mode"), S.EVENT_MODES, "mode")


def tag_facet(rows: DataFrame, tags: Sequence[str] = S.TIER_TAGS) -> DataFrame:
    return facet(rows.select(F.explode("tags").alias("tag")), F.col("tag"), tags, "tag")


def province_facet(rows: DataFrame, provinces: Sequence[str] = S.PROVINCES) -> DataFrame:
    return facet(rows, F.col("resolvedProvince"), provinces, "province")


def all_facets(rows: DataFrame, provinces: Sequence[str] = S.PROVINCES,
               tags: Sequence[str] = S.TIER_TAGS) -> DataFrame:
    """The whole facet panel from one scan: each row gives its (facet, value) pairs, one combining aggregate."""
    def pair(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("facet"), value.alias("value"))

    pairs = F.concat(
        F.array(
            pair("status", status_label(F.col("rowGroup"))),
            pair("mode", F.col("eventArrangement.mode")),
            pair("province", F.col("resolvedProvince")),
        ),
        F.transform("tags", lambda tag: pair("tag", tag)),
    )
    counts = (
        rows.select(F.explode(pairs).alias("p"))
        .groupBy("p.facet", "p.value").agg(F.count("*").alias("n"))
    )
    enums = [("status", S.STATUS_TAGS), ("mode", S.EVENT_MODES), ("province", provinces), ("tag", tags)]
    enum_pairs = F.array(*[pair(name, F.lit(value)) for name, values in enums for value in values])
    enum = rows.sparkSession.range(1).select(F.explode(enum_pairs).alias("p")).select("p.facet", "p.value")
    return enum.join(counts, ["facet", "value"], "left").select(
        "facet", "value", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def upcoming(rows: DataFrame) -> DataFrame:
    """Deadlines ahead within a week, a month, at all; cumulative, strict bounds, status is not looked at."""
    ahead = F.col("remainingMs") > 0
    return rows.agg(
        F.count_if(ahead & (F.col("remainingMs") < 7 * S.MS_PER_DAY)).alias("week"),
        F.count_if(ahead & (F.col("remainingMs") < 30 * S.MS_PER_DAY)).alias("month"),
        F.count_if(ahead).alias("all"),
    )


def feed_counts(rows: DataFrame, feeds: DataFrame) -> DataFrame:
    counts = rows.groupBy("feedId").agg(F.count("*").alias("n"))
    return feeds.join(counts, feeds["id"] == counts["feedId"], "left").select(
        feeds["id"].alias("feedId"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def snapshot_counts(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Actual counts by verification status, for one snapshot or for many."""
    status = F.col("verificationStatus")
    return rows.groupBy(*by).agg(
        F.count_if(status == S.OPEN).alias("confirmedOpen"),
        F.count_if(status == S.UNKNOWN_DEADLINE).alias("confirmedUnknownDeadline"),
        F.count_if(status == S.EXPIRED).alias("expired"),
    )


def group_sizes(rows: DataFrame) -> DataFrame:
    """Sizes of the list groups and whether more than one is non-empty."""
    sizes = facet(rows, F.col("rowGroup"), S.ROW_GROUPS, "row_group")
    three_rows = Window.partitionBy(F.lit(0))
    return sizes.select("row_group", "n", (F.count_if(F.col("n") > 0).over(three_rows) > 1).alias("has_multiple"))


def visible_counts(rows: DataFrame, passes: Column) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), F.count_if(passes).alias("visible"))


def has_tags(rows: DataFrame, tags: Sequence[str] = S.TIER_TAGS, by: Sequence[str] = ()) -> DataFrame:
    """Whether any row, or any row of each group of ``by``, has one of the tags."""
    return rows.groupBy(*by).agg(
        F.coalesce(F.bool_or(F.arrays_overlap("tags", text.literal_array(tags))), F.lit(False)).alias("has_tags")
    )


def newest_active_cycle(rows: DataFrame) -> DataFrame:
    """The newest cycle among active rows and the feed it makes the default."""
    cycle = text.key_cycle(F.col("projectId")).cast("int")
    newest = F.max(F.when(F.col("verificationStatus") != S.EXPIRED, cycle))
    return rows.agg(newest.cast("bigint").alias("cycle")).withColumn(
        "default_feed", F.concat(F.lit(S.FEED_ID_PREFIX), F.col("cycle").cast("string"))
    )


def cycle_feeds(rows: DataFrame, event_year: Column) -> DataFrame:
    """One feed for each cycle among the rows."""
    return rows.select(text.key_cycle(F.col("projectId")).alias("admissionCycle")).distinct().select(
        F.concat(F.lit(S.FEED_ID_PREFIX), F.col("admissionCycle")).alias("id"),
        F.concat(F.lit(S.FEED_LABEL_PREFIX), F.col("admissionCycle")).alias("label"),
        "admissionCycle",
        event_year.cast("bigint").alias("eventYear"),
    )
