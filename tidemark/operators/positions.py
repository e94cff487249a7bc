"""Positions in a total order, and state carried along an order, without putting a group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialise

CHUNK_ROWS = 65_536


def with_position(df: DataFrame, order: Sequence[Column], column: str = "pos") -> DataFrame:
    """Add the 1-based position in a total order.

    One range-partitioned sort, written once to the shared checkpoint folder; then only the row count of each sorted
    partition is needed to turn partition-local numbers into global ones.  ``order`` must end in a unique key.
    """
    numbered = materialise(df.orderBy(*order).withColumn("_local", F.monotonically_increasing_id()))
    partition = F.shiftright(F.col("_local"), 33)
    counts = numbered.groupBy(partition.alias("_part")).agg(F.count("*").alias("_rows"))
    # One row for each partition of the sorted frame: bounded by the number of tasks, not by the data.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    within = F.col("_local").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        numbered.withColumn("_part", partition)
        .join(F.broadcast(offsets), "_part")
        .withColumn(column, (F.col("_offset") + within + 1).cast("bigint"))
        .drop("_part", "_local", "_offset")
    )


def with_group_position(df: DataFrame, group: Sequence[str], order: Sequence[Column], column: str = "pos") -> DataFrame:
    """As ``with_position`` but counted from 1 in each group; a huge group stays spread over many tasks."""
    ranked = with_position(df, [F.col(name) for name in group] + list(order), "_global")
    starts = ranked.groupBy(*group).agg(F.min("_global").alias("_start"))
    return (
        ranked.join(starts, list(group))
        .withColumn(column, (F.col("_global") - F.col("_start") + 1).cast("bigint"))
        .drop("_global", "_start")
    )


def carried(df: DataFrame, group: Sequence[str], pos: str, states: dict[str, tuple[str, Column]],
            chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add columns which look back over all earlier rows of the group in stored order.

    ``states`` maps a new column to ``("any", flag)``, true when an earlier row had the flag, or to
    ``("last", value)``, the newest earlier non-NULL value.  Rows are looked at in chunks of ``chunk_rows`` positions;
    between chunks only one summary row of each chunk is ordered, so a group may have any size.
    """
    keys = [*group, "_chunk"]
    rows = df.withColumn("_chunk", F.floor(F.col(pos) / chunk_rows).cast("bigint"))
    for name, (_, value) in states.items():
        rows = rows.withColumn(f"_in_{name}", value)
    back = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    chunk_back = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)

    summary, local, between, merged = [], {}, [], {}
    for name, (kind, _) in states.items():
        value = F.col(f"_in_{name}")
        if kind == "any":
            summary.append(F.coalesce(F.bool_or(value), F.lit(False)).alias(f"_sum_{name}"))
            local[f"_own_{name}"] = F.coalesce(F.bool_or(value).over(back), F.lit(False))
            between.append(F.coalesce(F.bool_or(F.col(f"_sum_{name}")).over(chunk_back), F.lit(False)).alias(f"_old_{name}"))
            merged[name] = F.col(f"_own_{name}") | F.coalesce(F.col(f"_old_{name}"), F.lit(False))
        else:
            summary.append(F.max_by(value, F.when(value.isNotNull(), F.col(pos))).alias(f"_sum_{name}"))
            local[f"_own_{name}"] = F.last(value, ignorenulls=True).over(back)
            between.append(F.last(F.col(f"_sum_{name}"), ignorenulls=True).over(chunk_back).alias(f"_old_{name}"))
            merged[name] = F.coalesce(F.col(f"_own_{name}"), F.col(f"_old_{name}"))
    summaries = rows.groupBy(*keys).agg(*summary).select(*keys, *between)
    joined = rows.withColumns(local).join(summaries, keys, "left").withColumns(merged)
    helpers = [f"_{part}_{name}" for part in ("in", "own", "old") for name in states]
    return joined.drop("_chunk", *helpers)


def repeated(df: DataFrame, key: Sequence[str], pos: str) -> DataFrame:
    """Second and later rows of each key in stored order; keys are aggregated before any row is moved for them."""
    firsts = df.groupBy(*key).agg(F.min(pos).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    return df.join(firsts, list(key)).where(F.col(pos) > F.col("_first")).drop("_first", "_n")


def first_wins(df: DataFrame, key: Sequence[str], pos: str) -> DataFrame:
    """One row for each key, the earliest in input order, by a combining aggregate."""
    values = [name for name in df.columns if name not in key]
    packed = df.groupBy(*key).agg(F.min_by(F.struct(*values), F.col(pos)).alias("_row"))
    return packed.select(*key, *[F.col(f"_row.{name}").alias(name) for name in values])
