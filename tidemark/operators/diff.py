"""Snapshot comparison: added, changed, expired and removed rows, and what a reviewer has to look at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.functions import urls
from tidemark.functions.canonical import publication_fingerprint

ADDED, CHANGED, EXPIRED, REMOVED = "added", "changed", "expired", "removed"
CHANGE_TYPES = (ADDED, CHANGED, EXPIRED, REMOVED)
REVIEW_HOURS = 72


def _sides(previous: DataFrame, following: DataFrame, value: Column, order: str | None) -> DataFrame:
    """Both snapshots side by side for each projectId, from one combining aggregate instead of a join.

    An id which is stored twice counts with its last row; ``order`` names the position column.
    """
    def side(frame: DataFrame, name: str) -> DataFrame:
        position = F.col(order) if order else F.lit(0)
        return frame.select("projectId", F.lit(name).alias("side"), position.cast("bigint").alias("_pos"), value.alias("value"))

    latest = lambda name: F.max_by("value", F.when(F.col("side") == name, F.col("_pos"))).alias(name)
    return side(previous, "old").unionAll(side(following, "new")).groupBy("projectId").agg(latest("old"), latest("new"))


def diff(previous: DataFrame, following: DataFrame, order: str | None = None) -> DataFrame:
    """(projectId, changeType).  Classes exclude each other; newly expired goes before changed."""
    value = F.struct(F.col("verificationStatus").alias("status"), publication_fingerprint(S.OPPORTUNITY).alias("print"))
    both = _sides(previous, following, value, order)
    change = (
        F.when(F.col("new").isNull(), REMOVED)
        .when(F.col("old").isNull(), ADDED)
        .when((F.col("old.status") != S.EXPIRED) & (F.col("new.status") == S.EXPIRED), EXPIRED)
        .when(F.col("old.print") != F.col("new.print"), CHANGED)
    )
    return both.select("projectId", change.alias("changeType")).where(F.col("changeType").isNotNull())


def diff_counts(changes: DataFrame) -> DataFrame:
    return changes.agg(*[F.count_if(F.col("changeType") == name).alias(name) for name in CHANGE_TYPES])


def ids_only_in(left: DataFrame, right: DataFrame) -> DataFrame:
    """Ids of the left snapshot which the right one lacks."""
    return left.select("projectId").distinct().join(right.select("projectId"), "projectId", "left_anti")


def identity_sets_equal(left: DataFrame, right: DataFrame) -> DataFrame:
    """Migration check, one row: ids with multiplicity on both sides."""
    sides = left.select("projectId", F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(
        right.select("projectId", F.lit(0), F.lit(1)))
    per_id = sides.groupBy("projectId").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    surplus = lambda a, b: F.coalesce(F.sum(F.greatest(F.col(a) - F.col(b), F.lit(0))), F.lit(0))
    return per_id.agg(surplus("l", "r").alias("only_left"), surplus("r", "l").alias("only_right")).withColumn(
        "equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def review_queue(previous: DataFrame, following: DataFrame, as_of_ms: int, pending: DataFrame | None = None,
                 order: str | None = None) -> DataFrame:
    """(projectId, reason, deadlineEpochMs): one row for each reason to look at a project before approval.

    Urgent additions and changes (deadline within 72 hours), all removals, all promotions from pending, conflicting
    facts, other event arrangements, and addresses on which an id was replaced.
    """
    value = F.struct(
        F.col("verificationStatus").alias("status"), publication_fingerprint(S.OPPORTUNITY).alias("print"),
        F.col("deadlineEpochMs").alias("ms"), F.col("deadline").alias("deadline"), F.col("website").alias("website"),
        F.col("recommendation").alias("recommendation"), F.col("logistics").alias("logistics"),
        F.col("eventArrangement").alias("arrangement"))
    both = _sides(previous, following, value, order)
    if pending is None:
        both = both.withColumn("wasPending", F.lit(False))
    else:
        marks = pending.select("projectId").distinct().withColumn("wasPending", F.lit(True))
        both = both.join(marks, "projectId", "left").withColumn("wasPending", F.coalesce("wasPending", F.lit(False)))
    stays = F.col("old").isNotNull() & F.col("new").isNotNull()
    newly_expired = stays & (F.col("old.status") != S.EXPIRED) & (F.col("new.status") == S.EXPIRED)
    added, removed = F.col("old").isNull(), F.col("new").isNull()
    changed = stays & ~newly_expired & (F.col("old.print") != F.col("new.print"))
    ahead = F.col("new.ms") - F.lit(as_of_ms)
    differs = lambda name: ~F.col(f"old.{name}").eqNullSafe(F.col(f"new.{name}"))
    conflict = stays & (differs("deadline") | differs("website") | differs("recommendation") | differs("logistics"))
    reasons = F.array_compact(F.array(
        F.when((added | changed) & (ahead > 0) & (ahead < REVIEW_HOURS * S.MS_PER_HOUR), "urgent-deadline"),
        F.when(removed, "removed"),
        F.when(F.col("new").isNotNull() & F.col("wasPending"), "promoted-from-pending"),
        F.when(conflict, "field-conflict"),
        F.when(stays & differs("arrangement"), "arrangement-change"),
    ))
    deadline = F.coalesce("new.ms", "old.ms").alias("deadlineEpochMs")
    direct = both.select("projectId", F.explode(reasons).alias("reason"), deadline)

    # An address with both a removed and an added id; counted per address, then joined back to the moved ids only.
    moved = both.where(added | removed).select(
        "projectId", deadline, added.alias("isAdded"), urls.normalise_url(F.coalesce("new.website", "old.website")).alias("urlNorm"))
    shared = moved.groupBy("urlNorm").agg(F.bool_or("isAdded").alias("a"), F.bool_or(~F.col("isAdded")).alias("r")).where("a and r")
    renamed = moved.join(shared.select("urlNorm"), "urlNorm", "left_semi").select(
        "projectId", F.lit("shared-url-rename").alias("reason"), "deadlineEpochMs")
    return direct.unionAll(renamed)
