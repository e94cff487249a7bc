"""Keyed deadlines in a stream: announce each one once, when the clock passes it.

A newer record of a key replaces its deadlines; deadlines which vanish are withdrawn.  Keys are dealt by hash into groups;
state is one record and one timer for each group, so that a batch asks the state store for groups and not for every key.
Needs ``spark.sql.streaming.stateStore.providerClass`` set to the RocksDB provider.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark import schema as S
from tidemark.functions import dates

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DUE = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("at", T.LongType())]))
OUTPUT = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("label", T.StringType()), T.StructField("at", T.LongType())])
HELD = T.ArrayType(T.StructType([
    T.StructField("key", T.StringType()), T.StructField("version", T.LongType()), T.StructField("due", DUE)]))
STATE = T.StructType([T.StructField("timer", T.LongType()), T.StructField("held", HELD)])
#: Groups of keys.  A batch reads and writes the groups it meets: more groups suit small batches over many keys.
GROUPS = 1 << 14


class _Announcer(StatefulProcessor):
    """Holds the newest version of each key of a group and the deadlines it has not announced yet; the group's timer is its earliest one."""

    def __init__(self, time_mode: str) -> None:
        self.event_time = time_mode.lower() == "eventtime"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", STATE)

    def _keep(self, timer, held) -> None:
        earliest = min((at for _, _, due in held for _, at in due), default=None)
        if earliest != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if earliest is not None:
                self.handle.registerTimer(earliest)
        self.open.update((earliest, held))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        newest = {}
        for row in rows:
            kept = newest.get(row["key"])
            if kept is None or row["version"] > kept["version"]:
                newest[row["key"]] = row
        timer, before = self.open.get() or (None, ())
        held = {name: (name, version, [tuple(item) for item in due]) for name, version, due in before}
        changed = False
        for name, row in newest.items():
            if name not in held or row["version"] > held[name][1]:
                held[name] = (name, row["version"], [(item["label"], item["at"]) for item in row["due"] or ()])
                changed = True
        if changed:
            self._keep(timer, list(held.values()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        timer, before = self.open.get()
        # Spark removes the timer which fires.
        self._keep(None if timer == expiredTimerInfo.getExpiryTimeInMs() else timer, [
            (name, version, [(label, at) for label, at in due if at > now]) for name, version, due in before])
        for name, _, due in before:
            for label, at in due:
                if at <= now:
                    yield Row(key=name, label=label, at=at)

    def close(self) -> None:
        pass


def announce(records: DataFrame, key: Column, version: Column, due: Column, time_mode: str = "EventTime", groups: int = GROUPS) -> DataFrame:
    """(key, label, at) once for each deadline.  ``due`` is an array of (label, at) in epoch milliseconds; event-time
    mode needs a watermark on ``records``.  The number of ``groups`` belongs to a stream's state: keep it over restarts."""
    slim = records.select(key.cast("string").alias("key"), version.cast("bigint").alias("version"), due.cast(DUE).alias("due"),
                          *[F.col(name) for name in ("ts",) if name in records.columns])
    return slim.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups))).groupBy("group").transformWithState(
        statefulProcessor=_Announcer(time_mode), outputStructType=OUTPUT, outputMode="Append", timeMode=time_mode)


def _labelled(label: str, at: Column) -> Column:
    return F.struct(F.lit(label).alias("label"), at.cast("bigint").alias("at"))


def expiries(board: DataFrame, version: Column, time_mode: str = "EventTime") -> DataFrame:
    """One ``ended`` event for each open row when its deadline arrives; rows without a deadline are never timed out."""
    timed = (F.col("verificationStatus") == S.OPEN) & F.col("deadlineEpochMs").isNotNull()
    due = F.when(timed, F.array(_labelled("ended", F.col("deadlineEpochMs")))).otherwise(F.array().cast(DUE))
    return announce(board, F.col("projectId"), version, due, time_mode)


def freshness_changes(headers: DataFrame, warn_age_ms: int, max_age_ms: int, time_mode: str = "EventTime") -> DataFrame:
    """``warn`` and ``fail`` events when the older clock of a snapshot passes the two ages; exactly the age still passes."""
    scan, approval = dates.iso_to_ms(F.col("scanAt")), dates.iso_to_ms(F.col("approvedAt"))
    oldest = F.least(scan, approval)
    due = F.array(_labelled("warn", oldest + warn_age_ms + 1), _labelled("fail", oldest + max_age_ms + 1))
    return announce(headers, F.col("snapshotId"), approval, due, time_mode)
