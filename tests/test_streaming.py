import json
import time

from pyspark.sql import functions as F

from tests.helpers import opportunities, opportunity, rows_of, scouting
from tidemark import schema as S
from tidemark.sources.store import SnapshotStore
from tidemark.streaming import clock, imports, timers

ROW = "ts timestamp, projectId string, verificationStatus string, deadlineEpochMs bigint, version bigint"


def drop(folder, name, rows):
    (folder / name).write_text("\n".join(json.dumps(row) for row in rows), encoding="utf-8")


def at(second):
    return f"2026-07-01T00:00:{second:02d}Z"


def ms(second):
    return 1782864000000 + second * 1000


def test_each_deadline_is_announced_once(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", timers.ROCKSDB)
    source = tmp_path / "in"
    source.mkdir()
    row = lambda ts, key, status, due, version: dict(ts=at(ts), projectId=key, verificationStatus=status, deadlineEpochMs=due, version=version)
    drop(source, "1.json", [row(1, "moved", S.OPEN, ms(10), 1), row(1, "kept", S.OPEN, ms(10), 1), row(1, "gone", S.OPEN, ms(12), 1),
                            row(1, "unknown", S.UNKNOWN_DEADLINE, ms(5), 1), row(1, "late", S.OPEN, ms(50), 1)])
    time.sleep(1.1)
    drop(source, "2.json", [row(6, "moved", S.OPEN, ms(20), 2), row(6, "gone", S.UNKNOWN_DEADLINE, None, 2), row(6, "kept", S.OPEN, ms(30), 0)])
    time.sleep(1.1)
    drop(source, "3.json", [row(25, "other", S.OPEN, ms(40), 1)])
    stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).json(str(source)).withWatermark("ts", "0 seconds")
    query = (timers.expiries(stream, F.col("version")).writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    query.awaitTermination()
    assert rows_of(spark.read.parquet(str(tmp_path / "out"))) == [("kept", "ended", ms(10)), ("moved", "ended", ms(20))]


def test_state_is_asked_for_groups_of_keys(spark, tmp_path):
    """2000 keys in 8 groups are at most 8 records and 8 timers (a row in each of two indexes); deadlines fire up to and at the watermark."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", timers.ROCKSDB)
    source = tmp_path / "in"
    source.mkdir()
    drop(source, "1.json", [dict(ts=at(1), key=f"k{i}", due=[["a", ms(2 + i % 40)], ["b", ms(2 + i % 40)]]) for i in range(2000)])
    time.sleep(1.1)
    drop(source, "2.json", [dict(ts=at(21), key=f"k{i}", due=[["c", ms(50)]]) for i in range(0, 2000, 7)])
    stream = spark.readStream.schema("ts timestamp, key string, due array<array<string>>").option("maxFilesPerTrigger", 1).json(str(source))
    due = F.transform("due", lambda pair: F.struct(pair[0].alias("label"), pair[1].cast("bigint").alias("at")))
    announced = timers.announce(stream.withWatermark("ts", "0 seconds"), F.col("key"), F.unix_millis("ts"), due, groups=8)
    query = (announced.writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    query.awaitTermination()
    assert rows_of(spark.read.parquet(str(tmp_path / "out"))) == sorted(
        [(f"k{i}", label, ms(2 + i % 40)) for i in range(2000) if i % 7 and 2 + i % 40 <= 21 for label in "ab"], key=repr)
    assert max(step["stateOperators"][0]["numRowsTotal"] for step in query.recentProgress) <= 8 * 3


def test_ticks_rederive_the_board(spark, tmp_path):
    source = tmp_path / "ticks"
    source.mkdir()
    board = opportunities(spark, [opportunity(projectId="p", deadlineEpochMs=ms(10))])
    seen = []

    def keep(derived, moment):
        seen.append((moment, derived.first()["rowGroup"]))

    for i, second in enumerate((9, 10)):
        drop(source, f"{i}.json", [dict(timestamp=at(second))])
        time.sleep(1.1)
    ticks = spark.readStream.schema("timestamp timestamp").option("maxFilesPerTrigger", 1).json(str(source))
    clock.ticking_board(ticks, board, keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert seen == [(ms(9), S.TIMED_GROUP), (ms(10), S.EXPIRED_GROUP)]


def test_arriving_batches(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()

    def close(batch):
        batch["mainRows"][0]["meals"] = "提供午餐"
        batch["mainRows"][0]["accommodation"] = "提供住宿"
        batch["scanAt"] = "2026-07-16T11:30:00+08:00"

    for name, document in (("1.json", scouting()), ("2.json", scouting()), ("3.json", scouting(close))):
        (source / name).write_text(json.dumps(document, ensure_ascii=False), encoding="utf-8")
        time.sleep(1.1)
    store, seen = SnapshotStore(spark, str(tmp_path / "store")), []
    imports.import_stream(
        imports.arriving_batches(spark, str(source)), store,
        lambda file, status, frame: seen.append((file.rsplit("/", 1)[1], status, None if frame is None else frame.count())),
    ).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert [item[:2] for item in seen] == [("1.json", "published"), ("2.json", "no-change"), ("3.json", "published")]
    assert seen[2][2] == 1 and store.head()["seq"] == 2
    last = store.manifest().where("seq = 2").first()
    assert last["previousSnapshotId"] == store.manifest().where("seq = 1").first()["snapshotId"]
