import json
import time

from pyspark.sql import functions as F

from tests.helpers import rows_of
from tidemark import schema as S
from tidemark.functions.dates import iso_to_ms
from tidemark.streaming import timers


def test_severity_changes_follow_the_clock(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", timers.ROCKSDB)
    source = tmp_path / "in"
    source.mkdir()
    old = dict(snapshotId="old", scanAt="2026-07-01T00:00:00Z", approvedAt="2026-07-01T01:00:00Z", ts="2026-07-01T01:00:00Z")
    new = dict(snapshotId="new", scanAt="2026-07-03T12:00:00Z", approvedAt="2026-07-03T13:00:00Z", ts="2026-07-03T13:00:00Z")
    last = dict(snapshotId="last", scanAt="2026-07-04T00:00:00Z", approvedAt="2026-07-04T12:00:01Z", ts="2026-07-04T12:00:01Z")
    for name, row in (("1.json", old), ("2.json", new), ("3.json", last)):
        (source / name).write_text(json.dumps(row), encoding="utf-8")
        time.sleep(1.1)
    stream = spark.readStream.schema("ts timestamp, snapshotId string, scanAt string, approvedAt string").option(
        "maxFilesPerTrigger", 1).json(str(source)).withWatermark("ts", "0 seconds")
    (timers.freshness_changes(stream, S.MS_PER_DAY, 3 * S.MS_PER_DAY).writeStream.format("parquet").option("path", str(tmp_path / "out"))
     .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination())
    start = spark.range(1).select(iso_to_ms(F.lit("2026-07-01T00:00:00Z"))).first()[0]
    assert rows_of(spark.read.parquet(str(tmp_path / "out"))) == [
        ("new", "warn", start + int(3.5 * S.MS_PER_DAY) + 1), ("old", "fail", start + 3 * S.MS_PER_DAY + 1), ("old", "warn", start + S.MS_PER_DAY + 1)]
