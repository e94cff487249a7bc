from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F
import pytest

from tidemark.functions import dates

CN = timezone(timedelta(hours=8))


def at(day, hour, minute):
    return int(datetime(2026, 7, day, hour, minute, tzinfo=CN).timestamp() * 1000)


def test_official_deadline_keeps_stated_precision(spark):
    cases = [
        ("2026年6月3日8:15-2026年7月28日15:00；纸质件另寄", at(28, 15, 0), "2026年7月28日 15:00"),
        ("2026年7月2日—7月18日；官方未公布具体时刻", at(18, 23, 59), "2026年7月18日（官网未公布具体时刻）"),
        ("登记至2026年7月18日24:00；照片至7月20日24:00", at(19, 0, 0), "2026年7月18日 24:00"),
        ("", None, "未公布"),
    ]
    frame = spark.createDataFrame(cases, "t string, ms bigint, want string")
    for row in frame.select("want", dates.official_deadline(F.col("t"), F.col("ms")).alias("got")).collect():
        assert row["got"] == row["want"]


def test_stated_clock_time(spark):
    cases = [
        ("2026年7月28日15:00止", at(28, 15, 0), True), ("2026年7月28日15：00止", at(28, 15, 0), True),
        ("2026年7月28日18点30分收件", at(28, 18, 30), True), ("2026年7月28日18时30分收件", at(28, 18, 30), True),
        ("2026年7月28日下午5点截止", at(28, 17, 0), True), ("2026年7月28日20时截止", at(28, 20, 0), True),
        ("2026年7月28日中午12点截止", at(28, 12, 0), True), ("2026年7月28日24:00截止", at(29, 0, 0), True),
        ("10:00 开放，7月28日15:00止", at(28, 15, 0), True), ("10:00 开放，7月28日截止", at(28, 23, 59), False),
        ("2026年7月28日截止", at(28, 23, 59), False), ("2026年7月28日23:59截止；官方未公布具体时刻", at(28, 23, 59), False),
        ("2026年7月28日下午5点截止", at(28, 5, 0), False), ("2026年7月28日晚上8点截止", at(28, 8, 0), False),
        ("2026年7月28日24:01截止", at(29, 0, 1), False), ("2026年7月28日15:00止", None, False),
    ]
    frame = spark.createDataFrame(cases, "t string, ms bigint, want boolean")
    for row in frame.withColumn("got", dates.states_clock_time(F.col("t"), F.col("ms"))).collect():
        assert row["got"] == row["want"], row


def test_strict_iso(spark):
    cases = [
        ("2026-07-20T23:59:00+08:00", 1784563140000), ("2026-07-20T15:59:00.5Z", 1784563140500), ("2026-07-20", None),
        ("2026-02-30T00:00:00Z", None), ("2024-02-29T00:00:00Z", 1709164800000), ("2026-07-20T24:00:00Z", None),
        ("2026-07-20T23:59:00+24:00", None), ("2026-07-20T23:59:00", None), ("2026-07-20 23:59:00Z", None),
        ("2026-07-20T23:59:60Z", None), ("1970-01-01T00:00:00-23:59", 86340000), (None, None), ("", None), ("x", None),
    ]
    frame = spark.createDataFrame(cases, "t string, want bigint")
    for row in frame.withColumn("got", dates.iso_to_ms(F.col("t"))).collect():
        assert row["got"] == row["want"], row


def test_deadline_normalisation(spark):
    note = "官方未公布具体时刻"
    cases = [
        ("2026-07-20", "见官网", "2026-07-20T23:59:00+08:00", f"见官网；{note}", True),
        ("2026-07-20", f"x{note}", "2026-07-20T23:59:00+08:00", f"x{note}", True),
        ("2026-07-20T00:30:00Z", "见官网", "2026-07-20T08:30:00+08:00", "见官网", True),
        ("2026-07-20 17:30", None, "2026-07-20T17:30:00+08:00", "未公布", True),
        (" 2026-07-20T17:30:05.123-05:30 ", " a ", "2026-07-21T07:00:05+08:00", "a", True),
        (None, " ", None, "未公布", True), ("", "a", None, "a", True), ("soon", "a", None, "a", False),
        ("2026-02-30", "a", None, f"a；{note}", False), ("2026-07-20T25:00", "a", None, "a", False),
    ]
    frame = spark.createDataFrame(cases, "d string, o string, want string, original string, valid boolean")
    for row in dates.with_deadline(frame, "d", "o").collect():
        assert (row["due"], row["dueOriginal"], row["dueValid"]) == (row["want"], row["original"], row["valid"]), row


def test_countdown_and_progress(spark):
    day = 86_400_000
    cases = [
        (None, "N/A", "—", "unknown"), (-1, "已结束", "已结束", "expired"), (0, "00:00:00", "0s", "critical"),
        (42_000, "00:00:42", "42s", "critical"), (61_000, "00:01:01", "1m 1s", "critical"),
        (12 * 3_600_000 + 30 * 60_000, "12:30:00", "12h 30m", "critical"), (day, "1天 00:00:00", "1d 0h", "soon"),
        (3 * day + 15_669_000, "3天 04:21:09", "3d 4h", "soon"), (7 * day, "7天 00:00:00", "7d 0h", "near"),
        (30 * day, "30天 00:00:00", "30d 0h", "far"),
    ]
    frame = spark.createDataFrame(cases, "ms bigint, long string, short string, urgency string")
    ms = F.col("ms")
    for row in frame.select("*", dates.countdown_text(ms).alias("a"), dates.remaining_short(ms).alias("b"), dates.urgency(ms).alias("c")).collect():
        assert (row["a"], row["b"], row["c"]) == (row["long"], row["short"], row["urgency"])
    got = [row[0] for row in spark.createDataFrame([(None,), (-5,), (0,), (45 * day,), (200 * day,)], "ms bigint").select(dates.progress(F.col("ms"))).collect()]
    assert got == [0.0, 1.0, 1.0, 0.5, 0.0]


def test_results_do_not_depend_on_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    frame = spark.createDataFrame([(1784563140000, "2026-07-20T23:59:00+08:00")], "ms bigint, t string")
    try:
        got = set()
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got.add(tuple(frame.select(
                dates.date_time(F.col("ms")), dates.iso_to_ms(F.col("t")), dates.date_key(F.col("ms")), dates.start_of_day_ms(F.col("ms")),
                dates.snapshot_id(F.col("ms"), F.lit("a" * 64)), dates.publication_timestamp(F.col("ms"))).first()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == {("2026-07-20 23:59", 1784563140000, "2026-07-20", 1784476800000, "2026-07-20T15:59:00.000Z-" + "a" * 12, "2026-07-20T23:59:00+08:00")}


def test_max_age():
    assert dates.parse_max_age_ms("24") == 86_400_000
    assert dates.parse_max_age_ms("0.5") == 1_800_000
    for bad in ("0", "-1", "1e3", "", "abc", "01"):
        with pytest.raises(ValueError):
            dates.parse_max_age_ms(bad)
