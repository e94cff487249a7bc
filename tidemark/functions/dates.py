"""Date expressions on epoch milliseconds.

All of them are independent of the session time zone: an instant is turned into a zoned wall clock
(``timestamp_ntz``) by an explicit zone argument.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import non_blank, trim_u
from tidemark.schema import MS_PER_DAY, MS_PER_HOUR, MS_PER_MINUTE, MS_PER_SECOND

BOARD_ZONE = "Asia/Shanghai"
PUBLICATION_OFFSET = "+08:00"

# Patterns and texts of the deadline contract.
ISO_TIMESTAMP = (
    r"^\d{4}-\d{2}-\d{2}T([01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d{1,3})?(?:Z|[+-]([01]\d|2[0-3]):[0-5]\d)$"
)
INPUT_DATE = r"^\d{4}-\d{2}-\d{2}$"
INPUT_TIMESTAMP = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,3})?)?(?:Z|[+-]\d{2}:\d{2})?$"
COLON_TIME = r"(?:^|[^\d])([01]?\d|2[0-3]|24)\s*[:：]\s*([0-5]\d)(?!\d)"
CHINESE_TIME = (
    r"(?:^|[^\d])(?:(凌晨|早上|上午|中午|下午|晚上|晚间)\s*)?([01]?\d|2[0-3]|24)\s*[点时]"
    r"(?:\s*([0-5]?\d)\s*分)?(?!\d)"
)
MIDNIGHT_24 = r"(?:^|[^\d])24\s*[:：]\s*00(?!\d)"
AFTERNOON_PERIODS = ("下午", "晚上", "晚间", "中午")
MORNING_PERIODS = ("凌晨", "早上", "上午")
NO_CLOCK_TIME_NOTE = "官方未公布具体时刻"
NOT_PUBLISHED = "未公布"
MAX_AGE_PATTERN = r"^(?:0|[1-9]\d*)(?:\.\d+)?$"

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def wall_clock(ms: Column, zone: str = BOARD_ZONE) -> Column:
    """The zoned wall clock of an instant, as ``timestamp_ntz``."""
    utc = F.timestamp_add("MILLISECOND", ms, F.expr(_EPOCH))
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def _chars(wall: Column, start: int, length: int) -> Column:
    """Characters of ``yyyy-MM-dd HH:mm:ss``; a cast keeps the wall clock, formatting would pass through the session zone."""
    return F.substring(wall.cast("string"), start, length)


def _day(wall: Column) -> Column:
    return _chars(wall, 1, 10)


def ntz_to_ms(wall: Column) -> Column:
    """Epoch milliseconds of a wall clock read as UTC."""
    return F.timestamp_diff("MILLISECOND", F.expr(_EPOCH), wall)


def _day_ms(day_text: Column) -> Column:
    return F.unix_date(day_text.try_cast("date")).cast("bigint") * MS_PER_DAY


def iso_to_ms(text: Column) -> Column:
    """Epoch milliseconds of a strict ISO timestamp with offset; NULL for any other text.

    The pattern checks shape and ranges, the cast checks the calendar; offsets up to 23:59 are taken off by hand since a
    Spark zone offset ends at 18:00.
    """
    wall = F.unix_millis(F.concat(F.substring(text, 1, 19), F.lit("Z")).try_cast("timestamp"))
    fraction = F.rpad(F.regexp_extract(text, r"\.(\d{1,3})", 1), 3, "0").cast("bigint")
    minutes = F.substring(text, -5, 2).cast("bigint") * 60 + F.substring(text, -2, 2).cast("bigint")
    offset = (
        F.when(F.endswith(text, F.lit("Z")), F.lit(0).cast("bigint"))
        .when(F.substring(text, -6, 1) == "-", -minutes * MS_PER_MINUTE)
        .otherwise(minutes * MS_PER_MINUTE)
    )
    return F.when(text.rlike(ISO_TIMESTAMP), wall + fraction - offset)


def is_iso_timestamp(text: Column) -> Column:
    return iso_to_ms(text).isNotNull()


def publication_timestamp(ms: Column) -> Column:
    """The instant in +08:00 to the second."""
    wall = F.timestamp_add("MILLISECOND", ms + 8 * MS_PER_HOUR, F.expr(_EPOCH))
    return F.concat(F.translate(_chars(wall, 1, 19), " ", "T"), F.lit(PUBLICATION_OFFSET))


def with_deadline(rows: DataFrame, deadline: str, original: str) -> DataFrame:
    """Add ``due`` (text in +08:00), ``dueOriginal``, ``dueMs`` and ``dueValid``.

    A blank deadline stays empty; a bare date means the end of that day and notes once that no clock time is
    published; a clock time without offset is +08:00; every other offset is rendered in +08:00 to the second.
    """
    value, stated = trim_u(F.col(deadline)), F.coalesce(non_blank(F.col(original)), F.lit(NOT_PUBLISHED))
    rows = rows.withColumns({"_value": value, "dueOriginal": stated})
    value, empty = F.col("_value"), F.coalesce(F.col(deadline) == "", F.lit(True))
    seconds = F.when(F.substring(value, 17, 1) == ":", F.substring(value, 17, 3)).otherwise(":00")
    zone = F.regexp_extract(F.concat(value, F.lit(PUBLICATION_OFFSET)), r"(Z|[+-]\d{2}:\d{2})\+08:00$|(\+08:00)$", 0)
    spelled = (
        F.when(empty, F.lit(None).cast("string"))
        .when(value.rlike(INPUT_DATE), F.concat(value, F.lit("T23:59:00+08:00")))
        .when(value.rlike(INPUT_TIMESTAMP), F.concat(
            F.translate(F.substring(value, 1, 16), " ", "T"), seconds, F.regexp_replace(zone, r"(.)\+08:00$", "$1")))
        .otherwise("")
    )
    rows = rows.withColumn("_spelled", spelled)
    rows = rows.withColumn("dueMs", iso_to_ms(F.col("_spelled")))
    noted = F.concat("dueOriginal", F.lit("；"), F.lit(NO_CLOCK_TIME_NOTE))
    bare = value.rlike(INPUT_DATE) & ~F.contains("dueOriginal", F.lit(NO_CLOCK_TIME_NOTE))
    return rows.withColumns({
        "due": F.when(value.rlike(INPUT_DATE) & F.col("dueMs").isNotNull(), F.col("_spelled"))
        .otherwise(publication_timestamp(F.col("dueMs"))),
        "dueOriginal": F.when(bare, noted).otherwise(F.col("dueOriginal")),
        "dueValid": empty | F.col("dueMs").isNotNull(),
    }).drop("_value", "_spelled")


def lenient_ms(text: Column) -> Column:
    """A date or timestamp text in the common spellings, NULL on failure; a bare date is UTC midnight, a clock time
    without offset is board time."""
    with_t = F.regexp_replace(text, " ", "T")
    zoned = iso_to_ms(F.when(with_t.rlike(r"T[0-9]{2}:[0-9]{2}(Z|[+-][0-9]{2}:[0-9]{2})$"),
                             F.regexp_replace(with_t, "(T[0-9]{2}:[0-9]{2})", "$1:00")).otherwise(with_t))
    naive = iso_to_ms(F.concat(
        F.when(with_t.rlike("T[0-9]{2}:[0-9]{2}$"), F.concat(with_t, F.lit(":00"))).otherwise(with_t),
        F.lit(PUBLICATION_OFFSET),
    ))
    return F.coalesce(F.when(text.rlike(INPUT_DATE), _day_ms(text)), zoned, naive)


def _match_minutes(text: Column, zone_minutes: Column) -> Column:
    """Does one stated clock time equal the given minute of day?"""
    groups = lambda pattern, group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    number = lambda value: F.coalesce(F.nullif(value, F.lit("")).cast("int"), F.lit(0))

    def agrees(hour: Column, minute: Column) -> Column:
        return ((hour != 24) | (minute == 0)) & ((hour % 24) * 60 + minute == zone_minutes)

    colon = F.exists(
        F.arrays_zip(groups(COLON_TIME, 1).alias("h"), groups(COLON_TIME, 2).alias("m")),
        lambda hit: agrees(number(hit["h"]), number(hit["m"])),
    )

    def in_day(period: Column, hour: Column) -> Column:
        return (
            F.when(period.isin(*AFTERNOON_PERIODS) & (hour < 12), hour + 12)
            .when(period.isin(*MORNING_PERIODS) & (hour == 12), F.lit(0))
            .otherwise(hour)
        )

    chinese = F.exists(
        F.arrays_zip(
            groups(CHINESE_TIME, 1).alias("p"), groups(CHINESE_TIME, 2).alias("h"), groups(CHINESE_TIME, 3).alias("m")
        ),
        lambda hit: ((number(hit["h"]) != 24) | (number(hit["m"]) == 0))
        & ((in_day(hit["p"], number(hit["h"])) % 24) * 60 + number(hit["m"]) == zone_minutes),
    )
    return colon | chinese


def states_clock_time(original: Column, ms: Column, zone: str = BOARD_ZONE) -> Column:
    """Does the original text state the clock time of the normalised deadline?"""
    wall = wall_clock(ms, zone)
    minutes = F.hour(wall) * 60 + F.minute(wall)
    stated = ~F.contains(original, F.lit(NO_CLOCK_TIME_NOTE)) & _match_minutes(original, minutes)
    return F.coalesce(ms.isNotNull() & stated, F.lit(False))


def chinese_date(wall: Column) -> Column:
    return F.concat(
        F.year(wall).cast("string"), F.lit("年"), F.month(wall).cast("string"), F.lit("月"),
        F.day(wall).cast("string"), F.lit("日"),
    )


def official_deadline(original: Column, ms: Column, zone: str = BOARD_ZONE) -> Column:
    """The deadline with the precision the notice states; 24:00 is shown on the day before."""
    wall = wall_clock(ms, zone)
    midnight = (F.hour(wall) == 0) & (F.minute(wall) == 0)
    return (
        F.when(ms.isNull(), NOT_PUBLISHED)
        .when(~states_clock_time(original, ms, zone), F.concat(chinese_date(wall), F.lit("（官网未公布具体时刻）")))
        .when(midnight & original.rlike(MIDNIGHT_24),
              F.concat(chinese_date(F.date_sub(wall.cast("date"), 1)), F.lit(" 24:00")))
        .otherwise(F.concat(chinese_date(wall), F.lit(" "), _chars(wall, 12, 5)))
    )


def urgency(remaining: Column) -> Column:
    return (
        F.when(remaining.isNull(), "unknown")
        .when(remaining < 0, "expired")
        .when(remaining < MS_PER_DAY, "critical")
        .when(remaining < 7 * MS_PER_DAY, "soon")
        .when(remaining < 30 * MS_PER_DAY, "near")
        .otherwise("far")
    )


def _div(value: Column, by: int) -> Column:
    return F.floor(value / by).cast("bigint")


def countdown_parts(remaining: Column) -> Column:
    """Struct(days, hours, minutes, seconds), never negative."""
    ms = F.greatest(remaining, F.lit(0).cast("bigint"))
    return F.struct(
        _div(ms, MS_PER_DAY).alias("days"),
        _div(ms % MS_PER_DAY, MS_PER_HOUR).alias("hours"),
        _div(ms % MS_PER_HOUR, MS_PER_MINUTE).alias("minutes"),
        _div(ms % MS_PER_MINUTE, MS_PER_SECOND).alias("seconds"),
    )


def countdown_text(remaining: Column) -> Column:
    parts = countdown_parts(remaining)
    clock = F.format_string("%02d:%02d:%02d", parts["hours"], parts["minutes"], parts["seconds"])
    return (
        F.when(remaining.isNull(), "N/A")
        .when(remaining < 0, "已结束")
        .when(parts["days"] > 0, F.concat(parts["days"].cast("string"), F.lit("天 "), clock))
        .otherwise(clock)
    )


def remaining_short(remaining: Column) -> Column:
    parts = countdown_parts(remaining)
    two = lambda a, ua, b, ub: F.concat(parts[a].cast("string"), F.lit(f"{ua} "), parts[b].cast("string"), F.lit(ub))
    return (
        F.when(remaining.isNull(), "—")
        .when(remaining < 0, "已结束")
        .when(parts["days"] > 0, two("days", "d", "hours", "h"))
        .when(parts["hours"] > 0, two("hours", "h", "minutes", "m"))
        .when(parts["minutes"] > 0, two("minutes", "m", "seconds", "s"))
        .otherwise(F.concat(parts["seconds"].cast("string"), F.lit("s")))
    )


def progress(remaining: Column, window_days: int = 90) -> Column:
    share = 1 - remaining / F.lit(window_days * MS_PER_DAY)
    return (
        F.when(remaining.isNull(), F.lit(0.0))
        .when(remaining < 0, F.lit(1.0))
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))
    )


def date_key(ms: Column, zone: str = BOARD_ZONE) -> Column:
    return _day(wall_clock(ms, zone))


def start_of_day_ms(ms: Column, zone: str = BOARD_ZONE) -> Column:
    """The instant at which the zoned day of ``ms`` begins."""
    day = wall_clock(ms, zone).cast("date").cast("timestamp_ntz")
    return ntz_to_ms(F.convert_timezone(F.lit(zone), F.lit("UTC"), day))


def date_long(ms: Column, zone: str = BOARD_ZONE) -> Column:
    wall = wall_clock(ms, zone)
    text = F.concat(
        F.year(wall).cast("string"), F.lit(" 年 "), F.month(wall).cast("string"), F.lit("月 "),
        F.day(wall).cast("string"), F.lit(" 日"),
    )
    return F.when(ms.isNull(), NOT_PUBLISHED).otherwise(text)


def date_short(ms: Column, zone: str = BOARD_ZONE) -> Column:
    wall = wall_clock(ms, zone)
    return F.when(ms.isNull(), "—").otherwise(
        F.concat(F.month(wall).cast("string"), F.lit("/"), F.day(wall).cast("string"))
    )


def date_time(ms: Column, zone: str = BOARD_ZONE) -> Column:
    return F.when(ms.isNull(), "—").otherwise(_chars(wall_clock(ms, zone), 1, 16))


def beijing_date(ms: Column) -> Column:
    return _day(wall_clock(ms + 8 * MS_PER_HOUR, "UTC"))


def beijing_year(ms: Column) -> Column:
    return F.year(wall_clock(ms + 8 * MS_PER_HOUR, "UTC")).cast("bigint")


def compact_utc(ms: Column) -> Column:
    wall = wall_clock(ms, "UTC")
    return F.concat(F.translate(_day(wall), "-", ""), F.lit("-"), F.translate(_chars(wall, 12, 8), ":", ""))


def utc_iso_millis(ms: Column) -> Column:
    wall = wall_clock(ms, "UTC")
    millis = F.lpad(F.pmod(ms, F.lit(MS_PER_SECOND)).cast("string"), 3, "0")
    return F.concat(_day(wall), F.lit("T"), _chars(wall, 12, 8), F.lit("."), millis, F.lit("Z"))


def snapshot_id(approved_ms: Column, data_hash: Column) -> Column:
    return F.concat(utc_iso_millis(approved_ms), F.lit("-"), F.substring(data_hash, 1, 12))


def parse_max_age_ms(hours: str) -> int:
    """Positive decimal hours -> whole milliseconds; a driver-side parameter check."""
    if not re.fullmatch(MAX_AGE_PATTERN, hours) or float(hours) <= 0:
        raise ValueError("maximum age must be a positive decimal number of hours")
    age = float(hours) * MS_PER_HOUR
    if age != int(age) or age > 2**53 - 1:
        raise ValueError("maximum age must resolve to whole milliseconds")
    return int(age)
