"""Boards, snapshots and scouting rows derived from the generated star-schema tables.

They let every operator run on tables of any size and let plain SQL check it.  Clock: 1998-07-01T00:00:00Z.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.functions.facts import fixed_fact
from tidemark.functions.text import literal_array
from tidemark.session import spread

AS_OF_MS = 899_251_200_000
ZONE = "UTC"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.get(literal_array(values), index.cast("int"))


def _deadline_text(key: Column, minutes: Column) -> Column:
    """Seven spellings of a notice, some of which state the normalised clock time."""
    hour, minute = F.floor(minutes / 60), minutes % 60
    colon = F.format_string("截止 %02d:%02d", hour, minute)
    period = F.when(hour >= 13, F.format_string("下午%d点%d分", hour - 12, minute)).otherwise(
        F.format_string("上午%d点%d分", hour, minute))
    return (
        F.when(key % 7 == 0, colon)
        .when(key % 7 == 1, period)
        .when(key % 7 == 2, F.format_string("%d时截止", hour))
        .when(key % 7 == 3, F.concat(colon, F.lit("；官方未公布具体时刻")))
        .when(key % 7 == 4, "")
        .when(key % 7 == 5, "当日 23:59")
        .otherwise("当日 24:00")
    )


def orders_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the customer's segment, nation and region; only the needed columns are read."""
    orders = spread(table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority",
        F.unix_date(F.col("o_orderdate").cast("date")).cast("bigint").alias("day"),
        F.year("o_orderdate").cast("string").alias("cycle"),
    ))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return (
        orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
        .join(nation, customer["c_nationkey"] == nation["n_nationkey"])
        .join(region, nation["n_regionkey"] == region["r_regionkey"])
    )


def as_board(joined: DataFrame, *more: Column) -> DataFrame:
    """The opportunity schema over enriched orders."""
    key = F.col("o_orderkey")
    minutes = key % 1440
    status = (
        F.when(F.col("o_orderstatus") == "F", S.EXPIRED)
        .when(F.col("o_orderstatus") == "O", S.OPEN)
        .otherwise(S.UNKNOWN_DEADLINE)
    )
    ms = F.when(F.col("o_orderstatus") != "P", F.col("day") * S.MS_PER_DAY + minutes * S.MS_PER_MINUTE)
    website = F.concat(
        F.lit("https://"), F.lower("n_name"), F.lit(".example.edu/p/"), (key % 1000).cast("string"))
    official = F.struct(
        F.lit("official").alias("kind"), F.lit(S.OFFICIAL_LINK_LABEL).alias("label"), website.alias("url"))
    notice = F.struct(
        F.lit("baoyan-notice").alias("kind"), F.lit(S.NOTICE_LINK_LABEL).alias("label"), website.alias("url"))
    deadline = F.when(ms.isNotNull(), F.concat(
        F.date_format(F.date_from_unix_date(F.col("day").cast("int")), "yyyy-MM-dd"),
        F.format_string("T%02d:%02d:00Z", F.floor(minutes / 60), minutes % 60)))
    return joined.select(
        F.concat_ws("|", "cycle", "n_name", "c_mktsegment", F.concat(F.lit("o"), key.cast("string"))).alias("projectId"),
        F.concat(F.lit("camp"), F.col("cycle")).alias("feedId"),
        F.col("n_name").alias("name"),
        F.col("c_mktsegment").alias("institute"),
        F.col("o_orderpriority").alias("project"),
        F.concat(F.lit("type "), (key % 5).cast("string")).alias("eventType"),
        F.when(key % 4 == 0, F.concat(F.lit("  note "), key.cast("string")))
        .when(key % 4 == 1, " ").otherwise(F.col("o_orderpriority")).alias("description"),
        status.alias("verificationStatus"),
        deadline.alias("deadline"),
        _deadline_text(key, minutes).alias("deadlineOriginal"),
        ms.alias("deadlineEpochMs"),
        website.alias("website"),
        F.when(key % 13 == 0, F.array().cast("array<string>"))
        .when(key % 3 == 0, F.array(_pick(S.TIER_TAGS, key % 10), _pick(S.TIER_TAGS, (key + 3) % 10)))
        .otherwise(F.array(_pick(S.TIER_TAGS, key % 10))).alias("tags"),
        F.when(key % 17 != 0, F.col("r_name")).alias("province"),
        F.lit("1998-06-30T00:00:00Z").alias("verifiedAt"),
        F.when(key % 3 != 0, F.array(notice, official)).otherwise(F.array(notice)).alias("discoverySources"),
        fixed_fact("confirmed", "yes").alias("logistics"),
        fixed_fact("not-published", "未公布").alias("recommendation"),
        fixed_fact("unverified", "待官方公布").alias("materials"),
        F.struct(
            _pick(S.EVENT_MODES, key % 4).alias("mode"),
            fixed_fact("unverified", "待官方公布").alias("time"),
            fixed_fact("unverified", "待官方公布").alias("formatLocation"),
        ).alias("eventArrangement"),
        *more,
    )


def board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_board(orders_enriched(spark, sf_dir))


def provinces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Province dimension: nation name -> region name."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(
        F.col("n_name").alias("name"), F.col("r_name").alias("province"))


REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


def board_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A previous and a following snapshot: some rows only on one side, some expired, some with another project."""
    joined = orders_enriched(spark, sf_dir)
    key = F.col("o_orderkey")
    previous = as_board(joined.where(key % 10 != 0))
    following = as_board(
        joined.where(key % 10 != 1).withColumns({
            "o_orderstatus": F.when(key % 11 == 5, "F").otherwise(F.col("o_orderstatus")),
            "o_orderpriority": F.when(key % 7 == 3, F.concat("o_orderpriority", F.lit(" v2"))).otherwise(F.col("o_orderpriority")),
        })
    ).withColumn("verifiedAt", F.lit("1998-06-30T12:00:00Z"))
    return previous, following


def monthly_tables(spark: SparkSession, sf_dir: str):
    """One snapshot for each order month, stored in key order, with planted violations of every kind."""
    from tidemark.sources.snapshots import SnapshotTables

    key = F.col("_k")
    month = F.date_format(F.date_from_unix_date(F.col("day").cast("int")), "yyyy-MM")
    keyed = as_board(orders_enriched(spark, sf_dir), F.col("o_orderkey").alias("_k"), month.alias("snapshotKey"))
    opportunities = keyed.withColumns({
        "pos": key,
        "website": F.when(key % 97 == 0, "https://sub.GitHub.com./x").when(key % 89 == 0, "https://u:p@h.example/")
        .when(key % 83 == 0, "ftp://files.example/").otherwise(F.col("website")),
        "verifiedAt": F.when(key % 73 == 0, "yesterday").when(key % 71 == 0, F.concat("snapshotKey", F.lit("-01T06:00:00Z")))
        .when(key % 67 == 0, F.concat("snapshotKey", F.lit("-02T00:00:00Z")))
        .otherwise(F.concat("snapshotKey", F.lit("-01T00:00:00Z"))),
        "deadline": F.when(key % 79 != 0, F.col("deadline")),
        "projectId": F.when(key % 61 == 0, "1998| |x|y").when(key % 59 == 0, F.concat(F.lit("19x8|a|b|"), key.cast("string")))
        .when(key % 53 == 0, "1998|dup|dup|dup").otherwise(F.col("projectId")),
    }).drop("_k")
    months = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("snapshotKey")).agg(
        F.count_if(F.col("o_orderstatus") == "O").alias("confirmedOpen"),
        F.count_if(F.col("o_orderstatus") == "P").alias("confirmedUnknownDeadline"),
        F.count_if(F.col("o_orderstatus") == "F").alias("expired"),
        F.count("*").alias("n"),
    )
    number = F.substring("snapshotKey", 6, 2).cast("int")
    cycle = F.substring("snapshotKey", 1, 4)
    seal_hash = lambda name: F.sha2(name, 256)
    before = F.date_format(F.add_months(F.to_date(F.concat("snapshotKey", F.lit("-01"))), -1), "yyyy-MM")
    id_of = lambda name: F.concat(name, F.lit("-01T12:00:00.000Z-"), F.substring(seal_hash(name), 1, 12))
    headers = months.select(
        "snapshotKey",
        F.when(number == 3, F.lit(3)).otherwise(F.lit(2)).cast("bigint").alias("schemaVersion"),
        F.when(number == 4, F.concat("snapshotKey", F.lit("-01 00:00"))).otherwise(F.concat("snapshotKey", F.lit("-01T00:00:00Z"))).alias("scanAt"),
        F.concat(F.lit("camp"), cycle).alias("defaultFeedId"),
        F.struct(
            (F.col("confirmedOpen") + F.when(number == 9, 1).otherwise(0)).alias("confirmedOpen"),
            "confirmedUnknownDeadline",
            F.when(number == 10, F.lit(-1).cast("bigint")).otherwise(F.col("n")).alias("pendingExcluded"),
            "expired").alias("counts"),
        id_of(F.col("snapshotKey")).alias("snapshotId"),
        F.when(number == 2, F.concat(before, F.lit("-01T00:00:00Z"))).otherwise(F.concat("snapshotKey", F.lit("-01T12:00:00Z"))).alias("approvedAt"),
        F.when(number == 11, "first").otherwise(id_of(before)).alias("previousSnapshotId"),
        F.when(number == 5, "xyz").otherwise(seal_hash(F.col("snapshotKey"))).alias("dataHash"),
    )
    feed = F.struct(
        F.lit(0).cast("bigint").alias("pos"), F.concat(F.lit("camp"), cycle).alias("id"), F.lit("label").alias("label"),
        F.when(number == 7, F.concat(F.substring(cycle, 1, 3), F.lit("X"))).otherwise(cycle).alias("admissionCycle"),
        cycle.cast("bigint").alias("eventYear"))
    again = feed.withField("pos", F.lit(1).cast("bigint"))
    feeds = months.where(number != 6).select(
        "snapshotKey", F.explode(F.when(number == 8, F.array(feed, again)).otherwise(F.array(feed))).alias("f")).select("snapshotKey", "f.*")
    return SnapshotTables(headers, feeds, opportunities)


APPROVED_AT = "1998-07-01T00:00:00Z"


def clean_candidate(spark: SparkSession, sf_dir: str):
    """One candidate of all orders which breaks no rule: states follow the clock, every row has an official source, rows stand in publication order."""
    from tidemark.operators.board import publication_order
    from tidemark.operators.facets import snapshot_counts
    from tidemark.operators.positions import with_position
    from tidemark.session import materialise
    from tidemark.sources.snapshots import SnapshotTables

    ms = F.col("deadlineEpochMs")
    official = F.struct(F.lit("official").alias("kind"), F.lit(S.OFFICIAL_LINK_LABEL).alias("label"), F.col("website").alias("url"))
    notice = F.struct(F.lit("baoyan-notice").alias("kind"), F.lit(S.NOTICE_LINK_LABEL).alias("label"), F.col("website").alias("url"))
    rows = board(spark, sf_dir).withColumns({
        "verificationStatus": F.when(ms.isNull(), S.UNKNOWN_DEADLINE).when(ms > AS_OF_MS, S.OPEN).otherwise(S.EXPIRED), "discoverySources": F.array(notice, official)})
    ordered = with_position(rows, publication_order())
    opportunities = materialise(ordered.select(F.lit("candidate").alias("snapshotKey"), (F.col("pos") - 1).alias("pos"), *S.OPPORTUNITY_COLUMNS))
    cycles = opportunities.groupBy("snapshotKey").agg(F.array_sort(F.collect_set("feedId")).alias("ids"))  # one for each year
    feeds = cycles.select("snapshotKey", F.posexplode("ids").alias("pos", "id")).select(
        "snapshotKey", F.col("pos").cast("bigint").alias("pos"), "id", F.lit("label").alias("label"), F.substring("id", 5, 4).alias("admissionCycle"),
        F.substring("id", 5, 4).cast("bigint").alias("eventYear"))
    counts = snapshot_counts(opportunities, ["snapshotKey"]).withColumn("pendingExcluded", F.lit(0))
    headers = counts.join(cycles, "snapshotKey").select(
        "snapshotKey", F.lit(2).cast("bigint").alias("schemaVersion"), F.lit(APPROVED_AT).alias("scanAt"), F.element_at("ids", 1).alias("defaultFeedId"),
        F.struct(*[F.col(name).cast("bigint").alias(name) for name in S.COUNT_KEYS]).alias("counts"), *[F.lit(None).cast("string").alias(name) for name in S.APPROVAL_KEYS])
    return SnapshotTables(headers, feeds, opportunities)


def board_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(snapshotKey, doc VARIANT): candidate documents of the orders of 64 neighbouring keys, with planted faults of shape, type and value.

    Their number grows with the orders, the size of each does not.
    """
    from tidemark.functions.canonical import canonical_json

    key, order_key = F.col("_k"), F.col("o_orderkey")
    # The few columns of an order are dealt out by document; its texts, many times as long, are made where their document is put together.
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = orders_enriched(spark, sf_dir).withColumn("b", order_key - order_key % 64).repartition(tasks, "b")
    rows = as_board(dealt, order_key.alias("_k"), F.col("b")).withColumn(
        "description", F.when(key % 53 == 0, "write to a@b.example").otherwise(F.col("description")))
    body = canonical_json(S.OPPORTUNITY)
    for number, pattern, other in (
        (31, r"\}$", ',"extra":1}'), (37, r'"name":"[^"]*"', '"name":5'), (41, r'"tags":\[[^\]]*\]', '"tags":["x",1]'),
        (43, r'"logistics":\{"status":"confirmed","summary":"yes"\}', '"logistics":{"status":"confirmed"}'), (47, r',"website":"[^"]*"\}$', "}"),
    ):
        body = F.when(key % number == 0, F.regexp_replace(body, pattern, other)).otherwise(body)
    slim = rows.select("b", key.alias("k"), "feedId", "verificationStatus", body.alias("body"))
    number = F.floor(F.col("b") / 64)
    count = lambda status: F.count_if(F.col("verificationStatus") == status)
    blocks = slim.groupBy("b").agg(
        F.array_sort(F.collect_list(F.struct("k", "body"))).alias("rows"), F.array_sort(F.collect_set("feedId")).alias("feeds"),
        count(S.OPEN).alias("n_open"), count(S.UNKNOWN_DEADLINE).alias("n_unknown"), count(S.EXPIRED).alias("n_expired"))
    cycle = lambda feed: F.substring(feed, 5, 4)
    feeds = F.array_join(F.transform("feeds", lambda feed: F.concat(
        F.lit('{"id":"'), feed, F.lit('","label":"x","admissionCycle":"'), cycle(feed), F.when(number % 17 == 0, '","eventYear":"').otherwise('","eventYear":'),
        cycle(feed), F.when(number % 17 == 0, '"}').otherwise("}"))), ",")
    text = F.concat(
        F.lit('{"schemaVersion":2,"scanAt":'), F.when(number % 13 == 0, "5").otherwise('"1998-07-01T00:00:00Z"'), F.lit(',"defaultFeedId":"'), F.element_at("feeds", 1),
        F.lit('","feeds":['), feeds, F.lit('],"counts":{"confirmedOpen":'), (F.col("n_open") + F.when(number % 7 == 0, 1).otherwise(0)).cast("string"),
        F.lit(',"confirmedUnknownDeadline":'), F.col("n_unknown").cast("string"), F.lit(',"pendingExcluded":0,"expired":'), F.col("n_expired").cast("string"),
        F.lit('},"opportunities":['), F.array_join(F.transform("rows", lambda row: row["body"]), ","), F.when(number % 11 == 0, '],"note":1}').otherwise("]}"))
    return blocks.select(F.concat(F.lit("b"), number.cast("string")).alias("snapshotKey"), F.parse_json(text).alias("doc"))


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One release record for each month; some malformed, some of unknown snapshots or with another hash."""
    headers = monthly_tables(spark, sf_dir).headers
    number = F.substring("snapshotKey", 6, 2).cast("int")
    return headers.select(
        F.col("snapshotKey").alias("releaseKey"),
        F.when(number == 1, "HEAD").otherwise(F.substring(F.sha2("snapshotKey", 256), 1, 40)).alias("releaseSha"),
        F.when(number == 12, F.concat("snapshotId", F.lit("0"))).otherwise(F.col("snapshotId")).alias("snapshotId"),
        F.when(number == 6, F.sha2(F.concat("snapshotKey", F.lit("x")), 256)).otherwise(F.sha2("snapshotKey", 256)).alias("dataHash"))


# ------------------------------------------------------------------ scouting rows
SCAN_AT = "1998-07-01T08:00:00+08:00"


def _customer_url(spelling: Column) -> Column:
    """The address of a customer in five spellings of one normal form."""
    host = F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit(".example.edu"))
    return (
        F.when(spelling == 0, F.concat(F.lit("https://"), host, F.lit("/apply?a=1&b=2")))
        .when(spelling == 1, F.concat(F.lit("HTTPS://"), F.upper(host), F.lit("/apply?b=2&a=1")))
        .when(spelling == 2, F.concat(F.lit("https://"), host, F.lit(".:443/apply/?a=1&b=2#top")))
        .when(spelling == 3, F.concat(F.lit("https://"), host, F.lit("/apply//?b=2&a=1")))
        .otherwise(F.concat(F.lit("https://"), host, F.lit("/apply?&a=1&b=2#x")))
    )


def _scouting_id(marker: str = "o") -> Column:
    return F.concat_ws("|", "cycle", "n_name", "c_mktsegment", F.concat(F.lit(marker), F.col("o_orderkey").cast("string")))


def previous_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published (projectId, website): nine tenths of the orders, some under another id."""
    key = F.col("o_orderkey")
    return orders_enriched(spark, sf_dir).where(key % 10 != 0).select(
        F.when(key % 9 == 4, _scouting_id("r")).otherwise(_scouting_id()).alias("projectId"),
        _customer_url(key % 5).alias("website"))


def alias_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alias map entries: compound ones for half of the renamed orders, simple ones for some new customers, bad ones."""
    key = F.col("o_orderkey")
    joined = orders_enriched(spark, sf_dir)
    compound = joined.where((key % 18 == 4) & (key % 10 != 0)).select(
        F.concat(_customer_url(key % 3), F.lit("::"), _scouting_id()).alias("alias"),
        F.when(key % 900 == 4, F.concat(_scouting_id("r"), F.lit("x"))).otherwise(_scouting_id("r")).alias("target"))
    simple = joined.where(key % 10 == 0).groupBy("o_custkey").agg(F.min(F.struct("o_orderkey", _scouting_id("s").alias("id"))).alias("m")).select(
        _customer_url(F.lit(3)).alias("alias"), F.col("m.id").alias("target"))
    bad = joined.where(key % 500 == 7).select(
        F.when(key % 1000 == 7, F.concat(_customer_url(F.lit(0)), F.lit("::"))).otherwise(F.concat(F.lit("ftp://x/"), key.cast("string"))).alias("alias"),
        _scouting_id().alias("target"))
    return compound.unionAll(simple).unionAll(bad)


def scouting_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(section, pos, row VARIANT) of a scouting batch over all orders, with loose and mixed-type fields."""
    key = F.col("o_orderkey")
    day = F.date_format(F.date_from_unix_date(F.col("day").cast("int")), "yyyy-MM-dd")
    active = F.col("o_orderstatus") != "F"
    section = F.when(key % 29 == 0, "pendingRows").when(active, "mainRows").otherwise("expiredRows")
    status = F.when(F.col("o_orderstatus") == "O", S.OPEN).when(F.col("o_orderstatus") == "P", S.UNKNOWN_DEADLINE).otherwise(S.EXPIRED)
    deadline = (
        F.when(F.col("o_orderstatus") == "P", F.lit(None).cast("string"))
        .when(key % 4 == 0, day).when(key % 4 == 1, F.concat(day, F.lit(" 17:30")))
        .when(key % 4 == 2, F.concat(day, F.lit("T10:15:20.5Z"))).otherwise(F.concat(day, F.lit("T23:00:00-05:30")))
    )
    pieces = [
        F.to_json(F.struct(
            F.concat(F.lit("  "), _scouting_id()).alias("projectId"), F.col("n_name").alias("school"), F.col("o_orderpriority").alias("project"),
            F.when(active, F.concat(F.lit("type "), (key % 5).cast("string"))).alias("eventType"),
            F.when(key % 41 != 0, _pick(S.EVENT_MODES, key % 4)).alias("eventMode"),
            F.when(key % 43 == 0, "1990 2001").when(active, F.concat("cycle", F.lit(" season"))).alias("cycle"),
            F.when(key % 47 == 0, "pending").otherwise(status).alias("verificationStatus"),
            deadline.alias("deadline"), F.when(key % 6 != 0, F.lit("见官网")).when(active, F.lit("官方未公布具体时刻")).alias("deadlineOriginal"),
            _customer_url(key % 5).alias("officialUrl"), F.lit("1998-06-30T00:00:00Z").alias("verifiedAt"),
            F.when(key % 3 == 0, F.lit("https://notice.example/n")).alias("baoyanNoticeUrl"),
            F.when(key % 8 == 0, "统一安排住宿").when(key % 8 == 1, "未公布").when(key % 8 == 2, "/home/me/notes.txt").alias("accommodation"),
            F.when(key % 8 == 3, "可能提供").when(key % 8 == 0, "提供午餐").when(key % 8 == 4, " ").alias("meals"),
            F.lit("secret").alias("risks"), F.lit(9).alias("welfareScore"))),
    ]
    letters = F.when(key % 5 == 0, "2").when(key % 5 == 1, '["一封", " ", "两封", 3]').when(key % 5 == 2, '"两封"').when(key % 5 == 3, "true").otherwise("1.5")
    body = F.concat(F.regexp_replace(pieces[0], r"\}$", ',"recommendationLetters":'), letters, F.lit("}"))
    return orders_enriched(spark, sf_dir).select(section.alias("section"), key.alias("pos"), F.parse_json(body).alias("row"))


# ------------------------------------------------------------------ legacy archive and logos
def legacy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feedId, pos, legacy columns) from suppliers."""
    key = F.col("s_suppkey")
    nation = table(spark, sf_dir, "nation")
    return table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.when(key % 4 == 0, "camp1998").when(key % 4 == 1, "camp2099").when(key % 4 == 2, "yutuimian2098").otherwise("misc").alias("feedId"),
        key.alias("pos"),
        F.when(key % 9 == 0, F.concat("s_name", F.lit("研究所"))).otherwise(F.col("n_name")).alias("name"),
        F.concat(F.lit("inst"), (key % 3).cast("string")).alias("institute"),
        F.col("s_name").alias("description"),
        F.when(key % 5 == 0, "1997-03-01T12:00:00+08:00").when(key % 5 == 1, " 1997-03-02 ").when(key % 5 == 2, "soon").when(key % 5 == 3, "").alias("deadline"),
        F.when(key % 2 == 0, "https://old.example/x").otherwise("").alias("website"),
        F.when(key % 6 == 0, F.array(F.lit("四非"), F.lit("985"))).when(key % 6 == 1, F.array(F.lit("已结营"), F.lit("211")))
        .when(key % 6 == 2, F.array(F.lit("已开营"))).otherwise(F.array().cast("array<string>")).alias("tags"),
        F.when(key % 7 == 0, "P").alias("province"))


def logo_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, name, logo_url) ranking records from parts: mixed Chinese and Latin names, repeated."""
    key = F.col("p_partkey")
    chinese = _pick(("清华大学", "北京大学（深圳）", "复旦大学·医学院", "南京大学", ""), key % 5)
    return table(spark, sf_dir, "part").select(
        key.alias("pos"), F.concat(chinese, "p_brand", F.lit("/985")).alias("name"),
        F.when(key % 7 == 0, "").otherwise(F.concat(F.lit("/logo/"), key.cast("string"), F.lit(".png"))).alias("logo_url"))
