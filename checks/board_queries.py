"""Board, facet, filter and calendar queries over the order board."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import bench_views as B
from tidemark import schema as S
from tidemark.functions import dates, text
from tidemark.operators import board as ops
from tidemark.operators import calendar, facets, saved_filters


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.derive(B.board(spark, sf_dir), B.AS_OF_MS)


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.resolve_province(derived(spark, sf_dir), B.provinces(spark, sf_dir))


def board_ranked(spark, sf_dir):
    slim = derived(spark, sf_dir).select("projectId", "rowGroup", "deadlineEpochMs")
    return ops.ranked(slim).select(
        F.col("projectId").alias("project_id"), F.col("rowGroup").alias("row_group"),
        F.col("deadlineEpochMs").alias("deadline_ms"), "pos")


def board_next_k(spark, sf_dir):
    return ops.next_k(derived(spark, sf_dir), 100).select(
        F.col("projectId").alias("project_id"), F.col("rowGroup").alias("row_group"),
        F.col("remainingMs").alias("remaining_ms"), "urgency")


def board_urgency(spark, sf_dir):
    return derived(spark, sf_dir).groupBy("urgency", F.col("rowGroup").alias("row_group")).agg(
        F.count("*").alias("n"), F.min("remainingMs").alias("min_remaining"), F.max("remainingMs").alias("max_remaining"))


def board_labels(spark, sf_dir):
    return derived(spark, sf_dir).select(
        F.col("projectId").alias("project_id"),
        ops.status_label(F.col("rowGroup")).alias("status_label"),
        ops.expired_text(F.col("rowGroup")).alias("expired_text"),
        ops.mode_label(F.col("eventArrangement.mode")).alias("mode_label"),
        ops.fact_label(F.col("materials.status")).alias("materials_label"),
        ops.source_label(F.col("discoverySources")).alias("source_label"))


def board_detail(spark, sf_dir):
    return ops.detail(B.board(spark, sf_dir), B.ZONE).select(
        F.col("projectId").alias("project_id"), "description", F.col("officialUrl").alias("official_url"),
        F.col("deadlineText").alias("deadline_text"), F.col("logisticsLabel").alias("logistics_label"))


def deadline_texts(spark, sf_dir):
    return B.board(spark, sf_dir).select(
        F.col("projectId").alias("project_id"),
        dates.states_clock_time(F.col("deadlineOriginal"), F.col("deadlineEpochMs"), B.ZONE).alias("states_time"),
        dates.official_deadline(F.col("deadlineOriginal"), F.col("deadlineEpochMs"), B.ZONE).alias("shown"))


def countdown_parts(spark, sf_dir):
    remaining = F.col("remainingMs")
    parts = dates.countdown_parts(remaining)
    return derived(spark, sf_dir).select(
        F.col("projectId").alias("project_id"),
        parts["days"].alias("days"), parts["hours"].alias("hours"), parts["minutes"].alias("minutes"),
        parts["seconds"].alias("seconds"),
        dates.countdown_text(remaining).alias("countdown"), dates.remaining_short(remaining).alias("short"),
        F.round(dates.progress(remaining), 6).alias("progress"))


def date_texts(spark, sf_dir):
    ms = F.col("deadlineEpochMs")
    return B.board(spark, sf_dir).select(
        F.col("projectId").alias("project_id"),
        dates.date_key(ms, "Asia/Shanghai").alias("day_key"),
        dates.date_long(ms, "Asia/Shanghai").alias("long_text"),
        dates.date_short(ms, "Asia/Shanghai").alias("short_text"),
        dates.date_time(ms, "Asia/Shanghai").alias("time_text"),
        dates.start_of_day_ms(ms, "Asia/Shanghai").alias("day_start_ms"),
        dates.beijing_date(ms).alias("publication_day"),
        dates.beijing_year(ms).alias("publication_year"),
        dates.compact_utc(ms).alias("compact_utc"))


def province_resolved(spark, sf_dir):
    return located(spark, sf_dir).select(
        F.col("projectId").alias("project_id"), F.col("resolvedProvince").alias("province"))


def facet_status(spark, sf_dir):
    return facets.status_facet(derived(spark, sf_dir)).select("status", "n")


def facet_mode(spark, sf_dir):
    return facets.mode_facet(B.board(spark, sf_dir)).select("mode", "n")


def facet_tags(spark, sf_dir):
    return facets.tag_facet(B.board(spark, sf_dir)).select("tag", "n")


def facet_province(spark, sf_dir):
    values = B.REGIONS + S.PROVINCES
    return facets.province_facet(located(spark, sf_dir), values).select("province", "n")


def facets_all(spark, sf_dir):
    return facets.all_facets(located(spark, sf_dir), B.REGIONS)


def upcoming_counts(spark, sf_dir):
    return facets.upcoming(derived(spark, sf_dir)).select("week", "month", F.col("all").alias("all_ahead"))


def feed_counts(spark, sf_dir):
    rows = B.board(spark, sf_dir)
    feeds = facets.cycle_feeds(rows, F.lit(1998)).select("id").union(spark.range(1).select(F.lit("camp1990")))
    return facets.feed_counts(rows, feeds).select(F.col("feedId").alias("feed_id"), "n")


def snapshot_counts(spark, sf_dir):
    return facets.snapshot_counts(B.board(spark, sf_dir), ["feedId"]).select(
        F.col("feedId").alias("feed_id"), F.col("confirmedOpen").alias("confirmed_open"),
        F.col("confirmedUnknownDeadline").alias("confirmed_unknown_deadline"), "expired")


def group_sizes(spark, sf_dir):
    return facets.group_sizes(derived(spark, sf_dir))


def visible_counts(spark, sf_dir):
    chosen = ops.BoardFilter(query="HIGH", status=[S.LABEL_OPEN], modes=["online", "hybrid"])
    return facets.visible_counts(derived(spark, sf_dir), ops.predicate(chosen))


def tag_presence(spark, sf_dir):
    rows = B.board(spark, sf_dir)
    return facets.has_tags(rows, by=["feedId"]).withColumnRenamed("feedId", "feed_id")


def newest_active_cycle(spark, sf_dir):
    return facets.newest_active_cycle(B.board(spark, sf_dir))


def cycle_feeds(spark, sf_dir):
    return facets.cycle_feeds(B.board(spark, sf_dir), dates.beijing_year(F.lit(B.AS_OF_MS).cast("bigint"))).select(
        "id", "label", F.col("admissionCycle").alias("admission_cycle"), F.col("eventYear").alias("event_year"))


def board_filtered(spark, sf_dir):
    chosen = ops.BoardFilter(query=" machinery 2", tags=["985", "211", "C9"], status=[S.LABEL_OPEN, S.LABEL_ENDED],
                             modes=["online", "offline"], provinces=["ASIA", "EUROPE"])
    return ops.apply_filter(derived(spark, sf_dir), chosen, B.provinces(spark, sf_dir)).select(
        F.col("projectId").alias("project_id"), "urgency")


def board_search(spark, sf_dir):
    return ops.apply_filter(derived(spark, sf_dir), ops.BoardFilter(query="Building 1-UR")).select(
        F.col("projectId").alias("project_id"))


def board_by_tag(spark, sf_dir):
    return ops.apply_filter(derived(spark, sf_dir), ops.BoardFilter(tags=["TOP2"])).select(
        F.col("projectId").alias("project_id"))


def board_by_status(spark, sf_dir):
    return ops.apply_filter(derived(spark, sf_dir), ops.BoardFilter(status=[S.LABEL_OPEN])).select(
        F.col("projectId").alias("project_id"))


def board_by_mode(spark, sf_dir):
    return ops.apply_filter(derived(spark, sf_dir), ops.BoardFilter(modes=["unknown"])).select(
        F.col("projectId").alias("project_id"))


def board_by_province(spark, sf_dir):
    chosen = ops.BoardFilter(provinces=["AFRICA"])
    return ops.apply_filter(derived(spark, sf_dir), chosen, B.provinces(spark, sf_dir)).select(
        F.col("projectId").alias("project_id"))


def feed_board(spark, sf_dir):
    return ops.of_feed(derived(spark, sf_dir), "camp1998").select(
        F.col("projectId").alias("project_id"), F.col("rowGroup").alias("row_group"))


def point_lookup(spark, sf_dir):
    visible = ops.apply_filter(derived(spark, sf_dir), ops.BoardFilter(status=[S.LABEL_OPEN, S.LABEL_ENDED]))
    first = visible.agg(F.min("projectId").alias("id")).head()["id"]
    rows = ops.point_lookup(visible, first)
    return rows.select(F.col("projectId").alias("project_id"), "urgency")


def publication_order(spark, sf_dir):
    from tidemark.operators.positions import with_group_position

    slim = B.board(spark, sf_dir).select("feedId", "projectId", "verificationStatus", "deadlineEpochMs")
    return with_group_position(slim, ["feedId"], ops.publication_order()).select(
        F.col("feedId").alias("feed_id"), F.col("projectId").alias("project_id"), "pos")


def _link_rows(source: DataFrame, key: str, words: str) -> DataFrame:
    """Shared links, one raw parameter record for each row of a table."""
    key = F.col(key)
    return source.select(
        key.cast("bigint").alias("filter_id"),
        F.concat(F.lit("camp"), (F.lit(1990) + key % 14).cast("string")).alias("src"),
        F.when(key % 3 == 0, "calendar").when(key % 3 == 1, "grid").alias("view"),
        F.when(key % 2 == 0, F.concat(F.lit(" "), F.col(words))).otherwise("").alias("q"),
        F.when(key % 5 == 0, "985, 211,,").when(key % 5 == 1, "C9").alias("tags"),
        F.when(key % 4 == 0, "已开营,开放,x").when(key % 4 == 1, "已结束,已结营").alias("status"),
        F.when(key % 3 == 0, "online,online, hybrid,bad").alias("modes"),
        F.when(key % 7 == 0, "ASIA,EUROPE").when(key % 7 == 1, "AFRICA").alias("prov"))


def filter_params(spark, sf_dir):
    feeds = facets.cycle_feeds(B.board(spark, sf_dir), F.lit(1998)).select("id")
    parsed = saved_filters.parse(_link_rows(B.table(spark, sf_dir, "customer"), "c_custkey", "c_mktsegment"), feeds, "camp1998")
    joined = lambda name: F.array_join(name, ",").alias(name)
    return parsed.select("filter_id", "source", "view", "query", joined("tags"), joined("status"), joined("modes"),
                         joined("provinces"))


def saved_filter_matches(spark, sf_dir):
    feeds = facets.cycle_feeds(B.board(spark, sf_dir), F.lit(1998)).select("id")
    links = _link_rows(B.table(spark, sf_dir, "nation"), "n_nationkey", "n_name")
    parsed = saved_filters.parse(links, feeds, "camp1998")
    return saved_filters.matches(located(spark, sf_dir), parsed).select("filter_id", F.col("projectId").alias("project_id"))


def calendar_pick(spark, sf_dir):
    month = calendar.pick_month(B.board(spark, sf_dir), B.AS_OF_MS, B.ZONE)
    text_of = lambda frame, name: frame.select(F.lit(name).alias("which"), F.date_format("first_day", "yyyy-MM-dd").alias("first_day"))
    return (text_of(month, "shown").unionAll(text_of(calendar.shifted(month, -1), "previous"))
            .unionAll(text_of(calendar.shifted(month, 1), "next")))


def calendar_month(spark, sf_dir):
    return calendar.month(B.board(spark, sf_dir), B.AS_OF_MS, B.ZONE)


def calendar_preview(spark, sf_dir):
    return calendar.preview(derived(spark, sf_dir), B.AS_OF_MS, B.ZONE).select(
        "date_key", "rank", F.col("projectId").alias("project_id"), "urgency")


QUERIES = {
    f.__name__: f for f in (
        board_ranked, board_next_k, board_urgency, board_labels, board_detail, deadline_texts, countdown_parts,
        date_texts, province_resolved, facet_status, facet_mode, facet_tags, facet_province, facets_all,
        upcoming_counts, feed_counts, snapshot_counts, group_sizes, visible_counts, tag_presence,
        newest_active_cycle, cycle_feeds, board_filtered, board_search, board_by_tag, board_by_status, board_by_mode,
        board_by_province, feed_board, point_lookup, publication_order, filter_params, saved_filter_matches,
        calendar_pick, calendar_month, calendar_preview,
    )
}
