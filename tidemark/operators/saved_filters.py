"""Shared links: parameter records become filters, many filters are evaluated on the board at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.functions import text
from tidemark.operators.board import search_text, status_label

_ANY = ""


def parse(links: DataFrame, feeds: DataFrame, default_feed: str) -> DataFrame:
    """Raw columns (filter_id, src, view, q, tags, status, modes, prov) -> checked filter columns.

    Unknown feeds and views fall back to the default, two old status words are translated, status and mode values
    outside the enums are dropped, tags and provinces pass as they are.
    """
    known = feeds.select(F.col("id").alias("_feed")).distinct()
    aliases = F.create_map(*[F.lit(part) for pair in S.STATUS_ALIASES.items() for part in pair])
    translated = F.transform(
        text.split_list(F.col("status")), lambda item: F.coalesce(F.try_element_at(aliases, item), item)
    )
    return links.join(known, F.col("src") == F.col("_feed"), "left").select(
        "filter_id",
        F.coalesce("_feed", F.lit(default_feed)).alias("source"),
        F.when(F.col("view").isin(*S.VIEWS), F.col("view")).otherwise("list").alias("view"),
        F.coalesce("q", F.lit("")).alias("query"),
        text.split_list(F.col("tags")).alias("tags"),
        F.array_distinct(F.filter(translated, lambda item: item.isin(*S.STATUS_TAGS))).alias("status"),
        text.enum_list(F.col("modes"), S.EVENT_MODES).alias("modes"),
        text.split_list(F.col("prov")).alias("provinces"),
    )


def matches(rows: DataFrame, filters: DataFrame) -> DataFrame:
    """(filter_id, projectId) for each visible row of each filter.

    Every dimension becomes a part of one equi-join key, so no nested loop is needed: a filter is expanded over the
    status and mode values it admits, over its provinces and over its tags; a board row is expanded over "any" and its
    own value of the two open dimensions.  A row which holds several tags of a filter meets it once for each of them;
    only the first common tag counts.  The text search is a residual test on the joined pairs.
    """
    # A dimension with no selected value admits all of its enum; the open ones use the "any" key.
    all_status, all_modes = text.literal_array(S.STATUS_TAGS), text.literal_array(S.EVENT_MODES)
    open_key = F.array(F.lit(_ANY))
    keyed = filters.select(
        "filter_id", F.col("source").alias("feedId"), F.col("tags").alias("wanted_tags"),
        F.lower(text.trim_u(F.col("query"))).alias("needle"),
        F.explode(F.when(F.size("status") > 0, F.col("status")).otherwise(all_status)).alias("k_status"),
        "modes", "provinces",
    )
    keyed = keyed.withColumn("k_mode", F.explode(F.when(F.size("modes") > 0, F.col("modes")).otherwise(all_modes)))
    keyed = keyed.withColumn("k_province", F.explode(
        F.when(F.size("provinces") > 0, F.array_distinct("provinces")).otherwise(open_key)))
    keyed = keyed.withColumn("k_tag", F.explode(
        F.when(F.size("wanted_tags") > 0, F.array_distinct("wanted_tags")).otherwise(open_key)))
    board = rows.select(
        "projectId", "feedId", "tags", search_text().alias("hay"),
        status_label(F.col("rowGroup")).alias("k_status"),
        F.col("eventArrangement.mode").alias("k_mode"),
        F.explode(F.array_distinct(F.array(F.lit(_ANY), F.coalesce("resolvedProvince", F.lit(_ANY))))).alias("k_province"),
    ).withColumn("k_tag", F.explode(F.array_distinct(F.array_prepend("tags", F.lit(_ANY)))))
    first_common = (F.col("k_tag") == _ANY) | (
        F.get(F.array_intersect("tags", "wanted_tags"), F.lit(0)) == F.col("k_tag"))
    return (
        board.join(keyed, ["feedId", "k_status", "k_mode", "k_province", "k_tag"])
        .where(first_common & ((F.col("needle") == "") | F.contains("hay", F.col("needle"))))
        .select("filter_id", "projectId")
    )
