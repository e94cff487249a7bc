"""Approved and archived rows as one catalog: version adapter, legacy mapping, tiers, logos."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.functions import dates, text
from tidemark.functions.facts import fixed_fact
from tidemark.operators.positions import first_wins

_NO_TAGS = "array<string>"


def adapt_versions(rows: DataFrame) -> DataFrame:
    """Rows of schema version 1 (column ``schemaVersion``) get the unknown event arrangement."""
    unrecorded = fixed_fact("unverified", S.V1_FACT_SUMMARY)
    filler = F.struct(F.lit("unknown").alias("mode"), unrecorded.alias("time"), unrecorded.alias("formatLocation"))
    return rows.withColumn(
        "eventArrangement", F.when(F.col("schemaVersion") == 1, filler).otherwise(F.col("eventArrangement")))


# ------------------------------------------------------------------ tiers
def preferred_tier(tags: Column) -> Column:
    """The first tier of the priority list among the tags, or NULL."""
    held = F.filter(text.literal_array(S.TIER_PRIORITY), lambda tier: F.array_contains(tags, tier))
    return F.try_element_at(held, F.lit(1))


def tier_tags(name: Column, explicit: Column, historical: Column | None = None) -> Column:
    """One tier as a list: by the row's tags, else by historical tags, else by a research-institute name, else none."""
    candidates = [preferred_tier(explicit)]
    if historical is not None:
        candidates.append(F.when(historical.isNotNull(), preferred_tier(historical)))
    candidates.append(F.when(name.rlike(S.RESEARCH_NAME_PATTERN), S.RESEARCH_TIER))
    return F.array_compact(F.array(F.coalesce(*candidates)))


def display_tags(tags: Column) -> Column:
    return F.filter(tags, lambda tag: ~tag.isin(*S.STALE_STATUS_TAGS))


def historical_tags(legacy: DataFrame) -> DataFrame:
    """(name, historicalTags) over all archived feeds.

    Only tier tags can matter later, so at most ten values are kept for a name however many rows it has.
    """
    tiers = legacy.select("name", F.explode("tags").alias("tag")).where(F.col("tag").isin(*S.TIER_TAGS))
    return tiers.groupBy("name").agg(F.collect_set("tag").alias("historicalTags"))


def with_tier(rows: DataFrame, legacy: DataFrame) -> DataFrame:
    """Replace the tags of approved rows by their one tier."""
    return rows.join(historical_tags(legacy), "name", "left").withColumn(
        "tags", tier_tags(F.col("name"), F.col("tags"), F.col("historicalTags"))).drop("historicalTags")


# ------------------------------------------------------------------ legacy archive
def legacy_feeds(legacy: DataFrame, approved_feeds: DataFrame) -> DataFrame:
    """Descriptors of the archived feeds which the approved catalog lacks."""
    missing = legacy.select("feedId").distinct().join(approved_feeds.select(F.col("id").alias("feedId")), "feedId", "left_anti")
    found = F.regexp_extract("feedId", r"\d{4}", 0)
    year = F.when(found == "", "0000").otherwise(found)
    label = (
        F.when(F.col("feedId").startswith("camp"), F.concat(F.lit("夏令营 "), year))
        .when(F.col("feedId").startswith("yutuimian"), F.concat(F.lit("预推免 "), year))
        .otherwise(F.col("feedId"))
    )
    return missing.select(
        F.col("feedId").alias("id"), F.concat(label, F.lit("（历史归档）")).alias("label"),
        year.alias("admissionCycle"), year.cast("bigint").alias("eventYear"))


def legacy_id(feed: Column, name: Column, institute: Column, position: Column) -> Column:
    return F.concat_ws("|", F.lit("legacy"), feed, name, institute, position.cast("string"))


def map_legacy(legacy: DataFrame) -> DataFrame:
    """(feedId, pos, legacy columns) -> opportunity rows: expired, unverified facts, a source only with a website."""
    fact = fixed_fact("unverified", S.LEGACY_FACT_SUMMARY)
    original = F.coalesce(text.trim_u(F.col("deadline")), F.lit(""))
    ms = dates.lenient_ms(original)
    website = F.coalesce("website", F.lit(""))
    link = F.struct(F.lit("other-discovery").alias("kind"), F.lit(S.LEGACY_SOURCE_LABEL).alias("label"), website.alias("url"))
    no_link = F.array().cast(S.OPPORTUNITY["discoverySources"].dataType)
    return legacy.select(
        legacy_id(F.col("feedId"), F.col("name"), F.col("institute"), F.col("pos")).alias("projectId"),
        "feedId", "name", "institute",
        F.col("description").alias("project"),
        F.lit(S.LEGACY_EVENT_TYPE).alias("eventType"),
        "description",
        F.lit(S.EXPIRED).alias("verificationStatus"),
        F.when(ms.isNotNull(), original).alias("deadline"),
        F.when(original == "", S.LEGACY_NO_DEADLINE).otherwise(original).alias("deadlineOriginal"),
        ms.alias("deadlineEpochMs"),
        website.alias("website"),
        tier_tags(F.col("name"), display_tags(F.col("tags"))).alias("tags"),
        F.when(F.col("province") != "", F.col("province")).alias("province"),
        F.lit("").alias("verifiedAt"),
        F.when(website != "", F.array(link)).otherwise(no_link).alias("discoverySources"),
        fact.alias("logistics"), fact.alias("recommendation"), fact.alias("materials"),
        F.struct(F.lit("unknown").alias("mode"), fact.alias("time"), fact.alias("formatLocation")).alias("eventArrangement"),
    )


def catalog_feeds(approved_feeds: DataFrame, legacy: DataFrame) -> DataFrame:
    """All feeds: the approved ones, then archived ones which they do not replace."""
    return approved_feeds.select(*S.FEED_KEYS).unionByName(legacy_feeds(legacy, approved_feeds))


def catalog_rows(approved: DataFrame, approved_feeds: DataFrame, legacy: DataFrame) -> DataFrame:
    """Approved rows of the declared feeds and archived rows of the other feeds."""
    declared = approved_feeds.select(F.col("id").alias("feedId")).distinct()
    live = with_tier(approved.join(declared, "feedId", "left_semi"), legacy).select(*S.OPPORTUNITY_COLUMNS)
    archived = map_legacy(legacy.join(declared, "feedId", "left_anti"))
    return live.unionByName(archived)


# ------------------------------------------------------------------ logos
def logo_dimension(records: DataFrame) -> DataFrame:
    """(pos, name, logo_url) ranking records -> (name, logoUrl) by the leading CJK name, first record wins."""
    named = records.select(text.leading_cjk(F.col("name")).alias("name"), F.col("logo_url").alias("logoUrl"), "pos")
    return first_wins(named.where((F.col("name") != "") & (F.col("logoUrl") != "")), ["name"], "pos").select("name", "logoUrl")


def with_logo(rows: DataFrame, logos: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Add ``logoUrl``: override, else exact name, else the name without its trailing bracket."""
    exact = logos.select(F.col("name").alias("_exact"), F.col("logoUrl").alias("_exactLogo"))
    bare = logos.select(F.col("name").alias("_bare"), F.col("logoUrl").alias("_bareLogo"))
    joined = (
        rows.join(exact, F.col("name") == F.col("_exact"), "left")
        .join(bare, text.without_bracket_suffix(F.col("name")) == F.col("_bare"), "left")
    )
    candidates: Sequence[Column] = [F.col("_exactLogo"), F.col("_bareLogo")]
    if overrides is not None:
        fixed = overrides.select(F.col("name").alias("_fixed"), F.col("logoUrl").alias("_fixedLogo"))
        joined = joined.join(fixed, F.col("name") == F.col("_fixed"), "left").drop("_fixed")
        candidates = [F.col("_fixedLogo"), *candidates]
    return joined.withColumn("logoUrl", F.coalesce(*candidates)).drop("_exact", "_exactLogo", "_bare", "_bareLogo", "_fixedLogo")
