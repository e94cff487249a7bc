"""Data-quality rules as violation rows (snapshotKey, path, rule, message).

All rules of one table are evaluated in one projection; only the broken ones become rows.  A gate passes when there is
no row.  ``opportunities`` have (snapshotKey, pos) and the opportunity columns, ``feeds`` have (snapshotKey, pos) and
the feed columns, ``headers`` have one row for each snapshot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.functions import dates, text, urls
from tidemark.operators.facets import snapshot_counts
from tidemark.operators.positions import carried, repeated
from tidemark.operators.seals import scheme_of

SNAPSHOT_ID_PATTERN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z-[0-9a-f]{12}$"
HASH_PATTERN = "^[0-9a-fA-F]{64}$"
LOWER_HASH_PATTERN = "^[0-9a-f]{64}$"
SHA_PATTERN = "^[0-9a-f]{40}$"

Rule = tuple[str, Column, Column, str]


def rule(name: str, broken: Column, path: Column, message: str) -> Rule:
    return name, broken, path, message


def broken_rules(rules: Sequence[Rule]) -> Column:
    """Array of (path, rule, message) of the broken ones."""
    return F.array_compact(F.array(*[
        F.when(F.coalesce(broken, F.lit(False)),
               F.struct(path.alias("path"), F.lit(name).alias("rule"), F.lit(message).alias("message")))
        for name, broken, path, message in rules
    ]))


def as_violations(rows: DataFrame, found: Column | str, key: str = "snapshotKey") -> DataFrame:
    """The entries of an array of broken rules as rows."""
    return rows.select(key, F.explode(found).alias("v")).select(key, "v.path", "v.rule", "v.message")


def violations(rows: DataFrame, rules: Sequence[Rule], key: str = "snapshotKey") -> DataFrame:
    """Evaluate all rules in one pass over the rows."""
    return as_violations(rows, broken_rules(rules), key)


def _row_path(suffix: str = "") -> Column:
    return text.index_path("snapshot.opportunities", F.col("pos"), suffix)


def _feed_path(suffix: str = "") -> Column:
    return text.index_path("snapshot.feeds", F.col("pos"), suffix)


#: Row columns which are never null: all but the deadline, the optional province and what version 1 has not.
REQUIRED = tuple(name for name in S.OPPORTUNITY_COLUMNS if name not in ("deadline", "deadlineEpochMs", "province", "eventArrangement"))
FEED_REQUIRED = ("label", "admissionCycle", "eventYear")
HEADER_REQUIRED, APPROVAL_REQUIRED = ("scanAt", "defaultFeedId"), ("approvedAt", "snapshotId", "dataHash")


def required_rules(names: Sequence[str], path) -> list[Rule]:
    """A null in a column which has to have a value."""
    return [rule("required", F.col(name).isNull(), path(name), "missing value") for name in names]


def row_rules(as_of: Column) -> list[Rule]:
    """Rules of one opportunity row which need no other table."""
    status, ms, deadline = F.col("verificationStatus"), F.col("deadlineEpochMs"), F.col("deadline")
    parsed = dates.iso_to_ms(deadline)
    both, neither = deadline.isNotNull() & ms.isNotNull(), deadline.isNull() & ms.isNull()
    rules = [
        rule("status-enum", ~status.isin(*S.VERIFICATION_STATUSES), _row_path(".verificationStatus"), "expected an allowed value"),
        rule("deadline-iso", deadline.isNotNull() & parsed.isNull(), _row_path(".deadline"), "expected a valid ISO timestamp or null"),
        rule("website-url", ~urls.is_http_url(F.col("website")), _row_path(".website"), "expected a parseable HTTP(S) URL"),
        rule("website-credentials", urls.has_credentials(F.col("website")), _row_path(".website"), "URL credentials are not allowed"),
        rule("website-denied", urls.is_denied_host(F.col("website"), S.DENIED_OFFICIAL_HOSTS), _row_path(".website"),
             "denied discovery host cannot be the official website"),
        rule("verified-at-iso", F.col("verifiedAt").isNotNull() & ~dates.is_iso_timestamp(F.col("verifiedAt")),
             _row_path(".verifiedAt"), "expected a valid ISO timestamp"),
        rule("official-source",
             ~F.exists(F.coalesce("discoverySources", F.array().cast(S.OPPORTUNITY["discoverySources"].dataType)),
                       lambda source: source["kind"].eqNullSafe("official")),
             _row_path(".discoverySources"), "expected an explicit official discovery source"),
        rule("source-kind",
             F.exists("discoverySources", lambda source: ~F.coalesce(source["kind"].isin(*S.SOURCE_KINDS), F.lit(False))),
             _row_path(".discoverySources"), "expected an allowed value"),
        rule("source-url",
             F.exists("discoverySources", lambda source: ~F.coalesce(urls.is_public_url(source["url"]), F.lit(False))),
             _row_path(".discoverySources"), "expected a parseable HTTP(S) URL"),
        rule("source-label", F.exists("discoverySources", lambda source: source["label"].isNull()), _row_path(".discoverySources"), "missing value"),
        rule("tag-text", F.exists("tags", lambda tag: tag.isNull()), _row_path(".tags"), "expected an array of strings"),
        rule("source-denied",
             F.exists("discoverySources", lambda source: (source["kind"] == "official")
                      & F.coalesce(urls.is_denied_host(source["url"], S.DENIED_OFFICIAL_HOSTS), F.lit(False))),
             _row_path(".discoverySources"), "denied discovery host cannot be an official source"),
        rule("arrangement-mode", F.col("eventArrangement").isNotNull() & ~F.coalesce(F.col("eventArrangement.mode").isin(*S.EVENT_MODES), F.lit(False)), _row_path(".eventArrangement.mode"),
             "expected an allowed value"),
        rule("open-deadline", (status == S.OPEN) & ~both, _row_path(),
             "confirmed-open requires a finite future deadline and deadlineEpochMs"),
        rule("deadline-epoch", status.isin(S.OPEN, S.EXPIRED) & both & (parsed != ms), _row_path(".deadlineEpochMs"),
             "must match the normalized deadline timestamp"),
        rule("open-future", (status == S.OPEN) & both & parsed.isNotNull() & (ms <= as_of), _row_path(),
             "confirmed-open deadline must be in the future"),
        rule("unknown-deadline", (status == S.UNKNOWN_DEADLINE) & ~neither, _row_path(),
             "confirmed-unknown-deadline requires null deadline fields"),
        rule("expired-deadline", (status == S.EXPIRED) & ~both & ~neither, _row_path(),
             "expired deadline fields must both be null or normalized"),
        rule("expired-past", (status == S.EXPIRED) & both & parsed.isNotNull() & (ms > as_of), _row_path(),
             "expired rows cannot carry a future active deadline"),
        rule("key-parts", ~text.has_four_parts(F.col("projectId")), _row_path(".projectId"), "expected four non-empty parts"),
        rule("key-cycle", text.has_four_parts(F.col("projectId")) & ~text.first_part(F.col("projectId")).rlike(text.CYCLE_PATTERN),
             _row_path(".projectId"), "leading cycle must be exactly four digits"),
    ]
    facts = ("logistics", "recommendation", "materials", "eventArrangement.time", "eventArrangement.formatLocation")
    rules += [
        rule("fact-status", F.col(name.split(".")[0]).isNotNull() & ~F.coalesce(F.col(f"{name}.status").isin(*S.FACT_STATUSES), F.lit(False)),
             _row_path(f".{name}.status"), "expected an allowed value")
        for name in facts
    ]
    return rules + required_rules(REQUIRED, lambda name: _row_path(f".{name}"))


def header_columns(headers: DataFrame) -> DataFrame:
    """Parsed header clocks and the seal scheme, joined to rows by snapshotKey; small next to the rows, broadcast when its size allows."""
    return headers.select(
        "snapshotKey", scheme_of(headers).alias("_scheme"), F.col("schemaVersion").alias("_version"), dates.iso_to_ms(F.col("scanAt")).alias("_scanMs"),
        dates.iso_to_ms(F.col("approvedAt")).alias("_approvedMs"))


def opportunity_violations(opportunities: DataFrame, headers: DataFrame, feeds: DataFrame,
                           as_of: Column | None = None) -> DataFrame:
    """Row rules, feed membership and chronology of all snapshots at once, see ``judged_opportunities``."""
    return as_violations(judged_opportunities(opportunities, headers, feeds, as_of), "found")


def feed_cycles(feeds: DataFrame) -> DataFrame:
    """(snapshotKey, feedId, _cycle, _known) of each feed."""
    return feeds.select("snapshotKey", F.col("id").alias("feedId"), F.col("admissionCycle").alias("_cycle")).groupBy(
        "snapshotKey", "feedId").agg(F.max("_cycle").alias("_cycle"), F.lit(True).alias("_known"))


def judged_opportunities(opportunities: DataFrame, headers: DataFrame, feeds: DataFrame,
                         as_of: Column | None = None) -> DataFrame:
    """The rows with ``found``, the rules each of them breaks.

    Without ``as_of`` a stored snapshot is judged at its own approval time, a candidate at its scan time.
    """
    rows = opportunities.join(header_columns(headers), "snapshotKey", "left").join(feed_cycles(feeds), ["snapshotKey", "feedId"], "left")
    return rows.withColumn("found", broken_rules(opportunity_rules(as_of)))


def document_context(headers: DataFrame, feeds: DataFrame) -> DataFrame:
    """One row for each document with all its opportunities are judged by: clocks, scheme and a map of its feeds, which its size bounds."""
    feed = F.struct("feedId", "_cycle")
    maps = feed_cycles(feeds).where(F.col("feedId").isNotNull()).groupBy("snapshotKey").agg(F.map_from_entries(F.collect_list(feed)).alias("_feeds"))
    return header_columns(headers).join(maps, "snapshotKey", "left")


def known_feed(feed: Column, feeds: Column) -> list[Column]:
    """The columns of ``feed_cycles`` for a feed id and the map of ``document_context``."""
    known = F.coalesce(F.map_contains_key(feeds, F.coalesce(feed, F.lit(""))), F.lit(False))
    return [F.when(known, F.try_element_at(feeds, feed)).alias("_cycle"), F.when(known, F.lit(True)).alias("_known")]


def opportunity_rules(as_of: Column | None = None) -> list[Rule]:
    """All rules of a row beside its header's clocks and its feed's cycle."""
    moment = F.coalesce("_approvedMs", "_scanMs") if as_of is None else as_of
    verified = dates.iso_to_ms(F.col("verifiedAt"))
    return row_rules(moment) + [
        rule("feed-known", F.col("feedId").isNotNull() & F.col("_known").isNull(), _row_path(".feedId"), "expected a known feed ID"),
        rule("key-feed-cycle", text.has_four_parts(F.col("projectId"))
             & (text.first_part(F.col("projectId")) != F.col("_cycle")),
             _row_path(".projectId"), "leading segment must match feed admissionCycle"),
        rule("required", (F.col("_version") == 2) & F.col("eventArrangement").isNull(), _row_path(".eventArrangement"), "missing value"),
        rule("verified-scan", verified > F.col("_scanMs"), _row_path(".verifiedAt"), "must not be after snapshot.scanAt"),
        rule("verified-approval", verified > F.col("_approvedMs"), _row_path(".verifiedAt"), "must not be after snapshot.approvedAt"),
    ]


def feed_violations(feeds: DataFrame) -> DataFrame:
    rules = [
        rule("feed-id", F.coalesce(F.col("id"), F.lit("")) == "", _feed_path(".id"), "expected a non-empty string"),
        rule("feed-cycle", ~F.col("admissionCycle").rlike(text.CYCLE_PATTERN), _feed_path(".admissionCycle"), "expected exactly four digits"),
        *required_rules(FEED_REQUIRED, lambda name: _feed_path(f".{name}")),
    ]
    again = repeated(feeds, ["snapshotKey", "id"], "pos").select(
        "snapshotKey", _feed_path(".id").alias("path"), F.lit("feed-unique").alias("rule"),
        F.lit("duplicate feed ID").alias("message"))
    return violations(feeds, rules).unionAll(again)


def duplicate_violations(opportunities: DataFrame) -> DataFrame:
    return repeated(opportunities.select("snapshotKey", "projectId", "pos"), ["snapshotKey", "projectId"], "pos").select(
        "snapshotKey", _row_path(".projectId").alias("path"), F.lit("key-unique").alias("rule"),
        F.lit("duplicate projectId").alias("message"))


def order_violations(opportunities: DataFrame) -> DataFrame:
    """The stored order: expired rows last, unknown deadlines after timed ones, timed ones ascending.

    A deadline is compared with the last open deadline before it, not with the greatest one.
    """
    status, ms = F.col("verificationStatus"), F.col("deadlineEpochMs")
    slim = opportunities.select("snapshotKey", "pos", "verificationStatus", "deadlineEpochMs")
    rows = carried(slim, ["snapshotKey"], "pos", {
        "sawExpired": ("any", status == S.EXPIRED),
        "sawUnknown": ("any", status == S.UNKNOWN_DEADLINE),
        "lastOpen": ("last", F.when(status == S.OPEN, ms)),
    })
    return violations(rows, [
        rule("order-expired", status.isin(S.OPEN, S.UNKNOWN_DEADLINE) & F.col("sawExpired"), _row_path(),
             "expired rows must appear after active rows"),
        rule("order-unknown", (status == S.OPEN) & F.col("sawUnknown"), _row_path(),
             "unknown-deadline active rows must appear after timed active rows"),
        rule("order-deadline", (status == S.OPEN) & (ms < F.col("lastOpen")), _row_path(),
             "active rows must be ascending by deadline epoch"),
    ])


def count_violations(headers: DataFrame, opportunities: DataFrame) -> DataFrame:
    """Stated counts against the actual ones."""
    actual = snapshot_counts(opportunities, ["snapshotKey"]).select(
        "snapshotKey", *[F.col(name).alias(f"_{name}") for name in ("confirmedOpen", "confirmedUnknownDeadline", "expired")])
    rows = headers.join(actual, "snapshotKey", "left")
    rules = []
    for name in S.COUNT_KEYS:
        stated, path = F.col(f"counts.{name}"), F.lit(f"snapshot.counts.{name}")
        rules.append(rule("count-integer", stated.isNull() | (stated < 0), path, "expected a nonnegative integer"))
        if name != "pendingExcluded":
            found = F.coalesce(F.col(f"_{name}"), F.lit(0))
            rules.append(rule("count-match", ~stated.eqNullSafe(found), path, "must match opportunity rows"))
    return violations(rows, rules)


def header_violations(headers: DataFrame, feeds: DataFrame, approved: bool) -> DataFrame:
    """Header rules of candidates or approved snapshots."""
    known = feeds.select("snapshotKey", F.col("id").alias("defaultFeedId")).distinct().withColumn("_known", F.lit(True))
    rows = headers.join(known, ["snapshotKey", "defaultFeedId"], "left")
    scan = dates.iso_to_ms(F.col("scanAt"))
    version = F.col("schemaVersion")
    rules = [
        rule("schema-version", ~F.coalesce(version.isin(1, 2) if approved else version == 2, F.lit(False)),
             F.lit("snapshot.schemaVersion"), "expected exactly 1 or 2" if approved else "expected exactly 2"),
        rule("scan-iso", F.col("scanAt").isNotNull() & scan.isNull(), F.lit("snapshot.scanAt"), "expected a valid ISO timestamp"),
        rule("default-feed", F.col("defaultFeedId").isNotNull() & F.col("_known").isNull(),
             F.lit("snapshot.defaultFeedId"), "expected a known feed ID"),
        *required_rules(HEADER_REQUIRED + (APPROVAL_REQUIRED if approved else ()), lambda name: F.lit(f"snapshot.{name}")),
    ]
    if approved:
        approval = dates.iso_to_ms(F.col("approvedAt"))
        rules += [
            rule("approval-iso", F.col("approvedAt").isNotNull() & approval.isNull(), F.lit("snapshot.approvedAt"), "expected a valid ISO timestamp"),
            rule("approval-after-scan", approval < scan, F.lit("snapshot.approvedAt"), "must not be before snapshot.scanAt"),
            rule("snapshot-id", F.col("snapshotId") == "", F.lit("snapshot.snapshotId"), "expected a non-empty string"),
            rule("hash-format", ~F.col("dataHash").rlike(HASH_PATTERN), F.lit("snapshot.dataHash"), "expected exactly 64 hexadecimal characters"),
            rule("previous-format", F.col("previousSnapshotId").isNotNull() & ~is_snapshot_id(F.col("previousSnapshotId")), F.lit("snapshot.previousSnapshotId"),
                 "expected the repository snapshot ID format"),
        ]
    return violations(rows, rules)


def is_snapshot_id(value: Column) -> Column:
    return value.rlike(SNAPSHOT_ID_PATTERN) & dates.is_iso_timestamp(F.substring(value, 1, 24))


def seal_violations(headers: DataFrame, hashes: DataFrame) -> DataFrame:
    """The stored hash and id against the recomputed hash (snapshotKey, computedHash)."""
    rows = headers.join(hashes, "snapshotKey")
    approval = dates.iso_to_ms(F.col("approvedAt"))
    return violations(rows, [
        rule("hash-match", ~F.col("dataHash").eqNullSafe(F.col("computedHash")), F.lit("snapshot.dataHash"),
             "must equal the lowercase canonical SHA-256 hash"),
        rule("id-derived", approval.isNotNull()
             & ~F.col("snapshotId").eqNullSafe(dates.snapshot_id(approval, F.col("computedHash"))),
             F.lit("snapshot.snapshotId"), "must be derived from approvedAt and the canonical hash"),
    ])


def snapshot_violations(headers: DataFrame, feeds: DataFrame, opportunities: DataFrame, approved: bool,
                        as_of: Column | None = None) -> DataFrame:
    """All typed rules; shape and private-value rules of raw documents are in ``operators.documents``."""
    return (
        header_violations(headers, feeds, approved)
        .unionAll(feed_violations(feeds))
        .unionAll(opportunity_violations(opportunities, headers, feeds, as_of))
        .unionAll(duplicate_violations(opportunities))
        .unionAll(count_violations(headers, opportunities))
        .unionAll(order_violations(opportunities))
    )


# ------------------------------------------------------------------ freshness and releases
def freshness_errors(as_of_ms: Column, max_age_ms: int) -> Column:
    """Array of messages for a row with ``scanAt`` and ``approvedAt``; exactly the maximum age still passes."""
    scan, approval = dates.iso_to_ms(F.col("scanAt")), dates.iso_to_ms(F.col("approvedAt"))
    parsed = scan.isNotNull() & approval.isNotNull()
    tests = [
        (scan.isNull(), "scanAt: expected a valid ISO timestamp"),
        (approval.isNull(), "approvedAt: expected a valid ISO timestamp"),
        (parsed & (scan > as_of_ms), "scanAt: must not be in the future"),
        (parsed & (approval > as_of_ms), "approvedAt: must not be in the future"),
        (parsed & (approval < scan), "approvedAt: must not be before scanAt"),
        (parsed & (as_of_ms - scan > max_age_ms), "scanAt: is older than the maximum age"),
        (parsed & (as_of_ms - approval > max_age_ms), "approvedAt: is older than the maximum age"),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), message) for test, message in tests]))


def freshness(headers: DataFrame, as_of_ms: Column, warn_age_ms: int, max_age_ms: int) -> DataFrame:
    """Ages and the two severities for every snapshot."""
    return headers.select(
        "snapshotId",
        (as_of_ms - dates.iso_to_ms(F.col("scanAt"))).alias("scanAgeMs"),
        (as_of_ms - dates.iso_to_ms(F.col("approvedAt"))).alias("approvalAgeMs"),
        (F.size(freshness_errors(as_of_ms, warn_age_ms)) > 0).alias("warn"),
        (F.size(freshness_errors(as_of_ms, max_age_ms)) > 0).alias("fail"),
        F.array_join(freshness_errors(as_of_ms, max_age_ms), "; ").alias("errors"),
    )


def release_rules(record: str | None = None) -> list[Rule]:
    """Rules of a release record (releaseSha, snapshotId, dataHash).

    ``record`` names the column with the record's JSON text, whose keys then have to be exactly the contract's; without one the record is a
    row of a table, which has no other keys.
    """
    exact = [] if record is None else [
        rule("release-keys", ~F.coalesce(F.array_sort(F.json_object_keys(record)) == text.literal_array(S.RELEASE_KEYS), F.lit(False)), F.lit("release"),
             "must have exactly the keys " + ", ".join(S.RELEASE_KEYS))]
    return exact + [
        rule("release-sha", ~F.coalesce(F.col("releaseSha").rlike(SHA_PATTERN), F.lit(False)), F.lit("releaseSha"), "has an invalid format"),
        rule("release-id", ~F.coalesce(is_snapshot_id(F.col("snapshotId")), F.lit(False)), F.lit("snapshotId"), "has an invalid format"),
        rule("release-hash", ~F.coalesce(F.col("dataHash").rlike(LOWER_HASH_PATTERN), F.lit(False)), F.lit("dataHash"), "has an invalid format"),
    ]


def release_identity(releases: DataFrame, headers: DataFrame, expected_sha: str | None = None) -> DataFrame:
    """(releaseKey, severity, message): a release must name a known snapshot with the same hash; a differing source
    revision is only a warning."""
    sealed = headers.select("snapshotId", F.col("dataHash").alias("_hash"))
    joined = releases.join(sealed, "snapshotId", "left")
    found = F.array_compact(F.array(
        F.when(F.col("_hash").isNull(), F.struct(F.lit("error").alias("severity"), F.lit("snapshotId does not match the current snapshot").alias("message"))),
        F.when(F.col("dataHash") != F.col("_hash"), F.struct(F.lit("error").alias("severity"), F.lit("dataHash does not match the current snapshot").alias("message"))),
        F.when(F.lit(expected_sha is not None) & (F.col("releaseSha") != F.lit(expected_sha)),
               F.struct(F.lit("warning").alias("severity"), F.lit("release parity needs review").alias("message"))),
    ))
    return joined.select("releaseKey", F.explode(found).alias("v")).select("releaseKey", "v.severity", "v.message")


def disallowed_datasets(changed: DataFrame, allowed: Sequence[str] = S.PUBLICATION_DATASETS) -> DataFrame:
    """Changed dataset names (``name``) which a data publication may not contain."""
    return changed.select("name").distinct().where(~F.col("name").isin(*allowed))


def lineage_orphans(headers: DataFrame) -> DataFrame:
    """Snapshots whose predecessor is not stored."""
    ids = headers.select(F.col("snapshotId").alias("previousSnapshotId"))
    return headers.where(F.col("previousSnapshotId").isNotNull()).join(ids, "previousSnapshotId", "left_anti")
