"""Diff, hash, rule, release, import and identity queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark import bench_views as B
from tidemark import schema as S
from tidemark.functions import canonical, dates, text
from tidemark.functions.facts import with_fact_groups
from tidemark.functions.urls import normalise_url
from tidemark.operators import diff as diffs
from tidemark.operators import digest, documents, identity, quality, seals
from tidemark.operators.positions import repeated
from tidemark.plans import importing, publishing
from tidemark.session import ensure_checkpoint_dir, materialise, spread
from tidemark.sources.scouting import ScoutingBatch
from tidemark.sources.snapshots import read_snapshots
from tidemark.sources.store import SnapshotStore, write_diff


# ------------------------------------------------------------------ comparison
def snapshot_diff(spark, sf_dir):
    return diffs.diff(*B.board_pair(spark, sf_dir)).select(
        F.col("projectId").alias("project_id"), F.col("changeType").alias("change_type"))


def _new_folder(spark, what):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def diff_files(spark, sf_dir):
    """The diff written as files by change type and read back."""
    folder = _new_folder(spark, "diff")
    write_diff(diffs.diff(*B.board_pair(spark, sf_dir)), folder)
    return spark.read.schema("projectId string, changeType string").json(folder).select(
        F.col("projectId").alias("project_id"), F.col("changeType").alias("change_type"))


def snapshot_files(spark, sf_dir):
    """Documents written as one JSON file each, read strictly and turned into typed tables: what each file holds."""
    folder = _new_folder(spark, "documents")
    texts = B.board_documents(spark, sf_dir).select("snapshotKey", F.to_json("doc").alias("value"))
    # a document is one row, so its file is written where it is made; files are compressed, each on its own
    texts.write.partitionBy("snapshotKey").text(folder, compression="gzip")
    tables = read_snapshots(spark, f"{folder}/*/*.txt.gz")
    rows = tables.opportunities.groupBy("snapshotKey").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("name").alias("n_names"), F.count("website").alias("n_websites"), F.sum(F.size("tags")).alias("n_tags"))
    feeds = tables.feeds.groupBy("snapshotKey").agg(F.count(F.lit(1)).alias("n_feeds"), F.count("eventYear").alias("n_years"))
    return tables.headers.join(rows, "snapshotKey").join(feeds, "snapshotKey").select(
        F.regexp_extract("snapshotKey", "snapshotKey=([^/]+)", 1).alias("snapshot_key"), F.col("scanAt").alias("scan_at"), F.col("counts.expired").alias("n_expired"),
        "n_rows", "n_names", "n_websites", "n_tags", "n_feeds", "n_years")


def diff_counts(spark, sf_dir):
    return diffs.diff_counts(diffs.diff(*B.board_pair(spark, sf_dir)))


def removed_ids(spark, sf_dir):
    previous, following = B.board_pair(spark, sf_dir)
    return diffs.ids_only_in(previous, following).select(F.col("projectId").alias("project_id"))


def identity_sets(spark, sf_dir):
    return diffs.identity_sets_equal(*B.board_pair(spark, sf_dir))


def review_queue(spark, sf_dir):
    previous, following = B.board_pair(spark, sf_dir)
    pending = B.board(spark, sf_dir).where(F.col("verificationStatus") == S.UNKNOWN_DEADLINE)
    return diffs.review_queue(previous, following, B.AS_OF_MS, pending).select(
        F.col("projectId").alias("project_id"), "reason", F.col("deadlineEpochMs").alias("deadline_ms"))


# ------------------------------------------------------------------ hashes
def row_fingerprint(spark, sf_dir):
    return B.board(spark, sf_dir).select(
        F.col("projectId").alias("project_id"), canonical.publication_fingerprint(S.OPPORTUNITY).alias("fingerprint"))


def canonical_rows(spark, sf_dir):
    return B.board(spark, sf_dir).select(
        F.col("projectId").alias("project_id"), canonical.canonical_json(S.OPPORTUNITY).alias("json"))


def table_digest(spark, sf_dir):
    """Digest of the whole rows of each feed."""
    rows = B.board(spark, sf_dir).select("feedId", canonical.canonical_json(S.OPPORTUNITY).alias("json"))
    return digest.content_digest(rows, by=["feedId"]).select(
        F.col("feedId").alias("feed_id"), "digest", "n_rows")


def copy_digest(spark, sf_dir):
    """Digest of a table with heavy repetition: all values of one line status are few."""
    rows = B.table(spark, sf_dir, "lineitem").select(F.concat_ws("|", "l_returnflag", "l_linestatus").alias("json"))
    return digest.content_digest(rows)


def snapshot_hashes(spark, sf_dir):
    tables = B.monthly_tables(spark, sf_dir)
    hashes = digest.canonical_hashes(tables.headers, tables.feeds, tables.opportunities)
    approval = dates.iso_to_ms(F.col("approvedAt"))
    return tables.headers.join(hashes, "snapshotKey").select(
        F.col("snapshotKey").alias("snapshot_key"), F.col("computedHash").alias("data_hash"),
        dates.snapshot_id(approval, F.col("computedHash")).alias("snapshot_id"))


def snapshot_seals(spark, sf_dir):
    """Seals of any size: number of rows and multiset digest of every month."""
    tables = B.monthly_tables(spark, sf_dir)
    return seals.multiset_seals(tables.headers, tables.feeds, tables.opportunities).select(
        F.col("snapshotKey").alias("snapshot_key"), F.col("rowCount").alias("n_rows"), F.col("rowState").alias("row_state"), F.col("computedHash").alias("seal"))


def seal_after_changes(spark, sf_dir):
    """The state of the following board from the state of the previous one and the rows that differ, never from the whole."""
    previous, following = [frame.withColumn("snapshotKey", F.col("feedId")) for frame in B.board_pair(spark, sf_dir)]
    moved = materialise(diffs.diff(previous, following).select("projectId"))
    # the boards differ in verifiedAt everywhere, so it is no part of what is sealed here
    plain = lambda frame: frame.withColumn("verifiedAt", F.lit(""))
    before = seals.states(seals.row_digests(plain(previous)))
    removed, added = [seals.row_digests(plain(frame).join(moved, "projectId", "left_semi")) for frame in (previous, following)]
    return seals.after_changes(before, added, removed).select(F.col("snapshotKey").alias("feed_id"), F.col("n").alias("n_rows"), "state")


# ------------------------------------------------------------------ rules
def _named(violations):
    return violations.select(F.col("snapshotKey").alias("snapshot_key"), "path", "rule", "message")


def row_violations(spark, sf_dir):
    tables = B.monthly_tables(spark, sf_dir)
    return _named(quality.opportunity_violations(tables.opportunities, tables.headers, tables.feeds)).drop("message")


def feed_violations(spark, sf_dir):
    return _named(quality.feed_violations(B.monthly_tables(spark, sf_dir).feeds))


def header_violations(spark, sf_dir):
    tables = B.monthly_tables(spark, sf_dir)
    return _named(quality.header_violations(tables.headers, tables.feeds, approved=True)).drop("message")


def count_violations(spark, sf_dir):
    tables = B.monthly_tables(spark, sf_dir)
    return _named(quality.count_violations(tables.headers, tables.opportunities)).drop("message")


def order_violations(spark, sf_dir):
    return _named(quality.order_violations(B.monthly_tables(spark, sf_dir).opportunities)).drop("message")


def duplicate_ids(spark, sf_dir):
    return _named(quality.duplicate_violations(B.monthly_tables(spark, sf_dir).opportunities)).drop("message")


def stored_snapshot_gate(spark, sf_dir):
    """Violations by snapshot and rule of the whole gate, hash rules included."""
    found = publishing.stored_violations(B.monthly_tables(spark, sf_dir))
    return found.groupBy(F.col("snapshotKey").alias("snapshot_key"), "rule").agg(F.count("*").alias("n"))


def approved_snapshot(spark, sf_dir):
    """A candidate of the whole board is validated, sealed, published into a new store and read back."""
    store = SnapshotStore(spark, _new_folder(spark, "store"))
    published = store.read(publishing.approve(store, B.clean_candidate(spark, sf_dir), B.APPROVED_AT))
    counts = published.opportunities.groupBy("snapshotKey").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("pos").alias("last_pos"), F.max_by("projectId", "pos").alias("last_id"), F.min_by("projectId", "pos").alias("first_id"))
    return published.headers.join(counts, "snapshotKey").select(
        F.col("snapshotId").alias("snapshot_id"), F.col("dataHash").alias("data_hash"), F.col("previousSnapshotId").alias("previous_id"), "n_rows", "last_pos", "first_id", "last_id",
        F.col("counts.confirmedOpen").alias("n_open"), F.col("counts.confirmedUnknownDeadline").alias("n_unknown"), F.col("counts.expired").alias("n_expired"))


def document_gate(spark, sf_dir):
    """Every violation of raw candidate documents: shape, types, values, order, counts and private texts."""
    found = publishing.document_violations(B.board_documents(spark, sf_dir), approved=False, as_of=F.lit(B.AS_OF_MS).cast("bigint"))
    return _named(found).drop("message")


def freshness(spark, sf_dir):
    headers = B.monthly_tables(spark, sf_dir).headers
    return quality.freshness(headers, F.lit(B.AS_OF_MS).cast("bigint"), 30 * S.MS_PER_DAY, 365 * S.MS_PER_DAY).select(
        F.col("snapshotId").alias("snapshot_id"), F.col("scanAgeMs").alias("scan_age_ms"),
        F.col("approvalAgeMs").alias("approval_age_ms"), "warn", "fail", "errors")


def release_violations(spark, sf_dir):
    found = quality.violations(B.releases(spark, sf_dir), quality.release_rules(), "releaseKey")
    return found.select(F.col("releaseKey").alias("release_key"), "path", "message")


def release_identity(spark, sf_dir):
    headers = B.monthly_tables(spark, sf_dir).headers
    return quality.release_identity(B.releases(spark, sf_dir), headers, "0" * 40).select(
        F.col("releaseKey").alias("release_key"), "severity", "message")


def lineage_orphans(spark, sf_dir):
    return quality.lineage_orphans(B.monthly_tables(spark, sf_dir).headers).select(
        F.col("snapshotId").alias("snapshot_id"), F.col("previousSnapshotId").alias("previous_id"))


def publication_plan(spark, sf_dir):
    """Each month against the month before; every fourth month is compared with itself."""
    headers = B.monthly_tables(spark, sf_dir).headers
    number = F.substring("snapshotKey", 6, 2).cast("int")
    later = F.date_format(F.add_months(F.to_date(F.concat("snapshotKey", F.lit("-01"))), 1), "yyyy-MM")
    base = headers.withColumn("pairKey", F.when(number % 4 == 0, F.col("snapshotKey")).otherwise(later))
    plan = publishing.publication_plan(base, headers.withColumn("pairKey", F.col("snapshotKey")), B.AS_OF_MS)
    return plan.select(F.col("pairKey").alias("pair_key"), "status", F.col("snapshotId").alias("snapshot_id"),
                       F.col("previousSnapshotId").alias("previous_id"), F.col("scanDate").alias("scan_date"),
                       F.col("planStamp").alias("plan_stamp"))


def disallowed_datasets(spark, sf_dir):
    source = B.table(spark, sf_dir, "documents").select(F.col("source").alias("name"))
    return quality.disallowed_datasets(source, ("src0", "src1"))


# ------------------------------------------------------------------ import
def iso_checks(spark, sf_dir):
    key = F.col("o_orderkey")
    two = lambda value: F.lpad(value.cast("string"), 2, "0")
    spelled = F.concat(
        (F.lit(1900) + key % 200).cast("string"), F.lit("-"), two(key % 14), F.lit("-"), two(key % 33), F.when(key % 19 == 0, " ").otherwise("T"),
        two(key % 26), F.lit(":"), two(key % 62), F.lit(":"), two(key % 61),
        F.when(key % 3 == 0, ".5").when(key % 3 == 1, ".123").otherwise(""),
        F.when(key % 4 == 0, "Z").when(key % 4 == 1, "+08:00").when(key % 4 == 2, "-23:59").otherwise("+24:00"))
    rows = B.table(spark, sf_dir, "orders").select(key.alias("id"), spelled.alias("spelled"))
    return rows.select("id", dates.is_iso_timestamp(F.col("spelled")).alias("valid"), dates.iso_to_ms(F.col("spelled")).alias("ms"))


def deadline_normalised(spark, sf_dir):
    parsed = importing.parse_rows(B.scouting_rows(spark, sf_dir))
    return parsed.select(F.col("pos").alias("id"), F.col("due").alias("deadline"), F.col("dueOriginal").alias("original"),
                         F.col("dueMs").alias("ms"), F.col("dueValid").alias("valid"))


def key_parts(spark, sf_dir):
    rows = B.board(spark, sf_dir)
    key = F.col("projectId")
    odd = F.when(F.col("name") == "NATION_3", F.concat(F.lit(" "), key, F.lit(" "))).when(F.col("name") == "NATION_4", F.concat(key, F.lit("|")))
    spelled = F.coalesce(odd.when(F.col("name") == "NATION_5", F.regexp_replace(key, r"^\d", "x")), key)
    return rows.select(
        key.alias("project_id"), text.key_is_valid(spelled).alias("valid"), text.key_cycle(spelled).alias("cycle"),
        text.key_institute(spelled).alias("institute"))


def cycle_texts(spark, sf_dir):
    rows = B.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    year = F.year("o_orderdate").cast("string")
    spelled = (F.when(key % 6 == 0, F.concat(year, F.lit(" camp "), year)).when(key % 6 == 1, F.concat(year, F.lit("/2050")))
               .when(key % 6 == 2, F.concat(F.lit("9"), year)).when(key % 6 == 3, "  ").when(key % 6 == 4, "camp"))
    return rows.select(key.alias("id"), text.cycle_of(spelled, year, F.col("o_orderstatus") == "F").alias("cycle"))


def fact_groups(spark, sf_dir):
    parsed = importing.parse_rows(B.scouting_rows(spark, sf_dir))
    return with_fact_groups(parsed, importing.FACT_FIELDS).select(
        F.col("pos").alias("id"), F.col("recommendationLetters").alias("letters"),
        F.col("logistics.status").alias("logistics_status"), F.col("logistics.summary").alias("logistics_summary"),
        F.col("recommendation.status").alias("letters_status"), F.col("recommendation.summary").alias("letters_summary"))


def _identity_inputs(spark, sf_dir):
    parsed = materialise(importing.parse_rows(B.scouting_rows(spark, sf_dir)).select("urlNorm", "inputId"))
    known = B.previous_ids(spark, sf_dir).select("projectId", normalise_url(F.col("website")).alias("urlNorm"))
    names = identity.parse_aliases(B.alias_entries(spark, sf_dir))
    return parsed, known, names


def identity_resolution(spark, sf_dir):
    parsed, known, names = _identity_inputs(spark, sf_dir)
    good = names.where(F.col("problem").isNull())
    return identity.resolve(parsed, identity.url_ids(parsed, known, good), good).select(
        F.col("inputId").alias("input_id"), F.col("resolvedId").alias("resolved_id"), F.col("identityError").alias("error"))


def alias_coverage(spark, sf_dir):
    parsed, known, names = _identity_inputs(spark, sf_dir)
    ids = identity.url_ids(parsed, known, names.where(F.col("problem").isNull()))
    return identity.coverage_violations(ids).select(
        F.col("missingId").alias("missing_id"), F.col("hits").cast("bigint").alias("hits"))


def alias_violations(spark, sf_dir):
    _, known, names = _identity_inputs(spark, sf_dir)
    return identity.alias_violations(names, known).groupBy("message").agg(F.count("*").alias("n"))


def _batch(spark, sf_dir):
    rows = B.scouting_rows(spark, sf_dir)
    return ScoutingBatch(B.SCAN_AT, rows, spark.createDataFrame([], "path string, rule string, message string"))


def import_candidate(spark, sf_dir):
    candidate = importing.import_batch(_batch(spark, sf_dir))
    return candidate.tables.opportunities.select(
        "pos", F.col("projectId").alias("project_id"), F.col("feedId").alias("feed_id"), "name", "institute",
        F.col("eventType").alias("event_type"), F.col("verificationStatus").alias("status"), "deadline",
        F.col("deadlineEpochMs").alias("deadline_ms"), F.col("verifiedAt").alias("verified_at"),
        F.size("discoverySources").cast("bigint").alias("n_sources"), F.col("eventArrangement.mode").alias("mode"),
        F.col("logistics.status").alias("logistics_status"))


def import_header(spark, sf_dir):
    candidate = importing.import_batch(_batch(spark, sf_dir))
    return candidate.tables.headers.select(
        F.col("defaultFeedId").alias("default_feed"), F.col("counts.confirmedOpen").alias("confirmed_open"),
        F.col("counts.confirmedUnknownDeadline").alias("confirmed_unknown_deadline"),
        F.col("counts.pendingExcluded").alias("pending_excluded"), F.col("counts.expired").alias("expired"))


def import_feeds(spark, sf_dir):
    return importing.import_batch(_batch(spark, sf_dir)).tables.feeds.select(
        "pos", "id", "label", F.col("admissionCycle").alias("admission_cycle"), F.col("eventYear").alias("event_year"))


def import_row_violations(spark, sf_dir):
    return importing.row_violations(importing.parse_rows(B.scouting_rows(spark, sf_dir))).select("path", "rule")


def import_gate(spark, sf_dir):
    """Number of violations of each rule of the whole import with previous snapshot and aliases."""
    candidate = importing.import_batch(_batch(spark, sf_dir), B.previous_ids(spark, sf_dir), B.alias_entries(spark, sf_dir))
    return candidate.violations.groupBy("rule").agg(F.count("*").alias("n"))


def repeated_documents(spark, sf_dir):
    """Later copies of a text with the same words."""
    docs = spread(B.table(spark, sf_dir, "documents").select("doc_id", "text"))
    # The hashes are read twice and the texts are long, so the narrow table is written once.
    rows = materialise(docs.select("doc_id", F.sha2(text.collapse_spaces(F.col("text")), 256).alias("h")))
    return repeated(rows, ["h"], "doc_id").select("doc_id", "h")


def private_rows(spark, sf_dir):
    key = F.substring_index("projectId", "|o", -1).cast("bigint")
    rows = B.board(spark, sf_dir).withColumns({
        "snapshotKey": F.lit("s"), "pos": key,
        "description": F.when(key % 101 == 0, "write to ａ＠b.example").when(key % 103 == 0, "call %2B86 138-1234-5678")
        .when(key % 107 == 0, "see file%253A///x").otherwise(F.col("description")),
        "tags": F.when(key % 109 == 0, F.array(F.lit("/home/me/x"))).otherwise(F.col("tags")),
    })
    return documents.private_row_values(rows).select("path", "message")


QUERIES = {
    f.__name__: f for f in (
        snapshot_diff, diff_files, snapshot_files, diff_counts, removed_ids, identity_sets, review_queue, row_fingerprint, canonical_rows,
        table_digest, copy_digest, snapshot_hashes, snapshot_seals, seal_after_changes, row_violations, feed_violations, header_violations,
        count_violations, order_violations, duplicate_ids, stored_snapshot_gate, document_gate, approved_snapshot, freshness, release_violations,
        release_identity, lineage_orphans, publication_plan, disallowed_datasets, iso_checks, deadline_normalised,
        key_parts, cycle_texts, fact_groups, identity_resolution, alias_coverage, alias_violations, import_candidate,
        import_header, import_feeds, import_row_violations, import_gate, repeated_documents, private_rows,
    )
}
