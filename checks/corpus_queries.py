"""Text, URL, JSON, privacy, catalog and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark import bench_views as B
from tidemark import schema as S
from tidemark.functions import facts, privacy, text, urls
from tidemark.operators import board as ops
from tidemark.operators import catalog, documents, facets, leaks, positions
from tidemark.plans import privacy_gate
from tidemark.session import ensure_checkpoint_dir, spread
from tidemark.streaming import timers


def _documents(spark, sf_dir):
    return spread(B.table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


# ------------------------------------------------------------------ addresses
def url_normalize(spark, sf_dir):
    """Page addresses in shouting spelling with ports and extra slashes."""
    pages = B.table(spark, sf_dir, "pages")
    key, url = F.col("page_id"), F.col("url")
    loud = F.concat(F.upper(F.regexp_extract(url, "^(https?://[^/]*)", 1)), F.when(key % 3 == 0, F.when(url.startswith("https"), ":443").otherwise(":80"))
                    .when(key % 3 == 1, ".").otherwise(":8080"), F.regexp_extract(url, "^https?://[^/]*(.*)$", 1))
    odd = F.when(key % 11 == 0, F.regexp_replace(url, "^https?", "ftp")).when(key % 13 == 0, F.regexp_replace(url, "://", "://me:pw@")).otherwise(loud)
    return pages.select("page_id", urls.normalise_url(odd).alias("url_norm"))


def url_identity(spark, sf_dir):
    pages = B.table(spark, sf_dir, "pages")
    return pages.select(urls.normalise_url(F.col("url")).alias("url_norm"), "page_id").groupBy("url_norm").agg(
        F.count("*").alias("n_rows"), F.count_distinct("page_id").alias("n_ids"), F.min("page_id").alias("first_id"))


def denied_hosts(spark, sf_dir):
    """Pages at or below denied hosts, by an equi-join on the exploded domain suffixes."""
    denied = spark.createDataFrame([("example.org",), ("cheap-pills.example.com",), ("ample.net",)], "denied string")
    hosts = B.table(spark, sf_dir, "pages").select("page_id", F.explode(urls.host_suffixes(urls.host_of(F.col("url")))).alias("denied"))
    return hosts.join(denied, "denied").select("page_id", "denied")


def url_rules(spark, sf_dir):
    url = F.col("url")
    key = F.col("page_id")
    odd = (F.when(key % 5 == 0, F.concat(F.lit("https://u@"), F.substr(url, F.lit(9)))).when(key % 5 == 1, F.regexp_replace(url, "//", "/"))
           .when(key % 5 == 2, F.regexp_replace(url, "(?<=[a-z])/", ":99999/")).when(key % 5 == 3, F.concat(F.lit("https://a.GITHUB.com./"), key.cast("string"))).otherwise(url))
    return B.table(spark, sf_dir, "pages").select(
        "page_id", urls.is_http_url(odd).alias("is_http"), urls.has_credentials(odd).alias("has_credentials"),
        urls.is_denied_host(odd, S.DENIED_OFFICIAL_HOSTS).alias("is_denied"))


# ------------------------------------------------------------------ texts
def collapsed_texts(spark, sf_dir):
    padded = F.concat(F.lit("\u3000\u00a0 "), F.col("text"), F.lit("\u2028\ufeff"))
    return _documents(spark, sf_dir).select(
        "doc_id", F.sha2(text.collapse_spaces(padded), 256).alias("h"), F.length(text.trim_u(padded)).cast("bigint").alias("n"))


def diagnostic_texts(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", text.diagnostic_text(F.col("text")).alias("message"))


def private_free_text(spark, sf_dir):
    """Conversation turns with planted paths, addresses and markers."""
    tail = F.get(F.array(*[F.lit(item) for item in (
        " /etc/hosts", " https://a.example/etc/x.txt", " see a/b and/or c", " /srv", " C:\\Users\\me", " /work/notes.md", " profile_space",
        " https://me@a.example/home/x/y", " //cdn/x/y.js", " Targets/x")]), (F.col("conv_id") % 10).cast("int"))
    return B.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", facts.has_private_free_text(F.concat("text", tail)).alias("is_private"))


def evidence_phrases(spark, sf_dir):
    phrase = F.get(F.array(*[F.lit(item) for item in ("以报名系统为准", "请以。系统为准", "未在官网列出", "暂无", "已确认", "疑似")]), (F.col("conv_id") % 6).cast("int"))
    value = F.concat("text", phrase)
    return B.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", facts.is_unverified(value).alias("unverified"), facts.is_not_published(value).alias("not_published"))


def child_paths(spark, sf_dir):
    key = F.col("p_partkey")
    name = F.when(key % 3 == 0, F.col("p_type")).when(key % 3 == 1, F.col("p_name")).otherwise(F.concat(F.lit('say "'), "p_brand", F.lit('"')))
    return B.table(spark, sf_dir, "part").select("p_partkey", text.child_path(F.lit("snapshot"), name).alias("path"))


# ------------------------------------------------------------------ privacy
def privacy_findings(spark, sf_dir):
    """Lines of documents with private data; one mail domain counts as reviewed."""
    return privacy_gate.corpus_findings(_documents(spark, sf_dir)).select(F.col("file").alias("doc_id"), "line_no", "kind")


def reviewed_contacts(spark, sf_dir):
    docs = _documents(spark, sf_dir).select("doc_id", F.regexp_replace("text", "@mail[0-3]", "@mail0").alias("text"))
    with_known = docs.withColumn("text", F.regexp_replace("text", r"[A-Za-z0-9._%+-]+@mail0\.example\.com", "team@mail0.example.com"))
    return privacy_gate.corpus_findings(with_known, contacts=("team@mail0.example.com",)).select(
        F.col("file").alias("doc_id"), "line_no", "kind")


def private_texts(spark, sf_dir):
    """First private value of whole texts whose addresses are disguised by width or by double percent-encoding."""
    docs = _documents(spark, sf_dir)
    disguised = F.when(F.contains("text", F.lit("%")), F.col("text")).when(F.col("doc_id") % 2 == 0, F.regexp_replace("text", "@", "＠")).otherwise(
        F.regexp_replace("text", "@", "%2540"))
    return privacy_gate.text_findings(docs.select("doc_id", disguised.alias("text"))).select(F.col("file").alias("doc_id"), "kind")


def benchmark_leaks(spark, sf_dir):
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    markers = B.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("marker_id"), F.col("text").alias("marker"))
    return leaks.occurrences(docs, markers).select("doc_id", F.col("marker_id").alias("item_id"))


def short_marker_leaks(spark, sf_dir):
    """Markers without inner words: the domains of all pages inside the addresses of pages and the texts of documents."""
    pages = B.table(spark, sf_dir, "pages")
    markers = pages.select(urls.host_of(F.col("url")).alias("marker")).groupBy("marker").agg(F.count("*").alias("n")).select(
        F.col("marker").alias("marker_id"), "marker")
    docs = pages.select(F.concat(F.lit("page "), "page_id").alias("doc_id"), F.col("url").alias("text")).unionAll(
        _documents(spark, sf_dir).select(F.concat(F.lit("document "), "doc_id").alias("doc_id"), "text"))
    return leaks.occurrences(docs, markers).select(F.col("doc_id").alias("place"), F.col("marker_id").alias("host"))


def corpus_isolation(spark, sf_dir):
    docs = _documents(spark, sf_dir).select("doc_id", "text", F.col("lang").alias("corpus"))
    markers = B.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("marker_id"), F.col("text").alias("marker"), F.when(F.col("item_id") % 2 == 0, "en").otherwise("de").alias("home"))
    return leaks.isolation_findings(docs, markers).select("corpus", F.col("marker_id").alias("item_id"), "problem")


# ------------------------------------------------------------------ JSON
def json_leaves(spark, sf_dir):
    events = B.table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("props").alias("json"))
    return documents.json_leaves(events).select("doc_id", "path", "value", F.col("depth").cast("bigint").alias("depth"), "nodes")


def _event_documents(spark, sf_dir):
    key, props = F.col("event_id"), F.col("props")
    body = F.regexp_replace(props, r"\}$", "")
    return B.table(spark, sf_dir, "events").select(key.alias("doc_id"), (
        F.when(key % 5 == 0, props).when(key % 5 == 1, F.concat(body, F.lit(', "k": 2}'))).when(key % 5 == 2, F.concat(body, F.lit(', "\\u006b": 2}')))
        .when(key % 5 == 3, F.concat(props, F.lit(" x"))).otherwise(F.concat(body, F.lit(', "a b": {"welfareScore": 1, "to": "x＠y.example"}}')))).alias("json"))


def loose_json(spark, sf_dir):
    return documents.loose_json(_event_documents(spark, sf_dir)).select("doc_id", "message")


def private_json(spark, sf_dir):
    return documents.private_leaves(documents.json_leaves(_event_documents(spark, sf_dir))).select("doc_id", "path", "message")


def json_budgets(spark, sf_dir):
    return documents.budget_violations(documents.json_leaves(_event_documents(spark, sf_dir)), max_nodes=3, max_depth=1)


def exact_keys(spark, sf_dir):
    rows = _event_documents(spark, sf_dir).select(F.col("doc_id").alias("snapshotKey"), F.lit("event").alias("path"), "json")
    return documents.key_violations(rows, ("k",), ("k", "v")).select(F.col("snapshotKey").alias("doc_id"), "path", "message")


def field_types(spark, sf_dir):
    key = F.col("o_orderkey")
    body = F.concat(F.lit('{"name":'), F.when(key % 4 == 0, "1").when(key % 4 == 1, "null").otherwise('"x"'), F.lit(',"deadlineEpochMs":'),
                    F.when(key % 3 == 0, "null").when(key % 3 == 1, '"1"').otherwise("1.5"), F.lit(',"tags":'), F.when(key % 5 == 0, "{}").otherwise("[]"), F.lit("}"))
    rows = B.table(spark, sf_dir, "orders").select(key.alias("snapshotKey"), F.lit("row").alias("path"), F.parse_json(body).alias("doc"))
    return documents.type_violations(rows, documents.OPPORTUNITY_TYPES).select(F.col("snapshotKey").alias("id"), "path", "message")


# ------------------------------------------------------------------ catalog
def _approved_feeds(spark, sf_dir):
    return facets.cycle_feeds(B.board(spark, sf_dir), F.lit(1998))


def catalog_feeds(spark, sf_dir):
    return catalog.catalog_feeds(_approved_feeds(spark, sf_dir), B.legacy_rows(spark, sf_dir)).select(
        "id", "label", F.col("admissionCycle").alias("admission_cycle"), F.col("eventYear").alias("event_year"))


def legacy_board(spark, sf_dir):
    return catalog.map_legacy(B.legacy_rows(spark, sf_dir)).select(
        F.col("projectId").alias("project_id"), F.col("deadlineOriginal").alias("original"), "deadline", F.col("deadlineEpochMs").alias("ms"),
        F.array_join("tags", ",").alias("tags"), F.size("discoverySources").cast("bigint").alias("n_sources"), "province")


def school_tiers(spark, sf_dir):
    """One tier for each row: own tags, else those of the archive, else the name."""
    rows = B.board(spark, sf_dir).withColumn("tags", F.when(F.col("institute") == "MACHINERY", F.array().cast("array<string>")).otherwise(F.col("tags")))
    return catalog.with_tier(rows, B.legacy_rows(spark, sf_dir)).select(
        F.col("projectId").alias("project_id"), F.array_join("tags", ",").alias("tier"))


def catalog_counts(spark, sf_dir):
    feeds, legacy = _approved_feeds(spark, sf_dir), B.legacy_rows(spark, sf_dir)
    rows = catalog.catalog_rows(B.board(spark, sf_dir), feeds, legacy)
    return facets.feed_counts(rows, catalog.catalog_feeds(feeds, legacy)).select(F.col("feedId").alias("feed_id"), "n")


def version_adapter(spark, sf_dir):
    key = F.substring_index("projectId", "|o", -1).cast("bigint")
    rows = B.board(spark, sf_dir).withColumn("schemaVersion", F.when(key % 2 == 0, 1).otherwise(2)).withColumn(
        "eventArrangement", F.when(key % 2 == 1, F.col("eventArrangement")))
    return catalog.adapt_versions(rows).select(
        F.col("projectId").alias("project_id"), F.col("eventArrangement.mode").alias("mode"), F.col("eventArrangement.time.summary").alias("summary"))


def logo_dimension(spark, sf_dir):
    return catalog.logo_dimension(B.logo_records(spark, sf_dir)).select("name", F.col("logoUrl").alias("logo_url"))


def logos_resolved(spark, sf_dir):
    names = B.table(spark, sf_dir, "supplier").select("s_suppkey", F.get(text.literal_array(
        ("清华大学", "清华大学（深圳）", "北京大学（深圳）", "某大学", "复旦大学·医学院(上海)")), (F.col("s_suppkey") % 5).cast("int")).alias("name"))
    overrides = spark.createDataFrame([("某大学", "/fixed.png")], "name string, logoUrl string")
    return catalog.with_logo(names, catalog.logo_dimension(B.logo_records(spark, sf_dir)), overrides).select(
        "s_suppkey", F.col("logoUrl").alias("logo_url"))


# ------------------------------------------------------------------ deadlines over events
def _event_deadlines(events):
    """Events as announcements: the deadline lies ``value`` tenths of an hour after the event."""
    micros = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col("ts"))
    return events.withColumns({
        "deadline_ms": (F.floor(micros / 1000) + F.floor(F.col("value") * 360_000)).cast("bigint"),
        "ts": F.timestamp_micros(micros),  # the instant, whatever the session's zone
    })


def deadline_changes(spark, sf_dir):
    """Rows whose deadline differs from the one last announced by the same user."""
    rows = _event_deadlines(B.table(spark, sf_dir, "events")).withColumn("deadline_h", F.floor(F.col("value") / 50).cast("bigint"))
    seen = positions.carried(rows.select("user_id", "event_id", "deadline_h"), ["user_id"], "event_id", {"last_h": ("last", F.col("deadline_h"))})
    return seen.where(~F.col("deadline_h").eqNullSafe(F.col("last_h"))).select("event_id", "user_id", "deadline_h", "last_h")


def expiry_stream(spark, sf_dir):
    """Each event's deadline, announced by timers when the stream's clock passes it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", timers.ROCKSDB)
    folder = f"{ensure_checkpoint_dir(spark)}/expiry-{uuid.uuid4()}"
    schema = B.table(spark, sf_dir, "events").schema
    stream = _event_deadlines(spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet"))
    clocked = stream.withWatermark("ts", "0 seconds")
    board = clocked.select("ts", F.col("event_id").cast("string").alias("projectId"), F.lit(S.OPEN).alias("verificationStatus"),
                           F.col("deadline_ms").alias("deadlineEpochMs"))
    announced = timers.expiries(board, F.lit(1))
    query = (announced.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(announced.schema).parquet(f"{folder}/out").select(
        F.col("key").cast("bigint").alias("event_id"), "label", F.col("at").alias("at_ms"))


QUERIES = {
    f.__name__: f for f in (
        url_normalize, url_identity, denied_hosts, url_rules, collapsed_texts, diagnostic_texts, private_free_text,
        evidence_phrases, child_paths, privacy_findings, reviewed_contacts, private_texts, benchmark_leaks,
        short_marker_leaks, corpus_isolation, json_leaves, loose_json, private_json, json_budgets, exact_keys,
        field_types, catalog_feeds, legacy_board, school_tiers, catalog_counts, version_adapter, logo_dimension,
        logos_resolved, deadline_changes, expiry_stream,
    )
}
