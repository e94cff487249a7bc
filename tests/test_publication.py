import json
from functools import reduce

from pyspark.sql import functions as F
import pytest

from tests.helpers import FACT, OFFICIAL, batch_of, feeds, header, opportunities, opportunity, rows_of, scouting
from tidemark import schema as S
from tidemark.functions import canonical, dates
from tidemark.operators import diff, digest, documents, quality, seals
from tidemark.plans import publishing
from tidemark.plans.importing import import_batch
from tidemark.sources.snapshots import SnapshotTables, as_tables, read_snapshots
from tidemark.sources.store import MovedHead, SnapshotStore, create_exclusively, diagnostic, write_diff

APPROVED_AT = "2026-07-16T10:00:00+08:00"


def found(frame):
    return rows_of(frame, "path", "rule")


def test_known_hash(spark):
    head = header(spark, scanAt="2026-01-02T03:04:05Z", defaultFeedId="feed", counts=(0, 0, 0, 0))
    got = digest.canonical_hashes(head, feeds(spark, [("feed", "Feed", "2027", 2026)]), opportunities(spark, []))
    assert got.first()["computedHash"] == "2d1ac6c1deeea7e7fb4a5864af63dbeda7b876780a03872ea75c1a51fdbc36d0"


def test_no_text_is_gathered_beyond_the_size_bound(spark, monkeypatch):
    rows = opportunities(spark, [opportunity(projectId=f"2027|a|b|{i}") for i in range(3)])
    monkeypatch.setattr(S, "MAX_SNAPSHOT_BYTES", 1000)
    tables = SnapshotTables(header(spark), feeds(spark), rows)
    assert digest.canonical_hashes(tables.headers, tables.feeds, tables.opportunities).first()["computedHash"] is None
    assert ("snapshot", "size") in found(publishing.stored_violations(tables))


def test_canonical_json_tells_absent_from_null(spark):
    rows = [opportunity(province=None, deadline=None, description='a"\u0001\u001f\u000b\\u001F/中')]
    text = opportunities(spark, rows).select(canonical.canonical_json(S.OPPORTUNITY).alias("j")).first()["j"]
    parsed = json.loads(text)
    assert "province" not in parsed and parsed["deadline"] is None
    want = {k: v for k, v in opportunity(**rows[0]).items() if k != "province"}
    fact = lambda v: {"status": v[0], "summary": v[1]}
    want.update({k: fact(FACT) for k in ("logistics", "recommendation", "materials")},
                discoverySources=[dict(zip(("kind", "label", "url"), OFFICIAL))],
                eventArrangement={"mode": "offline", "time": fact(FACT), "formatLocation": fact(FACT)})
    assert text == json.dumps(want, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def _sealed(spark, rows, **head):
    return seals.multiset_seals(header(spark, **head), feeds(spark), opportunities(spark, rows)).first()


def test_multiset_seal_depends_on_rows_and_header_alone(spark):
    rows = [opportunity(projectId=f"2027|a|b|{i}") for i in range(40)] + [opportunity()] * 3
    one = _sealed(spark, rows)
    other = opportunities(spark, rows[::-1]).repartition(5)
    assert seals.multiset_seals(header(spark), feeds(spark), other).first() == one and one["rowCount"] == 43
    assert len(one["rowState"]) == 240
    different = [_sealed(spark, rows[:-1]), _sealed(spark, rows + [opportunity()]), _sealed(spark, rows[1:] + [rows[0] | {"name": "x"}]), _sealed(spark, rows, scanAt="2026-07-16T00:00:00Z"), _sealed(spark, [])]
    assert len({row["computedHash"] for row in [one, *different]}) == 6


def test_seal_after_changes_equals_the_seal_of_the_whole(spark):
    before = [opportunity(projectId=f"2027|a|b|{i}") for i in range(30)] + [opportunity(projectId="twice")] * 2
    after = before[3:-1] + [before[0] | {"name": "changed"}, opportunity(projectId="new"), opportunity(projectId="new")]
    out, put = before[:3] + before[-1:], after[-3:]
    sealed = publishing.seal(SnapshotTables(header(spark), feeds(spark), opportunities(spark, before)), APPROVED_AT, None)
    candidate = SnapshotTables(header(spark, counts=(9, 9, 9, 9)), feeds(spark), opportunities(spark, after))
    whole = publishing.seal(candidate, APPROVED_AT, "before").headers
    moved = publishing.seal(candidate, APPROVED_AT, "before", changes=publishing.Changes(sealed.headers, opportunities(spark, put), opportunities(spark, out))).headers
    assert moved.first() == whole.first() and moved.first()["rowCount"] == len(after)
    back = seals.seals_after(moved, header(spark), feeds(spark), opportunities(spark, out), opportunities(spark, put))
    assert back.first()["computedHash"] == sealed.headers.first()["dataHash"]


def test_every_scheme_is_verified(spark):
    tables = SnapshotTables(header(spark), feeds(spark), opportunities(spark, [opportunity()]))
    sealed = {scheme: publishing.seal(tables, APPROVED_AT, None, scheme).headers for scheme in (seals.MULTISET, seals.CANONICAL)}
    assert [frame.first()["sealScheme"] for frame in sealed.values()] == list(sealed)
    changes = {"same": {}, "hash": {"dataHash": "0" * 64}, "scan": {"scanAt": "2026-07-15T22:59:59+08:00"}, "scheme": {"sealScheme": "other"}}
    want = {"same": set(), "hash": {"hash-match"}, "scan": {"hash-match", "id-derived"}, "scheme": {"seal-scheme"}}
    named = lambda frame, key: frame.withColumn("snapshotKey", F.lit(key))
    heads, parts = [], []
    for scheme, frame in sealed.items():
        for name, change in changes.items():
            heads.append(named(frame.withColumns({k: F.lit(v) for k, v in change.items()}), f"{name}/{scheme}"))
            parts.append((named(tables.feeds, f"{name}/{scheme}"), named(tables.opportunities, f"{name}/{scheme}")))
    every = lambda frames: reduce(lambda x, y: x.unionByName(y), frames)
    found = rows_of(publishing.stored_violations(SnapshotTables(every(heads), every([f for f, _ in parts]), every([o for _, o in parts]))), "snapshotKey", "rule")
    for scheme in sealed:
        for name in changes:
            assert {rule for key, rule in found if key == f"{name}/{scheme}" and rule in ("hash-match", "id-derived", "seal-scheme")} == want[name], (name, scheme)
    old = publishing.stored_violations(SnapshotTables(sealed[seals.CANONICAL].drop(*publishing.SEAL_COLUMNS), tables.feeds, tables.opportunities))
    assert not {rule for _, rule in rows_of(old, "snapshotKey", "rule")} & {"hash-match", "id-derived", "seal-scheme"}


def test_a_snapshot_above_the_contracts_size_is_approved(spark, tmp_path):
    n = 6000
    one = opportunities(spark, [opportunity()]).drop("pos", "projectId", "description")
    long = F.concat(F.lit("x "), F.repeat(F.sha2(F.col("pos").cast("string"), 256), 48))
    rows = spark.range(n).select(F.col("id").alias("pos"), F.format_string("2027|a|b|%06d", "id").alias("projectId")).withColumn("description", long).crossJoin(one)
    rows = rows.select(*opportunities(spark, []).columns)
    tables = SnapshotTables(header(spark, counts=(n, 0, 0, 0)), feeds(spark), rows)
    assert digest.payload_sizes(digest.row_json(rows)).first()["bytes"] > S.MAX_SNAPSHOT_BYTES
    store = SnapshotStore(spark, str(tmp_path / "large"))
    first = publishing.approve(store, tables, APPROVED_AT)
    assert store.read(first).opportunities.count() == n
    assert publishing.seal(tables, APPROVED_AT, None, seals.CANONICAL).headers.first()["dataHash"] is None


def test_digest_tree_ignores_order_and_counts_copies(spark):
    frame = lambda items: spark.createDataFrame([(i,) for i in items], "json string")
    first = digest.content_digest(frame([str(i) for i in range(300)] + ["x"] * 500)).first()
    again = digest.content_digest(frame(["x"] * 500 + [str(i) for i in reversed(range(300))]).repartition(7)).first()
    other = digest.content_digest(frame([str(i) for i in range(300)] + ["x"] * 499)).first()
    assert first == again and first["n_rows"] == 800 and first["digest"] != other["digest"]


VALID = {"expired": dict(verificationStatus=S.EXPIRED, deadline=None, deadlineEpochMs=None),
         "unknown": dict(verificationStatus=S.UNKNOWN_DEADLINE, deadline=None, deadlineEpochMs=None)}
MUTATIONS = {
    "status-enum": dict(verificationStatus="open"), "deadline-iso": dict(deadline="2026-07-20"), "website-url": dict(website="x"),
    "website-credentials": dict(website="https://u:p@a.example/"), "website-denied": dict(website="https://docs.github.com/x"),
    "verified-at-iso": dict(verifiedAt="now"), "official-source": dict(discoverySources=[("cs-baoyan", "x", "https://a.example")]),
    "source-kind": dict(discoverySources=[OFFICIAL, ("blog", "x", "https://a.example")]),
    "source-url": dict(discoverySources=[OFFICIAL, ("cs-baoyan", "x", "ftp://a.example")]),
    "source-denied": dict(discoverySources=[("official", "x", "https://github.com/x")]),
    "arrangement-mode": dict(eventArrangement=("maybe", FACT, FACT)), "fact-status": dict(materials=("sure", "x")),
    "open-deadline": dict(deadline=None, deadlineEpochMs=None), "deadline-epoch": dict(deadlineEpochMs=1784563140001),
    "open-future": dict(deadline="2026-07-15T23:05:00+08:00", deadlineEpochMs=1784127900000),
    "unknown-deadline": dict(verificationStatus=S.UNKNOWN_DEADLINE), "expired-past": dict(verificationStatus=S.EXPIRED),
    "expired-deadline": dict(verificationStatus=S.EXPIRED, deadlineEpochMs=None),
    "key-parts": dict(projectId="2027|a| |b"), "key-cycle": dict(projectId="20x7|a|c|b"), "feed-known": dict(feedId="camp1"),
    "key-feed-cycle": dict(projectId="2026|a|c|b"), "verified-scan": dict(verifiedAt="2026-07-15T23:00:01+08:00"),
    "verified-approval": dict(verifiedAt="2026-07-15T23:05:01+08:00"),
}


def test_one_mutation_breaks_its_rule(spark):
    """All mutated rows in one frame; the position tells which mutation a violation belongs to."""
    names = list(MUTATIONS)
    rows = [opportunity(projectId=f"2027|a|b|{i}") | MUTATIONS[name] for i, name in enumerate(names)] + [
        opportunity(projectId=f"2027|ok|b|{name}") | change for name, change in VALID.items()] + [opportunity(projectId="2027|ok|b|open")]
    got = {}
    for row in quality.opportunity_violations(opportunities(spark, rows), header(spark), feeds(spark)).collect():
        got.setdefault(int(row["path"].split("[")[1].split("]")[0]), set()).add(row["rule"])
    follow = {"key-cycle": {"key-feed-cycle"}, "verified-approval": {"verified-scan"}, "expired-deadline": set(), "website-denied": set()}
    for i, name in enumerate(names):
        assert got[i] == {name} | follow.get(name, set()), (name, got[i])
    assert not any(i in got for i in range(len(names), len(rows)))


def test_null_in_a_required_column_is_a_violation(spark):
    names = quality.REQUIRED
    rows = [opportunity(projectId=f"2027|a|b|{i}") | {name: None} for i, name in enumerate(names)]
    got = {}
    for row in quality.opportunity_violations(opportunities(spark, rows), header(spark), feeds(spark)).where("rule = 'required'").collect():
        got.setdefault(row["path"].split("]")[0].split("[")[1], []).append(row["path"].split("].")[1])
    assert got == {str(i): [name] for i, name in enumerate(names)}
    bad = header(spark).select("snapshotKey", "schemaVersion", *[F.lit(None).cast("string").alias(c) for c in ("scanAt", "defaultFeedId", "snapshotId", "approvedAt", "previousSnapshotId", "dataHash")], "counts")
    assert {path for path, rule in found(quality.header_violations(bad, feeds(spark), True)) if rule == "required"} == {
        f"snapshot.{c}" for c in ("scanAt", "defaultFeedId", "snapshotId", "approvedAt", "dataHash")}
    facts = [opportunity(materials=(None, "x")), opportunity(eventArrangement=(None, FACT, FACT)), opportunity(eventArrangement=None)]
    broken = lambda version: [(p.split("].")[1], r) for p, r in found(
        quality.opportunity_violations(opportunities(spark, facts), header(spark, schemaVersion=version), feeds(spark)))]
    assert broken(1) == [("materials.status", "fact-status"), ("eventArrangement.mode", "arrangement-mode")]
    assert broken(2) == broken(1) + [("eventArrangement", "required")]


def test_null_elements_are_violations(spark):
    rows = [opportunity(tags=["985", None]), opportunity(discoverySources=[OFFICIAL, (None, "x", "https://a.example/")]),
            opportunity(discoverySources=[OFFICIAL, ("cs-baoyan", None, "https://a.example/")]), opportunity(discoverySources=[OFFICIAL, ("cs-baoyan", "x", None)])]
    rows = [row | {"projectId": f"2027|a|b|{i}"} for i, row in enumerate(rows)]
    got = quality.opportunity_violations(opportunities(spark, rows), header(spark), feeds(spark))
    assert [r for _, r in sorted(found(got))] == ["tag-text", "source-kind", "source-label", "source-url"]


def test_values_are_not_cast_with_a_loss(spark):
    docs = spark.createDataFrame([("a", '{"schemaVersion": 2.9, "scanAt": 5, "counts": {"confirmedOpen": "1", "expired": 1.9, "pendingExcluded": 2.0}, "feeds": [], "opportunities": []}')],
                                 "snapshotKey string, t string").select("snapshotKey", F.parse_json("t").alias("doc"))
    row = as_tables(docs).headers.first()
    assert (row["schemaVersion"], row["scanAt"]) == (None, None)
    assert (row["counts"]["confirmedOpen"], row["counts"]["expired"], row["counts"]["pendingExcluded"]) == (None, None, 2)


def test_a_failed_publication_can_be_repeated(spark, tmp_path, monkeypatch):
    store = SnapshotStore(spark, str(tmp_path / "again"))
    tables = SnapshotTables(header(spark), feeds(spark), opportunities(spark, [opportunity()]))
    with pytest.raises(MovedHead):
        store.publish(tables, "someone else's head")
    assert store.head() is None
    published = store.publish(tables, None)
    assert store.read(published).opportunities.count() == 1
    with pytest.raises(LookupError):
        store.read("unknown")


def test_of_two_writers_one_wins(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    store = SnapshotStore(spark, str(tmp_path / "both"))
    tables = SnapshotTables(header(spark), feeds(spark), opportunities(spark, [opportunity()]))
    first = store.publish(tables, None)
    barrier = Barrier(2)

    class Late(SnapshotStore):
        def head(self):
            found = super().head()
            barrier.wait(60)  # both have seen the same head before either claims the next number
            return found

    def write(name):
        try:
            return Late(spark, store.root).publish(SnapshotTables(tables.headers.withColumn("snapshotId", F.lit(name)), tables.feeds, tables.opportunities), first)
        except MovedHead:
            return None

    with ThreadPoolExecutor(2) as pool:
        won = [name for name in pool.map(write, ("x", "y")) if name]
    assert len(won) == 1 and store.head()["snapshotId"] == won[0] and store.head()["seq"] == 2
    assert store.manifest().count() == 2 and create_exclusively(spark, str(tmp_path / "f" / "a"), "1") and not create_exclusively(spark, str(tmp_path / "f" / "a"), "2")
    assert [p.read_text() for p in (tmp_path / "f").iterdir()] == ["1"]


def test_refused_files_are_not_lost(spark, tmp_path):
    (tmp_path / "ok.json").write_text('{"schemaVersion": 2}', encoding="utf-8")
    (tmp_path / "bad.json").write_text('{"schemaVersion": 2} trailing', encoding="utf-8")
    with pytest.raises(ValueError, match="bad.json"):
        read_snapshots(spark, str(tmp_path))


def test_leaves_take_any_key_and_tags_their_elements(spark):
    leaves = documents.json_leaves(spark.createDataFrame([("file:/a.json", '{"k": 1}')], "doc_id string, json string"))
    assert rows_of(leaves, "doc_id", "path") == [("file:/a.json", "$"), ("file:/a.json", "$.k")]
    rows = spark.createDataFrame([(1, '{"tags": [1, {"x": 2}]}'), (2, '{"tags": ["a"]}'), (3, '{"tags": []}'), (4, '{"tags": 1}')], "snapshotKey int, t string")
    got = rows_of(documents.type_violations(rows.select("snapshotKey", F.lit("r").alias("path"), F.parse_json("t").alias("doc")), {"tags": "strings"}), "snapshotKey", "message")
    assert got == [(1, "expected an array of strings"), (4, "expected an array")]


def test_table_rules(spark):
    rows = [
        opportunity(projectId="2027|a|b|1", deadlineEpochMs=300), opportunity(projectId="2027|a|b|2", deadlineEpochMs=200),
        opportunity(projectId="2027|a|b|2", deadlineEpochMs=250), opportunity(projectId="u") | VALID["unknown"],
        opportunity(projectId="v", deadlineEpochMs=900), opportunity(projectId="x") | VALID["expired"], opportunity(projectId="y") | VALID["unknown"],
    ]
    frame = opportunities(spark, rows)
    at = lambda i, tail="": f"snapshot.opportunities[{i}]{tail}"
    assert found(quality.order_violations(frame)) == sorted([
        (at(1), "order-deadline"), (at(4), "order-unknown"), (at(6), "order-expired")], key=repr)
    assert found(quality.duplicate_violations(frame)) == [(at(2, ".projectId"), "key-unique")]
    assert found(quality.count_violations(header(spark, counts=(4, 2, -1, 0)), frame)) == [
        ("snapshot.counts.expired", "count-match"), ("snapshot.counts.pendingExcluded", "count-integer")]
    several = feeds(spark, [("a", "A", "2027", 1), ("a", "A", "207", 1), ("", "B", "2027", 1)])
    assert found(quality.feed_violations(several)) == [
        ("snapshot.feeds[1].admissionCycle", "feed-cycle"), ("snapshot.feeds[1].id", "feed-unique"), ("snapshot.feeds[2].id", "feed-id")]
    bad = header(spark, schemaVersion=3, scanAt="x", defaultFeedId="none", dataHash="z", snapshotId="", previousSnapshotId="p", approvedAt="y")
    assert {rule for _, rule in found(quality.header_violations(bad, feeds(spark), True))} == {
        "schema-version", "scan-iso", "default-feed", "approval-iso", "snapshot-id", "hash-format", "previous-format"}
    assert found(quality.header_violations(header(spark), feeds(spark), True)) == []
    assert found(quality.header_violations(header(spark, schemaVersion=1), feeds(spark), False)) == [("snapshot.schemaVersion", "schema-version")]


def test_private_values_anywhere(spark):
    rows = [opportunity(tags=["file:///Users/alice/x"], description="联系 student＠example.com", eventArrangement=("online", ("confirmed", "+86 138 0013 8000"), FACT))]
    got = rows_of(documents.private_values(header(spark, defaultFeedId="a@b.example"), feeds(spark, [("f", "welfareScore", "2027", 1)]), opportunities(spark, rows)), "path")
    assert got == sorted([("snapshot.defaultFeedId",), ("snapshot.feeds[0].label",), ("snapshot.opportunities[0].description",),
                          ("snapshot.opportunities[0].eventArrangement.time.summary",), ("snapshot.opportunities[0].tags[0]",)], key=repr)


def test_freshness_bounds(spark):
    now, day = dates.iso_to_ms(F.lit("2026-07-16T23:00:00+08:00")), S.MS_PER_DAY
    errors = lambda ms, **kw: header(spark, **kw).select(F.array_join(quality.freshness_errors(ms, day), ";")).first()[0]
    assert errors(now) == ""
    assert errors(now + 1) == "scanAt: is older than the maximum age"
    assert errors(now, scanAt="x") == "scanAt: expected a valid ISO timestamp"
    assert errors(now, approvedAt="2026-07-15T22:00:00+08:00").startswith("approvedAt: must not be before scanAt")
    assert "must not be in the future" in errors(now - 2 * day)


def snapshot_json(**changes):
    fact = {"status": "not-published", "summary": "未公布"}
    row = {k: v for k, v in opportunity().items()} | {
        "discoverySources": [dict(zip(("kind", "label", "url"), OFFICIAL))], "logistics": fact, "recommendation": fact, "materials": fact,
        "eventArrangement": {"mode": "offline", "time": fact, "formatLocation": fact}}
    doc = {"schemaVersion": 2, "scanAt": "2026-07-15T23:00:00+08:00", "defaultFeedId": "camp2027",
           "feeds": [{"id": "camp2027", "label": "x", "admissionCycle": "2027", "eventYear": 2026}],
           "counts": {"confirmedOpen": 1, "confirmedUnknownDeadline": 0, "pendingExcluded": 0, "expired": 0}, "opportunities": [row],
           "snapshotId": "s", "approvedAt": "2026-07-15T23:05:00+08:00", "previousSnapshotId": None, "dataHash": "0" * 64}
    return doc | changes


def test_shapes_of_raw_documents(spark, tmp_path):
    good, bad, old = snapshot_json(), snapshot_json(), snapshot_json(schemaVersion=1)
    row = bad["opportunities"][0]
    row.update(extra=1, name=5, tags="x", logistics={"status": "confirmed"})
    del row["website"]
    bad["counts"]["more"] = 1
    del bad["feeds"][0]["label"]
    bad["feeds"][0]["eventYear"] = "2026"
    old["opportunities"][0].pop("eventArrangement")
    docs = spark.createDataFrame([(n, json.dumps(d)) for n, d in (("good", good), ("bad", bad), ("old", old))], "snapshotKey string, t string").select(
        "snapshotKey", F.parse_json("t").alias("doc"))
    got = rows_of(documents.shape_violations(docs, True), "snapshotKey", "path", "message")
    assert got == sorted([
        ("bad", "snapshot.counts.more", "unknown property"), ("bad", "snapshot.feeds[0].label", "missing property"),
        ("bad", "snapshot.feeds[0].eventYear", "expected a finite number"), ("bad", "snapshot.opportunities[0].extra", "unknown property"),
        ("bad", "snapshot.opportunities[0].website", "missing property"), ("bad", "snapshot.opportunities[0].name", "expected a string"),
        ("bad", "snapshot.opportunities[0].tags", "expected an array"), ("bad", "snapshot.opportunities[0].logistics.summary", "missing property")], key=repr)
    tables = as_tables(docs)
    assert rows_of(tables.opportunities.where("snapshotKey = 'old'"), "projectId", "eventArrangement") == [(good["opportunities"][0]["projectId"], None)]
    (tmp_path / "a.json").write_text(json.dumps(good, indent=1, ensure_ascii=False), encoding="utf-8")
    assert read_snapshots(spark, str(tmp_path)).opportunities.first()["deadlineEpochMs"] == 1784714700000


#: Rule which a change of the good document breaks: (name, change of the document, path behind "snapshot", rule).
FAULTS = [
    ("extra-key", lambda d: d.update(note=1), ".note", "exact-keys"),
    ("count-key", lambda d: d["counts"].pop("expired"), ".counts.expired", "exact-keys"),
    ("count", lambda d: d["counts"].update(confirmedOpen=2), ".counts.confirmedOpen", "count-match"),
    ("count-fraction", lambda d: d["counts"].update(pendingExcluded=0.5), ".counts.pendingExcluded", "count-integer"),
    ("version", lambda d: d.update(schemaVersion=3), ".schemaVersion", "schema-version"),
    ("scan", lambda d: d.update(scanAt=7), ".scanAt", "field-type"),
    ("feed-year", lambda d: d["feeds"][0].update(eventYear="2026"), ".feeds[0].eventYear", "field-type"),
    ("feed-cycle", lambda d: d["feeds"][0].update(admissionCycle="207"), ".feeds[0].admissionCycle", "feed-cycle"),
    ("feed-twice", lambda d: d["feeds"].append(d["feeds"][0]), ".feeds[1].id", "feed-unique"),
    ("default", lambda d: d.update(defaultFeedId="none"), ".defaultFeedId", "default-feed"),
    ("no-arrangement", lambda d: d["opportunities"][0].pop("eventArrangement"), ".opportunities[0].eventArrangement", "required"),
    ("tag-number", lambda d: d["opportunities"][0].update(tags=["985", 1]), ".opportunities[0].tags", "field-type"),
    ("tag-object", lambda d: d["opportunities"][0].update(tags=[{"a": 1}]), ".opportunities[0].tags", "field-type"),
    ("fact-flag", lambda d: d["opportunities"][0]["materials"].update(summary=True), ".opportunities[0].materials.summary", "field-type"),
    ("source-key", lambda d: d["opportunities"][0]["discoverySources"][0].update(more=1), ".opportunities[0].discoverySources[0].more", "exact-keys"),
    ("unknown-feed", lambda d: d["opportunities"][0].update(feedId="camp1"), ".opportunities[0].feedId", "feed-known"),
    ("cycle", lambda d: d["opportunities"][0].update(projectId="2026|a|c|b"), ".opportunities[0].projectId", "key-feed-cycle"),
    ("late-check", lambda d: d["opportunities"][0].update(verifiedAt="2026-07-15T23:00:01+08:00"), ".opportunities[0].verifiedAt", "verified-scan"),
    ("twice", lambda d: d["opportunities"].append(d["opportunities"][0]), ".opportunities[1].projectId", "key-unique"),
    ("private", lambda d: d["opportunities"][0].update(description="a＠b.example"), ".opportunities[0].description", "private-value"),
    ("hash", lambda d: None, ".dataHash", "hash-match"),
]


def test_document_gate_finds_each_fault(spark):
    from pyspark.sql import Observation

    docs = []
    for name, change, _, _ in FAULTS:
        doc = json.loads(json.dumps(snapshot_json()))
        change(doc)
        docs.append((name, json.dumps(doc, ensure_ascii=False)))
    raw = spark.createDataFrame(docs, "snapshotKey string, t string").select("snapshotKey", F.parse_json("t").alias("doc"))
    seen = Observation("gate")
    got = rows_of(publishing.document_violations(raw, approved=True, observation=seen), "snapshotKey", "path", "rule")
    for name, _, path, rule in FAULTS:
        assert (name, f"snapshot{path}", rule) in got, name
    # every document has the made-up hash and id; the one without a fault breaks nothing else
    assert {rule for name, _, rule in got if name == "hash"} == {"hash-match", "id-derived"}
    assert seen.get["rows"] == len(FAULTS) + 1 and seen.get["confirmedOpen"] == len(FAULTS) + 1 and 0 < seen.get["broken"] < len(FAULTS)


def test_release_records_have_exactly_their_keys(spark):
    good = {"dataHash": "a" * 64, "releaseSha": "b" * 40, "snapshotId": "2026-07-16T02:00:00.000Z-aaaaaaaaaaaa"}
    records = [(0, json.dumps(good)), (1, json.dumps(good | {"more": 1})), (2, json.dumps({k: v for k, v in good.items() if k != "dataHash"}))]
    frame = spark.createDataFrame(records, "releaseKey int, record string").select(
        "releaseKey", "record", F.from_json("record", "releaseSha string, snapshotId string, dataHash string").alias("r")).select("releaseKey", "record", "r.*")
    assert rows_of(quality.violations(frame, quality.release_rules("record"), "releaseKey"), "releaseKey", "rule") == [(1, "release-keys"), (2, "release-hash"), (2, "release-keys")]


def test_strict_json(spark):
    cases = [('{"a":1}', True), ('{"a":1} ', True), ('{"a":1} x', False), ('{"a":1,"a":2}', False), ('{"a":1,"\\u0061":2}', False), ("", False),
             ("1, 2", False), ("1] , [2", False), ('1}, {"v":2', False), ("[" * 512 + "]" * 512, True), ("[" * 513 + "]" * 513, False),
             ('{"a":"' + "[" * 600 + '"}', True), ("[" + ",".join(["[]"] * 600) + "]", True), (None, False)]
    frame = spark.createDataFrame([(i, *case) for i, case in enumerate(cases)], "i int, t string, want boolean")
    for row in frame.withColumn("got", documents.is_strict_json(F.col("t"))).collect():
        assert row["got"] == row["want"], row["i"]


def test_leaves_and_budgets(spark):
    doc = {"a": [1, 2.0, True, None, "x"], "b c": {"ｗelfareScore": "v"}, "d": "a@b.example"}
    frame = spark.createDataFrame([(1, json.dumps(doc)), (2, "[" * 300 + "]" * 300)], "doc_id bigint, json string")
    leaves = documents.json_leaves(frame)
    assert rows_of(leaves.where("doc_id = 1 and value is not null"), "path", "value") == sorted(
        [("$.a[0]", "1"), ("$.a[1]", "2"), ("$.a[4]", "x"), ('$["b c"]["ｗelfareScore"]', "v"), ("$.d", "a@b.example")], key=repr)
    assert rows_of(documents.budget_violations(leaves)) == [(2, "privacy scan exceeded depth budget")]
    deep = spark.createDataFrame([(1, '{"a":' * 300 + '"a@b.example"' + "}" * 300)], "doc_id bigint, json string")
    assert rows_of(documents.private_leaves(documents.json_leaves(deep)), "path", "message") == [("$" + ".a" * 300, "contains a email address")]
    assert rows_of(documents.budget_violations(leaves, max_nodes=9), "doc_id") == [(1,), (2,), (2,)]
    assert set(rows_of(documents.private_leaves(leaves), "path", "message")) == {
        ('$["b c"]["ｗelfareScore"]', "contains a private publication marker"), ("$.d", "contains a email address")}


def test_diff_classes(spark, tmp_path):
    one = opportunity
    before = [one(projectId=k) for k in ("same", "blank", "verified", "gone", "run", "changed", "reopened")]
    before[6].update(VALID["expired"])
    after = [one(projectId="same"), one(projectId="blank", description=" 一周的海上与实验室工作　"), one(projectId="verified", verifiedAt="x"),
             one(projectId="run") | VALID["expired"] | {"project": "also changed"}, one(projectId="changed", website="https://b.example/"),
             one(projectId="reopened"), one(projectId="new")]
    changes = diff.diff(opportunities(spark, before), opportunities(spark, after), "pos")
    assert rows_of(changes) == [("changed", "changed"), ("gone", "removed"), ("new", "added"), ("reopened", "changed"), ("run", "expired")]
    assert tuple(diff.diff_counts(changes).first()) == (1, 2, 1, 1)
    write_diff(changes, str(tmp_path / "d"))
    assert rows_of(spark.read.json(str(tmp_path / "d")).select("changeType", "projectId")) == rows_of(changes.select("changeType", "projectId"))
    with pytest.raises(Exception):
        write_diff(changes, str(tmp_path / "d"))


def test_release_identity(spark):
    sealed = header(spark, snapshotId="id1", dataHash="h1")
    releases = spark.createDataFrame([("ok", "s", "id1", "h1"), ("hash", "s", "id1", "h2"), ("id", "s", "id9", "h1"), ("sha", "t", "id1", "h1")],
                                     "releaseKey string, releaseSha string, snapshotId string, dataHash string")
    assert rows_of(quality.release_identity(releases, sealed, "s"), "releaseKey", "severity") == [("hash", "error"), ("id", "error"), ("sha", "warning")]


def test_approve_and_lineage(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    candidate = import_batch(batch_of(spark, scouting()))
    publishing.require_none(candidate.violations, "import")
    assert store.head() is None
    first = publishing.approve(store, candidate.tables, APPROVED_AT)
    assert first.startswith("2026-07-16T02:00:00.000Z-") and store.head()["snapshotId"] == first
    stored = store.read(first)
    assert stored.headers.first()["previousSnapshotId"] is None and stored.opportunities.count() == 3
    sealed = publishing.seal(candidate.tables, "2026-07-16T11:00:00+08:00", None)
    with pytest.raises(MovedHead):
        store.publish(sealed, None)
    with pytest.raises(publishing.Refused):
        publishing.require_none(publishing.stored_violations(SnapshotTables(
            stored.headers.withColumn("dataHash", F.lit("0" * 64)), stored.feeds, stored.opportunities)), "stored")
    base, again = stored.headers.withColumn("pairKey", F.lit(1)), sealed.headers.withColumn("pairKey", F.lit(1))
    assert publishing.publication_plan(base, again, 0).first()["status"] == "no-change"
    follow = again.withColumn("dataHash", F.lit("x"))
    assert publishing.publication_plan(base, follow, 0).first()["status"] == "broken-lineage"
    ready = publishing.publication_plan(base, follow.withColumn("previousSnapshotId", F.lit(first)), 0).first()
    assert (ready["status"], ready["scanDate"], ready["planStamp"]) == ("ready", "2026-07-16", "19700101-000000")


def test_diagnostic_record(spark):
    row = diagnostic(spark, False, "2026-07-16T00:00:00Z", "release", "bad\nthing").first()
    assert (row["ok"], row["stage"], row["message"]) == (False, "release", "bad thing")


def test_row_suspects_are_the_suspect_leaves(spark):
    """A row is looked at as a whole first; no private text of any field is lost by that."""
    texts = ["a@b.example", "call +86 138-1234-5678", "FILE:///x", "/home/me/x", r"c:\Users\me", "~/notes", "a%2540b", "ａ＠b.example", "WelfareScore", "targets/submitted", "plain"]
    changes = [{name: value} for value in texts for name in ("description", "website", "deadlineOriginal")]
    changes += [{"tags": [value]} for value in texts] + [{"logistics": ("confirmed", value)} for value in texts]
    changes += [{"discoverySources": [("official", "x", value)]} for value in texts] + [{"eventArrangement": ("offline", FACT, ("confirmed", value))} for value in texts]
    rows = opportunities(spark, [opportunity(**change) for change in changes])
    suspects = rows.select(documents.row_suspects().alias("fast"), documents.suspect_leaves(documents.text_leaves()).alias("slow")).collect()
    assert all(row["fast"] == row["slow"] for row in suspects)
    assert documents.private_row_values(rows).count() >= 60


def test_document_gate_reads_documents_twice(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    raw = spark.createDataFrame([("s", '{"schemaVersion":2,"feeds":[],"opportunities":[{"name":1}]}')], "snapshotKey string, body string").select(
        "snapshotKey", F.parse_json(F.udf(seen)("body")).alias("doc"))
    assert publishing.document_violations(raw, approved=False).count() > 0
    assert read.value == 2


def test_rows_of_one_snapshot_stay_spread_in_the_gate(spark, monkeypatch):
    """Heads meet the rows where these lie; dealt by the snapshot's key all rows would be in one task."""
    written, real = [], publishing.materialise
    monkeypatch.setattr(publishing, "materialise", lambda frame: written.append(real(frame)) or written[-1])
    rows = opportunities(spark, [opportunity(projectId=f"2027|a|b|{i}") for i in range(60)]).repartition(6)
    tables = publishing.seal(SnapshotTables(real(header(spark, counts=(60, 0, 0, 0))), real(feeds(spark)), real(rows)), APPROVED_AT, None)
    assert publishing.stored_violations(tables).count() == 0
    assert [frame.rdd.getNumPartitions() for frame in written if "found" in frame.columns] == [6]


def test_violations_are_looked_for_in_all_partitions_at_once(spark):
    rows = spark.range(0, 64, 1, 64).where("id % 7 = 9").select(F.lit("p").alias("path"), F.lit("m").alias("message"))
    spark.sparkContext.setJobGroup("at once", "")
    publishing.require_none(rows, "Test")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("at once")) <= 2
    with pytest.raises(publishing.Refused, match="p: m"):
        publishing.require_none(rows.sparkSession.range(3).select(F.lit("p").alias("path"), F.lit("m").alias("message")), "Test")


def _bytes_in(folder):
    from pathlib import Path

    return sum(file.stat().st_size for file in Path(folder.removeprefix("file:")).rglob("*") if file.is_file())


def test_documents_are_kept_compressed_and_bound_by_their_text(spark, tmp_path, monkeypatch):
    """Documents that are read once and kept for all tables take a part of their text; a compressed file counts with the text it holds."""
    import gzip

    from tidemark.session import ensure_checkpoint_dir

    text = json.dumps({"schemaVersion": 2, "feeds": [], "opportunities": [{"name": f"name {i % 50}"} for i in range(40_000)]})
    (tmp_path / "a.json").write_text(text)
    (tmp_path / "b.json.gz").write_bytes(gzip.compress(text.encode()))
    kept = ensure_checkpoint_dir(spark)
    before = _bytes_in(kept)
    tables = read_snapshots(spark, str(tmp_path))
    assert tables.opportunities.count() == 80_000 and _bytes_in(kept) - before < len(text) / 2
    monkeypatch.setattr(S, "MAX_SNAPSHOT_BYTES", len(text) - 1)
    with pytest.raises(ValueError, match="b.json.gz: exceeds the size limit"):
        read_snapshots(spark, str(tmp_path / "b.json.gz"))


def test_documents_are_put_together_after_one_exchange_of_narrow_rows(spark, tmp_path):
    """Texts are made where their document is; what is dealt out by document has no texts."""
    import re

    from tidemark import bench_views

    tables = {
        "orders": spark.range(200).selectExpr("id as o_orderkey", "id % 3 as o_custkey", "'O' as o_orderstatus", "'1-URGENT' as o_orderpriority", "timestamp_ntz'1998-01-02' as o_orderdate"),
        "customer": spark.range(3).selectExpr("id as c_custkey", "0 as c_nationkey", "'BUILDING' as c_mktsegment"),
        "nation": spark.sql("select 0 as n_nationkey, 'N' as n_name, 0 as n_regionkey"), "region": spark.sql("select 0 as r_regionkey, 'R' as r_name")}
    for name, frame in tables.items():
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    documents = bench_views.board_documents(spark, str(tmp_path))
    plan = documents._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(b#", plan)) == 1 and "collect_list" not in plan[plan.index("Exchange hashpartitioning(b#"):]
    assert rows_of(documents.select("snapshotKey", F.size(F.try_variant_get("doc", "$.opportunities", "array<variant>")))) == [("b0", 64), ("b1", 64), ("b2", 64), ("b3", 8)]
