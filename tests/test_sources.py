import json
import random

from pyspark.sql import functions as F

from tests.helpers import opportunities, opportunity, rows_of
from tidemark.operators import catalog, leaks
from tidemark.plans import pages, privacy_gate
from tidemark.operators.board import BoardFilter
from tidemark.sources import dimensions


def write(path, value):
    path.write_text(json.dumps(value, ensure_ascii=False, indent=1), encoding="utf-8")
    return str(path)


def test_dimensions(spark, tmp_path):
    provinces = dimensions.read_provinces(spark, write(tmp_path / "p.json", {"河北": ["燕山大学", "中北大学"], "山西": ["中北大学"]}))
    assert rows_of(provinces) == sorted([("燕山大学", "河北"), ("中北大学", "河北")], key=repr)
    records = dimensions.read_logo_records(spark, write(tmp_path / "l.json", [
        {"rank": "1", "name": "清华大学Tsinghua/985", "logo_url": "/a"}, {"rank": "2", "name": "清华大学 x", "logo_url": "/b"},
        {"rank": "3", "name": "MIT", "logo_url": "/c"}, {"rank": "4", "name": "无图", "logo_url": ""}]))
    assert rows_of(catalog.logo_dimension(records)) == sorted([("清华大学", "/a"), ("MIT", "/c")], key=repr)


def test_catalog(spark, tmp_path):
    archive = {
        "camp2020": [{"name": "甲大学", "institute": "a", "description": "d", "deadline": "2020-07-01T00:00:00+08:00", "website": "https://x.example", "tags": ["已结营", "C9", "985"]},
                     {"name": "乙研究所", "institute": "b", "description": "d", "website": "", "tags": []}],
        "camp2027": [{"name": "青石大学", "institute": "a", "description": "d", "deadline": "later", "website": "w", "tags": ["C9"], "province": "北京"}],
        "summer": [{"name": "丙", "institute": "c", "description": "d", "deadline": " ", "website": "w", "tags": ["x"]}]}
    legacy = dimensions.read_legacy(spark, write(tmp_path / "a.json", archive))
    feeds = spark.createDataFrame([("camp2027", "L", "2027", 2026)], "id string, label string, admissionCycle string, eventYear bigint")
    approved = opportunities(spark, [opportunity(tags=[]), opportunity(projectId="o", feedId="other")])
    catalog_feeds, rows, counts = pages.catalog_page(approved, feeds, legacy)
    assert rows_of(catalog_feeds, "id", "label", "eventYear") == [
        ("camp2020", "夏令营 2020（历史归档）", 2020), ("camp2027", "L", 2026), ("summer", "summer（历史归档）", 0)]
    assert rows_of(counts) == [("camp2020", 2), ("camp2027", 1), ("summer", 1)]
    got = {row["projectId"]: row for row in rows.collect()}
    assert got["2027|青石大学|海洋学院|夏令营"]["tags"] == ["C9"]
    first, second = got["legacy|camp2020|甲大学|a|0"], got["legacy|camp2020|乙研究所|b|1"]
    assert (first["deadlineEpochMs"], first["tags"], len(first["discoverySources"])) == (1593532800000, ["C9"], 1)
    assert (second["deadlineOriginal"], second["tags"], second["discoverySources"]) == ("历史数据未提供", ["研究院"], [])


def test_board_page(spark):
    rows = opportunities(spark, [opportunity(projectId=str(i), deadlineEpochMs=1000 * i, province=None) for i in range(5)])
    provinces = spark.createDataFrame([("青石大学", "北京")], "name string, province string")
    page = pages.board_page(rows, provinces, BoardFilter(provinces=["北京"], status=["开放"]), 2000)
    assert [row["projectId"] for row in page.rows.collect()] == ["3", "4"]
    assert tuple(page.counts.first()) == (5, 2)
    assert {(r["facet"], r["value"]): r["n"] for r in page.facets.collect()}[("status", "已结束")] == 3


def test_corpus_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("fine\nmail me@x.example\n", encoding="utf-8")
    (tmp_path / "sub" / "b.txt").write_text("１３８００１３８０００\n/home/me/x", encoding="utf-8")
    found = privacy_gate.corpus_findings(dimensions.read_corpus(spark, str(tmp_path)), "file")
    assert sorted((row["file"].rsplit("/", 1)[1], row["line_no"], row["kind"]) for row in found.collect()) == [
        ("a.txt", 2, "contact"), ("b.txt", 1, "contact"), ("b.txt", 2, "private")]


def test_leaks_equal_brute_force(spark):
    rng = random.Random(3)
    words = ["ab", "abc", "b", "大学", "x-y", "cab", "é"]
    docs = [(i, rng.choice([" ", "\n"]).join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(120)]
    marks = []
    for i in range(80):
        text = rng.choice(docs)[1]
        start = rng.randrange(len(text))
        marks.append((i, text[start:start + rng.randint(1, 40)]))
    marks += [(900, "b ab"), (901, "absent words in no document at all"), (902, ""), (903, docs[0][1] + "!"), (904, "大")]
    got = rows_of(leaks.occurrences(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(marks, "marker_id int, marker string")))
    assert got == sorted([(d, m) for d, text in docs for m, mark in marks if mark and mark in text], key=repr)


def test_runs_of_texts_equal_brute_force(monkeypatch):
    """Runs over tile edges, of slices and null texts; none reaches from one text into the next."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(leaks, "TILE", 37)
    rng = random.Random(5)
    texts = [None, ""] + ["".join(rng.choice("aé大 ") for _ in range(rng.randint(0, 150))) for _ in range(20)] + [None, "a"]
    for length in leaks.RUNS:
        hashed = lambda run: int(leaks._hashes(np.frombuffer(run, np.uint8), length).view(np.int64)[0])  # noqa: B023, E731
        expected = {(i, hashed(raw[j:j + length])) for i, raw in enumerate((text or "").encode() for text in texts[1:])
                    for j in range(len(raw) - length + 1)}
        rows, runs = leaks._runs_of_texts(pa.array(texts).slice(1), length, None, None)
        assert sorted(zip(rows.tolist(), runs.tolist(), strict=True)) == sorted(expected)


def test_only_runs_of_anchors_leave_the_documents(spark):
    """Not every run of a document is a row of the join: a long text that holds one marker gives one run."""
    rng = random.Random(7)
    docs = spark.createDataFrame([(1, "".join(rng.choice("abcdefgh") for _ in range(50_000)) + " www.example.org/x")], "doc_id int, text string")
    markers = spark.createDataFrame([("h", "www.example.org"), ("k", "other.example.net")], "marker_id string, marker string")
    found = leaks.occurrences(docs, markers)
    assert rows_of(found) == [(1, "h")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("MapInArrow") == 1


def test_markers_that_share_an_id_are_all_found(spark):
    docs = spark.createDataFrame([(1, "one first marker"), (2, "one second marker")], "doc_id int, text string")
    markers = spark.createDataFrame([("m", "first marker"), ("m", "second marker"), ("n", None)], "marker_id string, marker string")
    assert rows_of(leaks.occurrences(docs, markers)) == [(1, "m"), (2, "m")]


def test_isolation(spark):
    docs = spark.createDataFrame([(1, "the LIVE marker here", "live"), (2, "a test only FIXTURE", "test"), (3, "FIXTURE leaked", "live")], "doc_id int, text string, corpus string")
    markers = spark.createDataFrame([("l", "LIVE", "live"), ("f", "FIXTURE", "test"), ("n", "NOWHERE", "test")], "marker_id string, marker string, home string")
    assert rows_of(leaks.isolation_findings(docs, markers), "corpus", "marker_id", "problem") == [("live", "f", "leaked"), ("test", "n", "missing")]


def test_files_are_read_once(spark, tmp_path):
    """The tables hold after the files are gone: the check and all tables come from one reading."""
    from tidemark.sources.snapshots import read_snapshots

    folder = tmp_path / "snapshots"
    folder.mkdir()
    (folder / "a.json").write_text('{"schemaVersion":2,"scanAt":"t","feeds":[{"id":"f","eventYear":1}],"opportunities":[{"name":"n"},{"name":5}]}')
    tables = read_snapshots(spark, str(folder))
    for path in folder.iterdir():
        path.unlink()
    assert [row["name"] for row in tables.opportunities.orderBy("pos").collect()] == ["n", None]
    assert [(row["id"], row["eventYear"]) for row in tables.feeds.collect()] == [("f", 1)]


def test_costly_rows_are_spread_over_four_tasks_a_core(spark):
    from tidemark.session import spread

    tasks = 4 * spark.sparkContext.defaultParallelism
    assert spread(spark.range(100).coalesce(1)).rdd.getNumPartitions() == tasks
    assert spread(spark.range(0, 100, 1, tasks + 1)).rdd.getNumPartitions() == tasks + 1
