from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from tests.helpers import opportunities, opportunity
from tidemark import schema as S
from tidemark.operators import board, calendar, catalog, facets, saved_filters

CN = timezone(timedelta(hours=8))
NOW = int(datetime(2026, 7, 15, tzinfo=CN).timestamp() * 1000)


def at(day, hour=0):
    return int(datetime(2026, 7, day, hour, tzinfo=CN).timestamp() * 1000)


def unknown(**changes):
    return opportunity(**(dict(verificationStatus=S.UNKNOWN_DEADLINE, deadline=None, deadlineEpochMs=None) | changes))


def expired(**changes):
    return opportunity(**(dict(verificationStatus=S.EXPIRED, deadline=None, deadlineEpochMs=None) | changes))


def ids(frame):
    return [row["projectId"] for row in frame.collect()]


def test_order_of_groups_and_ties(spark):
    rows = [
        unknown(projectId="u"), opportunity(projectId="later", deadlineEpochMs=at(17)), expired(projectId="x-null"),
        opportunity(projectId="sooner", deadlineEpochMs=at(16)), opportunity(projectId="a-tie", deadlineEpochMs=at(17)),
        expired(projectId="x-old", deadlineEpochMs=at(1)), opportunity(projectId="x-run", deadlineEpochMs=at(10)),
        unknown(projectId="u-odd", deadlineEpochMs=at(1)),
    ]
    derived = board.derive(opportunities(spark, rows), NOW)
    want = ["sooner", "a-tie", "later", "u", "u-odd", "x-run", "x-old", "x-null"]
    assert ids(derived.orderBy(*board.board_order())) == want
    placed = board.ranked(derived).orderBy("pos").collect()
    assert [row["projectId"] for row in placed] == want and [row["pos"] for row in placed] == list(range(1, 9))
    assert ids(board.next_k(derived, 3)) == want[:3]


def test_boundary_at_the_deadline(spark):
    moment = at(18, 12)
    rows = [opportunity(projectId="p", deadlineEpochMs=moment), expired(projectId="f", deadlineEpochMs=moment + 10)]
    before = board.derive(opportunities(spark, rows), moment - 1).where("projectId = 'p'").first()
    ended = board.derive(opportunities(spark, rows), moment)
    assert (before["rowGroup"], before["urgency"]) == (S.TIMED_GROUP, "critical")
    assert {(r["projectId"], r["rowGroup"], r["urgency"]) for r in ended.collect()} == {
        ("p", S.EXPIRED_GROUP, "expired"), ("f", S.EXPIRED_GROUP, "expired")}
    assert [tuple(r) for r in facets.status_facet(ended).orderBy("ord").select("status", "n").collect()] == [(S.LABEL_OPEN, 0), (S.LABEL_ENDED, 2)]
    up = opportunities(spark, [rows[0], opportunity(projectId="q", deadlineEpochMs=moment + 1)])
    assert tuple(facets.upcoming(board.derive(up, moment)).first()) == (1, 1, 1)


def test_filters(spark):
    rows = [
        opportunity(projectId="a", tags=[], eventArrangement=("online", ("confirmed", "x"), ("confirmed", "x")), province=" 上海 "),
        unknown(projectId="b", tags=["985", "C9"], name="清华大学", province=None),
        expired(projectId="c", tags=["已开营"], name="某大学", province=None, project="Deep LEARNING", eventType="Camp"),
    ]
    provinces = spark.createDataFrame([("清华大学", "北京"), ("青石大学", "错")], "name string, province string")
    derived = board.derive(opportunities(spark, rows), NOW)
    chosen = lambda **kw: sorted(ids(board.apply_filter(derived, board.BoardFilter(**kw), provinces)))
    assert chosen() == ["a", "b", "c"]
    assert chosen(status=[S.LABEL_OPEN]) == ["a", "b"]
    assert chosen(status=[S.LABEL_ENDED]) == ["c"]
    assert chosen(tags=["C9", "港三"]) == ["b"]
    assert chosen(modes=["online"]) == ["a"]
    assert chosen(provinces=["上海", "北京"]) == ["a", "b"]
    assert chosen(query="  learning camp ") == ["c"]
    assert chosen(query="learning camp", status=[S.LABEL_OPEN]) == []
    assert chosen(modes=["online", "offline"], tags=["985"]) == ["b"]


def test_saved_filters_equal_single_filters(spark):
    rows = [opportunity(projectId=f"p{i}", tags=[S.TIER_TAGS[i % 10], S.TIER_TAGS[(i * 3 + 1) % 10]] if i % 4 else [], deadlineEpochMs=at(1 + i % 28),
                        eventArrangement=(S.EVENT_MODES[i % 4], ("confirmed", "x"), ("confirmed", "x")), province=S.PROVINCES[i % 5] if i % 3 else None,
                        project=f"project {i % 6}", verificationStatus=S.VERIFICATION_STATUSES[i % 3]) for i in range(60)]
    provinces = spark.createDataFrame([("青石大学", "新疆")], "name string, province string")
    located = board.resolve_province(board.derive(opportunities(spark, rows), NOW), provinces)
    links = [
        (1, "camp2027", "list", "", None, None, None, None), (2, "camp2027", "x", "project 3", "985,C9,211", None, None, None),
        (3, "nope", None, None, None, "已开营,bad", "online,bad", "北京,新疆,上海"), (4, "camp2027", "calendar", "PROJECT", "TOP2, 港三", "已结束,开放", "hybrid,offline", "浙江"),
        (5, "camp2027", None, "absent", None, None, None, None), (6, "camp2027", None, "", "不存在", None, None, None),
    ]
    frame = spark.createDataFrame(links, "filter_id bigint, src string, view string, q string, tags string, status string, modes string, prov string")
    parsed = saved_filters.parse(frame, spark.createDataFrame([("camp2027",)], "id string"), "camp2027")
    got = {}
    for row in saved_filters.matches(located, parsed).collect():
        got.setdefault(row["filter_id"], []).append(row["projectId"])
    for row in parsed.collect():
        single = board.BoardFilter(row["query"], row["tags"], row["status"], row["modes"], row["provinces"])
        want = ids(board.apply_filter(board.of_feed(located, row["source"]), single))
        assert sorted(got.get(row["filter_id"], [])) == sorted(want), row
    assert [row["view"] for row in parsed.orderBy("filter_id").collect()] == ["list", "list", "list", "calendar", "list", "list"]


def test_facets_show_zeros(spark):
    rows = [opportunity(projectId=str(i), tags=["985", "C9"] if i else []) for i in range(3)]
    derived = board.derive(opportunities(spark, rows), NOW)
    located = board.resolve_province(derived, spark.createDataFrame([("青石大学", "浙江")], "name string, province string"))
    assert {r["tag"]: r["n"] for r in facets.tag_facet(derived).collect()} == {t: 2 if t in ("985", "C9") else 0 for t in S.TIER_TAGS}
    provinces = {r["province"]: r["n"] for r in facets.province_facet(located).collect()}
    assert len(provinces) == 31 and provinces["山东"] == 3 and sum(provinces.values()) == 3
    panel = {(r["facet"], r["value"]): r["n"] for r in facets.all_facets(located).collect()}
    assert len(panel) == 2 + 4 + 31 + 10 and panel[("mode", "offline")] == 3 and panel[("tag", "C9")] == 2
    assert [tuple(r) for r in facets.group_sizes(derived).orderBy("row_group").collect()] == [
        ("active-timed", 3, False), ("active-unknown", 0, False), ("expired", 0, False)]
    assert facets.has_tags(derived).first()[0] is True


def test_calendar(spark):
    late, early = opportunity(projectId="l", deadlineEpochMs=at(20)), expired(projectId="e", deadlineEpochMs=int(datetime(2026, 5, 1, tzinfo=CN).timestamp() * 1000))
    first = lambda rows: calendar.pick_month(opportunities(spark, rows), NOW).first()["first_day"].isoformat()
    assert first([early, late]) == "2026-07-01"
    assert first([early]) == "2026-05-01"
    assert first([unknown()]) == "2026-07-01"
    crowded = [opportunity(projectId=f"p{i}", deadlineEpochMs=at(20, i)) for i in range(5)] + [late]
    frame = opportunities(spark, crowded)
    grid = calendar.month(frame, NOW).orderBy("cell").collect()
    assert len(grid) == 42 and grid[0]["date_key"] == "2026-06-29" and grid[-1]["date_key"] == "2026-08-09"
    day = next(row for row in grid if row["date_key"] == "2026-07-20")
    assert (day["n"], day["overflow"], day["in_month"]) == (6, 3, True)
    assert [row["date_key"] for row in grid if row["is_today"]] == ["2026-07-15"]
    shown = calendar.preview(board.derive(frame, NOW), NOW).orderBy("rank").collect()
    assert [row["projectId"] for row in shown] == ["l", "p0", "p1"]


def test_labels_and_detail(spark):
    rows = [opportunity(projectId="a", description=" 海岸带观测研习周 "), opportunity(projectId="b", description=" own text ", discoverySources=[("other-discovery", "x", "u")])]
    shown = {row["projectId"]: row for row in board.detail(opportunities(spark, rows)).collect()}
    assert shown["a"]["description"] == S.NO_DESCRIPTION and shown["a"]["officialUrl"] == "https://ocean.qingshi.example/notice/8"
    assert shown["b"]["description"] == "own text" and shown["b"]["officialUrl"] is None and shown["b"]["sourceLabel"] == S.HISTORICAL_SOURCE_LABEL


def test_tiers(spark):
    cases = [("北京大学", ["985", "TOP2"], None, ["TOP2"]), ("浙江大学", [], ["985", "C9", "华五"], ["华五"]),
             ("中国科学院软件研究所", [], None, ["研究院"]), ("未分类大学", [], None, []), ("某实验室", ["双非"], ["985"], ["双非"])]
    frame = spark.createDataFrame(cases, "name string, own array<string>, old array<string>, want array<string>")
    for row in frame.withColumn("got", catalog.tier_tags(F.col("name"), F.col("own"), F.col("old"))).collect():
        assert row["got"] == row["want"], row
