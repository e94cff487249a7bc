from pyspark.sql import functions as F

from tidemark.functions import facts, privacy, text, urls
from tidemark.schema import DENIED_OFFICIAL_HOSTS


def values(spark, items, build):
    frame = spark.createDataFrame([(i, item) for i, item in enumerate(items)], "i int, t string")
    return [row["got"] for row in frame.withColumn("got", build(F.col("t"))).orderBy("i").collect()]


def test_trim_and_collapse(spark):
    assert values(spark, ["\u3000a\u00a0", " \ufeff", "a\u2028", None], text.trim_u) == ["a", "", "a", None]
    assert values(spark, [" a \u3000\n b ", "\u00a0"], text.collapse_spaces) == ["a b", ""]


def test_keys(spark):
    keys = ["2027|a|b|c", " 2027 | a|b |c", "2027|a||c", "2027|a|\u3000|c", "2027|a|b", "2027|a|b|c|d", "20x7|a|b|c", None]
    assert values(spark, keys, text.key_is_valid) == [True, True, False, False, False, False, False, None]
    assert values(spark, keys[:2], text.key_institute) == ["b", "b"]


def test_paths_and_lists(spark):
    assert values(spark, ["name", "$x", "a b", 'q"', "9"], lambda k: text.child_path(F.lit("p"), k)) == [
        "p.name", "p.$x", 'p["a b"]', 'p["q\\""]', 'p["9"]']
    assert values(spark, ["a, b,,a ", "", None], text.split_list) == [["a", "b", "a"], [], []]
    assert values(spark, ["online,x, online,hybrid"], lambda v: text.enum_list(v, ("online", "hybrid"))) == [["online", "hybrid"]]
    assert values(spark, ["清华大学Tsinghua/985", "MIT", "北京（大学） x"], text.leading_cjk) == ["清华大学", "MIT", "北京（大学）"]
    assert values(spark, ["某大学（深圳）", "某大学(a)", "某大学"], text.without_bracket_suffix) == ["某大学"] * 3


def test_url_normalisation(spark):
    cases = {
        "HTTPS://Ocean.QINGSHI.example/Recruit/week/": "https://ocean.qingshi.example/Recruit/week",
        "https://ocean.qingshi.example./a#frag": "https://ocean.qingshi.example/a",
        "http://a.example:80": "http://a.example/", "https://a.example:443/": "https://a.example/",
        "http://a.example:443/x": "http://a.example:443/x", "https://a.example/?b=2&a=1&b=1": "https://a.example/?a=1&b=2&b=1",
        "https://a.example?": "https://a.example/", "https://a.example/?q": "https://a.example/?q=",
        "https://a.example/?x=1&x-y=2": "https://a.example/?x=1&x-y=2", "https://a.example/?q=a%20b&p=c+d": "https://a.example/?p=c+d&q=a+b",
        "ftp://a.example/": None, "https://u:p@a.example/": None, "https://@a.example/x": "https://a.example/x",
        "https:///x": None, "not a url": None, "https://a.example:99999/": None, "https://a b/": None,
    }
    assert values(spark, list(cases), urls.normalise_url) == list(cases.values())


def test_denied_hosts(spark):
    cases = ["https://github.com/x", "https://GITHUB.com./x", "https://docs.github.com", "https://notgithub.com", "https://github.com.evil.example",
             "https://u@github.com:443/x", "https://a.example/github.com"]
    want = [True, True, True, False, False, True, False]
    assert values(spark, cases, lambda url: urls.is_denied_host(url, DENIED_OFFICIAL_HOSTS)) == want
    assert values(spark, ["a.b.c"], urls.host_suffixes) == [["a.b.c", "b.c", "c"]]


def test_private_free_text(spark):
    private = ["/Users/noor/kept/back.md", "look in /home/noor/q", "(/etc/hosts)", "C:\\Users\\x", "\\\\server\\share", "targets/submitted",
               "file:///x", "profile_space", "submittedIds", "PRIVATE_X", "/work/notes.md", "https://u@a.example/home/x/y", "//cdn/x/y.js"]
    public = ["https://a.example/home/x/notes.md", "a/b", "/srv", "and/or", "线下，北京", "2026/07/20", "/学院/通知"]
    assert values(spark, private, facts.has_private_free_text) == [True] * len(private)
    assert values(spark, public, facts.has_private_free_text) == [False] * len(public)


def test_evidence_phrases(spark):
    unverified = ["未确认宿舍", "名额待核实", "未明确要求成绩单", "名额以官方报名系统为准", "清单以学院报名系统要求为准", "格式请以系统为准"]
    unpublished = ["未要求或未在附件中列出", "未在官网要求成绩单", "未提及餐食", "后续通知为准"]
    assert values(spark, unverified, facts.is_unverified) == [True] * len(unverified)
    assert values(spark, unpublished, facts.is_not_published) == [True] * len(unpublished)
    assert values(spark, ["未要求推荐信", "官网下载"], facts.is_unverified) == [False, False]
    assert values(spark, ["未要求推荐信"], facts.is_not_published) == [False]


def test_private_kinds_under_all_spellings(spark):
    mail, phone, uri, path, marker = [label for label, _ in privacy.DETECTORS]
    cases = {
        "写信到 rowan.elm@post.example": mail, "写信到 rowan.elm＠post.example": mail, "a%2540example.com": mail, "a%40example.com": mail,
        "致电 159-2604-7713": phone, "致电 １５９２６０４７７１３": phone, "致电 +8615926047713": phone, "致电 +86 159 2604 7713": phone,
        "致电 %2B8615926047713": phone, "/Users/noor/sheet.json": path, "/home/noor/sheet.json": path,
        "D:\\Users\\Noor\\sheet.json": path, "file:///Users/noor/sheet.json": uri, "x welfareScore y": marker, "targets/submitted/x": marker,
        "99159260477131234": None, "mywelfareScores": None, "100% 免费 %zz": None, "plain": None,
    }
    frame = spark.createDataFrame([(case,) for case in cases], "t string")
    assert {row["t"]: row["kind"] for row in privacy.with_private_kind(frame, "t").collect()} == cases
    spelled = values(spark, ["a％41", "plain", "%zz"], privacy.text_variants)
    assert spelled == [["a％41", "a%41", "aA"], ["plain"], ["%zz"]]


def test_reviewed_contacts(spark):
    lines = ["mail admissions@pjlab.org.cn now", "xadmissions@pjlab.org.cn", "admissions@pjlab.org.cn and a@b.example", "tel 13800138000",
             "id 4413800138000123", "/home/me/x and a@b.example"]
    assert values(spark, lines, privacy.corpus_kinds) == [[], ["contact"], ["contact"], ["contact"], [], ["private", "contact"]]


def test_diagnostics(spark):
    assert values(spark, ["a\tb\x7f" + "c" * 600], text.diagnostic_text) == ["a b " + "c" * 496]
