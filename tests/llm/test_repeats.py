"""Joins and repeats over all documents against plain versions, and the pipeline."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from checks.compare import compare, open_tables
from tests.llm import samples
from tidemark.llm import ngram_join, queries, suffix_dedup, suffix_sort
from tidemark.llm.components import components
from tidemark.llm.common import table

SF = "/root/testdata/sf0.001"
FOLD = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def roots(pairs, nodes):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def plain_components(rows):
    sets = {}
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
        sets[doc_id] = {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    found = roots(links, ids)
    return {i: (len(sets[i]), found[i]) for i in ids}


def chains(seed):
    """Chains of near copies: neighbours link, ends do not; and texts just below and above the threshold."""
    rng = random.Random(seed)
    out, words = [], ["c%d" % i for i in range(60)]
    for step in range(25):
        out.append(" ".join(words))
        words[rng.randrange(60)] = "s%d" % step
    return out


def test_ngram_join(spark, monkeypatch):
    rows = [(r[0], r[1]) for r in samples.rows()] + [(500 + i, t) for i, t in enumerate(chains(1) + chains(1)[:3] + ["A b c", "a  B\tc", "a b"])]
    without = [(None, "a text of its own that no other row is like"), (None, None)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows + without], "doc_id long, text string, a string, n int").repartition(3)
    want = plain_components(rows)
    for counters, partners in ((1 << 10, 3), (1 << 14, ngram_join.PARTNERS)):
        monkeypatch.setattr(ngram_join, "PARTNERS", partners)
        got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_components(docs, fragments=3, counters=counters).collect())
        assert got == Counter((i, *want[i]) for i, _ in rows) + Counter([(None, 7, None), (None, 0, None)])
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted([(False, i) for i, (_, c) in want.items() if i == c] + [(True, 0)] * 2)
    assert ngram_join.near_components(docs.limit(0)).count() == 0


def test_texts_without_an_id_link_nothing(spark):
    """A text without an id shares rare shingles with documents that do not link, and is the nearest of one that has a link."""
    a, b, c = (" ".join("%s%d" % (x, i) for i in range(60)) for x in "abc")
    near = a.replace("a59", "z")
    between = " ".join(a.split()[:30] + b.split()[:30])
    rows = [(1, a), (2, b), (3, near), (4, c)] + [(10 + i, between.replace("b29", "y%d" % i).replace("a0 ", "x%d " % i)) for i in range(2)]
    without = [(None, between), (None, a + " q"), (None, " ".join(b.split()[:30] + c.split()[:30])), (None, near + " q")]
    docs = spark.createDataFrame(rows + without, "doc_id long, text string").repartition(2)
    want = plain_components(rows)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_components(docs, fragments=3).collect())
    assert got == Counter((i, *want[i]) for i, _ in rows) + Counter((None, len(t.split()) - 4, None) for _, t in without)


@pytest.mark.parametrize("nodes, listed", [(6, 1 << 20), (1 << 20, 40)])
def test_lists_with_one_first_node_are_split(spark, monkeypatch, nodes, listed):
    """Pairs of blocks give the counts of the whole, and no task gets more nodes than two blocks have."""
    rng = np.random.default_rng(3)
    sizes = rng.integers(40, 90, 50)
    rows = [(7, s, int(sizes[i]), i, i % 45, int(5 * (i % 9)), int(sizes[i]) * (9 if i % 4 else 3) // 10) for i in range(50) for s in sorted(set(rng.integers(0, 30, 12).tolist()))]
    rows += [(8, s, 50, i, i, 3, 50) for i in range(100, 103) for s in (1, 2)]
    lists = spark.createDataFrame([tuple(int(x) for x in r) for r in rows], "leader long, shingle long, n int, rep long, component long, last long, most long")

    def counts(frame):
        return Counter(tuple(r) for r in frame.repartition("meeting").sortWithinPartitions("meeting").mapInArrow(ngram_join.pair_counts, ngram_join.PAIR_COUNTS).collect())

    whole = ngram_join.counting_groups(lists)
    assert whole.select("meeting").distinct().count() == 2
    want = counts(whole)
    monkeypatch.setattr(ngram_join, "NODES", nodes)
    monkeypatch.setattr(ngram_join, "LISTED", listed)
    split = ngram_join.counting_groups(lists)
    held = defaultdict(set)
    for r in split.select("meeting", "rep").distinct().collect():
        held[r.meeting].add(r.rep)
    assert len(held) > 10 and max(map(len, held.values())) < 30
    assert counts(split) == want and len(want) > 100


def test_sketches_rule_out_no_link():
    """Sets that link have slack, whatever their sizes; sets far below the threshold have none."""
    rng = np.random.default_rng(5)
    for n in (1, 2, 30, 100, 1000, 20000):
        base = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64) * np.uint64(2)
        sets = [np.unique(np.concatenate([base[k:n], base[n:n + max(1, round(n * share))]])) for k in (0, n // 20, n // 10, n // 4) for share in (0, 0.05, 0.11, 0.2, 0.5)]
        sets = [s for s in sets if len(s)]
        every = ngram_join.Sketches([ngram_join.sketch(s) for s in sets])
        sizes = np.array([len(s) for s in sets])
        u, v = (x.ravel() for x in np.indices((len(sets), len(sets))))
        found = ngram_join.slack(every, sizes, every, sizes, u, v)
        shared = np.array([len(np.intersect1d(sets[i], sets[j])) for i, j in zip(u, v)])
        united = sizes[u] + sizes[v] - shared
        assert (found[100 * shared >= 80 * united] >= 0).all()
        assert n < 100 or (found[100 * shared < 70 * united] < 0).mean() > 0.9


def test_heavily_edited_copies_are_no_pairs(spark, monkeypatch):
    """Copies of one text that are edited too much to link share many shingles; their number of pairs is not written out."""
    rng = random.Random(6)
    base = ["w%d" % i for i in range(300)]
    rows = []
    for i in range(120):
        words = list(base)
        for k in rng.sample(range(300), 8):
            words[k] = "e%d" % rng.randrange(40)
        rows.append((i, " ".join(words)))
    made = []
    held = ngram_join.written

    def counted(frame, what):
        out = held(frame, what)
        made.append((what, out.count()))
        return out

    monkeypatch.setattr(ngram_join, "written", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = plain_components(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_components(docs, fragments=3).collect()} == want
    pairs = sum(n for what, n in made if what in ("join-first-sketched", "join-nearest", "join-second"))
    assert len({c for _, c in want.values()}) > 60 and pairs < 600


def test_threshold_bounds():
    for a in range(1, 60):
        for b in range(1, a + 1):
            least = next(k for k in range(0, a + b + 1) if 100 * k >= 80 * (a + b - k))
            assert ngram_join.least_overlap(a, b) == least
        assert ngram_join.prefix_length(a) == a - -(-80 * a // 100) + 1


def test_overlap_by_fragments():
    rng = np.random.default_rng(2)
    for _ in range(200):
        pool = rng.integers(0, 1 << 63, 60, dtype=np.uint64) * np.uint64(2)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 50))) for _ in range(2))
        shared = len(np.intersect1d(a, b))
        assert all(ngram_join.overlap_at_least(a, b, k) == (shared >= k) for k in range(0, 50))


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1080)] + [(5000, x) for x in range(5001, 5100)]
    pairs = [(min(p), max(p)) for p in pairs if p[0] != p[1]]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "u long, v long").repartition(6)).collect()}
    assert got == roots(pairs, {x for p in pairs for x in p})
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("on_disk", [False, True])
def test_suffix_sorting(monkeypatch, on_disk):
    if on_disk:
        monkeypatch.setattr(suffix_sort, "DIRECT", 0)
        monkeypatch.setattr(suffix_sort, "IN_MEMORY", 8)
        monkeypatch.setattr(suffix_sort, "RUN", 16)
    rng = random.Random(on_disk)
    for _ in range(250):
        letters = rng.choice([1, 2, 3, 5, 40])
        text = [rng.randint(1, letters) for _ in range(rng.randint(0, 90))]
        text = text * rng.randint(1, 2) + text[:6] + [0]
        order = sorted(range(len(text)), key=lambda i: text[i:])
        common = [0]
        for i, j in zip(order, order[1:]):
            n = 0
            while i + n < len(text) and j + n < len(text) and text[i + n] == text[j + n]:
                n += 1
            common.append(min(n, suffix_sort.CAP))
        found, lengths = suffix_sort.sort_suffixes(np.array(text, dtype=np.uint16), letters + 1, suffix_sort.Store())
        assert list(found) == order and list(lengths[:len(text)]) == common


def plain_repeats(rows, length=suffix_dedup.LENGTH):
    data = [(i, (t or "").encode()) for i, t in rows]
    found = Counter(raw[k:k + length] for _, raw in data for k in range(len(raw) - length + 1))
    out = Counter()
    for i, raw in data:
        covered = np.zeros(len(raw), dtype=bool)
        for k in range(len(raw) - length + 1):
            if found[raw[k:k + length]] > 1:
                covered[k:k + length] = True
        runs = int(np.count_nonzero(np.diff(np.concatenate([[0], covered.astype(np.int8)])) == 1))
        out[(i, len(raw), int(covered.sum()), runs, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~covered])).hexdigest())] += 1
    return out


def overlapping(seed):
    """Texts that share pieces of all lengths around the limit, at all offsets, some of them twice in one text."""
    rng = random.Random(seed)
    source = "".join(rng.choice("abcdefgh é") for _ in range(3000))
    out = []
    for _ in range(40):
        parts = []
        for _ in range(rng.randint(1, 3)):
            at, n = rng.randrange(2400), rng.choice([350, 399, 400, 401, 450, 600])
            parts += [source[at:at + n], "".join(rng.choice("xyz") for _ in range(rng.randint(0, 30)))]
        out.append("".join(parts))
    return out


def test_suffix_dedup(spark, monkeypatch):
    rows = [(r[0], r[1]) for r in samples.rows()] + [(700 + i, t) for i, t in enumerate(overlapping(1))] + [(700, "another text under an id in use")]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, n_chars long, own string").repartition(3)
    found = suffix_dedup.report(docs).collect()
    assert Counter(tuple(r)[:5] for r in found) == plain_repeats(rows) and all(r.has_repeats == (r.n_removed > 0) for r in found)
    clean = suffix_dedup.without_repeats(docs)
    assert clean.columns == docs.columns
    assert suffix_dedup.report(docs.limit(0)).count() == 0


def test_only_cut_texts_go_to_python(spark):
    """The last step sends no row and no whole text through Python, and texts with repeats once."""
    shared = "é" * 250
    rows = [(1, "a" + shared + "b"), (2, "ab" + shared), (3, shared), (4, None), (5, "é alone"), (6, shared[:-1])]
    docs = spark.createDataFrame([(i, t, None if t is None else len(t), "x") for i, t in rows], "doc_id long, text string, n_chars long, spans string").repartition(3)
    clean = suffix_dedup.without_repeats(docs)
    for frame in (clean, suffix_dedup.report(docs)):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" not in plan and plan.count("ArrowEvalPython") == 1
    assert sorted(tuple(r) for r in clean.collect()) == [(1, "ab", 2, "x"), (2, "ab", 2, "x"), (4, None, None, "x"), (5, "é alone", 7, "x")]


def test_anchors_do_not_depend_on_tiles(monkeypatch):
    raw = np.frombuffer(("".join(overlapping(2)) * 2).encode(), dtype=np.uint8)
    whole = list(suffix_dedup.anchor_runs(raw))
    monkeypatch.setattr(suffix_dedup, "TILE", 1000)
    parts = list(suffix_dedup.anchor_runs(raw))
    by = lambda runs: {s + k: (a, lead - k) for a, s, n, lead in runs for k in range(n)}
    assert by(whole) == by(parts) and len(by(whole)) == len(raw) - suffix_dedup.LENGTH + 1


def test_queries_match_their_sql(spark):
    con = open_tables(SF)
    for name, sql in queries.SQL.items():
        assert compare(spark, con, queries.QUERIES[name], sql, SF) is None


def test_every_query_runs(spark):
    for name, query in queries.QUERIES.items():
        frame = query(spark, SF)
        assert frame.count() > 0, name


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.written(stage(spark, docs, SF), "test-" + name)
        kept[name] = docs
        if name != "packing":
            assert docs.columns == table(spark, SF, "documents").columns
            assert docs.join(before.select("doc_id"), "doc_id", "left_anti").count() == 0
    after = [(r.doc_id, r.text) for r in kept["quality_rules"].collect()]
    assert {r.doc_id for r in kept["ngram_join"].collect()} == {i for i, (_, c) in plain_components(after).items() if i == c}
    before = [(r.doc_id, r.text) for r in kept["ngram_join"].collect()]
    assert sum(len(r.text.encode()) for r in kept["suffix_dedup"].collect()) == sum(n - removed for _, n, removed, *_ in plain_repeats(before).elements())
    assert {r.doc_id for r in kept["packing"].collect()} == {r.doc_id for r in kept["decontamination"].collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_join", "suffix_dedup", "decontamination", "packing"]
