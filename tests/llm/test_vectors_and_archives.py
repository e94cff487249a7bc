"""Vector search, clustering and archives against plain versions."""

import gzip
import hashlib
import io
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import centroids, hard_negatives, vectors, warc
from tidemark.llm.queries import QUERIES

ROWS = "vec_id long, embedding array<double>, label int, query string, id string, vector int, anchor int, score int"


def vector_rows(seed=3, n=900, dims=6):
    """Clustered vectors of all lengths with nulls, copies, ties, ragged and hostile ones."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, dims))
    out = []
    for i in range(n):
        v = centres[i % 9] * (0.1 + (i % 13)) + rng.normal(size=dims) * 0.05
        out.append((i, v.tolist(), int(rng.integers(0, 4))))
    out += [(1000 + i, out[20][1], i % 3) for i in range(60)]
    out += [(None, out[1][1], 1), (1100, None, 1), (1101, [1.0, None, 2.0], 1), (1102, [math.nan] * dims, 1), (1103, [math.inf, 1.0], 2), (1104, [1e30] * dims, 1)]
    out += [(1200, [0.5, 0.25], 1), (1300, [], 2), (1400, [0.0] * dims, 1), (1500, [3.0] * (dims + 3), 2), (1501, out[5][1], None)]
    out += [out[100], out[100], out[7], out[300]]
    return [(*r, "q", "i", 7, 1, 2) for r in out]


def whole(rows, scale, labelled=True):
    for vec_id, v, label, *_ in rows:
        if v is not None and all(x is not None and math.isfinite(x) and abs(x * scale) < vectors.LARGEST for x in v) and not (labelled and (label is None or vec_id is None)):
            yield vec_id, [math.floor(x * scale) for x in v], label


def plain_negatives(rows, every, scale=256, positives=5, negatives=10):
    kept, out = list(whole(rows, scale)), Counter()
    for a, va, la in kept:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, vb)), b, lb) for b, vb, lb in kept if b != a)
        for s, p, _ in [x for x in scored if x[2] == la][:positives]:
            fit = [x for x in scored if x[2] != la and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            for rank, (t, b, _) in enumerate(fit, 1):
                out[(a, p, rank, b, -s, -t)] += 1
    return out


@pytest.mark.parametrize("sizes", [(1 << 22, 4096, 1 << 15, 4096), (600, 16, 40, 20)])
def test_hard_negatives(spark, monkeypatch, sizes):
    for name, size in zip(("TILE", "BUCKET", "BLOCK", "SAMPLE"), sizes):
        monkeypatch.setattr(hard_negatives, name, size)
    rows = vector_rows()
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    got = Counter(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 50 == 0).collect())
    assert got == plain_negatives(rows, 50) and got


def test_hard_negatives_without_rows(spark):
    none = spark.createDataFrame([], ROWS)
    assert hard_negatives.mine(none, F.col("vec_id") % 2 == 0).count() == 0
    some = spark.createDataFrame(vector_rows()[:20], ROWS)
    assert hard_negatives.mine(some, F.lit(None).cast("boolean")).count() == 0


def test_ranges_lose_no_row_and_narrow():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 8))
    rows = np.rint((centres[rng.integers(0, 40, 5000)] + rng.normal(size=(5000, 8)) * 0.05) * 300).astype(np.int32)
    index = hard_negatives.buckets_of(rows, np.arange(5000), np.zeros(5000, np.int64))
    assert all(b.longest * hard_negatives.RATIO <= np.linalg.norm(b.vectors.astype(float), axis=1).min() + 1e-6 for b in index)
    seen = 0
    for query in rows[:40]:
        size = np.linalg.norm(query)
        least = 0.9 * size * size
        for bucket in index:
            cosine = np.array([least / (size * bucket.longest)])
            if cosine[0] > 1:
                continue
            focus, first, behind = hard_negatives.feasible(bucket, query[None] / size, cosine)
            found = set(range(len(bucket.ids)))
            for f, a, b in zip(focus[0], first[0], behind[0]):
                found &= set(bucket.order[f, a:b].tolist())
            good = set(np.flatnonzero(bucket.vectors.astype(np.int64) @ query >= least).tolist())
            assert good <= found
            seen += len(bucket.ids) - len(found)
    assert seen > 40 * 1500


def plain_clusters(rows, dims, k, rounds, scale=64):
    points = [(i, v) for i, v, _ in whole(rows, scale, labelled=False) if len(v) == dims]
    first = sorted(points, key=lambda p: (p[0] is None, hashlib.sha256(f"1:{p[0]}".encode()).hexdigest() if p[0] is not None else "", p[1]))
    centres = [list(v) for _, v in first[:k]]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, v in points:
            groups.setdefault(nearest(v)[1], []).append(v)
        for n, vs in groups.items():
            centres[n] = [sum(x) // len(vs) for x in zip(*vs)]
    found = [(i, *nearest(v)) for i, v in points]
    of = Counter()
    for _, d, n in found:
        of[n] += d
    return Counter((i, n, d, of[n], sum(of.values()), hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest()) for i, d, n in found)


@pytest.mark.parametrize("k, pivots", [(16, 8), (3, 2), (16, 1), (5, 30)])
def test_clusters(spark, k, pivots):
    rows = vector_rows(seed=k)
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    got = Counter(tuple(r) for r in centroids.cluster(df, dims=6, k=k, pivots=pivots).collect())
    assert got == plain_clusters(rows, 6, k, 3)


def test_few_and_no_vectors(spark):
    same = [(i, [1.0, -2.0], 0, "", "", 0, 0, 0) for i in range(4)]
    df = spark.createDataFrame(same, ROWS)
    assert Counter(tuple(r) for r in centroids.cluster(df, dims=2).collect()) == plain_clusters(same, 2, 16, 3)
    for none in (df, spark.createDataFrame([], ROWS)):
        found = centroids.cluster(none, dims=64)
        assert found.collect() == [] and found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_projection_bounds_hold_and_filter():
    rng = np.random.default_rng(2)
    base = rng.integers(-64, 64, (16, 64))
    rows = base[rng.integers(0, 16, 3000)] + rng.integers(-6, 7, (3000, 64))
    simplex = centroids.Simplex(base, 8)
    apexes, points = (simplex.project(centroids.squared(x, simplex.pivots)) for x in (rows, base))
    true = centroids.squared(rows, base)
    low = ((apexes[:, None] - points[None]) ** 2).sum(axis=2)
    high = low + 4 * apexes[:, None, -1] * points[None, :, -1]
    assert (low <= true + 1e-3).all() and (true <= high + 1e-3).all()
    fine = centroids.possible(apexes, points)
    assert fine[np.arange(len(rows)), true.argmin(axis=1)].all() and fine.mean() < 0.5
    assert len(centroids.Simplex(np.repeat(base[:1], 5, axis=0), 8).pivots) == 1


PAGES = "page_id long, url string, html string, row string, digest string, first int, copies int"


def page_rows():
    rng = random.Random(4)
    long = ["".join(rng.choice("abc <>é日\r\n") for _ in range(n)) for n in (999, 1000, 1200, 5000)]
    htmls = [None, "", "x", "\r\n\r\n", "WARC/1.1\r\n\r\n", "é" * 500, "é" * 499, "z" * 300_000] + long
    out = [(i, f"http://h{i}.example/é?q=a b\r\nX: {i}", h) for i, h in enumerate(htmls * 3)]
    out += [(500, None, long[3]), (500, "http://other/", long[3]), (None, "http://n/", long[3]), (None, None, "q" * 2000), (None, "u", "q" * 2000), (7, "", None)]
    return [(*r, "r", "d", 1, 2) for r in out]


def plain_pages(rows):
    newest, out = {}, Counter()
    for page_id, _, html, *_ in rows:
        if page_id is not None:
            newest[html or ""] = max(page_id, newest.get(html or "", page_id))
    for page_id, _, html, *_ in rows:
        data, head = (html or "").encode(), newest.get(html or "")
        again = len(data) >= 1000 and head is not None and page_id != head
        out[(page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", head if again else None, None)] += 1
    return out


@pytest.mark.parametrize("file_bytes", [256 << 20, 2000])
def test_archives_round_trip(spark, file_bytes):
    rows = page_rows()
    df = spark.createDataFrame(rows, PAGES).repartition(3)
    manifest = warc.write_archives(df, file_bytes=file_bytes)
    found = warc.read_archives(manifest, keep_payload=True).filter("record_type <> 'warcinfo'").collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.problem) for r in found) == plain_pages(rows)
    assert manifest.agg(F.sum("n_records")).head()[0] == len(rows)
    of = {(p, hashlib.sha1((h or "").encode()).hexdigest()): (h or "").encode() for p, _, h, *_ in rows}
    assert all(bytes(r.payload) == (of[r.page_id, r.payload_digest] if r.record_type == "response" else b"") for r in found)
    # any gzip reader sees the same records one behind the other
    text = gzip.open(manifest.head().path).read()
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and text.endswith(b"\r\n\r\n")


def test_no_pages(spark):
    assert warc.archived_pages(spark.createDataFrame([], PAGES)).count() == 0


def read(data):
    return [(r[0], r[2], r[3], r[5]) for r in warc.read_records(io.BytesIO(data))]


def test_damaged_archives():
    def page(text):
        return warc.page_record(1, "http://a/", text, hashlib.sha1(text).hexdigest(), len(text), None, "2020-01-01T00:00:00Z")

    one, two = page(b"first" * 9), page(b"second")
    sound = read(one + two)
    assert [r[3] for r in sound] == [None, None] and sound[1][0] == len(one) and sound[0][1] == 45
    assert read(one + two[:-9])[-1][3] == "the file ends inside a member"
    assert "digest" in read(warc.page_record(1, "u", b"abc", hashlib.sha1(b"abd").hexdigest(), 3, None, "d"))[0][3]
    plain = gzip.decompress(one)
    for wrong in (plain.replace(b"Content-Length: 11", b"Content-Length: 12"), plain.replace(b"WARC/1.1", b"WARC-1.1"), plain[:-2], plain + b"x", plain.replace(b"Content-Length: 1", b"Content-Length: -1", 1), b"WARC/1.1\r\n" + b"a: b\r\n" * 300_000):
        if wrong != plain:
            assert read(gzip.compress(wrong) + two)[0][3], wrong[:80]
    assert read(b"no archive")[0][3] and read(b"") == []


def test_long_payload_is_read_in_little_memory():
    import tracemalloc

    data = warc.page_record(1, "u", b"0" * (64 << 20), hashlib.sha1(b"0" * (64 << 20)).hexdigest(), 64 << 20, None, "d")
    tracemalloc.start()
    assert read(data)[0][1] == 64 << 20
    assert tracemalloc.get_traced_memory()[1] < 8 << 20
    tracemalloc.stop()


def test_queries_are_registered():
    assert {"op11_hard_negatives", "op12_centroid_clustering", "op13_warc"} <= set(QUERIES)
