"""Operators on single documents against plain versions."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from tests.llm import samples
from tidemark.llm import bpe, decontamination, language_id, license_blocks, license_scan, packing, quality_rules, queries, token_counts, token_files, url_filter

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
FOLD = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def plain_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    found = defaultdict(list)
    for i in range(len(words) - 7):
        found[tuple(words[i:i + 8])].append(i)
    covered = {j for starts in found.values() if len(starts) > 1 for i in starts for j in range(i, i + 8)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.quality_report(samples.docs(spark)).collect())
    want = Counter()
    for doc_id, text, *_ in samples.rows():
        n = plain_quality(text)
        want[(doc_id, *n, n[0] < 20 or 100 * n[4] > 30 * n[0])] += 1
    assert got == want


def test_quality_lines(spark):
    text = "\n".join(["Home | News | Sport | More", samples.sentence(samples.random.Random(1), 60), "", "Skip to main content", "### ### ### ### ### ### ###"])
    docs = spark.createDataFrame([(1, text, 0), (2, "### $$$ ### $$$ ### $$$\n" * 30 + samples.sentence(samples.random.Random(2), 30), 0)], "doc_id long, text string, n_chars long")
    good = quality_rules.keep_good(docs).collect()
    assert [r.doc_id for r in good] == [1]
    assert good[0].text.split("\n")[1:] == [""] and good[0].n_chars == len(good[0].text)


def test_quality_keeps_columns(spark):
    docs = samples.docs(spark)
    good = quality_rules.keep_good(docs)
    assert good.columns == docs.columns and good.schema == docs.schema
    assert quality_rules.keep_good(samples.empty(spark)).count() == 0


def test_url_filter(spark):
    urls = [
        None, "", "no scheme", "http://", "https://A.Example.NET/EN/x", "https://example.net/en/1", "https://example.net/en", "http://b.net/", "http://b.net", "http://notexample.com/de/",
        "http://example.com/de/1?x=http://y.net/", "http://x.org/fr/#a", "http://org/fr/1", "http://free-bets.example.com/fr/", "http://www.free-bets.example.com/de/2", "http://u.free-bets.example.com",
        "ftp://a..net/x", "http://example.net:80/en/", "://net/q", "http://É.net/ü/",
    ]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls + urls[:3])], "page_id long, url string, host string")
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow", "b.net/pre": "allow"}
    listed = ("free-bets.example.com/", "b.net/pre")
    got = [(r.row.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, url_filter.entry_table(spark, rules, listed)).collect()]

    def plain(url):
        host, path = ("", "")
        if url and "://" in url:
            host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
            host = host.translate(FOLD)
        fits = [r for r in [*rules, *listed] for h, p in [(r[:r.index("/")], r[r.index("/"):])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max((r for r in fits if r in rules), key=len, default=None)
        return host, path, best, rules[best] if best else "block" if fits else "allow"

    assert sorted(got, key=str) == sorted(((i, *plain(u)) for i, u in enumerate(urls + urls[:3])), key=str)
    assert url_filter.allowed(pages, url_filter.entry_table(spark, {}, ())).count() == len(urls) + 3
    assert url_filter.filter_urls(pages.limit(0), url_filter.entry_table(spark, rules, listed)).count() == 0


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01", "sf0.1", "check_s", "check_l", "check_h"])
def test_listed_sites_are_blocked_at_every_scale(spark, scale):
    folder = f"/root/testdata/{scale}"
    if not os.path.isdir(folder):
        pytest.skip("scale not given")
    # in the given pages a hyphen in the host marks such a site; the one rule that allows more is about English paths
    bad = [r for r in queries.op2_url_filters(spark, folder).filter("host like '%-%'").select("host", "rule", "verdict").distinct().collect()]
    assert bad and all(r.verdict == ("block" if r.rule is None else queries.URL_RULES[r.rule]) for r in bad)
    made = spark.createDataFrame([(f"https://www.{r.host}/de/x",) for r in bad], "url string")
    judged = url_filter.filter_urls(made, url_filter.entry_table(spark, {}, queries.BLOCKED_HOSTS))
    assert [r.verdict for r in judged.collect()] == ["block"] * len(bad)


def test_url_digests_confirm_strings(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "_key", lambda entry: len(entry) % 2)
    shards = [("", "place", 0, 1, 3, ())]
    texts = [b"ab/", b"cdef/", b"abc/"]
    order = sorted(range(3), key=lambda i: len(texts[i]) % 2)
    monkeypatch.setitem(url_filter._OPEN, "place", (
        np.array([len(texts[i]) % 2 for i in order], dtype="<u8"), np.cumsum([len(texts[i]) for i in order]).astype("<u8"), np.array(order, dtype="u1"),
        np.frombuffer(b"".join(texts[i] for i in order), dtype="u1")))
    assert url_filter.lookup([b"ab/", b"zz/", b"cdef/", b"abc/", b"xyz/"], shards).tolist() == [0, -1, 1, 2, -1]


@pytest.fixture(scope="module")
def plain_ids():
    tokenizer = bpe.SegmentEncoder(BYTE_BPE).tokenizer
    return lambda text: np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, dtype="<u4")


def test_segments_give_the_ids_of_whole_texts(plain_ids):
    rng = samples.random.Random(4)
    parts = ["a", "b ", " ", "\n", "é", "日", "<|endoftext|>", "'s", "1", ",", " x", "\t", " ", " ", "!", "ab's"]
    odd = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(1500)] + [t or "" for t in samples.texts()]
    ids, numbers = bpe.SegmentEncoder(BYTE_BPE).encode(odd)
    ends = np.cumsum(numbers)
    assert all(np.array_equal(ids[e - n:e], plain_ids(t)) for t, e, n in zip(odd, ends, numbers))


def test_packing(spark, plain_ids):
    pieces = packing.pack(samples.docs(spark), BYTE_BPE, with_ids=True).collect()
    want = Counter()
    for doc_id, text, *_ in samples.rows():
        want[(doc_id, *plain_ids(text).tolist(), 1)] += 1
    tokens, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, dtype="<u4").tobytes()) and p.length == len(p.ids)
        tokens[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    assert sum(p.length for p in pieces) == sum((len(k) - 1) * n for k, n in want.items())
    single = {k[0]: k[1:] for k, n in want.items() if n == 1}
    for doc_id, ids in single.items():
        own = sorted(tokens[doc_id], key=lambda p: p.start)
        assert [x for p in own for x in p.ids] == list(ids) and all(p.doc_tokens == len(ids) for p in own)
    padding = 0
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= packing.WINDOW
        padding += packing.WINDOW - at
    assert padding <= 3 * packing.WINDOW
    assert packing.pack(samples.empty(spark), BYTE_BPE).count() == 0


def test_sum_of_squares_levels():
    packer, rng = packing.SumOfSquares(10), samples.random.Random(3)
    filled = defaultdict(int)
    for _ in range(500):
        size = rng.randint(1, 9)
        before = packer.counts.copy()
        sequence, offset = packer.place(size)
        assert filled[sequence] == offset
        filled[sequence] += size
        costs = {h: int(sum((before[1:10] - np.eye(11, dtype=int)[h][1:10] * (h > 0) + np.eye(11, dtype=int)[h + size][1:10]) ** 2)) for h in range(0, 11 - size) if h == 0 or before[h]}
        assert costs[offset] == min(costs.values())
    assert max(filled.values()) <= 10
    assert packer.holes == sum(10 - v for v in filled.values())


def test_pack_stream_is_whole_with_small_reserve():
    rng = samples.random.Random(9)
    docs = [(i, np.arange(rng.randint(1, 60), dtype=np.uint32)) for i in range(400)]
    seen, levels = defaultdict(list), defaultdict(int)
    for key, start, piece, n, sequence, offset in packing.pack_stream(iter(docs), 16, held=32):
        seen[key] += piece.tolist()
        levels[sequence] += len(piece)
    assert all(seen[k] == ids.tolist() for k, ids in docs)
    assert sum(16 - v for v in levels.values()) < 16


def test_token_counts(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    got = Counter((r.row.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(samples.docs(spark), PIECE_BPE).collect())
    want = Counter()
    for doc_id, text, *_ in samples.rows():
        n = len(sp.encode(text or ""))
        want[(doc_id, len((text or "").encode()), n, n > 4096)] += 1
    assert got == want
    assert token_counts.token_counts(samples.empty(spark), PIECE_BPE).count() == 0


@pytest.mark.parametrize("chunk,overlap", [(300, 8), (1000, 64), (2000, 16)])
def test_splices_agree_with_whole_texts(chunk, overlap):
    sp, stable = token_counts.load(PIECE_BPE)
    assert stable
    rng = samples.random.Random(chunk)
    odd = ["".join(rng.choice("ab  \n▁é日<s>. ") for _ in range(n)) for n in (400, 2500)] + ["a" * 3000, " " * 2500, "word  " * 900]
    for text in [*odd, *[t for t in samples.texts() if t]]:
        assert token_counts.count(sp, stable, text, chunk, overlap) == len(sp.encode(text))


def test_token_files(spark, plain_ids):
    manifest = token_files.write_files(samples.docs(spark), BYTE_BPE, row=64)
    got = sorted(token_files.read_files(manifest, samples.docs(spark).schema["doc_id"].dataType).collect(), key=lambda r: r.start)
    want = sorted(samples.rows(), key=lambda r: r[0])
    at = 0
    assert [r.doc_id for r in got] == [r[0] for r in want]
    for r, (_, text, *_) in zip(got, want):
        ids = np.append(plain_ids(text), 2).astype("<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    reader = token_files.open_file(*manifest.select("folder", "path").head())
    first = reader.get_batch(0)
    assert first.schema.field("input_ids").type.list_size == 64 and len(first.column("mask")[0]) == 64
    assert token_files.token_files(samples.empty(spark), BYTE_BPE).count() == 0


def test_language_id(spark):
    rng = samples.random.Random(6)
    speech = {"xx": "the and of ing tion er".split(), "yy": "der die und ung keit sch".split(), "zz": "el la ción ado que los".split()}
    rows = []
    for i in range(240):
        lang = ["xx", "yy", "zz"][i % 3]
        rows.append((i, " ".join("".join(rng.choice(speech[lang]) for _ in range(rng.randint(1, 3))) for _ in range(30)), lang if i % 5 else None))
    rows += [(1000, None, "xx"), (1001, "", "yy"), (1002, "123 !!", "zz"), (1003, "日", None), (1, rows[1][1], "yy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    from pyspark.sql import functions as F

    out = language_id.held_out(F.col("doc_id"))
    model = language_id.learn(docs, ~out)
    got = {r.row.doc_id: r for r in language_id.identify(docs.select("doc_id", "text"), model).collect()}
    assert len(got) == 244 and all(0 <= r.score <= 1 for r in got.values())
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002))
    right = [got[i].lang_pred == ["xx", "yy", "zz"][i % 3] for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(right) > 50 and sum(right) / len(right) > 0.97
    assert language_id.learn(docs.filter("false"), ~out) is None
    assert {r.lang_pred for r in language_id.identify(docs, None).collect()} == {"und"}
    assert language_id.identify(samples.empty(spark), model).count() == 0


def test_license_scan(spark):
    notice = "Licensed under the Apache License, Version 2.0."
    body = "\n".join(samples.sentence(samples.random.Random(i), 12) for i in range(4))
    files = [
        ("a/LICENSE", "Released under the MIT License.\n" + body), ("a/x/y/one.txt", body), ("a/x/two.txt", notice + "\n" + body), ("a/x/y/COPYING.txt", "Licensed under CC BY-NC 4.0."),
        ("a/x/y/z/three.txt", body), ("b/four.txt", body), ("five.txt", None), (None, notice), ("a/six.txt", ""), ("a/six.txt", ""), ("b/seven.txt", "This licence text says something else entirely, about gardens and driving."),
    ]
    docs = spark.createDataFrame([(p, t, "x") for p, t in files], "path string, text string, licence string")
    got = sorted(((r.row.path, r.own_licence, r.licence_file, r.licence, r.licence_from) for r in license_scan.scan(docs).collect()), key=str)
    want = [
        ("a/LICENSE", "MIT", True, "MIT", "own"), ("a/x/y/one.txt", None, False, "CC-BY-NC-4.0", "a/x/y"), ("a/x/two.txt", "Apache-2.0", False, "Apache-2.0", "own"),
        ("a/x/y/COPYING.txt", "CC-BY-NC-4.0", True, "CC-BY-NC-4.0", "own"), ("a/x/y/z/three.txt", None, False, "CC-BY-NC-4.0", "a/x/y"), ("b/four.txt", None, False, None, None),
        ("five.txt", None, False, None, None), (None, "Apache-2.0", True, "Apache-2.0", "own"), ("a/six.txt", None, False, "MIT", "a"), ("a/six.txt", None, False, "MIT", "a"),
        ("b/seven.txt", None, False, None, None),
    ]
    assert got == sorted(want, key=str)
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_license_headers_and_texts(spark):
    """Headers wrapped over lines of a comment, whole licence texts, and named licences beside "All rights reserved."."""
    gpl = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
    code = "\n".join("let %s;" % samples.sentence(samples.random.Random(i), 9) for i in range(60))
    holder = "Copyright (c) 2020, Some Body\nAll rights reserved.\n\n"
    texts = dict(license_blocks.full_texts())
    files = [("h/%d.c" % i, "/*\n" + "\n".join(" * " + line for line in gpl.split("\n")) + "\n */\n" + code, "GPL-3.0", False) for i in range(3)]
    files += [("t/%s/COPYING" % name, holder + text, name, True) for name, text in texts.items()]
    files += [("b/bsd.c", holder + texts["BSD-3-Clause"] + "\n" + code, "BSD-3-Clause", False), ("w/wrapped.txt", code + "\nLicensed under the Apache\nLicense, Version 2.0.", "Apache-2.0", False),
              ("r/own.txt", "All rights reserved.\n" + code, "AllRightsReserved", False), ("n/LICENSE", code, None, False),
              ("m/two.txt", "All rights reserved.\nReleased under the MIT License.\n" + code, "MIT", False)]
    docs = spark.createDataFrame([(p, t) for p, t, *_ in files], "path string, text string").repartition(3)
    got = {r.row.path: (r.own_licence, r.licence_file) for r in license_scan.scan(docs).collect()}
    assert got == {p: (name, own) for p, _, name, own in files}


def plain_contamination(text, items):
    def listed(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))

    words, hit, names = listed(text), set(), set()
    for item, own in items:
        own = listed(own)
        size = min(10, len(own))
        for k in range(len(own) - size + 1 if size else 0):
            for at in range(len(words) - size + 1):
                if words[at:at + size] == own[k:k + size]:
                    hit.update(range(at, at + size))
                    names.add("null" if item is None else str(item))
    return len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("bound", [decontamination.PASS_BYTES, 400])
def test_decontamination(spark, monkeypatch, bound):
    monkeypatch.setattr(decontamination, "PASS_BYTES", bound)
    rng = samples.random.Random(8)
    items = [(i, samples.sentence(rng, n)) for i, n in enumerate([30, 12, 10, 3, 1, 2])] + [(None, "larch Larch, LARCH larch"), (7, None), (8, " .. "), (1, "elm elm"), (9, samples.texts()[2][40:160])]
    rows = samples.rows()[:45] + [(900, "pre " + items[0][1].upper() + " post", None, None, 1, "", "", 1, True), (901, items[1][1] + "." + items[1][1], None, None, 1, "", "", 1, True)]
    docs = spark.createDataFrame(rows, samples.DOCS)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = Counter(tuple(r) for r in decontamination.contamination(docs, benchmark).collect())
    assert got == Counter((r[0], *plain_contamination(r[1], items)) for r in rows)
    clean = decontamination.clean(docs, benchmark)
    assert clean.columns == docs.columns and clean.count() == sum(not plain_contamination(r[1], items)[-1] for r in rows)
    assert decontamination.contamination(docs, benchmark.limit(0)).filter("contaminated").count() == 0
    assert decontamination.contamination(samples.empty(spark), benchmark).count() == 0
