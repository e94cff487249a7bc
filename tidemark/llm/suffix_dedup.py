"""Repeated byte strings over all documents, found by suffix sorting of shards, and their removal.

Every window of ``LENGTH`` bytes has one anchor: its smallest ``ANCHOR``-byte string by fingerprint, the first of equals.  Equal windows have equal
anchors, so windows may be dealt out by anchor.  Neighbouring windows with one anchor are a fragment: their bytes, cut once.

1. Anchors of one fragment are dropped where they lie.  An anchor whose fragments are all equal needs no sorting: all are repeats.
2. Of the other anchors each distinct fragment is sent once, by anchor, to a shard.  Parts that can have no equal there are left
   out; the suffixes of the rest are sorted by external induction; a window whose common prefix with a neighbour reaches ``LENGTH`` is a repeat.  The fragments of a shard
   are held in memory, only the arrays of the sort may lie in files.
3. The repeats found for a fragment hold for all places where it lies; a document's covered bytes are united and cut out.

A fragment found thousands of times is one row after the first partial aggregate, so copies meet in no task.

Defined results: a null text counts as empty; texts shorter than ``LENGTH`` have no windows; equal rows are repeats of each other; rows which
share an id are told apart by their texts; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import boxed, slices, written
from tidemark.llm.shingles import mix
from tidemark.llm.suffix_sort import Store, sort_suffixes

LENGTH, ANCHOR = 400, 64
#: Distances to the anchor that are looked at together before sorting.
BLOCK = 16
#: Window starts handled at once; longer documents are taken in parts that overlap.
TILE = 1 << 20
#: Bytes of fragments of a shard, on average.
SHARD_BYTES = 6 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(13).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def _power(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(14, n.bit_length())
        _powers[:] = [np.multiply.accumulate(np.append(np.uint64(1), np.full(size, b, dtype=np.uint64))) for b in (_BASE, _INVERSE)]
    return _powers


def anchor_runs(raw: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR):
    """(fingerprint of the anchor, first window start, number of windows, bytes from that start to the anchor) of each fragment."""
    for tile in range(0, len(raw) - length + 1, TILE):
        part = raw[tile:tile + TILE + length - 1]
        n = len(part)
        up, down = _power(n)
        sums = np.append(np.uint64(0), np.cumsum(_BYTES[part] * up[:n], dtype=np.uint64))
        grams = mix((sums[anchor:] - sums[:-anchor]) * down[:n - anchor + 1])
        packed = (grams & ~np.uint64(0xFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
        width, windows = length - anchor + 1, n - length + 1
        padded = np.full(-(-len(packed) // width) * width, np.uint64(2**64 - 1))
        padded[:len(packed)] = packed
        blocks = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        place = (np.minimum(back[:windows], ahead[width - 1:width - 1 + windows]) & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        yield from zip(grams[place[first]].view(np.int64).tolist(), (first + tile).tolist(), np.diff(np.append(first, windows)).tolist(), (place[first] - first).tolist())


def fragments_of(docs: DataFrame) -> DataFrame:
    """All fragments: anchor, digest (a, b) of the bytes, and where they lie."""

    def run(batches):
        for batch in slices(batches, "text"):
            out = []
            for doc, own, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "own", "text"))):
                data = text.encode()
                if len(data) < LENGTH:
                    continue
                for key, start, count, lead in anchor_runs(np.frombuffer(data, dtype=np.uint8)):
                    digest = hashlib.blake2b(data[start:start + count - 1 + LENGTH], digest_size=16).digest()
                    out.append((key, int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), doc, own, start, count, lead))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

    names = ["anchor", "a", "b", "doc_id", "own", "start", "windows", "lead"]
    return docs.select("doc_id", "own", "text").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def repeated_windows(pieces: list[bytes], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each piece, the ranges of starts of windows found elsewhere too, in it or in another piece."""
    sizes = np.array([len(p) + 1 for p in pieces], dtype=np.int64)
    store = Store()
    text = store.array(int(sizes.sum()) + 1, np.uint16)
    at = 0
    for piece in pieces:
        text[at:at + len(piece)] = np.frombuffer(piece, dtype=np.uint8).astype(np.uint16) + 2
        text[at + len(piece)] = 1
        at += len(piece) + 1
    suffixes, common = sort_suffixes(text, 258, store)
    marked = store.array(len(text), bool)
    for begin in range(0, len(suffixes), 1 << 20):
        end = min(begin + (1 << 20), len(suffixes))
        near = (np.array(common[begin:end]) >= length) | (np.array(common[begin + 1:end + 1]) >= length)
        marked[np.array(suffixes[begin:end])[near]] = True
    out, at = [], 0
    for size in sizes.tolist():
        inside = np.array(marked[at:at + max(0, size - length)])
        edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
        out.append(list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())))
        at += size
    return out


def shared_parts(pieces: list[tuple[int, int, int, bytes]]) -> list[tuple[int, int, int]]:
    """Of fragments (anchor, windows, lead, bytes), the runs of windows (fragment, first, number) that can have an equal one.

    Equal windows lie equally far before equal anchors.  Windows of one block of such distances have all bytes but a few in common;
    a block whose common bytes no other fragment has is left out.
    """
    owners: dict[tuple[int, int, int], list[tuple[int, int, int]]] = {}
    for i, (anchor, windows, lead, data) in enumerate(pieces):
        for block in range((lead - windows + 1) // BLOCK, lead // BLOCK + 1):
            at = lead - block * BLOCK
            core = xxhash.xxh3_64_intdigest(data[at:at + LENGTH - BLOCK + 1])
            owners.setdefault((anchor, block, core), []).append((i, max(0, at - BLOCK + 1), min(windows, at + 1)))
    runs: list[tuple[int, int, int]] = []
    for i, begin, end in sorted(x for group in owners.values() if len(group) > 1 for x in group):
        if runs and runs[-1][0] == i and runs[-1][1] + runs[-1][2] == begin:
            runs[-1] = (i, runs[-1][1], end - runs[-1][1])
        else:
            runs.append((i, begin, end - begin))
    return runs


def sorted_shards(pieces: DataFrame) -> DataFrame:
    """For fragments (anchor, a, b, copies, windows, lead, bytes): the ranges of their repeated windows."""

    def run(batches):
        rows, data = [], []
        for batch in batches:
            rows += list(zip(*(batch.column(c).to_pylist() for c in ("anchor", "a", "b", "copies", "windows", "lead"))))
            data += batch.column("bytes").to_pylist()
        if not rows:
            return
        runs = shared_parts([(r[0], r[4], r[5], d) for r, d in zip(rows, data)])
        ranges: dict[int, list[tuple[int, int]]] = {i: [(0, r[4])] for i, r in enumerate(rows) if r[3] > 1}
        if runs:
            for (i, first, _), found in zip(runs, repeated_windows([data[i][first:first + n - 1 + LENGTH] for i, first, n in runs])):
                if rows[i][3] == 1:
                    ranges.setdefault(i, []).extend((first + x, first + y) for x, y in found)
        out = [(*rows[i][:3], [x for x, _ in own], [y for _, y in own]) for i, own in ranges.items() if own]
        if out:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["anchor", "a", "b", "begins", "ends"])

    total = pieces.agg(F.sum(F.octet_length("bytes"))).head()[0] or 0
    shards = max(int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_BYTES))
    return pieces.repartition(shards, "anchor").mapInArrow(run, "anchor long, a long, b long, begins array<long>, ends array<long>")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, own, spans): the byte ranges covered by repeats, for documents that have some."""
    everywhere = written(fragments_of(docs), "dedup-fragments")
    anchors = everywhere.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("low"), F.max("a").alias("high")).filter("n > 1")
    shared = written(everywhere.join(anchors.select("anchor", (F.col("low") < F.col("high")).alias("mixed")), "anchor"), "dedup-shared")
    whole = shared.filter("not mixed").select("doc_id", "own", F.col("start").alias("begin"), (F.col("start") + F.col("windows") + (LENGTH - 1)).alias("end"))
    mixed = shared.filter("mixed")
    distinct = mixed.groupBy("anchor", "a", "b", "windows", "lead").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "own", "start")).alias("place"))
    wanted = distinct.groupBy(F.col("place.doc_id").alias("doc_id"), F.col("place.own").alias("own")).agg(
        F.collect_list(F.struct("anchor", "a", "b", "copies", "windows", "lead", F.col("place.start").alias("start"))).alias("cuts"))
    owners = docs.alias("d").join(wanted.alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.own") == F.col("w.own"))).select("text", "cuts")

    def cut(batches):
        for batch in slices(batches, "text", 1 << 20):
            out = []
            for text, cuts in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist()):
                data = text.encode()
                for c in cuts:
                    out.append((c["anchor"], c["a"], c["b"], c["copies"], c["windows"], c["lead"], data[c["start"]:c["start"] + c["windows"] - 1 + LENGTH]))
            if out:
                kinds = (pa.int64(),) * 6 + (pa.binary(),)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["anchor", "a", "b", "copies", "windows", "lead", "bytes"])

    pieces = written(owners.mapInArrow(cut, "anchor long, a long, b long, copies long, windows long, lead long, bytes binary"), "dedup-pieces")
    ranges = written(sorted_shards(pieces.dropDuplicates(["anchor", "a", "b"])), "dedup-ranges")
    partly = mixed.join(ranges, ["anchor", "a", "b"]).select("doc_id", "own", "start", F.explode(F.arrays_zip("begins", "ends")).alias("r")).select(
        "doc_id", "own", (F.col("start") + F.col("r.begins")).alias("begin"), (F.col("start") + F.col("r.ends") + (LENGTH - 1)).alias("end"))
    spans = whole.union(partly).groupBy("doc_id", "own").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    return written(spans, "dedup-spans")


def united(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for begin, end in sorted((s["begin"], s["end"]) for s in spans or ()):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [(a, b) for a, b in out]


def _cut(kind: pa.DataType, rest):
    """Column function of texts and spans: the united spans (``begins``, ``ends``) and what ``rest`` makes of the remaining bytes; null without spans."""
    fields = pa.struct([("begins", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("kept", kind)])

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans in batches:
            out = []
            for text, found in zip(texts, spans):
                if not found.is_valid:
                    out.append(None)
                    continue
                data, kept, at, runs = text.as_py().encode(), [], 0, united(found.as_py())
                for begin, end in runs:
                    kept.append(data[at:begin])
                    at = end
                out.append(([a for a, _ in runs], [b for _, b in runs], rest(b"".join([*kept, data[at:]]))))
            found = [pa.array([x and x[i] for x in out], fields[i].type) for i in range(3)]
            yield pa.StructArray.from_arrays(found, fields=list(fields), mask=pa.array([x is None for x in out], pa.bool_()))

    # not deterministic: else a filter on the result moves before it and cuts the texts a second time
    return F.arrow_udf(run, f"begins array<long>, ends array<long>, kept {'string' if pa.types.is_string(kind) else 'binary'}").asNondeterministic()


def _cut_out(docs: DataFrame, doc_id: str, text: str, cut) -> DataFrame:
    """Struct ``row`` of the input, its ``text`` (null: empty), ``n_bytes``, the removed runs (``begins``, ``ends``) and ``kept``, null where nothing is removed.

    A text goes through the last join once, inside its row, and to Python only if something is cut out of it.
    """
    base = boxed(docs, doc_id=doc_id, text=text).select(
        "row", F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("own", F.xxhash64("text"))
    spans = repeated_spans(base.select("doc_id", "own", "text"))
    both = base.drop("text").alias("d").join(spans.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.own") == F.col("s.own")), "left")
    whole = F.coalesce(F.col("row").getField(text), F.lit(""))
    found = both.select("row", whole.alias("text"), cut(F.when(F.col("spans").isNotNull(), whole), F.col("spans")).alias("cut"))
    none = F.array().cast("array<long>")
    return found.select("row", "text", F.octet_length("text").cast("long").alias("n_bytes"), F.coalesce("cut.begins", none).alias("begins"), F.coalesce("cut.ends", none).alias("ends"), F.col("cut.kept").alias("kept"))


def cut_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Struct ``row`` of the input, ``n_bytes``, the removed runs (``begins``, ``ends``) and the remaining bytes (``kept``)."""
    found = _cut_out(docs, doc_id, text, _cut(pa.binary(), bytes))
    return found.select("row", "n_bytes", "begins", "ends", F.coalesce("kept", F.col("text").cast("binary")).alias("kept"))


def _removed() -> Column:
    """Number of bytes in the removed runs."""
    return F.aggregate(F.zip_with("begins", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda n, x: n + x)


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: its bytes, how many were removed in how many runs, the digest of the rest, and whether anything was removed."""
    found = cut_repeats(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_bytes", _removed().alias("n_removed"), F.size("begins").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), (_removed() > 0).alias("has_repeats"))


def _decoded(data: bytes) -> str:
    return data.decode("utf-8", "ignore")


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: str = "n_chars") -> DataFrame:
    """The documents with all their columns, repeats cut out of their texts; ``length`` follows.

    A character of which a cut leaves only some bytes is left out.  A document that was nothing but repeats goes.
    """
    found = _cut_out(docs, doc_id, text, _cut(pa.string(), _decoded))
    plain = found.filter((F.size("begins") == 0) | (_removed() < F.col("n_bytes"))).select("row", F.col("kept").isNotNull().alias("changed"), "kept")
    columns = []
    for name in docs.columns:
        column = F.col("row")[name]
        if name == text:
            column = F.when(F.col("changed"), F.col("kept")).otherwise(column)
        elif name == length:
            column = F.when(F.col("changed"), F.length("kept").cast(docs.schema[name].dataType)).otherwise(column)
        columns.append(column.alias(name))
    return plain.select(*columns)
