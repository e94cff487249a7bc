"""URL filter over sorted digest arrays: memory-mapped 64-bit keys, vectorised binary search, full strings against collisions.

An entry is ``host/path``: it fits a URL whose host is that host or a subdomain of it and whose path starts with that path.  Entries are
written as shards of three files: sorted ``uint64`` keys, end offsets, and the strings.  A URL is looked up by the strings which
could be entries for it (suffixes of its host with prefixes of its path), all of them in one binary search for each batch and shard.

Entries with an action (``allow``, ``block``) are rules, and the longest one that fits decides; entries without one are the block
list, which decides where no rule fits.  Nothing that fits: allow.

Defined results: a null URL or one without ``://`` has an empty host and path and is allowed; equal rows are judged alike; an
empty table or list is fine; of two rules with the same text ``block`` wins.
"""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.llm.common import ascii_lower, boxed, file_system, run_folder

#: Kinds of entries in a shard; of one text the smallest kind is kept.
BLOCK, ALLOW, LISTED = 0, 1, 2
#: Entries of one shard.  A probe holds no shard in memory, only the pages it touches.
SHARD_ENTRIES = 4_000_000


def url_host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def _key(entry: bytes) -> int:
    return xxhash.xxh64_intdigest(entry)


def write_index(entries: DataFrame) -> list[tuple]:
    """Write (entry string, action string or null) as digest shards into the shared folder.

    Gives a tuple for each shard: its folder, smallest and largest key, number of entries and the lengths of paths that do not end in
    "/".  There is a row for every ``SHARD_ENTRIES`` entries, so the driver can hold them.
    """
    spark = entries.sparkSession
    folder = run_folder(spark, "url-digests")

    def keyed(batches):
        for batch in batches:
            keys = [_key(e.encode()) - (1 << 63) for e in batch.column("entry").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], names=[*batch.schema.names, "key"])

    kind = F.when(F.col("action") == "block", BLOCK).when(F.col("action") == "allow", ALLOW).otherwise(LISTED)
    distinct = entries.filter(F.col("entry").isNotNull()).groupBy("entry").agg(F.min(kind).cast("int").alias("kind"))
    shards = max(1, -(-distinct.count() // SHARD_ENTRIES))
    ordered = distinct.mapInArrow(keyed, "entry string, kind int, key long").repartitionByRange(shards, "key").sortWithinPartitions("key", "entry")

    def write(batches):
        texts, kinds = [], []
        for batch in batches:
            texts += [e.encode() for e in batch.column("entry").to_pylist()]
            kinds += batch.column("kind").to_pylist()
        if not texts:
            return
        key = np.array([_key(t) for t in texts], dtype="<u8")
        fs, base = file_system(folder)
        place = f"{base}/{uuid.uuid4().hex}"
        fs.create_dir(place)
        ends = np.cumsum([len(t) for t in texts]).astype("<u8")
        for name, data in (("keys", key.tobytes()), ("ends", ends.tobytes()), ("kinds", np.array(kinds, dtype="u1").tobytes()), ("texts", b"".join(texts))):
            with fs.open_output_stream(f"{place}/{name}") as out:
                out.write(data)
        lengths = sorted({len(p) for t in texts if not (p := t[t.find(b"/"):]).endswith(b"/")})
        yield pa.RecordBatch.from_pydict({"place": [place], "low": [f"{key[0]:020d}"], "high": [f"{key[-1]:020d}"], "n": [len(texts)], "lengths": pa.array([lengths], pa.list_(pa.int32()))})

    rows = ordered.mapInArrow(write, "place string, low string, high string, n long, lengths array<int>").collect()
    return [(folder, r.place, int(r.low), int(r.high), r.n, tuple(r.lengths)) for r in rows]


_OPEN: dict[str, tuple] = {}


def _shard(folder: str, place: str):
    """The mapped arrays of a shard; files which are not on a local path are copied once for each worker."""
    if place not in _OPEN:
        fs, _ = file_system(folder)
        local = place
        if not os.path.isdir(place):
            local = tempfile.mkdtemp(prefix="url-digests-")
            for name in ("keys", "ends", "kinds", "texts"):
                with fs.open_input_stream(f"{place}/{name}") as src, open(f"{local}/{name}", "wb") as out:
                    while block := src.read(1 << 20):
                        out.write(block)
        _OPEN[place] = tuple(np.memmap(f"{local}/{name}", dtype=kind, mode="r") for name, kind in (("keys", "<u8"), ("ends", "<u8"), ("kinds", "u1"), ("texts", "u1")))
    return _OPEN[place]


def _candidates(host: str, path: str, lengths: list[int]) -> list[bytes]:
    """The strings that could be entries for a URL, longest first."""
    raw = path.encode()
    cuts = {i + 1 for i, byte in enumerate(raw) if byte == 0x2F} | {n for n in lengths if n <= len(raw)}
    labels = host.encode().split(b".")
    found = [b".".join(labels[i:]) + raw[:cut] for i in range(len(labels)) for cut in cuts if labels[i] or i + 1 < len(labels)]
    return sorted(found, key=len, reverse=True)


def lookup(candidates: list[bytes], shards: list[tuple]) -> np.ndarray:
    """The kind of each candidate, -1 where it is no entry."""
    keys = np.fromiter((_key(c) for c in candidates), dtype=np.uint64, count=len(candidates))
    kinds = np.full(len(candidates), -1, dtype=np.int8)
    for folder, place, low, high, _, _ in shards:
        mine = np.flatnonzero((keys >= low) & (keys <= high))
        if not mine.size:
            continue
        table, ends, found, texts = _shard(folder, place)
        left = np.searchsorted(table, keys[mine], "left")
        for i, at in zip(mine, left):
            while at < len(table) and table[at] == keys[i]:
                if texts[int(ends[at - 1]) if at else 0:int(ends[at])].tobytes() == candidates[i]:
                    kinds[i] = found[at]
                    break
                at += 1
    return kinds


def filter_urls(pages: DataFrame, entries: DataFrame, url: str = "url") -> DataFrame:
    """Struct ``row`` of the input with host, path, rule and verdict beside it."""
    shards = write_index(entries)
    lengths = sorted({n for shard in shards for n in shard[5]})
    parts = boxed(pages, url=url).select("row", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))

    def judge(batches):
        for batch in batches:
            wanted = [_candidates(h, p, lengths) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())]
            owner = np.repeat(np.arange(len(wanted)), [len(w) for w in wanted])
            flat = [c for w in wanted for c in w]
            kinds = lookup(flat, shards)
            rule, verdict = [None] * len(wanted), ["allow"] * len(wanted)
            for i in np.flatnonzero(kinds >= 0):
                row, kind = owner[i], kinds[i]
                if rule[row] is not None:
                    continue
                if kind == LISTED:
                    verdict[row] = "block"
                else:
                    rule[row], verdict[row] = flat[i].decode(), "block" if kind == BLOCK else "allow"
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=[*batch.schema.names, "rule", "verdict"])

    return parts.mapInArrow(judge, StructType([*parts.schema.fields, StructField("rule", StringType()), StructField("verdict", StringType())]))


def entry_table(spark: SparkSession, rules: dict[str, str], listed: tuple[str, ...]) -> DataFrame:
    """Entries from literals; long lists come as a table."""
    rows = [(entry, action) for entry, action in rules.items()] + [(entry, None) for entry in listed]
    return spark.createDataFrame(rows, "entry string, action string")


def allowed(pages: DataFrame, entries: DataFrame, url: str = "url") -> DataFrame:
    """The rows of ``pages`` whose URL is allowed."""
    return filter_urls(pages, entries, url).filter(F.col("verdict") == "allow").select("row.*")
