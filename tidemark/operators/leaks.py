"""Which marker texts occur inside which documents, exactly, without comparing every pair.

A marker can only occur where each of its runs of bytes occurs.  It is anchored by the run that the fewest markers share; the
longer the marker, the longer the run.  One pass over the documents keeps the runs that hit a bitmap of all anchors; these meet the
anchors in an equi-join, and the few candidates are verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import materialise

#: Lengths of runs in bytes; a marker takes the longest one that it holds.
RUNS = (1, 2, 3, 4, 5, 6, 7, 8, 16, 32, 64)
#: The bitmap has 2 to the power of this many bits (2 MiB); with more anchors than that more runs go to the join, never fewer.
BITS = 24
#: Bytes of text handled at once.
TILE = 1 << 18


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return values ^ (values >> np.uint64(29))


def _hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A hash for each run of so many bytes: halves are hashed and joined, the halves of an odd length overlap."""
    if length == 1:
        return _mixed(data.astype(np.uint64) + np.uint64(1))
    half = (length + 1) // 2
    parts = _hashes(data, half)
    starts = len(data) - length + 1
    return _mixed(parts[:starts] * np.uint64(0xD6E8FEB86659FD93) + parts[length - half:length - half + starts] + np.uint64(length))


def _runs_of_texts(texts: pa.Array, length: int, bitmap: np.ndarray | None, wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(row, run) once for each run of a text that hits the bitmap and whose row is wanted."""
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    rows, runs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for start in range(int(bounds[0]), int(bounds[-1]) - length + 1, TILE):
        found = _hashes(data[start:min(start + TILE + length - 1, int(bounds[-1]))], length)
        if bitmap is None:
            at = np.arange(len(found))
        else:
            bit = found >> np.uint64(64 - BITS)
            at = np.flatnonzero(bitmap[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1))
        row = np.searchsorted(bounds, at + start, "right") - 1
        inside = at + start + length <= bounds[row + 1]
        if wanted is not None:
            inside &= wanted[row]
        rows.append(row[inside])
        runs.append(found[at[inside]].view(np.int64))
    pairs = np.unique(np.stack([np.concatenate(rows), np.concatenate(runs)], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _run_rows(rows: DataFrame, text: str, lengths: list[int], bitmap: np.ndarray | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns ``keep`` with ``length`` and ``run`` for each run of ``text``; a column ``run_length`` says which one a row takes, without it all are taken."""
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.asarray(batch.column("run_length")) if "run_length" in batch.schema.names else None
            for length in lengths:
                row, run = _runs_of_texts(batch.column(text), length, bitmap, None if own is None else own == length)
                if len(row):
                    kept = batch.select(list(keep)).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays(
                        [*kept.columns, pa.array(np.full(len(row), length, np.int32)), pa.array(run)], names=[*keep, "length", "run"])

    schema = T.StructType([rows.schema[name] for name in keep] + [T.StructField("length", T.IntegerType()), T.StructField("run", T.LongType())])
    return rows.mapInArrow(extract, schema)


def _bitmap(anchors: DataFrame) -> np.ndarray:
    """The leading bits of all anchors, at most 2 MiB at the driver."""
    bit = F.shiftrightunsigned("run", 64 - BITS)
    words = anchors.withColumn("bit", bit).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    bitmap = np.zeros(1 << (BITS - 6), np.uint64)
    found = words.toArrow()
    bitmap[np.asarray(found.column("word"))] = np.asarray(found.column("bits")).view(np.uint64)
    return bitmap


def _anchored(markers: DataFrame, lengths: list[int]) -> DataFrame:
    """One run for each marker: the one which the fewest markers share."""
    runs = _run_rows(markers, "marker", lengths, keep=("marker_id", "marker"))
    shared = runs.groupBy("length", "run").agg(F.count("*").alias("n"))
    ranked = runs.join(shared, ["length", "run"]).groupBy("marker_id", "marker").agg(F.min(F.struct("n", "length", "run")).alias("best"))
    return ranked.select("marker_id", "marker", F.col("best.length").alias("length"), F.col("best.run").alias("run"))


def occurrences(documents: DataFrame, markers: DataFrame) -> DataFrame:
    """(doc_id, text) x (marker_id, marker) -> (doc_id, marker_id) where the text contains the marker."""
    run_length = F.greatest(*[F.when(F.octet_length("marker") >= length, F.lit(length)) for length in RUNS])
    filled = markers.select("marker_id", "marker", run_length.alias("run_length")).where(F.octet_length("marker") > 0)
    lengths = sorted(row["run_length"] for row in filled.select("run_length").distinct().collect())
    anchors = materialise(_anchored(filled, lengths))
    found = _run_rows(documents.select("doc_id", "text"), "text", lengths, _bitmap(anchors), ("doc_id",))
    candidates = found.join(anchors, ["length", "run"]).select("doc_id", "marker_id", "marker")
    return (
        candidates.join(markers.select("marker_id", "marker"), ["marker_id", "marker"]).join(documents.select("doc_id", "text"), "doc_id")
        .where(F.contains("text", "marker")).select("doc_id", "marker_id")
    )


def isolation_findings(documents: DataFrame, markers: DataFrame) -> DataFrame:
    """(corpus, marker_id, problem).  ``documents`` has a ``corpus``; a marker must occur in its own corpus (``home``)
    and in no other one."""
    hits = occurrences(documents, markers).join(documents.select("doc_id", "corpus"), "doc_id")
    per_corpus = hits.groupBy("marker_id", "corpus").agg(F.count("*").alias("n"))
    joined = markers.select("marker_id", "home").join(per_corpus, "marker_id", "left")
    foreign = joined.where(F.col("corpus") != F.col("home")).select("corpus", "marker_id", F.lit("leaked").alias("problem"))
    at_home = joined.where(F.col("corpus") == F.col("home")).select("marker_id")
    absent = markers.join(at_home, "marker_id", "left_anti").select(
        F.col("home").alias("corpus"), "marker_id", F.lit("missing").alias("problem"))
    return foreign.unionAll(absent)
