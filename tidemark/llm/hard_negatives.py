"""Hard negatives by coordinate pruning over length buckets.

Scores are inner products of integer vectors.  Each task takes the rows it has read in tiles, sorts a tile by length into buckets and keeps, for each
bucket, the unit vectors' values coordinate by coordinate in sorted lists.  Anchors come in blocks from the shared folder.  What an anchor still
needs (its k-th best score so far, or the lower end of its band) is, divided by its length and the longest one of the bucket, a least cosine t.
A bucket with t above 1 is skipped.  Else each of the anchor's largest coordinates f allows only unit vectors whose value there lies between
cos(arccos(a_f) + arccos t) and cos(arccos(a_f) - arccos t): a range of the sorted list.  Rows in the ranges of all focus coordinates are verified by exact
products.  Where a range spans most of a bucket it says nothing, and the bucket is verified as a whole by one matrix product.

The vectors are never shuffled: tasks send at most k rows for each anchor and tile, fewer once the k-th best score in a bounded sample of the rows, from
which every anchor starts, is beaten by few.  Positives are found first; their scores give the bands in which negatives are looked for.

Defined results: rows with a null id, label or vector, with a null or non-finite component or one that is ``vectors.LARGEST`` or more once scaled take no part; shorter vectors
count as padded with zeros; each row counts for itself, so repeated rows fill several places, but rows with the anchor's id are never its partners; repeated
anchors give their rows once each; ties go to smaller ids; an empty table or one without anchors gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import file_system, run_folder
from tidemark.llm.vectors import exact_kind, integer_vectors, lengths, matrix, tables_of

#: Components of a tile of rows, rows of a bucket, and the least ratio of lengths in a bucket.
TILE, BUCKET, RATIO = 1 << 22, 4096, 0.9
#: Components of a block of anchors.
BLOCK = 1 << 15
#: Anchor coordinates whose ranges are intersected.
FOCUS = 3
#: Rows on average of the sample from which first bounds come, and anchors in one file.
SAMPLE, IN_FILE = 4096, 1 << 15
#: Slack of the ranges, far above the rounding of single-precision values.
SLACK = 1e-5


class Bucket:
    """Rows of similar length with a sorted list for each coordinate."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        self.longest, self.ids, self.labels = float(sizes[0]), ids, labels
        self.vectors = vectors.astype(exact_kind(self.longest * self.longest))
        unit = (vectors / np.where(sizes > 0, sizes, 1)[:, None]).astype(np.float32)
        order = np.argsort(unit, axis=0)
        self.values = np.ascontiguousarray(np.take_along_axis(unit, order, axis=0).T)
        self.order = np.ascontiguousarray(order.T.astype(np.int16))


def buckets_of(vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray, most: int = BUCKET) -> list[Bucket]:
    """The rows by falling length, cut where a bucket is full or lengths have fallen too far."""
    sizes = lengths(vectors)
    order = np.argsort(-sizes, kind="stable")
    sizes, out, begin = sizes[order], [], 0
    while begin < len(order):
        end = min(begin + most, int(np.searchsorted(-sizes, -RATIO * sizes[begin], "right")))
        rows = order[begin:end]
        out.append(Bucket(vectors[rows], sizes[begin:end], ids[rows], labels[rows]))
        begin = end
    return out


def feasible(bucket: Bucket, unit: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For unit anchors and their least cosines (0 to 1): focus coordinates and the range of each one's sorted list, first and behind the last."""
    width = min(unit.shape[1], len(bucket.values))
    count = min(FOCUS, width)
    focus = np.argsort(-np.abs(unit[:, :width]), axis=1)[:, :count]
    own = np.arccos(np.clip(np.take_along_axis(unit, focus, axis=1), -1, 1))
    turn = np.arccos(cosine)[:, None]
    low = np.cos(np.minimum(np.pi, own + turn)) - SLACK
    high = np.cos(np.maximum(0, own - turn)) + SLACK
    first, behind = np.zeros(focus.shape, np.int64), np.zeros(focus.shape, np.int64)
    for f in np.unique(focus).tolist():
        mine = focus == f
        first[mine] = np.searchsorted(bucket.values[f], low[mine].astype(np.float32), "left")
        behind[mine] = np.searchsorted(bucket.values[f], high[mine].astype(np.float32), "right")
    return focus, first, behind


class Queries:
    """A block of queries with the best rows found for each so far."""

    def __init__(self, block: pa.Table, k: int, same: bool):
        self.k, self.same = k, same
        self.ids = block.column("id").to_numpy()
        self.label_texts = block.column("label").combine_chunks()
        self.vectors = matrix(block.column("vector").combine_chunks())
        self.sizes = lengths(self.vectors)
        self.unit = self.vectors / np.where(self.sizes > 0, self.sizes, 1)[:, None]
        self.low, self.high = (block.column(c).to_numpy() for c in ("low", "high"))
        #: A row below this score can't be among the best k.
        self.bound = self.low.copy()
        self.query, self.score, self.row = (np.zeros(0, np.int64) for _ in range(3))
        self.labels = np.zeros(len(self.ids), np.int64)

    def know(self, texts: pa.Array) -> None:
        """Number labels as in ``texts``; labels not there are -1."""
        self.labels = pc.fill_null(pc.index_in(self.label_texts, value_set=texts), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def allowed(self, bucket: Bucket, queries: np.ndarray, rows) -> np.ndarray:
        alike = bucket.labels[rows] == self.labels[queries]
        return (alike if self.same else ~alike) & (bucket.ids[rows] != self.ids[queries])

    def visit(self, bucket: Bucket) -> None:
        reach = self.sizes * bucket.longest
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(reach > 0, self.bound / reach, 0.0)
        alive = np.flatnonzero((cosine <= 1 + SLACK) & ~((reach == 0) & (self.bound > 0)))
        if not alive.size:
            return
        n, whole = len(bucket.ids), np.ones(len(alive), dtype=bool)
        sharp = np.flatnonzero(cosine[alive] > 0)
        if sharp.size and self.vectors.shape[1] and len(bucket.values):
            who = alive[sharp]
            focus, first, behind = feasible(bucket, self.unit[who], np.minimum(cosine[who], 1.0))
            for i in np.flatnonzero((behind - first).min(axis=1) <= n // 2).tolist():
                whole[sharp[i]] = False
                self._narrow(bucket, int(who[i]), focus[i], first[i], behind[i])
        self._whole(bucket, alive[whole])

    def _narrow(self, bucket: Bucket, query: int, focus, first, behind) -> None:
        """Rows in the ranges of all focus coordinates, verified."""
        seen = np.zeros(len(bucket.ids), dtype=np.uint8)
        for f, a, b in zip(focus.tolist(), first.tolist(), behind.tolist()):
            seen[bucket.order[f, a:b]] += 1
        rows = np.flatnonzero(seen == len(focus))
        rows = rows[self.allowed(bucket, np.int64(query), rows)]
        if rows.size:
            self._keep(np.full(len(rows), query), rows, self._products(bucket, np.array([query]), rows)[0], bucket)

    def _products(self, bucket: Bucket, queries: np.ndarray, rows) -> np.ndarray:
        kind = exact_kind(float(self.sizes[queries].max()) * bucket.longest)
        width = min(self.vectors.shape[1], bucket.vectors.shape[1])
        return self.vectors[queries, :width].astype(kind) @ bucket.vectors[rows, :width].astype(kind, copy=False).T

    def _whole(self, bucket: Bucket, queries: np.ndarray) -> None:
        if not queries.size:
            return
        scores = self._products(bucket, queries, slice(None)).astype(np.float64 if float(self.sizes[queries].max()) * bucket.longest < 1 << 53 else np.int64)
        least = np.iinfo(np.int64).min if scores.dtype == np.int64 else -np.inf
        alike = bucket.labels == self.labels[queries][:, None]
        scores[(alike != self.same) | (bucket.ids == self.ids[queries][:, None]) | (scores > self.high[queries][:, None]) | (scores < self.bound[queries][:, None])] = least
        n = scores.shape[1]
        wanted = np.partition(scores, n - self.k, axis=1)[:, n - self.k] if n > self.k else np.full(len(queries), least)
        at, rows = np.nonzero((scores >= wanted[:, None]) & (scores > least))
        if at.size:
            self._keep(queries[at], rows, scores[at, rows], bucket)

    def _keep(self, queries, rows, scores, bucket: Bucket) -> None:
        scores = scores.astype(np.int64)
        fine = (scores >= self.bound[queries]) & (scores <= self.high[queries])
        query = np.concatenate([self.query, queries[fine]])
        score = np.concatenate([self.score, scores[fine]])
        row = np.concatenate([self.row, bucket.ids[rows[fine]]])
        order = np.lexsort((row, -score, query))
        query, score, row = query[order], score[order], row[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        last = query[place == self.k - 1]
        self.bound[last] = np.maximum(self.bound[last], score[place == self.k - 1])
        kept = place < self.k
        self.query, self.score, self.row = query[kept], score[kept], row[kept]


def blocks_of(folder: str, path: str, columns: list[str], budget: int):
    """Tables of the written rows in ``path``."""
    fs, base = file_system(folder)
    found = pads.dataset(f"{base}{path[len(folder):]}", filesystem=fs, format="parquet")
    yield from tables_of(found.to_batches(columns=columns, batch_size=4096), "vector", budget)


def _index(table: pa.Table, most: int) -> tuple[list[Bucket], pa.Array]:
    coded = table.column("label").combine_chunks().dictionary_encode()
    labels = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return buckets_of(matrix(table.column("vector").combine_chunks()), table.column("id").to_numpy(), labels, most), coded.dictionary


QUERY = "query long, id long, label string, vector array<int>, low long, high long"
NAMES = ["query", "id", "label", "vector", "low", "high"]


def _with_bounds(queries: DataFrame, sample: tuple[str, str], k: int, same: bool) -> DataFrame:
    """``low`` raised to the k-th best score in the sample."""

    def run(batches):
        tiles = None
        for block in tables_of(batches, "vector", BLOCK):
            if tiles is None:
                tiles = [_index(t, BUCKET) for t in blocks_of(*sample, ["id", "label", "vector"], TILE)]
            found = Queries(block, k, same)
            for index, texts in tiles:
                found.know(texts)
                for bucket in index:
                    found.visit(bucket)
            out = block.set_column(block.schema.get_field_index("low"), "low", pa.array(found.bound, pa.int64()))
            yield from out.select(NAMES).to_batches()

    return queries.select(*NAMES).mapInArrow(run, QUERY)


def _search(rows: DataFrame, queries: tuple[str, str], k: int, same: bool) -> DataFrame:
    """(query, found, score): the best ``k`` rows of each query in each tile, then of all."""

    def run(batches):
        for tile in tables_of(batches, "vector", TILE):
            index, texts = _index(tile, BUCKET)
            for block in blocks_of(*queries, NAMES, BLOCK):
                found = Queries(block, k, same)
                found.know(texts)
                for bucket in index:
                    found.visit(bucket)
                if len(found.query):
                    yield pa.RecordBatch.from_arrays([pa.array(block.column("query").to_numpy()[found.query]), pa.array(found.row), pa.array(found.score)], names=["query", "found", "score"])

    best = Window.partitionBy("query").orderBy(F.desc("score"), "found")
    return rows.mapInArrow(run, "query long, found long, score long").withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)


def _write(df: DataFrame, folder: str, name: str) -> DataFrame:
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def mine(rows: DataFrame, anchors: Column, row_id: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """For each anchor and each of its best ``positives`` rows of the same label, the best ``negatives`` rows of other labels whose
    score is between ``low`` and ``high`` per cent of the positive's.

    ``anchors`` is a condition on the columns of ``rows``.
    """
    spark = rows.sparkSession
    folder = run_folder(spark, "hard-negatives")
    named = rows.select(F.col(f"`{row_id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("string").alias("label"), F.col(f"`{vector}`").alias("vector"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    whole = integer_vectors(named.filter(F.col("id").isNotNull() & F.col("label").isNotNull()), "vector", scale)
    least, most = F.lit(-(1 << 63)).cast("long"), F.lit((1 << 63) - 1).cast("long")
    asked = _write(whole.filter("anchor").select(F.monotonically_increasing_id().alias("query"), "id", "label", "vector", least.alias("low"), most.alias("high")), folder, "asked")
    n_rows, n_asked = named.count(), asked.count()
    share = min(1 << 31, -(-SAMPLE * (1 << 31) // max(1, n_rows)))
    _write(whole.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 31)) < share).select("id", "label", "vector").limit(2 * SAMPLE), folder, "sample")
    sample = (folder, f"{folder}/sample")

    def files(n: int) -> int:
        return max(1, -(-n // IN_FILE))

    _write(_with_bounds(asked.repartition(files(n_asked), "query"), sample, positives, True), folder, "anchors")
    plain = whole.select("id", "label", "vector")
    near = _write(_search(plain, (folder, f"{folder}/anchors"), positives, True), folder, "positives")
    # the least and the largest whole score in the band, in integers: floor(x / 100) is (x - pmod(x, 100)) / 100
    bands = near.select(F.col("query").alias("anchor"), "score").distinct().select("anchor", "score", F.expr(f"-((-{low} * score - pmod(-{low} * score, 100)) div 100)").alias("low"), F.expr(f"({high} * score - pmod({high} * score, 100)) div 100").alias("high")).filter("low <= high")
    banded = _write(bands.join(asked.select(F.col("query").alias("anchor"), "id", "label", "vector"), "anchor").withColumn("query", F.monotonically_increasing_id()), folder, "bands")
    _write(_with_bounds(banded.repartition(files(n_asked * positives), "query"), sample, negatives, False), folder, "banded")
    far = _search(plain, (folder, f"{folder}/banded"), negatives, False)
    named_far = far.select("query", F.col("found").alias("negative_id"), F.col("score").alias("negative_score"), F.col("place").alias("rank")).join(banded.select("query", "anchor", F.col("score").alias("positive_score"), F.col("id").alias("anchor_id")), "query")
    pairs = near.select(F.col("query").alias("anchor"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score"))
    return named_far.join(pairs, ["anchor", "positive_score"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
