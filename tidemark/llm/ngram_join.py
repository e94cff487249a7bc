"""Exact Jaccard join of documents on word shingles by vertical partitioning.

Shingles have one global order: rising number of occurrences in the corpus, kept in a counter table of fixed size, then fingerprint.  Documents
that link at 0.8 share a shingle among the first fifth of their shingles in that order, and nearly half of that fifth if they are of a size.
The order is cut into fragments by fingerprint range, each joined by itself: a fragment counts, for pairs of documents, the shingles
of those first fifths that they share, and the partial overlaps are summed for each pair.

1. Equal sets are one node with one representative, so copies are never joined with each other.
2. Fragments keep the shingles that several nodes share (``lists``).
3. First round: neighbours in each list, sorted by size, are counted; every node is compared with its best neighbour only.  That
   links groups of near copies into components without looking at their pairs.
4. Between the rounds every node is compared with the one of another component whose sketch is nearest, among those it meets in the
   second round.  That links most components which have many links between them, by one row for each node.
5. Second round: of the lists that still hold several components, the pairs from different components are counted, lists with
   one first node together or, if many nodes are in them, by pairs of blocks of nodes; those whose sum can still reach the threshold are compared.  Of two documents the one whose first shingles end earlier in the order can share
   none of its first shingles but listed ones, so heavily edited copies, whose first shingles are their own, meet nobody.  No link between components is lost; links inside a component change nothing.

In all rounds a pair is dropped, before it is a row, if the sketches of its sets show that too many shingles differ.  A sketch is the parity
of the number of shingles in each of some places: every place where two sketches differ holds a shingle which only one of the sets has.

A comparison counts the overlap of two whole sets fragment by fragment and stops when the rest cannot reach the threshold.  Texts meet
in pairs of blocks of bounded size, whatever the number of partners.

Defined results: null and empty texts and texts without words have no shingles and are linked with nothing; fewer words than a shingle
are one shingle; rows with one id are one document; a row without an id belongs to the component of the documents with its set, or to none if
no row of that set has an id.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import boxed, slices, written
from tidemark.llm.components import components
from tidemark.llm.shingles import shingle_sets

#: Two documents link if PERCENT of their united shingles are shared.
PERCENT = 80
#: Counters of the order: more separate frequent from rare shingles better; any number gives the same links.
COUNTERS = 1 << 22
CHUNKS = 64
#: Fragments of a comparison, and documents of one block.
SEGMENTS, PARTNERS = 8, 256
#: Nodes of one block of a matrix product.
ROWS = 512
#: Lists with one first node are counted in one task up to so many nodes and rows, and else in pairs of blocks of about that many.
NODES, LISTED = 4096, 1 << 20
#: Places of a sketch for each shingle, at least, and places at most; other numbers change the speed, never the links.
PLACES, MOST_PLACES = 4, 1 << 15
#: Bytes of text read before a task hands on what it has.
BATCH = 24 << 20


def prefix_length(n):
    """Shingles in the given order of which linked documents share one: all but those that 80 % of the set can do without."""
    return n - (PERCENT * n + 99) // 100 + 1


def least_overlap(a, b):
    """Shared shingles at least of linked sets of sizes ``a`` and ``b``."""
    return -((-PERCENT * (a + b)) // (100 + PERCENT))


def signature(shingles: np.ndarray) -> tuple[int, int]:
    digest = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def sketch(shingles: np.ndarray) -> bytes:
    """For each of a power of two of places, the parity of the number of shingles there, as bits."""
    places = min(MOST_PLACES, 1 << max(6, (PLACES * len(shingles) - 1).bit_length()))
    counts = np.bincount((shingles >> np.uint64(8) & np.uint64(places - 1)).astype(np.int64), minlength=places)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


class Sketches:
    """Sketches of some nodes as rows of words, folded to the width that is asked for."""

    def __init__(self, sketches: list[bytes]):
        self.words = [np.frombuffer(s, dtype=np.uint64) for s in sketches]
        self.width = np.array([len(w) for w in self.words], dtype=np.int64)
        self.held: dict[int, np.ndarray] = {}

    def rows(self, width: int) -> np.ndarray:
        if width not in self.held:
            rows = np.zeros((len(self.words), width), dtype=np.uint64)
            for i in np.flatnonzero(self.width >= width).tolist():
                rows[i] = np.bitwise_xor.reduce(self.words[i].reshape(-1, width), axis=0)
            self.held[width] = rows
        return self.held[width]


def slack(a: Sketches, n_a: np.ndarray, b: Sketches, n_b: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For nodes ``u`` of ``a`` and ``v`` of ``b``: shingles in which linked sets may differ, less places where the sketches do; below 0 they cannot link."""
    most = n_a[u] + n_b[v] - 2 * least_overlap(n_a[u], n_b[v])
    width = np.minimum(a.width[u], b.width[v])
    out = np.zeros(len(u), dtype=np.int64)
    for w in np.unique(width).tolist():
        x, y, at = a.rows(w), b.rows(w), np.flatnonzero(width == w)
        step = max(1, (1 << 20) // w)
        for begin in range(0, len(at), step):
            part = at[begin:begin + step]
            out[part] = most[part] - np.bitwise_count(x[u[part]] ^ y[v[part]]).sum(axis=1, dtype=np.int64)
    return out


def overlap_at_least(a: np.ndarray, b: np.ndarray, least: int) -> bool:
    """Whether two sorted sets share ``least`` values: partial overlaps by fragment of the fingerprint range, summed."""
    cuts = (np.arange(1, SEGMENTS, dtype=np.uint64) << np.uint64(61)) if SEGMENTS == 8 else None
    cuts_a, cuts_b = ([0, *np.searchsorted(x, cuts).tolist(), len(x)] for x in (a, b))
    total, rest = 0, min(len(a), len(b))
    for f in range(SEGMENTS):
        x, y = a[cuts_a[f]:cuts_a[f + 1]], b[cuts_b[f]:cuts_b[f + 1]]
        if len(x) and len(y):
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            total += int(np.count_nonzero(y[at] == x))
        rest = min(len(a) - cuts_a[f + 1], len(b) - cuts_b[f + 1])
        if total + rest < least:
            return False
    return total >= least


def sum_chunks(parts: DataFrame, width: int) -> np.ndarray:
    """The sum of counter arrays that come as compressed chunks (chunk, counts): ``width`` counters, however large the input."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
                values = np.frombuffer(zlib.decompress(counts), dtype=np.uint32)
                sums[chunk] = sums[chunk] + values if chunk in sums else values
        for chunk, values in sums.items():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "counts": pa.array([zlib.compress(values.tobytes(), 1)], pa.binary())})

    out = np.zeros(width, dtype=np.uint32)
    step = width // CHUNKS
    for row in parts.repartition(CHUNKS, "chunk").mapInArrow(add, "chunk int, counts binary").toLocalIterator():
        out[row.chunk * step:(row.chunk + 1) * step] += np.frombuffer(zlib.decompress(row.counts), dtype=np.uint32)
    return out


def chunks_of(counts: np.ndarray):
    step = len(counts) // CHUNKS
    for chunk in range(CHUNKS):
        part = counts[chunk * step:(chunk + 1) * step]
        if part.any():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "counts": pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())})


def shingle_counts(docs: DataFrame, width: int = COUNTERS) -> np.ndarray:
    """How often shingles occur, by fingerprint modulo ``width``, over all documents."""

    def count(batches):
        counts = np.zeros(width, dtype=np.uint32)
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column("text").to_pylist())
            counts += np.bincount((np.concatenate(sets) & np.uint64(width - 1)).astype(np.int64), minlength=width).astype(np.uint32)
        yield from chunks_of(counts)

    return sum_chunks(docs.select("text").mapInArrow(count, "chunk int, counts binary"), width)


def nodes_of(docs: DataFrame) -> DataFrame:
    """Signature (a, b), size and sketch of the set of each document."""

    def run(batches):
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column("text").to_pylist())
            signs = [signature(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([a for a, _ in signs], pa.int64()), pa.array([b for _, b in signs], pa.int64()),
                 pa.array([sketch(s) if len(s) else None for s in sets], pa.binary())],
                names=["doc_id", "n_shingles", "a", "b", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, a long, b long, sketch binary")


def shared_lists(docs: DataFrame, counts: np.ndarray, fragments: int) -> DataFrame:
    """(shingle, a, n, a_before, n_before): the nodes that have a shingle among their first ones, for shingles with several nodes, each
    with the node before it in the list by size.  And a row for each node without a shingle, where ``a_before`` is the place in the
    order of the last of its first shingles."""
    order = docs.sparkSession.sparkContext.broadcast(counts)

    def emit(batches):
        held: list[np.ndarray] = []
        nodes: dict[tuple[int, int], int] = {}
        lasts: list[int] = []
        size = 0

        def hand_on():
            token = np.concatenate(held)
            owner = np.repeat(np.arange(len(held)), [len(h) for h in held])
            signs = np.array([a for a, _ in nodes], dtype=np.int64)
            sizes = np.array([n for _, n in nodes], dtype=np.int32)
            fragment = ((token >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)
            by = np.argsort(fragment, kind="stable")
            cuts = np.searchsorted(fragment[by], np.arange(fragments + 1))
            yield pa.RecordBatch.from_pydict({"fragment": pa.array([fragments + len(held) % fragments], pa.int32()), "token": pa.array([np.array(lasts, dtype=np.int64).tobytes()], pa.binary()),
                                              "a": pa.array([signs.tobytes()], pa.binary()), "n": pa.array([sizes.tobytes()], pa.binary())})
            for f in range(fragments):
                mine = by[cuts[f]:cuts[f + 1]]
                if len(mine):
                    yield pa.RecordBatch.from_pydict({"fragment": pa.array([f], pa.int32()), "token": pa.array([token[mine].tobytes()], pa.binary()),
                                                      "a": pa.array([signs[owner[mine]].tobytes()], pa.binary()), "n": pa.array([sizes[owner[mine]].tobytes()], pa.binary())})

        for batch in slices(batches, "text"):
            size += batch.column("text").nbytes
            for s in shingle_sets(batch.column("text").to_pylist()):
                if not len(s):
                    continue
                key = signature(s)[0], len(s)
                if key not in nodes:
                    nodes[key] = len(nodes)
                    often = order.value[(s & np.uint64(len(order.value) - 1)).astype(np.int64)]
                    first = np.lexsort((s, often))[:prefix_length(len(s))]
                    held.append(s[first])
                    lasts.append((min(int(often[first[-1]]), 0x7FFFFF) << 40) + (int(s[first[-1]]) >> 24 if often[first[-1]] < 0x7FFFFF else 0))
            if size > BATCH:
                yield from hand_on()
                held, nodes, lasts, size = [], {}, [], 0
        if held:
            yield from hand_on()

    names = ["shingle", "a", "n", "a_before", "n_before"]

    def gather(batches):
        current, parts = None, []

        def shared():
            if current >= fragments:
                for last, a, n in ((np.frombuffer(t, np.int64), np.frombuffer(x, np.int64), np.frombuffer(y, np.int32)) for t, x, y in parts):
                    nothing = np.ones(len(a), dtype=bool)
                    yield pa.RecordBatch.from_arrays([pa.array(last, mask=nothing), pa.array(a), pa.array(n), pa.array(last), pa.array(n, mask=nothing)], names=names)
                return
            token = np.concatenate([np.frombuffer(t, np.uint64) for t, _, _ in parts])
            a = np.concatenate([np.frombuffer(x, np.int64) for _, x, _ in parts])
            n = np.concatenate([np.frombuffer(x, np.int32) for _, _, x in parts])
            by = np.lexsort((a, n, token))
            token, a, n = token[by], a[by], n[by]
            same = token[1:] == token[:-1]
            fresh = np.append(True, ~(same & (a[1:] == a[:-1]) & (n[1:] == n[:-1])))
            token, a, n = token[fresh], a[fresh], n[fresh]
            same = token[1:] == token[:-1]
            many = np.append(False, same) | np.append(same, False)
            token, a, n = token[many], a[many], n[many]
            opens = np.append(True, token[1:] != token[:-1])[:len(token)]
            for at in range(0, len(token), 1 << 16):
                part, before = slice(at, at + (1 << 16)), np.maximum(np.arange(at, min(at + (1 << 16), len(token))) - 1, 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(token[part].view(np.int64)), pa.array(a[part]), pa.array(n[part]), pa.array(a[before], mask=opens[part]), pa.array(n[before], mask=opens[part])], names=names)

        for batch in batches:
            for f, *arrays in zip(*(batch.column(c).to_pylist() for c in ("fragment", "token", "a", "n"))):
                if f != current and parts:
                    yield from shared()
                    parts = []
                current = f
                parts.append(arrays)
        if parts:
            yield from shared()

    pieces = docs.select("text").mapInArrow(emit, "fragment int, token binary, a binary, n binary")
    return pieces.repartition(fragments, "fragment").sortWithinPartitions("fragment").mapInArrow(gather, "shingle long, a long, n int, a_before long, n_before int")


def sketched(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sketches allow a link."""
    both = pairs.select("u", "v")
    for side in "uv":
        both = both.join(sketches.select(F.col("rep").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}")), side)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                every = np.arange(part.num_rows)
                a, b = (Sketches(part.column(f"sketch_{side}").to_pylist()) for side in "uv")
                n_a, n_b = (part.column(f"n_{side}").to_numpy().astype(np.int64) for side in "uv")
                yield part.select(["u", "v"]).filter(pa.array(slack(a, n_a, b, n_b, every, every) >= 0))

    return both.mapInArrow(run, "u long, v long")


def compared(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (u, v) of representatives that link, by comparing their whole sets.

    Documents are put into blocks of about ``PARTNERS``, those with a common partner together; a pair is compared where its two blocks
    meet, and a text is sent once to each meeting of its block, not once for each pair.
    """
    pairs = pairs.select("u", "v")
    wanted = pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).distinct()
    texts = docs.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    groups = pairs.select(F.col("u").alias("w"), F.col("u").alias("g")).union(pairs.select(F.col("v").alias("w"), F.col("u").alias("g"))).groupBy("w").agg(F.min("g").alias("g"))
    sizes = groups.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("blocks"))
    homes = written(groups.join(sizes, "g").select("w", F.xxhash64("g", F.pmod(F.xxhash64("w"), F.col("blocks"))).alias("home")), "join-homes")
    placed = pairs.join(homes.select(F.col("w").alias("u"), F.col("home").alias("home_u")), "u").join(homes.select(F.col("w").alias("v"), F.col("home").alias("home_v")), "v")
    meetings = written(placed.select("u", "v", F.xxhash64(F.least("home_u", "home_v"), F.greatest("home_u", "home_v")).alias("meeting")), "join-meetings")
    needed = meetings.select("meeting", F.col("u").alias("w")).union(meetings.select("meeting", F.col("v").alias("w"))).distinct()
    rows = needed.join(texts, F.col("w") == F.col("doc_id")).select("meeting", F.lit(0).alias("role"), F.col("w").alias("u"), F.col("w").alias("v"), "text").union(
        meetings.select("meeting", F.lit(1), "u", "v", F.lit(None).cast("string")))

    def run(batches):
        sets: dict[int, np.ndarray] = {}
        current = None
        for batch in slices(batches, "text"):
            out: list[tuple[int, int]] = []
            for meeting, role, u, v, own in zip(*(batch.column(c).to_pylist() for c in ("meeting", "role", "u", "v")), shingle_sets(batch.column("text").to_pylist())):
                if meeting != current:
                    current, sets = meeting, {}
                if role == 0:
                    sets[u] = own
                elif overlap_at_least(sets[u], sets[v], least_overlap(len(sets[u]), len(sets[v]))):
                    out.append((u, v))
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in out], pa.int64()), pa.array([v for _, v in out], pa.int64())], names=["u", "v"])

    return rows.repartition("meeting").sortWithinPartitions("meeting", "role").mapInArrow(run, "u long, v long")


PAIR_COUNTS = "x long, y long, n_x int, n_y int, last_x long, last_y long, overlap long"


def counting_groups(open_lists: DataFrame) -> DataFrame:
    """The rows of the lists with ``meeting`` and ``side``: lists with one first node meet as a whole (side 2), or, if they hold many nodes, as
    pairs of blocks of them (sides 0 and 1).

    Blocks are made by size class, by whether a node can share enough with any node when its own first shingles end earlier, and by
    hash.  Blocks of which no two nodes can be linked do not meet: sizes more than one class apart, or no able node in either.
    Rows with a ``sketch`` are in no list; each node has one such row under each first node.
    """
    extra = [c for c in ("sketch",) if c in open_lists.columns]
    listed = F.col("sketch").isNull() if extra else F.lit(True)
    size_class = F.floor(F.log("n") / F.lit(float(np.log(1.26)))).cast("int").alias("class")
    able = (100 * F.col("most") >= PERCENT * F.col("n")).alias("able")
    counted = open_lists.groupBy("leader", "rep", "n", "most").agg(F.count_if(listed).alias("listed"))
    blocks = counted.groupBy("leader", size_class, able).agg(F.count(F.lit(1)).alias("nodes"), F.sum("listed").alias("listed"))
    large = blocks.groupBy("leader").agg(F.sum("nodes").alias("all_nodes"), F.sum("listed").alias("all_listed")).filter((F.col("all_nodes") > NODES) | (F.col("all_listed") > LISTED))
    pieces = F.greatest(F.ceil(F.col("nodes") / NODES), F.ceil(F.col("listed") / LISTED)).alias("pieces")
    blocks = written(blocks.join(large, "leader", "left_semi").select("leader", "class", "able", pieces), "join-blocks")
    names = ["leader", "shingle", "n", "rep", "component", "last", "most", *extra]
    if blocks.isEmpty():
        return open_lists.select(F.col("leader").alias("meeting"), F.lit(2).alias("side"), *names[1:])
    placed = open_lists.select(*names, size_class, able).join(blocks, ["leader", "class", "able"], "left")
    whole = placed.filter("pieces is null").select(F.col("leader").alias("meeting"), F.lit(2).alias("side"), *names[1:])
    each = blocks.select("leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("part"), "class", "able").select("leader", F.struct("class", "able", "part").alias("block"))
    pairs = each.join(each.withColumnRenamed("block", "other"), "leader").filter(
        "block <= other and other.class - block.class <= 1 and (block.able or other.able)").withColumn("meeting", F.xxhash64("leader", "block", "other"))
    sides = pairs.select("leader", "block", "meeting", F.when(F.col("block") == F.col("other"), 2).otherwise(0).alias("side")).union(
        pairs.filter("block < other").select("leader", "other", "meeting", F.lit(1)))
    part = F.pmod(F.xxhash64("rep"), F.col("pieces")).alias("part")
    split = placed.filter("pieces is not null").select(*names, F.struct("class", "able", part).alias("block")).join(sides, ["leader", "block"])
    return whole.union(split.select("meeting", "side", *names[1:]))


def first_of_each(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The place of the largest value of each key."""
    by = np.lexsort((-values, keys))
    return by[np.append(True, keys[by][1:] != keys[by][:-1])]


def pair_counts(batches, nearest: bool = False):
    """Partial overlaps of the pairs of nodes that meet in lists which begin with the same node, taken together by matrix products.

    Only pairs of different components are counted, of sizes that can link, where the node whose first shingles end earlier
    can share enough and, if sketches are given, these allow a link.  With ``nearest`` only the pair with the largest slack of each node
    (of each block of rows) is given, with that as ``overlap``.
    """
    def counted(sketches, side, shingle, *columns):
        column = np.unique(shingle, return_inverse=True)[1]
        width = int(column.max()) + 1
        sides = []
        for mine in ([side == 2] if side[0] == 2 else [side == 0, side == 1]):
            if not mine.any():
                return
            n, rep, component, last, most = (c[mine] for c in columns)
            nodes, at, row = np.unique(rep, return_index=True, return_inverse=True)
            sides.append((row, column[mine], nodes, n[at].astype(np.int64), component[at], last[at], most[at].astype(np.int64)))
        (row_a, column_a, *a), (row_b, column_b, *b) = sides[0], sides[-1]
        one = len(sides) == 1
        nodes, n, component, last, most = b
        if sketches:
            sketches_b = Sketches([sketches[x] for x in nodes.tolist()])
            sketches_a = sketches_b if one else Sketches([sketches[x] for x in a[0].tolist()])
        step = max(1, (1 << 24) // (len(a[0]) + len(nodes)))

        def part(row, column, number, left):
            inside = (column >= left) & (column < left + step)
            held = np.zeros((number, min(step, width - left)), dtype=np.float32)
            held[row[inside], column[inside] - left] = 1
            return held

        held_a = held_b = None
        for begin in range(0, len(a[0]), ROWS):
            rows = slice(begin, begin + ROWS)
            own, own_n, own_component, own_last, own_most = (c[rows, None] for c in a)
            overlap = np.zeros((len(own), len(nodes)), dtype=np.float32)
            for left in range(0, width, step):
                if held_a is None or width > step:
                    held_a = part(row_a, column_a, len(a[0]), left)
                    held_b = held_a if one else part(row_b, column_b, len(nodes), left)
                overlap += held_a[rows] @ held_b.T
            smaller = (own_n < n) | ((own_n == n) & (own < nodes))
            needed = PERCENT * (own_n + n)
            good = (overlap > 0) & (own_component != component) & (100 * np.minimum(own_n, n) >= PERCENT * np.maximum(own_n, n))
            good &= ((own_last <= last) & ((100 + PERCENT) * own_most >= needed)) | ((last <= own_last) & ((100 + PERCENT) * most >= needed))
            if one and not nearest:
                good &= smaller
            u, v = np.nonzero(good)
            if sketches and len(u):
                left_over = slack(sketches_a, a[1], sketches_b, n, u + begin, v)
                hopeful = left_over >= 0
                u, v = u[hopeful], v[hopeful]
                if nearest and len(u):
                    left_over = left_over[hopeful]
                    mine = first_of_each(u, left_over) if one else np.union1d(first_of_each(u, left_over), first_of_each(v, left_over))
                    u, v = u[mine], v[mine]
                    overlap[u, v] = left_over[mine]
            if len(u):
                first = smaller[u, v]
                found = [(np.where(first, x[u, 0], y[v]), np.where(first, y[v], x[u, 0])) for x, y in ((own, nodes), (own_n.astype(np.int32), n.astype(np.int32)), (own_last, last))]
                yield pa.RecordBatch.from_arrays([*[pa.array(c) for pair in found for c in pair], pa.array(overlap[u, v].astype(np.int64))], names=["x", "y", "n_x", "n_y", "last_x", "last_y", "overlap"])

    names = ("side", "shingle", "n", "rep", "component", "last", "most")
    parts: list[list[np.ndarray]] = []
    sketches: dict[int, bytes] = {}
    meeting = None
    for batch in batches:
        given = batch.column("sketch") if "sketch" in batch.schema.names else pa.nulls(batch.num_rows, pa.binary())
        of_lists = given.is_null().to_numpy(zero_copy_only=False)
        meetings = batch.column("meeting").to_numpy()
        columns = [batch.column(c).to_numpy() for c in names]
        cuts = [0, *(np.flatnonzero(np.diff(meetings)) + 1).tolist(), len(meetings)]
        for begin, end in zip(cuts, cuts[1:]):
            if begin == end:
                continue
            if parts and meetings[begin] != meeting:
                yield from counted(sketches, *(np.concatenate(c) for c in zip(*parts)))
                parts, sketches = [], {}
            meeting = meetings[begin]
            mine = np.flatnonzero(~of_lists[begin:end]) + begin
            sketches.update(zip(columns[names.index("rep")][mine].tolist(), given.take(pa.array(mine)).to_pylist()))
            parts.append([c[begin:end][of_lists[begin:end]] for c in columns])
    if parts:
        yield from counted(sketches, *(np.concatenate(c) for c in zip(*parts)))


def nearest_pairs(batches):
    return pair_counts(batches, nearest=True)


def _ordered(frame: DataFrame) -> DataFrame:
    return frame.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"), "overlap")


def near_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fragments: int | None = None, counters: int = COUNTERS) -> DataFrame:
    """One row for each document: ``doc_id``, ``n_shingles`` and ``component_id``, the smallest id that can be reached over links."""
    spark = docs.sparkSession
    docs = boxed(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    signed = written(nodes_of(docs), "join-nodes")
    nodes = written(signed.filter("n_shingles > 0").groupBy("a", "b", "n_shingles").agg(F.min("doc_id").alias("rep")), "join-representatives")
    # sets that only rows without an id have link nothing
    ids = nodes.filter("rep is not null").select("a", F.col("n_shingles").cast("int").alias("n"), "rep")
    named = docs.filter("doc_id is not null")
    fragments = fragments or int(spark.conf.get("spark.sql.shuffle.partitions"))
    lists = written(shared_lists(named, shingle_counts(docs, counters), fragments), "join-lists")

    lasts = lists.filter("shingle is null").groupBy("a", "n").agg(F.min("a_before").alias("last"))
    lists = lists.filter("shingle is not null")
    listed = written(lists.groupBy("a", "n").agg(F.count(F.lit(1)).alias("listed")), "join-listed")
    sketches = signed.filter("doc_id is not null and n_shingles > 0").select(F.col("doc_id").alias("rep"), F.col("n_shingles").cast("int").alias("n"), "sketch").dropDuplicates(["rep"])
    sketches = written(sketches.join(listed.join(ids, ["a", "n"]).select("rep"), "rep", "left_semi"), "join-sketches")

    # first round: neighbours in the lists, each node with its best one
    near = lists.filter(f"a_before is not null and 100 * n_before >= {PERCENT} * n")
    counted = near.groupBy("a", "n", "a_before", "n_before").agg(F.count(F.lit(1)).alias("overlap"))
    best = counted.groupBy("a", "n").agg(F.max_by(F.struct("a_before", "n_before"), F.struct("overlap", "n_before", "a_before")).alias("other"), F.max("overlap").alias("overlap"))
    mine = best.join(ids.withColumnRenamed("rep", "y"), ["a", "n"]).select("y", "overlap", F.col("other.a_before").alias("a"), F.col("other.n_before").alias("n"))
    best = mine.join(ids.withColumnRenamed("rep", "x"), ["a", "n"])
    tried = written(_ordered(best).groupBy("u", "v").agg(F.max("overlap").alias("overlap")), "join-first")
    linked = written(compared(written(sketched(tried, sketches), "join-first-sketched"), named), "join-first-links")
    known = components(linked)

    # second round: pairs from different components in lists that hold several
    # "most": shingles that a node can share with one whose first shingles reach as far in the order: all but its unlisted first ones
    homes = ids.join(listed, ["a", "n"]).join(lasts, ["a", "n"]).join(known, F.col("rep") == F.col("node"), "left").select(
        "a", "n", "rep", F.coalesce("component", "rep").alias("component"), "last", (F.col("n") - prefix_length_column("n") + F.col("listed")).alias("most"))
    placed = lists.select("shingle", "a", "n").join(homes, ["a", "n"]).select("shingle", "n", "rep", "component", "last", "most")
    whole = Window.partitionBy("shingle")
    names = ["shingle", "n", "rep", "component", "last", "most", "leader"]

    def still_open(frame: DataFrame) -> DataFrame:
        mixed = frame.select("*", F.min("component").over(whole).alias("low"), F.max("component").over(whole).alias("high"))
        return written(mixed.filter("low < high").select(*names), "join-open-lists")

    def meetings(frame: DataFrame) -> DataFrame:
        holders = frame.select(F.lit(0).cast("long").alias("shingle"), *names[1:]).distinct()
        carried = frame.select(*names, F.lit(None).cast("binary").alias("sketch")).unionByName(holders.join(sketches.select("rep", "sketch"), "rep"))
        return counting_groups(carried).repartition("meeting").sortWithinPartitions("meeting")

    open_lists = still_open(placed.select("*", F.min(F.struct("n", "rep")).over(whole)["rep"].alias("leader")))

    # each node with the nearest one of another component
    near = _ordered(meetings(open_lists).mapInArrow(nearest_pairs, PAIR_COUNTS)).join(tried, ["u", "v"], "left_anti")
    ends = near.select(F.explode(F.array("u", "v")).alias("w"), "u", "v", "overlap")
    nearest = written(ends.groupBy("w").agg(F.max(F.struct("overlap", "u", "v")).alias("best")).select("best.u", "best.v").distinct(), "join-nearest")
    linked = linked.union(written(compared(nearest, named), "join-nearest-links"))
    tried = tried.select("u", "v").union(nearest)
    known = components(linked)
    open_lists = still_open(open_lists.join(known, F.col("rep") == F.col("node"), "left").select(
        *[F.coalesce(known["component"], open_lists["component"]).alias(c) if c == "component" else open_lists[c] for c in names]))

    counts = meetings(open_lists).mapInArrow(pair_counts, PAIR_COUNTS)
    summed = counts.groupBy("x", "y", "n_x", "n_y", "last_x", "last_y").agg(F.sum("overlap").alias("overlap"))

    def reaches(number: Column) -> Column:
        return number * (100 + PERCENT) >= PERCENT * (F.col("n_x") + F.col("n_y"))

    rest_x, rest_y = (F.col("overlap") + F.col(f"n_{side}") - prefix_length_column(f"n_{side}") for side in "xy")
    hopeful = _ordered(summed.filter(((F.col("last_x") <= F.col("last_y")) & reaches(rest_x)) | ((F.col("last_y") <= F.col("last_x")) & reaches(rest_y))))
    second = written(hopeful.join(tried, ["u", "v"], "left_anti").select("u", "v"), "join-second")
    more = compared(second, named)
    final = components(linked.union(more))

    members = signed.join(nodes, ["a", "b", "n_shingles"], "left").join(final, F.col("rep") == F.col("node"), "left")
    return members.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))


def prefix_length_column(name: str):
    n = F.col(name)
    return n - F.floor((PERCENT * n + 99) / 100) + 1


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, with all their columns, whose id is the smallest of their component; one row for each id.

    Rows without an id stay.
    """
    groups = near_components(docs, doc_id, text).filter("doc_id = component_id").select(F.col("doc_id").alias("kept")).distinct()
    named = boxed(docs.filter(F.col(f"`{doc_id}`").isNotNull()).dropDuplicates([doc_id]), doc_id=doc_id)
    kept = named.join(groups, F.col("doc_id") == F.col("kept"), "left_semi").select("row.*")
    return kept.unionByName(docs.filter(F.col(f"`{doc_id}`").isNull()))
