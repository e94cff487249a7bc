"""Connected components of a table of links, by stars: no component is ever held in one task."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written


#: So many partitions of links are first reduced to one forest.
JOINED = 8


def _forest(batches):
    """A spanning forest of the links of one task, each node linked to the smallest of its tree there."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    nodes = [x for x in root if find(x) != x]
    for at in range(0, len(nodes), 65536):
        part = nodes[at:at + 65536]
        yield pa.RecordBatch.from_pydict({"u": pa.array([find(x) for x in part], pa.int64()), "v": pa.array(part, pa.int64())})


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (u, v): the smallest node that can be reached.

    Each round links every node to the smallest neighbour its neighbours know of, which halves the distances at least; the rounds end
    when nothing changes.  Only rows (node, smallest) are grouped, with partial minima before each shuffle.
    """
    parts = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    current = written(links.select("u", "v").coalesce(max(1, parts // JOINED)).mapInArrow(_forest, "u long, v long"), "links")
    while True:
        # large star: every larger neighbour of a node is linked to the smallest one in reach of the node
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("m").alias("u"), "v").filter("u < v").distinct()
        # small star: a node and its smaller neighbours are linked to the smallest of them
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("m").alias("a"), F.col("u").alias("b")).filter("a < b").union(least.select("m", "v"))
        after = written(small.toDF("u", "v").distinct(), "links")
        left = after.groupBy("v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
        roots = after.select(F.col("u").alias("v")).distinct().join(after.select("v").distinct(), "v", "left_semi").limit(1).count()
        current = after
        if not left and not roots:
            return current.select(F.col("v").alias("node"), F.col("u").alias("component")).union(
                current.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
