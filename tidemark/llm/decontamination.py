"""Wu-Manber search of whole documents for windows of test items.

Texts are word lists.  A table of shifts by the last two words read says how far no window can end, so most positions are never looked
at; where the shift is zero, the bucket of that suffix and of the first two words of the place holds the windows to compare word by
word.  Items with fewer words than a window are one window of that length; there is one table for each length, so that a short item does
not shorten the shifts of the long ones.

Test items are taken in blocks of bounded size, each broadcast and searched in one pass over the documents; a pass adds to what the
passes before found, in the same row, so nothing is shuffled.

Defined results: a null or empty text has no words and no hits; an item without words occurs nowhere; items with one id are one
item, an item without an id is called ``null``; equal rows are reported each; empty tables are fine.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tidemark.llm.common import boxed, slices

WINDOW, BLOCK = 10, 2
#: UTF-8 bytes of item texts searched for in one pass; their tables take some forty times as much in a worker.
PASS_BYTES = 2 << 20

#: ASCII but digits and letters parts words; A-Z count as a-z.
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32) for c in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


class Tables:
    """Shifts and buckets for windows of one length."""

    def __init__(self, length: int):
        self.length, self.block = length, min(BLOCK, length)
        self.far = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))

    def add(self, window: tuple, item: str) -> None:
        for end in range(self.block, self.length + 1):
            part = window[end - self.block:end]
            self.shift[part] = min(self.shift.get(part, self.far), self.length - end)
        self.buckets[window[-self.block:] + window[:self.block]][window].add(item)

    def search(self, text: list[bytes]):
        """(first word, items) of each occurrence."""
        length, block, far, shift, buckets = self.length, self.block, self.far, self.shift, self.buckets
        end, n = length, len(text)
        while end <= n:
            step = shift.get(tuple(text[end - block:end]), far)
            if step:
                end += step
                continue
            begin = end - length
            bucket = buckets.get((*text[end - block:end], *text[begin:begin + block]))
            if bucket:
                items = bucket.get(tuple(text[begin:end]))
                if items:
                    yield begin, items
            end += 1


def build(items: list[tuple[str, str]]) -> list[Tables]:
    tables: dict[int, Tables] = {}
    for item, text in items:
        found = words(text)
        size = min(WINDOW, len(found))
        if size:
            table = tables.setdefault(size, Tables(size))
            for at in range(len(found) - size + 1):
                table.add(tuple(found[at:at + size]), item)
    return [tables[size] for size in sorted(tables)]


_BUILT: dict[tuple, list[Tables]] = {}


def _tables(name: tuple, items) -> list[Tables]:
    """The tables of a pass; a worker keeps those of the last one."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = build(items.value)
    return _BUILT[name]


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, disjoint spans which cover the same words."""
    out: list[list[int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [(a, b) for a, b in out]


_FOUND = [StructField("n_words", LongType()), StructField("begins", ArrayType(LongType())), StructField("ends", ArrayType(LongType())), StructField("items", ArrayType(StringType()))]


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Struct ``row`` of the input with ``n_words``, the word spans hit (``begins``, ``ends``) and the ``items`` found there, sorted."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("null")).alias("id"), F.col(f"`{item_text}`").alias("text")).filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    passes = max(1, -(-size // PASS_BYTES))
    items = items.withColumn("pass", F.pmod(F.xxhash64("id", "text"), F.lit(passes)))
    found = boxed(docs, text=text).select(
        "row", "text", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<bigint>").alias("begins"), F.array().cast("array<bigint>").alias("ends"), F.array().cast("array<string>").alias("items"))
    schema = StructType([*found.schema.fields[:2], *_FOUND])

    def one_pass(frame: DataFrame, number: int) -> DataFrame:
        part = spark.sparkContext.broadcast([(r.id, r.text) for r in items.filter(F.col("pass") == number).select("id", "text").collect()])
        name = (spark.sparkContext.applicationId, part._jbroadcast.id() if part._jbroadcast is not None else id(part))

        def run(batches):
            tables = _tables(name, part)
            for batch in slices(batches, "text"):
                columns = [[], [], [], []]
                for text, begins, ends, seen in zip(*(batch.column(c).to_pylist() for c in ("text", "begins", "ends", "items"))):
                    listed = words(text)
                    spans, hit = list(zip(begins, ends)), set(seen)
                    for table in tables:
                        for begin, named in table.search(listed):
                            spans.append((begin, begin + table.length))
                            hit |= named
                    spans = merge(spans)
                    for column, value in zip(columns, (len(listed), [a for a, _ in spans], [b for _, b in spans], sorted(hit))):
                        column.append(value)
                types = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), *[pa.array(c, t) for c, t in zip(columns, types)]], names=schema.names)

        return frame.mapInArrow(run, schema)

    for number in range(passes):
        found = one_pass(found, number)
    return found.drop("text")


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document: its words, those inside occurrences, the items that occur and their digest."""
    found = find(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), benchmark, "text", item_id, item_text)
    n_hit = F.aggregate(F.zip_with("begins", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda n, x: n + x)
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("begins") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, whole and with all their columns, in which no test item occurs."""
    return find(docs, benchmark).filter(F.size("begins") == 0).select("row.*")
