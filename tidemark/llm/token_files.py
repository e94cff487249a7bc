"""Token ids as Arrow IPC files of fixed-size lists, which a reader maps without a copy.

Documents are range-sorted by id; each task appends ids and an end id to one stream, cuts it into rows of equal length and writes one
file.  A row has ``input_ids`` (a fixed-size list), ``mask`` (false in the padding of a file's last row), ``ends`` (true where a document
ends, as the end id is an ordinary token too) and ``doc_ids`` (of the documents that end there).  A manifest row for each file says where
it lies; files of lost or repeated tasks are in no manifest.

Defined results: a null or empty text is its end id alone; rows with equal ids follow each other in input order; an empty table
gives no files and no rows; documents with a null id come first.
"""

from __future__ import annotations

import os
import uuid
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.llm.bpe import encoder
from tidemark.llm.common import boxed, file_system, run_folder, slices, written

ROW, ROWS_PER_BATCH, END_ID = 2048, 256, 2


def file_schema(row: int, doc_type: pa.DataType, ids: pa.DataType) -> pa.Schema:
    return pa.schema([("input_ids", pa.list_(ids, row)), ("mask", pa.list_(pa.bool_(), row)), ("ends", pa.list_(pa.bool_(), row)), ("doc_ids", pa.list_(doc_type))])


class Writer:
    """Appends documents to one file; holds at most a batch of rows."""

    def __init__(self, sink, schema: pa.Schema, row: int, rows: int):
        self.file, self.schema, self.row, self.rows = pa.ipc.new_file(sink, schema), schema, row, rows
        self.kind = schema.field("input_ids").type.value_type.to_pandas_dtype()
        self.parts: list[np.ndarray] = []
        self.docs: list = []
        self.ends: list[int] = []
        self.held = self.tokens = 0

    def append(self, doc, ids: np.ndarray) -> None:
        self.parts.append(ids.astype(self.kind))
        self.held += len(ids)
        self.tokens += len(ids)
        self.docs.append(doc)
        self.ends.append(self.held - 1)
        if self.held >= self.row * self.rows:
            self._write(self.held // self.row)

    def _write(self, rows: int) -> None:
        size = rows * self.row
        stream = np.concatenate(self.parts)
        ids = np.zeros(size, dtype=self.kind)
        ids[:min(size, len(stream))] = stream[:size]
        mask, ends = np.arange(size) < len(stream), np.zeros(size, dtype=bool)
        inside = sum(end < size for end in self.ends)
        places = np.array(self.ends[:inside], dtype=np.int64)
        ends[places] = True
        offsets = np.searchsorted(places, np.arange(rows + 1) * self.row).astype(np.int32)
        docs = pa.ListArray.from_arrays(pa.array(offsets), pa.array(self.docs[:inside], self.schema.field("doc_ids").type.value_type))
        fixed = [pa.FixedSizeListArray.from_arrays(pa.array(a), self.row) for a in (ids, mask, ends)]
        batch = pa.RecordBatch.from_arrays([*fixed, docs], schema=self.schema)
        for at in range(0, rows, self.rows):
            self.file.write_batch(batch.slice(at, self.rows))
        self.parts, self.held = [stream[size:]], max(0, len(stream) - size)
        self.docs, self.ends = self.docs[inside:], [end - size for end in self.ends[inside:]]

    def close(self) -> None:
        if self.held:
            self._write(-(-self.held // self.row))
        self.file.close()


def write_files(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, row: int = ROW) -> DataFrame:
    """Write the files into the shared folder; gives the manifest: part, path, n_tokens, n_docs, in order of ``part``."""
    folder = run_folder(docs.sparkSession, "token-files")
    parts = boxed(docs, doc_id=doc_id, text=text).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("at"))
    ordered = parts.repartitionByRange("doc_id", "at").sortWithinPartitions("doc_id", "at")
    doc_type = to_arrow_type(parts.schema["doc_id"].dataType)

    def run(batches):
        from itertools import chain

        coder = encoder(tokenizer)
        kind = pa.uint16() if len(coder.opens) <= 1 << 16 and end_id < 1 << 16 else pa.uint32()
        first = next(stream := slices(batches, "text"), None)
        if first is None:
            return
        fs, base = file_system(folder)
        fs.create_dir(base)
        path = f"{base}/{uuid.uuid4().hex}.arrow"
        n_docs = 0
        with fs.open_output_stream(path) as sink:
            out = Writer(sink, file_schema(row, doc_type, kind), row, ROWS_PER_BATCH)
            for batch in chain([first], stream):
                ids, numbers = coder.encode(batch.column("text").to_pylist())
                n_docs += len(numbers)
                for key, end, n in zip(batch.column("doc_id").to_pylist(), np.cumsum(numbers).tolist(), numbers.tolist()):
                    out.append(key, np.append(ids[end - n:end], np.uint32(end_id)))
            out.close()
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "folder": [folder], "path": [path], "n_tokens": [out.tokens], "n_docs": [n_docs]},
                                         schema=pa.schema([("part", pa.int32()), ("folder", pa.string()), ("path", pa.string()), ("n_tokens", pa.int64()), ("n_docs", pa.int64())]))

    return written(ordered.mapInArrow(run, "part int, folder string, path string, n_tokens long, n_docs long"), "token-manifest")


def open_file(folder: str, path: str):
    """The reader of a file, mapped where it lies on a local path."""
    if os.path.exists(path):
        return pa.ipc.open_file(pa.memory_map(path))
    return pa.ipc.open_file(file_system(folder)[0].open_input_file(path))


def documents_of(reader):
    """(document id, its ids) in the order of a file, from the mapped buffers."""
    rest: list[np.ndarray] = []
    for i in range(reader.num_record_batches):
        batch = reader.get_batch(i)
        ids = batch.column("input_ids").flatten().to_numpy()
        ends = np.flatnonzero(batch.column("ends").flatten().to_numpy(zero_copy_only=False))
        used = int(np.count_nonzero(batch.column("mask").flatten().to_numpy(zero_copy_only=False)))
        begin = 0
        for doc, end in zip(batch.column("doc_ids").flatten().to_pylist(), ends.tolist()):
            piece = ids[begin:end + 1]
            yield doc, np.concatenate([*rest, piece]) if rest else piece
            rest, begin = [], end + 1
        if begin < used:
            rest.append(ids[begin:used])


def read_files(manifest: DataFrame, doc_type) -> DataFrame:
    """One row for each document in the files: id, ids of all documents before it, number and checksum of its ids.

    The driver holds one row for each file, that is for each task which wrote.
    """
    files = sorted(manifest.collect(), key=lambda r: r.part)
    before = accumulate((f.n_tokens for f in files), initial=0)
    rows = [(f.folder, f.path, start) for f, start in zip(files, before)]
    schema = StructType([StructField("doc_id", doc_type), StructField("start", LongType()), StructField("n_tokens", LongType()), StructField("ids_crc32", LongType())])
    types = [to_arrow_type(f.dataType) for f in schema.fields]

    def run(batches):
        for batch in batches:
            for folder, path, start in zip(*(batch.column(c).to_pylist() for c in ("folder", "path", "start"))):
                out = []
                for doc, ids in documents_of(open_file(folder, path)):
                    out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(out) == 8192:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=schema.names)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=schema.names)

    spark = manifest.sparkSession
    listed = spark.createDataFrame(rows, "folder string, path string, start long").repartition(max(1, len(rows)))
    return listed.mapInArrow(run, schema)


def token_files(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the files and read them back."""
    return read_files(write_files(docs, tokenizer, doc_id, text), docs.schema[doc_id].dataType)
