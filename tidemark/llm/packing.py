"""Sum-of-squares packing of documents into windows, online in the task that tokenises them.

Each document is cut into whole windows and a rest.  The rest goes to the fill level (or a new window) for which the sum of the squared
numbers of partly filled windows, kept in an array by level, becomes smallest; of equal choices the fullest.  A window's pieces are given out once it is
full.  At the end of a task the pieces of the windows that are still open are dealt anew: cut to fill them, fullest first, so that a task leaves one
padded window.  Open windows hold at most ``HELD`` tokens (sizes that never fit each other would open windows without end); at that
point they are dealt anew too.  Nothing is shuffled; a repeated task packs the same way.

Defined results: a null or empty text is its end id alone; repeated ids and equal rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from tidemark.llm.bpe import encoder
from tidemark.llm.common import boxed, slices

WINDOW, END_ID = 2048, 1
#: Tokens in open windows at most, 16 MiB of ids.
HELD = 1 << 22
#: Windows of one task are numbered from its partition times this.
SEQUENCES = 1 << 33


class SumOfSquares:
    """Open windows by fill level; ``counts[h]`` of them are filled up to ``h``."""

    def __init__(self, window: int):
        self.window = window
        self.counts = np.zeros(window + 1, dtype=np.int64)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]
        self.sequences = 0
        self.holes = 0

    def new(self) -> int:
        self.sequences += 1
        return self.sequences - 1

    def place(self, size: int) -> tuple[int, int]:
        """Window and offset for ``size`` tokens, fewer than a window."""
        counts, window = self.counts, self.window
        levels = np.flatnonzero(counts[1:window - size + 1]) + 1
        best, level = 2 * counts[size] + 1, 0
        if levels.size:
            after = levels + size
            change = 1 - 2 * counts[levels] + np.where(after < window, 2 * counts[after] + 1, 0)
            lowest = len(levels) - 1 - int(np.argmin(change[::-1]))
            if change[lowest] <= best:
                level = int(levels[lowest])
        if level:
            counts[level] -= 1
            sequence = self.open[level].pop()
            self.holes -= size
        else:
            sequence = self.new()
            self.holes += window - size
        if level + size < window:
            counts[level + size] += 1
            self.open[level + size].append(sequence)
        return sequence, level

    def close(self) -> list[int]:
        """The open windows, fullest first; none is open afterwards."""
        out = [sequence for level in range(self.window - 1, 0, -1) for sequence in self.open[level]]
        self.counts[:] = 0
        for own in self.open:
            own.clear()
        self.holes = 0
        return out

    def reopen(self, sequence: int, level: int) -> None:
        """A closed window is open again, filled up to ``level``."""
        self.counts[level] += 1
        self.open[level].append(sequence)
        self.holes += self.window - level


def pack_stream(docs, window: int, held: int = HELD):
    """For an iterator of (key, ids): tuples of key, start, ids of the piece, ids of the document, window number, offset."""
    packer, waiting, tokens = SumOfSquares(window), {}, 0

    def deal(last: bool):
        """Pieces of the open windows one behind the other into as few of them as they need; the one not filled stays open unless it is the ``last`` time."""
        sequences = packer.close()
        pieces = [piece for sequence in sequences for piece in waiting.pop(sequence)]
        at, level, own = 0, 0, []
        for key, start, ids, n in pieces:
            done = 0
            while done < len(ids):
                part = ids[done:done + window - level]
                own.append((key, start + done, part, n))
                done, level = done + len(part), level + len(part)
                if level == window:
                    yield from given(own, sequences[at])
                    at, level, own = at + 1, 0, []
        if last:
            yield from given(own, sequences[at] if own else 0)
        elif own:
            packer.reopen(sequences[at], level)
            waiting[sequences[at]] = own

    def given(pieces, sequence):
        offset = 0
        for key, start, ids, n in pieces:
            yield key, start, ids, n, sequence, offset
            offset += len(ids)

    for key, ids in docs:
        whole = len(ids) - len(ids) % window
        for start in range(0, whole, window):
            yield key, start, ids[start:start + window], len(ids), packer.new(), 0
        if whole == len(ids):
            continue
        rest = ids[whole:].copy()  # a view would keep the whole document
        sequence, level = packer.place(len(rest))
        waiting.setdefault(sequence, []).append((key, whole, rest, len(ids)))
        tokens += len(rest)
        if level + len(rest) == window:
            yield from given(waiting.pop(sequence), sequence)
            tokens -= window
        elif tokens > held:
            yield from deal(False)
            tokens %= window
    yield from deal(True)


NUMBERS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row for each piece: its document, its place there and in its window, the checksum of its ids, and the ids if asked for.

    ``tokenizer`` is the path of a tokenizer file that every executor has.
    """
    parts = boxed(docs, doc_id=doc_id, text=text).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        encode = encoder(tokenizer).encode

        def documents():
            for batch in slices(batches, "text"):
                ids, numbers = encode(batch.column("text").to_pylist())
                ends = np.cumsum(numbers)
                for key, end, n in zip(batch.column("doc_id").to_pylist(), ends.tolist(), numbers.tolist()):
                    yield key, np.append(ids[end - n:end], np.uint32(end_id))

        base = TaskContext.get().partitionId() * SEQUENCES
        rows: list[tuple] = []
        for key, start, piece, n, sequence, offset in pack_stream(documents(), window):
            crc = zlib.crc32(piece.astype("<u4").tobytes())
            rows.append((key, start, len(piece), crc, n, base + sequence, offset) + ((piece.astype(np.int32),) if with_ids else ()))
            if len(rows) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    names = ["doc_id", *NUMBERS] + ["ids"] * with_ids
    schema = StructType([parts.schema["doc_id"], *[StructField(name, LongType()) for name in NUMBERS]])
    if with_ids:
        schema = schema.add("ids", ArrayType(IntegerType()))
    types = [to_arrow_type(f.dataType) for f in schema.fields]
    return parts.mapInArrow(run, schema)
