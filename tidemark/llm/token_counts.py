"""Token counts of whole texts; huge documents are encoded in overlapping chunks which are spliced where both agree.

A boundary is stable if a piece starts there with the mark of a space, the character before is no space, and no piece of the
vocabulary holds such a mark behind another character: then no merge can cross it, and what stands on either side cannot change what
happens on the other.  The vocabulary is asked once for each worker.  Two chunks are spliced at a stable boundary that both have inside
their overlap; if there is none, the overlap is doubled, in the end to the whole rest of the text.

Defined results: null and empty texts have no tokens; equal rows are counted each; special strings in a text are ordinary text.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from tidemark.llm.common import boxed, slices

#: Bytes of a chunk and of the first overlap; shorter texts are encoded at once.
CHUNK, OVERLAP = 32_768, 256
MARK = "\u2581"
MARK_BYTES = MARK.encode()

_LOADED: dict[str, tuple] = {}


def load(path: str):
    """The processor and whether stable boundaries exist in its vocabulary."""
    if path not in _LOADED:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
        _LOADED[path] = sp, not any(MARK in piece.lstrip(MARK) for piece in pieces)
    return _LOADED[path]


def _aligned(raw: bytes, at: int) -> int:
    """The first start of a character at or behind ``at``."""
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return at


def _boundaries(sp, raw: bytes, begin: int, end: int) -> tuple[dict[int, int], int]:
    """Encode a chunk: number of its tokens before each stable boundary, by the byte in the whole text, and of all tokens."""
    chunk = raw[begin:end]
    pieces = sp.encode(chunk.decode(), return_type="proto").pieces
    before = {}
    for n, piece in enumerate(pieces):
        at = piece.begin
        if piece.piece.startswith(MARK) and 0 < at and chunk[at:at + 1] == b" " and chunk[at - 1:at] != b" " and chunk[at + 1:at + 2] != b" " and chunk[max(0, at - 3):at] != MARK_BYTES and chunk[at + 1:at + 4] != MARK_BYTES:
            before[begin + at] = n
    return before, len(pieces)


def count(sp, stable: bool, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of ``text`` as the library gives them for the whole of it."""
    raw = text.encode()
    if len(raw) <= chunk or not stable:
        return len(sp.encode(text))
    total = skipped = begin = 0
    end = _aligned(raw, chunk)
    left, n_left = _boundaries(sp, raw, begin, end)
    while end < len(raw):
        width = overlap
        while True:
            start = _aligned(raw, max(begin, end - width))
            if start <= begin or start >= end:  # no common boundary in the whole chunk: make it longer
                end = _aligned(raw, end + max(chunk, end - begin))
                left, n_left = _boundaries(sp, raw, begin, end)
                break
            stop = _aligned(raw, start + max(chunk, 2 * width))
            right, n_right = _boundaries(sp, raw, start, stop)
            common = [p for p in left.keys() & right.keys() if left[p] >= skipped]
            if common:
                at = min(common, key=lambda p: abs(2 * p - start - end))
                total += left[at] - skipped
                begin, end, skipped, left, n_left = start, stop, right[at], right, n_right
                break
            width *= 2
    return total + n_left - skipped


def token_counts(docs: DataFrame, model: str, text: str = "text", limit: int = 4096) -> DataFrame:
    """Struct ``row`` of the input, ``n_bytes``, ``n_tokens`` and whether these are more than ``limit``.

    ``model`` is the path of a model file that every executor has.
    """
    parts = boxed(docs, text=text).withColumn("text", F.coalesce("text", F.lit("")))

    def counted(batches):
        sp, stable = load(model)
        for batch in slices(batches, "text", 1 << 20):
            texts = batch.column("text").to_pylist()
            counts = [0] * len(texts)
            sizes = pa.compute.cast(pa.compute.binary_length(batch.column("text")), pa.int64())
            long = [n > CHUNK for n in sizes.to_pylist()]
            short = [i for i, is_long in enumerate(long) if not is_long]
            for i, ids in zip(short, sp.encode([texts[i] for i in short], num_threads=1)):
                counts[i] = len(ids)
            for i, is_long in enumerate(long):
                if is_long:
                    counts[i] = count(sp, stable, texts[i])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), sizes, pa.array(counts, pa.int64()), pa.array([n > limit for n in counts])], names=["row", "n_bytes", "n_tokens", "over_limit"])

    schema = StructType([parts.schema["row"], StructField("n_bytes", LongType()), StructField("n_tokens", LongType()), StructField("over_limit", BooleanType())])
    return parts.mapInArrow(counted, schema)
