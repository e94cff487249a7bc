"""WARC archives: one gzip member for each record, equal payloads stored once, and a sequential reader that verifies them.

Writing: payloads that occur several times are known by their SHA-256 and length from one partial aggregate; the row with the largest id keeps the payload as
``response``, the others become ``revisit`` records with the HTTP header only.  Whether a page is a revisit comes by a join on the digest, which the optimizer may
broadcast if it is small and splits where a digest is frequent.  Each task writes its records into files of bounded size in the shared folder and names them in a manifest;
files of lost or repeated tasks are in no manifest.

Reading: a member is inflated step by step into a buffer of bounded size, its header lines are read up to the empty line, the block is framed by Content-Length and
hashed as it passes, and the record has to end with its member.  Digests of block and payload are compared with the header.

Defined results: a null payload is empty; payloads shorter than ``least`` bytes are never revisits; rows which share the largest id of a group are all responses; a group in which
no row has an id has responses only; a null URL becomes ``urn:page:`` and the id; control and other characters that would break a header line are percent-encoded in URLs; an empty table gives no files and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from itertools import chain
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.common import boxed, file_system, run_folder, slices, written

LEAST, FILE_BYTES, CHUNK, HEADER_BYTES = 1000, 256 << 20, 1 << 16, 1 << 20
#: Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_RESPONSE = "application/http;msgtype=response"
#: Extension fields, which carry the ids of rows.
PAGE, REFERS_TO_PAGE = "X-Page-Id", "X-Refers-To-Page-Id"

MANIFEST = "folder string, path string, n_records long"
RECORD = "path string, offset long, record_type string, record_id string, uri string, date string, page_id long, payload_bytes long, payload_digest string, refers_to long, problem string"


def base32_digest(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = b"\r\n".join([VERSION, *[f"{name}: {value}".encode() for name, value in fields], b"Content-Length: %d" % len(block)])
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return b"".join([packer.compress(head + b"\r\n\r\n"), packer.compress(block), packer.compress(b"\r\n\r\n"), packer.flush()])


def record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(repr(parts).encode()).digest()[:16])}>"


def page_record(page_id, url, payload: bytes, digest: str, n_bytes: int, refers_to, date: str) -> bytes:
    """The record of a page; with ``refers_to`` a revisit, for which ``payload`` is not needed."""
    uri = quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else f"urn:page:{page_id}"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n_bytes
    block = http if refers_to is not None else http + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, uri, digest)), ("WARC-Date", date), ("WARC-Target-URI", uri)]
    if page_id is not None:
        fields.append((PAGE, str(page_id)))
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), (REFERS_TO_PAGE, str(refers_to))]
    fields += [("WARC-Payload-Digest", base32_digest(digest)), ("WARC-Block-Digest", base32_digest(hashlib.sha1(block).hexdigest())), ("Content-Type", HTTP_RESPONSE)]
    return record(fields, block)


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST, file_bytes: int = FILE_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write the archives; gives the manifest (folder, path, n_records), one row for each file."""
    folder = run_folder(pages.sparkSession, "warc")
    named = boxed(pages, page_id=page_id, url=url, payload=payload).select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("payload", F.lit("")).alias("payload"))
    digested = named.withColumns({"n_bytes": F.octet_length("payload").cast("long"), "same": F.sha2("payload", 256)})
    groups = digested.filter(F.col("n_bytes") >= least).groupBy("same", "n_bytes").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1 AND first IS NOT NULL")
    heads = written(groups.select("same", F.col("n_bytes").alias("size"), "first"), "warc-heads")
    both = digested.join(heads, (digested.same == heads.same) & (digested.n_bytes == heads.size), "left")
    refers_to = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = both.select("page_id", "url", F.sha1("payload").alias("digest"), "n_bytes", refers_to.alias("refers_to"), F.when(refers_to.isNull(), F.col("payload")).alias("payload"))

    def run(batches):
        fs, base = file_system(folder)
        attempt = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        sink, done, n = None, [], 0
        for batch in slices(batches, "payload"):
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "n_bytes", "refers_to"))):
                if sink is None:
                    fs.create_dir(base)
                    path = f"{base}/{attempt}-{len(done):05d}.warc.gz"
                    sink, n = fs.open_output_stream(path, compression=None), 0
                    sink.write(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(path)), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"software: tidemark\r\nformat: WARC File Format 1.1\r\n"))
                key, address, text, digest, n_bytes, other = row
                sink.write(page_record(key, address, (text or "").encode(), digest, n_bytes, other, date))
                n += 1
                if sink.tell() >= file_bytes:
                    sink.close()
                    done.append((folder, path, n))
                    sink = None
        if sink is not None:
            sink.close()
            done.append((folder, path, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.string(), pa.string(), pa.int64()))], names=["folder", "path", "n_records"])

    return written(rows.mapInArrow(run, MANIFEST), "warc-manifest")


class Damaged(ValueError):
    """What a record says and what it holds differ."""


class Members:
    """The gzip members of a stream one after another, inflated step by step.  Holds a chunk of the file and one of the content."""

    def __init__(self, stream):
        self.stream, self.raw, self.read_bytes, self.ready, self.inflater = stream, b"", 0, bytearray(), None

    def _more_raw(self) -> bool:
        if not self.raw:
            self.raw = self.stream.read(CHUNK)
            self.read_bytes += len(self.raw)
        return bool(self.raw)

    def next(self) -> int | None:
        """Begin the next member; gives its place in the file, or None at the end."""
        if not self._more_raw():
            return None
        self.inflater, self.ready = zlib.decompressobj(31), bytearray()
        return self.read_bytes - len(self.raw)

    def _step(self) -> bool:
        """Inflate some more of the member; False at its end."""
        if self.inflater.eof:
            return False
        if not self._more_raw():
            raise Damaged("the file ends inside a member")
        try:
            self.ready += self.inflater.decompress(self.raw, CHUNK)
        except zlib.error as error:
            raise Damaged(str(error)) from None
        self.raw = self.inflater.unused_data if self.inflater.eof else self.inflater.unconsumed_tail
        return True

    def until_empty_line(self, most: int) -> bytes:
        """The bytes up to an empty line, which is passed over."""
        begin = 0
        while (at := self.ready.find(b"\r\n\r\n", begin)) < 0:
            begin = max(0, len(self.ready) - 3)
            if begin > HEADER_BYTES or len(self.ready) > most or not self._step():
                raise Damaged("a header without an end")
        out = bytes(self.ready[:at])
        del self.ready[:at + 4]
        return out

    def pieces(self, size: int):
        """Exactly ``size`` bytes, piece by piece."""
        while size:
            if not self.ready and not self._step():
                raise Damaged("the block is shorter than its Content-Length")
            piece = bytes(self.ready[:size])
            del self.ready[:size]
            size -= len(piece)
            if piece:
                yield piece

    def finish(self) -> None:
        """The record's last four bytes and the end of the member."""
        if b"".join(self.pieces(4)) != b"\r\n\r\n":
            raise Damaged("no two line ends behind the block")
        while self._step():
            pass
        if self.ready:
            raise Damaged("the block is longer than its Content-Length")


def fields_of(lines: list[bytes]) -> dict[str, str]:
    """Header fields by lower-case name; of repeated ones the first."""
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("a header line without a colon")
        out.setdefault(name.strip().lower().decode("ascii", "replace"), value.strip().decode("utf-8", "replace"))
    return out


def hex_digest(text: str | None) -> str | None:
    """The hexadecimal SHA-1 of a ``sha1:`` header value in base 32 or 16."""
    if text is None or not text.lower().startswith("sha1:"):
        return None
    value = text[5:]
    try:
        return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()
    except ValueError:
        raise Damaged("a digest that is neither base 32 nor base 16") from None


def read_records(stream, keep_payload: bool = False):
    """(offset, fields, payload size, payload digest, payload or None, problem) of each record, in order.

    A wrong digest is told in ``problem``; a record whose frame is broken is the last one.
    """
    members = Members(stream)
    while (offset := members.next()) is not None:
        fields: dict[str, str] = {}
        try:
            lines = members.until_empty_line(HEADER_BYTES).split(b"\r\n")
            if not lines[0].startswith(b"WARC/1."):
                raise Damaged("no WARC record")
            fields = fields_of(lines[1:])
            length = fields.get("content-length", "")
            if not length.isascii() or not length.isdigit():
                raise Damaged("no Content-Length")
            length, block, payload, kept, size, http = int(length), hashlib.sha1(), hashlib.sha1(), [], 0, None
            rest = length
            if fields.get("content-type", "").replace(" ", "") == HTTP_RESPONSE:
                http = members.until_empty_line(length)
                block.update(http + b"\r\n\r\n")
                rest -= len(http) + 4
                if rest < 0:
                    raise Damaged("the HTTP header is longer than the block")
            for piece in members.pieces(rest):
                block.update(piece)
                payload.update(piece)
                size += len(piece)
                if keep_payload:
                    kept.append(piece)
            members.finish()
            told, digest, problem = hex_digest(fields.get("warc-payload-digest")), payload.hexdigest(), None
            if (of_block := hex_digest(fields.get("warc-block-digest"))) not in (None, block.hexdigest()):
                problem = f"block digest {block.hexdigest()} is not {of_block}"
            if fields.get("warc-type") == "revisit" and http is not None:
                size, digest = int(fields_of(http.split(b"\r\n")[1:]).get("content-length", "0")), told
            elif told not in (None, digest):
                problem = f"payload digest {digest} is not {told}"
        except Damaged as error:
            yield offset, fields, None, None, None, str(error)
            return
        yield offset, fields, size, digest, b"".join(kept) if keep_payload else None, problem


def read_archives(manifest: DataFrame, keep_payload: bool = False) -> DataFrame:
    """One row for each record of the files in ``manifest`` (folder, path), a file in one task after another."""
    n = manifest.count()
    schema = StructType.fromDDL(RECORD + (", payload binary" if keep_payload else ""))
    arrow = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    types = [arrow[f.dataType.simpleString()] for f in schema.fields]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=schema.names)

    def number(text):
        return None if text is None else int(text)

    def run(batches):
        for folder, path in chain.from_iterable(zip(b.column("folder").to_pylist(), b.column("path").to_pylist()) for b in batches):
            out, held = [], 0
            with file_system(folder)[0].open_input_stream(path, compression=None) as stream:
                for offset, f, size, digest, payload, problem in read_records(stream, keep_payload):
                    row = (path, offset, f.get("warc-type"), f.get("warc-record-id"), f.get("warc-target-uri"), f.get("warc-date"), number(f.get(PAGE.lower())), size, digest, number(f.get(REFERS_TO_PAGE.lower())), problem)
                    out.append(row + ((payload,) if keep_payload else ()))
                    held += len(payload or b"")
                    if len(out) == 4096 or held > 4 << 20:
                        yield batch_of(out)
                        out, held = [], 0
            if out:
                yield batch_of(out)

    return manifest.select("folder", "path").repartition(max(1, n)).mapInArrow(run, schema)


def archived_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write the archives and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, problem."""
    found = read_archives(write_archives(pages, page_id, url, payload))
    return found.filter(~F.col("record_type").eqNullSafe("warcinfo")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")
