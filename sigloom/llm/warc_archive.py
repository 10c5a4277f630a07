"""WARC archives in Zstandard: one frame per record, a dictionary in the leading skippable frame.

Archives are binary values (name, data) of a DataFrame, so any store that Spark writes can hold
them; ``write_archives`` makes them, ``read_archives`` takes them apart again.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.llm.common import free_prefix, slices

# Fixed values of the Zstandard format and of the WARC dictionary convention.
FRAME_MAGIC = 0xFD2FB528
DICTIONARY_FRAME_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_NAMES = uuid.UUID("5f2bb6f4-3e0c-4f0e-9a36-6a6d5ad0c8a1")
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


class ArchiveError(ValueError):
    """An archive or record that breaks the format."""


# --- writer ----------------------------------------------------------------------------------


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id}:{digest}')}>"


def record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One WARC record; with ``refers_to`` a revisit, which keeps the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)))
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    fields += [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page", str(refers_to))]
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def train(samples: list[bytes], size: int = 16 << 10) -> bytes:
    """A dictionary trained on ``samples``, or no bytes where they are too few or too short."""
    if len(samples) < 16 or sum(map(len, samples)) < 8 * size:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


class Writer:
    """Gathers records of one archive."""

    def __init__(self, dictionary: bytes, level: int):
        self.data = bytearray()
        if dictionary:
            packed = zstandard.ZstdCompressor(level=level).compress(dictionary)
            self.data += struct.pack("<II", DICTIONARY_FRAME_MAGIC, len(packed)) + packed
        kept = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.pack = zstandard.ZstdCompressor(level=level, dict_data=kept, write_checksum=True, write_content_size=True).compress
        self.records = 0

    def add(self, data: bytes) -> None:
        self.data += self.pack(data)
        self.records += 1


def mark_revisits(pages: DataFrame, min_bytes: int = 100, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """``pages`` with ``payload_digest`` and ``refers_to``, the smallest id with an equal payload (null: a response).

    Only digests are grouped, with partial aggregation; those that repeat come back by an equi-join,
    whose other side AQE splits where a page is very common.
    """
    first_id = free_prefix(pages.columns) + "first"
    body = F.coalesce(F.col(html), F.lit(""))
    tagged = pages.drop("payload_digest", "refers_to").withColumn("payload_digest", F.sha2(body, 256))
    long = F.octet_length(body) >= min_bytes
    first = tagged.where(long).groupBy("payload_digest").agg(F.min(id_col).alias(first_id), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    out = tagged.join(first, "payload_digest", "left")
    other = long & ~F.col(id_col).eqNullSafe(F.col(first_id))
    return out.withColumn("refers_to", F.when(other, F.col(first_id))).drop(first_id)


def write_archives(pages: DataFrame, min_bytes: int = 100, archive_bytes: int = 8 << 20, sample: int = 256, level: int = 3, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Archives (name string, n_records long, data binary) with one record for each row of ``pages``.

    Each task trains a dictionary on its first ``sample`` records (a bounded sample) and starts a
    new archive once one has reached ``archive_bytes``. Of equal payloads of ``min_bytes`` or more
    the one with the smallest id is a response, all others are revisits of it; equal rows with that
    id are all responses. A null html is an empty payload, a null url or id leaves its field out.
    """
    rows = mark_revisits(pages, min_bytes, id_col, html).select(id_col, url, html, "payload_digest", "refers_to")

    def run(batches):
        held, writer, number, names = [], None, 0, hashlib.sha256()

        def close():
            nonlocal writer, number
            out = {"name": [f"{names.hexdigest()[:24]}-{number:05d}.warc.zst"], "n_records": [writer.records], "data": [bytes(writer.data)]}
            writer, number = None, number + 1
            return pa.RecordBatch.from_pydict(out, pa.schema([("name", pa.string()), ("n_records", pa.int64()), ("data", pa.binary())]))

        def records():
            for batch in batches:
                for part in slices(batch, 4 << 20):
                    for page_id, link, text, digest, refers_to in zip(*(c.to_pylist() for c in part.columns), strict=True):
                        names.update(f"{page_id},{digest};".encode())
                        yield record(page_id, link, (text or "").encode("utf-8", "surrogatepass"), digest, refers_to, date)

        import pyarrow as pa

        dictionary, source = None, records()
        while True:
            if dictionary is None:
                size = 0
                for one in source:
                    held.append(one)
                    size += len(one)
                    if len(held) >= sample or size > 8 << 20:
                        break
                dictionary = train(held)
                pending, held = held, []
            else:
                pending = source
            any_ = False
            for one in pending:
                any_ = True
                writer = writer or Writer(dictionary, level)
                writer.add(one)
                if len(writer.data) >= archive_bytes:
                    yield close()
            if pending is source or not any_:
                break
        if writer:
            yield close()

    return rows.mapInArrow(run, "name string, n_records long, data binary")


# --- reader ----------------------------------------------------------------------------------


def frame_end(data, at: int) -> int:
    """Where the Zstandard frame at ``at`` ends, found by its block headers."""
    if at + 6 > len(data) or struct.unpack_from("<I", data, at)[0] != FRAME_MAGIC:
        raise ArchiveError(f"no frame at byte {at}")
    flags = data[at + 4]
    single = flags >> 5 & 1
    at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    last = False
    while not last:
        if at + 3 > len(data):
            raise ArchiveError("a frame is cut short")
        block = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = block & 1, block >> 1 & 3, block >> 3
        if kind == 3:
            raise ArchiveError("a reserved block type")
        at += 3 + (1 if kind == 1 else size)
    at += 4 * (flags >> 2 & 1)
    if at > len(data):
        raise ArchiveError("a frame is cut short")
    return at


def load_dictionary(data) -> tuple[bytes, int]:
    """The dictionary of the leading skippable frame (itself perhaps compressed), and where records begin."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICTIONARY_FRAME_MAGIC:
        return b"", 0
    (size,) = struct.unpack_from("<I", data, 4)
    if 8 + size > len(data):
        raise ArchiveError("the dictionary frame is cut short")
    body = bytes(data[8 : 8 + size])
    if body[:4] == struct.pack("<I", FRAME_MAGIC):
        try:
            body = zstandard.ZstdDecompressor().decompress(body)
        except zstandard.ZstdError as wrong:
            raise ArchiveError(f"the dictionary: {wrong}") from wrong
    return body, 8 + size


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields (names in lower case) and block of one whole record; ArchiveError where it is invalid."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise ArchiveError("no WARC version line or no end of header")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ArchiveError("a header line without a name")
        fields[name.strip().decode().lower()] = value.strip().decode("utf-8", "surrogatepass")
    for needed in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if needed not in fields:
            raise ArchiveError(f"{needed} is missing")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ArchiveError("the block's length is not Content-Length")
    block = rest[:-4]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ArchiveError("the block digest is wrong")
    return fields, block


def records_of(data):
    """(fields, block) of all records of one archive: one frame for each."""
    dictionary, at = load_dictionary(data)
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    view = memoryview(data)
    while at < len(data):
        end = frame_end(view, at)
        frame = bytes(view[at:end])
        size = zstandard.frame_content_size(frame)
        try:
            whole = unpack.decompress(frame, max_output_size=0 if size >= 0 else 1 << 30)
        except zstandard.ZstdError as wrong:
            raise ArchiveError(str(wrong)) from wrong
        yield parse_record(whole)
        at = end


def payload_of(fields: dict[str, str], block: bytes) -> tuple[int, bytes | None]:
    """Length of the full payload, and the payload itself unless the record is a revisit."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"HTTP/"):
        raise ArchiveError("no HTTP header in the block")
    length = re.search(rb"(?im)^content-length:[ \t]*(\d+)\r?$", head)
    if not length:
        raise ArchiveError("no HTTP Content-Length")
    if fields["warc-type"] == "revisit":
        if body:
            raise ArchiveError("a revisit with a payload")
        return int(length[1]), None
    if len(body) != int(length[1]):
        raise ArchiveError("the payload's length is not the HTTP Content-Length")
    if fields.get("warc-payload-digest") != f"sha256:{hashlib.sha256(body).hexdigest()}":
        raise ArchiveError("the payload digest is wrong")
    return len(body), body


READ_SCHEMA = T.StructType([T.StructField(n, k) for n, k in (
    ("archive", T.StringType()), ("page_id", T.LongType()), ("url", T.StringType()), ("record_type", T.StringType()), ("record_id", T.StringType()),
    ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("refers_to", T.LongType()), ("payload", T.BinaryType()),
)])


def read_archives(archives: DataFrame, payload: bool = True) -> DataFrame:
    """One row for each record of ``archives`` (name, data), after all checks; an invalid archive raises ArchiveError.

    ``payload=False`` leaves the payload column null: it is read and checked all the same.
    """
    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(READ_SCHEMA)

        def flush(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for i in range(batch.num_rows):
                name, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                rows, size = [], 0
                for fields, block in records_of(data or b""):
                    n, body = payload_of(fields, block)
                    digest = fields["warc-payload-digest"].removeprefix("sha256:")
                    number = lambda k, f=fields: int(f[k]) if k in f else None
                    rows.append((name, number("x-page-id"), fields.get("warc-target-uri"), fields["warc-type"], fields["warc-record-id"], n, digest, number("x-refers-to-page"), body if payload else None))
                    size += len(body) if payload and body else 256
                    if size > 4 << 20:
                        yield flush(rows)
                        rows, size = [], 0
                if rows:
                    yield flush(rows)

    return archives.select("name", "data").mapInArrow(run, READ_SCHEMA)
