"""WARC bundles: records in independent Zstandard frames, with a seek table at the end and an index of records."""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import salt_of, salted_lookup, shared_dir, written

#: Payloads from so many bytes are stored once.
REVISIT_BYTES = 1000
#: Uncompressed bytes after which a frame, and compressed bytes after which a bundle, is closed.
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 26
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
#: The seekable format's fixed values: magic of a skippable frame and of the table's footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record_id(page_id: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None) -> bytes:
    """A response record, or with payload None a revisit of the response of page refers_to."""
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Date: {DATE}", f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Target-URI: {''.join((url or '').split())}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if payload is None:
        lines += [f"WARC-Profile: {SAME_PAYLOAD}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    block = HTTP + (payload or b"")
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]


def parse(data: bytes, at: int = 0) -> tuple[Record, int]:
    """The record at a place of an uncompressed frame, and the place after it."""
    end = data.index(b"\r\n\r\n", at)
    head = data[at:end].decode().split("\r\n")
    if not head[0].startswith("WARC/"):
        raise ValueError("no record starts here")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head[1:])
    start, size = end + 4, int(headers["Content-Length"])
    if data[start + size : start + size + 4] != b"\r\n\r\n":
        raise ValueError("the record is cut short")
    return Record(headers, data[start : start + size]), start + size + 4


class BundleWriter:
    """Appends records to frames of one bundle; close() writes the seek table."""

    def __init__(self, uri: str, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.uri, self.frame_bytes = uri, frame_bytes
        where, path = fs.FileSystem.from_uri(uri)
        where.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.compressor = where.open_output_stream(path, compression=None), zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frame, self.table, self.size = bytearray(), [], 0

    def add(self, data: bytes) -> tuple[int, int]:
        """The number of the record's frame, and its offset in the uncompressed frame."""
        if self.frame and len(self.frame) + len(data) > self.frame_bytes:
            self._end_frame()
        at = len(self.table), len(self.frame)
        self.frame += data
        return at

    def _end_frame(self) -> None:
        packed = self.compressor.compress(bytes(self.frame))
        self.out.write(packed)
        self.table.append((len(packed), len(self.frame)))
        self.size += len(packed)
        self.frame.clear()

    def close(self) -> None:
        if self.frame:
            self._end_frame()
        entries = b"".join(struct.pack("<II", *x) for x in self.table)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(self.table), 0, SEEKABLE))
        self.out.close()


class BundleReader:
    """Random access: the footer's table says where frames lie; only frames asked for are read."""

    def __init__(self, uri: str):
        where, path = fs.FileSystem.from_uri(uri)
        self.file = where.open_input_file(path)
        size = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{uri} has no seek table")
        entry = 12 if flags & 0x80 else 8
        table = self.file.read_at(count * entry, size - 9 - count * entry)
        self.frames, at = [], 0
        for k in range(count):
            packed, plain = struct.unpack_from("<II", table, k * entry)
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, number: int) -> bytes:
        at, packed, plain = self.frames[number]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=plain)

    def record(self, frame: int, offset: int) -> Record:
        return parse(self.frame(frame), offset)[0]

    def close(self) -> None:
        self.file.close()


def _decided(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int) -> DataFrame:
    """Pages with payload, digest, size and, for revisits, refers_to."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    # a payload's size is part of the key, so small ones never meet a response
    best = rows.filter(F.col("size") >= least).groupBy("digest", "size").agg(F.max("page_id").alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    rows = salted_lookup(rows, best, ["digest", "size"], salt_of(F.col("page_id"), salts=64), how="left", keep_salt=True)
    # of rows that repeat the id of the response one is the response; they share a salt, so payloads do not move again
    nth = F.row_number().over(Window.partitionBy("digest", "size", "_salt", "page_id").orderBy(F.lit(1)))
    alone = F.col("best").isNull() | (F.col("page_id").eqNullSafe(F.col("best")) & (F.col("_nth") == 1))
    rows = rows.withColumn("_nth", F.when(F.col("page_id").eqNullSafe(F.col("best")), nth).otherwise(0))
    return rows.withColumns({"refers_to": F.when(~alone, F.col("best")), "payload": F.when(alone, F.col("payload"))}).drop("best", "_nth", "_salt")


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = REVISIT_BYTES, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes a record a page into bundles in folder, and returns the index: page_id, record_id, bundle, frame, offset.

    Of equal payloads of at least `least` bytes the one with the largest page_id is the response, the others revisit
    it; one of rows that repeat that id is the response. Smaller payloads are all responses. Null html is an empty
    payload; null urls are empty; a null page_id is written without an id and never the response of others with an id.
    An empty table writes no bundle.

    A task names each bundle anew, so a task that runs again never harms another's; only bundles that the index names count.
    The index is written to the shared folder before it is used, so bundles are not written twice. folder is any place that pyarrow.fs opens and all executors share.
    """
    rows = _decided(pages, id_col, url_col, html_col, least)
    kind = rows.schema["page_id"].dataType
    schema = T.StructType([T.StructField("page_id", kind), T.StructField("record_id", T.StringType()), T.StructField("bundle", T.StringType()), T.StructField("frame", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, index = None, []
        names = [f.name for f in schema]
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "size", "refers_to")), strict=True):
                page_id, url, payload, digest, size, refers_to = (x.as_py() for x in row)
                if out is None:
                    out = BundleWriter(f"{folder}/{uuid.uuid4().hex}.warc.zst", frame_bytes)
                index.append((page_id, record_id(page_id, digest), out.uri, *out.add(record(page_id, url, payload, digest, size, refers_to))))
                if out.size >= bundle_bytes:
                    out.close()
                    out = None
            if out is None and index:  # rows of a bundle go on once it is complete
                yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in index], schema=_arrow(schema))
                index = []
        if out is not None:
            out.close()
        if index:
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in index], schema=_arrow(schema))

    return written(rows.mapInArrow(run, schema))


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def read_warc(index: DataFrame) -> DataFrame:
    """The records that an index names, read from their bundles: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Frames are dealt over tasks; each is fetched by the seek table and decompressed once. A response's payload is
    hashed again and must have the digest of its header.
    """
    kind = index.schema["page_id"].dataType
    schema = T.StructType([T.StructField("page_id", kind), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", kind)])
    number = (lambda x: x) if isinstance(kind, T.StringType) else int

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = name = None
        for batch in batches:
            rows = []
            for bundle, frame, offsets in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bundle != name:
                    if reader:
                        reader.close()
                    reader, name = BundleReader(bundle), bundle
                data = reader.frame(frame)
                for offset in offsets:
                    found = parse(data, offset)[0]
                    head, payload = found.headers, found.payload
                    digest, kept = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"] == "response"
                    if kept and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(head["X-Payload-Length"])):
                        raise ValueError(f"{bundle}: the payload of {head['WARC-Record-ID']} is damaged")
                    page, refers = head.get("X-Page-Id"), head.get("X-Refers-To-Page")
                    rows.append((number(page) if page is not None else None, int(head["X-Payload-Length"]), digest, head["WARC-Type"], number(refers) if refers is not None else None))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=_arrow(schema))

    frames = index.groupBy("bundle", "frame").agg(F.collect_list("offset").alias("offsets"))  # a frame's records: bounded by its bytes
    return frames.repartition("bundle", "frame").sortWithinPartitions("bundle", "frame").mapInArrow(run, schema)


def warc_round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Pages written as records and read back; folder defaults to a new one in the shared folder."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/quire/warc-{uuid.uuid4().hex}"
    return read_warc(write_warc(pages, folder))
