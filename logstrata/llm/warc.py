"""WARC archives: a writer that leaves out repeated payloads and a salvage reader."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logstrata.operators.skew import lookup_side

# Compressed bytes after which an archive file is closed. Only a larger single record exceeds it.
ARCHIVE_BYTES = 32 * 1024 * 1024
LEVEL = 4
ID_PREFIX = "urn:logstrata:record:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_VERSION = re.compile(rb"WARC/\d+\.\d+\r?\n")
_MAGIC = b"\x1f\x8b\x08"
_PIECE = 1 << 14

RECORD = T.StructType([
    T.StructField("archive", T.StringType()), T.StructField("offset", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("kind", T.StringType()),
    T.StructField("reason", T.StringType()), T.StructField("record_id", T.StringType()),
    T.StructField("record_type", T.StringType()), T.StructField("target_uri", T.StringType()),
    T.StructField("refers_to", T.StringType()), T.StructField("payload_digest", T.StringType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload", T.BinaryType())])


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(record_id: str, uri: str | None, payload: bytes, sha1: str | None,
           refers_to: str | None, date: str) -> bytes:
    """One record as a gzip member; a revisit keeps the head of the response only."""
    revisit = refers_to is not None
    payload_digest = base64.b32encode(bytes.fromhex(sha1)).decode() if sha1 else digest(payload)
    head = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = head if revisit else head + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"),
              ("WARC-Record-ID", f"<{ID_PREFIX}{record_id}>"), ("WARC-Date", date),
              ("WARC-Payload-Digest", f"sha1:{payload_digest}"),
              ("WARC-Block-Digest", f"sha1:{digest(block)}"),
              ("Content-Type", "application/http; msgtype=response"),
              ("Content-Length", str(len(block)))]
    if uri is not None:
        fields.insert(2, ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", "", uri)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{ID_PREFIX}{refers_to}>")]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return b"".join((pack.compress(text.encode()), pack.compress(block),
                     pack.compress(b"\r\n\r\n"), pack.flush()))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html",
               uri_col: str | None = "url", min_payload: int = 0,
               date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write each row as a WARC record; gzip members in archives of about ``archive_bytes``.

    Of equal payloads of at least ``min_payload`` bytes, the record with the smallest id is the
    response and the others are revisits of it; rows that repeat the smallest id are responses
    too. A null payload is empty, a null id is written as ``null`` and comes after all others, a
    null address is left out; other columns are ignored. An empty table writes no record.

    The smallest id of each payload is found over digests, combined before the shuffle; digests
    that occur once are dropped from that side, and a digest with many rows may be split. The
    archives are written by Spark's own file writer, which keeps only the files of tasks that
    succeeded, on any file system. Its records end with one zero byte: this is the last byte of
    the last member's length field, or padding that gzip readers skip.
    """
    uri = F.col(uri_col) if uri_col else F.lit(None)
    payload = F.coalesce(F.encode(F.col(payload_col), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), uri.cast("string").alias("uri"),
                        payload.alias("payload")).withColumn("sha1", F.sha1("payload"))
    first = (rows.where(F.length("payload") >= min_payload).groupBy("sha1")
             .agg(F.min("id").alias("first"), F.count("*").alias("copies"))
             .where("copies > 1").select("sha1", "first"))
    joined = rows.join(lookup_side(first), "sha1", "left")
    records = joined.select(
        F.coalesce(F.col("id").cast("string"), F.lit("null")).alias("id"), "uri", "payload",
        "sha1", F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id")),
                       F.col("first").cast("string")).alias("refers_to"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                record_id, target, body, sha1, refers_to = row
                parts.append(member(record_id, target, body, sha1, refers_to, date))
                size += len(parts[-1])
                if size >= archive_bytes:
                    yield _archive(parts)
                    parts, size = [], 0
        if parts:
            yield _archive(parts)

    packed = records.mapInArrow(pack, "archive binary")
    (packed.select(F.col("archive").cast("string").alias("archive"))
     .write.option("lineSep", "\u0000").option("maxRecordsPerFile", 1).text(path))


def _archive(parts: list[bytes]) -> pa.RecordBatch:
    data = b"".join(parts)
    data = data[:-1] if data.endswith(b"\x00") else data
    return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["archive"])


class Damaged(Exception):
    member: tuple[bytes, int] | None = None  # text and end of the member, if it unpacks


def _parse(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at an offset and where it ends, or Damaged."""
    line = _VERSION.match(data, at)
    if not line:
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n", line.end() - 2)
    if end < 0:
        raise Damaged("head without end")
    fields: dict[str, str] = {}
    for part in data[line.end():end].decode("utf-8", "replace").split("\r\n"):
        name, colon, value = part.partition(":")
        if not colon and part:
            raise Damaged("bad head line")
        if colon:
            fields[name.strip().lower()] = value.strip()
    size = fields.get("content-length", "")
    if not size.isdigit():
        raise Damaged("no length")
    begin, stop = end + 4, end + 4 + int(size)
    block = data[begin:stop]
    if len(block) < int(size) or data[stop:stop + 4] != b"\r\n\r\n":
        raise Damaged("length does not fit")
    told = fields.get("warc-block-digest", "")
    if told.lower().startswith("sha1:") and told[5:] != digest(block):
        raise Damaged("block digest differs")
    return {**_payload(fields, block), "record_id": _bare(fields.get("warc-record-id")),
            "record_type": fields.get("warc-type"), "target_uri": fields.get("warc-target-uri"),
            "refers_to": _bare(fields.get("warc-refers-to"))}, stop + 4


def _payload(fields: dict[str, str], block: bytes) -> dict:
    told = fields.get("warc-payload-digest", "")
    told = told[5:] if told.lower().startswith("sha1:") else None
    head, payload, size = b"", block, len(block)
    if fields.get("content-type", "").startswith("application/http"):
        cut = block.find(b"\r\n\r\n")
        if cut < 0:
            raise Damaged("no end of the response head")
        head, payload = block[:cut + 4], block[cut + 4:]
        size = len(payload)
    if fields.get("warc-type") == "revisit":
        length = re.search(rb"(?im)^content-length:\s*(\d+)", head)
        return {"payload_digest": told, "payload_bytes": int(length[1]) if length else None,
                "payload": None}
    if told and told != digest(payload):
        raise Damaged("payload digest differs")
    return {"payload_digest": told or digest(payload), "payload_bytes": size, "payload": payload}


def _bare(uri: str | None) -> str | None:
    return uri.strip("<>").removeprefix(ID_PREFIX) if uri else None


def _record_at(data: bytes, at: int) -> tuple[dict, int]:
    """The record at an offset, packed or plain, and where it ends."""
    if not data.startswith((_MAGIC, b"WARC/"), at):
        raise Damaged("neither a member nor a version line")
    if not data.startswith(_MAGIC, at):
        return _parse(data, at)
    unpack, whole, end = zlib.decompressobj(31), [], at
    try:
        while not unpack.eof and end < len(data):
            piece = data[end:end + _PIECE]
            whole.append(unpack.decompress(piece))
            end += len(piece) - len(unpack.unused_data)
    except zlib.error as error:
        raise Damaged(f"member: {error}") from None
    if not unpack.eof:
        raise Damaged("member without end")
    text = b"".join(whole)
    try:
        record, length = _parse(text)
        if length != len(text):
            raise Damaged("more than one record in a member")
    except Damaged as error:
        error.member = text, end
        raise
    return record, end


def _records_inside(text: bytes) -> Iterator[tuple[int, int, str | None, dict]]:
    """Records and gaps of an unpacked member: (offset, length, reason of a gap, record)."""
    at, gap, reason = 0, None, ""
    while at < len(text):
        try:
            record, end = _parse(text, at)
        except Damaged as error:
            if gap is None:
                gap, reason = at, str(error)
            at = text.find(b"WARC/", at + 1)
            if at < 0:
                break
            continue
        if gap is not None:
            yield gap, at - gap, reason, {}
            gap = None
        yield at, end - at, None, record
        at = end
    if gap is not None:
        yield gap, len(text) - gap, reason, {}


def salvage(data: bytes) -> Iterator[tuple[int, int, str | None, dict]]:
    """Records and byte gaps of an archive, in order: (offset, length, reason of a gap, record).

    Where a check fails, the next place is searched at which a member or a version line begins
    and a whole record passes all checks; what lies between is one gap with the first reason.
    Zero bytes between members are padding, no gap. A member that unpacks well but is not one
    sound record is searched in the same way; its records and gaps have the member's offset and
    length, and the reason of such a gap tells its place in the unpacked text.
    """
    at, gap, reason = 0, None, ""
    while at < len(data):
        if data[at] == 0 and gap is None:
            at += 1
            continue
        try:
            record, end = _record_at(data, at)
        except Damaged as error:
            text, end = error.member or (b"", at)
            inside = list(_records_inside(text))
            if any(why is None for _, _, why, _ in inside):
                if gap is not None:
                    yield gap, at - gap, reason, {}
                    gap = None
                for first, size, why, record in inside:
                    why = why and f"{why}; {size} bytes at {first} of the unpacked member"
                    yield at, end - at, why, record
                at = end
                continue
            if gap is None:
                gap, reason = at, str(error)
            at = _next_start(data, at + 1)
            continue
        if gap is not None:
            yield gap, at - gap, reason, {}
            gap = None
        yield at, end - at, None, record
        at = end
    if gap is not None:
        yield gap, len(data) - gap, reason, {}


def _next_start(data: bytes, at: int) -> int:
    places = [p for p in (data.find(_MAGIC, at), data.find(b"WARC/", at)) if p >= 0]
    return min(places, default=len(data))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives in a folder, and what could not be read.

    ``kind`` is ``record`` or ``gap``. A gap has ``archive``, ``offset``, ``length`` and the
    ``reason``; nothing raises. ``payload_digest`` is the bare base32 SHA-1 and is checked for
    responses; ``payload_bytes`` of a revisit is the length that its stored response head tells.
    A folder without archives gives no rows.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, rows, size = batch.column(0)[i].as_py(), [], 0
                for offset, length, reason, record in salvage(batch.column(1)[i].as_py()):
                    rows.append({"archive": name, "offset": offset, "length": length,
                                 "kind": "gap" if reason else "record", "reason": reason, **record})
                    size += len(record.get("payload") or b"") + 500
                    if size > 8_000_000:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return files.mapInArrow(read, RECORD)


_ARROW = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
                    ("kind", pa.string()), ("reason", pa.string()), ("record_id", pa.string()),
                    ("record_type", pa.string()), ("target_uri", pa.string()),
                    ("refers_to", pa.string()), ("payload_digest", pa.string()),
                    ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_ARROW)
