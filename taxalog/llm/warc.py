"""WARC archives of Zstandard frames with a shared dictionary (operator 4).

An archive is a skippable frame that holds the dictionary, then one frame for each
record. Archives are rows (path, content), which is what ``binaryFile`` reads from
a folder of ``.warc.zst`` files, so files of other writers go through the same
reader.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxalog.storage import stored

MIN_REVISIT = 100
#: An archive ends with the record that takes it over so many bytes.
ARCHIVE_BYTES = 4 << 20
#: The dictionary is trained on that many first payloads of an archive's task, and so many bytes of each.
SAMPLES, SAMPLE_BYTES, DICTIONARY_BYTES = 128, 16 << 10, 16 << 10
DICTIONARY_FRAME = 0x184D2A5D
FEED = 16 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
FIELDS = ("path string, offset long, error string, record_id string, type string, uri string, payload_digest string, "
          "payload_bytes long, refers_to string, payload binary")


def plan_records(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with ``payload``, ``digest``, ``first``: the page whose equal payload it revisits.

    Payloads under ``MIN_REVISIT`` bytes, the smallest page_id of a group and rows
    without page_id in a group of such rows have a null ``first``. A null html is
    an empty payload; repeated rows of the smallest page_id are all responses.
    Digests are grouped within tasks before the shuffle, and only those that occur
    twice are stored and joined: where they are few, Spark broadcasts them and no
    payload is shuffled; else a digest that a third of the pages have is on the side
    of the pages, which adaptive execution splits. Other columns are ignored.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    groups = stored(rows.where(F.octet_length("payload") >= MIN_REVISIT).groupBy("digest")
                    .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
                    .select(F.col("digest").alias("_digest"), "first"), "groups")
    return (rows.join(groups, (F.col("digest") == F.col("_digest")) & (F.octet_length("payload") >= MIN_REVISIT), "left")
            .withColumn("first", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")))
            .drop("_digest"))


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head, whose length is that of the full payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if first is not None else http + payload
    fields = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url)))
    fields.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if first is not None:
        fields += [("WARC-Refers-To", record_id(first)), ("WARC-Profile", PROFILE)]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode() + block + b"\r\n\r\n"


def dictionary_of(payloads: list[bytes]) -> zstandard.ZstdCompressionDict:
    samples = [p[:SAMPLE_BYTES] for p in payloads if p]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:  # too few or too small: the samples themselves are the dictionary
        raw = b"".join(samples)[:DICTIONARY_BYTES] or b"<!DOCTYPE html>"
        return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_archives(records: DataFrame) -> DataFrame:
    """(path, content) archives of the rows of ``plan_records``, each some ``ARCHIVE_BYTES`` long."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ([c[k].as_py() for c in batch.columns] for batch in batches for k in range(batch.num_rows))
        first = list(itertools.islice(rows, SAMPLES))
        own = dictionary_of([row[2] for row in first])
        body = own.as_bytes()
        packer = zstandard.ZstdCompressor(level=3, dict_data=own, write_checksum=True)
        parts, size = [], 0
        for row in itertools.chain(first, rows):
            parts.append(packer.compress(record(*row)))
            size += len(parts[-1])
            if size >= ARCHIVE_BYTES:
                yield archive(body, parts)
                parts, size = [], 0
        if parts:
            yield archive(body, parts)

    def archive(body, parts):
        content = b"".join([struct.pack("<II", DICTIONARY_FRAME, len(body)), body, *parts])
        return pa.RecordBatch.from_arrays([pa.array([f"{uuid.uuid4().hex}.warc.zst"]), pa.array([content], pa.binary())],
                                          names=["path", "content"])

    return (records.select("page_id", "url", "payload", "digest", "first")
            .mapInArrow(write, "path string, content binary"))


class BadArchive(ValueError):
    pass


def frames(content: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of each frame behind the dictionary."""
    if len(content) < 8:
        raise BadArchive("no leading frame")
    magic, size = struct.unpack_from("<II", content)
    at, options = 0, {}
    if magic == DICTIONARY_FRAME:
        body, at = content[8:8 + size], 8 + size
        if len(body) < size:
            raise BadArchive("dictionary cut off")
        if body[:4] == zstandard.FRAME_HEADER:
            body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
        options["dict_data"] = zstandard.ZstdCompressionDict(body)
    unpacker, view = zstandard.ZstdDecompressor(**options), memoryview(content)
    while at < len(content):
        one, data, end = unpacker.decompressobj(), [], at
        try:
            while not one.eof and end < len(content):  # in pieces, as what is fed beyond the frame is copied
                data.append(one.decompress(view[end:end + FEED]))
                end = min(end + FEED, len(content))
        except zstandard.ZstdError as error:
            raise BadArchive(f"frame at {at}: {error}") from None
        if not one.eof:
            raise BadArchive(f"frame at {at} cut off")
        yield at, b"".join(data)
        at = end - len(one.unused_data)


def parse_record(data: bytes) -> dict:
    """Fields of one record, its headers, lengths and digest checked."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise BadArchive("no WARC header")
    fields = {k.strip().lower(): v.strip() for k, sep, v in (line.partition(":") for line in lines[1:]) if sep}
    if missing := [k for k in ("warc-type", "warc-record-id", "warc-date", "content-length") if k not in fields]:
        raise BadArchive(f"no {missing[0]}")
    if not fields["content-length"].isdecimal() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise BadArchive("length differs from content-length")
    http, found, payload = rest[:-4].partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^content-length:\s*([0-9]+)\s*$", http)
    if not found or not length:
        raise BadArchive("no HTTP header")
    algorithm, _, digest = fields.get("warc-payload-digest", "").partition(":")
    kind = fields["warc-type"]
    if kind == "response":
        if len(payload) != int(length[1]):
            raise BadArchive("payload length differs")
        if algorithm == "sha256" and hashlib.sha256(payload).hexdigest() != digest:
            raise BadArchive("payload digest differs")
    elif kind == "revisit" and "warc-refers-to" not in fields:
        raise BadArchive("revisit of nothing")
    return {"record_id": fields["warc-record-id"], "type": kind, "uri": fields.get("warc-target-uri"), "payload_digest": digest or None,
            "payload_bytes": int(length[1]), "refers_to": fields.get("warc-refers-to"), "payload": payload if kind == "response" else None}


def read_archives(archives: DataFrame) -> DataFrame:
    """A row per record of archives (path, content); see ``FIELDS``.

    A record that fails a check is a row with its ``error`` and no fields; a frame
    or dictionary that cannot be read ends its archive with such a row. A null or
    empty content is an archive without a leading frame.
    """
    names = ["record_id", "type", "uri", "payload_digest", "payload_bytes", "refers_to", "payload"]
    schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("error", pa.string()), ("record_id", pa.string()),
                        ("type", pa.string()), ("uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
                        ("refers_to", pa.string()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                out, size = [], 0
                for row in records_of(path.as_py(), content.as_py() or b""):
                    out.append(row)
                    size += len(row.get("payload") or b"")
                    if size > ARCHIVE_BYTES or len(out) >= 2000:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, size = [], 0
                yield pa.RecordBatch.from_pylist(out, schema)

    def records_of(path, content):
        at = 0
        try:
            for at, data in frames(content):
                try:
                    yield {"path": path, "offset": at, "error": None, **parse_record(data)}
                except BadArchive as error:
                    yield {"path": path, "offset": at, "error": str(error), **dict.fromkeys(names)}
        except BadArchive as error:
            yield {"path": path, "offset": at, "error": str(error), **dict.fromkeys(names)}

    return archives.select("path", "content").mapInArrow(read, FIELDS)
