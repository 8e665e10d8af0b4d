"""WARC archives compressed with Zstandard: a dictionary in the leading skippable frame, one frame per record.

Writing: each task writes its rows as archives of about `roll_bytes`. An archive starts with a
skippable frame (magic 0x184D2A5D) that holds a dictionary trained on the archive's first
records; each record is a frame of its own, compressed with it. Records with a payload equal to
that of a row with a smaller page_id are revisits: headers without the payload.

Reading: the dictionary is loaded from the skippable frame, frames are decoded one at a time from
a stream, and each record is checked: version line, mandatory headers, Content-Length against
the block, the closing blank lines, and the SHA-1 of a response's payload. A record that fails
raises ValueError with the archive and its place.

Recovery: archives go to the folder all executors share, under names of their own, and only
those in the written index are read: a retried task leaves an unread file at worst.

Edge cases: a null html is an empty payload, and empty payloads equal each other; a null url is
written as urn:eventloom:none; rows that repeat both the smallest page_id and the payload are all
responses, for nothing tells them apart; a null page_id is never the smallest unless all are; a very
long html is one record, held whole by the task that writes or reads it; an empty table writes nothing. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import materialised, scratch_path, text_or_empty

SKIPPABLE_MAGIC = 0x184D2A5D
VERSION = b"WARC/1.1"
RECORD_ID = "urn:eventloom:page:"
NO_URI = "urn:eventloom:none"
DICTIONARY_BYTES = 64 << 10
#: Records and bytes on which an archive's dictionary is trained.
SAMPLE_RECORDS, SAMPLE_BYTES = 200, 2 << 20
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: str, url: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One WARC record: a response, or a revisit without payload if refers_to names another page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        VERSION.decode(),
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{RECORD_ID}{page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_clean(url) if url else NO_URI}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <{RECORD_ID}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def skippable_frame(data: bytes) -> bytes:
    return SKIPPABLE_MAGIC.to_bytes(4, "little") + len(data).to_bytes(4, "little") + data


def train_dictionary(samples: list[bytes]) -> bytes | None:
    """A dictionary for records like the samples; None where they are too few or too short to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return None


def archive(records: Iterator[bytes], roll_bytes: int = 64 << 20, level: int = 3) -> Iterator[Iterator[bytes]]:
    """Archives as streams of chunks to write: the dictionary's frame, then a frame per record."""
    waiting: list[bytes] = []
    source = iter(records)
    ended = False

    def one() -> Iterator[bytes]:
        nonlocal ended
        size = 0
        data = train_dictionary(waiting)
        compressor = zstandard.ZstdCompressor(level=level, write_content_size=True, write_checksum=True, dict_data=zstandard.ZstdCompressionDict(data) if data else None)
        if data:
            yield skippable_frame(data)
        while waiting:
            frame = compressor.compress(waiting.pop(0))
            size += len(frame)
            yield frame
        while size < roll_bytes:
            item = next(source, None)
            if item is None:
                ended = True
                return
            frame = compressor.compress(item)
            size += len(frame)
            yield frame

    while not ended:
        held = 0
        while len(waiting) < SAMPLE_RECORDS and held < SAMPLE_BYTES:
            item = next(source, None)
            if item is None:
                ended = True
                break
            waiting.append(item)
            held += len(item)
        if waiting:
            yield one()


def frames(stream) -> Iterator[tuple[bytes, int]]:
    """(record bytes, place) of each frame of an archive, with the dictionary of its leading skippable frame."""
    chunk, place = stream.read(1 << 20), 0
    dictionary = None
    if len(chunk) >= 8 and int.from_bytes(chunk[:4], "little") == SKIPPABLE_MAGIC:
        size = int.from_bytes(chunk[4:8], "little")
        while len(chunk) < 8 + size:
            more = stream.read(1 << 20)
            if not more:
                raise ValueError("the archive ends within its dictionary")
            chunk += more
        data = bytes(chunk[8 : 8 + size])
        if data[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary may itself be a frame
            data = zstandard.ZstdDecompressor().decompress(data, max_output_size=64 << 20)
        dictionary = zstandard.ZstdCompressionDict(data)
        chunk, place = chunk[8 + size :], 8 + size
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
    while True:
        if not chunk:
            chunk = stream.read(1 << 20)
            if not chunk:
                return
        begin, parts, one = place, [], decompressor.decompressobj()
        while True:
            try:
                parts.append(one.decompress(chunk))
            except zstandard.ZstdError as e:
                raise ValueError(f"no frame at byte {begin}: {e}") from e
            place += len(chunk)
            if one.eof:
                chunk = one.unused_data
                place -= len(chunk)
                break
            chunk = stream.read(1 << 20)
            if not chunk:
                raise ValueError(f"the archive ends within the frame at byte {begin}")
        yield b"".join(parts), begin


def parse(data: bytes) -> dict:
    """The headers (by lower-case name) and the block of one record, checked."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        raise ValueError("no WARC version line or no end of headers")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ValueError(f"not a header: {line[:80]!r}")
        headers[name.strip().lower().decode()] = value.strip().decode()
    if missing := [h for h in MANDATORY if h not in headers]:
        raise ValueError(f"headers missing: {missing}")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError(f"the block does not have its Content-Length, {headers['content-length']}")
    return {"headers": headers, "block": rest[:-4]}


def _page(value: str) -> str:
    return value.removeprefix(f"<{RECORD_ID}").removesuffix(">")


def read_record(data: bytes) -> dict:
    """page_id, url, record_type, refers_to, payload (None of a revisit), payload_bytes, payload_digest."""
    found = parse(data)
    headers = found["headers"]
    http, ended, payload = found["block"].partition(b"\r\n\r\n")
    length = re.search(rb"\r\ncontent-length: *(\d+)", http, re.I)
    if not ended or not length:
        raise ValueError("no HTTP headers with a length in the block")
    kind, digest = headers["warc-type"], headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response":
        if int(length[1]) != len(payload):
            raise ValueError("the payload does not have its HTTP length")
        if sha1_base32(payload) != digest:
            raise ValueError("the payload does not have its digest")
    elif kind != "revisit" or payload or "warc-refers-to" not in headers:
        raise ValueError(f"not a response or revisit: {kind}")
    return {
        "page_id": _page(headers["warc-record-id"]),
        "url": None if headers.get("warc-target-uri") == NO_URI else headers.get("warc-target-uri"),
        "record_type": kind,
        "refers_to": _page(headers["warc-refers-to"]) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
        "payload_bytes": int(length[1]),
        "payload_digest": digest,
    }


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, roll_bytes: int = 64 << 20, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes page_id, url, html to archives below `folder`; returns their index: path, records, written once."""
    body = F.encode(text_or_empty("html"), "utf-8")
    keys = pages.select("page_id", F.sha2(body, 256).alias("key"), F.octet_length(body).alias("bytes")).where(F.col("bytes") >= min_revisit_bytes)
    firsts = keys.groupBy("key").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    revisits = keys.join(firsts, "key").where(F.col("page_id").isNull() | (F.col("page_id") > F.col("first"))).select("page_id", "key", F.coalesce(F.col("first").cast("string"), F.lit("null")).alias("first")).where("page_id is not null or first <> 'null'").distinct()
    keyed = pages.select("page_id", "url", body.alias("body"), F.sha2(body, 256).alias("key"))
    same = keyed["page_id"].eqNullSafe(revisits["page_id"]) & (keyed["key"] == revisits["key"])
    rows = keyed.join(revisits, same, "left").select(F.coalesce(keyed["page_id"].cast("string"), F.lit("null")).alias("page_id"), "url", "body", "first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}" if folder.startswith("/") else folder)
        count = 0

        def records() -> Iterator[bytes]:
            nonlocal count
            for batch in batches:
                for page_id, url, body, first in zip(*(batch.column(k) for k in range(4)), strict=True):
                    count += 1
                    yield record(page_id.as_py(), url.as_py(), body.as_py(), first.as_py(), date)

        for chunks in archive(records(), roll_bytes):
            name, before = f"{uuid.uuid4().hex}.warc.zst", count
            store.create_dir(top, recursive=True)
            with store.open_output_stream(f"{top}/{name}", compression=None) as out:
                for chunk in chunks:
                    out.write(chunk)
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [count - before]})

    return materialised(rows.mapInArrow(write, "path string, records long"))


def read_archives(index: DataFrame) -> DataFrame:
    """The records of the archives in column `path`, checked; see :func:`read_record` for the columns."""
    schema = pa.schema([("page_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, where = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
                with store.open_input_stream(where, compression=None) as stream:
                    rows, held = [], 0
                    for data, place in frames(stream):
                        try:
                            rows.append(read_record(data))
                        except ValueError as e:
                            raise ValueError(f"{path}, record at byte {place}: {e}") from e
                        held += len(data)
                        if held > 8 << 20 or len(rows) >= 2000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    return index.select("path").mapInArrow(read, "page_id string, url string, record_type string, refers_to string, payload binary, payload_bytes long, payload_digest string")


def archived_pages(pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = 0) -> DataFrame:
    """Pages written as archives and read back: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    kind = pages.schema["page_id"].dataType
    back = read_archives(write_archives(pages, folder, min_revisit_bytes))
    number = lambda c: F.when(F.col(c) != "null", F.col(c)).cast(kind).alias(c)
    return back.select(number("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to"), "url", "payload")
