import base64
import hashlib
import io

import pytest
import zstandard
from pyspark.sql import functions as F

from eventloom.llm import warc

PAGES = "page_id long, url string, html string"


def expected(rows):
    first, out = {}, []
    for i, _, h in rows:
        b = (h or "").encode()
        first[b] = min(first.get(b, i), i, key=lambda x: (x is None, x or 0))
    for i, _, h in rows:
        b = (h or "").encode()
        kind = "response" if first[b] == i else "revisit"
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), kind, None if kind == "response" else first[b]))
    return sorted(out, key=repr)


def found(df):
    return sorted([tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()], key=repr)


def test_round_trip(spark):
    rows = [(i, f"http://x/{i}", f"<html>{i % 7} é {'body ' * (i % 5)}</html>") for i in range(60)] + [(100, None, None), (101, "a b\r\nc", ""), (102, "u", "x" * 300_000), (103, "u", "x" * 300_000), (None, "u", "<html>only</html>")]
    df = spark.createDataFrame(rows, PAGES).withColumn("key", F.lit(1)).withColumn("first", F.lit("f"))
    back = warc.archived_pages(df)
    assert found(back) == expected(rows)
    payloads = {r.page_id: (r.url, r.payload) for r in back.where("record_type = 'response'").collect()}
    assert payloads[0] == ("http://x/0", b"<html>0 \xc3\xa9 </html>")
    assert payloads[100][0] is None and bytes(payloads[102][1]) == b"x" * 300_000


def test_empty_table_and_short_payloads(spark):
    assert warc.archived_pages(spark.createDataFrame([], PAGES)).count() == 0
    same = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], PAGES)
    kinds = {r.page_id: r.record_type for r in warc.archived_pages(same, min_revisit_bytes=3).collect()}
    assert kinds == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def build(n=300, roll=64 << 20):
    records = [warc.record(str(i), "http://x", f"<p>{i} and some words that repeat</p>".encode() * 5, None, "2024-01-01T00:00:00Z") for i in range(n)]
    return records, [b"".join(chunks) for chunks in warc.archive(iter(records), roll)]


def test_archive_starts_with_its_dictionary():
    records, [data] = build()
    assert int.from_bytes(data[:4], "little") == warc.SKIPPABLE_MAGIC
    assert [r for r, _ in warc.frames(io.BytesIO(data))] == records
    with pytest.raises(zstandard.ZstdError):
        zstandard.ZstdDecompressor().decompress(data[8 + int.from_bytes(data[4:8], "little") :])


def test_archives_roll():
    records, parts = build(600, roll=3000)
    assert len(parts) > 1
    assert [r for p in parts for r, _ in warc.frames(io.BytesIO(p))] == records


def test_a_compressed_dictionary_is_read():
    records, [data] = build()
    size = int.from_bytes(data[4:8], "little")
    packed = warc.skippable_frame(zstandard.compress(data[8 : 8 + size])) + data[8 + size :]
    assert [r for r, _ in warc.frames(io.BytesIO(packed))] == records


@pytest.mark.parametrize("damage", [lambda r: r.replace(b"WARC/1.1", b"WARC/9.1"), lambda r: r.replace(b"WARC-Date", b"Date"), lambda r: r[:-1], lambda r: r.replace(b"<p>", b"<q>"), lambda r: r.replace(b"Content-Length: ", b"Content-Length: 1"), lambda r: r.replace(b"response", b"metadata", 1)])
def test_damaged_records_are_refused(damage):
    records, _ = build(3)
    with pytest.raises(ValueError):
        warc.read_record(damage(records[0]))


def test_truncated_archives_are_refused():
    _, [data] = build()
    for cut in (len(data) - 5, 20):
        with pytest.raises(ValueError):
            list(warc.frames(io.BytesIO(data[:cut])))
