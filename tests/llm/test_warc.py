import hashlib
import io
import struct

import pytest
import zstandard

from rowloom.llm import warc

BIG, SMALL = "payload " * 200, "small"
ROWS = [(1, "http://a/1", BIG), (2, "http://a/2", BIG), (3, "http://a/3", SMALL), (4, "http://a/4", SMALL), (5, None, None), (6, "u\r\nX: y", "é" * 600), (7, "http://a/7", BIG + "x" * 300_000), (2, "http://a/2", BIG), (None, "http://a/n", "nothing")]


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    for roll in (warc.ROLL, 1000):
        files = warc.write(pages, roll=roll)
        got = sorted(((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(files).collect()), key=repr)
        size = lambda h: len((h or "").encode())
        sha = lambda h: hashlib.sha1((h or "").encode()).hexdigest()
        want = [(i or -1, size(h), sha(h), "response", None) for i, _, h in ROWS]
        want[0] = (*want[0][:3], "revisit", 2)
        want[7] = (*want[7][:3], "revisit", 2)
        assert got == sorted(want, key=repr)
    assert warc.read(warc.write(pages.limit(0))).collect() == []


def archive(*records, words=b"WARC/1.1 dictionary"):
    pack = zstandard.ZstdCompressor(dict_data=warc.load(words))
    return struct.pack("<II", warc.DICT_MAGIC, len(words)) + words + b"".join(pack.compress(r) for r in records)


def good(n=3):
    return warc.record_bytes(1, "http://x/", "response", None, b"abc"[:n], hashlib.sha1(b"abc"[:n]).hexdigest(), n)


def test_reader_validates():
    read = lambda raw: [warc.describe(*r) for r in warc.read_records(io.BytesIO(raw))]
    assert [r[0] for r in read(archive(good(), good(0)))] == [1, 1]
    packed = zstandard.ZstdCompressor().compress(b"WARC/1.1 dictionary")
    raw = archive(good())
    assert read(struct.pack("<II", warc.DICT_MAGIC, len(packed)) + packed + raw[8 + len(b"WARC/1.1 dictionary") :])[0][1] == 3
    bad = [raw[8:], raw[:20], raw[:-3], raw + b"junk", archive(good().replace(b"Content-Length: 3", b"Content-Length: 4")), archive(good().replace(b"WARC/1.1", b"HTTP/1.1")), archive(good().replace(b"WARC-Date", b"X-Date")), archive(good().replace(b"abc", b"abd")), archive(good()[:-2]), archive(good().replace(b"Content-Length: 3", b"Content-Length: x"))]
    for b in bad:
        with pytest.raises(warc.ArchiveError):
            read(b)
