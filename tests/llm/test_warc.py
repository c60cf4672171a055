import base64
import hashlib
import struct

import pytest
import zstandard

from lacuna.llm import warc

ROWS = [(1, "http://a", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (3, None, None), (4, "u", ""), (5, "é", "ü" * 3000), (6, "big", "word " * 400_000), (7, "c", "<p>x</p>"), (7, "c", "<p>x</p>"), (None, "n", "<p>x</p>"), (None, "m", "only null"), (8, "http://a\r\nWARC-Type: revisit\r\n\r\nx", "<p>line break</p>"), (9, "a\x00\tb\n", "<p>z</p>")]


def brute(rows):
    top = {}
    for i, _, h in rows:
        if i is not None:
            top[h or ""] = max(i, top.get(h or "", i))
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        t = top.get(h or "")
        response = t is None or i == t
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if response else "revisit", None if response else t, None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    pages = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, refers_to string")
    assert sorted(map(tuple, warc.round_trip(pages).collect()), key=repr) == brute(ROWS)


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_files_are_read_as_spark_reads_binary_files(spark, tmp_path):
    records = [warc.record(i, f"http://{i}", b"payload %d" % i, None) for i in range(40)]
    (tmp_path / "a.warc.zst").write_bytes(warc.archive(records))
    (tmp_path / "plain.warc.zst").write_bytes(b"".join(map(zstandard.ZstdCompressor().compress, records[:3])))
    found = warc.read_archives(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert len(found) == 43 and all(r["error"] is None for r in found)
    assert {bytes(r["payload"]) for r in found} == {b"payload %d" % i for i in range(40)}


def test_dictionary_comes_first_and_may_be_compressed():
    raw = b"some dictionary bytes " * 40
    frame = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw)).compress(b"x" * 50)
    for held in (raw, zstandard.ZstdCompressor().compress(raw)):
        assert list(warc.frames(struct.pack("<II", 0x184D2A5D, len(held)) + held + frame)) == [raw, b"x" * 50]


@pytest.mark.parametrize("change,error", [
    (lambda d: d.replace(b"Content-Length", b"Content-Lengtx", 1), "missing Content-Length"), (lambda d: d[:-4], "length does not match"), (lambda d: d.replace(b"payload", b"pAyload"), "digest does not match"),
    (lambda d: d.replace(b"WARC/1.1", b"WARC/9.9"), "no WARC header"), (lambda d: d.replace(b": response", b": strange", 1), "unknown type"),
])
def test_faults_are_named(change, error):
    assert warc.parsed(change(warc.record(1, "http://a", b"payload", None)))[7] == error


def test_broken_archives_give_an_error_row(spark):
    good = warc.archive([warc.record(1, "u", b"abc", None)])
    df = spark.createDataFrame([("a", bytearray(good[:-3])), ("b", bytearray(b"\x00\x01")), ("c", bytearray(good))], "path string, content binary")
    found = warc.read_archives(df).collect()
    assert sum(r["error"] is None for r in found) == 1 and sum((r["error"] or "").startswith("unreadable") for r in found) == 2


def foreign(kind, block, version=b"WARC/1.0", **more):
    head = {"warc-type": kind, "WARC-Record-Id": "<urn:uuid:1>", "WARC-date": "2020-01-01T00:00:00Z", "CONTENT-LENGTH": str(len(block)), **more}
    return version + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode("latin-1") for k, v in head.items()) + b"\r\n" + block + b"\r\n\r\n"


def test_archives_of_other_writers_are_read_to_the_end(spark):
    records = [
        foreign("warcinfo", b"software: x\r\n"), foreign("request", b"GET / HTTP/1.1\r\n\r\n"), foreign("response", b"HTTP/1.1 200 OK\r\n\r\nbody", **{"WARC-Target-URI": "http://\xff"}),
        foreign("response", b"dns answer"), foreign("metadata", b"m", version=b"WARC/1.1"), foreign("resource", b"r", **{"Page-ID": "none"}), foreign("response", b"HTTP/1.1 200 OK\r\n\r\nx", **{"WARC-Payload-Digest": "sha1:WRONG"}),
        foreign("response", b"HTTP/1.1 200 OK\r\n\r\ny", **{"WARC-Filename": "one\r\n two"}), foreign("revisit", b"HTTP/1.1 304\r\n\r\n"), foreign("odd", b""), b"no record", warc.record(3, "u", b"last", None),
    ]
    found = warc.read_archives(spark.createDataFrame([("a", bytearray(warc.archive(records)))], "path string, content binary")).collect()
    kinds = [(r["record_type"], r["payload"] and bytes(r["payload"]), r["error"]) for r in found]
    assert kinds == [
        ("warcinfo", b"software: x\r\n", None), ("request", b"GET / HTTP/1.1\r\n\r\n", None), ("response", b"body", None), ("response", b"dns answer", None), ("metadata", b"m", None), ("resource", b"r", None),
        ("response", b"x", "digest does not match"), ("response", b"y", None), ("revisit", None, None), ("odd", None, "unknown type"), (None, None, "no WARC header"), ("response", b"last", None),
    ]
    assert found[5]["page_id"] is None and found[-1]["page_id"] == 3
