"""Zstandard-compressed WARC: a writer that makes archives and a reader that takes them apart.

An archive starts with a skippable frame that holds the dictionary (itself plain or Zstandard-compressed), then
one frame per record. Archives are rows (path, content) as Spark's ``binaryFile`` source gives them, so
``read_archives`` takes files as well as a written table of them. The writer closes an archive at
``ARCHIVE_BYTES``; its dictionary is trained on the first records of the archive.

Of the records with equal payloads of at least ``least_bytes`` the one with the largest page_id is written as a
response; the others become revisit records, which carry the digest and name the response but no payload. The
reader checks magic numbers, the WARC version, mandatory headers, Content-Length against the block, the record's end, and the
payload digest; a bad record is a row with ``error`` set and the next frame is read, and a frame that cannot be decoded ends its archive.
Archives of other writers are read too: all standard record types (a response's payload is its HTTP body, that of others their block),
header names in any case, and bytes that are no UTF-8 in headers (replaced); a Page-ID that is no number is null.

Defined cases: a null html is an empty payload, and empty payloads are equal; null page_ids never count as largest, and where all are
null each is a response; rows that repeat the largest page_id are all responses; a null url is written as an empty
one, control characters in it percent-encoded; an empty table gives no archives and no rows; other columns are neither read nor returned.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import meet, settled, small_batches

#: Fixed values of the format.
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_FRAME = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
VERSIONS = (b"WARC/1.0", b"WARC/1.1")
TYPES = ("warcinfo", "response", "resource", "request", "metadata", "revisit", "conversion", "continuation")
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVE_BYTES = 4_000_000
DICTIONARY_BYTES = 16_384
#: Records, and bytes of each, that train an archive's dictionary.
TRAINING_RECORDS, TRAINING_BYTES = 64, 8_192
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
STEP = 65_536
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"

RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, error string"


_CONTROL = re.compile(r"[\x00-\x1f\x7f]")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str, payload: bytes, refers_to) -> bytes:
    """One WARC record; ``refers_to`` None makes a response."""
    digest = base32_sha1(payload)
    block = b"" if refers_to is not None else HTTP % len(payload) + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Page-ID": "" if page_id is None else str(page_id),
    }
    if refers_to is not None:
        head |= {"WARC-Profile": IDENTICAL, "WARC-Refers-To": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers_to}:{digest}')}>", "Refers-To-Page-ID": str(refers_to)}
    else:
        head |= {"Content-Type": "application/http; msgtype=response"}
    lines = "".join(f"{k}: {v}\r\n" for k, v in (head | {"Content-Length": len(block)}).items())
    return VERSION + b"\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def dictionary_of(samples: list[bytes]) -> bytes:
    """A trained dictionary; where there is too little to train on, the first records are a raw one."""
    samples = [s[:TRAINING_BYTES] for s in samples[:TRAINING_RECORDS]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL, d=8, k=256, steps=1).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICTIONARY_BYTES]


def archive(records: list[bytes]) -> bytes:
    raw = dictionary_of(records)
    packed = zstandard.ZstdCompressor(level=LEVEL).compress(raw)
    with_dictionary = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw)) if raw else zstandard.ZstdCompressor(level=LEVEL)
    return b"".join([struct.pack("<II", DICTIONARY_FRAME, len(packed)), packed, *map(with_dictionary.compress, records)])


def write_archives(records: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """path, content: archives made from page_id, url, html, refers_to."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for b in batches:
            for page_id, url, html, refers_to in zip(b["page_id"], b["url"], b["html"], b["refers_to"], strict=True):
                whole = lambda x: None if pd.isna(x) else int(x)
                held.append(record(whole(page_id), url or "", (html or "").encode("utf-8", "surrogatepass"), whole(refers_to)))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield packed(held)
                    held, size = [], 0
        if held:
            yield packed(held)

    def packed(held: list[bytes]) -> pd.DataFrame:
        content = archive(held)
        return pd.DataFrame({"path": [f"{hashlib.sha1(content).hexdigest()}.warc.zst"], "content": [content]})

    return records.select("page_id", "url", "html", "refers_to").mapInPandas(write, "path string, content binary")


def frames(content: bytes) -> Iterator[bytes]:
    """The decoded frames of one archive, the dictionary first (empty where there is none)."""
    view, at, dictionary = memoryview(content), 0, b""
    if len(content) >= 8 and struct.unpack_from("<I", content)[0] == DICTIONARY_FRAME:
        size = struct.unpack_from("<I", content, 4)[0]
        if 8 + size > len(content):
            raise ValueError("dictionary frame is cut off")
        dictionary, at = bytes(view[8 : 8 + size]), 8 + size
        if dictionary[:4] == ZSTD_FRAME:
            dictionary = zstandard.ZstdDecompressor().decompressobj().decompress(dictionary)
    yield dictionary
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()
    while at < len(content):
        one, out = decoder.decompressobj(), []
        while not one.eof and at < len(content):
            part = view[at : at + STEP]
            out.append(one.decompress(part))
            at += len(part) - len(one.unused_data)
        if not one.eof:
            raise ValueError("frame is cut off")
        yield b"".join(out)


def parsed(data: bytes) -> tuple:
    """The fields of RECORD from one decoded frame."""
    end = data.find(b"\r\n\r\n")
    first, _, lines = data[: max(end, 0)].partition(b"\r\n")
    if first not in VERSIONS:
        return (None, None, None, None, None, None, None, "no WARC header")
    head: dict[str, str] = {}
    for line in re.sub(r"\r\n[ \t]+", " ", lines.decode("utf-8", "replace")).split("\r\n"):  # a line that begins with a blank goes on
        name, colon, value = line.partition(":")
        if not colon:
            return (None, None, None, None, None, None, None, "bad header line")
        head.setdefault(name.strip().lower(), value.strip())
    number = lambda k: int(x) if re.fullmatch("-?[0-9]{1,18}", x := head.get(k, "")) else None
    kind, digest, error, payload = head.get("warc-type"), head.get("warc-payload-digest", "").removeprefix("sha1:"), None, None
    block, size = data[end + 4 : -4], head.get("content-length", "")
    if missing := [k for k in MANDATORY if k.lower() not in head]:
        error = f"missing {missing[0]}"
    elif not re.fullmatch("[0-9]{1,18}", size) or int(size) != len(block) or data[-4:] != b"\r\n\r\n":
        error = "length does not match"
    elif kind == "response" and block.startswith(b"HTTP/"):
        http = block.find(b"\r\n\r\n")
        payload = block[http + 4 :] if http >= 0 else b""
        if http < 0:
            error = "no HTTP header"
    elif kind == "response" and "page-id" in head:  # this writer's own always have one
        payload, error = b"", "no HTTP header"
    elif kind not in TYPES:
        error = "unknown type"
    elif kind != "revisit":
        payload = block
    if error is None and payload is not None and digest and base32_sha1(payload) != digest:
        error = "digest does not match"
    return (number("page-id"), head.get("warc-target-uri"), kind, number("refers-to-page-id"), None if payload is None else len(payload), digest, payload, error)


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """A row of RECORD for each record; without ``payloads`` the payload column is null."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        for b in batches:
            for content in b["content"]:
                rows = []
                try:
                    found = frames(content)
                    next(found)
                    for data in found:
                        row = parsed(data)
                        rows.append(row if payloads else (*row[:6], None, row[7]))
                        if payloads and len(rows) >= 256:
                            yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})
                            rows = []
                except (ValueError, zstandard.ZstdError) as why:
                    rows.append((None,) * 7 + (f"unreadable: {why}",))
                yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})

    return archives.select("content").mapInPandas(read, RECORD)


def with_references(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html and refers_to: the response that a page's record revisits, or null."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("bytes"))
    shared = rows.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1").select("digest", "largest")
    return meet(rows, shared, ["digest"], "left").select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest")).alias("refers_to"))


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Per page, read back from the archives it was written to: page_id, payload_bytes, payload_digest, record_type, refers_to, error.

    A revisit takes its payload's length from the response it names, whose digest must be its own.
    """
    spark = pages.sparkSession
    small_batches(spark)
    archives = settled(write_archives(with_references(pages, least_bytes)))
    found = settled(read_archives(archives, payloads=False).drop("payload", "url"))
    named = found.where("record_type = 'revisit'").select(F.col("refers_to").alias("page_id")).distinct()
    responses = found.where("record_type = 'response'").join(named, "page_id", "left_semi").groupBy("page_id").agg(F.min("payload_bytes").alias("whole_bytes"), F.min("payload_digest").alias("whole_digest"))
    rows = meet(found, responses.withColumnRenamed("page_id", "refers_to"), ["refers_to"], "left")
    wrong = F.when((F.col("record_type") == "revisit") & ~F.col("payload_digest").eqNullSafe(F.col("whole_digest")), F.lit("response does not match"))
    return rows.select("page_id", F.coalesce("payload_bytes", "whole_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", F.coalesce("error", wrong).alias("error"))
