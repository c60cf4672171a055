"""Substring deduplication by content-defined chunking.

A gear hash over the last 16 bytes, h = (h << 1) + GEAR[byte] in 16 bits, cuts a text after each byte whose hash is the
smallest within ``REACH`` bytes on either side. Whether a byte is a cut depends on those bytes alone, so insertions move no
later cut; gaps are over ``REACH`` bytes and about twice that on average, so that a passage of fifty words holds several.
A text without a cut for ``LONGEST`` bytes is cut there. What is deduplicated by digest is a chunk together with its
successor, which is too long to recur by chance; overlapping repeated ones are merged, and runs of at least
``LEAST_BYTES`` are the repeated passages.

The digest's group is never gathered: an aggregation gives the smallest and largest doc_id of each digest,
and a join (which Spark splits where a digest is hot) brings those that several documents hold back to their places.

Defined cases: a null or short text has no repeated passages; rows that repeat a doc_id are one document that
repeats itself, which counts with ``within`` only, and their passages are listed text by text; ties go to the smallest doc_id; rows without a doc_id are a document
for each distinct text, whose first_doc_id is null only where no holder has an id; doc_ids may be numbers or texts; an
empty table gives no rows; other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled, small_batches

REACH = 20
LONGEST = 1024
LEAST_BYTES = 100
HASH_BYTES = 16


def gear_table(seed: int = 2024) -> np.ndarray:
    """256 random 16-bit numbers: the gear of each byte."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 16, 256, dtype=np.uint16)


def smallest(h: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each run of ``n`` values, by runs of doubling length."""
    size = 1
    while 2 * size <= n:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (n - size)], h[n - size :]) if size < n else h


def cuts(data: np.ndarray, gear: np.ndarray, reach: int = REACH, longest: int = LONGEST) -> np.ndarray:
    """Ends of the chunks of ``data`` (bytes), the last one included."""
    ends = np.array([], np.int64)
    if len(data) > HASH_BYTES + 2 * reach:
        h, width = gear[data], 1
        while width < HASH_BYTES:  # the hash of 2, 4, 8 and 16 bytes from that of half as many
            h[width:] += h[:-width] << np.uint16(width)
            width *= 2
        h = h[HASH_BYTES - 1 :]
        around = smallest(h, reach)
        middle = h[reach:-reach]
        # strictly below what comes before, so that of equal ones the first is the cut
        ends = np.flatnonzero((middle < around[: len(middle)]) & (middle <= around[reach + 1 : reach + 1 + len(middle)])) + reach + HASH_BYTES
    if not len(ends) or ends[-1] != len(data):
        ends = np.append(ends, len(data))
    gaps = np.diff(ends, prepend=0)
    if gaps.max() > longest:
        ends = np.unique(np.concatenate([np.arange(e - g + longest, e, longest) for e, g in zip(ends, gaps, strict=True) if g > longest] + [ends]))
    return ends


def named(doc_id: Column, text: Column, kind: str) -> Column:
    """What tells documents apart: the id, and without one the text's hash. Whether there is an id is kept beside it (``part``), so any id may equal any hash."""
    own = F.xxhash64(text)
    return F.coalesce(doc_id, own if kind == "bigint" else F.hex(own))


def id_kind(docs: DataFrame) -> str:
    """bigint for whole numbers, string for all other types."""
    return "bigint" if docs.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long") else "string"


def chunk_pairs(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """doc (see ``named``), part (a hash of the text, odd if there is no id), start, stop (bytes) and digest of each chunk with its successor; a chunk without one stands alone."""
    gear, kind = gear_table(), id_kind(docs)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest_of, hash_of = xxhash.xxh3_128_digest, xxhash.xxh32_intdigest
        for b in batches:
            parts = []
            for doc, unnamed, text in zip(b["doc"], b["unnamed"], b["text"], strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                if not raw:
                    continue
                ends = cuts(np.frombuffer(raw, np.uint8), gear, reach)
                starts = np.concatenate([[0], ends[:-1]])
                stops = ends[1:] if len(ends) > 1 else ends
                starts = starts[: len(stops)]
                digests = b"".join([digest_of(raw[a:z]) for a, z in zip(starts.tolist(), stops.tolist(), strict=True)])
                parts.append((doc, starts, stops, np.frombuffer(digests, ">i8").reshape(-1, 2), (hash_of(raw) & ~1) + unnamed - (1 << 31)))
            if parts:
                n = [len(p[1]) for p in parts]
                high = np.concatenate([p[3] for p in parts]).astype(np.int64)
                whose = pd.Series([p[0] for p in parts]).repeat(n).reset_index(drop=True)
                yield pd.DataFrame({"doc": whose, "part": np.array([p[4] for p in parts], np.int32).repeat(n), "start": np.concatenate([p[1] for p in parts]).astype(np.int32), "stop": np.concatenate([p[2] for p in parts]).astype(np.int32), "d1": high[:, 0], "d2": high[:, 1]})

    small_batches(docs.sparkSession)
    return docs.select(named(F.col("doc_id").cast(kind), F.col("text"), kind).alias("doc"), F.col("doc_id").isNull().cast("int").alias("unnamed"), "text").mapInPandas(cut, f"doc {kind}, part int, start int, stop int, d1 long, d2 long")


def repeated(docs: DataFrame, reach: int = REACH, least_bytes: int = LEAST_BYTES, within: bool = False) -> DataFrame:
    """Repeated passages (of several documents; ``within`` adds those that one document repeats):

    doc_id, start, stop (bytes of the UTF-8 text), n_bytes, first_doc_id (the smallest that holds the passage's beginning),
    n_places (the largest number of places that any part of it has), is_first (the occurrence that deduplication keeps).
    """
    spots = settled(chunk_pairs(docs, reach))
    unnamed = lambda part="part": F.col(part).bitwiseAND(1) == 1
    ids, others = F.when(~unnamed(), F.col("doc")), F.when(unnamed(), F.col("doc"))
    known = spots.groupBy("d1", "d2").agg(F.min(ids).alias("a"), F.max(ids).alias("z"), F.min(others).alias("b"), F.max(others).alias("y"), F.count("*").alias("n_places"))
    several = F.coalesce(F.col("a") < F.col("z"), F.lit(False)) | F.coalesce(F.col("b") < F.col("y"), F.lit(False)) | (F.col("a").isNotNull() & F.col("b").isNotNull())
    known = known.where(F.col("n_places") > 1 if within else several).select("d1", "d2", F.coalesce("a", "b").alias("first"), F.col("a").isNull().alias("first_unnamed"), "n_places")
    found = spots.join(known, ["d1", "d2"]).select("doc", "part", "start", "stop", "first", "first_unnamed", "n_places")
    w = Window.partitionBy("doc", "part").orderBy("start", "stop")
    before = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = found.withColumn("new", F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0)).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("doc", "part", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min_by(F.struct("first", "first_unnamed"), "start").alias("f"), F.max("n_places").alias("n_places"))
    runs = runs.withColumn("n_bytes", F.col("stop") - F.col("start")).where(F.col("n_bytes") >= least_bytes)
    mine = (F.col("doc") == F.col("f.first")) & (unnamed() == F.col("f.first_unnamed"))
    return runs.select(F.when(~unnamed(), F.col("doc")).alias("doc_id"), "start", "stop", "n_bytes", F.when(~F.col("f.first_unnamed"), F.col("f.first")).alias("first_doc_id"), "n_places", mine.alias("is_first"))
