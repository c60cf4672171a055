"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint of 64 bits is embedded as the bit counts of its ``SEGMENTS`` segments. Two fingerprints whose
bits differ in at most k places are at most k apart there in Manhattan distance, so a range join under that
distance gives every link. The grid of the join: the embedding is split into two halves; where the whole
distance is at most 3, that of one half is at most 1. Each half is a cell of unit side, written as one number, and a
fingerprint looks into its own cell and, once for each segment that can hold one more bit, the cell one step up; an unordered pair
at most 1 apart meets exactly there. Pairs that meet are verified by the exact bit count of their difference.

Only distinct fingerprints are joined, so a group of copies is one point. Components come from
alternating large-star and small-star steps on the links, each a grouping and a join.

Defined cases: a null or wordless text has fingerprint zero and is linked like any other; a text of fewer words than a
shingle is one shingle; rows that repeat a doc_id get the same component where their texts do; a null doc_id takes part but never names
a component unless no member has an id (then the component is null); an empty table gives no rows; other columns are neither read nor returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import meet, settled, small_batches

SHINGLE_WORDS = 3
SEED = 42
BITS = 64
MOST_BITS = 3
#: Segments of two bits: counts 0 to 2, 16 segments in each half.
SEGMENTS = 32
ROUNDS = 40
#: Fingerprints that one task turns into cells: each has up to 34.
TASK_POINTS = 10_000

#: A-Z to a-z; all other bytes stay.
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def fingerprint(text: str | None) -> int:
    """64 bits as a signed number; a bit is set if it is in over half the shingle hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    n = len(words)
    if not n:
        return 0
    if n <= SHINGLE_WORDS:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    else:
        hash_of, last = xxhash.xxh64_intdigest, n - SHINGLE_WORDS + 1
        hashes = np.fromiter((hash_of(x, SEED) for x in map(b" ".join, zip(*[words[k : k + last] for k in range(SHINGLE_WORDS)], strict=True))), np.uint64, last)
    set_bits = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):
        set_bits += np.unpackbits(hashes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    majority = (2 * set_bits > len(hashes)).astype(np.uint8)
    return int(np.packbits(majority, bitorder="little").view("<i8")[0])


def fingerprints_of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([fingerprint(t) for t in batch], dtype="int64")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (a signed long) per row."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.pandas_udf(fingerprints_of, "long")("text").alias("fp"))


def cells(points: DataFrame) -> DataFrame:
    """fp, half, cell and up: the cells that a point looks into; ``up`` is false for its own cell."""
    width = BITS // SEGMENTS
    each = SEGMENTS // 2
    rows = []
    for half in range(2):
        counts = [F.bit_count(F.shiftrightunsigned(F.col("fp"), (half * each + s) * width).bitwiseAND(F.lit((1 << width) - 1))).cast("long") for s in range(each)]
        base = sum((F.shiftleft(c, 2 * s) for s, c in enumerate(counts[1:], 1)), counts[0])
        steps = [F.when(c < width, base + F.lit(1 << (2 * s)).cast("long")) for s, c in enumerate(counts)]
        rows.append(F.struct(F.lit(half).alias("half"), base.alias("base"), F.array_compact(F.array(*steps)).alias("steps")))
    own = points.select("fp", F.explode(F.array(*rows)).alias("h")).select("fp", "h.half", "h.base", "h.steps")
    look = F.concat(F.array(F.struct(F.col("base").alias("cell"), F.lit(False).alias("up"))), F.transform("steps", lambda c: F.struct(c.alias("cell"), F.lit(True).alias("up"))))
    return own.select("fp", "half", "base", F.explode(look).alias("c")).select("fp", "half", "base", "c.cell", "c.up")


def links(points: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """a < b: distinct fingerprints that differ in at most ``most`` (up to 3) bits."""
    if most > MOST_BITS:
        raise ValueError("a half at most 1 apart is certain only for 3 bits or fewer")
    own = cells(points.repartition(max(1, math.ceil(points.count() / TASK_POINTS)), "fp"))
    left = own.select(F.col("fp").alias("a"), "half", "cell", "up")
    right = own.where("not up").select(F.col("fp").alias("b"), F.col("half").alias("half_"), F.col("cell").alias("cell_"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most
    # in one cell a pair would be found twice: only the smaller one looks there
    pairs = left.join(right, (F.col("half") == F.col("half_")) & (F.col("cell") == F.col("cell_")) & (F.col("a") != F.col("b")) & near & (F.col("up") | (F.col("a") < F.col("b"))))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """node and root (the least node reachable) for every node of ``edges`` (a, b), by alternating stars."""
    now = settled(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = meet(both, least, ["u"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = meet(large, least, ["u"])
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = settled(small.where("u <> v").distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def classes(docs: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """Per row: doc_id, fp, component_id (the smallest doc_id of its component) and links (distinct fingerprints linked to its own)."""
    prints = settled(fingerprints(docs))
    return meet(prints, settled(placed(prints, most).drop("root")), ["fp"])


def placed(prints: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """Per distinct fp of ``prints``: root (the least fingerprint of its component), component_id and links."""
    points = settled(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = settled(links(points.select("fp"), most))
    roots = components(edges)
    degree = edges.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("links"))
    spots = points.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = spots.groupBy("root").agg(F.min("least").alias("component_id"))
    return meet(meet(spots, named, ["root"]), degree, ["fp"], "left").select("fp", "root", "component_id", F.coalesce("links", F.lit(0)).alias("links"))


def near_duplicates(docs: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id, links."""
    return classes(docs.select("doc_id", "text"), most).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "links")
