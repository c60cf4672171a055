"""Benchmark decontamination as a prefix-filtered set join.

An item is searched as one or more *units*: every run of ``window`` successive words of
it, or the whole item. A unit is the set of its word shingles. Its shingles are put in
order of rarity in the benchmark, and only the first ``k - ceil(t k) + 1`` of the ``k``
are joined with the documents: a window that holds a share ``t`` of the unit must hold
one of those. A joined shingle fixes where the unit would start, so the bounds on
position and length are two comparisons; what is left is verified on the item-sized
window. The rarest shingles of the units are the small side; they are sent to the
tasks in blocks of a checked size, and each block meets every row of documents.

Defined cases: a null or wordless text has no words and no hits; an item without words
gives no units; an item shorter than the window is one unit; equal units of several items
name all of them; item_ids may be of any type that sorts; the units of a null item_id are searched like all others, only the id is never listed; repeated rows are scored alike; an
empty table gives no rows or no hits; other columns are neither read nor returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled, small_batches

#: A-Z to a-z; bytes that are no word character to a space. Bytes of 0x80 and above stay.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)
SHINGLE_WORDS = 5
#: Units of the benchmark that one block of the index may hold: about 1 kB each at most in a worker.
BLOCK_UNITS = 50_000
HIT = "n_words long, spans array<struct<start:int,stop:int>>, items array<%s>"


def words(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def units_of(benchmark: DataFrame, window: int | None) -> DataFrame:
    """Distinct units (their words, space-joined) with the ids of the items that hold them."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, text in zip(batch["item_id"], batch["text"], strict=True):
                w = words(text if isinstance(text, str) else None)
                size = len(w) if window is None else min(window, len(w))
                rows += [(item, b" ".join(w[i : i + size]).decode("utf-8", "replace")) for i in range(len(w) - size + 1 if w else 0)]
            yield pd.DataFrame(rows, columns=["item_id", "unit"])

    cutout = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")  # text: with nulls pandas would hold numbers as doubles
    return cutout.mapInPandas(cut, "item_id string, unit string").groupBy("unit").agg(F.sort_array(F.collect_set(F.col("item_id").cast(benchmark.schema["item_id"].dataType))).alias("items"))


class Index:
    """The joined side: the units of one block and the prefix shingles that lead to them."""

    def __init__(self, units: list[tuple[str, list[int]]], shingle: int, containment: float):
        split = [u.encode().split(b" ") for u, _ in units]
        self.vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for u in split for w in u))}
        self.units = [np.array([self.vocabulary[w] for w in u], np.int64) for u in split]
        self.items = [list(i) for _, i in units]
        self.containment = containment
        self.sizes = [min(shingle, len(u)) for u in self.units]
        codes = [shingles(u, s) for u, s in zip(self.units, self.sizes, strict=True)]
        seen, count = np.unique(np.concatenate([np.unique(c) for c in codes]) if codes else np.array([], np.uint64), return_counts=True)
        leads: dict[int, dict[int, list[tuple[int, int]]]] = {}
        self.sets = []
        for k, (code, size) in enumerate(zip(codes, self.sizes, strict=True)):
            own, first = np.unique(code, return_index=True)
            self.sets.append(own)
            rarity = np.lexsort((own, count[np.searchsorted(seen, own)]))
            for r in rarity[: len(own) - math.ceil(containment * len(own)) + 1]:
                leads.setdefault(size, {}).setdefault(int(own[r]), []).extend((k, int(p)) for p in (first[r : r + 1] if containment == 1 else np.flatnonzero(code == own[r])))
        self.leads = {size: (np.array(sorted(x), np.uint64), x) for size, x in leads.items()}

    def find(self, ids: np.ndarray) -> tuple[list[tuple[int, int]], list[int]]:
        """Word spans hit in a document, merged, and the items with a verified window."""
        hit, items, n = [], set(), len(ids)
        for size, (sorted_codes, leads) in self.leads.items():
            if n < size:
                continue
            codes = shingles(ids, size)
            at = np.minimum(np.searchsorted(sorted_codes, codes), len(sorted_codes) - 1)
            for i in np.flatnonzero(sorted_codes[at] == codes):
                for k, p in leads[int(codes[i])]:
                    start, unit = i - p, self.units[k]
                    stop = start + len(unit)
                    if start < 0 or stop > n:
                        continue
                    if self.containment == 1:
                        if np.array_equal(ids[start:stop], unit):
                            hit.append((int(start), int(stop)))
                            items.update(self.items[k])
                    else:
                        held = np.flatnonzero(np.isin(codes[start : stop - size + 1], self.sets[k]))
                        if len(np.unique(codes[start + held])) >= math.ceil(self.containment * len(self.sets[k])):
                            hit += [(int(start + h), int(start + h + size)) for h in held]
                            items.update(self.items[k])
        return merged(hit), sorted(items)


def shingles(ids: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit code for each run of ``size`` words."""
    n, out = len(ids) - size + 1, np.zeros(max(0, len(ids) - size + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + (ids[k : k + n] + 2).astype(np.uint64)
            out ^= out >> np.uint64(29)
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(spans)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def block_hits(index, kind: str) -> object:
    """A column function: text to the hits of one block of the index; ``kind`` is the type of item_id."""

    @F.pandas_udf(HIT % kind)
    def hits(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ix: Index = index.value
        get = ix.vocabulary.get
        for batch in texts:
            rows = []
            for text in batch:
                w = words(text)
                ids = np.fromiter((get(x, -1) for x in w), np.int64, len(w))
                found = ix.find(ids) if len(w) and (ids >= 0).any() else ([], [])
                rows.append((len(w), [{"start": a, "stop": b} for a, b in found[0]], found[1]))
            yield pd.DataFrame(rows, columns=["n_words", "spans", "items"])

    return hits


def combined(one: Column, other: Column, kind: str) -> Column:
    @F.pandas_udf(HIT % kind)
    def both(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for n, s, i, t, j in zip(a["n_words"], a["spans"], a["items"], b["spans"], b["items"], strict=True):
            spans = merged([(x["start"], x["stop"]) for x in [*s, *t]])
            rows.append((n, [{"start": x, "stop": y} for x, y in spans], sorted({*i, *j})))
        return pd.DataFrame(rows, columns=["n_words", "spans", "items"])

    return both(one, other)


def add_hits(docs: DataFrame, benchmark: DataFrame, name: str, window: int | None = 10, shingle: int = SHINGLE_WORDS, containment: float = 1.0, block_units: int = BLOCK_UNITS) -> DataFrame:
    """``docs`` with a struct column ``name``: n_words, merged word spans that are hit, and the items found.

    ``window`` None takes whole items as units; ``containment`` is the least share of a unit's distinct
    shingles. An index of over ``block_units`` units is searched block by block over all documents.
    """
    spark, kind = docs.sparkSession, benchmark.schema["item_id"].dataType.simpleString()
    small_batches(spark)
    units = settled(units_of(benchmark, window))
    blocks = max(1, math.ceil(units.count() / block_units))
    for b in range(blocks):
        rows = units.where(F.pmod(F.xxhash64("unit"), F.lit(blocks)) == b).collect() if blocks > 1 else units.collect()
        index = spark.sparkContext.broadcast(Index([(r["unit"], r["items"]) for r in sorted(rows)], shingle, containment))
        found = block_hits(index, kind)(F.col("text"))
        if b == 0:
            docs = docs.withColumn(name, found)
        else:
            docs = settled(docs.withColumn(f"{name}_", found)).withColumn(name, combined(F.col(name), F.col(f"{name}_"), kind)).drop(f"{name}_")
    return docs


def contamination(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (of words), items."""
    hit = add_hits(docs.select("doc_id", "text"), benchmark.select("item_id", "text"), "hit", **how)
    listed = F.array_join(F.sort_array(F.transform("hit.items", lambda x: x.cast("string"))), ",")
    covered = F.aggregate("hit.spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"])
    return hit.select(
        "doc_id", F.col("hit.n_words").alias("n_words"), covered.alias("n_hit"), F.size("hit.items").cast("long").alias("n_items"),
        F.sha2(listed.cast("binary"), 256).alias("items_sha256"), (covered > 0).alias("contaminated"), F.col("hit.spans").alias("spans"), F.col("hit.items").alias("items"),
    )
