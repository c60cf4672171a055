"""Shards of even bytes by histogram sort.

Rows have a total order: 60 bits of the MD5 of the text, then the id, then a number that is unique in the written table. Equal texts are
therefore neighbours. The splitters of the shards are found by counting, not by sampling: every round sends a sorted list of candidate keys (probes) to
the tasks, which add up the exact bytes and rows between neighbouring probes; a splitter whose interval still holds more than the tolerance gets
new probes between the least and the greatest key found there, until its interval is one row. Only then are rows exchanged, once.

A row belongs to the shard that holds the middle of its bytes: floor((2 * before + size) * shards / (2 * total)), with ``before`` the bytes of all
smaller rows. A shard is thus at most half a row at each end off its even share, and a group of equal texts, however large, is cut where a
border runs through it. Slots number a shard's rows in the same order. For them the order is cut finer, at more splitters that even out
bytes and rows together, so that no task sorts a whole shard.

Probes go to every task: at most ``PROBES`` for each splitter, of which there are at most ``shards`` + ``FINEST``.

Defined cases: a null text counts as empty (size 16); a null id comes first among equal texts, ids that are no whole numbers are
ordered by their hash; rows that repeat wholly are told apart by their place in the written table; with fewer rows than shards some shards stay
empty; an empty table gives no rows; other columns are carried along in ``row``, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

from .common import settled

SHARDS = 40
OVERHEAD = 16
PROBES, FINEST = 16, 20_000
PIECE_BYTES = 64 << 20
LEAST = -(1 << 63)
LEVELS = ("k1", "k2", "k3")

Key = tuple[int, ...]


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def keyed(docs: DataFrame) -> DataFrame:
    """row (all columns), size, and the key k1, k2, k3, as a table: k3 is settled only once it is written."""
    whole = isinstance(docs.schema["doc_id"].dataType, IntegralType)
    number = F.coalesce(F.col("doc_id").cast("long") if whole else F.xxhash64(F.col("doc_id").cast("string")), F.lit(LEAST))
    digest = F.conv(F.substring(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")
    made = docs.select(F.struct(*docs.columns).alias("row"), (text_bytes(F.col("text")) + OVERHEAD).alias("size"), digest.alias("k1"), number.alias("k2"))
    return settled(made.withColumn("k3", F.monotonically_increasing_id()))


def place(keys: list[np.ndarray], bounds: np.ndarray) -> np.ndarray:
    """How many of the sorted bounds (a row each, a column for each level) are not above each key."""
    low, high = np.searchsorted(bounds[:, 0], keys[0], "left"), np.searchsorted(bounds[:, 0], keys[0], "right")
    if len(keys) == 1:
        return high
    out, tied = low.copy(), np.flatnonzero(low < high)
    for at in np.unique(low[tied]):
        rows = tied[low[tied] == at]
        out[rows] = at + place([k[rows] for k in keys[1:]], bounds[at : high[rows[0]], 1:])
    return out


def after(key: Key) -> Key:
    return (*key[:-1], key[-1] + 1)


@dataclass
class Splitter:
    """The border at ``part`` of ``parts`` of a measure: ``weights`` of a byte and of a row, ``total`` of all rows."""

    weights: tuple[int, int]
    part: int
    parts: int
    total: int

    def past(self, held: tuple[int, int]) -> int:
        """How far the rows with these bytes and this count reach beyond the border, in parts of the measure."""
        return sum(w * x for w, x in zip(self.weights, held, strict=True)) * self.parts - self.total * self.part


@dataclass
class Cell:
    """Neighbouring rows: bytes and count of the rows before them and up to their end, and their least and greatest key."""

    before: tuple[int, int]
    end: tuple[int, int]
    least: Key
    most: Key

    def probes(self, n: int) -> list[Key]:
        """Up to n keys above the least and not above the greatest, evenly spread over the first level in which they differ."""
        level = next(i for i in range(len(LEVELS)) if self.least[i] != self.most[i])
        low, wide = self.least[level], self.most[level] - self.least[level]
        steps = sorted({-(-wide * j // (n + 1)) for j in range(1, n + 1)})
        return [(*self.least[:level], low + s, *[LEAST] * (len(LEVELS) - level - 1)) for s in steps]

    def border(self, s: Splitter, tolerance: int) -> Key | None:
        """The key at which rows lie beyond the splitter, if that is settled here."""
        slack = tolerance * s.weights[0] * s.parts
        if -s.past(self.before) <= slack:
            return self.least
        if s.past(self.end) <= slack:
            return after(self.most)
        if self.least == self.most:  # one row: its middle decides
            return self.least if s.past(self.before) + s.past(self.end) >= 0 else after(self.most)
        return None


def splitters(rows: DataFrame, wanted: list[Splitter], whole: Cell, tolerance: int = 0, probes: int = PROBES) -> list[Key]:
    """For each wanted splitter the key from which on rows lie beyond it; ``tolerance``: bytes that a border may be off."""
    found: dict[int, Key] = {}
    opened: list[tuple[Cell, list[int]]] = []

    def settle(cells: list[Cell], sought: list[int]) -> None:
        for cell in cells:
            mine = [i for i in sought if wanted[i].past(cell.end) > 0]
            sought = [i for i in sought if wanted[i].past(cell.end) <= 0]
            at = {i: cell.border(wanted[i], tolerance) for i in mine}
            found.update({i: k for i, k in at.items() if k})
            if left := [i for i, k in at.items() if not k]:
                opened.append((cell, left))

    settle([whole], list(range(len(wanted))))
    while opened:
        cells, opened = opened, []
        each = max(1, probes * len(wanted) // len(cells))
        bounds: list[Key] = []
        owners = [-1]  # whose interval ends at each bound; -1: none
        for n, (cell, _) in enumerate(cells):
            inner = [cell.least, *cell.probes(each)]
            bounds += [*inner, after(cell.most)]
            owners += [*[n] * len(inner), -1]
        parts: dict[int, list] = {}
        for r in counted(rows, bounds, owners).collect():  # at most a row for each probe and cell
            parts.setdefault(owners[r["at"]], []).append(r)
        for n, (cell, sought) in enumerate(cells):
            inner, before = [], cell.before
            for r in sorted(parts[n], key=lambda r: r["at"]):
                end = (before[0] + r["bytes"], before[1] + r["rows"])
                inner.append(Cell(before, end, tuple(r["least"]), tuple(r["most"])))
                before = end
            settle(inner, sought)
    return [found[i] for i in range(len(wanted))]


def totals() -> list[Column]:
    return [F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min(F.struct(*LEVELS)).alias("least"), F.max(F.struct(*LEVELS)).alias("most")]


def counted(rows: DataFrame, bounds: list[Key], owners: list[int]) -> DataFrame:
    """The local histograms, added up: bytes, rows, least and greatest key by interval, for intervals that have an owner."""
    table, owned = np.array(bounds, np.int64), np.array(owners, np.int64)

    def interval(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        at = place([x.to_numpy() for x in (a, b, c)], table)
        return pd.Series(np.where(owned[at] >= 0, at, -1))

    return rows.select("size", *LEVELS, F.pandas_udf(interval, "long")(*LEVELS).alias("at")).where("at >= 0").groupBy("at").agg(*totals())


def sharded(docs: DataFrame, shards: int = SHARDS, tolerance: int = 0, probes: int = PROBES, pieces: int | None = None) -> DataFrame:
    """row (all columns of docs), size, shard, slot. ``pieces``: into how many the order is cut for the numbering, by default as many as the bytes need."""
    rows = keyed(docs)
    every = rows.agg(*totals()).first()
    n, total = every["rows"], every["bytes"] or 0
    pieces = pieces or min(FINEST, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PIECE_BYTES)))
    wanted = [Splitter((1, 0), i, shards, total) for i in range(1, shards)] + [Splitter((n, total), i, pieces, 2 * n * total) for i in range(1, pieces)]
    found = splitters(rows, wanted, Cell((0, 0), (total, n), tuple(every["least"]), tuple(every["most"])), tolerance, probes) if n else []
    borders, cuts = sorted(found[: shards - 1]), sorted(found)
    owner = np.array([0, *[bisect_right(borders, c) for c in cuts]], np.int64)
    table = np.array(cuts, np.int64).reshape(-1, len(LEVELS))

    def code(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        at = place([x.to_numpy() for x in (a, b, c)], table)
        return pd.Series(at * shards + owner[at])

    at = F.pandas_udf(code, "long")(*LEVELS)
    sizes = rows.groupBy(at.alias("code")).agg(F.count("*").alias("n")).withColumn("of", F.pmod("code", F.lit(shards)))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("of").orderBy("code").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("code", F.col("of").cast("int").alias("shard"), before.alias("start"))
    ranked = rows.withColumn("code", at).withColumn("rank", F.row_number().over(Window.partitionBy("code").orderBy(*LEVELS)))
    return ranked.join(F.broadcast(starts), "code").select("row", "size", "shard", (F.col("start") + F.col("rank") - 1).alias("slot"))  # a row for each cut, of which there are few


def write_shards(placed: DataFrame, path: str) -> None:
    """The rows of ``sharded`` as Parquet files, a folder for each shard; slot is kept as a column, in ``_slot``."""
    placed.select("row.*", F.col("slot").alias("_slot"), F.col("shard").alias("_shard")).write.partitionBy("_shard").parquet(path)


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    crc = F.crc32(F.coalesce(F.col("row.text"), F.lit("")).cast("binary"))
    return sharded(docs, shards).select(F.col("row.doc_id").alias("doc_id"), "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
