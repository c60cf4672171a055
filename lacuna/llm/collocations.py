"""Phrases that occur together more often than their parts, counted in quotient filters.

Texts are split into pieces at punctuation and line ends, and these into words. A task turns its texts into chunks of word numbers with a dictionary of
their own; the dictionaries, a row for each word and chunk, are joined with the words that occur ``LEAST`` times or more, which are numbered 1, 2, ... over
all corpora. Rarer words cannot be part of a phrase that counts and act as borders, like the ends of pieces.

N-grams are packed into a key of two halves, permuted invertibly (a Feistel network), and counted in counting quotient filters: the leading bits of
the permuted key, its quotient, are kept as the number of entries in each slot, all other bits, its full remainder, beside a counter of a byte
that grows where it must. Nothing is lost, so every key can be restored. A filter is sorted by key; each chunk gives one for every range of
quotients, and the filters of a range are merged into one. A phrase, however frequent, is one entry of a chunk's filter.
Phrases of two words are counted first. A bitmap of at most 2**``BITMAP_BITS`` bits marks the quotients of those that are frequent; longer phrases are counted only where all their pairs are
marked (frequent ones always are).

Scores: cutting a phrase into two parts gives floor(2000000 * a / (l + r)); the lowest cut counts. A phrase goes if a longer frequent one that contains it
has at least 80 % of its count. All of this is integer arithmetic, in decimals where 64 bits may not do.

Defined cases: a null language is ``und``, together with texts that bear this name; a null or wordless text has no words; repeated rows count as often as they
occur; ties in score and count are settled by the phrase, byte by byte; a text of any length is split within its chunk; an empty table gives no rows; other columns are neither read nor returned.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import meet, settled, small_batches

LEAST, TOP = 30, 2000
#: Bytes of text of a chunk, and of the slices in which they are split into words.
CHUNK_BYTES, SLICE_BYTES = 16 << 20, 2 << 20
#: Entries that meet in one merged filter, about.
RANGE_ENTRIES = 1 << 20
BITMAP_BITS = 26
#: Words of a chunk that are counted in one filter a range, words whose phrases are permuted together, and bits by which the keys are then dealt: a task holds the keys
#: of one block, and sorts and packs one part of them at a time.
BLOCK_WORDS, PIECE_WORDS, PART_BITS = 1 << 22, 1 << 18, 3
#: Phrases that are ranked in one task, about.
RANKED = 50_000

_BORDER = 0xFF  # no byte of UTF-8
_TABLE = bytes(_BORDER if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_ROUNDS = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7)


# ---------------------------------------------------------------- words

class Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def numbers_of(texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """The word numbers of the texts with 0 between pieces, and the words numbered from 1."""
    data = bytes([_BORDER]).join(texts).translate(_TABLE)
    known, parts, at = Numbers({bytes([_BORDER]): 0}), [], 0
    while at < len(data):
        end = at + SLICE_BYTES
        if end < len(data):  # up to a border or a space, the last one if there is one
            cut = max(data.rfind(c, at, end) for c in (b"\xff", b" ", b"\t"))
            ahead = [x for c in (b"\xff", b" ", b"\t") if (x := data.find(c, end)) >= 0] if cut < at else []
            end = cut + 1 if cut >= at else min(ahead, default=len(data) - 1) + 1
        words = data[at:end].replace(b"\xff", b" \xff ").split()
        parts.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
        at = end
    return np.concatenate([np.zeros(0, np.int32), *parts]), list(known)[1:]


_CHUNK = pa.schema([("lang", pa.string()), ("ids", pa.binary()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64()))])


def to_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}

    def flush(lang: str) -> pa.RecordBatch:
        ids, words = numbers_of(held.pop(lang))
        del sizes[lang]
        counts = np.bincount(ids, minlength=len(words) + 1)[1:]
        ends = pa.array([0, len(words)], pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(x, t)) for x, t in ((words, pa.binary()), (counts, pa.int64()))]
        return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([ids.tobytes()], pa.binary()), *lists], schema=_CHUNK)

    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            held.setdefault(lang, []).append(text)
            sizes[lang] = sizes.get(lang, 0) + len(text) + 1
            if sizes[lang] >= CHUNK_BYTES:
                yield flush(lang)
            elif sum(sizes.values()) >= 2 * CHUNK_BYTES:
                yield flush(max(sizes, key=sizes.get))
    for lang in list(held):
        yield flush(lang)


def chunked(docs: DataFrame) -> DataFrame:
    """chunk, lang, ids, words, counts."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    made = rows.mapInArrow(to_chunks, "lang string, ids binary, words array<binary>, counts array<long>")
    return settled(made.withColumn("chunk", F.monotonically_increasing_id()))


def dense(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as a table with ``name``: 1, 2, ... Only a count for each task meets in one place."""
    rows = settled(rows.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    return settled(rows.withColumn("_part", part).join(starts, "_part").withColumn(name, F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_at", "_part", "_start"))


def vocabulary(words: DataFrame, least: int) -> DataFrame:
    """lang, word, f, id of the words that occur ``least`` times or more in a language."""
    counts = words.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    return dense(counts, "id")


def renumbered(chunks: DataFrame, words: DataFrame, vocab: DataFrame) -> DataFrame:
    """grams: the chunks with the numbers of the vocabulary, 0 for borders and rare words."""
    known = words.join(vocab.select("lang", "word", "id"), ["lang", "word"]).groupBy("chunk").agg(F.collect_list(F.struct("local", "id")).alias("known"))

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                ids, known = np.frombuffer(b.column("ids")[k].as_py(), np.int32), b.column("known")[k].values
                table = np.zeros(ids.max(initial=0) + 1, np.uint32)
                table[known.field("local").to_numpy()] = known.field("id").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array([table[ids].tobytes()], pa.binary())], ["grams"])

    return settled(chunks.select("chunk", "ids").join(known, "chunk").select("ids", "known").mapInArrow(turn, "grams binary"))


# ---------------------------------------------------------------- filters

def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(a: np.ndarray, b: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """An invertible map of keys of two halves of ``half`` bits."""
    mask = np.uint64((1 << half) - 1)
    for k in _ROUNDS:
        a, b = b, a ^ (_mixed(b + np.uint64(k)) & mask)
    return a, b


def restored(a: np.ndarray, b: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << half) - 1)
    for k in reversed(_ROUNDS):
        a, b = b ^ (_mixed(a + np.uint64(k)) & mask), a
    return a, b


def leading(a: np.ndarray, b: np.ndarray, half: int, bits: int) -> np.ndarray:
    """The first ``bits`` bits of the keys."""
    if bits <= half:
        return a >> np.uint64(half - bits)
    return (a << np.uint64(bits - half)) | (b >> np.uint64(2 * half - bits))


def summed(a: np.ndarray, b: np.ndarray, n: np.ndarray | None, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counters (1 each without ``n``)."""
    if 2 * half <= 64 and n is None:
        key = np.sort((a << np.uint64(half)) | b)
        a, b = key >> np.uint64(half), key & np.uint64((1 << half) - 1)
    else:
        order = np.argsort((a << np.uint64(half)) | b, kind="stable") if 2 * half <= 64 else np.lexsort((b, a))
        a, b, n = a[order], b[order], None if n is None else n[order]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    sums = np.diff(np.append(new, len(a))) if n is None else np.add.reduceat(n, new) if len(a) else n
    return a[new], b[new], sums


_HEAD = struct.Struct("<QBBQ")


def packed(a: np.ndarray, b: np.ndarray, n: np.ndarray, half: int, first: int, bits: int) -> bytes:
    """A filter of sorted keys that all begin with the ``bits`` bits ``first``: entries by slot, remainders, counters."""
    q = min(half, bits + max(0, len(a).bit_length() - 1))
    runs = np.bincount((a >> np.uint64(half - q)).astype(np.int64) - (first << (q - bits)), minlength=1 << (q - bits))
    runs = runs.astype(np.min_scalar_type(int(runs.max(initial=0))))
    cut = lambda x, wide: x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-wide // 8)].tobytes()
    more = n - 1
    large = more[more >= 255].astype("<u8")
    head = _HEAD.pack(len(a), q, runs.dtype.itemsize, len(large))
    return head + runs.tobytes() + cut(a & np.uint64((1 << (half - q)) - 1), half - q) + cut(b, half) + np.minimum(more, 255).astype(np.uint8).tobytes() + large.tobytes()


def unpacked(data: bytes, half: int, first: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size, q, item, many = _HEAD.unpack_from(data)
    at = _HEAD.size
    runs = np.frombuffer(data, f"<u{item}", 1 << (q - bits), at)
    at += runs.nbytes

    def wide(bits_: int) -> np.ndarray:
        nonlocal at
        take = -(-bits_ // 8)
        out = np.zeros((size, 8), np.uint8)
        out[:, :take] = np.frombuffer(data, np.uint8, size * take, at).reshape(size, take)
        at += size * take
        return out.view("<u8").ravel()

    low, b = wide(half - q), wide(half)
    slots = np.repeat(np.arange(len(runs), dtype=np.uint64) + np.uint64(first << (q - bits)), runs)
    n = np.frombuffer(data, np.uint8, size, at).astype(np.int64)
    n[n == 255] = np.frombuffer(data, "<u8", many, at + size)
    return (slots << np.uint64(half - q)) | low, b, n + 1


def pairs_of(g: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of two words that begin among the first ``most`` words."""
    at = np.flatnonzero((g[:-1] > 0) & (g[1:] > 0))
    at = at[at < most]
    return g[at], g[at + 1]


def longer_of(g: np.ndarray, most: int, bits: int, marks: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of three and four words all of whose pairs are marked and that begin among the first ``most`` words, as halves of two words."""
    at = np.flatnonzero((g[:-1] > 0) & (g[1:] > 0))
    spot = leading(*permuted(g[at], g[at + 1], bits), bits, wide)
    ok = np.zeros(len(g) + 2, bool)
    ok[at] = (marks[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1
    three = np.flatnonzero(ok[:-1] & ok[1:])
    three = three[three < most]
    four = three[ok[three + 2]] if len(three) else three
    s = np.uint64(bits)
    a = (g[three] << s) | g[three + 1]
    c = g[three + 2] << s
    return np.concatenate([a, (g[four] << s) | g[four + 1]]), np.concatenate([c, (g[four + 2] << s) | g[four + 3]])


def filters_of(words: np.ndarray, keys_of, half: int, range_bits: int) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Ranges and filters of a chunk: for each block of words a filter for each range that its phrases have; those that begin in a block belong to it."""
    part_bits = min(PART_BITS, range_bits)
    for at in range(0, len(words), BLOCK_WORDS):
        end, parts = min(at + BLOCK_WORDS, len(words)), [[] for _ in range(1 << part_bits)]
        for start in range(at, end, PIECE_WORDS):
            most = min(PIECE_WORDS, end - start)
            a, b = permuted(*keys_of(words[start : start + most + 3].astype(np.uint64), most), half)
            part_of = leading(a, b, half, part_bits)
            for k, part in enumerate(parts):
                mine = part_of == k
                part.append((a[mine], b[mine]))
        while parts:
            a, b, n = summed(*[np.concatenate(x) for x in zip(*parts.pop(), strict=True)], None, half)
            ranges = leading(a, b, half, range_bits).astype(np.int64)
            starts = np.flatnonzero(np.diff(ranges, prepend=-1))
            made = [packed(a[i:j], b[i:j], n[i:j], half, int(ranges[i]), range_bits) for i, j in zip(starts, [*starts[1:], len(a)], strict=False)]
            yield ranges[starts], made


def counted(chunks: DataFrame, keys_of, half: int, least: int, range_bits: int, mark_bits: int = 0) -> DataFrame:
    """a, b, f of the keys that occur ``least`` times or more; with ``mark_bits`` also a row for each range with ``bits``, the marks of their leading bits."""

    def filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("grams"):
                for ranges, made in filters_of(np.frombuffer(data.as_buffer(), np.uint32), keys_of, half, range_bits):
                    yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), pa.array(made, pa.binary())], ["range", "filter"])

    def merged(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        first = int(key[0])
        parts = [unpacked(x, half, first, range_bits) for x in rows["filter"]]
        a, b, n = summed(*[np.concatenate(x) for x in zip(*parts, strict=True)], half)
        kept = n >= least
        a, b, n = a[kept], b[kept], n[kept]
        x, y = restored(a, b, half)
        out = pd.DataFrame({"a": x.astype(np.int64), "b": y.astype(np.int64), "f": n, "range": first, "bits": None})
        if mark_bits:
            marks = np.zeros(1 << (mark_bits - range_bits - 3), np.uint8)
            spot = leading(a, b, half, mark_bits).astype(np.int64) - (first << (mark_bits - range_bits))
            np.bitwise_or.at(marks, spot >> 3, (1 << (spot & 7)).astype(np.uint8))
            out = pd.concat([out, pd.DataFrame({"a": [0], "b": [0], "f": [0], "range": [first], "bits": [marks.tobytes()]})])
        return out

    made = chunks.mapInArrow(filters, "range int, filter binary")
    return settled(made.groupBy("range").applyInPandas(merged, "a long, b long, f long, range int, bits binary"))


def marks_of(found: DataFrame, range_bits: int, mark_bits: int) -> np.ndarray:
    """The bitmap of all ranges: 2**mark_bits bits, at most 2**BITMAP_BITS."""
    marks = np.zeros(1 << (mark_bits - 3), np.uint8)
    size = 1 << (mark_bits - range_bits - 3)
    for r in found.where("bits is not null").select("range", "bits").collect():
        marks[r["range"] * size : (r["range"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return marks


def grams(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hi, lo, f) of all phrases of one to four words that occur ``least`` times or more; the vocabulary; all words by language."""
    chunks = chunked(docs)
    totals = chunks.groupBy("lang").agg(F.sum(F.expr("aggregate(counts, 0L, (s, x) -> s + x)")).alias("n")).where("n > 0")
    words = chunks.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "x")).select("chunk", "lang", (F.col("at") + 1).alias("local"), F.col("x.words").cast("string").alias("word"), F.col("x.counts").alias("n"))
    vocab = vocabulary(words, least)
    spark = docs.sparkSession
    size, tokens = vocab.count(), totals.agg(F.sum("n")).first()[0] or 0
    range_bits = max(1, (max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * tokens // RANGE_ENTRIES) - 1).bit_length())
    bits = max(size.bit_length(), range_bits + 3)  # a half of a pair's key has the range's bits at least
    if bits > 32:
        raise ValueError("word numbers of more than 32 bits")
    text = renumbered(chunks, words, vocab)
    mark_bits = max(range_bits + 3, min(BITMAP_BITS, 2 * bits))
    two = counted(text, pairs_of, bits, least, range_bits, mark_bits)
    marks = spark.sparkContext.broadcast(marks_of(two, range_bits, mark_bits))
    more = counted(text, lambda g, most: longer_of(g, most, bits, marks.value, mark_bits), 2 * bits, least, range_bits)
    word = lambda c, k: F.shiftrightunsigned(c, k * bits).bitwiseAND((1 << bits) - 1)
    both = lambda x, y: F.shiftleft(x, 32).bitwiseOR(y)
    one = vocab.select(F.shiftleft("id", 32).alias("hi"), F.lit(0).cast("long").alias("lo"), "f")
    two = two.where("bits is null").select(both("a", F.col("b")).alias("hi"), F.lit(0).cast("long").alias("lo"), "f")
    more = more.select(both(word("a", 1), word("a", 0)).alias("hi"), both(word("b", 1), word("b", 0)).alias("lo"), "f")
    return settled(one.unionByName(two).unionByName(more)), vocab, totals


# ---------------------------------------------------------------- phrases

_LOW = (1 << 32) - 1


def _word(k: int) -> Column:
    c = F.col("hi" if k < 2 else "lo")
    return c.bitwiseAND(_LOW) if k % 2 else F.shiftrightunsigned(c, 32)


def _key(*words: Column) -> Column:
    zero = F.lit(0).cast("long")
    w = [*words, zero, zero, zero][:4]
    return F.struct(F.shiftleft(w[0], 32).bitwiseOR(w[1]).alias("hi"), F.shiftleft(w[2], 32).bitwiseOR(w[3]).alias("lo"))


def uncovered(found: DataFrame, share: int = 80) -> DataFrame:
    """hi, lo, a of phrases of two words or more that no longer one with ``share`` percent of their count contains."""
    w = [_word(k) for k in range(4)]
    inner = F.array(_key(w[0], w[1]), _key(w[1], w[2]))
    inner = F.when(w[3] > 0, F.concat(inner, F.array(_key(w[2], w[3]), _key(w[0], w[1], w[2]), _key(w[1], w[2], w[3])))).otherwise(inner)
    top = found.where(_word(2) > 0).select(F.explode(inner).alias("part"), "f").groupBy("part").agg(F.max("f").alias("top")).select("part.hi", "part.lo", "top")
    exact = lambda c, by: F.col(c).cast("decimal(20,0)") * F.lit(by)
    rows = found.where(_word(1) > 0).join(top, ["hi", "lo"], "left").where(F.col("top").isNull() | (exact("top", 100) < exact("f", share)))
    return rows.select("hi", "lo", F.col("f").alias("a"))


def scored(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Adds l, r and score of the lowest cut."""
    w = [_word(k) for k in range(4)]
    cuts = [F.struct(F.lit(k).alias("k"), _key(*w[:k]).alias("left"), _key(*w[k:]).alias("right")) for k in (1, 2, 3)]
    size = F.lit(2) + (w[2] > 0).cast("int") + (w[3] > 0).cast("int")
    rows = rows.select("hi", "lo", "a", F.explode(F.slice(F.array(*cuts), F.lit(1), size - 1)).alias("c")).select("hi", "lo", "a", "c.k", "c.left", "c.right")
    of = lambda side, name: found.select(F.struct("hi", "lo").alias(side), F.col("f").alias(name))
    rows = rows.join(of("left", "l"), "left").join(of("right", "r"), "right")
    score = F.expr("cast(cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + r) as bigint)")
    least = rows.groupBy("hi", "lo").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("m"), F.first("a").alias("a"))
    return least.select("hi", "lo", "a", "m.l", "m.r", "m.score")


def phrases(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language."""
    found, vocab, totals = grams(docs, least)
    rows = scored(uncovered(found), found).withColumn("id", _word(0)).join(vocab.select("id", "lang"), "id").drop("id")
    rows = settled(rows)
    # first within parts of a language, ties kept, so that no task ranks all of one
    part = F.pmod(F.xxhash64("hi", "lo"), F.lit(rows.count() // RANKED + 1))
    best = [F.desc("score"), F.desc("a")]
    rows = rows.withColumn("part", part)
    for by in (["lang", "part"], ["lang"]):
        rows = rows.withColumn("at", F.rank().over(Window.partitionBy(*by).orderBy(*best))).where(F.col("at") <= top)
    spelt = rows.select("hi", "lo", F.posexplode(F.array(*[_word(k) for k in range(4)])).alias("at", "id")).where("id > 0").join(vocab.select("id", "word"), "id")
    spelt = spelt.groupBy("hi", "lo").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("s")).select("hi", "lo", F.array_join(F.transform("s", lambda x: x["word"]), " ").alias("phrase"))
    rows = rows.drop("at").join(spelt, ["hi", "lo"])
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best, "phrase")).cast("long")).where(F.col("rank") <= top)
    return meet(rows, totals, ["lang"]).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
