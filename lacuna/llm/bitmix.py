"""Language-model scoring by logistic mixing of context bit predictors.

A text is its words, lower-cased and joined by single spaces, and a final newline. Each byte is spelled by the bits of a
prefix code made from the training bytes; every bit is predicted from several contexts (``CONTEXTS``: the last one to five bytes, and the
current word so far, of at most seven bytes). A context's key is its bytes packed into 64 bits with room for the code node: a hash without
collisions. A slot counts the zeros and ones that followed it over all training documents. The predictions' logits are mixed with
weights that a gate selects (the longest context seen, how often, and how often the current word's beginning was), learned online; an adaptive
map then refines the mixed probability by what followed it in training. Both are learned with the current occurrence left out
of the counts, on every occurrence of every training document; the online steps go over distinct grams in the order of their keys, weighted by how often they occur. The score is the sum of the bits' log10
probabilities, a proper probability over token sequences.

The work is done once for each distinct *gram* (a byte and the seven before it), however often it occurs: an aggregation counts
grams; they are dealt by their last two context bytes, so that every slot of a longer context lies in one task, and the slots of
the last byte alone (65,536 pairs at most) are sent along. At most 65,536 tasks can so share the work, and the most frequent pair is one of them (3 % of the grams of the test tables). One pass learns weights and map, a second one gives each gram
its log probability. The slots are as many as the corpus has contexts: nothing has a fixed size.

Texts then add up their grams. At most ``HEAVY_GRAMS`` grams and ``HEAVY`` words, those with the highest counts, are looked up within
the tasks; all others go through joins on the gram or word, none of which is frequent. The unigram base adds up
the tokens of all documents with the counts of all training tokens in the same way.

Defined cases: a null text is empty and scores its end alone; a null doc_id counts as the empty id; rows that repeat are scored alike and
counted each; without training rows N and V are 0 and every bit has probability one half; an empty table gives no rows; other columns are neither read nor returned.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from uuid import uuid4
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, meet, running_sums, settled, small_batches

FOLDS = 10
HEAVY = 400_000
HEAVY_GRAMS = 1 << 21
#: Bytes of context; the last entry is the current word so far, with the space before it (two bytes at least, PAD at most).
CONTEXTS = (1, 2, 3, 4, 5, "word")
K = len(CONTEXTS)
PAD, LEAST = 7, 5
#: What stands before a text: its first word begins like any other.
BEFORE = b"\0" * (PAD - 1) + b" "
PRIOR = 0.1
MINIBATCH = 4096
LIMIT = 8.0
#: Seen at least so often: the classes of a gate.
SEEN = (1, 3, 16)
LEVELS = len(SEEN) + 1
GATES = ((K - 1) * len(SEEN) + 1) * LEVELS
BUCKETS = 33
END = b"\n"
#: Distinct words, and grams, that a task counts before it hands them on.
FLUSH = 300_000
FLUSH_GRAMS = 2_000_000
#: Parts by hash for each task that adds them up.
PARTS = 4
#: Grams that are made distinct at once.
RAW_GRAMS = 2_000_000
#: Distinct grams of a task, on average.
TASK_GRAMS = 150_000

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_BYTE = np.uint64(8)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


class Code:
    """A prefix code of bytes: for each byte its length and rank (the order of the codes), and for each depth the node and the bit."""

    def __init__(self, counts: np.ndarray):
        heap = [(int(n) + 1, b, b) for b, n in enumerate(counts)]
        heapq.heapify(heap)
        kids, new = {}, 256
        while len(heap) > 1:
            (n, _, a), (m, _, b) = heapq.heappop(heap), heapq.heappop(heap)
            kids[new] = (a, b)
            heapq.heappush(heap, (n + m, new, new))
            new += 1
        paths: dict[int, list[tuple[int, int]]] = {heap[0][2]: []}
        for node in sorted(kids, reverse=True):
            for bit, kid in enumerate(kids[node]):
                paths[kid] = [*paths[node], (node, bit)]
        self.length = np.array([len(paths[b]) for b in range(256)])
        self.node, self.bit = np.zeros((self.length.max(), 256), np.int64), np.zeros((self.length.max(), 256), np.int64)
        for b in range(256):
            for d, (node, bit) in enumerate(paths[b]):
                self.node[d, b], self.bit[d, b] = node, bit
        self.byte = np.array(sorted(range(256), key=lambda b: [bit for _, bit in paths[b]]))
        self.rank = np.argsort(self.byte).astype(np.uint64)


def pieces_of(texts: pd.Series) -> list[bytes]:
    return [b" ".join(words(t)) + END for t in texts]


def grams(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each piece, itself (lowest) and the bytes before it as one number; and where pieces begin.

    Of the bytes before it those are kept that a context has: the current word with the space before it up to PAD bytes, and LEAST ones at least.
    """
    data = b"".join([x for p in pieces for x in (BEFORE, p)])
    g = np.ndarray(len(data) - PAD, ">u8", data, 0, (1,)).astype(np.uint64)
    space = np.frombuffer(data, np.uint8) == 0x20
    near = space[PAD - 1 : -1].copy()  # is there a space among the last LEAST context bytes, and one more
    for k in range(1, LEAST):
        near |= space[PAD - 1 - k : -1 - k]
    for k in range(LEAST, PAD):
        # beyond the space before the current word nothing is kept
        g &= ~(near.astype(np.uint64) * np.uint64(0xFF << 8 * (k + 1)))
        near |= space[PAD - 1 - k : len(space) - 1 - k]
    sizes = np.array([len(p) for p in pieces])
    ends = np.cumsum(sizes + PAD) - PAD
    return np.concatenate([g[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]), np.cumsum(sizes) - sizes


def context(g: np.ndarray, kind) -> np.ndarray:
    """The context bytes of each gram that a predictor of this kind sees, the latest lowest."""
    held = g >> _BYTE
    if kind != "word":
        return held & np.uint64((1 << 8 * kind) - 1)
    mask = np.full(len(g), (1 << 8 * PAD) - 1, np.uint64)
    for j in range(PAD, 0, -1):
        space = (held >> np.uint64(8 * (j - 1))) & np.uint64(255) == np.uint64(0x20)
        mask[space] = (1 << 8 * max(2, j)) - 1
    return held & mask


class Slots:
    """The slot counts that distinct grams ``g``, seen ``n`` times in training, need; all grams with the same last two context bytes must be there.

    ``last`` has the counts of the last byte's contexts: (byte, node, bit). ``order`` sorts the grams by falling code length: at depth d the first ``active[d]`` have a bit.
    """

    def __init__(self, g: np.ndarray, n: np.ndarray, code: Code, last: np.ndarray):
        length = code.length[(g & np.uint64(255)).astype(np.int64)]
        self.order = np.argsort(-length, kind="stable")
        self.g, self.n, self.code, self.last = g[self.order], n[self.order].astype(float), code, last
        self.byte = (self.g & np.uint64(255)).astype(np.int64)
        self.active = [a for d in range(len(code.node)) if (a := int((length > d).sum()))]
        self.back, self.rows, seen = [None], [None], [last[(context(self.g, 1)).astype(np.int64), code.node[0, 0]].sum(1)]
        for kind in CONTEXTS[1:]:
            key, back = np.unique((context(self.g, kind) << _BYTE) | code.rank[self.byte], return_inverse=True)
            held, byte = key >> _BYTE, code.byte[(key & np.uint64(255)).astype(np.int64)]
            total = np.bincount(back, self.n, len(key))
            run = np.cumsum(np.diff(held, prepend=held[:1]) != 0)
            seen.append((np.bincount(run, total) if len(run) else total)[run][back])
            self.back.append(back)
            self.rows.append((run, byte, total, code.length[byte]))
        self.seen = seen

    def gates(self, left_out: int) -> np.ndarray:
        """Of each gram: the longest context seen and how often (0: none), and how often the current word's beginning was."""
        level = lambda c: sum((c - left_out >= s).astype(np.int64) for s in SEEN)
        gate = np.zeros(len(self.g), np.int64)
        for k in range(K - 1):
            own = level(self.seen[k])
            gate = np.where(own > 0, k * len(SEEN) + own, gate)
        return gate * LEVELS + level(self.seen[K - 1])

    def counts(self, k: int, d: int, a: int) -> tuple[np.ndarray, np.ndarray]:
        """Zeros and ones that followed the k-th context of the first ``a`` grams at the code node of depth d."""
        if k == 0:
            c = self.last[context(self.g[:a], 1).astype(np.int64), self.code.node[d][self.byte[:a]]]
            return c[:, 0], c[:, 1]
        run, byte, total, length = self.rows[k]
        own = np.flatnonzero(length > d)
        run, byte, total = run[own], byte[own], total[own]
        node = self.code.node[d][byte]
        # bytes are in the order of their codes, so those below a node follow one another
        group = np.cumsum(np.concatenate([[False], (run[1:] != run[:-1]) | (node[1:] != node[:-1])]))
        ones, every = np.bincount(group, total * self.code.bit[d][byte]), np.bincount(group, total)
        spot = np.zeros(len(length), np.int64)
        spot[own] = group
        at = spot[self.back[k][:a]]
        return every[at] - ones[at], ones[at]

    def bits(self, left_out: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """By depth: logits (K x active grams) and bits; ``left_out`` occurrences of the gram itself are taken from the counts."""
        for d, a in enumerate(self.active):
            bit = self.code.bit[d][self.byte[:a]]
            x = np.empty((K, a), np.float32)
            for k in range(K):
                zeros, ones = self.counts(k, d, a)
                if left_out:
                    zeros, ones = np.maximum(zeros - left_out * (1 - bit), 0), np.maximum(ones - left_out * bit, 0)
                x[k] = np.clip(np.log((ones + PRIOR) / (zeros + PRIOR)), -LIMIT, LIMIT)
            yield x, bit


class Learner:
    """Weights by gate, learned online: each minibatch takes a Newton step with all the curvature seen so far."""

    def __init__(self):
        self.weights = np.full((GATES, K), 0.2)
        self.curve = np.tile(np.eye(K) * 50.0, (GATES, 1, 1))

    def learn(self, gate: np.ndarray, x: np.ndarray, bit: np.ndarray, n: np.ndarray) -> None:
        for a in range(0, len(bit), MINIBATCH):
            g, m, v = gate[a : a + MINIBATCH], n[a : a + MINIBATCH], x[:, a : a + MINIBATCH].astype(float)
            met, g = np.unique(g, return_inverse=True)
            p = 1 / (1 + np.exp(-(self.weights[met][g].T * v).sum(0)))
            pull, bend = (bit[a : a + MINIBATCH] - p) * m, p * (1 - p) * m
            slope = np.stack([np.bincount(g, pull * v[r], len(met)) for r in range(K)], 1)
            curve = self.curve[met]
            for r in range(K):
                for c in range(r, K):
                    h = np.bincount(g, bend * v[r] * v[c], len(met))
                    curve[:, r, c] += h
                    if c != r:
                        curve[:, c, r] += h
            self.curve[met] = curve
            self.weights[met] += np.linalg.solve(curve, slope[:, :, None])[:, :, 0]


def training_bits(s: Slots) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gate, logits, bit and multiplicity of every bit of the training grams, in an order without any pattern."""
    gate, parts = s.gates(1), []
    for x, bit in s.bits(1):
        own = np.flatnonzero(s.n[: len(bit)] > 0)
        parts.append((gate[own], x[:, own], bit[own], s.n[own], (s.g[own] + np.uint64(len(parts))) * _ODD))
    if not parts:
        return np.zeros(0, np.int64), np.zeros((K, 0), np.float32), np.zeros(0, np.int64), np.zeros(0)
    gate, bit, n, mixed = (np.concatenate([p[i] for p in parts]) for i in (0, 2, 3, 4))
    order = np.argsort(mixed ^ (mixed >> np.uint64(29)), kind="stable")
    return gate[order], np.concatenate([p[1] for p in parts], 1)[:, order], bit[order], n[order]


def place(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower bucket of the map and the share of the next one."""
    at = (np.clip(z, -LIMIT, LIMIT) + LIMIT) * ((BUCKETS - 1) / (2 * LIMIT))
    low = np.minimum(at.astype(np.int64), BUCKETS - 2)
    return low, at - low


def log_probabilities(s: Slots, weights: np.ndarray, refined: np.ndarray) -> np.ndarray:
    """Natural log probability of the last byte of each gram after its context, in the order in which Slots got them."""
    gate, total = s.gates(0), np.zeros(len(s.g))
    w = weights[gate].T
    for x, bit in s.bits(0):
        a = len(bit)
        z = (w[:, :a] * x).sum(0)
        low, part = place(z)
        at = gate[:a] * BUCKETS + low
        p = 0.5 / (1 + np.exp(-z)) + 0.5 * (refined[at] * (1 - part) + refined[at + 1] * part)
        total[:a] += np.log(np.where(bit == 1, p, 1 - p))
    out = np.empty(len(s.g))
    out[s.order] = total
    return out


def summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(g, n, m): distinct grams with the sums of their counts."""
    g, n, m = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.argsort(g)
    g, n, m = g[order], n[order], m[order]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    return g[first], *(np.add.reduceat(x, first) if len(first) else x for x in (n, m))


def counted(docs: DataFrame) -> DataFrame:
    """Counts over all rows of (text, held_out): word, g, n, m.

    A row with a word (an end is a newline, which is in no word) has its training tokens n; one with a gram g (as a signed number) has n in
    training and m in all documents. Each task counts for itself and hands on what it has in parts by hash, a few packed values each, which are added up part by part.
    """
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = PARTS * tasks

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _KEPT.clear()  # of an earlier scoring in this process
        held: Counter = Counter()
        raw, done = {False: [], True: []}, []
        for b in batches:
            for out in False, True:
                pieces = []
                for t in b["text"][b["held_out"] == out]:
                    w = words(t)
                    if not out:
                        held.update(w)
                    pieces.append(b" ".join(w) + END)
                if pieces:
                    held[b""] += 0 if out else len(pieces)  # the end, as long as words are packed
                    raw[out].append(grams(pieces)[0])
                if sum(map(len, raw[out])) > RAW_GRAMS:
                    done.append(distinct(raw[out], out))
                    raw[out] = []
            if len(held) > FLUSH:
                yield pack_words(held)
                held = Counter()
            if sum(len(p[0]) for p in done) > FLUSH_GRAMS:
                done = [summed(done)]
                if len(done[0][0]) > 3 * FLUSH_GRAMS // 4:
                    yield pack_grams(done)
                    done = []
        yield pack_words(held)
        yield pack_grams([*done, *(distinct(raw[out], out) for out in raw if raw[out])])

    def distinct(raw: list[np.ndarray], out: bool) -> tuple[np.ndarray, ...]:
        g, m = np.unique(np.concatenate(raw), return_counts=True)
        return g, m * (not out), m

    def dealt(part: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """An order by part, and (part, first, last) of each."""
        order = np.argsort(part, kind="stable")
        edges = np.flatnonzero(np.diff(part[order], prepend=-1, append=parts))
        return order, [(int(part[order[a]]), a, z) for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]

    def pack_words(held: Counter) -> pd.DataFrame:
        kept = [w for w, c in held.items() if c]
        n = np.fromiter((held[w] for w in kept), "<i8", len(kept))
        order, spans = dealt(np.fromiter(map(crc32, kept), np.int64, len(kept)) % parts)
        return pd.DataFrame([(k, END.join([kept[i] for i in order[a:z].tolist()]), n[order[a:z]].tobytes(), None) for k, a, z in spans], columns=["part", "a", "n", "m"])

    def pack_grams(done: list) -> pd.DataFrame:
        g, n, m = summed(done) if done else (np.zeros(0, np.uint64),) * 3
        with np.errstate(over="ignore"):
            order, spans = dealt((((g * _ODD) >> np.uint64(32)) % np.uint64(parts)).astype(np.int64))
        return pd.DataFrame([(k, *(x[order[a:z]].astype("<i8").tobytes() for x in (g.view(np.int64), n, m))) for k, a, z in spans], columns=["part", "a", "n", "m"])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bytes, int] = {}
        done: list = []
        for b in batches:
            for a, n, m in zip(b["a"], b["n"], b["m"], strict=True):
                n = np.frombuffer(n, "<i8")
                if m is not None:
                    done.append((np.frombuffer(a, "<u8").astype(np.uint64), n, np.frombuffer(m, "<i8")))
                else:
                    for w, c in zip(a.split(END), n.tolist(), strict=True):
                        held[w] = held.get(w, 0) + c
            if sum(len(p[0]) for p in done) > FLUSH_GRAMS:
                done = [summed(done)]
        if held:
            yield pd.DataFrame({"word": [w or END for w in held], "g": pd.array([None] * len(held), "Int64"), "n": np.fromiter(held.values(), np.int64, len(held)), "m": 0})
        if done:
            g, n, m = summed(done)
            yield pd.DataFrame({"word": pd.Series([None] * len(g), dtype=object), "g": g.view(np.int64), "n": n, "m": m})

    packs = docs.select("text", "held_out").mapInPandas(count, "part int, a binary, n binary, m binary")
    return packs.repartition(tasks, "part").mapInPandas(add, "word binary, g long, n long, m long")


def least_count(counts: DataFrame, count: str, most: int) -> int | None:
    """The smallest value of ``count`` that at most ``most`` rows reach."""
    by_count = counts.groupBy(F.col(count).alias("c")).agg(F.count("*").alias("n")).withColumn("down", -F.col("c"))
    return running_sums(by_count, [], "down", ["n"]).where(F.col("before_n") + F.col("n") <= most).agg(F.min("c").alias("least")).first()["least"]


def packed(rows: DataFrame, kinds: tuple[str, str]) -> list[tuple[bytes, bytes]]:
    """Two columns as bytes, a pair for each Arrow batch: what the driver sends on without looking into it. The rows must be few."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"a": [END.join(b["a"]) if kinds[0] == "word" else b["a"].to_numpy(kinds[0]).tobytes()], "b": [b["b"].to_numpy(kinds[1]).tobytes()]})

    return [(bytes(r["a"]), bytes(r["b"])) for r in rows.toDF("a", "b").mapInPandas(pack, "a binary, b binary").collect()]


class Lookup:
    """Log probabilities of the most frequent grams: a table of one probe, and a sorted list for the few that share a slot."""

    def __init__(self, sent: list[tuple[bytes, bytes]]):
        g = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(a, np.uint64) for a, _ in sent]])
        p = np.concatenate([np.zeros(0), *[np.frombuffer(b, np.float64) for _, b in sent]])
        order = np.argsort(g)
        self.g, self.p = g[order], p[order]
        self.shift = np.uint64(64 - max(10, (3 * len(g)).bit_length()))
        slot = self.slot(self.g)
        self.keys, self.values = np.zeros(1 << (64 - int(self.shift)), np.uint64), np.zeros(1 << (64 - int(self.shift)))
        self.keys[slot], self.values[slot] = self.g, self.p

    def slot(self, g: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((g * _ODD) >> self.shift).astype(np.int64)

    def find(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The log probability of each gram (0 where it is not listed), and which are not listed."""
        at = self.slot(g)
        p = self.values.take(at)
        miss = np.flatnonzero(self.keys.take(at) != g)
        if not len(miss):
            return p, miss
        if not len(self.g):
            p[miss] = 0.0
            return p, miss
        spot = np.minimum(np.searchsorted(self.g, g[miss]), len(self.g) - 1)
        found = self.g[spot] == g[miss]
        p[miss] = np.where(found, self.p[spot], 0.0)
        return p, miss[~found]


_KEPT: dict[str, object] = {}


def kept_for(token: str, make):
    """What ``make`` gives, kept for the next tasks of the same worker process; the one before is dropped."""
    if token not in _KEPT:
        _KEPT.clear()
        _KEPT[token] = make()
    return _KEPT[token]


def slots_of(batches: Iterator[pd.DataFrame], sent) -> tuple[Slots, np.ndarray]:
    """All grams of a task, by their number, and their slots."""
    _KEPT.clear()
    held = [(b["g"].to_numpy(np.int64).view(np.uint64), b["n"].to_numpy(np.int64), b["m"].to_numpy(np.int64)) for b in batches if len(b)]
    g, n, m = summed(held) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return Slots(g, n, *sent.value), m


def mixing(dealt: DataFrame, sent) -> tuple[np.ndarray, np.ndarray]:
    """Weights by gate and context, and the refined probability of a one by gate and bucket of the mixed logit.

    Each task learns online from equal first weights, and counts what followed each mixed logit; the weights' mean by bits seen is kept,
    and the counts are added up and drawn to the bucket's own value.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        learner = Learner()
        gate, x, bit, n = training_bits(slots_of(batches, sent)[0])
        learner.learn(gate, x, bit, n)
        low, part = place((learner.weights[gate].T * x).sum(0))
        at = gate * BUCKETS + low + (part > 0.5)
        bits, seen, ones = np.bincount(gate, n, GATES), np.bincount(at, n, GATES * BUCKETS), np.bincount(at, n * bit, GATES * BUCKETS)
        yield pd.DataFrame({"gate": np.repeat(np.arange(GATES), K), "k": np.tile(np.arange(K), GATES), "x": (learner.weights * bits[:, None]).ravel(), "n": np.repeat(bits, K)})
        own = np.flatnonzero(seen)
        yield pd.DataFrame({"gate": -1, "k": own, "x": ones[own], "n": seen[own]})

    z = np.linspace(-LIMIT, LIMIT, BUCKETS)
    weights, plain = Learner().weights, np.tile(1 / (1 + np.exp(-z)), GATES)
    ones, seen = np.zeros(GATES * BUCKETS), np.zeros(GATES * BUCKETS)
    for r in dealt.mapInPandas(run, "gate int, k int, x double, n double").groupBy("gate", "k").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).where("n > 0").collect():  # GATES * (K + BUCKETS) rows
        if r["gate"] < 0:
            ones[r["k"]], seen[r["k"]] = r["x"], r["n"]
        else:
            weights[r["gate"], r["k"]] = round(r["x"] / r["n"], 9)
    return weights, np.clip((ones + 20 * plain) / (seen + 20), 1e-5, 1 - 1e-5)


def last_byte(table: DataFrame) -> tuple[Code, np.ndarray]:
    """The code of the training bytes, and how often each bit followed each last byte at each node."""
    rows = np.array([(r["pair"], r["n"]) for r in table.groupBy(F.col("g").bitwiseAND(F.lit(0xFFFF)).alias("pair")).agg(F.sum("n").alias("n")).collect()], np.int64).reshape(-1, 2)  # 65,536 rows at most
    before, byte, n = rows[:, 0] >> 8, rows[:, 0] & 255, rows[:, 1].astype(float)
    code = Code(np.bincount(byte, n, 256).astype(np.int64))
    last = np.zeros((256, 512, 2))
    for d in range(len(code.node)):
        own = code.length[byte] > d
        np.add.at(last, (before[own], code.node[d][byte[own]], code.bit[d][byte[own]]), n[own])
    return code, last


def gram_scores(table: DataFrame) -> DataFrame:
    """g, m and p, the natural log probability of each distinct gram of ``table`` (g, n, m)."""
    spark = table.sparkSession
    sent = spark.sparkContext.broadcast(last_byte(table))
    tasks = max(1, math.ceil(table.count() / TASK_GRAMS))
    dealt = table.select("g", "n", "m").repartition(tasks, F.shiftrightunsigned("g", 8).bitwiseAND(F.lit(0xFFFF)))
    learned = spark.sparkContext.broadcast(mixing(dealt, sent))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, m = slots_of(batches, sent)
        p, g = log_probabilities(s, *learned.value), np.empty(len(s.g), np.uint64)
        g[s.order] = s.g
        yield pd.DataFrame({"g": g.view(np.int64), "m": m, "p": p})

    return dealt.mapInPandas(run, "g long, m long, p double")


def score(docs: DataFrame, folds: int = FOLDS, heavy: int = HEAVY, heavy_grams: int = HEAVY_GRAMS) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text", (crc_of_id(F.col("doc_id")) % folds == 0).alias("held_out"))
    both = settled(counted(docs))
    counts = both.where("word is not null").select("word", F.col("n").alias("c"))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.when(F.col("word") == F.lit(END), F.col("c"))), F.lit(0)).alias("ends")).first()
    n, v, ends = total["n"], total["v"], total["ends"]
    least = least_count(counts, "c", heavy)
    known = spark.sparkContext.broadcast(packed(counts.where(F.col("word") != F.lit(END)).where(F.col("c") >= F.lit(least)), ("word", "<i8")) if least is not None else [])
    scored = settled(gram_scores(both.where("g is not null")))
    least = least_count(scored, "m", heavy_grams)
    listed = spark.sparkContext.broadcast(packed(scored.where(F.col("m") >= F.lit(least)).select("g", "p"), ("<i8", "<f8")) if least is not None else [])
    end, below = float(np.log10((ends + 0.1) / (n + 0.1 * (v + 1)))), float(np.log10(n + 0.1 * (v + 1)))

    token = uuid4().hex

    def tables() -> tuple[Lookup, dict]:
        base: dict[bytes, float] = {}
        for a, c in known.value:
            base.update(zip(a.split(END), (np.log10(np.frombuffer(c, "<i8") + 0.1) - below).tolist(), strict=True))
        return Lookup(listed.value), base

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lookup, base = kept_for(token, tables)
        get = base.get
        for b in batches:
            rows, pieces = [], []
            for text in b["text"]:
                held = words(text)
                found = [get(w) for w in held]
                rest = [w for w, x in zip(held, found, strict=True) if x is None] if None in found else []
                rows.append((len(held) + 1, len(held) - len(rest) + (ends > 0), sum([x for x in found if x is not None] if rest else found) + end, rest))
                pieces.append(b" ".join(held) + END)
            if not rows:
                continue
            g, starts = grams(pieces)
            p, miss = lookup.find(g)
            cut = np.searchsorted(miss, np.append(starts, len(g)))
            missed = g[miss].view(np.int64)
            yield pd.DataFrame({
                "doc_id": b["doc_id"], "held_out": b["held_out"], "n_tokens": [r[0] for r in rows], "heavy_known": [r[1] for r in rows], "heavy_score": [r[2] for r in rows],
                "heavy_log": np.add.reduceat(p, starts), "n_bytes": [len(x) for x in pieces], "words": [r[3] for r in rows], "grams": [missed[a:z] for a, z in zip(cut[:-1], cut[1:], strict=True)],
            })

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.mapInPandas(run, f"doc_id {kind}, held_out boolean, n_tokens long, heavy_known long, heavy_score double, heavy_log double, n_bytes long, words array<binary>, grams array<long>")
    rows = settled(rows.withColumn("row", F.monotonically_increasing_id()))
    found = rows.select("row", F.explode("words").alias("word")).join(counts, "word", "left").select("row", F.col("c").isNotNull().cast("long").alias("known"), (F.log10(F.coalesce("c", F.lit(0)) + 0.1) - below).alias("base"), F.lit(0.0).alias("log"))
    others = rows.select("row", F.explode("grams").alias("g")).join(scored, "g").select("row", F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"), F.col("p").alias("log"))
    sums = found.unionByName(others).groupBy("row").agg(F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum("log").alias("log"))
    rows = meet(rows.drop("words", "grams"), sums, ["row"], "left")
    log10 = (F.col("heavy_log") + F.coalesce("log", F.lit(0.0))) / math.log(10)
    return rows.select(
        "doc_id", "held_out", "n_tokens", (F.col("heavy_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("heavy_score") + F.coalesce("base", F.lit(0.0))).alias("base_score"), log10.alias("score"), "n_bytes", (-log10 * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )
