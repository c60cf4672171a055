import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from lacuna.llm import collocations as c


def brute(rows, least, top=2000):
    text_of = lambda t: "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t or "")
    f, n = {}, Counter()
    for lang, t in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text_of(t)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        frequent = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        covered = set()
        for p, a in frequent.items():
            for k in range(2, len(p)):
                covered |= {q for i in range(len(p) - k + 1) if 100 * a >= 80 * counts[q := p[i : i + k]]}
        kept = []
        for p, a in frequent.items():
            if p not in covered:
                score, _, left, right = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k, p.decode(), -a, left, right, n[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def corpus(seed, n=400):
    r = random.Random(seed)
    words = ["the", "Of", "and", "é", "ß x", "x1", "don't", "\x1cq", "LONG", "y\x00z"]
    rows = []
    for _ in range(n):
        t = " ".join(r.choices(words, [9, 7, 5, 3, 2, 2, 1, 1, 1, 1], k=r.randint(0, 40)))
        t = re.sub(" ", lambda m: r.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\n"]), t)
        rows.append((r.choice(["en", "en", "de", None, "und"]), t))
    return [*rows, ("en", None), (None, ""), ("fr", " .,\n"), *[("en", "a fixed phrase of words, a fixed phrase of")] * 40, ("de", "the of " * 20_000)]


@pytest.mark.parametrize("least,top", [(3, 2000), (10, 7), (30, 2000)])
def test_phrases_equal_brute_force(spark, monkeypatch, least, top):
    rows = corpus(least)
    docs = spark.createDataFrame([(a, b, 1, "z") for a, b in rows], "lang string, text string, id int, word string").repartition(3)
    assert sorted(tuple(x) for x in c.phrases(docs, least, top).collect()) == brute(rows, least, top)


def test_empty_tables(spark):
    assert c.phrases(spark.createDataFrame([], "lang string, text string")).collect() == []
    assert c.phrases(spark.createDataFrame([("en", None), (None, "one word")], "lang string, text string")).collect() == []


def test_many_partitions_and_few_words(spark):
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        rows = [("en", "a b a b. A b")] * 10
        assert sorted(tuple(x) for x in c.phrases(spark.createDataFrame(rows, "lang string, text string"), 3).collect()) == brute(rows, 3)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)


def test_slices_and_giant_words(monkeypatch):
    monkeypatch.setattr(c, "SLICE_BYTES", 7)
    for text in (b"aa bb, cc dd", b"x" * 50, b"x" * 50 + b" y." + b"z" * 30, b"", b"  ", b"a" * 7 + b" b"):
        ids, words = c.numbers_of([text, text])
        plain = re.sub(rb"[.,]", b" , ", text).split()
        assert [([b","] + words)[i] for i in ids] == [*plain, b",", *plain]


@pytest.mark.parametrize("half", [5, 16, 17, 32, 33, 50, 64])
def test_filters_lose_nothing(half):
    r = np.random.default_rng(half)
    top = (1 << half) - 1
    a, b = (r.integers(0, top, 3000, np.uint64, endpoint=True) for _ in range(2))
    assert all((x == y).all() for x, y in zip(c.restored(*c.permuted(a, b, half), half), (a, b), strict=True))
    n = r.integers(1, 1000, 3000)
    n[:2] = 255, 1 << 40
    a[:1500], b[:1500] = a[1500:], b[1500:]
    expected = Counter()
    for x, y, k in zip(a.tolist(), b.tolist(), n.tolist(), strict=True):
        expected[x, y] += k
    a, b, n = c.summed(a, b, n, half)
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == sorted(expected) and n.tolist() == [expected[k] for k in sorted(expected)]
    for bits in (1, 4):
        for first in range(1 << bits):
            mine = c.leading(a, b, half, bits) == first
            back = c.unpacked(c.packed(a[mine], b[mine], n[mine], half, first, bits), half, first, bits)
            assert all((x == y).all() for x, y in zip(back, (a[mine], b[mine], n[mine]), strict=True))


@pytest.mark.parametrize("block,piece", [(1 << 22, 1 << 18), (7, 3), (64, 64), (100, 7)])
def test_blocks_lose_no_phrase(monkeypatch, block, piece):
    monkeypatch.setattr(c, "BLOCK_WORDS", block)
    monkeypatch.setattr(c, "PIECE_WORDS", piece)
    words = np.random.default_rng(block).integers(0, 6, 500).astype(np.uint32)
    marks, bits, plain = np.full(1 << 3, 255, np.uint8), 6, words.tolist()
    grams = lambda k: Counter(g for i in range(len(plain) - k + 1) if 0 not in (g := tuple(plain[i : i + k])))
    pairs, longer = Counter(), Counter()
    for found, keys_of, half in ((pairs, c.pairs_of, bits), (longer, lambda g, most: c.longer_of(g, most, bits, marks, 6), 2 * bits)):
        for ranges, made in c.filters_of(words, keys_of, half, 3):
            for r, data in zip(ranges.tolist(), made, strict=True):
                a, b, n = c.unpacked(data, half, r, 3)
                for x, y, k in zip(*[v.tolist() for v in c.restored(a, b, half)], n.tolist(), strict=True):
                    found[x, y] += k
    assert pairs == grams(2)
    assert longer == Counter({(g[0] << bits | g[1], g[2] << bits | (g[3] if k == 4 else 0)): n for k in (3, 4) for g, n in grams(k).items()})


def test_a_chunk_is_counted_within_bounds():
    words = np.random.default_rng(1).integers(1, 1 << 20, 3_000_000).astype(np.uint32)
    marks = np.full(1 << 17, 255, np.uint8)
    tracemalloc.start()
    try:
        total = sum(c._HEAD.unpack_from(data)[0] for _, made in c.filters_of(words, lambda g, most: c.longer_of(g, most, 20, marks, 20), 40, 6) for data in made)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert total == 5_999_995 and peak < 200 << 20  # the keys alone are 92 MB; all at once took more than 400
