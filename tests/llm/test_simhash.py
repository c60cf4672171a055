import random
import re

import xxhash

from lacuna.llm import simhash


def brute_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, ids, most=3):
    n = len(prints)
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= most:
                parent[find(a)] = find(b)
    groups = {}
    for k in range(n):
        groups.setdefault(find(k), []).append(ids[k])
    least = {g: min((i for i in v if i is not None), default=None) for g, v in groups.items()}
    return [least[find(k)] for k in range(n)]


def test_texts(spark):
    r = random.Random(4)
    text = lambda n: " ".join(r.choice(["The", "of", "é", "ab", "Cd", "x"]) for _ in range(n))
    texts = [text(r.randint(0, 60)) for _ in range(60)] + [None, "", " \t", "one", "One", "two words", "a b c", "A B C", "long " * 30_000]
    base = text(400)
    texts += [base, base, base + " x", base.replace("ab", "q", 1)]
    rows = [(500 - i, t) for i, t in enumerate(texts)] + [(None, base), (500, texts[0])]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, fp string")
    prints = [brute_print(t) for _, t in rows]
    expected = sorted(zip([i for i, _ in rows], [f"{p:016x}" for p in prints], brute_components(prints, [i for i, _ in rows]), strict=True), key=repr)
    assert sorted([tuple(x)[:3] for x in simhash.near_duplicates(docs).collect()], key=repr) == expected


def test_links_and_chains_of_given_prints(spark):
    r = random.Random(9)
    prints = [r.getrandbits(64) for _ in range(40)]
    for p in list(prints):
        for k in range(8):  # chains: every step flips up to three bits
            for _ in range(r.randint(1, 3)):
                p ^= 1 << r.randrange(64)
            prints.append(p)
    prints = sorted(set(prints) | {0, 1, 7, 2**64 - 1})
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    points = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    expected = {(min(signed(a), signed(b)), max(signed(a), signed(b))) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= 3}
    edges = simhash.links(points)
    assert {tuple(e) for e in edges.collect()} == expected
    roots = dict(map(tuple, simhash.components(edges).collect()))
    ids = [signed(p) for p in prints]
    for fp, root in zip(ids, brute_components(prints, ids), strict=True):
        assert roots.get(fp, fp) == root


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
