"""Toxicity, token lengths and language-model scoring: brute force where there is one, held-out quality otherwise."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lacuna.llm import bitmix, token_lengths, toxicity

LETTERS = "etaoinshrdlu"


def prose(r, n):
    return " ".join("".join(r.choice(LETTERS) for _ in range(r.randint(2, 8))) + r.choice(["", "", "", "."]) for _ in range(n))


def test_toxicity_held_out(spark):
    r = random.Random(1)
    bad = ["vile", "nasty", "filth"]
    docs, labels = [], []
    for i in range(900):
        toxic = r.random() < 0.2
        words = prose(r, r.randint(3, 120)).split()
        for _ in range(3 * toxic):
            words.insert(r.randrange(len(words) + 1), r.choice(bad))
        docs.append((i, " ".join(words), None, "x"))
        labels.append((i, int(toxic), "y"))
    docs += [(5000, None, None, "x"), (5001, "", None, "x"), (None, "vile", None, "x"), (5002, "word " * 50_000 + ". vile filth", None, "x"), (3, docs[3][1], None, "x")]
    labels += [(5000, None, "y"), (1, labels[1][1], "y"), (None, 1, "y")]
    found = toxicity.score(spark.createDataFrame(docs, "doc_id long, text string, lang string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int, text string")).collect()
    assert len(found) == len(docs)
    by = {x["doc_id"]: x for x in found}
    held = [(by[i]["predicted"], y) for i, y, _ in labels[:900] if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(900))
    assert sum(p == y for p, y in held) / len(held) > 0.97
    assert by[5000]["score"] == by[5001]["score"] < 0.2 and by[5002]["predicted"] == 1
    text = docs[-2][1]
    assert "vile filth" in text[by[5002]["sentence_start"] : by[5002]["sentence_end"]]


def test_training_rows_are_bounded_in_rows_and_bytes(spark):
    docs = spark.createDataFrame([(3, f"text {k}") for k in range(500)] + [(i, "same " * 10) for i in range(4, 40)] + [(4, "same " * 10), (1000, "unlabelled")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(40), *range(5000, 9000)]], "doc_id long, toxic int")
    every = toxicity.training_rows(docs, labels).collect()
    kept = [i for i in range(3, 40) if zlib.crc32(str(i).encode()) % 5]
    assert Counter(r["doc_id"] for r in every) == Counter({i: 500 if i == 3 else 1 for i in kept})
    assert toxicity.training_rows(docs, labels, sample=20).count() == 20
    few = toxicity.training_rows(docs, labels, sample_bytes=200).collect()
    assert 0 < sum(len(r["text"]) for r in few) <= 200 and set(map(tuple, few)) <= set(map(tuple, every))


def test_scores_equal_plain_sums():
    texts = ["Vile words here. Fine ones there!\nvileness and größenwahn", "größenordnung größen", "", None, "fine fine fine"]
    weights = {b"vile": 2.0, b"vilen*": 1.5, "größe*".encode(): 0.7, b"fine": -1.0}
    model = toxicity.Model(weights, -2.0, 0.02)
    for text in texts:
        safe, own = 0.98, []
        for sentence in re.split("[.!?\n]", (text or "").lower()):
            found = re.findall(r"[^\W_]+", sentence)
            if found:
                z = -2.0 + sum(weights.get(w.encode(), 0) + weights.get(w[:5].encode() + b"*", 0) for w in found)
                own.append(1 / (1 + math.exp(-z)))
                safe *= 1 - own[-1]
        p, top, worst, offending = model.score(text)
        assert p == pytest.approx(1 - safe) and offending == sum(x >= 0.5 for x in own)
        assert (top, worst) == ((own.index(max(own)), pytest.approx(max(own))) if own else (-1, 0.0))


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert toxicity.score(docs, spark.createDataFrame([], "doc_id long, toxic int")).first()["score"] == 0.0
    assert toxicity.score(docs.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).count() == 0


def test_token_histogram(spark):
    r = random.Random(2)
    encode = token_lengths.encoding(token_lengths.tokenizer_file()).encode_ordinary
    rows = [(prose(r, r.randint(0, 40)), r.choice(["a", "b", None])) for _ in range(120)] + [(None, "a"), ("", "a"), ("<|endoftext|> é\n\n x", "b"), ("y" * 9000, "b"), (" " * 9000, None)]
    n = [(g, 0 if not t else sum(len(encode(p)) for p in token_lengths.pieces(t))) for t, g in rows]
    found = token_lengths.histogram(spark.createDataFrame([(t, g, 1) for t, g in rows], "text string, source string, tokens int"), ("source",))
    held = found.collect()
    assert {(x["source"], x["n_tokens"]) for x in held} == set(n)
    for x in held:
        own = [k for g, k in n if g == x["source"]]
        assert x["documents"] == own.count(x["n_tokens"]) and x["documents_from"] == sum(k >= x["n_tokens"] for k in own)
        assert x["tokens_from"] == sum(k for k in own if k >= x["n_tokens"]) and x["truncated_total"] == sum(min(k, x["n_tokens"]) for k in own)
    every = token_lengths.histogram(spark.createDataFrame([(t,) for t, _ in rows], "text string"))
    lengths = sorted(k for _, k in n)
    for x in token_lengths.at_limits(every, [1, 16, 100]).collect():
        assert x["truncated_tokens"] == sum(min(k, x["limit"]) for k in lengths) and x["documents_over"] == sum(k > x["limit"] for k in lengths)
    for x in token_lengths.quantiles(every, [0.1, 0.5, 1.0]).collect():
        assert x["n_tokens"] == lengths[math.ceil(x["share"] * len(lengths)) - 1]
    assert token_lengths.histogram(spark.createDataFrame([], "text string")).count() == 0


def test_short_texts_are_encoded_whole():
    encode = token_lengths.encoding(token_lengths.tokenizer_file()).encode_ordinary
    text = prose(random.Random(3), 300)
    assert token_lengths.token_length(encode, text) == len(encode(text))


def test_long_texts_have_the_length_of_the_whole(spark):
    own = token_lengths.encoding(token_lengths.tokenizer_file())
    r = random.Random(6)
    dense = ["".join(r.choice("abcdefgh" + more) for _ in range(21_000)) for more in ("", ".,;", "0123", "é—中") for _ in range(4)]
    gap = lambda: "".join(r.choice(" \t\n\xa0\u3000\x0b\x85") for _ in range(r.choice([4095, 4096, 4097, 4098, 9000])))
    blank = [r.choice(["", "a", "word.", "\x1c"]) + gap() + r.choice(["", "b", " 1", ".", "'s", "\x1d" * 5000]) + r.choice(["", gap() + "z"]) for _ in range(40)]
    blank += [" " * 4098, "x" + " " * 4097 + "y", "x" + "\n" * 4097 + "y", "x" + " " * 5000 + "\n" + "y"]
    texts = dense + blank
    whole = [len(own.encode_ordinary(t)) for t in texts]
    assert [token_lengths.token_length(own.encode_ordinary, t, own._encode_single_piece) for t in texts] == whole
    found = token_lengths.histogram(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert {x["n_tokens"]: x["documents"] for x in found} == dict(Counter(whole))
    # the pattern's engine fails on so long a run
    assert token_lengths.token_length(own.encode_ordinary, "a" + " " * 3_000_000 + "b", own._encode_single_piece) == 1 + len(own._encode_single_piece(" " * 2_999_999)) + len(own.encode_ordinary(" b"))


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


@pytest.mark.parametrize("heavy", [200_000, 5])
def test_base_score_and_known_tokens(spark, heavy):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["The", "of", "a", "é", "Zebra", f"w{r.randrange(40)}"]) for _ in range(r.randint(0, 30)))) for i in range(150)] + [(500, None), (501, ""), (None, "of the"), (7, "of rare of"), (502, "the " * 20_000)]
    found = bitmix.score(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, score int"), heavy=heavy).collect()
    key = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10
    counts = Counter(w for i, t in rows if key(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    expected = sorted((repr(i), key(i) == 0, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 4)) for i, t in rows)
    got = sorted((repr(x["doc_id"]), x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"], round(x["base_score"], 4)) for x in found)
    assert [g[:5] for g in got] == [e[:5] for e in expected]
    assert [g[5] for g in got] == pytest.approx([e[5] for e in expected], abs=2e-4)
    assert all(x["score"] < 0 for x in found)


def slots(g, n):
    """Slots of all grams, as one task sees them, and the code."""
    pair, byte = (g & np.uint64(0xFFFF)).astype(int), (g & np.uint64(255)).astype(int)
    code = bitmix.Code(np.bincount(byte, n, 256).astype(np.int64))
    last = np.zeros((256, 512, 2))
    for k, b, c in zip(pair >> 8, byte, n, strict=True):
        for d in range(code.length[b]):
            last[k, code.node[d][b], code.bit[d][b]] += c
    return bitmix.Slots(g, n, code, last), code


def contexts(text, i):
    """Brute force: the contexts of byte i of a text, in the order of CONTEXTS."""
    before = bitmix.BEFORE + text[:i]
    at = before.rindex(b" ")
    return [*(before[-k:] for k in range(1, 6)), before[-max(2, min(7, len(before) - at)) :]]


def brute_counts(pieces, code):
    counts = Counter()
    for p in pieces:
        for i, b in enumerate(p):
            for k, c in enumerate(contexts(p, i)):
                for d in range(code.length[b]):
                    counts[k, c, code.node[d][b], code.bit[d][b]] += 1
    return counts


def brute_log(text, counts, code, weights, refined):
    total = 0.0
    for i, b in enumerate(text):
        own, root = contexts(text, i), code.node[0][0]
        seen = [counts[k, c, root, 0] + counts[k, c, root, 1] for k, c in enumerate(own)]
        level = [sum(s >= x for x in bitmix.SEEN) for s in seen]
        gate = max([3 * k + x for k, x in enumerate(level[:-1]) if x], default=0) * 4 + level[-1]
        for d in range(code.length[b]):
            node, bit = code.node[d][b], code.bit[d][b]
            z = 0.0
            for k, c in enumerate(own):
                x = math.log((counts[k, c, node, 1] + bitmix.PRIOR) / (counts[k, c, node, 0] + bitmix.PRIOR))
                z += weights[gate, k] * min(bitmix.LIMIT, max(-bitmix.LIMIT, x))
            at = (min(bitmix.LIMIT, max(-bitmix.LIMIT, z)) + bitmix.LIMIT) * (bitmix.BUCKETS - 1) / (2 * bitmix.LIMIT)
            low = min(int(at), bitmix.BUCKETS - 2)
            own_map = refined[gate * bitmix.BUCKETS + low : gate * bitmix.BUCKETS + low + 2]
            p = 0.5 / (1 + math.exp(-z)) + 0.5 * (own_map[0] * (1 - at + low) + own_map[1] * (at - low))
            total += math.log10(p if bit else 1 - p)
    return total


def test_bits_are_a_probability_and_learn():
    r = random.Random(5)
    train = [f"the cat sat on {r.choice(['the mat', 'a hat'])}\n".encode() for _ in range(400)]
    g, n = np.unique(bitmix.grams(train)[0], return_counts=True)
    s, code = slots(g, n)
    learner = bitmix.Learner()
    learner.learn(*bitmix.training_bits(s))
    w = learner.weights
    z = np.linspace(-bitmix.LIMIT, bitmix.LIMIT, bitmix.BUCKETS)
    refined = np.tile(1 / (1 + np.exp(-z)), bitmix.GATES)

    def logs(more):  # the counts of the training grams, asked for others too
        every = np.unique(np.concatenate([g, more]))
        own = dict(zip(g.tolist(), n.tolist(), strict=True))
        found = bitmix.Slots(every, np.array([own.get(x, 0) for x in every.tolist()]), code, s.last)
        return dict(zip(every.tolist(), bitmix.log_probabilities(found, w, refined).tolist(), strict=True))

    # over all 256 next bytes of a context the probabilities add up to one
    last = bitmix.grams([b"the c?"])[0][-1]
    every = (last & ~np.uint64(255)) | np.arange(256, dtype=np.uint64)
    held = logs(every)
    assert sum(math.exp(held[x]) for x in every.tolist()) == pytest.approx(1.0, abs=1e-4)

    def bits(text):
        own = bitmix.grams([text])[0]
        held = logs(own)
        return -sum(held[x] for x in own.tolist()) / math.log(2) / len(text)

    assert bits(b"the cat sat on a hat\n") < 1.0 < 4.0 < bits(b"qzx vkw jjq 93 zzz\n")


@pytest.mark.parametrize(("heavy", "tasks"), [(1 << 20, 1 << 20), (50, 200), (0, 37)])
def test_score_equals_plain_sums(spark, monkeypatch, heavy, tasks):
    monkeypatch.setattr(bitmix, "TASK_GRAMS", tasks)
    r = random.Random(8)
    vocabulary = [prose(r, 1).strip(".") for _ in range(12)] + ["a", "Extraordinarily", "é"]
    rows = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 12)))) for i in range(60)] + [(500, None), (None, "a a"), (7, "zq"), (7, "zq")]
    key = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    learned = []
    kept = bitmix.mixing
    monkeypatch.setattr(bitmix, "mixing", lambda *x: learned.append(kept(*x)) or learned[-1])
    found = bitmix.score(docs, heavy_grams=heavy).collect()
    train = bitmix.pieces_of([t for i, t in rows if key(i)])
    code = bitmix.Code(np.bincount(np.frombuffer(b"".join(train), np.uint8), minlength=256))
    counts = brute_counts(train, code)
    expected = sorted((repr(i), round(brute_log(bitmix.pieces_of([t])[0], counts, code, *learned[0]), 3)) for i, t in rows)
    got = sorted((repr(x["doc_id"]), round(x["score"], 3)) for x in found)
    assert [x[0] for x in got] == [x[0] for x in expected]
    assert [x[1] for x in got] == pytest.approx([x[1] for x in expected], abs=3e-3)


def test_learning_leaves_the_occurrence_itself_out_and_takes_every_one():
    r = random.Random(7)
    texts = [prose(r, 20) for _ in range(10)] * 2
    pieces = bitmix.pieces_of(texts)
    g, n = np.unique(bitmix.grams(pieces)[0], return_counts=True)
    s, code = slots(g, n)
    gate, x, bit, m = bitmix.training_bits(s)
    assert m.sum() == sum(code.length[b] for p in pieces for b in p)
    counts, expected = brute_counts(pieces, code), Counter()
    for p in pieces:
        for i, b in enumerate(p):
            for d in range(code.length[b]):
                logits = []
                for k, c in enumerate(contexts(p, i)):
                    one, zero = (counts[k, c, code.node[d][b], v] - (code.bit[d][b] == v) for v in (1, 0))
                    logits.append(round(min(8, max(-8, math.log((one + 0.1) / (zero + 0.1)))), 2))
                expected[(*logits, int(code.bit[d][b]))] += 1
    got = Counter()
    for row, v, w in zip(x.T.tolist(), bit.tolist(), m.tolist(), strict=True):
        got[(*[round(y, 2) + 0.0 for y in row], v)] += w
    assert got == {k: v for k, v in expected.items()}
    # online steps from equal weights end below their loss
    learner = bitmix.Learner()
    loss = lambda w: -(m * np.log(np.where(bit == 1, p := 1 / (1 + np.exp(-(w[gate].T * x).sum(0))), 1 - p))).sum()
    before = loss(learner.weights)
    learner.learn(gate, x, bit, m)
    assert loss(learner.weights) < before


def test_counts_above_32_bits_keep_their_ratio():
    g = bitmix.grams([b"ab", b"ac"])[0]
    big = {g[1]: 12_000_000_000, g[3]: 3_000_000_000}
    u = np.unique(g)
    s, code = slots(u, np.array([big.get(x, 1) for x in u]))
    assert max(c.max() for c in s.seen) >= 15_000_000_000
    at = int(np.flatnonzero(s.g == g[1])[0])
    for k in range(1, bitmix.K):
        zeros, ones = next((z, o) for d in range(int(code.length[ord("b")])) for z, o in [s.counts(k, d, s.active[d])] if z[at] and o[at])
        assert sorted([zeros[at], ones[at]]) == [3_000_000_000, 12_000_000_000]


def test_grams_do_not_cross_texts_and_starts_match():
    g, starts = bitmix.grams([b"ab\n", b"\n", b"abc\n"])
    assert list(starts) == [0, 3, 4] and len(g) == 8
    assert int(g[3]) & 0xFFFF == 0x2000 | ord("\n") and g[0] == g[4] and g[1] == g[5]
    # the current word counts up to seven bytes, else five
    held = bitmix.grams([b"wonderful day\n"])[0]
    assert [int(held[i]).to_bytes(8, "big") for i in (6, 7, 8)] == [b" wonderf", b"wonderfu", b"onderful"]
    assert int(held[11]).to_bytes(8, "big") == b"\0\0ful da"


def test_lookup_finds_listed_grams_and_names_others():
    r = np.random.default_rng(1)
    g = np.unique(r.integers(1, 1 << 62, 5000).astype(np.uint64))
    p = -r.random(len(g))
    own = bitmix.Lookup([(g[:900].tobytes(), p[:900].tobytes()), (g[900:4000].tobytes(), p[900:4000].tobytes())])
    found, miss = own.find(g)
    assert miss.tolist() == list(range(4000, len(g)))
    assert found[:4000] == pytest.approx(p[:4000]) and not found[4000:].any()
    assert bitmix.Lookup([]).find(g[:3])[1].tolist() == [0, 1, 2]


def test_language_model_edges(spark):
    assert bitmix.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    x = bitmix.score(spark.createDataFrame([(held, "only held out")], "doc_id long, text string")).first()
    assert x["train_tokens"] == x["n_known"] == 0 and x["base_score"] == 0.0 and x["score"] < 0


def test_the_fit_is_a_minimum_of_the_likelihood():
    """No single change of a weight, the bias or the leak makes the documents' labels (with the pull towards the words' own odds) much likelier."""
    r = random.Random(17)
    plain, bad = [f"word{k}" for k in range(30)], ["awful", "vile", "nasty"]
    texts, labels = [], []
    for k in range(200):
        toxic = k % 3 == 0
        body = [" ".join(r.choice(plain) for _ in range(5)) for _ in range(4)]
        if toxic:
            body[r.randrange(4)] += f" {r.choice(bad)} {r.choice(bad)}"
        elif r.random() < 0.1:
            body[0] += f" {r.choice(bad)}"
        texts.append(". ".join(body))
        labels.append(int(toxic))
    model = toxicity.fit(texts, labels)
    assert {b"awful", b"vile", b"nasty"} <= set(model.words)
    features = lambda s: {*s, *(w[: toxicity.STEM] + b"*" for w in s)}
    names = [*model.words, *(s + b"*" for s in model.stems)]
    rate = sum(labels) / len(labels)
    held = [{f for s in toxicity.sentences(t) for f in features(s)} for t in texts]

    def odds(name):
        k, n = sum(y for h, y in zip(held, labels, strict=True) if name in h), sum(name in h for h in held)
        return math.log((k + 0.5) / (n - k + 0.5)) - math.log(rate / (1 - rate))

    prior = {n: odds(n) for n in names}

    def loss(weights, bias, leak):
        total = 0.0
        for text, y in zip(texts, labels, strict=True):
            safe = 1 - leak
            for s in toxicity.sentences(text):
                safe *= 1 - 1 / (1 + math.exp(-(bias + sum(weights.get(f, 0.0) for f in features(s)))))
            total -= math.log(max(1 - safe, 1e-9)) if y else math.log(max(safe, 1e-300))
        return total / len(texts) + toxicity.L2 / 2 * sum((weights[n] - prior[n]) ** 2 for n in names)

    weights = {n: (model.stems[n[:-1]] if n.endswith(b"*") else model.words[n]) for n in names}
    least = loss(weights, model.bias, model.leak)
    for step in (0.2, -0.2):
        assert loss(weights, model.bias + step, model.leak) > least - 1e-3
        assert loss(weights, model.bias, model.leak * (1 + step)) > least - 1e-3
        for n in names:
            assert loss(weights | {n: weights[n] + step}, model.bias, model.leak) > least - 1e-3
    assert loss(prior, model.bias, model.leak) > least and loss({n: 0.0 for n in names}, -3.0, 0.02) > least + 0.05
