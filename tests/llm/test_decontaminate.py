import hashlib
import random
import re

from lacuna.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if got := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= got
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), len(hit) > 0))
    return sorted(out, key=repr)


def cases():
    r = random.Random(5)
    vocabulary = ["alpha", "Beta", "gamma", "dél", "eps", "z9"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(1, text(30)), (2, text(12)), (3, "Short, item!"), (4, None), (5, "..."), (20, text(10)), (6, "alpha alpha alpha alpha alpha alpha alpha alpha alpha alpha alpha")]
    docs = [(i, text(r.randint(0, 200))) for i in range(30)]
    docs += [(100, f"{text(20)} {items[0][1].upper()} {text(5)}"), (101, items[1][1].replace(" ", "... ")), (102, "a short item b"), (103, None), (104, ""), (105, "alpha " * 500), (100, "again"), (None, items[5][1])]
    return docs, items


def found(spark, docs, items, **how):
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_words int")
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, source string")
    return sorted([tuple(r)[:6] for r in decontaminate.contamination(d, b, **how).collect()], key=repr)


def test_equals_brute_force(spark):
    docs, items = cases()
    assert found(spark, docs, items) == brute(docs, items)


def test_items_without_an_id_are_searched(spark):
    docs, items = cases()
    held = " ".join(f"word{i}" for i in range(14))
    docs, items = [*docs, (200, f"before {held} after"), (201, items[0][1])], [*items, (None, held), (None, items[0][1]), (2**53 + 1, held)]
    rows = {x[0]: x for x in found(spark, docs, items)}
    assert rows[200][1:4] == (16, 14, 1) and rows[200][4] == hashlib.sha256(str(2**53 + 1).encode()).hexdigest()
    expected = {x[0]: x for x in brute(docs, items[:-3] + [(2**53 + 1, held)])}
    assert rows == expected
    rows = {x[0]: x for x in found(spark, docs, items[:-1])}
    assert rows[200] == (200, 16, 14, 0, hashlib.sha256(b"").hexdigest(), True)


def test_blocks_give_the_same(spark):
    docs, items = cases()
    assert found(spark, docs, items, block_units=7) == brute(docs, items)


def test_partial_containment(spark):
    item = " ".join(f"w{i}" for i in range(40))
    changed = item.split()
    changed[3] = "other"
    rows = found(spark, [(1, " ".join(changed)), (2, " ".join(changed[:20]))], [(7, item)], window=None, containment=0.8)
    assert [r[5] for r in rows] == [True, False]


def test_empty_tables(spark):
    docs, items = cases()
    assert found(spark, [], items) == []
    assert all(not r[5] for r in found(spark, docs, []))


def test_ids_may_be_texts(spark):
    docs, items = cases()
    d = spark.createDataFrame([(f"d{i}", t) for i, t in docs], "doc_id string, text string")
    b = spark.createDataFrame([(None if i == 2 else f"item {i}", t) for i, t in items], "item_id string, text string")
    for block in (50_000, 20):
        rows = decontaminate.contamination(d, b, block_units=block).collect()
        expected = brute([(f"d{i}", t) for i, t in docs], [(f"item {i}", t) for i, t in items if i != 2])
        assert [x[:2] for x in sorted((tuple(r)[:6] for r in rows), key=repr)] == [x[:2] for x in expected]
        assert {r["doc_id"]: r["items"] for r in rows}["d101"] in ([], ["item 1"], ["item 3"]) and all(isinstance(i, str) for r in rows for i in r["items"])
