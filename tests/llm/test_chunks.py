import random

import numpy as np
import xxhash

from lacuna.llm import chunks


def prose(r, n):
    return " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(n))


def test_cuts_are_where_the_gear_hash_is_smallest():
    r, gear = random.Random(1), chunks.gear_table()
    for n in (0, 1, 40, 57, 300, 2000):
        data = np.frombuffer(bytes(r.choice(b"abcdef ") for _ in range(n)), np.uint8)
        if not n:
            continue
        h = [sum(int(gear[data[i - k]]) << k for k in range(16)) % 65536 for i in range(15, n)]
        expected = [i + 16 for i in range(20, len(h) - 20) if all(h[i] < h[i - k] for k in range(1, 21)) and all(h[i] <= h[i + k] for k in range(1, 21))]
        got = [int(e) for e in chunks.cuts(data, gear)]
        assert got[-1] == n and [e for e in got if e != n] == [e for e in expected if e != n]


def test_insertions_move_no_later_cut():
    r, gear = random.Random(2), chunks.gear_table()
    a = prose(r, 300).encode()
    b = b"inserted words " + a
    ends = lambda x: {len(x) - int(e) for e in chunks.cuts(np.frombuffer(x, np.uint8), gear)}
    assert len(ends(a) - ends(b)) <= 2


def test_planted_passages_are_found_and_clean_documents_left(spark):
    r = random.Random(3)
    passages = [prose(r, 55) for _ in range(25)]
    rows = [(i, prose(r, r.randint(5, 300))) for i in range(150)]
    planted = set()
    for p in passages:
        for _ in range(3):
            i = r.randrange(150)
            planted.add(i)
            t = rows[i][1].split()
            at = r.randrange(len(t) + 1)
            rows[i] = (i, " ".join([*t[:at], p, *t[at:]]))
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start int")
    found = {x["doc_id"] for x in chunks.repeated(docs).collect()}
    assert found == planted


def brute(rows, within=False):
    """The result's rows from whole texts, place by place."""
    gear, places, known = chunks.gear_table(), [], {}
    for i, text in rows:
        raw = (text or "").encode()
        if not raw:
            continue
        ends = [int(e) for e in chunks.cuts(np.frombuffer(raw, np.uint8), gear)]
        starts = [0, *ends[:-1]]
        for a, z in zip(starts, ends[1:], strict=False) if len(ends) > 1 else [(0, ends[0])]:
            doc = ("id", i) if i is not None else ("text", text)
            places.append((doc, text, a, z))
            known.setdefault(raw[a:z], []).append(doc)
    out = []
    for doc, text in dict.fromkeys((d, t) for d, t, *_ in places):
        raw, own = text.encode(), []
        for a, z in sorted({(a, z) for d, t, a, z in places if (d, t) == (doc, text)}):
            held = known[raw[a:z]]
            if len(set(held)) > 1 or within and len(held) > 1:
                first = min(held, key=lambda x: (0, x[1]) if x[0] == "id" else (1, hashed(x[1], any(isinstance(i, str) for i, _ in rows))))
                if own and a <= own[-1][1]:
                    own[-1] = [own[-1][0], max(z, own[-1][1]), own[-1][2], max(own[-1][3], len(held))]
                else:
                    own.append([a, z, first, len(held)])
        back = lambda x: x[1] if x[0] == "id" else None
        out += [(back(doc), a, z, z - a, back(first), n, doc == first) for a, z, first, n in own if z - a >= chunks.LEAST_BYTES]
    return sorted(out, key=repr)


def hashed(text, as_text):
    """The stand-in of a text without an id."""
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return f"{h:X}" if as_text else h - (h >> 63 << 64)


def test_rows_equal_brute_force(spark):
    r = random.Random(11)
    passages = [prose(r, 40) for _ in range(6)]
    rows = [(i, " ".join([prose(r, 20), r.choice(passages), prose(r, 10), r.choice(passages)])) for i in range(30)]
    rows += [rows[3], (3, rows[9][1]), (3, prose(r, 60)), (None, rows[5][1]), (None, f"{passages[0]} {prose(r, 30)}"), (50, None), (51, "")]
    big = (1 << 62) + 5  # ids as large as any, and one that equals the stand-in of a text without one
    rows += [(big, rows[2][1]), (big + 4, rows[2][1]), ((1 << 63) - 1, rows[4][1]), (hashed(rows[5][1], False), rows[7][1])]
    lost = prose(r, 50)
    rows += [(None, f"{lost} {prose(r, 8)}"), (None, f"{prose(r, 8)} {lost}")]
    for within in (False, True):
        for kind in (int, str):
            own = [(i if i is None else kind(i), t) for i, t in rows]
            docs = spark.createDataFrame([(i, t, 1) for i, t in own], f"doc_id {'long' if kind is int else 'string'}, text string, start int")
            # a row that repeats id and text is the same place again: it has the same passages
            assert sorted(set(map(tuple, chunks.repeated(docs, within=within).collect())), key=repr) == brute(own, within)


def test_edges(spark):
    r = random.Random(5)
    text = prose(r, 80)
    twice = f"{text} {prose(r, 40)} {text}"
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (4, twice), (None, text), (5, "a" * 40_000), (6, "a" * 40_000)], "doc_id long, text string")
    assert {x["doc_id"] for x in chunks.repeated(docs).collect()} == {None, 4, 5, 6}
    assert {x["doc_id"] for x in chunks.repeated(docs.where("doc_id is not null")).collect()} == {5, 6}
    assert {x["doc_id"] for x in chunks.repeated(docs.where("doc_id is not null"), within=True).collect()} == {4, 5, 6}
    assert chunks.repeated(docs.limit(0)).count() == 0
