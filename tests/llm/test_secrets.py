import hashlib
import re

import pytest

from lacuna.llm import secrets

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    text = text or ""
    found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [x[2] for x in sorted(found)]


TEXTS = [
    None, "", "nothing here", "ToKeN = 'abc'", "token = abcdef", "apikey:xxxxxx api_key=\"yyyyyy\" ſecret=abcdefg toKen=abcdefg",
    "AKIA" + "A" * 16 + " AKIAAKIASHORT AKIA" + "B" * 40, "é" * 5 + "0123456789abcdef01234567" + " password: hunter22 ",
    "login = someone and secret = s3cr3tvalue at https://db.example.com/x", "see https://plain.example.com only", "login = someone only",
    "key AKIA" + "C" * 16 + " with aB3" + "dE6" * 10, "x" * 50_000 + " passwd=longenough " + "deadbeef" * 4, "token = token = token = abcdefgh",
]


def test_base_and_links(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "repeated"), (None, "secret=abcdefgh", "null id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    found = secrets.scan(docs).collect()
    assert len(found) == len(rows)
    by = {r["doc_id"]: r for r in found}
    for i, text in enumerate(TEXTS):
        spans = base(text)
        assert by[i]["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest(), i
        assert set(spans) <= set(by[i]["spans"].split(",")) | {""}
        assert by[i]["n_assign"] == sum(s.startswith("assign") for s in spans)
    assert "login:" in by[8]["spans"] and "endpoint:" in by[8]["spans"]
    assert by[9]["spans"] == "" and by[10]["spans"] == ""
    assert "token:" in by[11]["spans"]
    assert by[None]["n_assign"] == 1


def test_empty_table(spark):
    assert secrets.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_weak_parts_outside_the_scope_are_not_linked(spark):
    far = "login = someone" + " word" * 200 + " secret = s3cr3tvalue"
    near = "login = someone word secret = s3cr3tvalue"
    found = {r["doc_id"]: r["n_linked"] for r in secrets.scan(spark.createDataFrame([(1, far), (2, near)], "doc_id long, text string")).collect()}
    assert found == {1: 0, 2: 1}


def brute_links(text, radius=200):
    """Weak parts by comparing every pair of spans."""
    strong, weak = secrets.parts(text)
    role = lambda p: secrets.ROLE[secrets.KINDS[p[0]]]
    out = []
    for p in weak:
        near = lambda q: q[1] <= p[2] + radius and q[2] >= p[1] - radius  # noqa: B023, E731
        held = {role(q) for q in strong if near(q)}
        every = {role(q) for q in strong + weak if near(q)}
        if len(every) == 3 or ("id" if role(p) == "secret" else "secret") in held:
            out.append(p)
    return sorted(out)


def test_long_parts_link_on_either_side(spark):
    import random

    r = random.Random(8)
    long = "eyJ" + "aB3" * 199
    pieces = [f"token={long}", f"AKIA{'Q7' * 200}", "client_id=abcd", "https://db.example.com/" + "p" * 500, "see s3://b/k", "aB3" + "dE6" * 150, "secret = s3cr3tvalue", "login: someone"]
    texts = [f"token={long}\nclient_id=abcd", f"client_id=abcd\ntoken={long}", f"token={long}{' ' * 200}client_id=abcd", f"token={long}{' ' * 201}client_id=abcd", f"client_id=abcd{' ' * 201}token={long}", f"AKIA{'Q7' * 200}\n{'aB3' * 100}"]
    texts += [" ".join(f"{r.choice(pieces)}{' ' * r.randint(1, 330)}" for _ in range(r.randint(1, 7))) for _ in range(150)]
    found = {x["doc_id"]: sorted((p["kind"], p["start"], p["stop"]) for p in x["linked"]) for x in secrets.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [len(found[i]) for i in range(6)] == [1, 1, 1, 0, 0, 1]
    assert found == {i: brute_links(t) for i, t in enumerate(texts)}


def test_credentials_equal_connected_parts(spark):
    import random

    r = random.Random(9)
    pieces = [f"AKIA{'Q7' * 12}", "client_id=abcd", "https://db.example.com/x", "secret = s3cr3tvalue", "login: someone", "0123456789abcdef01234567"]
    texts = [" ".join(f"{r.choice(pieces)}{' ' * r.choice([1, 150, 198, 199, 200, 201, 202, 400])}" for _ in range(r.randint(0, 7))) for _ in range(150)]
    rows = [*enumerate(texts), (0, texts[0]), (None, texts[5]), (7, texts[8]), (500, None)]
    found = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len(rows)

    def brute(spans):
        parts = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in spans.split(",") if x)]
        groups = [{i} for i in range(len(parts))]
        for i, p in enumerate(parts):
            for j, q in enumerate(parts[:i]):
                if q[1] - 200 <= p[2] and p[1] - 200 <= q[2]:
                    one, other = (next(g for g in groups if x in g) for x in (i, j))
                    if one is not other:
                        groups.remove(other)
                        one |= other
        kept = [sorted(g) for g in groups if len(roles := {secrets.ROLE[parts[i][0]] for i in g}) > 1 and "secret" in roles]
        return ",".join("+".join(":".join(map(str, parts[i])) for i in g) for g in sorted(kept))

    assert [x["credentials"] for x in found] == [brute(x["spans"]) for x in found]
    assert sum(x["credentials"] != "" for x in found) > 20


@pytest.mark.parametrize("text,listed,expected", [("ab token=xyz123 c", "assign:3:15", "ab [assign] c"), (None, "assign:0:1", None), ("plain", "", "plain"), ("0123456789", "assign:1:5,hex:3:7", "0[assign]789")])
def test_cut_out(text, listed, expected):
    import pandas as pd

    assert secrets.cut_out(pd.Series([text], dtype=object), pd.Series([listed], dtype=object))[0] == expected
