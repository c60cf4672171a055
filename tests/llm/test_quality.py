import random
import re

import pytest

from lacuna.llm import quality


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {}
    for k in range(len(w) - 4):
        at.setdefault(tuple(w[k : k + 5]), []).append(k)
    repeat = {q for v in at.values() if len(v) > 1 for k in v for q in range(k, k + 5)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat))


TEXTS = [None, "", " \t\n", "one", "a b c d e a b c d e", "x " * 30, "l\nl\n \nl", "é ü ß x\x85y", "# * $ % & | < >", "a\x0bb\x0cc\rd", "w1 w2 w3 w4 w5 w6 " * 3, "long " * 60_000]


@pytest.mark.parametrize("text", TEXTS)
def test_counts(text):
    assert quality.statistics(text)[:5] == brute(text)


def test_counts_of_random_texts():
    r = random.Random(1)
    for _ in range(200):
        text = "".join(r.choice("ab é\n\t#") for _ in range(r.randint(0, 120)))
        assert quality.statistics(text)[:5] == brute(text)


def corpus():
    r = random.Random(2)
    clean = lambda: " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(r.randint(15, 80))) + "."
    rows = [(i, clean(), r.choice(["en", "de"]), r.choice(["s1", "s2"])) for i in range(400)]
    junk = [(1000 + i, " ".join(f"{w}%%%" for w in clean().split()), "en", "s1") for i in range(20)]
    edge = [(2000, None, None, None), (2001, "", "en", "s1"), (2002, clean(), None, "s1"), (2003, clean(), "fr", "rare"), (5, clean(), "en", "s1")]
    return rows, junk, edge


def test_keeps_clean_and_rejects_junk(spark):
    rows, junk, edge = corpus()
    docs = spark.createDataFrame([(*r, "x") for r in rows + junk + edge], "doc_id long, text string, lang string, source string, kept string")
    found = quality.rate(docs).collect()
    assert len(found) == len(rows) + len(junk) + len(edge)
    kept = {r["doc_id"]: r["kept"] for r in found}
    assert all(kept[i] for i, *_ in rows) and not any(kept[i] for i, *_ in junk)
    assert not kept[2000] and not kept[2001] and kept[2002] and kept[2003]


def test_each_kind_of_junk_is_rejected(spark):
    r = random.Random(3)
    word = lambda letters="etaoinshrdlu": "".join(r.choice(letters) for _ in range(r.randint(2, 9)))
    line = lambda n, *how: " ".join(word(*how) for _ in range(n))
    passage = line(10)
    kinds = {
        "lines": "\n".join(f"{line(8)}\nthe same end" for _ in range(20)), "digits": line(60, "0123456789"), "capitals": line(60).upper(),
        "marks": " ".join(f"{word()}!" for _ in range(60)), "symbols": " ".join(f"{word()}%" for _ in range(60)), "repeats": f"{passage} {line(40)} {passage} {line(40)}",
        "long words": " ".join(word() + word() + word() for _ in range(60)),
    }
    junk = [(3000 + i, text, "en", "s1") for i, text in enumerate(kinds.values())]
    assert not any(c[0] < 10 or 100 * c[4] > 20 * c[0] for c in (quality.statistics(t) for t in kinds.values()))
    rows = corpus()[0]
    kept = {x["doc_id"]: x["kept"] for x in quality.rate(spark.createDataFrame(rows + junk, "doc_id long, text string, lang string, source string")).collect()}
    assert {k: kept[3000 + i] for i, k in enumerate(kinds)} == dict.fromkeys(kinds, False)
    assert all(kept[i] for i, *_ in rows)


def test_cut_is_a_quantile_that_each_statistic_can_reach():
    import numpy as np

    draws = np.random.default_rng(1).chisquare(quality.D, 400_000)
    assert quality.chi_square(9.0, quality.D) == pytest.approx((draws <= 9.0).mean(), abs=0.004)
    assert quality.chi_square(quality.CUT, quality.D) == pytest.approx(1 - quality.BEYOND)
    assert quality.chi_square_quantile(0.95, 7) == pytest.approx(14.067, abs=1e-3) and quality.chi_square_quantile(0.95, 2) == pytest.approx(5.991, abs=1e-3)
    most = {"repeat_share": quality.REPEAT_PERCENT / 100}
    assert all(most.get(v, 1.0) / f**2 > quality.CUT for v, f in zip(quality.VECTOR, quality.FLOOR, strict=True))


def test_estimate_is_near_that_of_the_clean_rows(spark):
    import numpy as np

    r = np.random.default_rng(0)
    n, bad = 1500, 200
    x = r.normal(size=(n, quality.D)) * 0.3
    x[:bad] += 5
    rows = spark.createDataFrame([("g", *map(float, v)) for v in x], "group string, " + ", ".join(f"x{i} double" for i in range(quality.D)))
    found = quality.estimates(rows).first()
    assert np.abs(np.array(found["mean"]) - x[bad:].mean(0)).max() < 0.06


def vectors(spark, rows):
    """Statistics as ``fitted`` and ``judged`` take them: (id, group, vector)."""
    names = ", ".join([*(f"{c}: long" for c in quality.COUNTS), *(f"{c}: double" for c in quality.VECTOR)])
    return spark.createDataFrame([(i, g, (100, 500, 0, 0, 0, *map(float, v))) for i, g, v in rows], f"doc_id long, group string, s struct<{names}>")


def test_the_estimate_decides(spark):
    """Normal rows with spread and correlations: distances are those of NumPy and follow the chi-square law; what breaks the correlations is rejected inside every single limit."""
    import numpy as np

    r = np.random.default_rng(7)
    mix = np.linalg.cholesky(0.9 * np.ones((quality.D,) * 2) + 0.1 * np.eye(quality.D))  # spread far wider than the floors
    x = r.normal(size=(4000, quality.D)) @ mix.T
    odd = np.tile([1.5, -1.5], quality.D)[: quality.D]  # 1.5 deviations in each statistic, but of opposite signs
    stats = vectors(spark, [*((i, "g", v) for i, v in enumerate(x)), (9000, "g", odd)])
    shapes = quality.fitted(stats)
    found = {q["doc_id"]: q for q in quality.judged(stats, shapes).collect()}
    shape = {q["group"]: q for q in shapes.collect()}["g"]
    off = x - np.array(shape["mean"])
    plain = np.einsum("ij,jk,ik->i", off, np.array(shape["inverse"]).reshape(quality.D, -1), off)
    assert [found[i]["distance"] for i in range(4000)] == pytest.approx(plain) and all(found[i]["kept"] == (plain[i] <= quality.CUT) for i in range(4000))
    law = quality.chi_square_quantile(0.5, quality.D)
    assert abs(np.median(plain) / law - 1) < 0.12 and (plain > quality.CUT).mean() < 20 * quality.BEYOND
    assert not found[9000]["kept"] and (np.abs(odd) < np.abs(x).max(0)).all()
    # without the estimate, by the floors alone, nearly all rows would go
    assert ((x / quality.FLOOR) ** 2).sum(1).min() > quality.CUT or (((x / quality.FLOOR) ** 2).sum(1) > quality.CUT).mean() > 0.9


def test_groups_have_limits_of_their_own(spark):
    """What is ordinary in one group is rejected in another."""
    import numpy as np

    r = np.random.default_rng(8)
    ordinary = {"a": 1.4, "b": 1.9}
    rows = [(k + 2000 * n, g, [m + r.normal(0, 0.03), *r.normal(0.2, 0.012, 3), *[0.0] * 5]) for n, (g, m) in enumerate(ordinary.items()) for k in range(1500)]
    rows += [(8000, "a", [1.9, 0.2, 0.2, 0.2, *[0.0] * 5]), (8001, "b", [1.4, 0.2, 0.2, 0.2, *[0.0] * 5])]
    stats = vectors(spark, rows)
    kept = {q["doc_id"]: q["kept"] for q in quality.judged(stats, quality.fitted(stats)).collect()}
    assert not kept[8000] and not kept[8001] and sum(kept.values()) >= 2995


def test_groups_of_any_size_are_drawn_to_all():
    import numpy as np

    r = np.random.default_rng(4)
    a, b = (r.normal(size=(50, quality.D)) @ np.diag(np.arange(1, quality.D + 1)) for _ in range(2))
    shape = lambda x: (x.mean(0)[None], np.linalg.inv(np.cov(x.T, bias=True)).reshape(1, -1))
    # of as many documents as the prior has, the result is that of both together
    mean, inverse = quality.drawn(*shape(a), *shape(b), np.array([50.0]), 50)
    both = np.concatenate([a, b])
    assert mean[0] == pytest.approx(both.mean(0)) and np.linalg.inv(inverse.reshape(quality.D, -1)) == pytest.approx(np.cov(both.T, bias=True))
    mean, inverse = quality.drawn(*shape(a), *shape(b), np.array([1e9]), 40)
    assert mean[0] == pytest.approx(a.mean(0), abs=1e-5) and inverse[0] == pytest.approx(shape(a)[1][0], rel=1e-3)


def test_small_groups_reject_junk_too(spark):
    rows, junk, _ = corpus()
    few = [(5000 + i, t, "xx", f"few {i % 3}") for i, (_, t, _, _) in enumerate(rows[:9])] + [(6000 + i, t, "xx", f"few {i}") for i, (_, t, _, _) in enumerate(junk[:3])]
    kept = {x["doc_id"]: x["kept"] for x in quality.rate(spark.createDataFrame(rows + few, "doc_id long, text string, lang string, source string")).collect()}
    assert all(kept[5000 + i] for i in range(9)) and not any(kept[6000 + i] for i in range(3))


def test_empty_table(spark):
    assert quality.rate(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0
