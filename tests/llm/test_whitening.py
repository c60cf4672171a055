import math
import random

import numpy as np

from lacuna.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, id int, v string"


def brute(vectors, most=32):
    """n, eigenvalues, deviations by row, whitened rows (signs left open), explained shares."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[k] for r in x) for k in range(d)]
    off = [[n * r[k] - sums[k] for k in range(d)] for r in x]
    centred = np.array(off, float) / n
    cov = centred.T @ centred / n
    values, directions = np.linalg.eigh(cov)
    kept = [k for k in np.argsort(values)[::-1] if values[k] > 1e-12 * values.max()][:most]
    return n, [sum(c * c for c in r) for r in off], centred @ directions[:, kept] / np.sqrt(values[kept]), values[kept] / np.trace(cov)


def compare(spark, rows, good, monkeypatch=None):
    got = {}
    for r in whitening.whiten(spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA).repartition(4)).collect():
        got.setdefault(r["vec_id"], []).append(r)
    n, deviations, w, shares = brute([v for _, v in good])
    assert set(got) == {i for i, _ in good}
    sign = None
    for (i, _), dev, row in zip(good, deviations, w, strict=True):
        mine = sorted(got[i], key=lambda r: r["component"])
        assert [r["component"] for r in mine] == list(range(1, len(shares) + 1))
        assert {r["deviation"] for r in mine} == {dev} and {r["n"] for r in mine} == {n}
        found = np.array([r["whitened"] for r in mine])
        if sign is None:
            sign = np.ones(len(found))
        unset = (sign == 1) & (np.abs(row) > 1e-3)
        sign = np.where(unset, np.sign(found * row), sign)
        assert np.allclose(found * sign, row, atol=1e-6)
        assert np.allclose([r["explained"] for r in mine], shares, rtol=1e-6) and max(r["identity_error"] for r in mine) < 1e-9


def test_whitening_equals_numpy(spark, monkeypatch):
    monkeypatch.setattr(whitening, "LEAST_ROWS", 16)
    r = np.random.default_rng(5)
    mix = r.normal(size=(40, 40)) * np.linspace(0.2, 2, 40)
    good = [(k, v.tolist()) for k, v in enumerate((r.normal(size=(300, 40)) @ mix).astype(np.float32))]
    bad = [(900, None), (901, [None, *good[0][1][1:]]), (902, [math.nan, *good[0][1][1:]]), (903, [math.inf, *good[0][1][1:]]), (904, good[0][1][:7]), (905, []), (906, [-math.inf] * 40)]
    compare(spark, good + bad, good)


def test_columns_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_COLUMNS", 4)
    monkeypatch.setattr(whitening, "LEAST_ROWS", 8)
    r = np.random.default_rng(6)
    rows = [(k, (r.normal(size=10) * np.arange(1, 11) * 3).astype(np.float32).tolist()) for k in range(90)]
    compare(spark, rows, rows)


def test_flat_directions_and_repeats(spark):
    r = random.Random(2)
    base = [[r.gauss(0, 3) for _ in range(3)] for _ in range(30)]
    rows = [(k, [*v, 1.5, 2 * 0.0]) for k, v in enumerate(base)]
    out = whitening.whiten(spark.createDataFrame([(i, v, 1, "x") for i, v in [*rows, (None, rows[0][1]), (3, rows[3][1])]], SCHEMA)).collect()
    assert len(out) == 32 * 3 and {x["n"] for x in out} == {32} and sum(x["vec_id"] is None for x in out) == 3
    assert abs(sum(x["explained"] for x in out if x["vec_id"] == 1) - 1) < 1e-12


def test_tables_without_variance(spark):
    for rows in ([], [(1, None)], [(1, [0.5, 1.0])], [(k, [1.0, 2.0]) for k in range(5)]):
        assert whitening.whiten(spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)).collect() == []


def test_deviations_beyond_64_bits_of_a_product(spark):
    far = [[float(1 << 40), 0.0], [0.0, 1.0], [5.0, 2.0]]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(far)], "vec_id long, embedding array<double>")
    out = whitening.whiten(rows).select("vec_id", "deviation").distinct().collect()
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in far]
    sums = [sum(c) for c in zip(*x, strict=True)]
    exact = {k: sum((3 * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for k, v in enumerate(x)}
    assert {r["vec_id"]: r["deviation"] for r in out} == {k: v if v < 1 << 63 else None for k, v in exact.items()}
