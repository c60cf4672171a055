"""Regressions against plain NumPy."""

import math
import random

import numpy as np
import pytest

from lacuna.operators import models, outcomes


def frame(spark, n=160, seed=3):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        x, z, code = r.gauss(0, 1), r.choice([0.0, 1.0]), r.choice(["a", "b", None])
        y = int(r.random() < min(0.9, math.exp(-1.2 + 0.4 * x + 0.3 * z)))
        rows.append((i, i // 3, None if i % 17 == 0 else y, None if i % 13 == 0 else x, z, code))
    return spark.createDataFrame(rows, "case_id int, subject int, y int, x double, z double, code string"), rows


def newton(x, y):
    beta = np.zeros(x.shape[1])
    beta[0] = math.log(y.mean())
    for _ in range(60):
        mu = np.exp(x @ beta)
        beta += np.linalg.solve(x.T @ (x * mu[:, None]), x.T @ (y - mu))
    return beta


def test_poisson_estimates_errors_and_likelihood(spark):
    df, rows = frame(spark)
    kept = [r for r in rows if r[2] is not None and r[3] is not None]
    x, y, g = np.array([[1.0, r[3], r[4]] for r in kept]), np.array([float(r[2]) for r in kept]), np.array([r[1] for r in kept])
    beta = newton(x, y)
    mu = np.exp(x @ beta)
    bread = np.linalg.inv(x.T @ (x * mu[:, None]))
    scores = np.array([(x[g == c] * (y - mu)[g == c][:, None]).sum(0) for c in sorted(set(g))])
    m, n = len(scores), len(y)
    se = np.sqrt(np.diag(bread @ scores.T @ scores @ bread) * m / (m - 1) * (n - 1) / (n - 3))
    found = models.poisson_cluster(df, "y", ["x", "z"], "subject").collect()
    assert [r["term"] for r in found] == ["intercept", "x", "z"]
    assert [r["estimate"] for r in found] == pytest.approx(beta, abs=1e-6) and [r["se"] for r in found] == pytest.approx(se, rel=1e-5)
    likelihood = (y * np.log(mu) - mu).sum()
    assert found[0]["log_likelihood"] == pytest.approx(likelihood) and found[0]["aic"] == pytest.approx(6 - 2 * likelihood)
    assert all(r["converged"] and (r["n"], r["events"], r["clusters"], r["parameters"]) == (n, y.sum(), m, 3) for r in found)
    for r, b, s in zip(found, beta, se, strict=True):
        assert r["ratio"] == pytest.approx(math.exp(b)) and r["low"] == pytest.approx(math.exp(b - 1.959963984540054 * s)) and r["p"] == pytest.approx(math.erfc(abs(b / s) / math.sqrt(2)))


def test_models_without_rows_and_stability(spark):
    df, _ = frame(spark)
    specs = [models.Spec("all", "y", ("x",)), models.Spec("none", "y", ("x", "z"), "x > 1000"), models.Spec("coded", "y", ("x", "z"), "code is not null")]
    found = models.sequence_of_models(df, specs, "subject").collect()
    assert [(r["label"], r["term"]) for r in found] == [("all", "intercept"), ("all", "x"), *[("none", t) for t in ("intercept", "x", "z")], *[("coded", t) for t in ("intercept", "x", "z")]]
    none = [r for r in found if r["label"] == "none"]
    assert all(r["estimate"] is None and r["n"] == 0 and not r["converged"] for r in none)
    gate = spark.createDataFrame(found).where("term = 'x'").selectExpr("label", "converged", "ratio as estimate", "low", "high", "events", "parameters")
    assert {r["label"]: r["failed"] for r in outcomes.stability(gate).collect()} == {"all": "", "coded": "", "none": "converged,finite,positive,events,width"}


def logistic(x, y, w, ridge=1e-3):
    """Weighted logistic regression with a ridge on standardised terms, the first column being the intercept."""
    w = w / w.sum()
    mean = (w[:, None] * x).sum(0)
    sd = np.sqrt((w[:, None] * (x - mean) ** 2).sum(0) / (1 - (w * w).sum()))
    sd[0] = 0
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ beta))
        beta += np.linalg.solve(x.T @ (x * (w * p * (1 - p))[:, None]) + ridge * np.diag(sd**2), x.T @ (w * (y - p)) - ridge * sd**2 * beta)
    return beta


def test_out_of_fold_risks(spark):
    df, rows = frame(spark)
    found = {r["case_id"]: r for r in models.out_of_fold(df, "case_id", "y", ["x", "z"], ("code",)).collect()}
    kept = [r for r in rows if r[2] is not None]
    assert set(found) == {r[0] for r in kept} and {r["fold"] for r in found.values()} == set(range(5))
    for f in range(5):
        train = [r for r in kept if found[r[0]]["fold"] != f]
        middle = np.median([r[3] for r in train if r[3] is not None])
        line = lambda r: [1.0, middle if r[3] is None else r[3], r[4], float(r[5] == "b"), float(r[5] is None)]  # noqa: B023, E731
        y = np.array([float(r[2]) for r in train])
        beta = logistic(np.array([line(r) for r in train]), y, np.where(y > 0, 1 / y.sum(), 1 / (1 - y).sum()))
        for r in kept:
            if found[r[0]]["fold"] == f:
                assert found[r[0]]["risk"] == pytest.approx(1 / (1 + math.exp(-np.dot(line(r), beta))), abs=2e-3)


def test_transport_weights(spark):
    df, rows = frame(spark)
    found = {r["case_id"]: r["weight"] for r in models.transport_weights(df.where("case_id % 2 = 0"), df.where("case_id % 2 = 1"), "case_id", ["x", "z"], 0.2, 1.5).collect()}
    middle = np.median([r[3] for r in rows if r[3] is not None])
    x = np.array([[1.0, middle if r[3] is None else r[3], r[4]] for r in rows])
    y = np.array([float(r[0] % 2) for r in rows])
    odds = np.exp(x @ logistic(x, y, np.ones(len(y))))[::2]
    expected = np.clip(odds / np.median(odds), 0.2, 1.5)
    assert [found[i] for i in range(0, len(rows), 2)] == pytest.approx(expected, rel=5e-3)


def test_models_are_fitted_together(spark, monkeypatch):
    """Each model of a sequence has the numbers it has alone, and all of them take as many passes as the slowest, not as many as their steps together."""
    df, _ = frame(spark, 300, 11)
    specs = [models.Spec("a", "y", ("x",)), models.Spec("b", "y", ("x", "z"), "code = 'a'"), models.Spec("c", "y", ("z",), "case_id < 200"), models.Spec("flat", "y", ("x", "one"))]
    df = df.selectExpr("*", "1.0D as one").repartition(6)
    passes = []
    collect = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: passes.append(1) or collect(self))
    together = models.sequence_of_models(df, specs, "subject")
    used, alone = len(passes), []
    monkeypatch.undo()
    rows = {(r["label"], r["term"]): r for r in together.collect()}
    for s in specs[:3]:
        for r in models.poisson_cluster(df.where(s.rows), s.outcome, list(s.terms), "subject", s.label).collect():
            alone.append(r)
            assert all(a == b if a is None or isinstance(a, (str, bool, int)) else a == pytest.approx(b, rel=1e-7) for a, b in zip(r, rows[r["label"], r["term"]], strict=True))
    assert all(r["converged"] for r in alone) and used <= 12
    # a column that repeats the intercept shares its weight, and the other estimates are those without it
    assert rows["flat", "x"]["estimate"] == pytest.approx(rows["a", "x"]["estimate"], rel=1e-6)
