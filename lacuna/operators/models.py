"""Regressions: Poisson with log link and cluster-robust errors, logistic risks out of fold, transport weights.

Rows stay distributed; only gradients and matrices of the few parameters reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.columns import hashed
from lacuna.sources.files import settled

from . import ranks


@dataclass(frozen=True)
class Spec:
    """A model of a sequence: its label, outcome and terms, and which rows it takes (SQL; NULL is no)."""

    label: str
    outcome: str
    terms: tuple[str, ...]
    rows: str = "true"


COLUMNS = (
    "label string, term string, estimate double, se double, ratio double, low double, high double, p double, n long, events double, clusters long, "
    "parameters long, log_likelihood double, aic double, converged boolean"
)


def poisson_cluster(df: DataFrame, outcome: str, terms: list[str], cluster: str, label: str = "model", most_steps: int = 50) -> DataFrame:
    """``sequence_of_models`` of one model on all rows."""
    return sequence_of_models(df, [Spec(label, outcome, tuple(terms))], cluster, most_steps)


def sequence_of_models(df: DataFrame, specs: list[Spec], cluster: str, most_steps: int = 50) -> DataFrame:
    """COLUMNS of every specification, a row per term, all fitted together on their complete cases.

    Modified Poisson: the point estimates are those of a Poisson model with log link; the variance is the cluster
    sandwich with the factor G / (G - 1) * (n - 1) / (n - k). One pass over the rows gives the gradient and the information matrix of every model that has not settled
    yet, so there are as many passes as the slowest model needs steps, and one more, ordered by cluster, for the sandwich. A step that lowers the
    likelihood is halved. A model that does not settle within ``most_steps`` is not converged; without rows all numbers are NULL.
    """
    used = list(dict.fromkeys(x for s in specs for x in (s.outcome, *s.terms)))
    whole = lambda s: F.coalesce(F.expr(s.rows), F.lit(False)) & reduce(Column.__and__, [F.col(x).isNotNull() for x in (s.outcome, *s.terms, cluster)])
    flags = F.array(*[whole(s) for s in specs])
    place = {x: i for i, x in enumerate(used)}
    rows = df.select(F.col(cluster).alias("cluster"), F.array(*[F.col(x).cast("double") for x in used]).alias("x"), flags.alias("takes"))
    rows = settled(rows.where(F.exists("takes", lambda f: f)))
    columns = [[place[t] for t in s.terms] for s in specs]
    answers = [place[s.outcome] for s in specs]
    sizes = [1 + len(s.terms) for s in specs]

    def matrices(b: tuple[np.ndarray, np.ndarray], i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mine = b[0][:, i]
        x = b[1][mine]
        return np.column_stack([np.ones(len(x)), x[:, columns[i]]]), x[:, answers[i]], mine

    def passed(at: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        """n, events, log-likelihood, gradient and information of the models at these estimates, as one vector for each."""

        def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = {i: np.zeros(3 + sizes[i] + sizes[i] ** 2) for i in at}
            for b in batches:
                block = arrays(b)
                for i, beta in at.items():
                    x, y, _ = matrices(block, i)
                    with np.errstate(over="ignore", invalid="ignore"):
                        eta = x @ beta
                        mu = np.exp(eta)
                        fit = y @ eta - mu.sum() - sum(math.lgamma(v + 1) * n for v, n in zip(*np.unique(y, return_counts=True), strict=True))
                        sums[i] += np.concatenate([[len(y), y.sum(), fit], x.T @ (y - mu), (x.T @ (x * mu[:, None])).ravel()])
            yield pd.DataFrame({"model": list(sums), "sums": list(sums.values())})

        each = rows.mapInPandas(add_up, "model int, sums array<double>").select("model", F.posexplode("sums").alias("k", "v"))
        found = {i: np.zeros(3 + sizes[i] + sizes[i] ** 2) for i in at}
        for r in each.groupBy("model", "k").agg(F.sum("v").alias("v")).collect():  # the matrices' entries
            found[r["model"]][r["k"]] = r["v"]
        return found

    start = {i: np.zeros(k) for i, k in enumerate(sizes)}
    first = passed(start)
    fits = {i: Fit(n=int(v[0]), events=float(v[1])) for i, v in first.items()}
    for i, f in fits.items():
        if f.n:
            f.begin(start[i], max(f.events, 0.5) / f.n)
    for _ in range(most_steps):
        todo = {i: f.beta for i, f in fits.items() if f.n and not f.converged}
        if not todo:
            break
        for i, v in passed(todo).items():
            k = sizes[i]
            fits[i].step(v[2], v[3 : 3 + k], v[3 + k :].reshape(k, k))
    final = {i: f.best for i, f in fits.items() if f.n}
    meat, groups = sandwich(rows, final, matrices) if final else ({}, {})
    out = []
    for i, s in enumerate(specs):
        f, k, names = fits[i], sizes[i], ["intercept", *s.terms]
        if not f.n:
            out += [(s.label, x, *[None] * 6, 0, 0.0, 0, k, None, None, False) for x in names]
            continue
        g = groups[i]
        factor = g / (g - 1) * (f.n - 1) / (f.n - k) if g > 1 and f.n > k else math.nan
        bread = np.linalg.pinv(f.information)
        se = np.sqrt(np.maximum(np.diag(bread @ meat[i] @ bread), 0) * factor)
        for x, b, e in zip(names, f.best, se, strict=True):
            p = math.erfc(abs(b) / e / math.sqrt(2)) if e > 0 else math.nan
            ends = [_number(v) for v in (_up(b), _up(b - Z95 * e), _up(b + Z95 * e), p)]
            out.append((s.label, x, _number(b), _number(e), *ends, f.n, f.events, g, k, _number(f.likelihood), _number(2 * k - 2 * f.likelihood), f.converged))
    return df.sparkSession.createDataFrame(out, COLUMNS)


def arrays(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Which models take each row of a batch, and its numbers, NaN where one is missing."""
    return np.array(b["takes"].tolist(), bool), np.array(b["x"].tolist(), float)


#: The normal quantile of 0.975.
Z95 = 1.959963984540054


def _number(x: float) -> float | None:
    return float(x) if math.isfinite(x) else None


def _up(x: float) -> float:
    return float(np.exp(x)) if x < 700 else math.inf


@dataclass
class Fit:
    """Newton steps of one model: the estimates to try next, and the best ones so far with their likelihood and information."""

    n: int
    events: float
    beta: np.ndarray | None = None
    best: np.ndarray | None = None
    likelihood: float = -math.inf
    information: np.ndarray | None = None
    converged: bool = False

    def begin(self, zero: np.ndarray, rate: float) -> None:
        self.beta = zero.copy()
        self.beta[0] = math.log(rate)

    def step(self, likelihood: float, gradient: np.ndarray, information: np.ndarray) -> None:
        whole = np.isfinite(likelihood) and np.isfinite(information).all()
        if self.best is not None and not (whole and likelihood >= self.likelihood - 1e-9 * (1 + abs(self.likelihood))):
            self.beta = (self.beta + self.best) / 2
            return
        if not whole:  # the start itself
            self.converged = False
            self.best, self.information = self.beta, np.zeros((len(self.beta),) * 2)
            return
        move = np.linalg.pinv(information, hermitian=True) @ gradient
        self.best, self.likelihood, self.information = self.beta, likelihood, information
        self.converged = bool(np.abs(move).max() <= 1e-9 * (1 + np.abs(self.beta).max()))
        self.beta = self.beta + move


def sandwich(rows: DataFrame, at: dict[int, np.ndarray], matrices) -> tuple[dict[int, np.ndarray], dict[int, int]]:
    """Of each model the sum over clusters of the outer product of their scores, and how many clusters it has."""
    sizes = {i: len(b) for i, b in at.items()}

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {i: np.zeros(1 + k * k) for i, k in sizes.items()}
        scores: dict[int, np.ndarray] = {}
        held = None

        def close() -> None:
            for i, u in scores.items():
                sums[i] += np.concatenate([[1], np.outer(u, u).ravel()])
            scores.clear()

        for b in batches:  # sorted by cluster; the last one of a batch may go on in the next
            code, ids = pd.factorize(b["cluster"])
            block, parts = arrays(b), {}
            for i, beta in at.items():
                x, y, mine = matrices(block, i)
                u = x * (y - np.exp(x @ beta))[:, None]
                own = code[mine]
                starts = np.flatnonzero(np.diff(own, prepend=-1))
                found = np.add.reduceat(u, starts) if len(starts) else u
                parts[i] = dict(zip(own[starts].tolist(), found, strict=True))
            for c, name in enumerate(ids):
                if name != held:
                    close()
                    held = name
                for i in at:
                    if c in parts[i]:
                        scores[i] = scores.get(i, 0) + parts[i][c]
        close()
        yield pd.DataFrame({"model": list(sums), "sums": list(sums.values())})

    ordered = rows.repartition("cluster").sortWithinPartitions("cluster")
    each = ordered.mapInPandas(add_up, "model int, sums array<double>").select("model", F.posexplode("sums").alias("k", "v"))
    found = {i: np.zeros(1 + k * k) for i, k in sizes.items()}
    for r in each.groupBy("model", "k").agg(F.sum("v").alias("v")).collect():  # the matrices' entries
        found[r["model"]][r["k"]] = r["v"]
    return {i: v[1:].reshape(sizes[i], sizes[i]) for i, v in found.items()}, {i: int(v[0]) for i, v in found.items()}


#: Values of a category, at most.
MOST_LEVELS = 200


def dummies(df: DataFrame, column: str, missing: str = "missing") -> tuple[DataFrame, list[str]]:
    """Adds a 0/1 column for each value of a category but the first (NULL is a value too); more than ``MOST_LEVELS`` values are an error."""
    value = F.coalesce(F.col(column).cast("string"), F.lit(missing))
    levels = sorted(r[0] for r in df.select(value.alias("v")).distinct().limit(MOST_LEVELS + 1).collect())
    if len(levels) > MOST_LEVELS:
        raise ValueError(f"{column} has more than {MOST_LEVELS} values and is no category")
    names = [f"{column}_{i}" for i in range(1, len(levels))]
    return df.withColumns({n: (value == v).cast("double") for n, v in zip(names, levels[1:], strict=True)}), names


def _medians(df: DataFrame, terms: list[str]) -> DataFrame:
    """One row: the median of each term."""
    return ranks.quantiles(df, [], {f"_m_{t}": (F.col(t), 0.5) for t in terms})


def _imputed(df: DataFrame, terms: list[str], medians: DataFrame) -> DataFrame:
    """Missing numbers become the medians (0 where there is none)."""
    rows = df.join(F.broadcast(medians), F.lit(True))  # one row
    return rows.withColumns({t: F.coalesce(F.col(t).cast("double"), F.col(f"_m_{t}"), F.lit(0.0)) for t in terms}).drop(*[f"_m_{t}" for t in terms])


def folds(df: DataFrame, key: str, label: str, k: int, seed: int) -> DataFrame:
    """Adds fold 0..k-1, stratified by the label, in the order of md5."""
    w = Window.partitionBy(label, "_b").orderBy("_h", key)
    return df.withColumn("_h", hashed(F.lit(seed), key)).withColumn("_b", F.col("_h") % 64).withColumn("fold", F.pmod(F.row_number().over(w) + F.col("_b"), F.lit(k))).drop("_h", "_b")


def out_of_fold(df: DataFrame, key: str, label: str, terms: list[str], categories: tuple[str, ...] = (), k: int = 5, seed: int = 20260706) -> DataFrame:
    """key, label, fold, risk: logistic risk from the other folds, classes weighted equally, numbers imputed by the medians of those folds.

    ``categories`` are one-hot, a missing value being one of its own.
    """
    rows, names = df.select(key, label, *terms, *categories).where(F.col(label).isNotNull()), list(terms)
    for c in categories:
        rows, more = dummies(rows, c)
        names += more
    rows = folds(rows, key, label, k, seed).withColumn("_y", F.col(label).cast("double"))
    out = None
    for f in range(k):
        train = rows.where(F.col("fold") != f)
        middle, n = _medians(train, terms), train.groupBy("_y").agg(F.count("*").alias("_n"))
        ready = lambda part: VectorAssembler(inputCols=names, outputCol="_x").transform(_imputed(part, terms, middle))  # noqa: B023, E731
        weighted = ready(train).join(F.broadcast(n), "_y").withColumn("_w", 1.0 / F.col("_n"))  # two rows
        model = LogisticRegression(labelCol="_y", featuresCol="_x", weightCol="_w", probabilityCol="_p", regParam=1e-3).fit(weighted)
        one = model.transform(ready(rows.where(F.col("fold") == f))).select(key, label, "fold", vector_to_array("_p")[1].alias("risk"))
        out = one if out is None else out.unionByName(one)
    return out


def transport_weights(source: DataFrame, target: DataFrame, key: str, terms: list[str], least: float = 0.05, most: float = 20.0) -> DataFrame:
    """key, weight of the source rows: odds of belonging to the target, over their median, cut to [least, most]."""
    rows = source.select(key, *terms, F.lit(0.0).alias("_y")).unionByName(target.select(key, *terms, F.lit(1.0).alias("_y")))
    rows = VectorAssembler(inputCols=terms, outputCol="_x").transform(_imputed(rows, terms, _medians(rows, terms)))
    scored = LogisticRegression(labelCol="_y", featuresCol="_x", probabilityCol="_p", regParam=1e-3).fit(rows).transform(rows.where("_y = 0"))
    odds = scored.select(key, vector_to_array("_p").alias("p")).select(key, (F.col("p")[1] / F.col("p")[0]).alias("odds"))
    middle = ranks.quantiles(odds, [], {"_m": (F.col("odds"), 0.5)})
    return odds.join(F.broadcast(middle), F.lit(True)).select(key, F.least(F.greatest(F.col("odds") / F.col("_m"), F.lit(least)), F.lit(most)).alias("weight"))  # one row
