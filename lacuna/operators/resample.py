"""Cluster bootstrap with weights from md5, agreement of two measurements, and other summaries of groups.

Clusters are reduced to their sums first. In a replicate a cluster has a Poisson weight of mean 1, read from the md5 of (seed, cluster, block of
replicates): the same on every machine, in every order and for every set of other groups. A task works out the weights of a block of clusters as a matrix,
clusters by replicates, and multiplies it with the clusters' sums; only its sums by group and replicate are shuffled. There is no row for a
cluster and a replicate, no join and no ranking. Drawing as many clusters as there are with replacement gives weights of the same means and variances;
ratios of sums and means of clusters have the same limits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from hashlib import md5
from math import exp, factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.columns import hashed, ratio, tally
from lacuna.sources.files import settled

from . import ranks


#: Cumulative Poisson probabilities of mean 1 as numbers of 32 bits: a hash has the weight of how many it reaches.
POISSON = [round(2**32 * sum(exp(-1) / factorial(i) for i in range(k + 1))) for k in range(12)]
#: Hashes of 32 bits in one md5.
BLOCK = 4
#: Rows of clusters whose weights a task holds as one matrix, and groups whose sums it holds.
CLUSTERS, GROUPS = 1000, 500
#: Replicates whose minima are taken in one aggregation.
MINIMA = 50


def clusters_of(df: DataFrame, groups: list[str], cluster: str, sums: list[Column]) -> DataFrame:
    """groups, cluster and the sums of each cluster of a group."""
    return df.where(F.col(cluster).isNotNull()).groupBy(*groups, cluster).agg(*sums)


def weights(clusters: list[str], reps: int, seed: int) -> np.ndarray:
    """Weights of the clusters (rows) in the replicates (columns)."""
    blocks = range(-(-reps // BLOCK))
    digests = b"".join([md5(f"{seed}|{c}|{k}".encode()).digest() for c in clusters for k in blocks])
    hashes = np.frombuffer(digests, ">u4").reshape(len(clusters), -1)[:, :reps]
    return np.searchsorted(np.array(POISSON, np.int64), hashes.astype(np.int64), "right").astype(np.float64)


def weighted(values: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums of the values (cluster x column) in each replicate, and of the weights: replicate x (column + 1)."""
    return w.T @ np.column_stack([values, np.ones(len(values))])


def replicates(clusters: DataFrame, groups: list[str], cluster: str, reps: int, seed: int, columns: list[str], sums: Callable = weighted, names: list[str] | None = None) -> DataFrame:
    """groups, rep, the columns' weighted sums over the clusters (missing values count as 0), and the clusters drawn.

    ``sums`` may make other additive numbers, ``names``, of a block's values and weights.
    """
    names = names or [*columns, "drawn"]
    kinds = {f.name: f.dataType.simpleString() for f in clusters.schema.fields}
    rows = clusters.select(*groups, F.col(cluster).cast("string").alias("_id"), *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(columns)])
    rows = rows.repartition("_id").sortWithinPartitions("_id")  # a cluster's rows of all groups come together

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for b in batches:
            for start in range(0, len(b), CLUSTERS):
                part = b.iloc[start : start + CLUSTERS]
                at, ids = pd.factorize(part["_id"])
                w = weights(list(ids), reps, seed)
                values = np.nan_to_num(part[[f"_v{i}" for i in range(len(columns))]].to_numpy(float))
                keys = list(part[groups].itertuples(index=False, name=None)) if groups else [()] * len(part)
                spots: dict[tuple, list[int]] = {}
                for i, k in enumerate(keys):
                    spots.setdefault(tuple(None if x != x else x for x in k), []).append(i)
                for k, i in spots.items():
                    one = sums(values[i], w[at[i]])
                    held[k] = held[k] + one if k in held else one
            if len(held) > GROUPS:
                yield listed(held)
                held = {}
        yield listed(held)

    def listed(held: dict[tuple, np.ndarray]) -> pd.DataFrame:
        return pd.DataFrame([(*k, *v.T) for k, v in held.items()], columns=[*groups, *names])

    schema = ", ".join([*[f"{g} {kinds[g]}" for g in groups], *[f"{n} array<double>" for n in names]])
    each = rows.mapInPandas(add_up, schema).select(*groups, F.posexplode(F.arrays_zip(*names)).alias("rep", "_x"))
    return each.groupBy(*groups, "rep").agg(*[F.sum(f"_x.{n}").alias(n) for n in names]).where("drawn > 0" if "drawn" in names else "true")


def interval(reps: DataFrame, groups: list[str], values: dict[str, Column], low: float = 0.025, high: float = 0.975) -> DataFrame:
    """groups and ``name``_low and ``name``_high of each value over the replicates."""
    rows = reps.select(*groups, *[v.alias(n) for n, v in values.items()])
    return rows.groupBy(*groups).agg(*[F.percentile(n, F.lit(q)).alias(f"{n}_{side}") for n in values for side, q in (("low", low), ("high", high))])


def bootstrap_ratio(df: DataFrame, groups: list[str], cluster: str, top: str, bottom: str, reps: int, seed: int) -> DataFrame:
    """groups, clusters, estimate (ratio of sums), low and high."""
    c = clusters_of(df, groups, cluster, [F.sum(top).alias("top"), F.sum(bottom).alias("bottom")])
    point = c.groupBy(*groups).agg(F.count("*").alias("clusters"), ratio(F.sum("top"), F.sum("bottom")).alias("estimate"))
    ends = interval(replicates(c, groups, cluster, reps, seed, ["top", "bottom"]), groups, {"r": ratio("top", "bottom")})
    return point.join(ends.withColumnsRenamed({"r_low": "low", "r_high": "high"}), groups)


def bootstrap_mean(df: DataFrame, groups: list[str], cluster: str, value: str, reps: int, seed: int) -> DataFrame:
    """groups, rows, clusters, estimate (mean of rows), equal (mean of cluster means) and the interval of the latter."""
    c = clusters_of(df.where(F.col(value).isNotNull()), groups, cluster, [F.avg(value).alias("m"), F.sum(value).alias("s"), F.count("*").alias("k")])
    point = c.groupBy(*groups).agg(F.sum("k").alias("rows"), F.count("*").alias("clusters"), ratio(F.sum("s"), F.sum("k")).alias("estimate"), F.avg("m").alias("equal"))
    ends = interval(replicates(c, groups, cluster, reps, seed, ["m"]), groups, {"r": F.col("m") / F.col("drawn")})
    return point.join(ends.withColumnsRenamed({"r_low": "low", "r_high": "high"}), groups)


def agreement(df: DataFrame, groups: list[str], bias: str = "bias") -> DataFrame:
    """Bland-Altman: mean, sd, limits at 1.96 sd, median absolute difference."""
    rows = settled(df.select(*groups, bias))
    out = rows.groupBy(*groups).agg(F.count(bias).alias("n"), F.avg(bias).alias("mean"), F.stddev_samp(bias).alias("sd"))
    out = ranks.with_quantiles(out, rows, groups, {"median_abs": (F.abs(bias), 0.5)})
    return out.withColumns({"loa_low": F.col("mean") - 1.96 * F.col("sd"), "loa_high": F.col("mean") + 1.96 * F.col("sd")})


def cluster_moments(df: DataFrame, cluster: str, value: str) -> DataFrame:
    return df.groupBy(cluster).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.avg(value).alias("m"), (F.var_pop(value) * F.count(value)).alias("ss"))


def random_intercept(moments: DataFrame) -> DataFrame:
    """One row: between and within variance by moments, the weighted mean and limits of agreement."""
    t = moments.agg(F.sum("n").alias("total"), F.count("*").alias("k"), (F.sum("s") / F.sum("n")).alias("grand"), F.sum("ss").alias("ssw"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    rows = moments.join(F.broadcast(t), F.lit(True))  # one row
    c = F.col
    b = rows.groupBy("total", "k", "grand", "ssw", "nn").agg(F.sum(c("n") * (c("m") - c("grand")) ** 2).alias("ssb"))
    b = b.withColumns({"within": c("ssw") / (c("total") - c("k")), "msb": c("ssb") / (c("k") - 1), "n0": (c("total") - c("nn") / c("total")) / (c("k") - 1)})
    b = b.withColumn("between", F.greatest((c("msb") - c("within")) / c("n0"), F.lit(0.0))).select("between", "within", "k", "total")
    w = moments.join(F.broadcast(b), F.lit(True)).withColumn("w", 1 / (c("between") + c("within") / c("n")))  # one row
    out = w.groupBy("between", "within", "k", "total").agg((F.sum(c("w") * c("m")) / F.sum("w")).alias("mean"))
    half = 1.96 * F.sqrt(c("between") + c("within"))
    return out.select(c("k").alias("clusters"), c("total").alias("rows"), "mean", "between", "within", (c("mean") - half).alias("loa_low"), (c("mean") + half).alias("loa_high"))


def random_intercept_interval(moments: DataFrame, cluster: str, reps: int, seed: int) -> DataFrame:
    """One row: percentile intervals of the mean and of both limits of agreement over resampled clusters."""
    c = F.col
    rows = settled(moments.select(cluster, "n", "s", "m", "ss", (c("n") * c("n")).alias("nn"), (c("n") * c("m") * c("m")).alias("nmm")))
    sums = replicates(rows, [], cluster, reps, seed, ["n", "s", "ss", "nn", "nmm"]).withColumnRenamed("drawn", "k")
    within = c("ss") / (c("n") - c("k"))
    msb = (c("nmm") - c("s") * c("s") / c("n")) / (c("k") - 1)
    n0 = (c("n") - c("nn") / c("n")) / (c("k") - 1)
    parts = sums.where("k > 1 and n > k").select("rep", within.alias("within"), F.greatest((msb - within) / n0, F.lit(0.0)).alias("between"))
    found = parts.collect()  # a row for each replicate
    spread = np.full((2, reps), np.nan)
    for r in found:
        spread[:, r["rep"]] = r["between"], r["within"]

    def means(values: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Each replicate has variances, and so weights, of its own."""
        n, m = values.T
        v = w / (spread[0] + spread[1] / n[:, None])
        return np.nan_to_num(np.column_stack([v.T @ m, v.sum(0)]))

    mean = replicates(rows, [], cluster, reps, seed, ["n", "m"], means, ["top", "bottom"])
    ends = mean.join(F.broadcast(parts), "rep").select((c("top") / c("bottom")).alias("mean"), (1.96 * F.sqrt(c("between") + c("within"))).alias("half"), F.lit(1).alias("_all"))  # a row for each replicate
    return interval(ends, ["_all"], {"mean": c("mean"), "loa_low": c("mean") - c("half"), "loa_high": c("mean") + c("half")}).drop("_all")


def reml_profile(moments: DataFrame, ratios: list[float]) -> DataFrame:
    """ratio (between to within variance), loglik: the profiled restricted likelihood on a grid, from cluster moments alone."""
    c = F.col
    rows = moments.withColumn("ratio", F.explode(F.array(*[F.lit(float(r)) for r in ratios]))).withColumn("w", c("n") / (1 + c("n") * c("ratio")))
    mu = rows.groupBy("ratio").agg((F.sum(c("w") * c("m")) / F.sum("w")).alias("mu"))
    q = rows.join(mu, "ratio").groupBy("ratio").agg(F.sum("n").alias("total"), F.sum(c("ss") + c("w") * (c("m") - c("mu")) ** 2).alias("rss"), F.sum(F.log(1 + c("n") * c("ratio"))).alias("logs"), F.log(F.sum("w")).alias("logw"))
    return q.select("ratio", (-0.5 * ((c("total") - 1) * F.log(c("rss") / (c("total") - 1)) + c("logs") + c("logw"))).alias("loglik"))


def one_per_cluster(df: DataFrame, cluster: str, key: str, reps: int, seed: int) -> DataFrame:
    """rep and one row of each cluster per replicate, by the smallest md5: a minimum for each replicate, taken in each task first."""
    held = F.struct(*df.columns)
    parts = [range(k, min(k + MINIMA, reps)) for k in range(0, reps, MINIMA)]
    out = []
    for part in parts:
        least = df.groupBy(F.col(cluster).alias("_cluster")).agg(*[F.min(F.struct(hashed(F.lit(seed), F.lit(r), key).alias("h"), F.col(key).alias("k"), held.alias("row"))).alias(f"_r{r}") for r in part])
        each = F.explode(F.array(*[F.struct(F.lit(r).alias("rep"), F.col(f"_r{r}.row").alias("row")) for r in part]))
        out.append(least.select(each.alias("_x")).select("_x.row.*", "_x.rep"))
    return reduce(DataFrame.unionByName, out)


def standardised_differences(df: DataFrame, group: Column, columns: list[str], weight: str | None = None) -> DataFrame:
    """variable, mean_1, mean_0, smd, large: difference of means over the pooled deviation; with a weight, weighted means and variances."""
    w = F.col(weight) if weight else F.lit(1.0)
    parts = []
    for v in columns:
        x = F.col(v).cast("double")
        for g in (1, 0):
            on = (group == F.lit(bool(g))) & x.isNotNull()
            s, sw = F.sum(F.when(on, w * x)), F.sum(F.when(on, w))
            parts += [ratio(s, sw).alias(f"m{g}_{v}"), (ratio(F.sum(F.when(on, w * x * x)), sw) - ratio(s, sw) ** 2).alias(f"v{g}_{v}"), F.count(F.when(on, F.lit(1))).alias(f"n{g}_{v}")]
    one = df.agg(*parts)
    ddof = lambda g, v: F.lit(1.0) if weight else F.col(f"n{g}_{v}") / (F.col(f"n{g}_{v}") - 1)
    rows = [F.struct(F.lit(v).alias("variable"), F.col(f"m1_{v}").alias("mean_1"), F.col(f"m0_{v}").alias("mean_0"), F.sqrt((F.col(f"v1_{v}") * ddof(1, v) + F.col(f"v0_{v}") * ddof(0, v)) / 2).alias("sd")) for v in columns]
    out = one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return out.withColumn("smd", ratio(F.col("mean_1") - F.col("mean_0"), F.col("sd"))).withColumn("large", F.abs("smd") > 0.2).drop("sd")


def pareto(df: DataFrame, keys: list[str], burden: str, benefit: str) -> DataFrame:
    """Adds optimal: no other row has burden as low and benefit as high with one of them better. Sorted scan per key."""
    b, g = F.coalesce(F.col(burden), F.lit(float("inf"))), F.coalesce(F.col(benefit), F.lit(float("-inf")))
    rows = df.withColumns({"_b": b, "_g": g})
    w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    best = rows.groupBy(*keys, "_b").agg(F.max("_g").alias("_top")).withColumn("_cheaper", F.max("_top").over(w))
    # dominated by a cheaper row that is as good, or by an equally cheap one that is better
    optimal = (F.col("_g") == F.col("_top")) & (F.col("_cheaper").isNull() | (F.col("_cheaper") < F.col("_g")))
    return rows.join(best, [*keys, "_b"]).withColumn("optimal", optimal).drop("_b", "_g", "_top", "_cheaper")


def capture(df: DataFrame, score: str, outcome: Column, tie: str, shares: list[float]) -> DataFrame:
    """share, taken, captured, capture_rate, needed: outcomes among the highest scores."""
    n = df.agg(F.count("*").alias("n"), tally(outcome).alias("all"))
    rows = ranks.numbered(df.withColumn("_o", outcome), [F.desc(score), F.col(tie)], "_r").join(F.broadcast(n), F.lit(True))  # one row
    rows = rows.withColumn("share", F.explode(F.array(*[F.lit(s) for s in shares]))).where(F.col("_r") <= F.ceil(F.col("n") * F.col("share")))
    out = rows.groupBy("share").agg(F.count("*").alias("taken"), tally(F.col("_o")).alias("captured"), F.max("all").alias("_all"))
    return out.withColumns({"capture_rate": ratio("captured", "_all"), "needed": ratio("taken", "captured")}).drop("_all")


def quantile_bins(df: DataFrame, value: str, bins: int, keep: list[Column]) -> DataFrame:
    """bin 1..bins by linear quantile edges, right-closed, the lowest included, with the aggregates."""
    edges = ranks.quantiles(df, [], {f"_e{i}": (F.col(value), i / bins) for i in range(1, bins)})
    at = reduce(lambda a, i: a + F.when(F.col(value) > F.col(f"_e{i}"), 1).otherwise(0), range(1, bins), F.lit(1))
    return df.join(F.broadcast(edges), F.lit(True)).where(F.col(value).isNotNull()).withColumn("bin", at).groupBy("bin").agg(*keep)  # one row
