"""Quality rules and robust multivariate outliers.

``statistics`` counts what the fixed rules need and a vector of transformed shares. For each language
and source the minimum covariance determinant of those vectors is estimated from all its documents:
from two deterministic starts (spread around medians; a damped correlation), concentration steps
keep the ``kept_share`` of documents nearest in Mahalanobis distance and take their mean and
covariance, and the start with the smaller determinant wins. Every step is one aggregation of
moments and one of counts by distance bin, so a group of any size is never gathered. The kept documents' covariance is raised to that of all (``consistency``).

Of the nine statistics four have spread in every text: word length and the shares of separators, vowels and capitals. There the estimate is
wider than the floor under the variances (``FLOOR``) and decides, with its correlations. The other five are zero in most texts, so that their estimated spread is none; their
floors say from which share on they matter. Short texts are drawn to an ordinary one by ``SMOOTH_WORDS`` words that are added to all, so that chance does not look like deviation.

Rows of a normal law have distances of a chi-square law, whose quantile is the cut. Texts without the rare marks have smaller ones: the cut is on the safe side. A deviation in one
statistic gives at most its square over that of the floor: floors are so small that each statistic alone can pass the cut, the repeated words within what the base rule allows.

Every group's estimate is drawn to that of all documents by the weight of ``PRIOR`` documents, at every size alike: a large
group hardly moves, and one of a few documents is not its own measure. A document is kept if it passes the base rules and its
distance is at most ``CUT``.

Defined cases: a null text has no words and fails; a null language or source is a group of its own; rows that repeat
count each; equal distances fall into one bin; an empty table gives no rows; other columns are neither read nor
returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import meet, settled, small_batches

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_WORDS, REPEAT_PERCENT = 10, 20

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The transformed statistics: log mean word length, and square roots of shares, which spread small shares.
VECTOR = ("word_length", "separator_share", "vowel_share", "capital_share", "symbol_share", "digit_share", "mark_share", "repeat_share", "dup_line_share")
D = len(VECTOR)
#: Standard deviations below which a difference does not matter, in the units of VECTOR.
FLOOR = (0.02, 0.01, 0.01, 0.01, 0.02, 0.11, 0.03, 0.075, 0.13)
#: Words that are added to every text: of five letters, with the shares of separators, vowels and capitals that prose has, and no other marks.
SMOOTH_WORDS, SMOOTH_LETTERS, SMOOTH_SHARES = 30, 5, (0.03, 0.37, 0.016)
KEPT_SHARE = 0.75
STEPS = 4
#: Documents that the estimate of all groups counts for in each.
PRIOR = 40
#: Squared distances are counted in bins of this ratio.
BIN = 1.02

_BLANK = b" \t\n\x0b\x0c\r"
_SYMBOL = SYMBOLS.encode()
_MARK = b"!?{}[]@=~^\\_"
_SEPARATOR = b".,;:"
_VOWEL = b"aeiouAEIOU"
_CAPITAL = bytes(range(0x41, 0x5B))
_DIGIT = bytes(range(0x30, 0x3A))
_BOTH = "struct<" + ",".join([*(f"{c}:long" for c in COUNTS), *(f"{c}:double" for c in VECTOR)]) + ">"


def chi_square(x: float, k: int) -> float:
    """The share of a chi-square law of k degrees of freedom up to x."""
    share, at = (math.erf(math.sqrt(x / 2)), 1) if k % 2 else (1 - math.exp(-x / 2), 2)
    for j in range(at, k, 2):
        share -= (x / 2) ** (j / 2) * math.exp(-x / 2) / math.gamma(j / 2 + 1)
    return share


def chi_square_quantile(share: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, k) < share else (low, middle)
    return (low + high) / 2


def consistency(kept_share: float) -> float:
    """The factor from the covariance of the nearest ``kept_share`` of normal rows to that of all."""
    return 1.0 if kept_share >= 1 else kept_share / chi_square(chi_square_quantile(kept_share, D), D + 2)


#: Share of ordinary documents that may lie beyond the cut.
BEYOND = 1e-4
CUT = chi_square_quantile(1 - BEYOND, D)


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of WINDOW words that the text holds twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    code = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WINDOW):
            code = code * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
            code ^= code >> np.uint64(31)
    ranked = np.sort(code)
    if not (ranked[1:] == ranked[:-1]).any():
        return 0
    order = np.argsort(code)
    same = code[order][1:] == code[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(text: str | None) -> tuple:
    """COUNTS and VECTOR of one text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return (0,) * len(COUNTS) + (0.0,) * D
    found = lambda chars: len(raw) - len(raw.translate(None, chars))
    chars, symbols = len(text) - found(_BLANK), found(_SYMBOL)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup, repeat = len(lines) - len(set(lines)), repeated_words(words)
    more = SMOOTH_WORDS * SMOOTH_LETTERS
    share = lambda part, ordinary=0.0: ((part + ordinary * more) / (chars + more)) ** 0.5
    spread = [share(found(x), s) for x, s in zip((_SEPARATOR, _VOWEL, _CAPITAL), SMOOTH_SHARES, strict=True)]
    vector = (math.log((chars + more) / (n + SMOOTH_WORDS)), *spread, share(symbols), share(found(_DIGIT)), share(found(_MARK)), (repeat / n) ** 0.5, (dup / len(lines)) ** 0.5)
    return (n, chars, symbols, dup, repeat, *vector)


def statistics_of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        yield pd.DataFrame([statistics(t) for t in batch], columns=[*COUNTS, *VECTOR])


def base_failed(n_words="n_words", n_repeat="n_repeat_words"):
    return (F.col(n_words) < LEAST_WORDS) | (100 * F.col(n_repeat) > REPEAT_PERCENT * F.col(n_words))


def with_statistics(docs: DataFrame, name: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.withColumn(name, F.pandas_udf(statistics_of, _BOTH)("text"))


def _binned_level(rows: DataFrame, keys: list[str], value, share: float, name: str) -> DataFrame:
    """keys and ``name``: the upper end of the bin in which the ``share`` smallest values of a key end."""
    from pyspark.sql import Window

    counts = rows.select(*keys, F.floor(value).cast("long").alias("_bin")).groupBy(*keys, "_bin").agg(F.count("*").alias("_n"))
    up = Window.partitionBy(*keys).orderBy("_bin")
    counts = counts.select(*keys, "_bin", F.sum("_n").over(up).alias("_to"), F.sum("_n").over(Window.partitionBy(*keys)).alias("_all"))
    return counts.where(F.col("_to") >= F.col("_all") * share).groupBy(*keys).agg((F.min("_bin") + 1).alias(name))


def _moments(rows: DataFrame, keys: list[str], weight) -> DataFrame:
    """Per key: the number of weighted rows, their sums and sums of products (upper triangle)."""
    x = [F.when(weight, F.col(f"x{i}")) for i in range(D)]
    sums = [F.sum(v).alias(f"s{i}") for i, v in enumerate(x)]
    products = [F.sum(x[i] * F.col(f"x{j}")).alias(f"p{i}_{j}") for i in range(D) for j in range(i, D)]
    return rows.groupBy(*keys).agg(F.count(F.when(weight, F.lit(1))).alias("m"), *sums, *products)


def _shape(moments: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """Per key: mean, the inverse of the floored covariance times ``factor`` (row by row) and its log determinant."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[keys].copy()
            m = np.maximum(b["m"].to_numpy(float), 1)
            mean = np.stack([b[f"s{i}"].fillna(0).to_numpy(float) / m for i in range(D)], 1) if len(b) else np.zeros((0, D))
            cov = np.zeros((len(b), D, D))
            for i in range(D):
                for j in range(i, D):
                    cov[:, i, j] = cov[:, j, i] = b[f"p{i}_{j}"].fillna(0).to_numpy(float) / m - mean[:, i] * mean[:, j]
            cov = cov * factor + np.diag(np.square(FLOOR))
            out["mean"] = list(mean)
            out["inverse"] = list(np.linalg.inv(cov).reshape(len(b), D * D))
            out["log_det"] = np.linalg.slogdet(cov)[1]
            yield out

    kinds = {f.name: f.dataType.simpleString() for f in moments.schema.fields}
    return moments.mapInPandas(solve, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", mean array<double>, inverse array<double>, log_det double")


def _distance():
    """Squared Mahalanobis distance of x0.. from the joined mean and inverse, in plain column arithmetic."""
    off = [F.col(f"x{i}") - F.get("mean", i) for i in range(D)]
    total = F.lit(0.0)
    for i in range(D):
        total = total + off[i] * off[i] * F.get("inverse", i * D + i)
        for j in range(i + 1, D):
            total = total + 2 * off[i] * off[j] * F.get("inverse", i * D + j)
    return F.greatest(total, F.lit(0.0))


def estimates(rows: DataFrame, kept_share: float = KEPT_SHARE, steps: int = STEPS) -> DataFrame:
    """group, mean, inverse, n: the minimum covariance determinant estimate of each group of rows (group, x0, x1, ...)."""
    # medians and median deviations by counts in bins far narrower than FLOOR
    place = lambda x: F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), (x(i) / (FLOOR[i] / 32)).alias("v")) for i in range(D)])).alias("d")
    wide = lambda level, name: level.groupBy("group").agg(*[F.max(F.when(F.col("dim") == i, F.col("level"))).alias(f"{name}{i}") for i in range(D)])
    long = rows.select("group", place(lambda i: F.col(f"x{i}"))).select("group", "d.dim", "d.v")
    medians = settled(wide(_binned_level(long, ["group", "dim"], F.col("v"), 0.5, "level"), "c"))
    long = meet(rows, medians, ["group"]).select("group", place(lambda i: F.abs(F.col(f"x{i}") - F.col(f"c{i}") * (FLOOR[i] / 32)))).select("group", "d.dim", "d.v")
    start = settled(meet(medians, wide(_binned_level(long, ["group", "dim"], F.col("v"), 0.5, "level"), "a"), ["group"]))
    centre = [F.col(f"c{i}") * (FLOOR[i] / 32) for i in range(D)]
    scale = [F.sqrt((F.col(f"a{i}") * (1.4826 * FLOOR[i] / 32)) ** 2 + FLOOR[i] ** 2) for i in range(D)]
    inverse = F.array(*[1 / (scale[i] * scale[i]) if i == j else F.lit(0.0) for i in range(D) for j in range(D)])
    plain = start.select("group", F.lit(0).alias("start"), F.array(*centre).alias("mean"), inverse.alias("inverse"))
    scaled = meet(rows, start, ["group"])
    damped = scaled.select("group", *[F.tanh((F.col(f"x{i}") - centre[i]) / scale[i]).alias(f"x{i}") for i in range(D)])
    second = meet(_correlated(_moments(damped, ["group"], F.lit(True))), start, ["group"])
    turned = F.array(*[F.get("r", i * D + j) / (scale[i] * scale[j]) for i in range(D) for j in range(D)])
    shape = settled(plain.unionByName(second.select("group", F.lit(1).alias("start"), F.array(*centre).alias("mean"), turned.alias("inverse"))))
    for _ in range(steps):
        far = meet(rows, shape, ["group"]).withColumn("bin", F.floor(F.log(_distance() + 1e-6) / math.log(BIN))).drop("mean", "inverse")
        level = settled(_binned_level(far, ["group", "start"], F.col("bin"), kept_share, "level"))
        near = meet(far, level, ["group", "start"])
        shape = settled(_shape(_moments(near, ["group", "start"], F.col("bin") < F.col("level")), ["group", "start"], consistency(kept_share)))
    best = shape.groupBy("group").agg(F.min(F.struct("log_det", "start", "mean", "inverse")).alias("b"))
    counts = rows.groupBy("group").agg(F.count("*").alias("n"))
    return meet(best.select("group", "b.mean", "b.inverse"), counts, ["group"])


def _correlated(moments: DataFrame) -> DataFrame:
    """group and r: the inverse of the floored correlation matrix of damped values."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            m = np.maximum(b["m"].to_numpy(float), 1)
            r = np.zeros((len(b), D, D))
            for i in range(D):
                for j in range(i, D):
                    r[:, i, j] = r[:, j, i] = b[f"p{i}_{j}"].fillna(0).to_numpy(float) / m
            r += 0.1 * np.eye(D)
            unit = np.sqrt(np.einsum("kii->ki", r)) if len(b) else np.zeros((0, D))
            r = r / (unit[:, :, None] * unit[:, None, :])
            yield pd.DataFrame({"group": b["group"], "r": list(np.linalg.inv(r).reshape(len(b), D * D))})

    return moments.mapInPandas(solve, "group string, r array<double>")


def group_of(*columns: str):
    """One text for the values of ``columns``; null differs from every value."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("?"))
    return F.concat_ws("\t", *[part(c) for c in columns])


def fitted(stats: DataFrame, prior: float = PRIOR, **how) -> DataFrame:
    """group, mean, inverse from a table of group and the statistics struct ``s``; a row "all" has that of all groups together."""
    own = stats.where(~base_failed("s.n_words", "s.n_repeat_words")).select("group", *[F.col(f"s.{v}").alias(f"x{i}") for i, v in enumerate(VECTOR)])
    found = settled(estimates(settled(own.unionByName(own.withColumn("group", F.lit("all")))), **how))
    shared = found.where("group = 'all'").select(F.col("mean").alias("all_mean"), F.col("inverse").alias("all_inverse"))  # one row

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                mean, inverse = drawn(*(np.stack(b[c].to_list()) for c in ("mean", "inverse", "all_mean", "all_inverse")), b["n"].to_numpy(float), prior)
                yield pd.DataFrame({"group": b["group"], "mean": list(mean), "inverse": list(inverse)})

    return settled(found.join(F.broadcast(shared), F.lit(True)).mapInPandas(draw, "group string, mean array<double>, inverse array<double>"))


def drawn(mean, inverse, all_mean, all_inverse, n, prior) -> tuple[np.ndarray, np.ndarray]:
    """Means and inverse covariances of groups of n documents mixed with ``prior`` documents of all; the distance between the means counts as variance."""
    cov, every = (np.linalg.inv(x.reshape(-1, D, D)) for x in (inverse, all_inverse))
    share = (prior / (n + prior))[:, None] if prior else np.zeros((len(n), 1))
    off = mean - all_mean
    cov = (1 - share[:, :, None]) * cov + share[:, :, None] * every + (share * (1 - share))[:, :, None] * off[:, :, None] * off[:, None, :]
    return mean - share * off, np.linalg.inv(cov).reshape(-1, D * D)


def judged(stats: DataFrame, shapes: DataFrame, cut: float = CUT) -> DataFrame:
    """``stats`` with base_failed, distance and kept. ``shapes`` has a row for each group, of about 0.5 kB."""
    rows = stats.withColumns({f"x{i}": F.col(f"s.{v}") for i, v in enumerate(VECTOR)})
    every = shapes.where("group = 'all'").select(F.col("mean").alias("m_"), F.col("inverse").alias("i_"))  # one row
    rows = meet(rows, shapes, ["group"], "left").join(F.broadcast(every), F.lit(True), "left")
    rows = rows.withColumns({"mean": F.coalesce("mean", "m_"), "inverse": F.coalesce("inverse", "i_")}).drop("m_", "i_")
    rows = rows.withColumn("base_failed", base_failed("s.n_words", "s.n_repeat_words"))
    rows = rows.withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cut)).drop(*[f"x{i}" for i in range(D)], "mean", "inverse")


def grouped_statistics(docs: DataFrame) -> DataFrame:
    return with_statistics(docs.select("doc_id", group_of("lang", "source").alias("group"), "text"), "s").drop("text")


def rate(docs: DataFrame, **how) -> DataFrame:
    """Per document: doc_id, the counts, base_failed, kept and distance."""
    stats = settled(grouped_statistics(docs))
    return judged(stats, fitted(stats, **how)).select("doc_id", *[F.col(f"s.{c}").alias(c) for c in COUNTS], "base_failed", "kept", "distance")
