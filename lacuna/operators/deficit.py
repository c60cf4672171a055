"""Below-threshold deficit of a reference and of what is displayed, split point by point.

r and d are the deficits of the reference and the display. hidden = max(r - d, 0) is what the display does not show, over = max(d - r, 0)
what it shows without cause, concordant = min(r, d). A missing reference contributes nothing; a display that is unavailable has no
deficit, and its hidden part is counted on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.columns import ratio, tally, total

AREAS = ("true_auc", "display_auc", "hidden_auc", "over_auc", "concordant_auc", "hidden_unavailable_auc", "hidden_valid_auc")
MINUTES = ("valid_min", "available_min", "true_low_min", "display_low_min", "both_low_min", "normal_discordant_min", "low_discordant_min", "unavailable_low_min")
MEASURES = AREAS + MINUTES
RATIOS = ("hdr", "odr", "net", "concordance", "availability")


def with_thresholds(df: DataFrame, thresholds: list[float]) -> DataFrame:
    return df.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))


def parts(df: DataFrame) -> DataFrame:
    """Adds the deficit columns to rows of value, shown and threshold."""
    valid, up = F.col("value").isNotNull(), F.col("shown").isNotNull()
    r = F.when(valid, F.greatest(F.col("threshold") - F.col("value"), F.lit(0.0))).otherwise(0.0)
    d = F.when(valid & up, F.greatest(F.col("threshold") - F.col("shown"), F.lit(0.0))).otherwise(0.0)
    rows = df.withColumns({"_valid": valid, "_up": up, "_r": r, "_d": d, "_low": valid & (F.col("value") < F.col("threshold")), "_dlow": valid & up & (F.col("shown") < F.col("threshold"))})
    return rows.withColumns({"_hidden": F.greatest(F.col("_r") - F.col("_d"), F.lit(0.0)), "_over": F.greatest(F.col("_d") - F.col("_r"), F.lit(0.0)), "_both": F.least("_r", "_d")})


def decompose(df: DataFrame, keys: list[str], minutes: float) -> DataFrame:
    """Sums of all MEASURES per key, for bins of ``minutes``, with RATIOS."""
    area = lambda c: total(F.col(c)) * minutes
    count = lambda c: tally(c) * F.lit(float(minutes))
    low, dlow, valid, up = F.col("_low"), F.col("_dlow"), F.col("_valid"), F.col("_up")
    out = parts(df).groupBy(*keys).agg(
        area("_r").alias("true_auc"), area("_d").alias("display_auc"), area("_hidden").alias("hidden_auc"), area("_over").alias("over_auc"), area("_both").alias("concordant_auc"),
        (total(F.when(~up, F.col("_hidden"))) * minutes).alias("hidden_unavailable_auc"), (total(F.when(up, F.col("_hidden"))) * minutes).alias("hidden_valid_auc"),
        count(valid).alias("valid_min"), count(valid & up).alias("available_min"), count(low).alias("true_low_min"), count(dlow).alias("display_low_min"), count(low & dlow).alias("both_low_min"),
        count(low & up & ~dlow).alias("normal_discordant_min"), count(valid & ~low & dlow).alias("low_discordant_min"), count(low & ~up).alias("unavailable_low_min"),
    )
    return with_ratios(out)


def sum_samples(rows: DataFrame, keys: list[str], thresholds: list[float], minutes: float, share: Column | float = 1.0) -> DataFrame:
    """The same sums from ``hold.samples(..., seen=True)``, per key and threshold, times ``share``; thresholds become rows after the sums.

    A row stands for the bins that show one sample. Its measures are sums over the list of their valid values; where none of these is low or the display is
    not low, they follow without another look at the list.
    """
    zero = F.lit(0.0)
    up, shown, valid = F.col("shown").isNotNull(), F.col("shown"), F.size("seen")
    below = lambda t: lambda x: x < t
    over_list = lambda low, f: F.aggregate(low, zero, lambda s, x: s + f(x))
    rows = rows.select(*keys, "shown", "seen", valid.alias("_valid"))
    order = sorted(range(len(thresholds)), key=lambda i: -thresholds[i])
    lists = "seen"
    sums: dict[str, Column] = {}
    for i in order:
        t, low, n = F.lit(float(thresholds[i])), F.col(f"_low{i}"), F.size(f"_low{i}")
        rows = rows.withColumn(f"_low{i}", F.filter(lists, below(t)))
        rows = rows.withColumn(f"_true{i}", F.when(n > 0, over_list(low, lambda x, t=t: t - x)).otherwise(zero))
        lists, dlow, both = f"_low{i}", up & (shown < t), (n > 0) & up & (shown < t)
        rows = rows.withColumns({
            f"_hidden{i}": F.when(both, over_list(low, lambda x: F.greatest(shown - x, zero))).otherwise(F.col(f"_true{i}")),
            f"_over{i}": F.when(dlow, (t - shown) * (F.col("_valid") - n)).otherwise(zero) + F.when(both, over_list(low, lambda x: F.greatest(x - shown, zero))).otherwise(zero),
            f"_both{i}": F.when(both, over_list(low, lambda x, t=t: F.least(t - x, t - shown))).otherwise(zero),
        })
        hidden, count = F.col(f"_hidden{i}"), lambda c, x: F.when(c, x).otherwise(0)
        sums |= {f"{m}_{i}": F.sum(x) for m, x in {
            "true_auc": F.col(f"_true{i}"), "display_auc": F.when(dlow, (t - shown) * F.col("_valid")).otherwise(zero), "hidden_auc": hidden, "over_auc": F.col(f"_over{i}"), "concordant_auc": F.col(f"_both{i}"),
            "hidden_unavailable_auc": F.when(~up, hidden).otherwise(zero), "hidden_valid_auc": F.when(up, hidden).otherwise(zero), "true_low_min": n, "display_low_min": count(dlow, F.col("_valid")), "both_low_min": count(dlow, n),
            "normal_discordant_min": count(up & (shown >= t), n), "low_discordant_min": count(dlow, F.col("_valid") - n), "unavailable_low_min": count(~up, n),
        }.items()}
    sums |= {"valid_min": F.sum("_valid"), "available_min": F.sum(F.when(up, F.col("_valid")).otherwise(0))}
    one = lambda i: F.struct(F.lit(float(thresholds[i])).alias("threshold"), *[F.col(f"{m}_{i}" if f"{m}_{i}" in sums else m).cast("double").alias(m) for m in MEASURES])
    out = rows.groupBy(*keys).agg(*[x.alias(m) for m, x in sums.items()]).select(*keys, F.explode(F.array(*[one(i) for i in range(len(thresholds))])).alias("_m"))
    factor = share * minutes if isinstance(share, Column) else F.lit(float(share * minutes))
    return with_ratios(out.select(*keys, "_m.threshold", *[(F.col(f"_m.{m}") * factor).alias(m) for m in MEASURES]))


def with_ratios(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "hdr": ratio("hidden_auc", "true_auc"), "odr": ratio("over_auc", "true_auc"), "net": ratio(F.col("over_auc") - F.col("hidden_auc"), F.col("true_auc")),
        "concordance": ratio("concordant_auc", "true_auc"), "availability": ratio("available_min", "valid_min"),
    })


def phase_means(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Means of the measures over phases; ratios are taken of the means."""
    return with_ratios(facts.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in MEASURES], F.count("*").alias("phases")))


def pooled(means: DataFrame, keys: list[str]) -> DataFrame:
    """Ratios of sums over cases, and rates per hour of valid time."""
    out = means.groupBy(*keys).agg(F.count_distinct("case_id").alias("cases"), *[F.sum(m).alias(m) for m in MEASURES])
    hours = F.col("valid_min") / 60
    return with_ratios(out).withColumns({"hidden_per_hour": ratio(F.col("hidden_auc"), hours), "over_per_hour": ratio(F.col("over_auc"), hours), "true_per_hour": ratio(F.col("true_auc"), hours)})


def identity_faults(facts: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """How many rows break an identity of the decomposition."""
    off = lambda a, b: tally(F.abs(a - b) > tolerance)
    c = F.col
    return facts.agg(
        F.count("*").alias("rows"), off(c("true_auc"), c("hidden_auc") + c("concordant_auc")).alias("true_parts"), off(c("display_auc"), c("over_auc") + c("concordant_auc")).alias("display_parts"),
        off(c("display_auc") - c("true_auc"), c("over_auc") - c("hidden_auc")).alias("net_parts"), off(c("hidden_auc"), c("hidden_unavailable_auc") + c("hidden_valid_auc")).alias("hidden_parts"),
    )


def displayed_low_minutes(df: DataFrame) -> DataFrame:
    """Adds displayed_low_min by algebra, and whether it lies between 0 and the valid minutes."""
    x = F.col("true_low_min") - F.col("unavailable_low_min") - F.col("normal_discordant_min") + F.col("low_discordant_min")
    return df.withColumn("displayed_low_min", x).withColumn("in_bounds", (x >= -1e-9) & (x <= F.col("valid_min") + 1e-9))
