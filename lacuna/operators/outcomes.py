"""Outcomes from windows of measurements, and tables about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.columns import ratio, tally

from . import ranks

DAY = 86400.0


def latest_before(labs: DataFrame, anchors: DataFrame, within: float) -> DataFrame:
    """case_id, value: the last measurement at or before the anchor and not older than ``within``; the larger value at equal times."""
    rows = labs.join(anchors, "case_id").where((F.col("sec") <= F.col("anchor")) & (F.col("sec") >= F.col("anchor") - within))
    last = rows.groupBy("case_id").agg(F.max(F.struct("sec", "value"))["value"].alias("value"))
    return anchors.select("case_id").join(last, "case_id", "left")


def windowed(labs: DataFrame, cases: DataFrame, rise: float, fold: float, absolute: float) -> DataFrame:
    """Outcome of measurements strictly after the anchor, up to 7 days and to discharge if known.

    ``cases`` has case_id, anchor, discharge, baseline. An event is a rise of ``rise`` within 48 h or a ratio of ``fold`` within 7 days; stage 2
    from a ratio of 2, stage 3 from 3 or from ``absolute`` with an acute rise. Not evaluable (NULL) without baseline or measurement.
    """
    c = F.col
    rows = labs.join(cases, "case_id").where((c("sec") > c("anchor")) & (c("sec") <= c("anchor") + 7 * DAY) & (c("discharge").isNull() | (c("sec") <= c("discharge"))))
    early = c("sec") <= c("anchor") + 2 * DAY
    qualifies = (early & (c("value") - c("baseline") >= rise)) | (ratio("value", "baseline") >= fold)
    found = rows.groupBy("case_id").agg(F.max(F.when(early, c("value"))).alias("max_2d"), F.max("value").alias("max_7d"), tally(early).alias("n_2d"), F.count("*").alias("n_7d"), F.min(F.when(qualifies, (c("sec") - c("anchor")) / 3600)).alias("first_hour"))
    out = cases.join(found, "case_id", "left").fillna(0, ["n_2d", "n_7d"]).withColumns({"delta": c("max_2d") - c("baseline"), "times": ratio("max_7d", "baseline"), "evaluable": F.coalesce(c("baseline") > 0, F.lit(False)) & c("max_7d").isNotNull()})
    acute, relative = F.coalesce(c("delta") >= rise, F.lit(False)), F.coalesce(c("times") >= fold, F.lit(False))
    stage = F.when((c("times") >= 3) | ((c("max_7d") >= absolute) & acute), 3).when(c("times") >= 2, 2).when(acute | relative, 1).otherwise(0)
    return out.withColumns({"event": F.when(c("evaluable"), acute | relative), "stage": F.when(c("evaluable"), stage)})


def two_by_two(df: DataFrame, exposure: Column, outcome: Column) -> DataFrame:
    """One row: the four cells, whether an odds ratio can be estimated, the crude one, and Fisher's two-sided p.

    The p value adds the probabilities of all tables with the same margins that are no likelier than the observed one. A table's probability follows from that of the one with
    one case less in the first cell, so their logarithms are a running sum over the first cell; together they are 1.
    """
    c = F.col
    t = df.agg(tally(exposure & outcome).alias("a"), tally(exposure & ~outcome).alias("b"), tally(~exposure & outcome).alias("c"), tally(~exposure & ~outcome).alias("d"))
    least, most = F.greatest(F.lit(0).cast("long"), c("a") - c("d")), F.least(c("a") + c("b"), c("a") + c("c"))
    support = t.withColumn("_x", F.explode(F.sequence(least, most)))
    # log of the next table's probability over this one's; the last table has no next one
    up = F.when(c("_x") < most, F.ln((c("a") + c("b") - c("_x")).cast("double")) + F.ln((c("a") + c("c") - c("_x")).cast("double")) - F.ln(c("_x") + 1.0) - F.ln(c("d") - c("a") + c("_x") + 1.0)).otherwise(0.0)
    rows = ranks.running(support, [c("_x")], up, "_lp")
    ends = rows.agg(F.max("_lp").alias("_top"), F.max(F.when(c("_x") == c("a"), c("_lp"))).alias("_at"))
    rows = rows.join(F.broadcast(ends), F.lit(True))  # one row
    weight = F.exp(c("_lp") - c("_top"))
    p = rows.groupBy("a", "b", "c", "d").agg((F.sum(F.when(c("_lp") <= c("_at") + 1e-7, weight).otherwise(0.0)) / F.sum(weight)).alias("fisher_p"))
    sound = F.least("a", "b", "c", "d") > 0
    return p.withColumns({"estimable": sound, "odds_ratio": F.when(sound, c("a") * c("d") / (c("b") * c("c"))), "fisher_p": F.least("fisher_p", F.lit(1.0))})


def spline_basis(df: DataFrame, value: str, knots: DataFrame, key: str | None = None) -> DataFrame:
    """Adds s1, s2, s3: quadratic B-spline without intercept with one inner knot. ``knots`` is one row: lo, mid, hi; or one for each ``key``."""
    c, x = F.col, F.col(value)
    rows = df.join(knots, key) if key else df.join(F.broadcast(knots), F.lit(True))  # one row
    left = x < c("mid")
    a, m, z = c("lo"), c("mid"), c("hi")
    s1 = F.when(left, (x - a) / (m - a) * (m - x) / (m - a) + (z - x) / (z - a) * (x - a) / (m - a)).otherwise((z - x) / (z - a) * (z - x) / (z - m))
    s2 = F.when(left, (x - a) / (z - a) * (x - a) / (m - a)).otherwise((x - a) / (z - a) * (z - x) / (z - m) + (z - x) / (z - m) * (x - m) / (z - m))
    s3 = F.when(left, 0.0).otherwise(((x - m) / (z - m)) ** 2)
    return rows.withColumns({"s1": s1, "s2": s2, "s3": s3}).drop("lo", "mid", "hi")


def stability(df: DataFrame, least_events: float = 5.0, widest: float = 10.0) -> DataFrame:
    """Adds stable and failed (listed) to rows of label, converged, estimate, low, high, events, parameters."""
    c = F.col
    checks = {
        "converged": c("converged"), "finite": c("estimate").isNotNull() & c("low").isNotNull() & c("high").isNotNull(), "positive": c("low") > 0,
        "events": c("events") / c("parameters") >= least_events, "width": c("high") / c("low") <= widest,
    }
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in checks.items()]))
    return df.withColumn("failed", F.array_join(failed, ",")).withColumn("stable", F.col("failed") == "")
