"""Regular grids from raw readings, and what can be said of their quality.

A panel is ``case_id, bin, value`` with every bin of a case present; a missing value is NULL and is
never dropped before a window function.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.columns import dealt, ratio, tally, total


def window_bounds(cases: DataFrame, kind: str, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds start_sec (0 at least, 0 if missing) and end_sec of the named analysis window."""
    if kind not in columns:
        raise ValueError(f"unknown window: {kind}")
    start, end = columns[kind]
    return cases.withColumns({"start_sec": F.greatest(F.coalesce(F.col(start), F.lit(0.0)), F.lit(0.0)), "end_sec": F.col(end)})


def _binned(readings: DataFrame, step: float, low: float, high: float, bins: Column) -> DataFrame:
    rows = readings.where(F.col("value").between(low, high)).withColumn("bin", F.floor(F.col("sec") / step).cast("int"))
    return rows.where((F.col("bin") >= 0) & (F.col("bin") < bins))


def bin_medians(readings: DataFrame, step: float, low: float, high: float, bins: Column, keys: tuple = ("case_id",)) -> DataFrame:
    """Median per bin of the readings (sec from the window's start) that lie in [low, high]."""
    return _binned(readings, step, low, high, bins).groupBy(*keys, "bin").agg(F.median("value").alias("value"))


def median_grid(readings: DataFrame, cases: DataFrame, step: float, low: float, high: float, channels: dict[str, Column] | None = None) -> DataFrame:
    """Panel of every case: ``cases`` has case_id, start_sec, end_sec; an empty window gives no bins. With ``channels`` a column of medians for each, of the readings that meet its condition.

    Readings and a missing value for each bin are exchanged once, by case; the number of partitions is that of a shuffle, whatever their size: what follows by case takes them as they are.
    """
    bounds = cases.where("end_sec > start_sec").select("case_id", "start_sec", F.ceil((F.col("end_sec") - F.col("start_sec")) / step).cast("int").alias("n_bins"))
    shifted = readings.join(bounds, "case_id").withColumn("sec", F.col("sec") - F.col("start_sec"))
    kinds = {"value": F.lit(True)} if channels is None else channels
    found = _binned(shifted, step, low, high, F.col("n_bins")).select("case_id", "bin", *[F.when(on, F.col("value")).alias(n) for n, on in kinds.items()])
    spine = bounds.select("case_id", F.explode(F.sequence(F.lit(0), F.col("n_bins") - 1)).alias("bin"))
    rows = found.unionByName(spine, allowMissingColumns=True).repartition(int(readings.sparkSession.conf.get("spark.sql.shuffle.partitions")), "case_id")
    return rows.groupBy("case_id", "bin").agg(*[F.median(n).alias(n) for n in kinds])


def coverage(panel: DataFrame, keys: tuple, step_min: float, least_share: float, least_min: float) -> DataFrame:
    """Per key: bins, valid bins, share, minutes and whether both least values are met."""
    rows = panel.groupBy(*keys).agg(F.count("*").alias("bins"), F.count("value").alias("valid"))
    rows = rows.withColumns({"share": F.col("valid") / F.col("bins"), "minutes": F.col("bins") * step_min})
    return rows.withColumn("include", (F.col("share") >= least_share) & (F.col("minutes") >= least_min))


def grid_quality(panel: DataFrame, least_share: float, same: float = 1e-9) -> DataFrame:
    """Per case: bins, valid, missing, share, repeats of the previous valid value, include."""
    w = Window.partitionBy("case_id").orderBy("bin")
    earlier = F.last(F.col("value"), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = panel.withColumn("repeat", F.abs(F.col("value") - earlier) < same)
    out = rows.groupBy("case_id").agg(F.count("*").alias("bins"), F.count("value").alias("valid"), tally(F.col("repeat")).alias("repeats"))
    return out.withColumns({"missing": F.col("bins") - F.col("valid"), "share": F.col("valid") / F.col("bins")}).withColumn("include", F.col("share") >= least_share)


def complete_bins(panel: DataFrame, step: float, duration: Column) -> DataFrame:
    """Bins that end within the duration, and whether a bin follows its predecessor from 0 on."""
    w = Window.partitionBy("case_id").orderBy("bin")
    kept = panel.where((F.col("bin") + 1) * step <= duration)
    return kept.withColumn("in_order", F.col("bin") == F.coalesce(F.lag("bin").over(w) + 1, F.lit(0)))


def cleaned_track(rows: DataFrame, start: float, end: float) -> DataFrame:
    """Rows (case_id, sec, value, row_no) without conflicting times and exact repeats, cut to [start, end] and shifted."""
    held = rows.where("sec is not null and value is not null").groupBy("case_id", "sec").agg(F.min("value").alias("value"), F.max("value").alias("top"))
    return held.where((F.col("value") == F.col("top")) & F.col("sec").between(start, end)).select("case_id", (F.col("sec") - start).alias("sec"), "value")


def track_faults(rows: DataFrame) -> DataFrame:
    """Per case: times with several values, steps back in source order, exact repeats."""
    w = Window.partitionBy("case_id").orderBy("row_no")
    back = rows.where("sec is not null").withColumn("back", F.col("sec") < F.lag("sec").over(w)).groupBy("case_id").agg(tally(F.col("back")).alias("backward"))
    times = rows.groupBy("case_id", "sec").agg(F.count_distinct("value").alias("kinds"))
    conflicts = times.groupBy("case_id").agg(tally(F.col("kinds") > 1).alias("conflicts"))
    spots = rows.groupBy("case_id", "sec", "value").agg((F.count("*") - 1).alias("extra")).groupBy("case_id").agg(F.sum("extra").alias("repeats"))
    return back.join(conflicts, "case_id").join(spots, "case_id")


def islands(rows: DataFrame, keys: tuple, flag: Column) -> DataFrame:
    """Rows whose flag holds, with ``island``: equal within an unbroken run of bins."""
    w = Window.partitionBy(*keys).orderBy("bin")
    return rows.where(flag).withColumn("island", F.col("bin") - F.row_number().over(w))


def longest_runs(rows: DataFrame, keys: tuple, flag: Column, name: str = "longest") -> DataFrame:
    """Longest unbroken run of the flag per key; keys without one are absent."""
    return islands(rows, keys, flag).groupBy(*keys, "island").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.max("n").alias(name))


def plateaus(panel: DataFrame, width: int, below: float, spread: float) -> DataFrame:
    """Per case: whether ``width`` successive valid bins have a median under ``below`` and a range of ``spread`` at most."""
    w = Window.partitionBy("case_id").orderBy("bin").rowsBetween(0, width - 1)
    held = panel.select("case_id", "bin", F.collect_list("value").over(w).alias("values"))
    v = F.array_sort("values")
    middle = (F.get(v, F.lit((width - 1) // 2)) + F.get(v, F.lit(width // 2))) / 2
    flat = (F.size(v) == width) & (middle < below) & (F.get(v, F.lit(width - 1)) - F.get(v, F.lit(0)) <= spread)
    return held.groupBy("case_id").agg(F.coalesce(F.bool_or(flat), F.lit(False)).alias("plateau"))


def supported_duration(rows: DataFrame, duration: float, most_gap: float) -> DataFrame:
    """Per case: the gaps between records, the last one up to ``duration``, each cut to [0, most_gap], added up."""
    w = Window.partitionBy("case_id").orderBy("sec")
    gap = F.lead("sec", 1).over(w)
    gaps = rows.select("case_id", F.least(F.greatest(F.coalesce(gap, F.lit(duration)) - F.col("sec"), F.lit(0.0)), F.lit(most_gap)).alias("gap"))
    return gaps.groupBy("case_id").agg(F.sum("gap").alias("supported_sec"))


def interpolated(events: DataFrame, panel: DataFrame, step: float) -> DataFrame:
    """Events (case_id, sec) with the panel's value at their time: linear between bins, missing bins at the case's median."""
    middle = panel.groupBy("case_id").agg(F.median("value").alias("middle"), F.max("bin").alias("last_bin"))
    filled = panel.join(middle, "case_id").select("case_id", "bin", F.coalesce("value", "middle").alias("v"))
    at = F.least(F.greatest(F.col("sec") / step, F.lit(0.0)), F.col("last_bin").cast("double"))
    rows = events.join(middle, "case_id").withColumn("at", at).withColumns({"lo": F.floor("at").cast("int"), "hi": F.ceil("at").cast("int")})
    lower = filled.select("case_id", F.col("bin").alias("lo"), F.col("v").alias("v_lo"))
    upper = filled.select("case_id", F.col("bin").alias("hi"), F.col("v").alias("v_hi"))
    rows = rows.join(lower, ["case_id", "lo"]).join(upper, ["case_id", "hi"])
    return rows.withColumn("interpolated", F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) * (F.col("at") - F.col("lo"))).drop("at", "lo", "hi", "v_lo", "v_hi", "middle", "last_bin")


def wave_bins(samples: DataFrame, step: float, expected: int) -> DataFrame:
    """Per case and bin of raw samples: coverage, mean, 5th and 95th percentile, population deviation, span."""
    rows = samples.withColumn("bin", F.floor(F.col("sec") / step).cast("int"))
    q = F.percentile("value", F.array(F.lit(0.05), F.lit(0.95)))
    out = rows.groupBy("case_id", "bin").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), q.alias("q"))
    out = out.select("case_id", "bin", F.least(F.col("n") / expected, F.lit(1.0)).alias("coverage"), "mean", "sd", F.get("q", F.lit(0)).alias("p05"), F.get("q", F.lit(1)).alias("p95"))
    return out.withColumn("span", F.col("p95") - F.col("p05"))


def wave_peaks(samples: DataFrame, step: float, distance: float, prominence: float) -> DataFrame:
    """Per case and bin: peaks of the samples, by the rules of ``peak_count``; a missing sample stands at the bin's median."""

    def peaks(values: np.ndarray) -> int:
        v = np.asarray(values, float)
        if not np.isfinite(v).all():
            v = np.where(np.isfinite(v), v, np.nanmedian(v) if np.isfinite(v).any() else 0.0)
        return peak_count(v.tolist(), distance, prominence)

    @F.pandas_udf("int")
    def counted(lists: pd.Series) -> pd.Series:
        return lists.map(peaks)

    # a missing value after the others of its time
    own = F.struct(F.col("sec").isNull().alias("n"), "sec", F.col("value").isNull().alias("m"), F.col("value").cast("double").alias("v"))
    rows = samples.select(F.col("case_id").cast("long").alias("case_id"), F.floor(F.col("sec") / step).cast("int").alias("bin"), own.alias("_s"))
    lists = rows.groupBy("case_id", "bin").agg(F.sort_array(F.collect_list("_s"))["v"].alias("_v"))
    return lists.select("case_id", "bin", counted("_v").alias("peaks"))


def peak_count(v: list[float], distance: float, prominence: float) -> int:
    """Peaks that keep their distance and then stand out.

    A peak is a sample, or the middle of a run of equal ones, with lower neighbours on both sides. Of peaks nearer than ``distance`` samples the highest stays (of
    equal ones the last), whatever its prominence; of those that stay, the ones count that rise ``prominence`` above the higher of the two lowest points
    between them and a higher sample, or the end.
    """
    tops, i = [], 1
    while i < len(v) - 1:
        j = i
        while j < len(v) - 1 and v[j + 1] == v[i]:
            j += 1
        if v[i - 1] < v[i] and j < len(v) - 1 and v[j + 1] < v[i]:
            tops.append((i + j) // 2)
        i = j + 1
    gone = [False] * len(tops)
    for k in sorted(range(len(tops)), key=lambda k: (v[tops[k]], k), reverse=True):
        if not gone[k]:
            for way in (-1, 1):
                n = k + way
                while 0 <= n < len(tops) and abs(tops[n] - tops[k]) < distance:
                    gone[n], n = True, n + way
    left, right = _lows(v), _lows(v[::-1])[::-1]
    return sum(not g and v[t] - max(left[t], right[t]) >= prominence for t, g in zip(tops, gone, strict=True))


def _lows(v: list[float]) -> list[float]:
    """For each sample the lowest one back to the last higher sample, by a stack of falling values, each with the lowest one since the value below it."""
    stack: list[tuple[float, float]] = []
    out = []
    for x in v:
        low = x
        while stack and stack[-1][0] <= x:
            low = min(low, stack.pop()[1])
        stack.append((x, low))
        out.append(low)
    return out


def pulse_like(coverage: float, span: float, least: int, most: int) -> Column:
    """Of rows with coverage, span and peaks: enough samples, enough span, and a plausible number of peaks."""
    return F.coalesce((F.col("coverage") >= coverage) & (F.col("span") >= span) & F.col("peaks").between(least, most), F.lit(False))


def decoded_times(samples: DataFrame, start: Column, interval: Column) -> DataFrame:
    """Samples numbered by ``idx`` with their time; an interval outside (0, 1] is an error."""
    sound = F.assert_true((interval > 0) & (interval <= 1), F.lit("sampling interval outside (0, 1]"))
    return samples.withColumn("sec", F.when(sound.isNull(), start + F.col("idx") * interval))


def flagged_runs(panel: DataFrame, flag: Column) -> DataFrame:
    """Adds run: the length of the unbroken run of flagged bins that a bin is in (0: not flagged)."""
    rows = panel.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    w = Window.partitionBy("case_id").orderBy("bin")
    rows = rows.withColumn("_breaks", F.sum(F.when(F.col("_flag"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = tally(F.col("_flag")).over(Window.partitionBy("case_id", "_breaks"))
    return rows.withColumn("run", F.when(F.col("_flag"), run).otherwise(0)).drop("_flag", "_breaks")


def masked(panel: DataFrame, flag: Column, least_run: int) -> DataFrame:
    """Adds ``masked``: in an unbroken run of at least ``least_run`` flagged bins."""
    return flagged_runs(panel, flag).withColumn("masked", F.col("run") >= least_run).drop("run")


def first_bins(panel: DataFrame, width: int) -> DataFrame:
    """Adds ``masked``: among the ``width`` bins from the first valid one of the case."""
    first = F.min(F.when(F.col("value").isNotNull(), F.col("bin"))).over(Window.partitionBy("case_id"))
    return panel.withColumn("masked", F.coalesce((F.col("bin") >= first) & (F.col("bin") < first + width), F.lit(False)))


def unmasked(panel: DataFrame) -> DataFrame:
    return panel.withColumn("value", F.when(~F.col("masked"), F.col("value")))


def mask_intervals(rows: DataFrame, keys: tuple, step: float, threshold: float) -> DataFrame:
    """Runs of masked bins: start, end_excl (seconds), bins, median and burden of the removed values."""
    runs = islands(rows, keys, F.col("masked"))
    out = runs.groupBy(*keys, "island").agg((F.min("bin") * step).alias("start_sec"), ((F.max("bin") + 1) * step).alias("end_excl_sec"), F.count("*").alias("bins"), F.median("value").alias("median"), F.sum(F.greatest(threshold - F.col("value"), F.lit(0.0)) * (step / 60)).alias("removed_auc"))
    return out.drop("island")


def mask_faults(before: DataFrame, after: DataFrame) -> DataFrame:
    """Counts of what a masked panel must not do: add or lose bins, change a value, fill in a missing one."""
    a, b = before.select("case_id", "bin", F.col("value").alias("a"), F.lit(True).alias("in_a")), after.select("case_id", "bin", F.col("value").alias("b"), F.lit(True).alias("in_b"))
    rows = a.join(b, ["case_id", "bin"], "full_outer")
    return rows.agg(
        tally(F.col("in_b").isNull()).alias("lost"), tally(F.col("in_a").isNull()).alias("added"), tally(F.col("a") != F.col("b")).alias("changed"),
        tally(F.col("a").isNull() & F.col("b").isNotNull()).alias("imputed"), tally(F.col("a").isNotNull() & F.col("b").isNull()).alias("masked"),
    )


def reconciled(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-8) -> DataFrame:
    """One row: keys in one table only, and per value the largest difference and how many exceed the tolerance."""
    left = a.select(*keys, *[F.col(v).alias(f"a_{v}") for v in values], F.lit(True).alias("in_a"))
    right = b.select(*keys, *[F.col(v).alias(f"b_{v}") for v in values], F.lit(True).alias("in_b"))
    rows = left.join(right, keys, "full_outer")
    off = {v: F.abs(F.col(f"a_{v}") - F.col(f"b_{v}")) for v in values}
    return rows.agg(
        F.count("*").alias("rows"), tally(F.col("in_b").isNull()).alias("only_first"), tally(F.col("in_a").isNull()).alias("only_second"),
        *[F.max(off[v]).alias(f"{v}_largest") for v in values], *[tally((off[v] > tolerance) | (F.col(f"a_{v}").isNull() != F.col(f"b_{v}").isNull())).alias(f"{v}_off") for v in values],
    )


def numeric_screen(panel: DataFrame, names: list[str], bins: int, rules: dict[str, Column], threshold: float, minutes: float) -> DataFrame:
    """Longest run of each rule over the first ``bins`` bins from the first valid one of the first channel, and where its area below the threshold lies.

    ``rules`` are conditions over the channels ``names`` of the panel and ``jump``, the change of the first channel between neighbouring bins. The areas: of the
    whole case, of its first ``bins`` bins, and of as many from the first valid one; the latter two also as shares of the whole. All of it is one pass over the bins of a case in order.
    """
    by_bin = Window.partitionBy("case_id").orderBy("bin")
    back = by_bin.rowsBetween(Window.unboundedPreceding, 0)
    lead, bin_ = F.col(names[0]), F.col("bin")
    first = F.min(F.when(lead.isNotNull(), bin_)).over(back)  # NULL before it, where nothing is inside
    rows = panel.withColumns({"_first": first, "jump": F.abs(lead - F.lag(names[0]).over(by_bin)), "_before": F.lag("bin").over(by_bin)})
    rows = rows.withColumn("_in", F.coalesce((bin_ >= F.col("_first")) & (bin_ < F.col("_first") + bins), F.lit(False)))
    # the last bin up to this one that does not belong to the run
    held = {n: F.col("_in") & F.coalesce(rule, F.lit(False)) for n, rule in rules.items()}
    gap = F.col("_before").isNull() | (bin_ - F.col("_before") > 1)
    rows = rows.withColumns({f"_{n}": bin_ - F.max(F.when(~on, bin_).when(gap, bin_ - 1)).over(back) for n, on in held.items()})
    area = lambda on: total(F.when(on & (lead < threshold), (threshold - lead) * minutes))
    paired = F.col("_in") & ~F.greatest(*[F.col(n).isNull() for n in names])
    out = rows.groupBy("case_id").agg(
        tally(F.col("_in")).alias("screened"), tally(paired).alias("paired"), *[F.coalesce(F.max(f"_{n}"), F.lit(0)).cast("long").alias(n) for n in rules],
        area(F.lit(True)).alias("auc"), area(bin_ < bins).alias("start_auc"), area(F.col("_in")).alias("first_auc"),
    ).where("screened > 0")
    return out.withColumns({"start_share": ratio("start_auc", "auc"), "first_share": ratio("first_auc", "auc")})


def share_of(a: str, b: str) -> Column:
    return ratio(a, b)
