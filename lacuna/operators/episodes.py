"""Below-threshold episodes as gaps and islands, and how a held display shows them.

Low is strictly below the threshold. Two definitions are kept apart: by tolerance a normal or missing point ends an episode when
it comes too late after the last low one; by bridging only observed normal bins may be bridged and a missing bin always splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.columns import dealt, ratio, tally, total

from . import hold


def tolerant(panel: DataFrame, step: float, least: float, tolerance: float) -> DataFrame:
    """Episodes of rows (case_id, threshold, bin, value): start, end (last low) bin, duration and burden."""
    w = Window.partitionBy("case_id", "threshold").orderBy("bin")
    low = panel.where(F.col("value") < F.col("threshold")).withColumn("gap", F.col("bin") - F.lag("bin").over(w))
    # the point that ends an episode is the first one whose distance to the last low point exceeds the tolerance
    split = F.when(F.col("gap").isNull() | ((F.col("gap") - 1) * step > tolerance), 1).otherwise(0)
    low = low.withColumn("split", split).withColumn("episode", F.sum("split").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = low.groupBy("case_id", "threshold", "episode").agg(F.min("bin").alias("start_bin"), F.max("bin").alias("end_bin"), F.count("*").alias("n_low"), F.sum((F.col("threshold") - F.col("value")) * (step / 60)).alias("auc"), F.min("value").alias("nadir"))
    return out.withColumn("duration", (F.col("end_bin") - F.col("start_bin") + 1) * F.lit(float(step))).where(F.col("duration") >= least)


def bridged(panel: DataFrame, gap_bins: Column | int, least_low: Column | int, keys: tuple = ("case_id", "threshold")) -> DataFrame:
    """Events of rows (keys, bin, value, threshold) that bridge at most ``gap_bins`` observed normal bins: start, end_excl, n_low, auc, nadir."""
    w = Window.partitionBy(*keys).orderBy("bin")
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = panel.withColumn("missing", F.sum(F.when(F.col("value").isNull(), 1).otherwise(0)).over(back))
    low = rows.where(F.col("value") < F.col("threshold"))
    split = F.when(F.lag("bin").over(w).isNull() | (F.col("bin") - F.lag("bin").over(w) - 1 > gap_bins) | (F.col("missing") != F.lag("missing").over(w)), 1).otherwise(0)
    low = low.withColumn("split", split).withColumn("event", F.sum("split").over(back))
    out = low.groupBy(*keys, "event").agg(F.min("bin").alias("start_bin"), (F.max("bin") + 1).alias("end_excl"), F.count("*").alias("n_low"), F.sum(F.col("threshold") - F.col("value")).alias("auc"), F.min("value").alias("nadir"), F.first(least_low if isinstance(least_low, Column) else F.lit(least_low)).alias("_least"))
    return out.where(F.col("n_low") >= F.col("_least")).drop("_least")


def on_show(samples: DataFrame, spans: DataFrame | None, first: str, last: str, steps: list[int]) -> DataFrame:
    """Spans of bins (case_id, ``first``, ``last``, ...) with the samples that are on show in them, and ``since``, the bin of the span from which on.

    A phase has one sample that stands at the first bin, taken there or before, and those that follow up to the last: an equi-join on bins with as many rows as
    a span has bins and an interval phases. Without ``spans`` they are those of the samples' panel (``hold.marked``), and nothing is joined or exchanged.
    """
    if spans is None:
        rows = samples.withColumn("_span", F.explode("spans")).select(*[c for c in samples.columns if c != "spans"], "_span.*").withColumnRenamed("_first", first)
        return rows.withColumn("since", F.greatest("bin", F.col(first)))
    spots = spans.withColumn("bin", F.explode(F.sequence(F.col(first) - (max(steps) - 1), F.col(last))))
    return dealt(spots).join(samples, ["case_id", "bin"]).where(F.col("bin") > F.col(first) - F.col("step")).withColumn("since", F.greatest("bin", F.col(first)))


def detected(samples: DataFrame, spans: DataFrame | None, first: str, last: str, steps: list[int], keys: list[str]) -> DataFrame:
    """Per span, step, phase and more ``keys``: the first bin at which the display is below the span's ``t``, NULL if there is none."""
    rows = on_show(samples, spans, first, last, steps)
    return rows.groupBy(*keys, "step", "phase").agg(F.min(F.when(F.col("shown") < F.col("t"), F.col("since"))).alias("first_bin"), F.first(first).alias(first))


def with_reference(rows: DataFrame, keys: tuple, step: float, thresholds: list[float]) -> DataFrame:
    """Adds for rows (keys, bin, value) and each threshold the burden before a bin and the next bin, or the one after the last, at which the reference breaks a stale run."""
    back = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*keys).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)  # from the end on, so that a frame only grows
    low = lambda t: F.when(F.col("value") < t, t - F.col("value")) * (step / 60)
    stop = lambda t: F.when((F.col("bin") >= 0) & (F.col("value").isNull() | (F.col("value") < t)), F.col("bin"))
    ts = [F.lit(float(t)) for t in thresholds]
    rows = rows.withColumn("_stops", F.array(*[F.coalesce(F.min(stop(t)).over(ahead), F.max("bin").over(ahead) + 1) for t in ts]))
    return rows.withColumn("_burdens", F.array(*[F.coalesce(F.sum(low(t)).over(back), F.lit(0.0)) for t in ts]))


def _spans(episodes: DataFrame, thresholds: list[float]) -> DataFrame:
    which = F.array_position(F.array(*[F.lit(float(t)) for t in thresholds]), F.col("threshold")).cast("int") - 1
    return episodes.select("case_id", "start_bin", "end_bin", which.alias("_i"), "episode", "auc")


def observability(samples: DataFrame, episodes: DataFrame, steps: list[int], step: float, margins: tuple, thresholds: list[float]) -> DataFrame:
    """Per case, threshold, episode, step and phase: detection, delay, time left, burden before it, and how long the display stays low after the end.

    The stale run counts bins from the end on until the reference is missing or low, or the display unavailable or normal. The burden before a bin, the next bin
    at which the reference breaks a run and the next sample of a phase that does are worked out once for each sample and threshold, before the join with episodes.
    """
    rows = with_reference(_cleared(samples, thresholds), ("case_id", "step"), step, thresholds)
    found = on_show(rows, _spans(episodes, thresholds).withColumn("_end", F.col("end_bin") + 1), "start_bin", "_end", steps)
    found = found.withColumns({"_burden": F.get("_burdens", F.col("_i")), "_ref": F.when(F.col("bin") == F.col("_end"), F.get("_stops", F.col("_i")))})
    return _observed(found, step, margins, thresholds)


def observed(panel: DataFrame, episodes: DataFrame, steps: list[int], step: float, margins: tuple, thresholds: list[float]) -> DataFrame:
    """``observability`` of the samples of a panel: the episodes are carried by its bins, so that only these are joined, and the samples exchanged once, by case and step."""
    rows = with_reference(hold.marked(panel, _spans(episodes, thresholds), "start_bin", F.col("end_bin") + 1, steps), ("case_id",), step, thresholds)
    known = lambda x: {"auc": F.when(F.col("bin") == x["_first"], x["auc"]), "_burden": F.when(F.col("bin") >= x["_first"], F.get("_burdens", x["_i"])), "_ref": F.when(F.col("bin") == x["end_bin"] + 1, F.get("_stops", x["_i"]))}
    full = lambda x: F.struct(*[x[c].alias(c) for c in ("_first", "end_bin", "_i", "episode")], *[v.alias(c) for c, v in known(x).items()])
    rows = rows.select("case_id", "bin", "value", F.transform("spans", full).alias("spans"))
    return _observed(on_show(_cleared(hold.samples(rows, steps), thresholds), None, "start_bin", "end_bin", steps), step, margins, thresholds)


def _cleared(samples: DataFrame, thresholds: list[float]) -> DataFrame:
    """Adds for each threshold the next sample of the phase, this one included, that is unavailable or not low."""
    after = Window.partitionBy("case_id", "step", "phase").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    clear = lambda t: F.when(F.col("shown").isNull() | (F.col("shown") >= t), F.col("bin"))
    return samples.withColumn("_clears", F.array(*[F.min(clear(F.lit(float(t)))).over(after) for t in thresholds]))


def _observed(found: DataFrame, step: float, margins: tuple, thresholds: list[float]) -> DataFrame:
    """From rows of an episode and a sample; ``auc`` and ``_burden`` are known at its first bin at least, ``_ref`` at the first bin after it."""
    keys = ["case_id", "_i", "episode", "start_bin", "end_bin", "step"]  # the threshold's number: keys that are doubles would be dealt anew for the aggregation
    end = F.col("end_bin") + 1
    found = found.withColumn("threshold", F.get(F.array(*[F.lit(float(t)) for t in thresholds]), F.col("_i")))
    seen = (F.col("shown") < F.col("threshold")) & (F.col("bin") <= F.col("end_bin"))
    out = found.groupBy(*keys, "phase").agg(
        F.first("threshold").alias("threshold"), F.max("auc").alias("auc"), F.min(F.when(seen, F.greatest("bin", "start_bin"))).alias("first_bin"),
        F.min_by(F.when(F.col("bin") >= F.col("start_bin"), F.col("_burden")), F.when(seen, F.greatest("bin", "start_bin"))).alias("_until"), F.max(F.when(F.col("bin") == F.col("start_bin"), F.col("_burden"))).alias("_at_start"),
        F.max(F.when(F.col("bin") > end - F.col("step"), F.get("_clears", F.col("_i")))).alias("_clear"), F.max("_ref").alias("_ref"),  # of the sample that stands at the first bin after the end
    )
    every = Window.partitionBy(*keys)  # the phase that samples at a bin knows what stands there; an episode that ends with the panel has no bin after it
    out = out.withColumns({"auc": F.max("auc").over(every), "_before": F.coalesce(F.col("_until") - F.max("_at_start").over(every), F.lit(0.0)), "break_bin": F.coalesce(F.least(F.max("_ref").over(every), F.when(F.col("_clear").isNotNull(), F.greatest("_clear", end))), end)})
    recovery = F.col("end_bin") + 1
    hit = F.col("first_bin").isNotNull()
    out = out.withColumns({
        "detected": hit, "delay": (F.col("first_bin") - F.col("start_bin")) * step, "left": (recovery - F.col("first_bin")) * step,
        "auc_before": F.when(hit, F.col("_before")).otherwise(F.col("auc")), "stale": F.when(hit, F.coalesce(F.col("break_bin") - recovery, F.lit(0)) * step),
    })
    return out.withColumns({f"left_{k}": F.col("detected") & (F.col("left") >= m) for k, m in enumerate(margins, 1)}).drop("_i", "_until", "_at_start", "_clear", "_ref", "_before", "break_bin")


def observability_sums(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Sums over episode-phase pairs and what follows from them."""
    out = pairs.groupBy(*keys).agg(
        F.count("*").alias("pairs"), tally(F.col("detected")).alias("detected_pairs"), total(F.col("delay")).alias("delay_sum"), total(F.col("left")).alias("left_sum"), total(F.col("stale")).alias("stale_sum"),
        tally(F.col("left_1")).alias("left_1_pairs"), tally(F.col("left_2")).alias("left_2_pairs"), F.sum("auc").alias("auc_sum"), F.sum("auc_before").alias("auc_before_sum"),
    )
    return out.withColumns({"miss_fraction": 1 - ratio("detected_pairs", "pairs"), "mean_delay": ratio("delay_sum", "detected_pairs"), "mean_left": ratio("left_sum", "detected_pairs"), "mean_stale": ratio("stale_sum", "detected_pairs"), "p_left_1": ratio("left_1_pairs", "pairs"), "p_left_2": ratio("left_2_pairs", "pairs"), "auc_before_share": ratio("auc_before_sum", "auc_sum")})


def classified(panel: DataFrame, events: DataFrame, steps: list[int]) -> DataFrame:
    """``classes`` of the samples of a panel: the events are carried by its bins, so that only these are joined, and the samples exchanged once, by case and step."""
    spans = events.select("case_id", F.col("threshold").alias("t"), "event", "start_bin", "end_excl", "n_low")
    return classes(hold.samples(hold.marked(panel, spans, "start_bin", F.col("end_excl") - 1, steps), steps), None, steps)


def classes(samples: DataFrame, events: DataFrame | None, steps: list[int]) -> DataFrame:
    """Per event and schedule: fresh (a low value sampled inside), inherited (only held low values), never; carry-in and whether the first low one is inherited."""
    spans = None if events is None else events.withColumnRenamed("threshold", "t").withColumn("_last", F.col("end_excl") - 1)
    rows = on_show(samples, spans, "start_bin", "_last", steps)
    low = F.col("shown") < F.col("t")
    fresh = low & (F.col("held_bin") == F.col("bin")) & (F.col("bin") >= F.col("start_bin"))
    out = rows.groupBy("case_id", F.col("t").alias("threshold"), "event", "step", "phase", "start_bin", "end_excl", "n_low").agg(
        F.coalesce(F.bool_or(fresh), F.lit(False)).alias("fresh"), F.coalesce(F.bool_or(low), F.lit(False)).alias("any_low"),
        F.coalesce(F.bool_or(low & (F.col("bin") <= F.col("start_bin")) & (F.col("held_bin") < F.col("start_bin"))), F.lit(False)).alias("carry_in"),
        F.min_by("held_bin", F.when(low, F.col("since"))).alias("_first_held"),
    )
    kind = F.when(F.col("fresh"), "fresh").when(F.col("any_low"), "inherited").otherwise("never")
    return out.withColumns({"class": kind, "first_inherited": F.coalesce(F.col("_first_held") < F.col("start_bin"), F.lit(False))}).drop("fresh", "any_low", "_first_held")


def strata(column: str, edges: list[float], labels: list[str]) -> Column:
    """Label of the first edge that the value lies below; the last label otherwise."""
    out = None
    for e, label in zip(edges, labels, strict=False):
        out = F.when(F.col(column) < e, label) if out is None else out.when(F.col(column) < e, label)
    return out.otherwise(labels[-1])
