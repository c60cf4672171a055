"""Sample-and-hold displays of a panel.

All phases of an interval come from one window: within each residue class of bins the last valid value is carried
forward, and the display of phase p at bin b is the carried value of the newest bin up to b in class p. A bin is sampled by one phase
of an interval, so ``samples`` has a row for each bin and interval however many phases there are; what a phase shows changes at
its samples only. Sums and searches go over these rows; ``by_phase`` lists every phase at every bin, where that is asked for.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.columns import dealt

from . import asof, ranks, scan

_BACK = (Window.unboundedPreceding, 0)


def _by_bin(*more: str):
    return Window.partitionBy("case_id", *more).orderBy("bin")


def held(panel: DataFrame, selected: Column) -> DataFrame:
    """Adds held_bin and shown: the last valid value at a selected bin, and its bin. A missing sample leaves the earlier one standing."""
    last = F.last(F.when(selected & F.col("value").isNotNull(), F.struct(F.col("bin").alias("b"), F.col("value").alias("v"))), ignorenulls=True).over(_by_bin().rowsBetween(*_BACK))
    return panel.withColumn("_last", last).withColumns({"held_bin": F.col("_last.b"), "shown": F.col("_last.v")}).drop("_last")


def on_schedule(step: int, phase: int) -> Column:
    return F.pmod(F.col("bin") - phase, F.lit(step)) == 0


def limited(display: DataFrame, most: int) -> DataFrame:
    """Nothing is shown that is older than ``most`` bins."""
    old = F.col("bin") - F.col("held_bin") > most
    return display.withColumns({"shown": F.when(~old, F.col("shown")), "held_bin": F.when(~old, F.col("held_bin"))})


def initialised(display: DataFrame) -> DataFrame:
    """Before the first scheduled sample the first valid value is shown."""
    first = F.first(F.when(F.col("value").isNotNull(), F.struct(F.col("bin").alias("b"), F.col("value").alias("v"))), ignorenulls=True).over(Window.partitionBy("case_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = display.withColumn("_first", first)
    early = F.col("held_bin").isNull() & (F.col("bin") >= F.col("_first.b"))
    return rows.withColumns({"shown": F.when(early, F.col("_first.v")).otherwise(F.col("shown")), "held_bin": F.when(early, F.col("_first.b")).otherwise(F.col("held_bin"))}).drop("_first")


def marked(panel: DataFrame, spans: DataFrame, first: str, last: Column, steps: list[int]) -> DataFrame:
    """Adds ``spans``: those of (case_id, ``first``, ...) up to ``last`` during which a sample of the bin, or at bin 0 one before it, may be on show. Their first bin is ``_first``.

    All rows of a case are in one of as many partitions as a shuffle has, whatever their size, since samples multiply them afterwards.
    """
    parts = int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    more = [c for c in spans.columns if c not in ("case_id", first)]
    spots = spans.select("case_id", F.explode(F.sequence(F.greatest(F.col(first) - (max(steps) - 1), F.lit(0)), last)).alias("bin"), F.struct(F.col(first).alias("_first"), *more).alias("_span"))
    return panel.join(dealt(spots.groupBy("case_id", "bin").agg(F.collect_list("_span").alias("spans"))), ["case_id", "bin"], "left").repartition(parts, "case_id")


def samples(panel: DataFrame, steps: list[int], seen: bool = False) -> DataFrame:
    """case_id, step, phase, bin, value, held_bin, shown: a row for each sample, which stands for the ``step`` bins from its own on.

    A phase p > 0 also has a row at bin p - step, a negative one, for the bins before its first sample: it shows nothing. ``seen`` adds the valid
    values of the bins that a row stands for, and ``bins``, how many of them the panel has. The panel must be complete from bin 0 on. Of the ``spans`` of a
    panel that is ``marked`` a row keeps those during which it is on show.
    """
    more = ["spans"] if "spans" in panel.columns else []
    most, common = max(steps), math.lcm(*steps)
    every = F.when(F.col("bin") == 0, F.sequence(F.lit(1 - most), F.lit(0))).otherwise(F.array("bin"))
    rows = panel.select("case_id", F.col("bin").alias("_own"), "value", *more, F.explode(every).alias("bin")).withColumn("step", F.explode(F.array(*[F.lit(s) for s in steps])))
    if more:
        rows = rows.withColumn("spans", F.filter("spans", lambda x: x["_first"] < F.col("bin") + F.col("step")))
    else:
        rows = rows.repartition("case_id", "step")
    rows = rows.where(F.col("bin") > -F.col("step")).select("case_id", "step", F.pmod("bin", "step").alias("phase"), "bin", F.when(F.col("bin") == F.col("_own"), F.col("value")).alias("value"), (F.col("bin") == F.col("_own")).cast("int").alias("_real"), *more)
    held = F.last(F.when(F.col("value").isNotNull(), F.struct(F.col("bin").alias("b"), F.col("value").alias("v"))), ignorenulls=True).over(_by_bin("step", "phase").rowsBetween(*_BACK))
    out = ["case_id", "step", "phase", "bin", "value", F.col("_h.b").alias("held_bin"), F.col("_h.v").alias("shown"), *more]
    rows = rows.withColumn("_h", held)
    if not seen:
        return rows.select(*out)
    # bins at a distance of common / step: one frame then spans ``step`` bins in the rows of every step
    ahead = Window.partitionBy("case_id", "step").orderBy("_at").rangeBetween(0, common - 1)
    rows = rows.withColumn("_at", F.col("bin") * F.expr(f"{common} div step"))
    return rows.withColumns({"seen": F.collect_list("value").over(ahead), "bins": F.sum("_real").over(ahead)}).select(*out, "seen", "bins")


def shown_at(samples: DataFrame, rows: DataFrame, steps: list[int]) -> DataFrame:
    """``rows`` (case_id, bin, ...; bins of the panel) with step, phase, held_bin and shown of every phase: an equi-join with the sample that is on show."""
    spots = rows.withColumn("_s", F.explode(F.sequence(F.col("bin") - (max(steps) - 1), F.col("bin"))))
    on = samples.select("case_id", F.col("bin").alias("_s"), "step", "phase", "held_bin", "shown")
    return dealt(spots).join(on, ["case_id", "_s"]).where(F.col("_s") > F.col("bin") - F.col("step")).drop("_s")


def phase_arrays(panel: DataFrame, steps: list[int]) -> DataFrame:
    """case_id, bin, value, step, carried: what each residue class holds, from ``step - 1`` bins back to this one."""
    rows = panel.withColumn("step", F.explode(F.array(*[F.lit(s) for s in steps]))).withColumn("_class", F.pmod("bin", "step"))
    carried = F.last(F.when(F.col("value").isNotNull(), F.struct(F.col("bin").alias("b"), F.col("value").alias("v"))), ignorenulls=True).over(_by_bin("step", "_class").rowsBetween(*_BACK))
    rows = rows.withColumn("_held", F.struct(carried.alias("h")))
    return rows.withColumn("_all", F.collect_list("_held").over(_by_bin("step").rowsBetween(-(max(steps) - 1), 0))).select(
        "case_id", "bin", "value", "step", F.slice(F.col("_all"), F.greatest(F.size("_all") - F.col("step") + 1, F.lit(1)), F.col("step")).alias("carried")
    )


def by_phase(arrays: DataFrame) -> DataFrame:
    """One row per phase: case_id, bin, value, step, phase, held_bin, shown."""
    rows = arrays.withColumn("phase", F.explode(F.sequence(F.lit(0), F.col("step") - 1)))
    at = F.size("carried") - 1 - F.pmod(F.col("bin") - F.col("phase"), F.col("step"))
    rows = rows.withColumn("_h", F.when(at >= 0, F.get("carried", at)["h"]))
    return rows.select("case_id", "bin", "value", "step", "phase", F.col("_h.b").alias("held_bin"), F.col("_h.v").alias("shown"))


def event_display(panel: DataFrame, events: DataFrame, step: float, limit: float | None = None, width: float = asof.BUCKET) -> DataFrame:
    """Holds irregular events (case_id, sec, shown) on the panel's times: a backward as-of join, same time included."""
    points = panel.select("case_id", (F.col("bin") * step).cast("double").alias("sec"), "bin", "value", F.lit(None).cast("struct<sec:double,v:double>").alias("_m"))
    mark = F.struct(F.col("sec").cast("double").alias("sec"), F.col("shown").cast("double").alias("v"))
    marks = events.where("shown is not null").select("case_id", F.col("sec").cast("double").alias("sec"), mark.alias("_m"))
    rows = asof.neighbours(points.unionByName(marks, allowMissingColumns=True), "_m", width, ahead=False).where("_m is null")
    shown = F.col("back.v") if limit is None else F.when(F.col("sec") - F.col("back.sec") <= limit, F.col("back.v"))
    return rows.select("case_id", "bin", "value", shown.alias("shown"), F.when(shown.isNotNull(), F.col("back.sec")).alias("event_sec"))


def adaptive_samples(panel: DataFrame, rule: str, base: int, close: int, hold: int, low: float, drop: float) -> DataFrame:
    """case_id, bin, fires: the bins at which an adaptive schedule samples, and whether the sample there intensifies it.

    The next sample follows ``close`` bins later while intensified and ``base`` bins later otherwise. A sample below ``low`` (rule
    'threshold'), or ``drop`` under the one before (rule 'trend', which knows both), intensifies for ``hold`` bins.
    """
    if rule not in ("threshold", "trend"):
        raise ValueError(f"unknown rule: {rule}")
    return scan.scanned(panel, ["case_id"], ["bin"], ["bin", "value"], "bin int, fires boolean", scan.adaptive(rule, base, close, hold, low, drop))


def top_share(scores: DataFrame, key: str, score: str, share: float) -> DataFrame:
    """``key`` of the highest scores: ceil(share of all rows), ties to the smaller key. A missing score comes last."""
    n = scores.agg(F.ceil(F.count("*") * F.lit(share)).alias("_most"))
    ranked = ranks.numbered(scores.select(key, score), [F.desc_nulls_last(score), F.col(key)], "_rank")
    return ranked.join(F.broadcast(n), F.lit(True)).where(F.col("_rank") <= F.col("_most")).select(key)  # one row


def selective(panel: DataFrame, chosen: DataFrame, schedule: Column) -> DataFrame:
    """The display of a schedule, but of the reference itself for the chosen cases: adds continuous, held_bin, shown and sampled."""
    marked = panel.join(chosen.select("case_id", F.lit(True).alias("_c")), "case_id", "left").withColumn("continuous", F.coalesce("_c", F.lit(False))).drop("_c")
    rows = held(marked, schedule).withColumn("sampled", F.col("continuous") | schedule)
    return rows.withColumns({"shown": F.when(F.col("continuous"), F.col("value")).otherwise(F.col("shown")), "held_bin": F.when(F.col("continuous"), F.when(F.col("value").isNotNull(), F.col("bin"))).otherwise(F.col("held_bin"))})
