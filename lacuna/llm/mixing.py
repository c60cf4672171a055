"""Mixing sources to token targets by entropy balancing.

Each source has a target of tokens. Of all document rates between 0 and ``most`` whose expected
tokens meet the targets, entropy balancing takes those nearest to 1 in relative entropy; they are
exponentially tilted, ``r = min(most, exp(lambda_s * size / mean size of s))``, and the lambdas solve
a convex dual. Its Newton iterations run on counts by (source, size), which hold all that the dual
needs; each is one join and one aggregation, guarded by bisection, for all sources at once.

Rates become copies by systematic rounding along the sizes of a source: with C the running sum of rates, the
documents of one size get floor(C + 1/2) - floor(C_before + 1/2) copies together, so neighbouring sizes even out. What a
source's tokens then miss is repaired on the same counts: copies of the largest sizes that still fit are added or taken back,
round by round, until less than the smallest useful size is missing. A size's copies are dealt evenly over its documents;
ranks among documents of one size come from counts by small hash buckets, never from one large group.

Defined cases: a null or wordless text has size 0 and takes 0; a null source is a source, the last one;
a source of size 0 has target 0; rows that repeat a doc_id count as documents of their own; ties in size are
ordered by doc_id and text; an empty table gives no rows; other columns are neither read nor returned.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_SPACE, meet, running_sums, settled

#: Rows that a hash bucket of documents holds on average.
BUCKET_ROWS = 500
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
STEPS = 30
REPAIRS = 3
#: exp() of more is not needed: the rate is capped long before.
FAR = 60.0


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, and a key that orders rows of equal size."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(NOT_SPACE)), F.lit(0)).cast("long").alias("size"), F.xxhash64("doc_id", "text").alias("tie"))


def targets(by_source: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target. Excess over ``most`` times a source's size is reshared by weight among the rest.

    The result of resharing is min(most * size, weight * level): sources are capped in the order of
    most * size / weight, and the level is what then remains for each unit of weight.
    """
    listed = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(listed) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = by_source.select("source", "source_size", w.alias("w")).withColumn("cap", F.col("source_size") * F.lit(most))
    capped = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, rest = capped.rowsBetween(Window.unboundedPreceding, -1), capped.rowsBetween(0, Window.unboundedFollowing)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.select("*", ((F.sum("source_size").over(every) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)).alias("level"))
    rows = rows.withColumn("open", F.col("level") <= F.col("cap") / F.col("w"))
    level = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("w"), F.col("level").alias("level")))).over(every)["level"]
    return rows.select("source", "source_size", F.when(level.isNull(), F.col("cap")).otherwise(F.least("cap", F.col("w") * level)).alias("target"))


def tilts(counts: DataFrame, goal: DataFrame, most: float = MOST, steps: int = STEPS) -> DataFrame:
    """source, mean, tilt: lambda of each source. ``counts`` has source, size, n; ``goal`` source, source_size, target."""
    mean = counts.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    state = meet(goal, mean, ["source"]).select("source", "target", F.greatest("mean", F.lit(1e-9)).alias("mean"), (F.col("target") >= F.col("source_size") * most).alias("full"))
    state = state.select("*", F.lit(0.0).alias("tilt"), F.lit(-FAR).alias("low"), F.lit(FAR).alias("high"))
    held = [c for c in state.columns if c != "source"]
    for step in range(steps):
        if step % 5 == 0:  # cuts lineage; settled sources drop out of the work
            state = settled(state)
            if not state.where("not full and high - low > 1e-12").head(1):
                break
        # the state goes with the counts through one join and one aggregation, so that steps form a chain
        x = F.col("size") / F.col("mean")
        r = F.exp(F.least(F.col("tilt") * x, F.lit(FAR)))
        got = F.sum(F.col("n") * F.col("size") * F.least(r, F.lit(most)))
        slope = F.sum(F.when(r < most, F.col("n") * F.col("size") * x * r).otherwise(0.0))
        state = meet(counts, state, ["source"]).groupBy("source").agg(*[F.max(c).alias(c) for c in held], got.alias("got"), slope.alias("slope")).select(
            "source", "target", "mean", "full", "tilt", "slope", "got",
            F.when(F.col("got") <= F.col("target"), F.col("tilt")).otherwise(F.col("low")).alias("low"), F.when(F.col("got") >= F.col("target"), F.col("tilt")).otherwise(F.col("high")).alias("high"),
        )
        newton = F.col("tilt") + F.try_divide(F.col("target") - F.col("got"), F.col("slope"))
        inside = newton.isNotNull() & (newton > F.col("low")) & (newton < F.col("high"))
        near = F.abs(F.col("got") - F.col("target")) <= F.col("target") * 1e-10
        at = F.when(near, F.col("tilt")).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
        state = state.select("source", "target", "mean", "full", at.alias("tilt"), F.when(near, F.col("tilt")).otherwise(F.col("low")).alias("low"), F.when(near, F.col("tilt")).otherwise(F.col("high")).alias("high"))
    return state.select("source", "mean", F.when(F.col("full"), F.lit(FAR)).otherwise(F.col("tilt")).alias("tilt"), "full")


def copies(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, steps: int = STEPS, repairs: int = REPAIRS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds source_size, target, rate, copies and taken to doc_id, source, size, tie."""
    sized = settled(sized)
    buckets = max(1, math.ceil(sized.count() / bucket_rows))
    sized = sized.withColumn("bucket", F.pmod(F.xxhash64("tie"), F.lit(buckets)))
    fine = settled(sized.groupBy("source", "size", "bucket").agg(F.count("*").alias("n")))
    counts = settled(fine.groupBy("source", "size").agg(F.sum("n").alias("n")))
    goal = settled(targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most))
    tilt = tilts(counts, goal, most, steps)
    rated = meet(counts, tilt, ["source"]).select("source", "size", "n", F.when(F.col("full"), F.lit(most)).otherwise(F.least(F.lit(most), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(FAR))))).alias("rate"))
    rated = running_sums(rated.withColumn("mass", F.col("rate") * F.col("n")), ["source"], "size", ["mass"])
    near = lambda x: F.floor(x + 0.5 + 1e-9)
    cells = settled(rated.select("source", "size", "n", "rate", (near(F.col("before_mass") + F.col("mass")) - near(F.col("before_mass"))).alias("k")))
    for last in [False] * repairs + [True]:
        cells = settled(repaired(cells, goal, int(most), last))
    # where each bucket of a (source, size) begins
    fine = running_sums(fine, ["source", "size"], "bucket", ["n"])
    spots = meet(fine.drop("n"), cells, ["source", "size"])
    ranked = sized.select("*", F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("tie", F.col("doc_id").asc_nulls_last())).alias("rank"))
    dealt = meet(ranked, spots, ["source", "size", "bucket"]).withColumn("p", F.col("before_n") + F.col("rank"))
    made = dealt.select("doc_id", "source", "size", "rate", F.expr("cast(k * p div n - k * (p - 1) div n as int)").alias("copies"))
    return meet(made, goal, ["source"]).select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def repaired(cells: DataFrame, goal: DataFrame, most: int, last: bool) -> DataFrame:
    """Copies of a source's sizes moved towards its target: the largest that fit, or at ``last`` one copy of the size nearest to what is missing."""
    taken = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("k")).alias("got"))
    off = meet(goal, taken, ["source"]).select("source", (F.col("target") - F.col("got")).alias("off"))
    rows = meet(cells, off, ["source"]).withColumn("room", F.when(F.col("off") > 0, most * F.col("n") - F.col("k")).otherwise(F.col("k")))
    left = F.abs("off")
    if last:
        gain = left - F.abs(left - F.col("size"))
        best = rows.where((F.col("room") > 0) & (gain > 0)).groupBy("source").agg(F.max(F.struct(gain.alias("gain"), "size"))["size"].alias("best"))
        rows = meet(rows, best, ["source"], "left").withColumn("move", (F.col("size") == F.coalesce("best", F.lit(-1))).cast("long"))
    else:
        fits = (F.col("room") > 0) & (F.col("size") > 0) & (F.col("size") <= left)
        rows = rows.withColumns({"down": -F.col("size"), "mass": F.when(fits, F.col("size") * F.col("room")).otherwise(0)})
        rows = running_sums(rows, ["source"], "down", ["mass"])
        rows = rows.withColumn("move", F.when(fits, F.greatest(F.least(F.col("room"), F.floor((left - F.col("before_mass")) / F.col("size"))), F.lit(0))).otherwise(0))
    return rows.select("source", "size", "n", "rate", (F.col("k") + F.col("move") * F.sign("off").cast("long")).alias("k"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, copies, rate."""
    return copies(sizes(docs), **how).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")
