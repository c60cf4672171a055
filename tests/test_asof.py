"""As-of joins against plain searches, with buckets of all sizes and one case that fills them."""

import random

import pytest
from pyspark.sql import functions as F

from lacuna.operators import devices, hold


@pytest.mark.parametrize("width", [0.5, 3.0, 1e9])
def test_neighbours_in_time(spark, width):
    r = random.Random(6)
    at = lambda: r.choice([float(r.randint(-5, 30)), r.uniform(0, 25)])
    left = [(r.choice([1, 2, 3]), k, at()) for k in range(80)] + [(None, 900, 3.0), (4, 901, 3.0)]
    right = [(r.choice([1, 2]), at(), float(r.randint(0, 9))) for _ in range(50)] + [(None, 3.0, 1.0)]
    a, b = spark.createDataFrame(left, "case_id long, event_id int, sec double").repartition(3), spark.createDataFrame(right, "case_id long, sec double, value double").repartition(4)
    for tolerance in (None, 2.0):
        expected = []
        for c, k, t in left:
            mine = [(s, v) for x, s, v in right if x == c and c is not None]
            back, ahead = max([m for m in mine if m[0] <= t], default=None), min([m for m in mine if m[0] >= t], default=None)
            pick = back if ahead is None or (back and t - back[0] <= ahead[0] - t) else ahead
            far = None if pick is None else abs(t - pick[0])
            expected.append((c, k, t, far, None if far is None or (tolerance is not None and far > tolerance) else pick[1]))
        got = devices.nearest(a, b, "other", tolerance, width).select("case_id", "event_id", "sec", "other_distance", "other")
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("width", [10.0, 35.0, 1e9])
def test_events_held_on_a_grid(spark, width):
    r = random.Random(7)
    panel = [(c, b, float(b)) for c in (1, 2) for b in range(12)]
    events = [(1, r.choice([10.0 * r.randint(0, 11), r.uniform(-20, 120)]), r.choice([None, float(r.randint(0, 9))])) for _ in range(14)]
    p, e = spark.createDataFrame(panel, "case_id long, bin int, value double"), spark.createDataFrame(events, "case_id long, sec double, shown double")
    for limit in (None, 25.0):
        expected = []
        for c, b, v in panel:
            last = max([(s, x) for k, s, x in events if k == c and x is not None and s <= 10 * b], default=None)
            last = None if last is None or (limit is not None and 10 * b - last[0] > limit) else last
            expected.append((c, b, v, last and last[1], last and last[0]))
        got = hold.event_display(p, e, 10.0, limit, width)
        assert sorted(map(tuple, got.collect())) == sorted(expected)


def test_one_case_is_spread_over_tasks(spark):
    rows = spark.range(200_000).select(F.lit(1).cast("long").alias("case_id"), F.col("id").cast("double").alias("sec"))
    right = rows.where("sec % 50 = 0").withColumn("value", F.col("sec"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = devices.nearest(rows, right, "other", None, 5000.0).withColumn("task", F.spark_partition_id())
        each = found.groupBy("task").agg(F.count("*").alias("n"), F.max("other_distance").alias("far")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(each) >= 3 and sum(r["n"] for r in each) == 200_000 and max(r["n"] for r in each) < 120_000 and max(r["far"] for r in each) == 49
