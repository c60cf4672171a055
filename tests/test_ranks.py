"""Quantiles, numbering and running totals against NumPy; rules of audits on small tables."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lacuna.operators import devices, grid, ranks, resample, tables
from lacuna.plans import audits


def values(spark, n=400):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), None if r.random() < 0.1 else r.choice([1.0, 1.0, r.gauss(0, 5)]), r.randrange(50)) for _ in range(n)] + [("only null", None, 1)]
    return spark.createDataFrame(rows, "g string, v double, w int"), rows


def test_quantiles_equal_numpy(spark):
    df, rows = values(spark)
    wanted = {"low": (F.col("v"), 0.05), "middle": (F.col("v"), 0.5), "w_high": (F.col("w"), 0.9)}
    found = {r["g"]: r for r in ranks.quantiles(df, ["g"], wanted).collect()}
    assert set(found) == {g for g, _, _ in rows}
    for g, r in found.items():
        v, w = [x for k, x, _ in rows if k == g and x is not None], [x for k, _, x in rows if k == g]
        assert r["w_high"] == pytest.approx(np.quantile(w, 0.9))
        assert (r["low"], r["middle"]) == ((None, None) if not v else pytest.approx((np.quantile(v, 0.05), np.quantile(v, 0.5))))
    one = ranks.quantiles(df, [], {"m": (F.col("v"), 0.25)}).collect()
    assert len(one) == 1 and one[0]["m"] == pytest.approx(np.quantile([x for _, x, _ in rows if x is not None], 0.25))


def test_numbers_and_running_totals(spark):
    df, rows = values(spark)
    df = df.withColumn("id", F.monotonically_increasing_id())
    order = [F.desc("w"), F.col("id")]
    found = ranks.running(ranks.numbered(df, order), order, F.col("w"), "before").orderBy("n").collect()
    assert [r["n"] for r in found] == list(range(1, len(rows) + 1))
    w = [r["w"] for r in found]
    assert w == sorted(w, reverse=True) and [r["before"] for r in found] == [0, *np.cumsum(w)[:-1].tolist()]


def test_weights_have_the_moments_of_drawing_with_replacement(spark):
    c = spark.createDataFrame([(i, "g", 1.0) for i in range(300)], "c int, g string, x double")
    reps = resample.replicates(c, ["g"], "c", 1000, 5, ["x"]).collect()
    drawn = np.array([r["drawn"] for r in reps])
    assert len(reps) == 1000 and abs(drawn.mean() - 300) < 3 and abs(drawn.std() - 300**0.5) < 2
    w = resample.weights([str(i) for i in range(300)], 1000, 5)
    assert abs(w.mean() - 1) < 0.01 and abs((w**2).mean() - 2) < 0.05


def test_replicates_are_weighted_sums(spark, monkeypatch):
    """Whatever the blocks of clusters and the groups held at once: sums by the weights, missing values left out, null groups kept."""
    monkeypatch.setattr(resample, "CLUSTERS", 7)
    monkeypatch.setattr(resample, "GROUPS", 2)
    r = random.Random(3)
    rows = [(c, g, None if r.random() < 0.2 else r.random(), float(c)) for c in range(40) for g in (None, 1, 2, 3) if r.random() < 0.7]
    df = spark.createDataFrame(rows, "c long, g int, x double, y double").repartition(5)
    w = resample.weights([str(c) for c in range(40)], 30, 9)
    found = {(x["g"], x["rep"]): (x["x"], x["y"], x["drawn"]) for x in resample.replicates(df, ["g"], "c", 30, 9, ["x", "y"]).collect()}
    for g in (None, 1, 2, 3):
        mine = [x for x in rows if x[1] == g]
        for k in range(30):
            expected = (sum((x[2] or 0) * w[x[0], k] for x in mine), sum(x[3] * w[x[0], k] for x in mine), sum(w[x[0], k] for x in mine))
            assert found[g, k] == pytest.approx(expected)


def test_one_row_of_each_cluster(spark, monkeypatch):
    monkeypatch.setattr(resample, "MINIMA", 3)
    df = spark.createDataFrame([(c, e, float(e)) for c in range(5) for e in range(10 * c, 10 * c + c + 1)], "case_id long, event_id long, rep_value double")
    out = resample.one_per_cluster(df, "case_id", "event_id", 7, 4).collect()
    pick = lambda k, c: min(range(10 * c, 10 * c + c + 1), key=lambda e: (int(hashlib.md5(f"4|{k}|{e}".encode()).hexdigest()[:8], 16), e))
    assert sorted((r["rep"], r["case_id"], r["event_id"]) for r in out) == [(k, c, pick(k, c)) for k in range(7) for c in range(5)]


def test_a_summary_is_brought_up_to_date(spark):
    summarise = lambda p: p.groupBy("case_id").agg(F.sum("value").alias("total"))
    stored = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, -1.0)], "case_id long, total double")
    rows = spark.createDataFrame([(1, 4.0), (2, 21.0), (2, 1.0), (3, 5.0)], "case_id long, value double")
    changed = spark.createDataFrame([(2,), (3,)], "case_id long")
    # what is unchanged comes from the stored summary, whatever its rows say
    assert sorted(map(tuple, tables.brought_up_to_date(stored, rows, changed, "case_id", summarise).collect())) == [(1, 10.0), (2, 22.0), (3, 5.0)]
    with pytest.raises(Exception, match="does not cover"):
        tables.brought_up_to_date(stored.where("case_id > 1"), rows, changed, "case_id", summarise).collect()


def test_consistency_and_conservation(spark):
    a = spark.createDataFrame([("x", 1.0, 5), ("y", 2.0, 6), ("z", 0.0, 0)], "k string, s double, n long")
    b = spark.createDataFrame([("x", 1.0, 5), ("y", 2.1, 6)], "k string, s double, n long")
    assert {r["k"]: r["passed"] for r in tables.consistent(a, b, ["k"], ["s", "n"]).collect()} == {"x": True, "y": False, "z": False}
    parts = spark.createDataFrame([(3, 1, 2), (5, 5, 0)], "n long, a long, b long")
    assert tables.conserved(parts, "n", ["a", "b"]).count() == 2
    with pytest.raises(Exception, match="n is not the sum of a, b"):
        tables.conserved(parts.withColumn("b", F.col("b") + 1), "n", ["a", "b"]).collect()


def test_scenarios_exclude_in_order(spark):
    ways = [devices.Scenario("plain"), devices.Scenario("long", low_bins=2), devices.Scenario("first", only_first=True), devices.Scenario("late", first_bin=7)]
    names = [w.name for w in ways]
    events = spark.createDataFrame([(n, c, e, t) for n in names for c, e, t in ((1, 1, 100.0), (1, 2, 700.0), (2, 1, 700.0), (3, 1, 900.0), (4, 1, 800.0))], "scenario string, case_id long, event_id long, sec double")
    states = spark.createDataFrame([(n, *x) for n in names for x in ((1, 2, 2, 0, 30.0, "fresh_low", 1), (2, 1, 2, 0, 30.0, "fresh_low", 3), (3, 1, 2, 0, 90.0, "reference_normal", 0))], "scenario string, case_id long, event_id long, step int, phase int, value double, category string, low_bins int")
    why = {(r["scenario"], r["case_id"], r["event_id"]): r["why"] for r in devices.judged_events(states, events, ways, 100.0, 5, 35.0, F.lit(1)).collect()}
    plain = {(1, 1): "too_early", (1, 2): None, (2, 1): None, (3, 1): None, (4, 1): "poor_support"}
    changed = {"plain": {}, "long": {(1, 2): "short_low_run"}, "first": {(2, 1): "not_first"}, "late": {(1, 2): "too_early", (2, 1): "too_early"}}
    assert why == {(n, *k): v for n in names for k, v in (plain | changed[n]).items()}


def test_scenarios_share_a_pass_over_blocks(spark):
    one = lambda *rows: spark.createDataFrame([(1, t, k, "start") for t, k in rows], "case_id long, sec double, track string, kind string")
    ways = [devices.Scenario("narrow", width=10.0), devices.Scenario("wide", width=100.0), devices.Scenario("all", sustained=False, width=100.0)]
    blocks = devices.scenario_blocks(devices.scenario_changes(one((0.0, "a"), (50.0, "b")), one((0.0, "a"), (50.0, "b"), (300.0, "a")), ways)).collect()
    assert sorted((r["scenario"], r["event_id"], r["sec"], r["tracks"], r["changes"]) for r in blocks) == [("all", 1, 0.0, "a+b", 2), ("all", 2, 300.0, "a", 1), ("narrow", 1, 0.0, "a", 1), ("narrow", 2, 50.0, "b", 1), ("wide", 1, 0.0, "a+b", 2)]


def test_strata_add_up(spark):
    rows = spark.createDataFrame([("x", "a", "s", 1.0), ("x", "b", "s", 3.0), ("y", "a", "t", 5.0)], "scenario string, tracks string, kind string, v double")
    out = devices.strata(rows, ["scenario"], ["tracks", "kind"], {"events": F.count("*")}, {"v": F.avg("v")}).collect()
    assert {(r["scenario"], r["level"], r["stratum"]): (r["events"], r["v"]) for r in out} == {
        ("x", "all", None): (2, 2.0), ("x", "tracks", "a"): (1, 1.0), ("x", "tracks", "b"): (1, 3.0), ("x", "kind", "s"): (2, 2.0), ("y", "all", None): (1, 5.0), ("y", "tracks", "a"): (1, 5.0), ("y", "kind", "t"): (1, 5.0)}
    with pytest.raises(ValueError, match="do not add up"):
        devices.strata(rows, ["scenario"], ["tracks", "kind"], {"kinds": F.count_distinct("kind")}, {})


def test_named_counts_add_up(spark):
    rows = lambda n: spark.createDataFrame([("x", "all", 3), ("x", "a", 2), ("x", "b", n), ("y", "all", 0)], "k string, name string, n long")
    rules = {"all": ["a", "b"]}
    assert sorted(map(tuple, tables.balanced(rows(1), ["k"], "name", "n", rules).collect())) == [("x", "a", 2), ("x", "all", 3), ("x", "b", 1), ("y", "all", 0)]
    with pytest.raises(Exception, match="all is not the sum of a, b"):
        tables.balanced(rows(2), ["k"], "name", "n", rules).collect()


def test_event_flow_is_that_of_all_scenarios(spark):
    rows = entry.queries()["event_flow"](spark, "/root/testdata/sf0.001").collect()
    flow = {(r["scenario"], r["name"]): r for r in rows if r["part"] == "flow"}
    assert set(flow) == {(s.name, n) for s in audits.SCENARIOS for n in ["cohort", "raw_changes", "stable_changes", *audits._FLOW]}
    assert {r["part"] for r in rows} == {"flow", "stop_reason", "all", "tracks", "kind"}
    for s in audits.SCENARIOS:
        n = {name: r["events"] for (scenario, name), r in flow.items() if scenario == s.name}
        assert n["blocks"] <= n["stable_changes" if s.sustained else "raw_changes"] and n["stable_changes"] < n["raw_changes"]
        assert n["blocks"] == sum(n[x] for x in devices.EXCLUSIONS) + n["low"] + n["normal"]
        assert n["low"] == sum(n[x] for x in devices.SUPPORT)
        for step in (2, 4, 6):
            mine = [r for r in rows if r["scenario"] == s.name and r["step"] == step]
            assert sum(r["pairs"] for r in mine if r["part"] == "stop_reason") == step * n["supported"]
            assert all(sum(r["events"] for r in mine if r["part"] == part) == n["low"] for part in ("all", "tracks", "kind"))


def prominences(v, distance, least):
    """Peaks in three plain steps: maxima (middles of flat tops), the distance rule from the highest down, then prominence by looking outwards."""
    tops = []
    for i in range(1, len(v) - 1):
        for j in range(i, len(v) - 1):
            if v[j] != v[i]:
                break
            if v[i - 1] < v[i] and v[j + 1] < v[i]:
                tops.append((i + j) // 2)
    kept = []
    for i in sorted(tops, key=lambda i: (-v[i], -i)):
        if all(abs(i - j) >= distance for j in kept):
            kept.append(i)
    n = 0
    for i in kept:
        left = next((j for j in range(i - 1, -1, -1) if v[j] > v[i]), -1)
        right = next((j for j in range(i + 1, len(v)) if v[j] > v[i]), len(v))
        n += v[i] - max(min(v[left + 1 : i + 1]), min(v[i:right])) >= least
    return n


def test_peaks_keep_their_distance_before_they_stand_out():
    assert grid.peak_count([0, 20, 40, 60, 80, 70, 90, 88, 92, 96, 100, 50, 0], 3, 5) == 1
    assert grid.peak_count([0, 5, 5, 5, 0, 5, 5], 1, 1) == 1 and grid.peak_count([], 1, 1) == 0 and grid.peak_count([1, 1, 1], 1, 0) == 0
    r = random.Random(9)
    for _ in range(600):
        v = [float(r.randint(0, r.choice([2, 6, 30]))) for _ in range(r.randint(0, 40))]
        distance, least = r.choice([1, 2, 3, 5, 2.5]), r.choice([0, 1, 3, 5])
        assert grid.peak_count(v, distance, least) == prominences(v, distance, least)


def test_peaks_and_pulses(spark):
    r = random.Random(4)
    rows = [(c, float(i), round(r.uniform(0, 30), 1)) for c in range(12) for i in range(40)]
    found = {x["case_id"]: x for x in grid.wave_peaks(spark.createDataFrame(rows, "case_id long, sec double, value double"), 1000.0, 3, 5.0).withColumns({"coverage": F.lit(0.9), "span": F.lit(10.0)}).withColumn("pulse", grid.pulse_like(0.8, 8.0, 4, 40)).collect()}
    for c in range(12):
        n = prominences([v for k, _, v in rows if k == c], 3, 5.0)
        assert found[c]["peaks"] == n and found[c]["pulse"] == (n >= 4)
