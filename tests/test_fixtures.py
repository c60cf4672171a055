"""Small inputs with known results; missing is None."""

import pytest
from pyspark.sql import functions as F

from lacuna.functions.columns import number, require_columns
from lacuna.operators import cohort, deficit, devices, episodes, grid, hold, outcomes, resample, tables, text_audit
from lacuna.sources import files


def panel(spark, values, case=1):
    return spark.createDataFrame([(case, i, None if v is None else float(v)) for i, v in enumerate(values)], "case_id long, bin int, value double")


def column(df, name, *order):
    return [r[name] for r in df.orderBy(*(order or ("bin",))).collect()]


def decomposed(spark, ref, shown, threshold=65.0):
    rows = spark.createDataFrame([(1, float(a) if a is not None else None, float(d) if d is not None else None, threshold) for a, d in zip(ref, shown, strict=True)], "case_id long, value double, shown double, threshold double")
    return deficit.decompose(rows, ["case_id"], 1.0).first()


def test_decomposition_of_a_late_display(spark):
    r = decomposed(spark, [70, 60, 60, 70], [70, 70, 55, 55])
    assert (r["true_auc"], r["display_auc"], r["hidden_auc"], r["over_auc"], r["concordant_auc"], r["net"]) == (10, 20, 5, 15, 5, 1.0)


def test_decomposition_of_an_unavailable_display(spark):
    r = decomposed(spark, [60, 70], [None, None])
    assert (r["true_auc"], r["display_auc"], r["hidden_auc"], r["hidden_unavailable_auc"], r["hidden_valid_auc"], r["unavailable_low_min"], r["normal_discordant_min"]) == (5, 0, 5, 5, 0, 1, 0)


def test_decomposition_of_a_missing_reference(spark):
    r = decomposed(spark, [None, 70], [50, 50])
    assert (r["true_auc"], r["display_auc"], r["over_auc"], r["low_discordant_min"]) == (0, 15, 15, 1)


def test_low_is_strictly_below(spark):
    r = decomposed(spark, [64, 65, 70, 64], [65, 64, 64, None])
    assert (r["normal_discordant_min"], r["low_discordant_min"], r["unavailable_low_min"]) == (1, 2, 1)


def test_held_display_keeps_the_last_valid_sample(spark):
    h = hold.held(panel(spark, [60, 70, None, 80, 90, 55, 75]), hold.on_schedule(3, 2))
    assert column(h, "held_bin") == [None] * 5 + [5, 5] and column(h, "shown") == [None] * 5 + [55, 55]
    h = hold.held(panel(spark, [60, 70, 70, None, 70, 70, 80]), hold.on_schedule(3, 0))
    assert column(h, "held_bin") == [0] * 6 + [6] and column(h, "shown") == [60] * 6 + [80]


def test_initialised_display(spark):
    h = hold.held(panel(spark, [72, 71, 60, 61, 75, 76, 77]), hold.on_schedule(3, 2))
    assert column(h, "shown")[:2] == [None, None]
    assert column(hold.initialised(h), "shown") == [72, 72, *column(h, "shown")[2:]]


def test_all_phases_equal_single_schedules(spark):
    p = panel(spark, [60, None, 70, 80, None, 55, 75, 64, None, 66, 67, 50])
    every = hold.by_phase(hold.phase_arrays(p, [2, 3, 5]))
    for step in (2, 3, 5):
        for phase in range(step):
            one = every.where((F.col("step") == step) & (F.col("phase") == phase))
            # a phase shows nothing before its own first bin
            assert column(one, "held_bin") == column(hold.held(p, hold.on_schedule(step, phase) & (F.col("bin") >= phase)), "held_bin")


def test_tolerance_joins_episodes(spark):
    p = deficit.with_thresholds(panel(spark, [75, 60, 60, 70, 60, 60, 75, 75, 75, 75]), [65.0])
    assert episodes.tolerant(p, 10.0, 0.0, 0.0).count() == 2
    assert episodes.tolerant(p, 10.0, 0.0, 20.0).count() == 1


def bridged(spark, values, gap, least):
    rows = episodes.bridged(deficit.with_thresholds(panel(spark, values), [65.0]), gap, least).orderBy("start_bin").collect()
    return [(r["start_bin"], r["end_excl"], r["n_low"]) for r in rows]


def test_missing_bins_split_bridged_events(spark):
    v = [60, 60, 70, 60, 60, None, 60, 60]
    assert bridged(spark, v, 1, 4) == [(0, 5, 4)] and bridged(spark, v, 0, 4) == []
    assert bridged(spark, [60, 70, 70, 60], 2, 3) == [] and bridged(spark, [60, 70, 70, 60], 2, 2) == [(0, 4, 2)]


@pytest.mark.parametrize("step,phase,kinds,carry,inherited", [(4, 0, ["inherited", "never"], [True, False], None), (3, 0, ["fresh", "fresh"], None, [True, True])])
def test_event_classes(spark, step, phase, kinds, carry, inherited):
    p = panel(spark, [60, 70, 60, 60, 70, 60, 60, 70])
    shown = hold.samples(p, [step]).where(F.col("phase") == phase)
    events = spark.createDataFrame([(1, 65.0, 1, 2, 4, 2), (1, 65.0, 2, 5, 7, 2)], "case_id long, threshold double, event int, start_bin int, end_excl int, n_low int")
    rows = episodes.classes(shown, events, [step]).orderBy("event").collect()
    assert [r["class"] for r in rows] == kinds
    assert carry is None or [r["carry_in"] for r in rows] == carry
    assert inherited is None or [r["first_inherited"] for r in rows] == inherited


def test_observability_of_one_episode(spark):
    p = panel(spark, [75.0] * 10 + [60.0] * 12 + [75.0] * 38)
    e = episodes.tolerant(deficit.with_thresholds(p, [65.0]), 10.0, 60.0, 0.0)
    pairs = episodes.observability(hold.samples(p, [30]), e, [30], 10.0, (60.0, 120.0), [65.0])
    s = episodes.observability_sums(pairs, ["threshold"]).first()
    assert (s["pairs"], s["detected_pairs"]) == (30, 12)
    assert s["miss_fraction"] == pytest.approx(0.6) and s["mean_delay"] == pytest.approx(55) and s["mean_left"] == pytest.approx(65) and s["mean_stale"] == pytest.approx(235)
    assert s["p_left_1"] == pytest.approx(7 / 30) and s["p_left_2"] == pytest.approx(1 / 30) and s["auc_before_share"] == pytest.approx(47 / 60)


@pytest.mark.parametrize("times,values,limits,expected", [([0, 10, 20, 110, 130, 150], [80, 80, 80, 80, 80, 79], (0, 300), [(0, 80), (130, 80), (150, 79)]), ([0, 60, 120], [10, 80, 190], (20, 180), [(60, 80)])])
def test_collapse_compares_with_the_last_kept(spark, times, values, limits, expected):
    rows = spark.createDataFrame([(1, float(t), float(v)) for t, v in zip(times, values, strict=True)], "case_id long, sec double, value double")
    kept = devices.collapsed(rows, 90.0, 120.0, *map(float, limits)).orderBy("sec").collect()
    assert [(r["sec"], r["value"]) for r in kept] == expected


def test_range_filter_comes_before_the_median(spark):
    rows = spark.createDataFrame([(1, 0.0, 1000.0), (1, 1.0, 1000.0), (1, 2.0, 80.0)], "case_id long, sec double, value double")
    cases = spark.createDataFrame([(1, 0.0, 10.0), (2, 5.0, 5.0)], "case_id long, start_sec double, end_sec double")
    assert [tuple(r) for r in grid.median_grid(rows, cases, 10.0, 20.0, 180.0).collect()] == [(1, 0, 80.0)]


def test_window_starts_at_zero(spark):
    df = spark.createDataFrame([(1, -1667.0, 6073.0), (2, None, None)], "case_id long, a double, z double")
    assert [(r["start_sec"], r["end_sec"]) for r in grid.window_bounds(df, "w", {"w": ("a", "z")}).orderBy("case_id").collect()] == [(0.0, 6073.0), (0.0, None)]
    with pytest.raises(ValueError):
        grid.window_bounds(df, "other", {"w": ("a", "z")})


def test_pareto(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 0.2), (3, 6.0, 0.4), (4, 6.0, 0.3)], "id int, burden double, benefit double")
    assert column(resample.pareto(df, [], "burden", "benefit"), "optimal", "id") == [True, True, True, False]


def test_bootstrap_point_and_clusters(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("a", 1, 12.0), ("a", 1, 14.0), ("a", 2, -2.0)], "g string, case_id int, bias double")
    r = resample.bootstrap_mean(df, ["g"], "case_id", "bias", 200, 1).first()
    assert (r["estimate"], r["clusters"], r["rows"]) == (8.5, 2, 4) and r["low"] <= 5.0 <= r["high"]


def test_bootstrap_does_not_depend_on_other_groups(spark):
    rows = [("a", 101, 10.0, 10.0), ("a", 101, 10.0, 10.0), ("a", 202, 0.0, 10.0)]
    more = rows + [("b", k, float(k), 10.0) for k in range(5)]
    run = lambda x: resample.bootstrap_ratio(spark.createDataFrame(x, "g string, c int, t double, b double"), ["g"], "c", "t", "b", 100, 7).where("g = 'a'").first()
    assert run(rows) == run(more) == run(more[::-1]) and run(rows)["estimate"] == pytest.approx(2 / 3) and run(rows)["clusters"] == 2


def blocks(spark, times, width):
    df = spark.createDataFrame([(1, float(t), "d", "start") for t in times], "case_id long, sec double, track string, kind string")
    return column(devices.anchored_blocks(df, float(width)), "sec", "sec")


def test_blocks_are_anchored(spark):
    assert blocks(spark, [0, 50, 100], 60) == [0, 100] and blocks(spark, [0, 60, 61], 60) == [0, 61]


def state(spark, values, sec, step=30, phase=0):
    p = panel(spark, values)
    shown = hold.samples(p, [step]).where(F.col("phase") == phase)
    e = spark.createDataFrame([(1, 1, float(sec))], "case_id long, event_id int, sec double")
    return devices.states_at(e, shown, [step], p, 10.0, 65.0).first()


def test_states_use_completed_bins(spark):
    r = state(spark, [75] * 30 + [50, 50], 305)
    assert (r["value"], r["category"]) == (75, "reference_normal")
    assert state(spark, [60] * 30 + [None] + [60] * 9, 315) is None
    assert state(spark, [60] * 29 + [None] + [60] * 10, 315, phase=29)["category"] == "unavailable"
    v = [75.0] * 50
    for i in [0, 1, *range(30, 50)]:
        v[i] = 60.0
    assert state(spark, v, 315, phase=1)["category"] == "inherited_low" and state(spark, v, 315, phase=0)["category"] == "fresh_low"
    r = state(spark, [60] * 29 + [None] + [60] * 20, 325)
    assert r["category"] == "fresh_low" and r["low_start"] == 30


def recovered(spark, values, sec=315):
    p = panel(spark, values)
    shown = hold.samples(p, [30])
    e = spark.createDataFrame([(1, 1, float(sec))], "case_id long, event_id int, sec double")
    return devices.recovery(e, shown, [30], p, 10.0, 65.0, 30, 0.8, len(values) - 1).where("phase = 0").first()


def test_recovery_needs_two_normal_bins(spark):
    v = [60.0] * 80
    v[31] = 75.0
    v[33:] = [75.0] * 47
    assert recovered(spark, v)["recovery_bin"] == 34
    v = [60.0] * 32 + [75.0] * 48
    v[36] = None
    r = recovered(spark, v)
    assert (r["recovery_bin"], r["stop_reason"], r["persistence_sec"]) == (33, "missing_reference", 30.0)


def rate_rows(spark, times, values):
    return spark.createDataFrame([(1, i, float(t), float(v)) for i, (t, v) in enumerate(zip(times, values, strict=True))], "case_id long, event_id int, sec double, value double")


def test_sustained_changes(spark):
    assert devices.sustained(rate_rows(spark, [0, 1, 2, *range(20, 27)], [1, 1, 0, *[2] * 7]), 5.0, 5.0).count() == 0
    assert column(devices.sustained(rate_rows(spark, range(12), [0, 0, *[3] * 10]), 5.0, 5.0), "kind", "sec") == ["start"]
    brief = rate_rows(spark, range(10), [0, 2, *[0] * 8])
    assert devices.sustained(brief, 5.0, 5.0).count() == 0 and devices.sustained(brief, 5.0, 0.0).count() == 1


def test_mask_needs_a_run(spark):
    p = panel(spark, [50] * 12).withColumn("cover", F.when(F.col("bin") == 6, 0.0).otherwise(1.0))
    flag = (F.col("value") > 40) & (F.col("cover") >= 0.8)
    assert sum(column(grid.masked(p, flag, 6), "masked")) == 6 and sum(column(grid.masked(p, flag, 1), "masked")) == 11
    faults = grid.mask_faults(p, grid.unmasked(grid.masked(p, flag, 6))).first()
    assert faults["masked"] == 6 and faults["imputed"] == faults["changed"] == faults["lost"] == 0


DAY = 86400.0


def test_windowed_outcome(spark):
    base = [1.0, 1.0, 1.0, 1.0, 1.5, None]
    cases = spark.createDataFrame([(i + 1, 1000.0, 1000.0 + DAY if i == 2 else None, v) for i, v in enumerate(base)], "case_id long, anchor double, discharge double, baseline double")
    labs = [(1, 999.0, 9.0), (1, 1000.0, 8.0), (1, 1000 + DAY, 1.31), (1, 1000 + 8 * DAY, 2.0), (2, 1000 + 6 * DAY, 1.6), (3, 1000 + 2 * DAY, 3.0), (4, 1000 + DAY, 2.2), (5, 1000 + DAY, 4.6), (6, 1000 + DAY, 2.0)]
    rows = outcomes.windowed(spark.createDataFrame(labs, "case_id long, sec double, value double"), cases, 0.3, 1.5, 4.0).orderBy("case_id").collect()
    assert [r["stage"] for r in rows] == [1, 1, None, 2, 3, None] and rows[0]["max_7d"] == 1.31
    high = spark.createDataFrame([(1, 1000.0, None, 4.5)], "case_id long, anchor double, discharge double, baseline double")
    r = outcomes.windowed(spark.createDataFrame([(1, 1000 + DAY, 4.6)], "case_id long, sec double, value double"), high, 0.3, 1.5, 4.0).first()
    assert (r["event"], r["stage"]) == (False, 0)


def test_latest_before(spark):
    labs = spark.createDataFrame([(1, -91 * DAY, 0.7), (1, -5 * DAY, 0.8), (1, -DAY, 0.9), (1, 1.0, 1.2)], "case_id long, sec double, value double")
    anchors = spark.createDataFrame([(1, 0.0), (2, 0.0)], "case_id long, anchor double")
    assert column(outcomes.latest_before(labs, anchors, 90 * DAY), "value", "case_id") == [0.9, None]


def test_guards_fail_closed(spark):
    df = spark.createDataFrame([(1, "TRUE"), (2, "maybe")], "id int, flag string")
    with pytest.raises(Exception, match="ambiguous"):
        cohort.ledger(df, "flag").collect()
    with pytest.raises(Exception, match="repeats"):
        cohort.validated_join(df, df.union(df), "id", "many_to_one").collect()
    with pytest.raises(ValueError, match="missing"):
        require_columns(df, "id", "absent")
    with pytest.raises(ValueError):
        cohort.head_candidates(df, "id", 0)
    with pytest.raises(Exception, match="interval"):
        grid.decoded_times(spark.createDataFrame([(0,)], "idx int"), F.lit(0.0), F.lit(2.0)).collect()


def test_numbers_and_cells(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("NaN",), (None,), (" 7 ",), ("",), ("true",)], "t string")
    assert [r["n"] for r in df.select(number("t").alias("n")).collect()][:4] == [1.5, None, None, None]
    assert [r["c"]["kind"] for r in df.select(tables.typed_cell("t").alias("c")).collect()] == ["float", "text", "text", "blank", "int", "blank", "bool"]


def test_manifest_faults_and_first_root(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "b.txt").write_text("two")
    saved = files.manifest(spark, str(tmp_path)).collect()
    saved = spark.createDataFrame(saved)
    assert files.manifest_faults(files.manifest(spark, str(tmp_path)), saved).count() == 0
    (tmp_path / "b.txt").write_text("twx")
    (tmp_path / "c.txt").write_text("new")
    assert {(r["name"], r["fault"]) for r in files.manifest_faults(files.manifest(spark, str(tmp_path)), saved).collect()} == {("b.txt", "changed"), ("c.txt", "unexpected")}
    for root, value in (("r1", 1.0), ("r2", 2.0)):
        files.write_tracks(spark.createDataFrame([(1, 0.0, value)] + ([(2, 0.0, value)] if root == "r2" else []), "tid long, sec double, value double"), str(tmp_path / root))
    found = files.read_tracks(spark, str(tmp_path / "r1"), str(tmp_path / "r2")).orderBy("tid").collect()
    assert [(r["tid"], r["value"]) for r in found] == [("1", 1.0), ("2", 2.0)]  # ids of tracks are texts


def test_forbidden_columns():
    assert text_audit.forbidden_columns(["Case", "SubjectID", "x"], {"subjectid", "name"}) == ["SubjectID"]


def test_sums_of_samples_equal_sums_of_points(spark):
    """Whatever is missing, sums over samples are those over every phase at every bin."""
    import random

    r = random.Random(8)
    rows = [(c, i, None if r.random() < 0.3 else float(r.randint(50, 80))) for c, n in ((1, 1), (2, 3), (3, 31), (4, 40)) for i in range(n)] + [(5, i, None) for i in range(7)]
    p = spark.createDataFrame(rows, "case_id long, bin int, value double")
    steps, cuts, keys = [2, 3, 5], [60.0, 65.0, 70.0], ["case_id", "threshold", "step", "phase"]
    points = deficit.decompose(deficit.with_thresholds(hold.by_phase(hold.phase_arrays(p, steps)), cuts), keys, 0.5)
    samples = deficit.sum_samples(hold.samples(p, steps, seen=True), ["case_id", "step", "phase"], cuts, 0.5)
    names = [*keys, *deficit.MEASURES, *deficit.RATIOS]
    plain = lambda df: sorted((tuple(None if x is None else round(x, 9) + 0.0 for x in row) for row in df.select(*names).collect()), key=repr)
    assert plain(points) == plain(samples)
    shown = hold.shown_at(hold.samples(p, steps), p, steps).select("case_id", "bin", "step", "phase", "held_bin", "shown")
    every = hold.by_phase(hold.phase_arrays(p, steps)).select(shown.columns)
    assert sorted(map(tuple, shown.collect()), key=repr) == sorted(map(tuple, every.collect()), key=repr)


def test_samples_are_as_many_as_bins_whatever_the_phases(spark):
    p = panel(spark, [60.0] * 40)
    for step in (2, 5, 20):
        assert hold.samples(p, [step]).count() == 40 + step - 1
    assert hold.samples(p, [2, 5, 20]).count() == 3 * 40 + 1 + 4 + 19
    seen = hold.samples(p, [20], seen=True)
    # each phase sees every bin once
    assert seen.groupBy("phase").agg(F.sum("bins").alias("n"), F.sum(F.size("seen")).alias("v")).where("n = 40 and v = 40").count() == 20
