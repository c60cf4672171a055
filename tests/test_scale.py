"""What keeps figures in bounds on larger tables: no exploded side is sent whole to every task, nothing is worked out that is not asked for."""

import contextlib
import io
import math
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lacuna.operators import deficit, devices, episodes, grid, hold, outcomes
from lacuna.plans import bindings as b
from lacuna.plans import outcomes as plans
from lacuna.plans import signal
from lacuna.sources import files, readers

SF = "/root/testdata/sf0.001"


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as text:
        df.explain("formatted")
    return text.getvalue()


@pytest.fixture
def panel(spark):
    return spark.createDataFrame([(1, k, float(20 + 7 * k % 40)) for k in range(24)], "case_id long, bin int, value double")


def test_exploded_sides_are_not_broadcast(spark, panel):
    samples = hold.samples(panel, [2, 4])
    spans = spark.createDataFrame([(1, 3, 5)], "case_id long, a int, z int")
    at = spark.createDataFrame([(1, 1, 8 * 60.0)], "case_id long, event_id long, sec double")
    made = [
        episodes.on_show(samples, spans, "a", "z", [2, 4]), hold.shown_at(samples, panel, [2, 4]), devices.states_at(at, samples, [2, 4], panel, 60.0, 35.0, 3, 1),
        devices.recovery(at, samples, [2, 4], panel, 60.0, 35.0, 4, 0.5, 23),
    ]
    for df in made:
        assert "BroadcastHashJoin" not in plan(df)


def wavy(spark, cases=3, bins=40):
    rows = [(c, k, None if (k * 7 + c) % 11 == 0 else float((k * k * (c + 3) + 5 * c) % 41 + 20 * (k % 9 < 4))) for c in range(cases) for k in range(bins)]
    return spark.createDataFrame(rows, "case_id long, bin int, value double")


def test_episodes_are_carried_by_the_panel(spark):
    p, steps, cuts = wavy(spark), [2, 3, 5], [25.0, 40.0]
    e = episodes.tolerant(deficit.with_thresholds(p, cuts), 10.0, 20.0, 0.0)
    joined = episodes.observability(hold.samples(p, steps), e, steps, 10.0, (10.0, 20.0), cuts)
    carried = episodes.observed(p, e, steps, 10.0, (10.0, 20.0), cuts)
    rounded = lambda df: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(sorted(df.columns)).fillna(-1).collect())
    assert rounded(carried) == rounded(joined) and carried.count() > 30
    ev = episodes.bridged(deficit.with_thresholds(p, cuts), 1, 2)
    assert rounded(episodes.classified(p, ev, steps)) == rounded(episodes.classes(hold.samples(p, steps), ev, steps))


def test_samples_are_not_exchanged(spark):
    for name in ("observability", "event_classes", "episode_detection"):
        for keys in re.findall(r"hashpartitioning\(([^)]*)", plan(signal.QUERIES[name](spark, SF))):
            assert "phase" not in keys and "_s#" not in keys and ("step" not in keys or "case_id" not in keys)


def test_a_panel_is_exchanged_once(spark):
    text = plan(signal.QUERIES["longest_run"](spark, SF))
    assert "bin#" not in " ".join(re.findall(r"hashpartitioning\(([^)]*)", text))
    text = plan(signal.QUERIES["numeric_screen"](spark, SF))
    assert "full_outer" not in text.lower() and "FullOuter" not in text and len(re.findall(r"^\(\d+\) SortMergeJoin", text, re.M)) <= 3


def test_screen_breaks_runs_at_gaps(spark):
    rows = [(1, k, v, v) for k, v in [(0, None), (1, 5.0), (2, 5.0), (4, 5.0), (5, 50.0), (6, 5.0), (7, 5.0), (8, 5.0), (9, 5.0)]] + [(2, 0, None, 1.0)]
    out = grid.numeric_screen(spark.createDataFrame(rows, "case_id long, bin int, a double, b double"), ["a", "b"], 8, {"low": F.col("a") < 40, "high": F.col("a") > 90}, 35.0, 1.0).collect()
    assert [(r["case_id"], r["screened"], r["paired"], r["low"], r["high"], r["auc"], r["first_auc"]) for r in out] == [(1, 7, 7, 3, 0, 210.0, 180.0)]


def test_features_of_one_step_and_threshold(spark):
    text = plan(plans.features(spark, SF))
    assert "[4]" in text and "[2,3,4,6,12]" not in text and "60.0" not in text


def test_two_by_two_of_large_counts(spark):
    cells = {(1, 1): 6_020, (1, 0): 24_000, (0, 1): 5_900, (0, 0): 24_080}
    df = spark.range(60_000).selectExpr("int(id >= 30020) as e", "id").selectExpr("1 - e as x", "if(e = 0, int(id < 6020), int(id < 35920)) as y")
    out = outcomes.two_by_two(df, df.x == 1, df.y == 1)
    assert "aggregate(" not in plan(out)  # a sum of logarithms for each table would be quadratic
    row = out.first()
    a, c, d = (row[k] for k in ("a", "c", "d"))
    assert [row[k] for k in "abcd"] == list(cells.values())
    lf = lambda n: math.lgamma(n + 1)
    p = lambda x: sum(map(lf, (30_020, 29_980, 11_920, 48_080))) - lf(60_000) - lf(x) - lf(30_020 - x) - lf(11_920 - x) - lf(d - a + x)
    assert row["fisher_p"] == pytest.approx(sum(math.exp(p(x)) for x in range(11_921) if p(x) <= p(a) + 1e-7), rel=1e-6)


def test_small_waveforms_share_partitions(tmp_path):
    for k in range(40):
        (tmp_path / f"{k}.csv").write_text("time,wave\n0,1\n0.5,2\n")
    reader = readers.WavePrefixReader({"path": str(tmp_path), "seconds": "1"})
    parts = reader.partitions()
    assert len(parts) == 1
    assert sorted(x[0] for x in reader.read(parts[0])) == sorted(f"{k}.csv" for k in range(40) for _ in range(2))


def test_seconds_of_the_sql_are_exact():
    found = duckdb.sql(f"with events as (select 1 as user_id, timestamp '2024-01-02 03:54:01.685' as ts, 0 as value, 'error' as event_type, 1 as event_id), {b.SIG_EXACT} select sec from sig").fetchall()[0][0]
    assert found == 100441.685


def test_changes_are_between_neighbouring_records(spark):
    rows = spark.createDataFrame([(1, 1, 0.0, 10.0), (1, 2, 60.0, None), (1, 3, 120.0, 30.0), (1, 4, 180.0, -5.0), (1, 5, 240.0, 40.0), (1, 6, 300.0, 50.0)], "case_id long, event_id long, sec double, value double")
    found = [(r["sec"], r["previous"], r["value"]) for r in devices.rate_transitions(rows, 3600.0).collect()]
    assert found == [(300.0, 40.0, 50.0)]


def test_robustness_has_a_row_for_each_gap_only(spark):
    assert not re.search(r"case_id#\w+, threshold#\w+, gap_bins#\w+, least_low", plan(signal.QUERIES["event_robustness"](spark, SF)))


def test_peaks_are_counted_for_many_bins_at_once(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.0, 9.0), (1, 2.0, None), (1, 3.0, 9.0), (1, 4.0, 1.0), (2, 5.0, None)], "case_id long, sec double, value double")
    out = grid.wave_peaks(df, 10.0, 2, 5.0)
    assert "FlatMapGroupsInPandas" not in plan(out)
    assert sorted(tuple(r) for r in out.collect()) == [(1, 0, grid.peak_count([1, 9, 5, 9, 1], 2, 5.0)), (2, 0, 0)]


def test_waveforms_are_one_file_a_key(spark, tmp_path):
    df = spark.createDataFrame([(k, i, i / 4, float(i) if i else None) for k in range(50) for i in range(3)], "case_id long, idx int, at double, value double")
    files.write_waves(df, str(tmp_path / "w"), "case_id", ["idx"], "at", "value")
    assert sorted(p.name for p in (tmp_path / "w").iterdir()) == sorted(f"case_id={k}.csv" for k in range(50))
    assert (tmp_path / "w" / "case_id=7.csv").read_text() == "time,wave\n0.0,\n0.25,1.0\n0.5,2.0\n"
