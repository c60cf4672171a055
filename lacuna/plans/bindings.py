"""The test tables bound to the concepts of the library, and the same in SQL.

Case: a user of ``events``; signal: its values over 30 days, in bins of 12 h (60 per case) or, for coverage rules, of 24 h.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions.columns import number, seconds_since
from lacuna.operators import grid, hold

from .registry import table

ORIGIN = "2024-01-01"
DAYS = 30
DURATION = DAYS * 86400.0
STEP, BINS = 43200.0, 60
BIN_MIN = STEP / 60
WIDE = 86400.0
LOW, HIGH = 1.0, 300.0
THRESHOLDS = [20.0, 35.0, 60.0]
STEPS = [2, 3, 4, 6, 12]


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, sec, value, event_type, event_id."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("case_id"), seconds_since("ts", ORIGIN).alias("sec"), number("value").alias("value"), "event_type", "event_id")


def case_windows(rows: DataFrame) -> DataFrame:
    return rows.select("case_id").distinct().select("case_id", F.lit(0.0).alias("start_sec"), F.lit(DURATION).alias("end_sec"))


def panel(spark: SparkSession, sf_dir: str, step: float = STEP, kinds: tuple = ()) -> DataFrame:
    rows = readings(spark, sf_dir)
    kept = rows.where(F.col("event_type").isin(*kinds)) if kinds else rows
    return grid.median_grid(kept, case_windows(rows), step, LOW, HIGH)


def channels(spark: SparkSession, sf_dir: str, step: float, kinds: tuple) -> DataFrame:
    """A panel with a column for each kind of reading."""
    rows = readings(spark, sf_dir)
    return grid.median_grid(rows, case_windows(rows), step, LOW, HIGH, {k: F.col("event_type") == k for k in kinds})


def samples(spark: SparkSession, sf_dir: str, seen: bool = False, steps: list[int] = STEPS) -> DataFrame:
    """What all phases of the intervals sample."""
    return hold.samples(panel(spark, sf_dir), steps, seen)


#: CTEs of the same bindings for DuckDB.
SIG = f"""sig as (select user_id as case_id, epoch(ts) - epoch(timestamp '{ORIGIN}') as sec, value, event_type, event_id from events),
cases as (select distinct case_id from sig)"""
#: The same with seconds exact to the microsecond; the difference of two epochs as doubles is off by up to 2e-7, which moves what lies on the edge of a rounding.
SIG_EXACT = SIG.replace(f"epoch(ts) - epoch(timestamp '{ORIGIN}')", f"(epoch_us(ts) - epoch_us(timestamp '{ORIGIN}')) / 1e6")


def panel_sql(name: str = "panel", step: float = STEP, where: str = "true") -> str:
    return f"""{name} as (select c.case_id, b.bin::int as bin, g.value from cases c cross join range({int(DURATION / step)}) b(bin)
left join (select case_id, floor(sec / {step})::int as bin, median(value) as value from sig where value between {LOW} and {HIGH} and sec >= 0 and sec < {DURATION} and {where} group by 1, 2) g
on g.case_id = c.case_id and g.bin = b.bin)"""


BASE = f"with {SIG}, {panel_sql()}"
DISPLAY = f"""{BASE}, sched as (select s.step, p.phase from (values (2), (3), (4), (6), (12)) s(step), range(s.step) p(phase)),
display as (select case_id, bin, value, step::int as step, phase::int as phase,
  last_value(case when (bin - phase) % step = 0 and bin >= phase and value is not null then bin end ignore nulls) over w as held_bin,
  last_value(case when (bin - phase) % step = 0 and bin >= phase and value is not null then value end ignore nulls) over w as shown
  from panel cross join sched window w as (partition by case_id, step, phase order by bin rows between unbounded preceding and current row))"""
CUTS = "thr as (select * from (values (20.0::double), (35.0::double), (60.0::double)) t(threshold))"
POINTS = f"""{DISPLAY}, {CUTS},
pts as (select d.*, threshold, value is not null as valid, shown is not null as up,
  case when value is not null then greatest(threshold - value, 0) else 0 end as r,
  case when value is not null and shown is not null then greatest(threshold - shown, 0) else 0 end as d from display d cross join thr)"""


def sums_sql(keys: str, source: str = "pts", minutes: float = BIN_MIN) -> str:
    m = minutes
    return f"""select {keys}, sum(r) * {m} as true_auc, sum(d) * {m} as display_auc, sum(greatest(r - d, 0)) * {m} as hidden_auc, sum(greatest(d - r, 0)) * {m} as over_auc, sum(least(r, d)) * {m} as concordant_auc,
sum(case when not up then greatest(r - d, 0) else 0 end) * {m} as hidden_unavailable_auc, sum(case when up then greatest(r - d, 0) else 0 end) * {m} as hidden_valid_auc,
count(*) filter (valid) * {m} as valid_min, count(*) filter (valid and up) * {m} as available_min, count(*) filter (value < threshold) * {m} as true_low_min,
count(*) filter (valid and shown < threshold) * {m} as display_low_min, count(*) filter (value < threshold and shown < threshold) * {m} as both_low_min,
count(*) filter (value < threshold and shown >= threshold) * {m} as normal_discordant_min, count(*) filter (value >= threshold and shown < threshold) * {m} as low_discordant_min,
count(*) filter (value < threshold and not up) * {m} as unavailable_low_min from {source} group by all"""


MEASURES = "true_auc display_auc hidden_auc over_auc concordant_auc hidden_unavailable_auc hidden_valid_auc valid_min available_min true_low_min display_low_min both_low_min normal_discordant_min low_discordant_min unavailable_low_min"
RATIOS_SQL = """hidden_auc / nullif(true_auc, 0) as hdr, over_auc / nullif(true_auc, 0) as odr, (over_auc - hidden_auc) / nullif(true_auc, 0) as net,
concordant_auc / nullif(true_auc, 0) as concordance, available_min / nullif(valid_min, 0) as availability"""
RATIOS = "hdr odr net concordance availability"
FACTS = f"{POINTS}, facts as ({sums_sql('case_id, threshold, step, phase')})"
MEANS = f"""{FACTS}, means0 as (select case_id, threshold, step, {', '.join(f'avg({m}) as {m}' for m in MEASURES.split())}, count(*) as phases from facts group by all),
means as (select *, {RATIOS_SQL} from means0)"""
