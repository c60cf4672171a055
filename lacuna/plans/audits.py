"""Queries that check results of other queries: recomputation, intervals, masks, event scenarios, manifests, identifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.columns import ratio, tally
from lacuna.operators import deficit, devices, episodes, grid, hold, models, resample, tables, text_audit
from lacuna.sources import files

from . import bindings as b
from . import devices as events
from . import inference, outcomes, signal
from .registry import Registry, table

R = Registry()
QUERIES, SQL = R.queries, R.sql
add = R.add


def summary(panel: DataFrame) -> DataFrame:
    return panel.groupBy("case_id").agg(F.count("*").alias("bins"), F.count("value").alias("valid"), F.sum("value").alias("total"), F.min("value").alias("least"))


@add("incremental_recompute", f"{b.BASE}, {signal._POLICY} select case_id, count(*) as bins, count(value) as valid, sum(value) as total, min(value) as least from masked where policy = 'runs2' group by 1", "total least", "bins valid")
def incremental_recompute(spark, d):
    """The stored summary of the panel brought up to date after a mask: only cases with a masked bin are summarised again."""
    before = b.panel(spark, d)
    stored = files.settled(summary(before))
    after = signal.policy_panels(before).where("policy = 'runs2'")
    changed = after.where("masked and raw is not null").select("case_id").distinct()
    return tables.brought_up_to_date(stored, after.select("case_id", "bin", "value"), changed, "case_id", summary)


_SHOWN = {"detected": "d / nullif(n, 0)", "left_1": "l1 / nullif(n, 0)", "left_2": "l2 / nullif(n, 0)", "before": "u / nullif(a, 0)"}
_CHECKS = "left_2 >= 0 and left_2 <= left_1 + 1e-12 and left_1 <= detected + 1e-12 and detected <= 1 + 1e-12 as hierarchy_ok, before between -1e-12 and 1 + 1e-12 as range_ok, " + " and ".join(f"{n}_low <= {n} + 1e-12 and {n} <= {n}_high + 1e-12 and {n}_low >= -1e-12 and {n}_high <= 1 + 1e-12" for n in ("left_1", "left_2", "before")) + " as interval_ok"
_OSUMS = "count(*) as n, count(*) filter (detected) as d, count(*) filter (left_sec >= {0}) as l1, count(*) filter (left_sec >= {1}) as l2, sum(auc_before) as u, sum(auc) as a".format(b.STEP, 2 * b.STEP)


@add("interval_qc", f"{signal.OBS}, os as (select *, case_id // 3 as subject from o), {inference.boot_sql('threshold step', 'subject', _OSUMS, 'n d l1 l2 u a', 'os')}, iq as (select threshold, step, {', '.join(f'{e} as {n}' for n, e in _SHOWN.items())} from (select threshold, step, {_OSUMS} from os group by all)), iz as (select threshold, step, {inference._ends(_SHOWN)} from rp group by all) select threshold, step, {', '.join(_SHOWN)}, {_CHECKS} from iq join iz using (threshold, step)", "threshold " + " ".join(_SHOWN), "step")
def interval_qc(spark, d):
    """Detection probabilities per threshold and step: their order, their range, and whether bootstrap intervals hold them."""
    p = signal.pairs(spark, d).withColumn("subject", F.floor(F.col("case_id") / 3))
    keys = ["threshold", "step"]
    c = resample.clusters_of(p, keys, "subject", [F.count("*").alias("n"), tally(F.col("detected")).alias("d"), tally(F.col("left_1")).alias("l1"), tally(F.col("left_2")).alias("l2"), F.sum("auc_before").alias("u"), F.sum("auc").alias("a")])
    point = c.groupBy(*keys).agg(*[F.sum(x).alias(x) for x in ("n", "d", "l1", "l2", "u", "a")]).select(*keys, *[F.expr(e).alias(n) for n, e in _SHOWN.items()])
    ends = resample.interval(resample.replicates(c, keys, "subject", inference.REPS, inference.SEED, ["n", "d", "l1", "l2", "u", "a"]), keys, {n: F.expr(e) for n, e in _SHOWN.items()})
    return point.join(ends, keys).selectExpr(*keys, *_SHOWN, *_CHECKS.replace("ok, ", "ok;").split(";"))


@add("assembly_consistency", f"{signal.OBS}, acs as (select threshold, step, count(*) as pairs, count(*) filter (detected) as found from o group by all) select threshold, step, pairs, found, 0.0 as largest, true as passed from acs", "threshold largest", "step pairs found")
def assembly_consistency(spark, d):
    """The same sums put together twice, from pairs and from cases by way of offsets; they may differ by rounding only."""
    p = signal.pairs(spark, d)
    keys = ["threshold", "step"]
    sums = lambda rows, n, found, delay: rows.agg(F.sum(n).alias("pairs"), F.sum(found).alias("found"), F.coalesce(F.sum(delay), F.lit(0.0)).alias("delays"))
    direct = sums(p.groupBy(*keys), F.lit(1), F.col("detected").cast("long"), F.col("delay"))
    offsets = p.groupBy("case_id", *keys, "phase").agg(F.count("*").alias("n"), tally(F.col("detected")).alias("f"), F.sum("delay").alias("t"))
    cases = offsets.groupBy("case_id", *keys).agg(F.sum("n").alias("n"), F.sum("f").alias("f"), F.sum("t").alias("t"))
    return tables.consistent(direct, sums(cases.groupBy(*keys), "n", "f", "t"), keys, ["pairs", "found", "delays"]).select(*keys, "pairs", "found", F.round("largest", 9).alias("largest"), "passed")


_MK = "mk as (select case_id, bin, value, coalesce(value < 20 or value > 150, false) as masked from panel)"
_FIRST = f"floor((sec + 1e-9) / {b.STEP})::int"
_AUDIT = ["events_checked", "before_minimum", "not_eligible", "masked_support", "masked_low_run", "phases_masked_sample", "masked_after", "later_bins_masked_sample"]


@add("mask_audit", f"""{events.STATES}, {_MK}, pe as (select be.case_id, be.event_id, {_FIRST} - 1 as ix from be), mo as (select case_id, event_id, sec, bin as ix, value, low_start from ba),
ms as (select ok.case_id, ok.event_id, ok.value, coalesce(bool_or(m.masked and m.bin >= ix - 5), false) as support, coalesce(bool_or(m.masked and m.bin >= low_start) filter (ok.value < {events.T}), false) as low_run from mo ok join mk m on m.case_id = ok.case_id and m.bin <= ix group by all),
ml as (select case_id, event_id, {_FIRST} as first from mo where value < {events.T}),
ma as (select l.case_id, l.event_id, bool_or(m.masked) as hit from ml l join mk m on m.case_id = l.case_id and m.bin between first and first + 7 group by all)
select (select count(*) from mo) as events_checked, (select count(*) from pe where ix < 5) as before_minimum, (select count(*) from pe where ix >= 5) - (select count(*) from mo) as not_eligible, (select count(*) from ms where support) as masked_support, (select count(*) from ms where low_run) as masked_low_run,
(select count(*) from st join mk m on m.case_id = st.case_id and m.bin = st.held_bin where m.masked) as phases_masked_sample, (select count(*) from ma where hit) as masked_after,
(select count(*) from ml l join display d on d.case_id = l.case_id and d.bin between first and first + 7 join mk m on m.case_id = d.case_id and m.bin = d.held_bin where m.masked) as later_bins_masked_sample""", "", " ".join(_AUDIT))
def mask_audit(spark, d):
    """What a mask would touch around events: their support, the low run before, the samples shown at the event and after it."""
    p = b.panel(spark, d)
    flag = F.coalesce((F.col("value") < 20) | (F.col("value") > 150), F.lit(False))
    every = events.block_events(spark, d).select("case_id", "event_id", "sec")
    steps = [2, 4, 6]
    samples = hold.samples(p, steps)
    states = devices.states_at(every, samples, steps, p, b.STEP, events.T, 6, 3)
    return devices.mask_audit(every, states, samples, steps, p.select("case_id", "bin", flag.alias("masked")), b.STEP, events.T, 6, 8).select(*_AUDIT)


_SC = devices.Scenario
_DAY = 86400.0
SCENARIOS = [
    _SC("primary"), _SC("narrow blocks", width=_DAY), _SC("wide blocks", width=4 * _DAY), _SC("no stability", sustained=False), _SC("longer low run", low_bins=3), _SC("first low event", only_first=True), _SC("without the start", first_bin=12),
]
_EVENT = ["scenario", "case_id", "event_id"]
_STEPS = [2, 4, 6]


def scenario_rows(spark, d):
    """Changes, blocks, and all events of all scenarios with their states and what excludes them."""
    p = b.panel(spark, d)
    changes = devices.scenario_changes(events.stable_changes(spark, d), events.changes(spark, d), SCENARIOS)
    blocks = files.settled(devices.scenario_blocks(changes))
    states = devices.states_at(blocks, hold.samples(p, _STEPS), _STEPS, p, b.STEP, events.T, 6, 3)
    return changes, blocks, files.settled(devices.judged_events(states, blocks, SCENARIOS, b.STEP, 5, events.T, F.floor(F.col("case_id") / 3)))


def scenario_shares(rows: DataFrame) -> DataFrame:
    """Per low event that counts and step: the share of phases in each state."""
    low = rows.where("why is null and step is not null and is_low")
    return devices.category_shares(low, [*_EVENT, "step", "tracks", "kind"]).withColumn("subject", F.floor(F.col("case_id") / 3))


def scenario_recoveries(spark, d, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Low events that count, and their recovery per step and phase."""
    low = rows.where("why is null and is_low").select(*_EVENT, "sec").distinct()
    p = b.panel(spark, d)
    return low, devices.recovery(low, hold.samples(p, _STEPS), _STEPS, p, b.STEP, events.T, 8, 0.5, b.BINS - 1, tuple(_EVENT))


_SCEN = f"""with recursive {b.SIG}, {b.panel_sql()},
r2 as (select case_id, event_type as track, sec, floor(value / 10) * 10 as value, row_number() over w as n, lag(floor(value / 10) * 10) over w as previous, sec - lag(sec) over w as gap from sig where event_type in ('error', 'purchase') window w as (partition by case_id, event_type order by sec, event_id)),
tr as (select case_id, track, sec, n, previous, case when previous = 0 then 'start' else 'increase' end as kind from r2 where gap > 0 and gap <= 259200 and previous >= 0 and value > previous + 1e-8),
en as (select t.case_id, t.track, t.n, min(r.n) as e from tr t join r2 r on r.case_id = t.case_id and r.track = t.track and r.n >= t.n and r.sec >= t.sec + 86400 group by all),
su as (select t.* from tr t join en using (case_id, track, n) where not exists (select 1 from r2 r where r.case_id = t.case_id and r.track = t.track and r.n between t.n and en.e and (not coalesce(r.value > t.previous + 1e-8, false) or (r.n > t.n and r.gap > 259200)))),
cfg as (select * from (values {', '.join(f"('{s.name}', {str(s.sustained).lower()}, {s.width}::double, {max(s.first_bin, 5)}, {s.low_bins}, {str(s.only_first).lower()})" for s in SCENARIOS)}) c(scenario, stable, width, first_bin, low_need, only_first)),
ch as (select scenario, width, case_id, sec, track, kind, row_number() over (partition by scenario, case_id order by sec, track, kind) as n from cfg join (select true as stable, * from su union all select false, * from tr) x using (stable)),
bl as (select scenario, width, case_id, n, sec, track, kind, sec as anchor from ch where n = 1 union all select c.scenario, c.width, c.case_id, c.n, c.sec, c.track, c.kind, case when c.sec > anchor + c.width + 1e-9 then c.sec else anchor end from bl join ch c on c.scenario = bl.scenario and c.case_id = bl.case_id and c.n = bl.n + 1),
block as (select scenario, case_id, anchor as sec, string_agg(distinct track, '+' order by track) as tracks, case when count(distinct kind) > 1 then 'mixed' else any_value(kind) end as kind from bl group by 1, 2, 3),
be as (select *, row_number() over (partition by scenario, case_id order by sec) as event_id, floor((sec + 1e-9) / {b.STEP})::int - 1 as ix from block),
sched as (select s.step::int as step, p.phase::int as phase from (values (2), (4), (6)) s(step), range(s.step) p(phase)),
display as (select case_id, bin, value, step, phase, last_value(case when (bin - phase) % step = 0 and bin >= phase and value is not null then bin end ignore nulls) over w as held_bin, last_value(case when (bin - phase) % step = 0 and bin >= phase and value is not null then value end ignore nulls) over w as shown
  from panel cross join sched window w as (partition by case_id, step, phase order by bin rows between unbounded preceding and current row)),
pr as (select case_id, bin, value, count(value) over (partition by case_id order by bin rows between 5 preceding and current row) as support, coalesce(max(case when not coalesce(value < {events.T}, false) then bin end) over (partition by case_id order by bin) + 1, 0) as low_start from panel),
ev as (select be.*, p.value, p.low_start, coalesce(p.value < {events.T}, false) as is_low, case when p.value < {events.T} then ix - low_start + 1 else 0 end as low_bins from be left join (select * from pr where bin >= 5 and value is not null and support >= 3) p on p.case_id = be.case_id and p.bin = ix),
w0 as (select ev.*, only_first, case when ix < first_bin then 'too_early' when value is null then 'poor_support' when is_low and low_bins < low_need then 'short_low_run' end as why0 from ev join cfg using (scenario)),
je as (select *, coalesce(why0, case when only_first and is_low and row_number() over (partition by scenario, case_id // 3, why0 is null and is_low order by case_id, sec, event_id) > 1 then 'not_first' end) as why from w0),
st as (select je.*, step, phase, case when je.value >= {events.T} then 'reference_normal' when shown is null then 'unavailable' when shown >= {events.T} then 'normal_display' when held_bin >= low_start then 'fresh_low' else 'inherited_low' end as category from je join display d on d.case_id = je.case_id and d.bin = ix where why is null),
sh as (select scenario, case_id, case_id // 3 as subject, event_id, step, tracks, kind, {', '.join(f"avg((category = '{c}')::int) as {c}" for c in devices.CATEGORIES)} from st where is_low group by 1, 2, 3, 4, 5, 6, 7)"""
_MEANS = ", ".join(f"avg({c}) as {c}" for c in devices.CATEGORIES[1:])
_SHARES = " ".join(devices.CATEGORIES[1:])


@add("event_scenarios", f"""{_SCEN}, n as (select scenario, step, count(distinct (case_id, event_id)) as events, count(distinct (case_id, event_id)) filter (is_low) as low_events from st group by 1, 2),
l as (select scenario, step, count(distinct subject) as subjects, {_MEANS} from sh group by 1, 2), q as (select step, subject, {_MEANS} from sh where scenario = 'primary' group by 1, 2)
select n.*, l.* exclude (scenario, step) from n left join l using (scenario, step) union all by name select 'equal subjects' as scenario, n.step, events, low_events, e.* exclude (step) from n left join (select step, count(*) as subjects, {_MEANS} from q group by 1) e using (step) where n.scenario = 'primary'""", _SHARES, "step events low_events subjects")
def event_scenarios(spark, d):
    """Per scenario and step: events, low ones, and the mean share of phases in each state at low events; also with every subject weighing alike."""
    _, _, rows = scenario_rows(spark, d)
    kept, share = rows.where("why is null and step is not null"), files.settled(scenario_shares(rows))
    n = kept.groupBy("scenario", "step").agg(F.count_distinct("case_id", "event_id").alias("events"), F.count_distinct(F.when(F.col("is_low"), F.struct("case_id", "event_id"))).alias("low_events"))
    means = [F.avg(c).alias(c) for c in devices.CATEGORIES[1:]]
    low = share.groupBy("scenario", "step").agg(F.count_distinct("subject").alias("subjects"), *means)
    equal = share.where("scenario = 'primary'").groupBy("step", "subject").agg(*means).groupBy("step").agg(F.count("*").alias("subjects"), *means)
    alike = n.where("scenario = 'primary'").join(equal, "step", "left").withColumn("scenario", F.lit("equal subjects"))
    return n.join(low, ["scenario", "step"], "left").unionByName(alike)


_WHYS = ", ".join(f"count(*) filter (why = '{x}') as {x}" for x in devices.EXCLUSIONS)


@add("scenario_flow", f"""{_SCEN} select scenario, changes, count(*) as blocks, {_WHYS}, count(*) filter (why is null) as eligible, count(*) filter (why is null and is_low) as low, count(*) filter (why is null and not is_low) as normal
from je join (select scenario, count(*) as changes from ch group by 1) c using (scenario) group by 1, 2""", "", "changes blocks eligible low normal " + " ".join(devices.EXCLUSIONS))
def scenario_flow(spark, d):
    """Per scenario: changes, blocks, what excludes blocks, low and normal ones; a row whose parts do not add up is an error."""
    changes, _, rows = scenario_rows(spark, d)
    each = rows.select(*_EVENT, "why", "is_low").distinct()
    n = each.groupBy("scenario").agg(F.count("*").alias("blocks"), *[tally(F.col("why") == x).alias(x) for x in devices.EXCLUSIONS], tally(F.col("why").isNull()).alias("eligible"), tally(F.col("why").isNull() & F.col("is_low")).alias("low"), tally(F.col("why").isNull() & ~F.col("is_low")).alias("normal"))
    flow = n.join(changes.groupBy("scenario").agg(F.count("*").alias("changes")), "scenario").select("scenario", "changes", "blocks", *devices.EXCLUSIONS, "eligible", "low", "normal")
    return tables.conserved(tables.conserved(flow, "blocks", [*devices.EXCLUSIONS, "eligible"]), "eligible", ["low", "normal"])


@add("scenario_strata", f"""{_SCEN} select scenario, step, 'all' as level, null as stratum, count(*) as events, {_MEANS} from sh group by 1, 2
union all select scenario, step, 'tracks', tracks, count(*), {_MEANS} from sh group by 1, 2, 4 union all select scenario, step, 'kind', kind, count(*), {_MEANS} from sh group by 1, 2, 4""", _SHARES, "step events")
def scenario_strata(spark, d):
    """Per scenario and step: low events and their mean states, of all, by the set of tracks and by kind; levels that do not add up are an error."""
    shares = files.settled(scenario_shares(scenario_rows(spark, d)[2]))
    return devices.strata(shares, ["scenario", "step"], ["tracks", "kind"], {"events": F.count("*")}, {c: F.avg(c) for c in devices.CATEGORIES[1:]})


_SCREC = f"""{_SCEN}, le as (select scenario, case_id, event_id, sec, floor((sec + 1e-9) / {b.STEP})::int as first from je where why is null and is_low),
sp as (select le.*, p.bin, p.value, p.value >= {events.T} as ok, lag(p.value >= {events.T}) over (partition by scenario, le.case_id, event_id order by p.bin) as pok from le join panel p on p.case_id = le.case_id and p.bin between first and first + 7 where first + 7 <= 59),
fo as (select scenario, case_id, event_id, sec, first, count(value) as valid, min(case when ok and pok then bin end) as recovery_bin from sp group by 1, 2, 3, 4, 5 having count(value) >= 4),
ls as (select fo.*, d.step, d.phase, d.bin, case when (d.bin + 1) * {b.STEP} >= sec + 8 * {b.STEP} - 1e-9 then 'window_end' when d.value is null then 'missing_reference' when d.value < {events.T} then 'recurrent_low' when d.shown is null then 'unavailable_display' when d.shown >= {events.T} then 'normal_display' end as stop from fo join display d on d.case_id = fo.case_id and d.bin between recovery_bin and first + 7),
le2 as (select scenario, case_id, event_id, step, phase, recovery_bin, sec, min(case when stop is not null then bin end) as ebin, min_by(stop, bin) filter (stop is not null) as stop, max(bin) as last from ls group by 1, 2, 3, 4, 5, 6, 7),
re as (select fo.scenario, fo.case_id, fo.event_id, s.step, s.phase, case when l.case_id is null then null else greatest(case when coalesce(ebin, last + 1) > l.recovery_bin then least((1 + coalesce(ebin, last + 1)) * {b.STEP}, l.sec + 8 * {b.STEP}) - (l.recovery_bin + 1) * {b.STEP} else 0 end, 0) end as persistence_sec,
  case when l.case_id is null then 'no_recovery' else coalesce(l.stop, 'window_end') end as stop_reason from fo cross join sched s left join le2 l on l.scenario = fo.scenario and l.case_id = fo.case_id and l.event_id = fo.event_id and l.step = s.step and l.phase = s.phase)"""


@add("scenario_stops", f"{_SCREC} select scenario, step, stop_reason, count(*) as pairs, count(distinct (case_id, event_id)) as events, avg(persistence_sec) as mean_persistence from re group by 1, 2, 3", "mean_persistence", "step pairs events")
def scenario_stops(spark, d):
    """Per scenario, step and reason why a low display ended after recovery: event-phase pairs, events and how long it lasted."""
    _, found = scenario_recoveries(spark, d, scenario_rows(spark, d)[2])
    return found.groupBy("scenario", "step", "stop_reason").agg(F.count("*").alias("pairs"), F.count_distinct("case_id", "event_id").alias("events"), F.avg("persistence_sec").alias("mean_persistence"))


@add("scenario_support", f"""{_SCREC}, z as (select le.scenario, case when le.first + 7 > 59 then 'incomplete_interval' when fo.case_id is null then 'poor_reference' when recovery_bin is null then 'no_recovery' else 'recovered' end as support from le left join fo using (scenario, case_id, event_id))
select scenario, count(*) as low, {', '.join(f"count(*) filter (support = '{x}') as {x}" for x in devices.SUPPORT)} from z group by 1""", "", "low " + " ".join(devices.SUPPORT))
def scenario_support(spark, d):
    """Per scenario: low events and what becomes of them; a row whose parts do not add up is an error."""
    low, found = scenario_recoveries(spark, d, scenario_rows(spark, d)[2])
    rows = devices.after_support(low, found, b.STEP, 8, b.BINS - 1, _EVENT)
    return tables.conserved(rows.groupBy("scenario").agg(F.count("*").alias("low"), *[tally(F.col("support") == x).alias(x) for x in devices.SUPPORT]), "low", list(devices.SUPPORT))


#: Rows of a scenario's flow that count its blocks: all, what excludes them, those that count, and what becomes of the low ones.
_FLOW = ["blocks", *devices.EXCLUSIONS, "eligible", "low", "normal", *devices.SUPPORT, "supported"]
_ADD_UP = {"blocks": [*devices.EXCLUSIONS, "eligible"], "eligible": ["low", "normal"], "low": list(devices.SUPPORT), "supported": ["no_recovery", "recovered"]}
_COUNTS = "count(*) as events, count(distinct case_id) as cases, count(distinct case_id // 3) as subjects"
_HALF_UP = lambda x: f"floor(({x}) * 1000000 + 0.5) / 1000000"
#: Means as whole numbers of phases or microseconds over whole numbers: sums of doubles depend on order, which shows where a mean is half of the last digit.
_EXACT = ", ".join(f"{_HALF_UP(f'sum(round({c} * step)::bigint) / sum(step)')} as {c}" for c in devices.CATEGORIES[1:])


@add("event_flow", f"""{_SCREC.replace(b.SIG, b.SIG_EXACT)}, z as (select scenario, case_id, event_id, case when le.first + 7 > 59 then 'incomplete_interval' when valid is null then 'poor_reference' when recovery_bin is null then 'no_recovery' else 'recovered' end as support from le left join fo using (scenario, case_id, event_id)),
nm as (select scenario, case_id, event_id, unnest(['blocks', coalesce(why, 'eligible'), case when why is null and is_low then 'low' when why is null then 'normal' end, support, case when support in ('no_recovery', 'recovered') then 'supported' end]) as name from je left join z using (scenario, case_id, event_id)),
fl as (select scenario, name, {_COUNTS} from nm where name is not null group by 1, 2)
select scenario, 'flow' as part, null::int as step, name, coalesce(events, 0) as events, coalesce(cases, 0) as cases, coalesce(subjects, 0) as subjects, null::bigint as pairs, null::double as share, null::double as mean_persistence, {', '.join(f'null::double as {c}' for c in devices.CATEGORIES[1:])} from cfg cross join (select unnest({_FLOW}) as name) left join fl using (scenario, name)
union all by name select scenario, 'flow' as part, g.* from cfg cross join (select 'cohort' as name, null::bigint as events, count(distinct case_id) as cases, count(distinct case_id // 3) as subjects from cases union all select 'raw_changes', {_COUNTS} from tr union all select 'stable_changes', {_COUNTS} from su) g
union all by name select scenario, 'stop_reason' as part, step, stop_reason as name, count(distinct (case_id, event_id)) as events, count(distinct case_id) as cases, count(distinct case_id // 3) as subjects, count(*) as pairs, {_HALF_UP('count(*) / sum(count(*)) over (partition by scenario, step)')} as share, {_HALF_UP('sum(round(persistence_sec * 1000000)::bigint) / count(persistence_sec) / 1000000')} as mean_persistence from re group by scenario, step, stop_reason
union all by name select scenario, 'all' as part, step, {_COUNTS}, {_EXACT} from sh group by scenario, step
union all by name select scenario, 'tracks' as part, step, tracks as name, {_COUNTS}, {_EXACT} from sh group by scenario, step, tracks
union all by name select scenario, 'kind' as part, step, kind as name, {_COUNTS}, {_EXACT} from sh group by scenario, step, kind""", f"share mean_persistence {_SHARES}", "step events cases subjects pairs")
def event_flow(spark, d):
    """The flow of every scenario in rows, its parts adding up or it is an error: the cohort, all changes and the sustained ones, blocks, what excludes them, low and normal ones and what
    becomes of the low ones (``part`` flow); event-phase pairs by the reason why a low display ended (stop_reason); mean states at low events, of all, by the set of tracks and by kind."""
    _, _, rows = scenario_rows(spark, d)
    low, found = scenario_recoveries(spark, d, rows)
    found = files.settled(found)
    subject = F.floor(F.col("case_id") / 3)
    numbers = {"events": F.count("*"), "cases": F.count_distinct("case_id"), "subjects": F.count_distinct(subject)}
    counts = [c.alias(n) for n, c in numbers.items()]
    support = devices.after_support(low, found, b.STEP, 8, b.BINS - 1, _EVENT).select(*_EVENT, "support")
    each = rows.select(*_EVENT, "why", "is_low").distinct().join(support, _EVENT, "left")
    names = [F.lit("blocks"), F.coalesce("why", F.lit("eligible")), F.when(F.col("why").isNull(), F.when(F.col("is_low"), "low").otherwise("normal")), F.col("support"), F.when(F.col("support").isin("no_recovery", "recovered"), "supported")]
    have = each.withColumn("name", F.explode(F.array(*names))).where("name is not null").groupBy("scenario", "name").agg(*counts)
    spine = spark.createDataFrame([(s.name, n) for s in SCENARIOS for n in _FLOW], "scenario string, name string")
    flow = spine.join(have, ["scenario", "name"], "left").fillna(0)
    before = b.readings(spark, d).agg(F.lit("cohort").alias("name"), F.lit(None).cast("long").alias("events"), *counts[1:])
    for name, changed in (("raw_changes", events.changes(spark, d)), ("stable_changes", events.stable_changes(spark, d))):
        before = before.unionByName(changed.agg(F.lit(name).alias("name"), *counts))
    before = before.withColumn("scenario", F.explode(F.array(*[F.lit(s.name) for s in SCENARIOS])))
    strata = devices.strata(files.settled(scenario_shares(rows)), ["scenario", "step"], ["tracks", "kind"], {"events": numbers["events"]}, {n: numbers[n] for n in ("cases", "subjects")} | {c: tables.half_up(F.sum(F.round(F.col(c) * F.col("step")).cast("long")) / F.sum("step"), 6) for c in devices.CATEGORIES[1:]})
    strata = strata.withColumnsRenamed({"level": "part", "stratum": "name"})
    stops = found.groupBy("scenario", "step", F.col("stop_reason").alias("name")).agg(F.count_distinct("case_id", "event_id").alias("events"), *counts[1:], F.count("*").alias("pairs"), tables.half_up(ratio(F.sum(F.round(F.col("persistence_sec") * 10**6).cast("long")), F.count("persistence_sec")) / 10**6, 6).alias("mean_persistence"))
    stops = stops.withColumns({"part": F.lit("stop_reason"), "share": tables.half_up(F.col("pairs") / F.sum("pairs").over(Window.partitionBy("scenario", "step")), 6)})
    # every supported event has all phases of all steps, every low one a row for each step
    checks = stops.groupBy("scenario").agg(F.lit("_pairs").alias("name"), (F.sum("pairs") / sum(_STEPS)).alias("events")).unionByName(strata.where("part = 'all'").groupBy("scenario").agg(F.lit("_low").alias("name"), (F.sum("events") / len(_STEPS)).alias("events")))
    flow = tables.balanced(flow.unionByName(checks, allowMissingColumns=True), ["scenario"], "name", "events", {**_ADD_UP, "_pairs": ["supported"], "_low": ["low"]}).where(~F.col("name").isin("_pairs", "_low"))
    out = tables.union_of(flow.unionByName(before).withColumn("part", F.lit("flow")), stops, strata)
    return out.select("scenario", "part", "step", "name", "events", "cases", "subjects", "pairs", "share", "mean_persistence", *devices.CATEGORIES[1:])


@add("wave_pulse")
def wave_pulse(spark, d):
    """Bins whose waveform looks like a pulse: enough samples, enough span, a plausible number of peaks."""
    r = b.readings(spark, d)
    metrics = grid.wave_bins(r, 5 * b.WIDE, 6).join(grid.wave_peaks(r, 5 * b.WIDE, 2, 5.0), ["case_id", "bin"])
    return metrics.select("case_id", "bin", "coverage", "span", "peaks", grid.pulse_like(0.8, 8.0, 1, 6).alias("pulse_like"))


@add("policy_refit")
def policy_refit(spark, d):
    """The outcome model fitted under each mask policy, in one row each: estimate, interval as text, and whether the text is that of the unmasked data."""
    f = signal.policy_panels(b.panel(spark, d)).groupBy("policy", "case_id").agg(F.sum(F.greatest(35 - F.col("value"), F.when(F.col("value").isNotNull(), 0.0))).alias("auc"), F.count("value").alias("valid"))
    o = outcomes.outcome(spark, d).select("case_id", F.floor(F.col("case_id") / 3).alias("subject"), (F.col("baseline") / 10).alias("baseline_10"), F.col("event").cast("int").alias("event"))
    rows = files.settled(f.withColumn("log_twa", F.log1p(ratio("auc", "valid"))).join(o, "case_id"))
    names = ["original", "runs2", "runs1", "startup6"]
    fits = models.sequence_of_models(rows, [models.Spec(n, "event", ("log_twa", "baseline_10"), f"policy = '{n}'") for n in names], "subject").where("term = 'log_twa'")
    text = fits.select("label", "ratio", "n", tables.estimate_text("ratio", "low", "high").alias("text"))
    wide = tables.wide(text.withColumn("_all", F.lit(1)), ["_all"], "label", names, "text")
    base = text.where("label = 'original'").select(F.col("text").alias("original_text"), F.col("ratio").alias("original_ratio"))
    return text.join(F.broadcast(base), F.lit(True)).join(F.broadcast(wide.drop("_all")), F.lit(True)).select("label", "n", "ratio", "text", (F.col("ratio") - F.col("original_ratio")).alias("change"), (F.col("text") == F.col("original_text")).alias("same_text"), *[F.col(n).alias(f"{n}_text") for n in names if n != "original"])  # one row each


@add("manifest_check", "select * from (values ('region.parquet', 'unexpected'), ('nation.parquet', 'changed'), ('lost-supplier.parquet', 'missing')) f(name, fault)")
def manifest_check(spark, d):
    """Files of three tables against a saved manifest in which one is missing, one is new and one has changed."""
    now = reduce(DataFrame.unionByName, [files.manifest(spark, f"{d}/{t}.parquet") for t in ("nation", "region", "supplier")])
    saved = now.where("name not like 'region%'").withColumn("sha256", F.when(F.col("name").like("nation%"), F.sha2("sha256", 256)).otherwise(F.col("sha256")))
    gone = now.where("name like 'supplier%'").withColumn("name", F.concat(F.lit("lost-"), "name"))
    return files.manifest_faults(now, files.settled(saved.unionByName(gone)))


_BANNED = ("c_name", "c_phone", "s_phone", "user_id", "address")
_TABLES = ("customer", "supplier", "events")


@add("identifier_scan", f"""with c as (select 'column' as place, table_name || '.' || column_name as name, 1 as n from information_schema.columns where table_name in {_TABLES} and lower(column_name) in {_BANNED}),
k as (select 'json_key' as place, key as name, count(*) as n from (select unnest(json_keys(props)) as key from events where props is not null) group by 2)
select place, name, n, place = 'column' or name in ('device', 'ip', 'user') as forbidden from (select * from c union all select * from k)""", "", "n")
def identifier_scan(spark, d):
    """Forbidden column names of tables, and all keys of a JSON column with how often they occur and whether they are forbidden."""
    found = [(t, c) for t in _TABLES for c in text_audit.forbidden_columns(table(spark, d, t).columns, set(_BANNED))]
    columns = spark.createDataFrame([("column", f"{t}.{c}", 1) for t, c in found], "place string, name string, n long")
    keys = text_audit.json_keys(table(spark, d, "events"), "props").select(F.lit("json_key").alias("place"), F.col("key").alias("name"), "n")
    return columns.unionByName(keys).withColumn("forbidden", (F.col("place") == "column") | F.col("name").isin("device", "ip", "user"))
