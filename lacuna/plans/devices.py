"""Queries over second-device events, nearest joins, rate changes, states and recovery."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lacuna.functions.columns import dealt, ratio, tally
from lacuna.operators import deficit, devices, grid, hold, ranks
from lacuna.sources import files

from . import bindings as b
from .registry import Registry

R = Registry()
QUERIES, SQL = R.queries, R.sql
add = R.add
OTHERS = ("click", "purchase", "signup", "error")
HOLD, GAP = 36 * 3600.0, 48 * 3600.0


def raw(spark, d):
    """Second device: values of 'view' in steps of ten."""
    return b.readings(spark, d).where("event_type = 'view'").select("case_id", "event_id", "sec", (F.floor(F.col("value") / 10) * 10).alias("value"))


RAW = f"with recursive {b.SIG}, dev as (select case_id, event_id, sec, floor(value / 10) * 10 as value from sig where event_type = 'view'), cl as (select *, row_number() over (partition by case_id order by sec, value) as n from (select distinct case_id, sec, value from dev where value between 0 and 300 and sec is not null))"


def _reason(t: str, v: str) -> str:
    return f"case when abs(c.value - {v}) >= 1 then 'change' when c.sec - {t} >= gap and c.sec - {t} >= hold then 'timer' end"


def collapse_sql(settings: str = f"(values ({HOLD}::double, {GAP}::double))") -> str:
    return f"""{RAW}, st as (select * from {settings} s(hold, gap)), w as (select hold, gap, case_id, n, sec as t, value as v, 'initial' as reason from cl cross join st where n = 1
union all select hold, gap, w.case_id, c.n, case when {_reason('t', 'v')} is null then t else c.sec end, case when {_reason('t', 'v')} is null then v else c.value end, {_reason('t', 'v')} from w join cl c on c.case_id = w.case_id and c.n = w.n + 1),
kept as (select hold, gap, case_id, t as sec, v as value, reason from w where reason is not null)"""


def kept(spark, d):
    return devices.collapsed(raw(spark, d), HOLD, GAP, 0.0, 300.0)


@add("collapse_events", f"{collapse_sql()} select case_id, sec, value, reason from kept", "sec value")
def collapse_events(spark, d):
    return kept(spark, d)


@add("retention", f"{collapse_sql()} select (select count(*) from dev) as raw, (select count(*) from dev where value between 0 and 300) as plausible, count(*) as kept, (select count(*) from dev where value between 0 and 300) / (select count(*) from dev) as plausible_rate, count(*) / (select count(*) from dev) as kept_rate from kept", "plausible_rate kept_rate", "raw plausible kept")
def retention(spark, d):
    return devices.retention(raw(spark, d), kept(spark, d), 0.0, 300.0)


@add("collapse_grid", f"{collapse_sql('(select * from (values (43200.0::double), (86400.0), (129600.0), (172800.0)) a(h) cross join (values (86400.0::double), (129600.0), (172800.0), (259200.0)) z(g))')} select hold, gap, count(*) as kept, count(distinct case_id) as cases, count(*) filter (reason = 'timer') as timers from kept group by 1, 2", "hold gap", "kept cases timers")
def collapse_grid(spark, d):
    settings = [(h, g) for h in (43200.0, 86400.0, 129600.0, 172800.0) for g in (86400.0, 129600.0, 172800.0, 259200.0)]
    k = devices.collapsed_each(raw(spark, d), settings, 0.0, 300.0)
    return k.groupBy("hold", "gap").agg(F.count("*").alias("kept"), F.count_distinct("case_id").alias("cases"), tally(F.col("reason") == "timer").alias("timers"))


@add("record_classes", f"{collapse_sql()}, o as (select case_id, sec from sig where event_type = 'signup'), k as (select k.case_id, k.reason, k.sec, (select min(abs(o.sec - k.sec)) from o where o.case_id = k.case_id) as dist from kept k) select reason, count(*) as n, count(*) filter (dist <= 43200) as near_other from k group by 1", "", "n near_other")
def record_classes(spark, d):
    other = b.readings(spark, d).where("event_type = 'signup'").select("case_id", "sec", "value")
    k = devices.nearest(kept(spark, d), other, "other")
    return k.groupBy("reason").agg(F.count("*").alias("n"), tally(F.col("other_distance") <= 43200).alias("near_other"))


def reference(spark, d):
    return b.panel(spark, d, b.STEP, OTHERS)


REF = b.panel_sql("ref", b.STEP, "event_type <> 'view'")
PAIR = f"""with {b.SIG}, {REF}, dev as (select case_id, event_id, sec, floor(value / 10) * 10 as value from sig where event_type = 'view'),
pw as (select e.case_id, e.event_id, count(r.value) as points, median(r.value) as middle from dev e left join ref r on r.case_id = e.case_id and r.bin between floor(e.sec / {b.STEP}) - 2 and floor(e.sec / {b.STEP}) + 2 group by 1, 2),
pair as (select e.*, points, points / 5 as share, points / 5 >= 0.6 and points > 0 as paired, case when points / 5 >= 0.6 then middle end as reference from dev e join pw using (case_id, event_id))"""


def paired(spark, d, before=2, after=2, least=0.6):
    return devices.window_pairs(raw(spark, d), reference(spark, d), b.STEP, before, after, least)


@add("window_pair", f"{PAIR} select * from pair", "sec value share reference", "points")
def window_pair(spark, d):
    return paired(spark, d)


@add("pair_sensitivity", f"""with {b.SIG}, {REF}, dev as (select case_id, event_id, sec from sig where event_type = 'view'), c as (select * from (values (1), (2), (3)) c(k)),
pw as (select k, e.case_id, e.event_id, count(r.value) as points from c cross join dev e left join ref r on r.case_id = e.case_id and r.bin between floor(e.sec / {b.STEP}) - k and floor(e.sec / {b.STEP}) + k group by 1, 2, 3)
select k, case when points = 0 then 'no_points' when points / (2 * k + 1) < 0.6 then 'too_few' else 'paired' end as outcome, count(*) as n from pw group by 1, 2""", "", "k n")
def pair_sensitivity(spark, d):
    out = None
    for k in (1, 2, 3):
        p = paired(spark, d, k, k).select(F.lit(k).alias("k"), F.when(F.col("points") == 0, "no_points").when(F.col("share") < 0.6, "too_few").otherwise("paired").alias("outcome"))
        out = p if out is None else out.unionByName(p)
    return out.groupBy("k", "outcome").agg(F.count("*").alias("n"))


_NEAR = """near_{0} as (select e.case_id, e.event_id, coalesce(case when bk.sec is null then nx.value when nx.sec is null then bk.value when e.sec - bk.sec <= nx.sec - e.sec then bk.value else nx.value end, null) as value,
  case when bk.sec is null then nx.sec - e.sec when nx.sec is null then e.sec - bk.sec else least(e.sec - bk.sec, nx.sec - e.sec) end as dist
  from (select * from sig where event_type = 'click') e asof left join (select case_id, sec, value from sig where event_type = '{0}') bk on bk.case_id = e.case_id and bk.sec <= e.sec
  asof left join (select case_id, sec, value from sig where event_type = '{0}') nx on nx.case_id = e.case_id and nx.sec >= e.sec)"""
JOINT = f"with {b.SIG}, {_NEAR.format('purchase')}, {_NEAR.format('signup')}, joint as (select e.case_id, e.event_id, e.sec, e.value as click, case when p.dist <= 86400 then p.value end as purchase, case when s.dist <= 86400 then s.value end as signup, p.dist as pd, s.dist as sd from sig e join near_purchase p using (case_id, event_id) join near_signup s using (case_id, event_id) where e.event_type = 'click')"


def joint(spark, d, tolerance=86400.0):
    r = b.readings(spark, d)
    one = lambda k: r.where(F.col("event_type") == k).select("case_id", "event_id", "sec", "value")
    rows = devices.nearest(one("click").withColumnRenamed("value", "click"), one("purchase").drop("event_id"), "purchase", tolerance)
    return devices.nearest(rows, one("signup").drop("event_id"), "signup", tolerance)


@add("asof_nearest", f"""{JOINT}, c as (select * from joint where purchase is not null and signup is not null), m as (select *, lag(sec) over w as ps, abs(click - lag(click) over w) >= 1 as m1, abs(purchase - lag(purchase) over w) >= 1 as m2, abs(signup - lag(signup) over w) >= 1 as m3 from c window w as (partition by case_id order by sec))
select case_id, event_id, click, purchase, signup, signup <= click and click <= purchase as ordered, coalesce(m1, false) or coalesce(m2, false) or coalesce(m3, false) as any_change, coalesce(m1, false) as first_change, ps is null as initial, coalesce(sec - ps > 86400, false) as after_gap, (coalesce(m2, false) or coalesce(m3, false)) and not coalesce(m1, false) as others_only from m""", "click purchase signup")
def asof_nearest(spark, d):
    rows = devices.channel_changes(joint(spark, d), ["click", "purchase", "signup"], 86400.0)
    return rows.withColumn("ordered", (F.col("signup") <= F.col("click")) & (F.col("click") <= F.col("purchase"))).select("case_id", "event_id", "click", "purchase", "signup", "ordered", "any_change", "first_change", "initial", "after_gap", "others_only")


@add("nearest_distance", f"{JOINT} select case_id, event_id, pd as purchase_distance, sd as signup_distance from joint", "purchase_distance signup_distance")
def nearest_distance(spark, d):
    return joint(spark, d, None).select("case_id", "event_id", "purchase_distance", "signup_distance")


def _mechanisms(spark, d, limit=None):
    """Panel rows shown by three mechanisms: a fixed schedule, event times with the interpolated reference, event times with their own value."""
    ref = reference(spark, d)
    e = raw(spark, d)
    timed = grid.interpolated(e.select("case_id", "event_id", "sec"), ref, b.STEP)
    fixed = hold.held(ref, hold.on_schedule(4, 0))
    if limit is not None:
        fixed = hold.limited(fixed, int(limit / b.STEP))
    parts = {
        "fixed": fixed.select("case_id", "bin", "value", "shown"),
        "timing": hold.event_display(ref, timed.select("case_id", "sec", F.col("interpolated").alias("shown")), b.STEP, limit).select("case_id", "bin", "value", "shown"),
        "actual": hold.event_display(ref, e.select("case_id", "sec", F.col("value").alias("shown")), b.STEP, limit).select("case_id", "bin", "value", "shown"),
    }
    out = None
    for name, rows in parts.items():
        rows = rows.withColumn("mechanism", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return deficit.with_thresholds(out, b.THRESHOLDS)


def mech_sql(limit: str = "1e18", horizon: str = "", more: str = "") -> str:
    return f"""{more}md as (select case_id, median(value) as mid from ref group by 1), fl as (select r.case_id, bin, coalesce(value, mid) as v from ref r join md using (case_id)),
dv as (select case_id, event_id, sec, floor(value / 10) * 10 as value, least(greatest(sec / {b.STEP}, 0), 59) as pos from sig where event_type = 'view'),
iv as (select d.case_id, d.event_id, d.sec, d.value, lo.v + (hi.v - lo.v) * (pos - floor(pos)) as iv from dv d join fl lo on lo.case_id = d.case_id and lo.bin = floor(pos) join fl hi on hi.case_id = d.case_id and hi.bin = ceil(pos)),
ed as (select r.case_id, r.bin, r.value, e.sec as esec, e.value as ev, e.iv from ref r asof left join iv e on e.case_id = r.case_id and r.bin * {b.STEP} >= e.sec),
fx as (select case_id, bin, value, last_value(case when bin % 4 = 0 and value is not null then bin end ignore nulls) over w as hb, last_value(case when bin % 4 = 0 and value is not null then value end ignore nulls) over w as hv from ref window w as (partition by case_id order by bin rows between unbounded preceding and current row)),
mech as (select {horizon}'fixed' as mechanism, case_id, bin, value, case when (bin - hb) * {b.STEP} <= {limit} then hv end as shown from fx{' cross join hz' if horizon else ''} union all select {horizon}'timing', case_id, bin, value, case when bin * {b.STEP} - esec <= {limit} then iv end from ed{' cross join hz' if horizon else ''} union all select {horizon}'actual', case_id, bin, value, case when bin * {b.STEP} - esec <= {limit} then ev end from ed{' cross join hz' if horizon else ''}),
pts as (select m.*, threshold, value is not null as valid, shown is not null as up, case when value is not null then greatest(threshold - value, 0) else 0 end as r, case when value is not null and shown is not null then greatest(threshold - shown, 0) else 0 end as d from mech m cross join thr)"""


MECH = f"with {b.SIG}, {REF}, {b.CUTS}, {mech_sql()}"


@add("mechanism", f"""{MECH}, s as ({b.sums_sql('mechanism, threshold')}), q as (select mechanism, threshold, true_auc, hidden_auc, over_auc, hidden_auc / true_auc as hdr, over_auc / true_auc as odr from s)
select * from q union all select 'increment', a.threshold, a.true_auc, a.hidden_auc - t.hidden_auc, a.over_auc - t.over_auc, a.hdr - t.hdr, a.odr - t.odr from q a join q t on a.threshold = t.threshold where a.mechanism = 'actual' and t.mechanism = 'timing'""", "threshold true_auc hidden_auc over_auc hdr odr")
def mechanism(spark, d):
    q = deficit.decompose(_mechanisms(spark, d), ["mechanism", "threshold"], b.BIN_MIN).select("mechanism", "threshold", "true_auc", "hidden_auc", "over_auc", "hdr", "odr")
    pick = lambda m, c: F.max(F.when(F.col("mechanism") == m, F.col(c)))
    inc = q.groupBy("threshold").agg(F.lit("increment").alias("mechanism"), pick("actual", "true_auc").alias("true_auc"), *[(pick("actual", c) - pick("timing", c)).alias(c) for c in ("hidden_auc", "over_auc", "hdr", "odr")])
    return q.unionByName(inc)


def conf_sql(keys: str) -> str:
    return f"""cf as (select {keys}, count(*) filter (up and value < threshold and shown < threshold) as tp, count(*) filter (up and value < threshold and shown >= threshold) as fn, count(*) filter (up and value >= threshold and shown < threshold) as fp, count(*) filter (up and value >= threshold and shown >= threshold) as tn,
count(*) filter (not up and value < threshold) as unavailable_low, count(*) filter (not up and value >= threshold) as unavailable_normal from pts where valid group by all)
select *, tp / nullif(tp + fn, 0) as sensitivity, tn / nullif(tn + fp, 0) as specificity, tp / nullif(tp + fp, 0) as ppv, tn / nullif(tn + fn, 0) as npv from cf"""


_CELLS = "tp fn fp tn unavailable_low unavailable_normal"


def _confusion(rows, keys):
    up = F.col("shown").isNotNull()
    return devices.confusion(rows.where("value is not null"), keys, F.col("value") < F.col("threshold"), F.coalesce(F.col("shown") < F.col("threshold"), F.lit(False)), up)


@add("confusion_points", f"{MECH}, {conf_sql('mechanism, threshold')}", "threshold sensitivity specificity ppv npv", _CELLS)
def confusion_points(spark, d):
    return _confusion(_mechanisms(spark, d), ["mechanism", "threshold"])


_HZ = mech_sql("h", "h, ", "hz as (select * from (values (1e18::double), (172800.0), (86400.0)) z(h)), ")


@add("validity_horizon", f"with {b.SIG}, {REF}, {b.CUTS}, {_HZ}, {conf_sql('h, mechanism, threshold')}", "h threshold sensitivity specificity ppv npv", _CELLS)
def validity_horizon(spark, d):
    out = None
    for h in (1e18, 172800.0, 86400.0):
        rows = _mechanisms(spark, d, None if h > 1e17 else h).withColumn("h", F.lit(h))
        out = rows if out is None else out.unionByName(rows)
    return _confusion(out, ["h", "mechanism", "threshold"])


@add("confusion_paired", f"""{PAIR}, {b.CUTS}, p as (select case_id, threshold, reference < threshold as lo, value < threshold as dl from pair cross join thr where paired)
select threshold, count(*) as pairs, count(distinct case_id) as cases, count(*) filter (lo and dl) as tp, count(*) filter (lo and not dl) as fn, count(*) filter (not lo and dl) as fp, count(*) filter (not lo and not dl) as tn, count(distinct case_id) filter (lo and not dl) as fn_cases from p group by 1""", "threshold", "pairs cases tp fn fp tn fn_cases")
def confusion_paired(spark, d):
    p = deficit.with_thresholds(paired(spark, d).where("paired"), b.THRESHOLDS)
    lo, dl = F.col("reference") < F.col("threshold"), F.col("value") < F.col("threshold")
    return p.groupBy("threshold").agg(F.count("*").alias("pairs"), F.count_distinct("case_id").alias("cases"), tally(lo & dl).alias("tp"), tally(lo & ~dl).alias("fn"), tally(~lo & dl).alias("fp"), tally(~lo & ~dl).alias("tn"), F.count_distinct(F.when(lo & ~dl, F.col("case_id"))).alias("fn_cases"))


# ---------------------------------------------------------------- rate changes

def rates(spark, d):
    return b.readings(spark, d).where("event_type = 'error'").select("case_id", "event_id", "sec", (F.floor(F.col("value") / 10) * 10).alias("value"))


RATES = f"with recursive {b.SIG}, rt as (select case_id, event_id, sec, floor(value / 10) * 10 as value from sig where event_type = 'error'), rl as (select *, row_number() over w as n, lag(value) over w as previous, sec - lag(sec) over w as gap from rt window w as (partition by case_id order by sec, event_id))"
_CHANGE = "tr as (select case_id, event_id, sec, n, value, previous, case when previous = 0 then 'start' else 'increase' end as kind from rl where gap > 0 and gap <= 259200 and previous >= 0 and value > previous + 1e-8)"


@add("rate_transitions", f"{RATES}, {_CHANGE} select case_id, event_id, sec, value, previous, kind from tr", "sec value previous")
def rate_transitions(spark, d):
    return devices.rate_transitions(rates(spark, d), 259200.0)


SUST = f"""{RATES}, {_CHANGE}, en as (select t.case_id, t.n, min(r.n) as e from tr t join rl r on r.case_id = t.case_id and r.n >= t.n and r.sec >= t.sec + 86400 group by 1, 2),
su as (select t.case_id, t.sec, t.kind, t.previous, t.value from tr t join en on en.case_id = t.case_id and en.n = t.n where not exists (select 1 from rl r where r.case_id = t.case_id and r.n between t.n and en.e and (not r.value > t.previous + 1e-8 or (r.n > t.n and r.gap > 259200))))"""


@add("sustained_changes", f"{SUST} select * from su", "sec previous value")
def sustained_changes(spark, d):
    return devices.sustained(rates(spark, d), 259200.0, 86400.0)


def changes(spark, d):
    r = b.readings(spark, d).where("event_type in ('error', 'purchase')")
    out = None
    for k in ("error", "purchase"):
        rows = r.where(F.col("event_type") == k).select("case_id", "event_id", "sec", (F.floor(F.col("value") / 10) * 10).alias("value"))
        one = devices.rate_transitions(rows, 259200.0).select("case_id", "sec", F.lit(k).alias("track"), "kind")
        out = one if out is None else out.unionByName(one)
    return out


def stable_changes(spark, d):
    """Changes of both tracks that are kept up for a day."""
    r, out = b.readings(spark, d), None
    for k in ("error", "purchase"):
        rows = r.where(F.col("event_type") == k).select("case_id", "event_id", "sec", (F.floor(F.col("value") / 10) * 10).alias("value"))
        one = devices.sustained(rows, 259200.0, 86400.0).select("case_id", "sec", F.lit(k).alias("track"), "kind")
        out = one if out is None else out.unionByName(one)
    return out


BLOCKS = f"""with recursive {b.SIG_EXACT}, r2 as (select case_id, event_type as track, sec, floor(value / 10) * 10 as value, lag(floor(value / 10) * 10) over w as previous, sec - lag(sec) over w as gap from sig where event_type in ('error', 'purchase') window w as (partition by case_id, event_type order by sec, event_id)),
ch as (select case_id, sec, track, case when previous = 0 then 'start' else 'increase' end as kind, row_number() over (partition by case_id order by sec, track) as n from r2 where gap > 0 and gap <= 259200 and previous >= 0 and value > previous + 1e-8),
bl as (select case_id, n, sec, track, kind, sec as anchor from ch where n = 1 union all select c.case_id, c.n, c.sec, c.track, c.kind, case when c.sec > anchor + 172800 + 1e-9 then c.sec else anchor end from bl join ch c on c.case_id = bl.case_id and c.n = bl.n + 1),
block as (select case_id, anchor as sec, string_agg(distinct track, '+' order by track) as tracks, case when count(distinct kind) > 1 then 'mixed' else any_value(kind) end as kind, count(*) as changes from bl group by 1, 2)"""


def blocks(spark, d):
    return devices.anchored_blocks(changes(spark, d), 172800.0)


# a half is rounded as the decimal that it is: a product by 100 as a double may lie on either side of it
@add("anchored_blocks", f"{BLOCKS} select * replace (case when abs(sec) < 1e5 then sec else round(sec::decimal(18, 6), 2)::double end as sec) from block", "sec", "changes")
def anchored_blocks(spark, d):
    return blocks(spark, d)


T = 35.0
_STATE_STEPS = [2, 4, 6]


def block_events(spark, d):
    w = Window.partitionBy("case_id").orderBy("sec")
    return blocks(spark, d).withColumn("event_id", F.row_number().over(w))


def _block_states(spark, d):
    p = b.panel(spark, d)
    return devices.states_at(block_events(spark, d), hold.samples(p, _STATE_STEPS), _STATE_STEPS, p, b.STEP, T, 6, 3)


STATES = f"""{BLOCKS.replace('with recursive ' + b.SIG_EXACT, 'with recursive ' + b.SIG_EXACT + ', ' + b.panel_sql())}, be as (select *, row_number() over (partition by case_id order by sec) as event_id from block),
sched as (select s.step, p.phase from (values (2), (4), (6)) s(step), range(s.step) p(phase)),
display as (select case_id, bin, value, step::int as step, phase::int as phase, last_value(case when (bin - phase) % step = 0 and bin >= phase and value is not null then bin end ignore nulls) over w as held_bin, last_value(case when (bin - phase) % step = 0 and bin >= phase and value is not null then value end ignore nulls) over w as shown
  from panel cross join sched window w as (partition by case_id, step, phase order by bin rows between unbounded preceding and current row)),
pr as (select case_id, bin, value, count(value) over (partition by case_id order by bin rows between 5 preceding and current row) as support, coalesce(max(case when not coalesce(value < {T}, false) then bin end) over (partition by case_id order by bin) + 1, 0) as low_start from panel),
ba as (select e.*, p.value, support, low_start, p.bin from be e join pr p on p.case_id = e.case_id and p.bin = floor((e.sec + 1e-9) / {b.STEP}) - 1 where p.bin >= 5 and p.value is not null and support >= 3),
st as (select ba.*, step, phase, held_bin, shown, case when ba.value >= {T} then 'reference_normal' when shown is null then 'unavailable' when shown >= {T} then 'normal_display' when held_bin >= low_start then 'fresh_low' else 'inherited_low' end as category, case when ba.value < {T} then ba.bin - low_start + 1 else 0 end as low_bins from ba join display d on d.case_id = ba.case_id and d.bin = ba.bin)"""


@add("event_state", f"{STATES} select case_id, event_id, sec, step, phase, value, shown, category, low_bins from st", "sec value shown", "event_id step phase low_bins")
def event_state(spark, d):
    return _block_states(spark, d).select("case_id", "event_id", "sec", "step", "phase", "value", "shown", "category", "low_bins")


_SHARES = ", ".join(f"avg((category = '{c}')::int) as {c}" for c in devices.CATEGORIES)


@add("event_phase_shares", f"""{STATES}, sh as (select case_id, event_id, sec, step, value, max(low_bins) as low_bins, {_SHARES} from st group by 1, 2, 3, 4, 5), fi as (select * from sh where value >= {T} union all select * from sh where value < {T} and low_bins >= 1 qualify row_number() over (partition by case_id // 3, step order by case_id, sec) = 1)
select step, count(*) as events, count(*) filter (value < {T}) as low_events, {', '.join(f'avg({c}) as {c}' for c in devices.CATEGORIES)} from fi group by 1""", " ".join(devices.CATEGORIES), "step events low_events")
def event_phase_shares(spark, d):
    sh = devices.category_shares(_block_states(spark, d), ["case_id", "event_id", "sec", "step", "value"])
    w = Window.partitionBy(F.floor(F.col("case_id") / 3), "step").orderBy("case_id", "sec")
    low = sh.where(F.col("value") < T).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    rows = sh.where(F.col("value") >= T).unionByName(low)
    return rows.groupBy("step").agg(F.count("*").alias("events"), tally(F.col("value") < T).alias("low_events"), *[F.avg(c).alias(c) for c in devices.CATEGORIES])


def _recovered(spark, d):
    p = b.panel(spark, d)
    low = _block_states(spark, d).where(F.col("value") < T).select("case_id", "event_id", "sec").distinct()
    return devices.recovery(low, hold.samples(p, _STATE_STEPS), _STATE_STEPS, p, b.STEP, T, 8, 0.5, b.BINS - 1)


RECOVERY = f"""{STATES}, le as (select distinct case_id, event_id, sec, floor((sec + 1e-9) / {b.STEP})::int as first from st where value < {T} and floor((sec + 1e-9) / {b.STEP}) + 7 <= 59),
sp as (select le.*, p.bin, p.value, p.value >= {T} as ok, lag(p.value >= {T}) over (partition by le.case_id, event_id order by p.bin) as pok from le join panel p on p.case_id = le.case_id and p.bin between first and first + 7),
fo as (select case_id, event_id, sec, first, count(value) as valid, min(case when ok and pok then bin end) as recovery_bin from sp group by 1, 2, 3, 4 having count(value) >= 4),
ls as (select fo.*, d.step, d.phase, d.bin, case when (d.bin + 1) * {b.STEP} >= sec + 8 * {b.STEP} - 1e-9 then 'window_end' when d.value is null then 'missing_reference' when d.value < {T} then 'recurrent_low' when d.shown is null then 'unavailable_display' when d.shown >= {T} then 'normal_display' end as stop from fo join display d on d.case_id = fo.case_id and d.bin between recovery_bin and first + 7),
le2 as (select case_id, event_id, step, phase, recovery_bin, sec, min(case when stop is not null then bin end) as ebin, min_by(stop, bin) filter (stop is not null) as stop, max(bin) as last from ls group by 1, 2, 3, 4, 5, 6),
re as (select fo.case_id, fo.event_id, s.step::int as step, s.phase::int as phase, fo.valid, fo.recovery_bin, case when l.case_id is null then null else greatest(case when coalesce(ebin, last + 1) > l.recovery_bin then least((1 + coalesce(ebin, last + 1)) * {b.STEP}, l.sec + 8 * {b.STEP}) - (l.recovery_bin + 1) * {b.STEP} else 0 end, 0) end as persistence_sec,
  case when l.case_id is null then 'no_recovery' else coalesce(l.stop, 'window_end') end as stop_reason from fo cross join sched s left join le2 l on l.case_id = fo.case_id and l.event_id = fo.event_id and l.step = s.step and l.phase = s.phase)"""


@add("recovery", f"{RECOVERY} select * from re", "persistence_sec", "event_id step phase valid recovery_bin")
def recovery(spark, d):
    return _recovered(spark, d)


@add("distinct_recovery", f"{RECOVERY}, p as (select distinct case_id, event_id, recovery_bin from re where recovery_bin is not null) select count(*) as pairs, count(distinct (case_id, recovery_bin)) as recoveries, count(*) / count(distinct (case_id, recovery_bin)) as pairs_each from p", "pairs_each", "pairs recoveries")
def distinct_recovery(spark, d):
    p = _recovered(spark, d).where("recovery_bin is not null").select("case_id", "event_id", "recovery_bin").distinct()
    return p.agg(F.count("*").alias("pairs"), F.count_distinct("case_id", "recovery_bin").alias("recoveries"), ratio(F.count("*"), F.count_distinct("case_id", "recovery_bin")).alias("pairs_each"))


@add("recovery_partition", f"""{RECOVERY}, z as (select step, case stop_reason when 'window_end' then 'persistent_low' when 'normal_display' then 'display_cleared' when 'recurrent_low' then 'reference_recurred' else 'unknown' end as state from re)
select step, avg((state = 'persistent_low')::int) as persistent_low, avg((state = 'display_cleared')::int) as display_cleared, avg((state = 'reference_recurred')::int) as reference_recurred, avg((state = 'unknown')::int) as unknown, avg((state in ('persistent_low', 'unknown'))::int) as upper_bound from z group by 1""", "persistent_low display_cleared reference_recurred unknown upper_bound", "step")
def recovery_partition(spark, d):
    state = F.when(F.col("stop_reason") == "window_end", "persistent_low").when(F.col("stop_reason") == "normal_display", "display_cleared").when(F.col("stop_reason") == "recurrent_low", "reference_recurred").otherwise("unknown")
    z = _recovered(spark, d).withColumn("state", state)
    share = lambda *s: F.avg(F.col("state").isin(*s).cast("double"))
    return z.groupBy("step").agg(*[share(s).alias(s) for s in ("persistent_low", "display_cleared", "reference_recurred", "unknown")], share("persistent_low", "unknown").alias("upper_bound"))


@add("mask_overlap", f"""{STATES}, mk as (select *, coalesce(value < 20 or value > 150, false) as masked from panel), be2 as (select case_id, event_id, floor((sec + 1e-9) / {b.STEP})::int as first from be)
select case when m.bin < first then 'before' else 'after' end as side, count(*) as bins, count(*) filter (masked) as masked_bins, count(distinct (e.case_id, event_id)) filter (masked) as events from be2 e join mk m on m.case_id = e.case_id and m.bin between first - 6 and first + 7 group by 1""", "", "bins masked_bins events")
def mask_overlap(spark, d):
    first = F.floor((F.col("sec") + 1e-9) / b.STEP).cast("int")
    e = block_events(spark, d).select("case_id", "event_id", first.alias("first")).withColumn("bin", F.explode(F.sequence(F.col("first") - 6, F.col("first") + 7)))
    m = b.panel(spark, d).withColumn("masked", F.coalesce((F.col("value") < 20) | (F.col("value") > 150), F.lit(False)))
    rows = dealt(e).join(m, ["case_id", "bin"]).withColumn("side", F.when(F.col("bin") < F.col("first"), "before").otherwise("after"))
    return rows.groupBy("side").agg(F.count("*").alias("bins"), tally(F.col("masked")).alias("masked_bins"), F.count_distinct(F.when(F.col("masked"), F.struct("case_id", "event_id"))).alias("events"))


@add("track_diagnostics", f"""with {b.SIG}, l as (select event_type, case_id, sec, value, sec - lag(sec) over w as gap, value - lag(value) over w as step from sig window w as (partition by event_type, case_id order by sec, event_id)),
n as (select l.*, (select min(abs(o.sec - l.sec)) from sig o where o.case_id = l.case_id and o.event_type = 'view') as dist from l)
select event_type, count(*) as n, count(distinct case_id) as cases, count(*) filter (value > 50) as high, count(*) filter (step < 0) as down, median(gap) as middle_gap, count(*) filter (dist <= 21600) as near_view, (select count(*) from cases c where not exists (select 1 from sig s where s.case_id = c.case_id and s.event_type = n.event_type and s.sec < 259200)) as empty_start from n group by 1""", "middle_gap", "n cases high down near_view empty_start")
def track_diagnostics(spark, d):
    r = b.readings(spark, d)
    w = Window.partitionBy("event_type", "case_id").orderBy("sec", "event_id")
    rows = r.withColumns({"gap": F.col("sec") - F.lag("sec").over(w), "step": F.col("value") - F.lag("value").over(w)})
    rows = files.settled(devices.nearest(rows, r.where("event_type = 'view'").select("case_id", "sec", "value"), "view"))
    out = rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("case_id").alias("cases"), tally(F.col("value") > 50).alias("high"), tally(F.col("step") < 0).alias("down"), tally(F.col("view_distance") <= 21600).alias("near_view"))
    out = ranks.with_quantiles(out, rows, ["event_type"], {"middle_gap": (F.col("gap"), 0.5)})
    early = r.where("sec < 259200").groupBy("event_type").agg(F.count_distinct("case_id").alias("k"))
    every = r.agg(F.count_distinct("case_id").alias("all_cases"))
    return out.join(early, "event_type", "left").join(F.broadcast(every), F.lit(True)).withColumn("empty_start", F.col("all_cases") - F.coalesce("k", F.lit(0))).drop("k", "all_cases")  # one row


@add("strategy_audit", f"{b.BASE} select 'same' as strategy, count(distinct case_id) as cases, count(distinct case_id) as equal_cases, 'identical' as verdict from panel union all select 'later', count(distinct case_id), (select count(*) from (select case_id from h2 group by 1 having bool_and(a is not distinct from c))), 'differs' from panel".replace(b.BASE, b.BASE + ", h2 as (select case_id, last_value(case when bin % 4 = 0 and value is not null then value end ignore nulls) over w as a, last_value(case when bin % 4 = 1 and value is not null then value end ignore nulls) over w as c from panel window w as (partition by case_id order by bin rows between unbounded preceding and current row))"), "", "cases equal_cases")
def strategy_audit(spark, d):
    p = b.panel(spark, d)
    base = hold.held(p, hold.on_schedule(4, 0)).select("case_id", "bin", F.col("shown").alias("a"))
    out = None
    for name, phase in (("same", 0), ("later", 1)):
        c = hold.held(p, hold.on_schedule(4, phase)).select("case_id", "bin", F.col("shown").alias("c"))
        eq = base.join(c, ["case_id", "bin"]).groupBy("case_id").agg(F.bool_and(F.col("a").eqNullSafe(F.col("c"))).alias("eq"))
        one = eq.agg(F.lit(name).alias("strategy"), F.count("*").alias("cases"), tally(F.col("eq")).alias("equal_cases"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("verdict", F.when(F.col("cases") == F.col("equal_cases"), "identical").otherwise("differs"))

