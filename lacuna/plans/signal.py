"""Queries over the gridded signal: grids and their quality, holds, decomposition, episodes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lacuna.functions.columns import ratio, tally
from lacuna.operators import deficit, episodes, grid, hold, ranks
from lacuna.sources import files

from . import bindings as b
from .registry import Registry, table

R = Registry()
QUERIES, SQL = R.queries, R.sql
add = R.add
W = lambda *k: Window.partitionBy(*k)


# ---------------------------------------------------------------- grids

@add("range_filter", f"with {b.SIG} select event_type, count(*) as rows, count(*) filter (value between 1 and 300) as plausible, median(value) filter (value between 1 and 300) as middle from sig group by 1", "middle", "rows plausible")
def range_filter(spark, d):
    ok = F.col("value").between(b.LOW, b.HIGH)
    r = b.readings(spark, d)
    out = r.groupBy("event_type").agg(F.count("*").alias("rows"), tally(ok).alias("plausible"))
    return ranks.with_quantiles(out, r, ["event_type"], {"middle": (F.when(ok, F.col("value")), 0.5)})


@add("median_grid", f"{b.BASE} select * from panel", "value", "bin")
def median_grid(spark, d):
    return b.panel(spark, d)


@add("window_bounds", "select c_custkey as case_id, greatest(coalesce(nullif(c_acctbal, 0), 0), 0) as start_sec, c_acctbal + 3600 as end_sec from customer", "start_sec end_sec")
def window_bounds(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("case_id"), F.expr("nullif(c_acctbal, 0)").alias("anestart"), (F.col("c_acctbal") + 3600).alias("aneend"))
    return grid.window_bounds(c, "whole", {"whole": ("anestart", "aneend")}).select("case_id", "start_sec", "end_sec")


_COVERAGE_SQL = f"""with {b.SIG}, {b.panel_sql('wide', b.WIDE)}, win as (select * from (values ('month', 0, 30), ('first_half', 0, 15), ('second_half', 15, 30)) w(win, lo, hi)),
c as (select win, case_id, count(*) as bins, count(value) as valid, count(value) / count(*) as share, count(*) * 1440.0 as minutes from wide join win on bin >= lo and bin < hi group by 1, 2)
select win, count(distinct case_id) as cases, count(*) filter (share >= 0.8 and minutes >= 60) as included, median(share) as middle_share, sum(valid) as valid from c group by 1"""


@add("window_coverage", _COVERAGE_SQL, "middle_share", "cases included valid")
def window_coverage(spark, d):
    wide = b.panel(spark, d, b.WIDE)
    windows = F.array(*[F.struct(F.lit(n).alias("win"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for n, lo, hi in (("month", 0, 30), ("first_half", 0, 15), ("second_half", 15, 30))])
    rows = wide.withColumn("w", F.explode(windows)).where((F.col("bin") >= F.col("w.lo")) & (F.col("bin") < F.col("w.hi"))).withColumn("win", F.col("w.win"))
    c = files.settled(grid.coverage(rows, ("win", "case_id"), 1440.0, 0.8, 60.0))
    out = c.groupBy("win").agg(F.count_distinct("case_id").alias("cases"), tally(F.col("include")).alias("included"), F.sum("valid").alias("valid"))
    return ranks.with_quantiles(out, c, ["win"], {"middle_share": (F.col("share"), 0.5)})


@add("grid_qc", f"""{b.BASE}, v as (select case_id, bin, value, lag(value) over (partition by case_id order by bin) as before from panel where value is not null)
select p.case_id, count(*) as bins, count(p.value) as valid, count(*) filter (abs(v.value - v.before) < 0.5) as repeats, count(*) - count(p.value) as missing, count(p.value) / count(*) as share, count(p.value) / count(*) >= 0.66 as include
from panel p left join v on v.case_id = p.case_id and v.bin = p.bin group by 1""", "share", "bins valid repeats missing")
def grid_qc(spark, d):
    return grid.grid_quality(b.panel(spark, d), 0.66, 0.5)


@add("complete_bins", f"""{b.BASE}, k as (select case_id, bin, value, bin = coalesce(lag(bin) over (partition by case_id order by bin) + 1, 0) as in_order from panel where (bin + 1) * {b.STEP} <= {b.DURATION} - (case_id % 5) * 30000)
select case_id, count(*) as bins, count(value) as valid, bool_and(in_order) as in_order from k group by 1""", "", "bins valid")
def complete_bins(spark, d):
    kept = grid.complete_bins(b.panel(spark, d), b.STEP, F.lit(b.DURATION) - F.pmod("case_id", F.lit(5)) * 30000)
    return kept.groupBy("case_id").agg(F.count("*").alias("bins"), F.count("value").alias("valid"), F.bool_and("in_order").alias("in_order"))


def _track(spark, d):
    """Readings with coarse times, so that conflicts and repeats occur."""
    return b.readings(spark, d).select("case_id", (F.floor(F.col("sec") / 21600) * 21600).alias("sec"), (F.floor(F.col("value") / 50) * 50).alias("value"), F.col("event_id").alias("row_no"))


_TRACK_SQL = f"with {b.SIG}, trk as (select case_id, floor(sec / 21600) * 21600 as sec, floor(value / 50) * 50 as value, event_id as row_no from sig)"


@add("clean_track", f"""{_TRACK_SQL}, ok as (select case_id, sec, min(value) as value from trk group by 1, 2 having min(value) = max(value) and sec between 86400 and 2505600),
bk as (select case_id, count(*) filter (sec < before) as backward from (select case_id, sec, lag(sec) over (partition by case_id order by row_no) as before from trk) group by 1),
cf as (select case_id, count(*) filter (k > 1) as conflicts from (select case_id, sec, count(distinct value) as k from trk group by 1, 2) group by 1),
rp as (select case_id, count(*) - count(distinct (sec, value)) as repeats from trk group by 1)
select c.case_id, count(ok.sec) as kept, min(ok.sec - 86400) as first_sec, sum(ok.value) as value_sum, any_value(backward) as backward, any_value(conflicts) as conflicts, any_value(repeats) as repeats
from cases c left join ok using (case_id) left join bk using (case_id) left join cf using (case_id) left join rp using (case_id) group by 1""", "first_sec value_sum", "kept backward conflicts repeats")
def clean_track(spark, d):
    rows = _track(spark, d)
    kept = grid.cleaned_track(rows, 86400.0, 2505600.0).groupBy("case_id").agg(F.count("*").alias("kept"), F.min("sec").alias("first_sec"), F.sum("value").alias("value_sum"))
    return grid.track_faults(rows).join(kept, "case_id", "left").fillna(0, ["kept"])


@add("reconcile_tables", f"""{b.BASE}, p2 as (select case_id, bin, case when bin % 7 = 0 then null when bin % 11 = 0 then value + 1e-3 else value end as value from panel where bin < 59), p1 as (select * from panel where bin > 0)
select count(*) as rows, count(*) filter (b.bin is null) as only_first, count(*) filter (a.bin is null) as only_second, max(abs(a.value - b.value)) as value_largest,
count(*) filter (coalesce(abs(a.value - b.value) > 1e-8, false) or (a.value is null) <> (b.value is null)) as value_off from p1 a full join p2 b on a.case_id = b.case_id and a.bin = b.bin""", "value_largest", "rows only_first only_second value_off")
def reconcile_tables(spark, d):
    p = b.panel(spark, d)
    other = p.where("bin < 59").withColumn("value", F.expr("case when bin % 7 = 0 then null when bin % 11 = 0 then value + 1e-3 else value end"))
    return grid.reconciled(p.where("bin > 0"), other, ["case_id", "bin"], ["value"])


@add("waveform_decode", f"with {b.SIG}, n as (select case_id, value, row_number() over (partition by case_id order by sec, event_id) - 1 as idx from sig) select case_id, idx, 0.5 * case_id + idx * 0.25 as sec, value from n where 0.5 * case_id + idx * 0.25 < 0.5 * case_id + 5", "sec value", "idx")
def waveform_decode(spark, d):
    """Every case's values as a waveform of four samples a second in a file of its own, of which the first five seconds are read."""
    at = F.row_number().over(W("case_id").orderBy("sec", "event_id")) - 1
    path = files.shared_path(spark, "waves")
    files.write_waves(b.readings(spark, d).withColumn("idx", at).withColumn("at", F.col("case_id") * 0.5 + F.col("idx") * 0.25), path, "case_id", ["idx"], "at", "value")
    found = files.wave_prefix(spark, path, 5.0)
    return found.select(F.regexp_extract("file", r"case_id=(\d+)", 1).cast("long").alias("case_id"), "idx", "sec", "value")


@add("wave_bin_metrics", f"""with {b.SIG} select case_id, floor(sec / {b.WIDE})::int as bin, least(count(value) / 3, 1) as coverage, avg(value) as mean, stddev_pop(value) as sd, quantile_cont(value, 0.05) as p05, quantile_cont(value, 0.95) as p95,
quantile_cont(value, 0.95) - quantile_cont(value, 0.05) as span from sig group by 1, 2""", "coverage mean sd p05 p95 span", "bin")
def wave_bin_metrics(spark, d):
    return grid.wave_bins(b.readings(spark, d), b.WIDE, 3)


@add("wave_peaks")
def wave_peaks(spark, d):
    return grid.wave_peaks(b.readings(spark, d), 5 * b.WIDE, 2, 5.0)


@add("longest_run", f"""{b.BASE}, i as (select case_id, bin - row_number() over (partition by case_id order by bin) as g from panel where value < 35), n as (select case_id, g, count(*) as k from i group by 1, 2)
select case_id, max(k) as longest from n group by 1""", "", "longest")
def longest_run(spark, d):
    return grid.longest_runs(b.panel(spark, d), ("case_id",), F.col("value") < 35)


@add("plateau_flag", f"""{b.BASE}, w as (select case_id, count(value) over f as n, median(value) over f as m, max(value) over f - min(value) over f as r, count(*) over f as k from panel window f as (partition by case_id order by bin rows between current row and 2 following))
select case_id, coalesce(bool_or(n = 3 and m < 40 and r <= 25), false) as plateau from w group by 1""")
def plateau_flag(spark, d):
    return grid.plateaus(b.panel(spark, d), 3, 40.0, 25.0)


_KINDS = ("click", "purchase", "signup")
_SCREEN_BINS = 20
_SCREEN_RULES = {
    "low": "coalesce(click < 40, false)", "jumps": "coalesce(jump >= 30, false)", "crossed": "coalesce(purchase < signup, false)",
    "narrow": "coalesce(purchase - signup between 0 and 5, false)", "outside": "coalesce(purchase is not null and signup is not null and (click < signup - 5 or click > purchase + 5), false)",
}
_SCREEN_SQL = f"""with {b.SIG}, {', '.join(b.panel_sql(k, b.WIDE, f"event_type = '{k}'") for k in _KINDS)},
j as (select case_id, bin, a.value as click, p.value as purchase, s.value as signup from click a join purchase p using (case_id, bin) join signup s using (case_id, bin)),
f as (select *, min(case when click is not null then bin end) over (partition by case_id) as first, abs(click - lag(click) over (partition by case_id order by bin)) as jump from j),
q as (select *, {', '.join(f'{rule} as {name}' for name, rule in _SCREEN_RULES.items())} from f where bin >= first and bin < first + {_SCREEN_BINS}),
u as (select case_id, bin, unnest([{', '.join(f"('{name}', {name})" for name in _SCREEN_RULES)}]) as e from q),
g as (select case_id, e[1] as rule, bin - row_number() over (partition by case_id, e[1] order by bin) as g from u where e[2]), n as (select case_id, rule, g, count(*) as k from g group by all),
w as (select case_id, count(click) over r as n, median(click) over r as m, max(click) over r - min(click) over r as span from q window r as (partition by case_id order by bin rows between current row and 2 following)),
pl as (select case_id, coalesce(bool_or(n = 3 and m < 40 and span <= 25), false) as plateau from w group by 1),
au as (select case_id, coalesce(sum(greatest(35 - click, 0)), 0) * 1440 as auc, coalesce(sum(greatest(35 - click, 0)) filter (bin < {_SCREEN_BINS}), 0) * 1440 as start_auc, coalesce(sum(greatest(35 - click, 0)) filter (bin >= first and bin < first + {_SCREEN_BINS}), 0) * 1440 as first_auc from f group by 1),
sc as (select q.case_id, count(*) as screened, count(*) filter (click is not null and purchase is not null and signup is not null) as paired,
{', '.join(f"coalesce((select max(k) from n where n.case_id = q.case_id and rule = '{name}'), 0) as {name}" for name in _SCREEN_RULES)} from q group by 1)
select sc.*, auc, start_auc, first_auc, start_auc / nullif(auc, 0) as start_share, first_auc / nullif(auc, 0) as first_share, plateau, plateau or narrow >= 3 or crossed >= 2 or outside >= 3 as review from sc join au using (case_id) join pl using (case_id)"""


@add("numeric_screen", _SCREEN_SQL, "auc start_auc first_auc start_share first_share", "screened paired " + " ".join(_SCREEN_RULES))
def numeric_screen(spark, d):
    panel = b.channels(spark, d, b.WIDE, _KINDS)
    found = grid.numeric_screen(panel, list(_KINDS), _SCREEN_BINS, {name: F.expr(rule) for name, rule in _SCREEN_RULES.items()}, 35.0, 1440.0)
    first = F.min(F.when(F.col("click").isNotNull(), F.col("bin"))).over(W("case_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    early = panel.select("case_id", "bin", F.col("click").alias("value"), first.alias("_first")).where((F.col("bin") >= F.col("_first")) & (F.col("bin") < F.col("_first") + _SCREEN_BINS)).drop("_first")
    flags = grid.plateaus(early, 3, 40.0, 25.0)
    return found.join(flags, "case_id").withColumn("review", F.expr("plateau or narrow >= 3 or crossed >= 2 or outside >= 3"))


def policy_panels(panel):
    """The panel under each mask policy: policy, case_id, bin, raw, value, masked."""
    rows = grid.flagged_runs(grid.first_bins(panel, 6), (F.col("value") < 20) | (F.col("value") > 150))
    rules = {"original": F.lit(False), "runs2": F.col("run") >= 2, "runs1": F.col("run") >= 1, "startup6": F.col("masked")}
    each = rows.withColumn("_p", F.explode(F.array(*[F.struct(F.lit(n).alias("policy"), m.alias("masked")) for n, m in rules.items()])))
    return each.select("_p.policy", "case_id", "bin", F.col("value").alias("raw"), F.when(~F.col("_p.masked"), F.col("value")).alias("value"), "_p.masked")


_POLICY = """flag as (select *, coalesce(value < 20 or value > 150, false) as f, min(case when value is not null then bin end) over (partition by case_id) as first from panel),
brk as (select *, sum(case when f then 0 else 1 end) over (partition by case_id order by bin) as g from flag), run as (select *, count(*) filter (f) over (partition by case_id, g) as k from brk),
pol as (select policy, case_id, bin, value as raw, case policy when 'original' then false when 'runs2' then f and k >= 2 when 'runs1' then f and k >= 1 else coalesce(bin >= first and bin < first + 6, false) end as masked
  from run cross join (values ('original'), ('runs2'), ('runs1'), ('startup6')) p(policy)), masked as (select *, case when not masked then raw end as value from pol)"""


@add("mask_policies", f"{b.BASE}, {_POLICY} select policy, case_id, bin, value, masked from masked", "value", "bin")
def mask_policies(spark, d):
    return policy_panels(b.panel(spark, d)).select("policy", "case_id", "bin", "value", "masked")


@add("mask_summary", f"""{b.BASE}, {_POLICY}, c as (select policy, case_id, count(value) / count(*) as share, count(*) filter (masked and raw is not null) as masked from masked group by 1, 2)
select policy, count(*) as cases, count(*) filter (share >= 0.55 or policy in ('original', 'startup6')) as retained, sum(masked) as masked_bins, count(*) filter (masked > 0) as masked_cases, median(share) as middle_share from c group by 1""", "middle_share", "cases retained masked_bins masked_cases")
def mask_summary(spark, d):
    c = files.settled(policy_panels(b.panel(spark, d)).groupBy("policy", "case_id").agg((F.count("value") / F.count("*")).alias("share"), tally(F.col("masked") & F.col("raw").isNotNull()).alias("masked")))
    kept = (F.col("share") >= 0.55) | F.col("policy").isin("original", "startup6")
    out = c.groupBy("policy").agg(F.count("*").alias("cases"), tally(kept).alias("retained"), F.sum("masked").alias("masked_bins"), tally(F.col("masked") > 0).alias("masked_cases"))
    return ranks.with_quantiles(out, c, ["policy"], {"middle_share": (F.col("share"), 0.5)})


@add("mask_intervals", f"""{b.BASE}, {_POLICY}, g as (select *, bin - row_number() over (partition by policy, case_id order by bin) as g from masked where masked)
select policy, case_id, min(bin) * {b.STEP} as start_sec, (max(bin) + 1) * {b.STEP} as end_excl_sec, count(*) as bins, median(raw) as median, sum(greatest(35 - raw, 0) * {b.BIN_MIN}) as removed_auc from g group by policy, case_id, g""", "start_sec end_excl_sec median removed_auc", "bins")
def mask_intervals(spark, d):
    rows = policy_panels(b.panel(spark, d)).drop("value").withColumnRenamed("raw", "value")
    return grid.mask_intervals(rows, ("policy", "case_id"), b.STEP, 35.0)


@add("mask_validate", f"""{b.BASE}, {_POLICY}, p as (select * from masked where policy = 'runs2')
select 0 as lost, 0 as added, count(*) filter (raw <> value) as changed, count(*) filter (raw is null and value is not null) as imputed, count(*) filter (raw is not null and value is null) as masked from p""", "", "lost added changed imputed masked")
def mask_validate(spark, d):
    p = b.panel(spark, d)
    return grid.mask_faults(p, grid.unmasked(grid.masked(p, (F.col("value") < 20) | (F.col("value") > 150), 2)))


_WIDE_BINS = f"with {b.SIG}, wb as (select case_id, floor(sec / {b.WIDE})::int as bin, quantile_cont(value, 0.95) - quantile_cont(value, 0.05) as span, median(value) as value from sig group by 1, 2)"
_ROLL = f"""{_WIDE_BINS}, f as (select *, value < 35 and span < 60 as calm, value < 35 and span >= 60 as lively from wb), i as (select case_id, bin - row_number() over (partition by case_id order by bin) as g from f where calm),
l as (select case_id, max(k) as longest from (select case_id, g, count(*) as k from i group by 1, 2) group by 1),
r as (select f.case_id, count(*) filter (calm) * {b.WIDE} as calm_sec, count(*) filter (lively) * {b.WIDE} as lively_sec, coalesce(any_value(longest), 0) as longest,
case when count(*) filter (calm) >= 6 then 'calm_low' when count(*) filter (lively) >= 6 then 'lively_low' when count(*) filter (calm or lively) > 0 then 'some_low' else 'none' end as status from f left join l using (case_id) group by 1)"""


def _rollup(spark, d):
    w = grid.wave_bins(b.readings(spark, d), b.WIDE, 3).select("case_id", "bin", "span")
    m = b.readings(spark, d).groupBy("case_id", F.floor(F.col("sec") / b.WIDE).cast("int").alias("bin")).agg(F.median("value").alias("value"))
    low = F.col("value") < 35
    rows = w.join(m, ["case_id", "bin"]).withColumns({"calm": low & (F.col("span") < 60), "lively": low & (F.col("span") >= 60)})
    out = rows.groupBy("case_id").agg(tally(F.col("calm")).alias("c"), tally(F.col("lively")).alias("v"))
    out = out.join(grid.longest_runs(rows, ("case_id",), F.col("calm")), "case_id", "left").fillna(0, ["longest"])
    status = F.when(F.col("c") >= 6, "calm_low").when(F.col("v") >= 6, "lively_low").when(F.col("c") + F.col("v") > 0, "some_low").otherwise("none")
    return out.select("case_id", (F.col("c") * b.WIDE).alias("calm_sec"), (F.col("v") * b.WIDE).alias("lively_sec"), "longest", status.alias("status"))


@add("screen_rollup", f"{_ROLL} select status, count(*) as cases, sum(calm_sec) as calm_sec, sum(lively_sec) as lively_sec, max(longest) as longest from r group by 1", "calm_sec lively_sec", "cases longest")
def screen_rollup(spark, d):
    return _rollup(spark, d).groupBy("status").agg(F.count("*").alias("cases"), F.sum("calm_sec").alias("calm_sec"), F.sum("lively_sec").alias("lively_sec"), F.max("longest").alias("longest"))


@add("review_list", f"""{_ROLL}, k as (select case_id, row_number() over (order by longest desc, calm_sec desc, case_id) as n from r where calm_sec >= 259200 or longest >= 2),
o as (select case_id, row_number() over (partition by status order by md5('20261007|' || case_id), case_id) as n from r where not (calm_sec >= 259200 or longest >= 2))
select case_id, printf('QC%03d', n) as code, 'review' as part from k union all select case_id, printf('CT%03d', n), 'control' from o where n <= 20""")
def review_list(spark, d):
    r = files.settled(_rollup(spark, d))
    flagged = (F.col("calm_sec") >= 259200) | (F.col("longest") >= 2)
    first = ranks.numbered(r.where(flagged), [F.desc("longest"), F.desc("calm_sec"), F.col("case_id")]).select("case_id", "n", F.lit("QC").alias("p"), F.lit("review").alias("part"))
    other = r.where(~flagged).select("case_id", F.row_number().over(W("status").orderBy(F.md5(F.concat(F.lit("20261007|"), F.col("case_id").cast("string"))), "case_id")).alias("n"), F.lit("CT").alias("p"), F.lit("control").alias("part")).where("n <= 20")
    return first.unionByName(other).select("case_id", F.concat("p", F.format_string("%03d", "n")).alias("code"), "part")


@add("interp_at_events", f"""{b.BASE}, m as (select case_id, median(value) as mid from panel group by 1), fl as (select p.case_id, bin, coalesce(value, mid) as v from panel p join m using (case_id)),
e as (select case_id, event_id, least(greatest(sec / {b.STEP}, 0), 59) as pos from sig where event_type = 'view')
select e.case_id, event_id, lo.v + (hi.v - lo.v) * (pos - floor(pos)) as interpolated from e join fl lo on lo.case_id = e.case_id and lo.bin = floor(pos) join fl hi on hi.case_id = e.case_id and hi.bin = ceil(pos)""", "interpolated")
def interp_at_events(spark, d):
    e = b.readings(spark, d).where("event_type = 'view'").select("case_id", "event_id", "sec")
    return grid.interpolated(e, b.panel(spark, d), b.STEP).select("case_id", "event_id", "interpolated")


@add("supported_duration", f"with {b.SIG}, g as (select case_id, lead(sec, 1, {b.DURATION}) over (partition by case_id order by sec) - sec as gap from sig) select case_id, round(sum(least(greatest(gap, 0), 36000)), 3) as supported_sec from g group by 1", "supported_sec")
def supported_duration(spark, d):
    return grid.supported_duration(b.readings(spark, d), b.DURATION, 36000.0).withColumn("supported_sec", F.round("supported_sec", 3))


@add("common_minute", f"{b.BASE}, m as (select case_id, bin // 2 as pair, count(value) = 2 as whole, avg(value) as value from panel group by 1, 2) select case_id, pair, whole, case when whole then value end as value from m", "value", "pair")
def common_minute(spark, d):
    m = b.panel(spark, d).groupBy("case_id", F.floor(F.col("bin") / 2).alias("pair")).agg((F.count("value") == 2).alias("whole"), F.avg("value").alias("value"))
    return m.withColumn("value", F.when(F.col("whole"), F.col("value")))


# ---------------------------------------------------------------- holds

_HELD = "last_value(case when (bin - 1) % 4 = 0 and bin >= 1 and value is not null then {} end ignore nulls) over (partition by case_id order by bin rows between unbounded preceding and current row)"


@add("held_display", f"{b.BASE} select case_id, bin, value, {_HELD.format('bin')} as held_bin, {_HELD.format('value')} as shown from panel", "value shown", "bin held_bin")
def held_display(spark, d):
    return hold.held(b.panel(spark, d), hold.on_schedule(4, 1))


@add("held_limit", f"{b.BASE}, h as (select case_id, bin, value, {_HELD.format('bin')} as held_bin, {_HELD.format('value')} as shown from panel) select case_id, bin, value, case when bin - held_bin <= 5 then held_bin end as held_bin, case when bin - held_bin <= 5 then shown end as shown from h", "value shown", "bin held_bin")
def held_limit(spark, d):
    return hold.limited(hold.held(b.panel(spark, d), hold.on_schedule(4, 1)), 5)


@add("held_init", f"""{b.BASE}, h as (select case_id, bin, value, {_HELD.format('bin')} as held_bin, {_HELD.format('value')} as shown, min(case when value is not null then bin end) over (partition by case_id) as fb from panel),
k as (select h.*, f.value as fv from h left join panel f on f.case_id = h.case_id and f.bin = fb)
select case_id, bin, value, case when held_bin is null and bin >= fb then fb else held_bin end as held_bin, case when held_bin is null and bin >= fb then fv else shown end as shown from k""", "value shown", "bin held_bin")
def held_init(spark, d):
    return hold.initialised(hold.held(b.panel(spark, d), hold.on_schedule(4, 1)))


@add("event_hold", f"""{b.BASE}, e as (select case_id, sec, max(value) as shown from sig where event_type = 'view' group by 1, 2)
select p.case_id, p.bin, p.value, case when p.bin * {b.STEP} - e.sec <= 172800 then e.shown end as shown, case when p.bin * {b.STEP} - e.sec <= 172800 then e.sec end as event_sec
from panel p asof left join e on e.case_id = p.case_id and p.bin * {b.STEP} >= e.sec""", "value shown event_sec", "bin")
def event_hold(spark, d):
    e = b.readings(spark, d).where("event_type = 'view'").select("case_id", "sec", F.col("value").alias("shown"))
    return hold.event_display(b.panel(spark, d), e, b.STEP, 172800.0)


@add("phase_hold", f"{b.DISPLAY} select case_id, step, phase, count(*) as bins, count(shown) as available, sum(shown) as shown_sum, max(bin - held_bin) as oldest from display group by 1, 2, 3", "shown_sum", "step phase bins available oldest")
def phase_hold(spark, d):
    up = F.col("shown").isNotNull()
    rows = b.samples(spark, d, seen=True)
    # the first bin that a sample with a negative bin stands for is 0; the last shows the oldest value
    oldest = F.greatest("bin", F.lit(0)) + F.col("bins") - 1 - F.col("held_bin")
    return rows.groupBy("case_id", "step", "phase").agg(F.sum("bins").alias("bins"), F.sum(F.when(up, F.col("bins")).otherwise(0)).alias("available"), F.sum(F.col("shown") * F.col("bins")).alias("shown_sum"), F.max(oldest).alias("oldest"))


_FIXED = {"every4": "bin % 4 = 0", "early": "bin < 12 or (bin - 12) % 6 = 0", "continuous": "true"}


@add("strategy_fixed", b.BASE + ", s as (" + " union all ".join(f"select '{n}' as strategy, case_id, bin, value, last_value(case when ({c}) and value is not null then value end ignore nulls) over (partition by case_id order by bin rows between unbounded preceding and current row) as shown, ({c}) as sampled from panel" for n, c in _FIXED.items()) + ") select strategy, case_id, count(*) filter (sampled) as samples, count(*) filter (sampled) / 30.0 as per_day, count(shown) as available, sum(abs(shown - value)) as error from s group by 1, 2", "per_day error", "samples available")
def strategy_fixed(spark, d):
    p, out = b.panel(spark, d), None
    for name, rule in _FIXED.items():
        h = hold.held(p, F.expr(rule)).select(F.lit(name).alias("strategy"), "case_id", "value", "shown", F.expr(rule).alias("sampled"))
        out = h if out is None else out.unionByName(h)
    return out.groupBy("strategy", "case_id").agg(tally(F.col("sampled")).alias("samples"), (tally(F.col("sampled")) / 30.0).alias("per_day"), F.count("shown").alias("available"), F.sum(F.abs(F.col("shown") - F.col("value"))).alias("error"))


_SELECTIVE = f"""{b.BASE}, {b.CUTS}, sc as (select case_id, coalesce(count(*) filter (value < 35) / nullif(count(value), 0), 0) as score from panel where bin < 20 group by 1),
rk as (select *, row_number() over (order by score desc, case_id) <= ceil(count(*) over () * 0.2) as continuous from sc),
h as (select p.*, continuous, last_value(case when bin % 4 = 0 and value is not null then value end ignore nulls) over (partition by p.case_id order by bin rows between unbounded preceding and current row) as held from panel p join rk using (case_id)),
s as (select unnest(['every4', 'selective']) as strategy, h.* from h), d0 as (select strategy, case_id, bin, value, strategy = 'selective' and continuous as continuous, case when strategy = 'selective' and continuous then value else held end as shown from s),
pts as (select d0.*, threshold, value is not null as valid, shown is not null as up, case when value is not null then greatest(threshold - value, 0) else 0 end as r, case when value is not null and shown is not null then greatest(threshold - shown, 0) else 0 end as d from d0 cross join thr),
facts as ({b.sums_sql('strategy, threshold')}), n as (select strategy, count(distinct case_id) as cases, count(distinct case_id) filter (continuous) as continuous_cases, count(*) filter (continuous or bin % 4 = 0) as samples, count(*) filter (not continuous and bin % 4 = 0) / nullif(count(distinct case_id) filter (not continuous) * 30.0, 0) as per_day from d0 group by 1),
q as (select n.*, threshold, hidden_auc, over_auc, hidden_auc / nullif(true_auc, 0) as hdr from facts join n using (strategy)) select q.*, 1 - q.hidden_auc / nullif(z.hidden_auc, 0) as reduction from q join q z on z.threshold = q.threshold and z.strategy = 'every4'"""


@add("strategy_selective", _SELECTIVE, "threshold per_day hidden_auc over_auc hdr reduction", "cases continuous_cases samples")
def strategy_selective(spark, d):
    """The fifth of cases with the most low bins at the start is followed continuously, the others every fourth bin: what stays hidden, against every fourth bin for all."""
    p = files.settled(b.panel(spark, d))
    score = p.where("bin < 20").groupBy("case_id").agg(F.coalesce(ratio(tally(F.col("value") < 35), F.count("value")), F.lit(0.0)).alias("score"))
    chosen, every4 = hold.top_share(score, "case_id", "score", 0.2), hold.on_schedule(4, 0)
    plain = hold.selective(p, chosen.where("false"), every4).withColumn("strategy", F.lit("every4"))
    rows = plain.unionByName(hold.selective(p, chosen, every4).withColumn("strategy", F.lit("selective")))
    single = F.when(~F.col("continuous"), F.col("case_id"))
    n = rows.groupBy("strategy").agg(F.count_distinct("case_id").alias("cases"), F.count_distinct(F.when(F.col("continuous"), F.col("case_id"))).alias("continuous_cases"), tally(F.col("sampled")).alias("samples"), ratio(tally(F.col("sampled") & ~F.col("continuous")), F.count_distinct(single) * 30.0).alias("per_day"))
    q = deficit.decompose(deficit.with_thresholds(rows, b.THRESHOLDS), ["strategy", "threshold"], b.BIN_MIN).select("strategy", "threshold", "hidden_auc", "over_auc", "hdr").join(n, "strategy")
    base = q.where("strategy = 'every4'").select("threshold", F.col("hidden_auc").alias("_base"))
    return q.join(base, "threshold").withColumn("reduction", 1 - ratio("hidden_auc", "_base")).drop("_base")


def _adaptive_sql(rule: str) -> str:
    fell = "(prev is not null and prev - value >= 8)" if rule == "trend" else "false"
    fires = f"coalesce(value is not null and (value < 35 or {fell}), false)"
    return f"""select case_id, bin + case when bin < nu then 1 else 6 end as next, nu as until, value as prev, len + 1 as len, trig + case when f then 1 else 0 end as trig, last_sum + bin as last_sum from
(select r.case_id, p.bin, p.value, r.len, r.trig, r.last_sum, {fires} as f, case when {fires} then greatest(r.until, p.bin + 6) else r.until end as nu from {rule}_r r join panel p on p.case_id = r.case_id and p.bin = r.next)"""


@add("strategy_adaptive", f"with recursive {b.SIG}, {b.panel_sql()}, " + ", ".join(f"{r}_r(case_id, next, until, prev, len, trig, last_sum) as (select case_id, 0, -1, null::double, 0, 0, 0 from cases union all {_adaptive_sql(r)})" for r in ("threshold", "trend"))
     + " " + " union all ".join(f"select '{r}' as rule, case_id, max(len) as samples, max(trig) as triggers, max(last_sum) as bin_sum from {r}_r group by 2" for r in ("threshold", "trend")), "", "samples triggers bin_sum")
def strategy_adaptive(spark, d):
    p, out = b.panel(spark, d), None
    for rule in ("threshold", "trend"):
        s = hold.adaptive_samples(p, rule, 6, 1, 6, 35.0, 8.0).groupBy(F.lit(rule).alias("rule"), "case_id").agg(F.count("*").alias("samples"), tally(F.col("fires")).alias("triggers"), F.sum("bin").alias("bin_sum"))
        out = s if out is None else out.unionByName(s)
    return out


# ---------------------------------------------------------------- decomposition

def facts(spark, d):
    return deficit.sum_samples(b.samples(spark, d, seen=True), ["case_id", "step", "phase"], b.THRESHOLDS, b.BIN_MIN)


def means(spark, d, steps=b.STEPS, thresholds=b.THRESHOLDS):
    """Means over phases: every phase of a step counts alike, so they are sums over all samples by the step."""
    return deficit.sum_samples(b.samples(spark, d, seen=True, steps=steps), ["case_id", "step"], thresholds, b.BIN_MIN, 1 / F.col("step")).withColumn("phases", F.col("step"))


@add("decompose", f"{b.FACTS} select *, {b.RATIOS_SQL} from facts", f"threshold {b.MEASURES} {b.RATIOS}", "step phase")
def decompose(spark, d):
    return facts(spark, d)


@add("decompose_identities", f"""{b.FACTS} select count(*) as rows, count(*) filter (abs(true_auc - hidden_auc - concordant_auc) > 1e-6) as true_parts, count(*) filter (abs(display_auc - over_auc - concordant_auc) > 1e-6) as display_parts,
count(*) filter (abs(display_auc - true_auc - over_auc + hidden_auc) > 1e-6) as net_parts, count(*) filter (abs(hidden_auc - hidden_unavailable_auc - hidden_valid_auc) > 1e-6) as hidden_parts from facts""", "", "rows true_parts display_parts net_parts hidden_parts")
def decompose_identities(spark, d):
    return deficit.identity_faults(facts(spark, d))


@add("phase_mean", f"{b.MEANS} select * from means", f"threshold {b.MEASURES} {b.RATIOS}", "step phases")
def phase_mean(spark, d):
    return means(spark, d)


_POOLED = ", ".join(f"sum({m}) as {m}" for m in b.MEASURES.split())


@add("population_ratios", f"""{b.MEANS}, pooled as (select threshold, step, count(distinct case_id) as cases, {_POOLED} from means group by 1, 2)
select *, {b.RATIOS_SQL}, hidden_auc / (valid_min / 60) as hidden_per_hour, over_auc / (valid_min / 60) as over_per_hour, true_auc / (valid_min / 60) as true_per_hour from pooled""", f"threshold {b.MEASURES} {b.RATIOS} hidden_per_hour over_per_hour true_per_hour", "step cases")
def population_ratios(spark, d):
    return deficit.pooled(means(spark, d), ["threshold", "step"])


@add("offset_variability", f"""{b.FACTS}, p as (select threshold, step, phase, sum(hidden_auc) / sum(true_auc) as hdr, sum(over_auc) / sum(true_auc) as odr from facts group by 1, 2, 3)
select threshold, step, min(hdr) as hdr_min, median(hdr) as hdr_median, max(hdr) as hdr_max, stddev_samp(hdr) as hdr_sd, min(odr) as odr_min, median(odr) as odr_median, max(odr) as odr_max, stddev_samp(odr) as odr_sd from p group by 1, 2""", "threshold hdr_min hdr_median hdr_max hdr_sd odr_min odr_median odr_max odr_sd", "step")
def offset_variability(spark, d):
    p = deficit.sum_samples(b.samples(spark, d, seen=True), ["step", "phase"], b.THRESHOLDS, b.BIN_MIN)
    return p.groupBy("threshold", "step").agg(*[f(m).alias(f"{m}_{n}") for m in ("hdr", "odr") for n, f in (("min", F.min), ("median", F.median), ("max", F.max), ("sd", F.stddev_samp))])


@add("denominator_checks", f"{b.MEANS} select threshold, step, count(distinct case_id) as cases, count(*) filter (true_auc > 0) as with_auc, sum(true_auc) as auc_total, median(true_auc) as auc_median, median(valid_min) as valid_median from means group by 1, 2", "threshold auc_total auc_median valid_median", "step cases with_auc")
def denominator_checks(spark, d):
    m = files.settled(means(spark, d).select("case_id", "threshold", "step", "true_auc", "valid_min"))
    out = m.groupBy("threshold", "step").agg(F.count_distinct("case_id").alias("cases"), tally(F.col("true_auc") > 0).alias("with_auc"), F.sum("true_auc").alias("auc_total"))
    return ranks.with_quantiles(out, m, ["threshold", "step"], {"auc_median": (F.col("true_auc"), 0.5), "valid_median": (F.col("valid_min"), 0.5)})


_INIT = f"""{b.BASE}, {b.CUTS}, h as (select case_id, bin, value, s.phase::int as phase, last_value(case when (bin - s.phase) % 4 = 0 and bin >= s.phase and value is not null then value end ignore nulls) over (partition by case_id, s.phase order by bin rows between unbounded preceding and current row) as shown,
  first_value(value ignore nulls) over (partition by case_id, s.phase order by bin rows between unbounded preceding and unbounded following) as fv from panel cross join range(4) s(phase)),
pp as (select p.policy, case_id, bin, phase, case when policy = 'excluded' and shown is null then null else value end as value,
  case when policy = 'initialised' and shown is null and value is not null then fv when policy = 'initialised' and shown is null and bin >= (select min(bin) from panel z where z.case_id = h.case_id and z.value is not null) then fv else shown end as shown,
  policy = 'excluded' and shown is null and value is not null as gone from h cross join (values ('unavailable'), ('initialised'), ('excluded')) p(policy)),
pts as (select pp.*, threshold, value is not null as valid, shown is not null as up, case when value is not null then greatest(threshold - value, 0) else 0 end as r,
  case when value is not null and shown is not null then greatest(threshold - shown, 0) else 0 end as d from pp cross join thr),
facts as ({b.sums_sql('policy, threshold, case_id, phase, count(*) filter (gone) * 720.0 as excluded_min')}),
m as (select policy, threshold, case_id, avg(true_auc) as true_auc, avg(hidden_auc) as hidden_auc, avg(over_auc) as over_auc, avg(excluded_min) as excluded_min from facts group by 1, 2, 3)
select policy, threshold, sum(true_auc) as true_auc, sum(hidden_auc) as hidden_auc, sum(over_auc) as over_auc, sum(excluded_min) as excluded_min, sum(hidden_auc) / sum(true_auc) as hdr, sum(over_auc) / sum(true_auc) as odr from m group by 1, 2"""


@add("initial_policy", _INIT, "threshold true_auc hidden_auc over_auc excluded_min hdr odr")
def initial_policy(spark, d):
    """What is shown before a phase's first sample: nothing; the case's first valid value; or these bins are left out."""
    first = F.first("value", ignorenulls=True).over(W("case_id", "step").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    early = F.col("shown").isNull()
    policies = {"unavailable": ("shown", "seen"), "initialised": (F.coalesce("shown", "_first"), "seen"), "excluded": ("shown", F.when(~early, F.col("seen")).otherwise(F.array()))}
    each = F.array(*[F.struct(F.lit(n).alias("policy"), (F.col(x) if isinstance(x, str) else x).alias("shown"), (F.col(y) if isinstance(y, str) else y).alias("seen")) for n, (x, y) in policies.items()])
    rows = hold.samples(b.panel(spark, d), [4], seen=True).withColumn("_first", first).select("case_id", "step", F.when(early, F.size("seen")).otherwise(0).alias("gone"), F.explode(each).alias("p")).select("case_id", "step", "gone", "p.*")
    m = deficit.sum_samples(rows, ["policy"], b.THRESHOLDS, b.BIN_MIN, 1 / 4)
    gone = rows.groupBy("policy").agg((F.sum(F.when(F.col("policy") == "excluded", F.col("gone")).otherwise(0)) * (b.BIN_MIN / 4)).alias("excluded_min"))
    return m.join(F.broadcast(gone), "policy").select("policy", "threshold", "true_auc", "hidden_auc", "over_auc", "excluded_min", "hdr", "odr")  # a row for each policy


_SUBSETS = f"""{b.MEANS}, q as (select case_id, count(value) / count(*) as share, count(*) filter (abs(value - before) < 1) as same from (select *, lag(value) over (partition by case_id order by bin) as before from panel) group by 1),
cut as (select quantile_cont(same, 0.95) as c from q), sub as (select 'all' as subset, case_id from q union all select 'share60', case_id from q where share >= 0.6 union all select 'share65', case_id from q where share >= 0.65 union all select 'not_flat', case_id from q, cut where same <= c)"""


@add("coverage_sensitivity", f"{_SUBSETS} select subset, threshold, step, count(*) as cases, sum(hidden_auc) / sum(true_auc) as hdr, sum(over_auc) / sum(true_auc) as odr from sub join means using (case_id) group by 1, 2, 3", "threshold hdr odr", "step cases")
def coverage_sensitivity(spark, d):
    p = b.panel(spark, d).withColumn("before", F.lag("value").over(W("case_id").orderBy("bin")))
    q = files.settled(p.groupBy("case_id").agg((F.count("value") / F.count("*")).alias("share"), tally(F.abs(F.col("value") - F.col("before")) < 1).alias("same")))
    cut = ranks.quantiles(q, [], {"cut": (F.col("same"), 0.95)})
    q = q.join(F.broadcast(cut), F.lit(True))  # one row
    subsets = F.array_compact(F.array(F.lit("all"), F.when(F.col("share") >= 0.6, "share60"), F.when(F.col("share") >= 0.65, "share65"), F.when(F.col("same") <= F.col("cut"), "not_flat")))
    sub = q.select("case_id", F.explode(subsets).alias("subset"))
    return sub.join(means(spark, d), "case_id").groupBy("subset", "threshold", "step").agg(F.count("*").alias("cases"), ratio(F.sum("hidden_auc"), F.sum("true_auc")).alias("hdr"), ratio(F.sum("over_auc"), F.sum("true_auc")).alias("odr"))


@add("case_phase_quantiles", f"""{b.MEANS}, r as (select case_id, threshold, step, max(hidden_auc) - min(hidden_auc) as phase_range from facts group by 1, 2, 3), j as (select threshold, step, hdr, odr, phase_range from means join r using (case_id, threshold, step)),
u as (unpivot j on hdr, odr, phase_range into name metric value v) select threshold, step, metric, count(v) as n, quantile_cont(v, 0.05) as p05, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.5) as median, quantile_cont(v, 0.75) as q3, quantile_cont(v, 0.95) as p95 from u group by 1, 2, 3""", "threshold p05 q1 median q3 p95", "step n")
def case_phase_quantiles(spark, d):
    sums = facts(spark, d).groupBy("case_id", "threshold", "step").agg(*[F.avg(f"{m}_auc").alias(m) for m in ("hidden", "over", "true")], (F.max("hidden_auc") - F.min("hidden_auc")).alias("phase_range"))
    m = sums.select("threshold", "step", ratio("hidden", "true").alias("hdr"), ratio("over", "true").alias("odr"), "phase_range")
    u = files.settled(m.unpivot(["threshold", "step"], ["hdr", "odr", "phase_range"], "metric", "v").where("v is not null"))
    keys = ["threshold", "step", "metric"]
    shares = {"p05": 0.05, "q1": 0.25, "median": 0.5, "q3": 0.75, "p95": 0.95}
    return ranks.with_quantiles(u.groupBy(*keys).agg(F.count("v").alias("n")), u, keys, {n: (F.col("v"), q) for n, q in shares.items()})


@add("phase_schedule", f"{b.FACTS} select threshold, step, phase, 100 * sum(hidden_auc) / sum(true_auc) as hidden_pct, 100 * sum(over_auc) / sum(true_auc) as over_pct, 100 * sum(available_min) / sum(valid_min) as available_pct from facts group by 1, 2, 3", "threshold hidden_pct over_pct available_pct", "step phase")
def phase_schedule(spark, d):
    p = deficit.sum_samples(b.samples(spark, d, seen=True), ["step", "phase"], b.THRESHOLDS, b.BIN_MIN)
    return p.select("threshold", "step", "phase", *[(100 * ratio(x, y)).alias(n) for n, x, y in (("hidden_pct", "hidden_auc", "true_auc"), ("over_pct", "over_auc", "true_auc"), ("available_pct", "available_min", "valid_min"))])


@add("displayed_minutes", f"""{b.MEANS}, x as (select *, true_low_min - unavailable_low_min - normal_discordant_min + low_discordant_min as m from means)
select threshold, step, sum(m) as displayed_low_min, sum(display_low_min) as direct_min, count(*) filter (m < -1e-9 or m > valid_min + 1e-9) as out_of_bounds from x group by 1, 2""", "threshold displayed_low_min direct_min", "step out_of_bounds")
def displayed_minutes(spark, d):
    x = deficit.displayed_low_minutes(means(spark, d))
    return x.groupBy("threshold", "step").agg(F.sum("displayed_low_min").alias("displayed_low_min"), F.sum("display_low_min").alias("direct_min"), tally(~F.col("in_bounds")).alias("out_of_bounds"))


@add("pooled_twa", f"{b.MEANS} select threshold, step, sum(true_auc) / sum(valid_min) as true_twa, sum(display_auc) / sum(available_min) as display_twa from means group by 1, 2", "threshold true_twa display_twa", "step")
def pooled_twa(spark, d):
    return means(spark, d).groupBy("threshold", "step").agg(ratio(F.sum("true_auc"), F.sum("valid_min")).alias("true_twa"), ratio(F.sum("display_auc"), F.sum("available_min")).alias("display_twa"))


@add("interval_summary", f"""{b.MEANS}, s as (select threshold, step, sum(true_auc) as true_auc, sum(display_auc) as shown_auc, sum(true_low_min) as true_low_min, sum(display_low_min) as shown_low_min from means group by 1, 2)
select threshold, step, true_auc, shown_auc, true_low_min, shown_low_min from s union all select threshold, 0, avg(true_auc), avg(true_auc), avg(true_low_min), avg(true_low_min) from s group by 1""", "threshold true_auc shown_auc true_low_min shown_low_min", "step")
def interval_summary(spark, d):
    s = means(spark, d).groupBy("threshold", "step").agg(F.sum("true_auc").alias("true_auc"), F.sum("display_auc").alias("shown_auc"), F.sum("true_low_min").alias("true_low_min"), F.sum("display_low_min").alias("shown_low_min"))
    reference = s.groupBy("threshold").agg(F.lit(0).alias("step"), F.avg("true_auc").alias("true_auc"), F.avg("true_auc").alias("shown_auc"), F.avg("true_low_min").alias("true_low_min"), F.avg("true_low_min").alias("shown_low_min"))
    return s.unionByName(reference)


_STARTUP = f"""{b.BASE}, {b.CUTS}, fb as (select *, min(case when value is not null then bin end) over (partition by case_id) as first from panel),
mk as (select scenario, case_id, bin, case when scenario = 'first6' and bin < 6 then null when scenario = 'valid6' and bin >= first and bin < first + 6 then null else value end as value from fb cross join (values ('none'), ('first6'), ('valid6')) s(scenario)),
h as (select scenario, case_id, bin, value, s.phase::int as phase, last_value(case when (bin - s.phase) % 6 = 0 and bin >= s.phase and value is not null then value end ignore nulls) over (partition by scenario, case_id, s.phase order by bin rows between unbounded preceding and current row) as shown from mk cross join range(6) s(phase)),
pts as (select h.*, threshold, value is not null as valid, shown is not null as up, case when value is not null then greatest(threshold - value, 0) else 0 end as r, case when value is not null and shown is not null then greatest(threshold - shown, 0) else 0 end as d from h cross join thr),
facts as ({b.sums_sql('scenario, threshold, case_id, phase')})
select scenario, threshold, sum(true_auc) / 6 as true_auc, sum(hidden_auc) / 6 as hidden_auc, sum(over_auc) / 6 as over_auc, sum(concordant_auc) / 6 as concordant_auc, sum(valid_min) / 6 as valid_min, sum(available_min) / 6 as available_min from facts group by 1, 2"""


@add("startup_sensitivity", _STARTUP, "threshold true_auc hidden_auc over_auc concordant_auc valid_min available_min")
def startup_sensitivity(spark, d):
    p, out = b.panel(spark, d), None
    for name, rows in {"none": p, "first6": p.withColumn("value", F.when(F.col("bin") >= 6, F.col("value"))), "valid6": grid.unmasked(grid.first_bins(p, 6)).drop("masked")}.items():
        f = hold.samples(rows, [6], seen=True).withColumn("scenario", F.lit(name))
        out = f if out is None else out.unionByName(f)
    kept = ("true_auc", "hidden_auc", "over_auc", "concordant_auc", "valid_min", "available_min")
    return deficit.sum_samples(out, ["scenario"], b.THRESHOLDS, b.BIN_MIN, 1 / 6).select("scenario", "threshold", *kept)


@add("area_identity", f"{b.MEANS} select threshold, step, count(*) as rows, count(*) filter (abs((display_auc - true_auc) - (over_auc - hidden_auc)) > 1e-6) as faults, sum(over_auc - hidden_auc) as net from means group by 1, 2", "threshold net", "step rows faults")
def area_identity(spark, d):
    off = F.abs((F.col("display_auc") - F.col("true_auc")) - (F.col("over_auc") - F.col("hidden_auc"))) > 1e-6
    return means(spark, d).groupBy("threshold", "step").agg(F.count("*").alias("rows"), tally(off).alias("faults"), F.sum(F.col("over_auc") - F.col("hidden_auc")).alias("net"))


# ---------------------------------------------------------------- episodes

def with_cuts(spark, d, thresholds=b.THRESHOLDS):
    return deficit.with_thresholds(b.panel(spark, d), thresholds)


def _episodes_sql(tolerance: float, least: float, name: str = "ep") -> str:
    return f"""lo as (select case_id, threshold, bin, value, bin - lag(bin) over (partition by case_id, threshold order by bin) as gap from panel cross join thr where value < threshold),
li as (select *, sum(case when gap is null or (gap - 1) * {b.STEP} > {tolerance} then 1 else 0 end) over (partition by case_id, threshold order by bin) as episode from lo),
{name} as (select case_id, threshold, episode, min(bin) as start_bin, max(bin) as end_bin, count(*) as n_low, sum((threshold - value) * {b.BIN_MIN}) as auc, min(value) as nadir, (max(bin) - min(bin) + 1) * {b.STEP} as duration from li group by 1, 2, 3 having (max(bin) - min(bin) + 1) * {b.STEP} >= {least})"""


EP = f"{b.BASE}, {b.CUTS}, {_episodes_sql(0, 2 * b.STEP)}"


def two_bin_episodes(spark, d, thresholds=b.THRESHOLDS):
    return episodes.tolerant(with_cuts(spark, d, thresholds), b.STEP, 2 * b.STEP, 0.0)


@add("episodes", f"{b.BASE}, {b.CUTS}, {_episodes_sql(b.STEP, 2 * b.STEP)} select * from ep", "threshold auc nadir duration", "episode start_bin end_bin n_low")
def tolerant_episodes(spark, d):
    return episodes.tolerant(with_cuts(spark, d), b.STEP, 2 * b.STEP, b.STEP)


def bridged_sql(gap: str = "1", least: str = "2", source: str = "panel cross join thr", more: str = "", name: str = "ev") -> str:
    k = f"{more}case_id, threshold"
    return f"""bm as (select *, sum(case when value is null then 1 else 0 end) over (partition by {k} order by bin) as ms from (select * from {source})),
bl as (select *, bin - lag(bin) over (partition by {k} order by bin) - 1 as g, ms - lag(ms) over (partition by {k} order by bin) as mg from bm where value < threshold),
bi as (select *, sum(case when g is null or g > {gap} or mg <> 0 then 1 else 0 end) over (partition by {k} order by bin) as event from bl),
{name} as (select {k}, event, min(bin) as start_bin, max(bin) + 1 as end_excl, count(*) as n_low, sum(threshold - value) as auc, min(value) as nadir from bi group by {k}, event having count(*) >= {least})"""


EV = f"{b.DISPLAY}, {b.CUTS}, {bridged_sql()}"


def events(spark, d):
    return episodes.bridged(with_cuts(spark, d), 1, 2)


@add("bridged_events", f"{EV} select * from ev", "threshold auc nadir", "event start_bin end_excl n_low")
def bridged_events(spark, d):
    return events(spark, d)


@add("episode_detection", f"""{b.DISPLAY}, {b.CUTS}, {_episodes_sql(0, 2 * b.STEP)}, k as (select e.*, step, phase, bin, shown from ep e join display d on d.case_id = e.case_id and d.bin between start_bin and end_bin + 1),
q as (select case_id, threshold, episode, step, phase, coalesce(bool_or(shown < threshold), false) as documented, min(case when shown < threshold then bin end) - min(start_bin) as delay from k group by 1, 2, 3, 4, 5)
select threshold, step, count(*) as pairs, count(*) filter (documented) as documented, avg(delay) as mean_delay from q group by 1, 2""", "threshold mean_delay", "step pairs documented")
def episode_detection(spark, d):
    e = two_bin_episodes(spark, d).withColumn("end_bin", F.col("end_bin") + 1)  # one bin of grace
    e = e.select("case_id", "episode", "start_bin", "end_bin", "threshold", F.col("threshold").alias("t"))
    q = episodes.detected(hold.samples(hold.marked(b.panel(spark, d), e, "start_bin", F.col("end_bin"), b.STEPS), b.STEPS), None, "start_bin", "end_bin", b.STEPS, ["case_id", "threshold", "episode"])
    q = q.withColumns({"documented": F.col("first_bin").isNotNull(), "delay": F.col("first_bin") - F.col("start_bin")})
    return q.groupBy("threshold", "step").agg(F.count("*").alias("pairs"), tally(F.col("documented")).alias("documented"), F.avg("delay").alias("mean_delay"))


OBS = f"""{b.DISPLAY}, {b.CUTS}, {_episodes_sql(0, 2 * b.STEP)},
bk as (select case_id, step, phase, threshold, bin, coalesce(min(case when value is null or value < threshold or shown is null or shown >= threshold then bin end) over (partition by case_id, step, phase, threshold order by bin rows between current row and unbounded following), 60) as break_bin from display cross join thr),
f as (select e.*, step, phase, min(case when shown < e.threshold then bin end) as first_bin from ep e join display d on d.case_id = e.case_id and d.bin between start_bin and end_bin group by all),
a as (select f.case_id, f.threshold, f.episode, f.step, f.phase, coalesce(sum(case when f.first_bin is null or p.bin < f.first_bin then greatest(f.threshold - p.value, 0) * {b.BIN_MIN} end), 0) as auc_before from f join panel p on p.case_id = f.case_id and p.bin between f.start_bin and f.end_bin group by all),
o as (select f.*, auc_before, first_bin is not null as detected, (first_bin - start_bin) * {b.STEP} as delay, (end_bin + 1 - first_bin) * {b.STEP} as left_sec,
  case when first_bin is not null then coalesce(bk.break_bin - (end_bin + 1), 0) * {b.STEP} end as stale from f join a using (case_id, threshold, episode, step, phase)
  left join bk on bk.case_id = f.case_id and bk.step = f.step and bk.phase = f.phase and bk.threshold = f.threshold and bk.bin = f.end_bin + 1)"""


def pairs(spark, d, steps=b.STEPS, thresholds=b.THRESHOLDS):
    return episodes.observed(b.panel(spark, d), two_bin_episodes(spark, d, thresholds), steps, b.STEP, (b.STEP, 2 * b.STEP), thresholds)


def obs_sums_sql(keys: str) -> str:
    return f"""select {keys}, count(*) as pairs, count(*) filter (detected) as detected_pairs, coalesce(sum(delay), 0) as delay_sum, coalesce(sum(left_sec), 0) as left_sum, coalesce(sum(stale), 0) as stale_sum, count(*) filter (left_sec >= {b.STEP}) as left_1_pairs, count(*) filter (left_sec >= {2 * b.STEP}) as left_2_pairs,
sum(auc) as auc_sum, sum(auc_before) as auc_before_sum, 1 - count(*) filter (detected) / count(*) as miss_fraction, avg(delay) as mean_delay, avg(left_sec) as mean_left, avg(stale) as mean_stale, count(*) filter (left_sec >= {b.STEP}) / count(*) as p_left_1, count(*) filter (left_sec >= {2 * b.STEP}) / count(*) as p_left_2, sum(auc_before) / sum(auc) as auc_before_share from o group by all"""


_OBS_D, _OBS_L = "threshold delay_sum left_sum stale_sum auc_sum auc_before_sum miss_fraction mean_delay mean_left mean_stale p_left_1 p_left_2 auc_before_share", "step pairs detected_pairs left_1_pairs left_2_pairs"


@add("observability", f"{OBS} {obs_sums_sql('threshold, step')}", _OBS_D, _OBS_L)
def observability(spark, d):
    return episodes.observability_sums(pairs(spark, d), ["threshold", "step"])


_DUR = "case when duration < 129600 then '<3' when duration < 216000 then '3-4' else '5+' end"
_NAD = "case when nadir < 10 then '<10' when nadir < 20 then '10-20' else '20+' end"


@add("episode_strata", f"{OBS} select * from (select threshold, step, {_DUR} as duration_bin, {_NAD} as nadir_bin, count(*) as pairs, count(*) filter (detected) as detected, count(distinct (case_id, episode)) as episodes from o group by 1, 2, 3, 4)", "threshold", "step pairs detected episodes")
def episode_strata(spark, d):
    e = two_bin_episodes(spark, d).select("case_id", "threshold", "episode", episodes.strata("duration", [129600, 216000], ["<3", "3-4", "5+"]).alias("duration_bin"), episodes.strata("nadir", [10, 20], ["<10", "10-20", "20+"]).alias("nadir_bin"))
    p = pairs(spark, d).select("case_id", "threshold", "episode", "step", "detected").join(e, ["case_id", "threshold", "episode"])
    return p.groupBy("threshold", "step", "duration_bin", "nadir_bin").agg(F.count("*").alias("pairs"), tally(F.col("detected")).alias("detected"), F.count_distinct("case_id", "episode").alias("episodes"))


@add("offset_to_case", f"""{OBS}, c as (select case_id, threshold, step, phase, count(*) as n, count(*) filter (detected) as det, avg(delay) as delay from o group by 1, 2, 3, 4)
select case_id, threshold, step, count(*) as phases, min(n) as episodes, min(n) = max(n) as invariant, avg(det) as expected_detected, avg(n - det) as expected_missed, avg(delay) as mean_delay from c group by 1, 2, 3""", "threshold expected_detected expected_missed mean_delay", "step phases episodes")
def offset_to_case(spark, d):
    c = pairs(spark, d).groupBy("case_id", "threshold", "step", "phase").agg(F.count("*").alias("n"), tally(F.col("detected")).alias("det"), F.avg("delay").alias("delay"))
    return c.groupBy("case_id", "threshold", "step").agg(F.count("*").alias("phases"), F.min("n").alias("episodes"), (F.min("n") == F.max("n")).alias("invariant"), F.avg("det").alias("expected_detected"), F.avg(F.col("n") - F.col("det")).alias("expected_missed"), F.avg("delay").alias("mean_delay"))


CLASSES = f"""{EV}, cr as (select e.*, step, phase, bin, shown, held_bin from ev e join display d on d.case_id = e.case_id and d.bin >= start_bin and d.bin < end_excl),
cls as (select case_id, threshold, event, step, phase, start_bin, end_excl, n_low, case when bool_or(shown < threshold and held_bin = bin) then 'fresh' when bool_or(shown < threshold) then 'inherited' else 'never' end as class,
coalesce(bool_or(shown < threshold and bin = start_bin and held_bin < start_bin), false) as carry_in, coalesce(min_by(held_bin, bin) filter (shown < threshold) < start_bin, false) as first_inherited from cr group by case_id, threshold, event, step, phase, start_bin, end_excl, n_low)"""


def classed(spark, d):
    return episodes.classified(b.panel(spark, d), events(spark, d), b.STEPS)


@add("event_classes", f"{CLASSES} select * from cls", "threshold", "event step phase start_bin end_excl n_low")
def event_classes(spark, d):
    return classed(spark, d)


@add("event_robustness", f"""{b.BASE}, {b.CUTS}, cfg as (select * from (values (0, 2), (0, 3), (1, 2), (1, 3), (2, 2), (2, 3), (0, 5), (1, 5), (2, 5)) c(gap_bins, least_low)),
{bridged_sql('gap_bins', 'any_value(least_low)', 'panel cross join thr cross join cfg', 'gap_bins, least_low, ')}
select gap_bins, least_low, threshold, count(*) as events, count(distinct case_id) as cases, sum(n_low) as low_bins from ev group by 1, 2, 3""", "threshold", "gap_bins least_low events cases low_bins")
def event_robustness(spark, d):
    rows = with_cuts(spark, d).withColumn("gap_bins", F.explode(F.array(*[F.lit(g) for g in (0, 1, 2)])))
    e = episodes.bridged(rows, F.col("gap_bins"), 1, ("case_id", "threshold", "gap_bins"))  # the least number of low bins only chooses among the events
    e = e.withColumn("least_low", F.explode(F.array(*[F.lit(m) for m in (2, 3, 5)]))).where("n_low >= least_low")
    return e.groupBy("gap_bins", "least_low", "threshold").agg(F.count("*").alias("events"), F.count_distinct("case_id").alias("cases"), F.sum("n_low").alias("low_bins"))


@add("class_by_duration", f"""{CLASSES}, k as (select *, case when n_low < 3 then '2' when n_low < 5 then '3-4' else '5+' end as size from cls)
select threshold, step, size, class, count(*) as pairs, 100 * count(*) / sum(count(*)) over (partition by threshold, step, size) as pct from k group by 1, 2, 3, 4""", "threshold pct", "step pairs")
def class_by_duration(spark, d):
    k = classed(spark, d).withColumn("size", episodes.strata("n_low", [3, 5], ["2", "3-4", "5+"]))
    n = k.groupBy("threshold", "step", "size", "class").agg(F.count("*").alias("pairs"))
    return n.withColumn("pct", 100 * F.col("pairs") / F.sum("pairs").over(W("threshold", "step", "size")))


@add("miss_by_phase", f"""{CLASSES}, c as (select case_id, threshold, step, phase, avg(case when class = 'never' then 1.0 else 0.0 end) as miss from cls group by 1, 2, 3, 4), r as (select case_id, threshold, step, avg(miss) as miss, max(miss) - min(miss) as span from c group by 1, 2, 3)
select threshold, step, count(*) as cases, avg(miss) as mean_miss, quantile_cont(miss, 0.25) as q1, quantile_cont(miss, 0.75) as q3, median(span) as middle_span from r group by 1, 2""", "threshold mean_miss q1 q3 middle_span", "step cases")
def miss_by_phase(spark, d):
    c = classed(spark, d).groupBy("case_id", "threshold", "step", "phase").agg(F.avg((F.col("class") == "never").cast("double")).alias("miss"))
    r = files.settled(c.groupBy("case_id", "threshold", "step").agg(F.avg("miss").alias("m"), (F.max("miss") - F.min("miss")).alias("span")))
    out = r.groupBy("threshold", "step").agg(F.count("*").alias("cases"), F.avg("m").alias("mean_miss"))
    return ranks.with_quantiles(out, r, ["threshold", "step"], {"q1": (F.col("m"), 0.25), "q3": (F.col("m"), 0.75), "middle_span": (F.col("span"), 0.5)})


@add("count_integrity", f"{CLASSES}, n as (select threshold, step, class, count(*) / step as per_phase from cls group by threshold, step, class) select threshold, step, sum(per_phase) as events, abs(sum(per_phase) - round(sum(per_phase))) < 1e-7 as whole from n group by 1, 2", "threshold events", "step")
def count_integrity(spark, d):
    n = classed(spark, d).groupBy("threshold", "step", "class").agg(F.count("*").alias("n")).groupBy("threshold", "step").agg(F.sum(F.col("n") / F.col("step")).alias("events"))
    return n.withColumn("whole", F.abs(F.col("events") - F.round("events")) < 1e-7)


@add("hierarchy_qc", f"""{OBS}, s as (select threshold, step, count(*) filter (detected) / count(*) as p, count(*) filter (left_sec >= {b.STEP}) / count(*) as p1, count(*) filter (left_sec >= {2 * b.STEP}) / count(*) as p2 from o group by 1, 2)
select count(*) as rows, count(*) filter (p1 > p + 1e-12) as p1_over_p, count(*) filter (p2 > p1 + 1e-12) as p2_over_p1, count(*) filter (p > 1 or p2 < 0) as out_of_range from s""", "", "rows p1_over_p p2_over_p1 out_of_range")
def hierarchy_qc(spark, d):
    s = episodes.observability_sums(pairs(spark, d), ["threshold", "step"]).withColumn("p", 1 - F.col("miss_fraction"))
    return s.agg(F.count("*").alias("rows"), tally(F.col("p_left_1") > F.col("p") + 1e-12).alias("p1_over_p"), tally(F.col("p_left_2") > F.col("p_left_1") + 1e-12).alias("p2_over_p1"), tally((F.col("p") > 1) | (F.col("p_left_2") < 0)).alias("out_of_range"))


@add("phase_convention", f"""{b.MEANS}, s as (select threshold, step, sum(hidden_auc) / sum(true_auc) as averaged from means group by 1, 2), z as (select threshold, step, sum(hidden_auc) / sum(true_auc) as anchored from facts where phase = 0 group by 1, 2)
select threshold, step, averaged, anchored, anchored - averaged as difference from s join z using (threshold, step)""", "threshold averaged anchored difference", "step")
def phase_convention(spark, d):
    hdr = ratio(F.sum("hidden_auc"), F.sum("true_auc"))
    a = means(spark, d).groupBy("threshold", "step").agg(hdr.alias("averaged"))
    z = facts(spark, d).where("phase = 0").groupBy("threshold", "step").agg(hdr.alias("anchored"))
    return a.join(z, ["threshold", "step"]).withColumn("difference", F.col("anchored") - F.col("averaged"))
