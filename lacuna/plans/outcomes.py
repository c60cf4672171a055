"""Queries over outcomes, exposure features and regressions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lacuna.functions.columns import ratio, tally
from lacuna.operators import models, outcomes, ranks
from lacuna.operators.outcomes import DAY
from lacuna.sources import files

from . import bindings as b
from . import signal
from .registry import Registry, table

R = Registry()
QUERIES, SQL = R.queries, R.sql
add = R.add


def labs(spark, d):
    return b.readings(spark, d).where("event_type in ('click', 'signup') and value between 1 and 300").select("case_id", "sec", "value")


def anchors(spark, d):
    """Day 10 of every case; discharge 5 to 10 days later, unknown for every seventh case; the case's user is its subject three by three."""
    c = b.readings(spark, d).select("case_id").distinct()
    return c.select("case_id", F.lit(10 * DAY).alias("anchor"), F.when(F.pmod("case_id", F.lit(7)) != 0, (15 + F.pmod("case_id", F.lit(6))) * DAY).alias("discharge"))


LABS = f"with {b.SIG}, labs as (select case_id, sec, value from sig where event_type in ('click', 'signup') and value between 1 and 300), anc as (select case_id, 864000.0 as anchor, case when case_id % 7 <> 0 then (15 + case_id % 6) * 86400.0 end as discharge from cases), base as (select a.case_id, max_by(l.value, (l.sec, l.value)) as value from anc a left join labs l on l.case_id = a.case_id and l.sec <= anchor and l.sec >= anchor - 604800 group by 1)"


def baseline(spark, d):
    a = anchors(spark, d)
    return outcomes.latest_before(labs(spark, d), a.select("case_id", "anchor"), 7 * DAY)


@add("latest_before", f"{LABS} select * from base", "value")
def latest_before(spark, d):
    return baseline(spark, d)


OUT = f"""{LABS}, ps as (select l.*, anchor, b.value as baseline from labs l join anc using (case_id) join base b on b.case_id = l.case_id where l.sec > anchor and l.sec <= anchor + 604800 and (discharge is null or l.sec <= discharge)),
fo as (select case_id, max(value) filter (sec <= anchor + 172800) as max_2d, max(value) as max_7d, count(*) filter (sec <= anchor + 172800) as n_2d, count(*) as n_7d, min((sec - anchor) / 3600) filter ((sec <= anchor + 172800 and value - baseline >= 5) or value / baseline >= 1.5) as first_hour from ps group by 1),
o1 as (select a.case_id, b.value as baseline, max_2d, max_7d, coalesce(n_2d, 0) as n_2d, coalesce(n_7d, 0) as n_7d, first_hour, max_2d - b.value as delta, max_7d / nullif(b.value, 0) as times, coalesce(b.value > 0, false) and max_7d is not null as evaluable from anc a left join base b using (case_id) left join fo using (case_id)),
outc as (select *, case when evaluable then coalesce(delta >= 5, false) or coalesce(times >= 1.5, false) end as event, case when evaluable then case when times >= 3 or (max_7d >= 200 and coalesce(delta >= 5, false)) then 3 when times >= 2 then 2 when coalesce(delta >= 5, false) or coalesce(times >= 1.5, false) then 1 else 0 end end as stage from o1)"""


def outcome(spark, d):
    cases = anchors(spark, d).join(baseline(spark, d).withColumnRenamed("value", "baseline"), "case_id", "left")
    return outcomes.windowed(labs(spark, d), cases, 5.0, 1.5, 200.0).drop("anchor", "discharge")


@add("windowed_outcome", f"{OUT} select * from outc", "baseline max_2d max_7d first_hour delta times", "n_2d n_7d stage")
def windowed_outcome(spark, d):
    return outcome(spark, d)


@add("stay_outcome", f"{LABS} select case_id, (discharge - anchor) / 86400 as stay_days, discharge - anchor >= 691200 as long_stay from anc", "stay_days")
def stay_outcome(spark, d):
    return anchors(spark, d).select("case_id", ((F.col("discharge") - F.col("anchor")) / DAY).alias("stay_days"), (F.col("discharge") - F.col("anchor") >= 8 * DAY).alias("long_stay"))


@add("feasibility_gate", f"{OUT}, g as (select 'cases' as gate, count(*) as n, 100 as least from outc union all select 'evaluable', count(*) filter (evaluable), 50 from outc union all select 'events', count(*) filter (event), 20 from outc) select gate, n, least, n >= least as passes from g", "", "n least")
def feasibility_gate(spark, d):
    o = outcome(spark, d).agg(F.count("*").alias("cases"), tally(F.col("evaluable")).alias("evaluable"), tally(F.col("event")).alias("events"))
    rows = o.select(F.explode(F.array(*[F.struct(F.lit(g).alias("gate"), F.col(g).alias("n"), F.lit(k).alias("least")) for g, k in (("cases", 100), ("evaluable", 50), ("events", 20))])).alias("r")).select("r.*")
    return rows.withColumn("passes", F.col("n") >= F.col("least"))


FEAT = f"{signal.OBS}, fm as (select case_id, true_auc, hidden_auc, valid_min from (select case_id, avg(true_auc) as true_auc, avg(hidden_auc) as hidden_auc, avg(valid_min) as valid_min from ({b.sums_sql('case_id, phase', '(select d.*, 35.0 as threshold, value is not null as valid, shown is not null as up, case when value is not null then greatest(35 - value, 0) else 0 end as r, case when value is not null and shown is not null then greatest(35 - shown, 0) else 0 end as d from display d where step = 4)')}) group by 1)), fe as (select case_id, count(*) as pairs, count(*) filter (detected) as det from o where threshold = 35 and step = 4 group by 1), feat as (select case_id, true_auc, true_auc / nullif(valid_min, 0) as twa, hidden_auc / nullif(true_auc, 0) as hdr, coalesce(pairs, 0) / 4 as episodes, det / nullif(pairs, 0) as p_detected from fm left join fe using (case_id))"


def features(spark, d):
    one = ([4], [35.0])  # what is asked for only, not every step and threshold
    m = signal.means(spark, d, *one).select("case_id", "true_auc", ratio("true_auc", "valid_min").alias("twa"), "hdr")
    e = signal.pairs(spark, d, *one).groupBy("case_id").agg(F.count("*").alias("pairs"), tally(F.col("detected")).alias("det"))
    out = m.join(e, "case_id", "left")
    return out.select("case_id", "true_auc", "twa", "hdr", (F.coalesce("pairs", F.lit(0)) / 4).alias("episodes"), ratio("det", "pairs").alias("p_detected"))


@add("exposure_features", f"{FEAT} select * from feat", "true_auc twa hdr episodes p_detected")
def exposure_features(spark, d):
    return features(spark, d)


def frame(spark, d):
    """Analysis rows: features of days 0 to 30, the outcome, and its cluster."""
    f = features(spark, d).join(outcome(spark, d).select("case_id", "baseline", "event"), "case_id")
    return f.select("case_id", F.floor(F.col("case_id") / 3).alias("subject"), F.log1p("twa").alias("log_twa"), (F.col("baseline") / 10).alias("baseline_10"), F.col("hdr"), (F.col("episodes") > 4).cast("int").alias("many"), F.col("event").cast("int").alias("event"))


_FRAME = f"{FEAT}, {OUT.removeprefix('with ' + b.SIG + ', ')}, frame as (select case_id, case_id // 3 as subject, ln(1 + twa) as log_twa, baseline / 10 as baseline_10, hdr, (episodes > 4)::int as many, event::int as event from feat join outc using (case_id))"


@add("model_frame", f"{_FRAME} select * from frame", "log_twa baseline_10 hdr", "subject many event")
def model_frame(spark, d):
    return frame(spark, d)


@add("presence_2x2", f"""{_FRAME}, t as (select count(*) filter (many = 1 and event = 1) as a, count(*) filter (many = 1 and event = 0) as b, count(*) filter (many = 0 and event = 1) as c, count(*) filter (many = 0 and event = 0) as d from frame where event is not null),
x as (select *, unnest(range(greatest(0, a + c - (c + d)), least(a + b, a + c) + 1)) as k from t), p as (select *, lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) as m, lgamma(k + 1) + lgamma(a + b - k + 1) + lgamma(a + c - k + 1) + lgamma(d - a + k + 1) as q, lgamma(a + 1) + lgamma(b + 1) + lgamma(c + 1) + lgamma(d + 1) as q0 from x)
select a, b, c, d, least(sum(case when m - q <= m - q0 + 1e-7 then exp(m - q) else 0 end), 1) as fisher_p, least(a, b, c, d) > 0 as estimable, case when least(a, b, c, d) > 0 then a * d / (b * c) end as odds_ratio from p group by a, b, c, d""", "fisher_p odds_ratio", "a b c d")
def presence_2x2(spark, d):
    return outcomes.two_by_two(frame(spark, d).where("event is not null"), F.col("many") == 1, F.col("event") == 1)


_SPLINE = f"{_FRAME}, k as (select min(baseline_10) as lo, median(baseline_10) as mid, max(baseline_10) as hi from frame), sp as (select case_id, baseline_10 as x, lo, mid, hi from frame, k where baseline_10 is not null)"


@add("bspline_basis", f"""{_SPLINE} select case_id, case when x < mid then (x - lo) / (mid - lo) * (mid - x) / (mid - lo) + (hi - x) / (hi - lo) * (x - lo) / (mid - lo) else (hi - x) / (hi - lo) * (hi - x) / (hi - mid) end as s1,
case when x < mid then (x - lo) / (hi - lo) * (x - lo) / (mid - lo) else (x - lo) / (hi - lo) * (hi - x) / (hi - mid) + (hi - x) / (hi - mid) * (x - mid) / (hi - mid) end as s2, case when x < mid then 0 else ((x - mid) / (hi - mid)) ** 2 end as s3 from sp""", "s1 s2 s3")
def bspline_basis(spark, d):
    f = files.settled(frame(spark, d).select("case_id", "baseline_10"))
    knots = ranks.with_quantiles(f.agg(F.min("baseline_10").alias("lo"), F.max("baseline_10").alias("hi")), f, [], {"mid": (F.col("baseline_10"), 0.5)})
    return outcomes.spline_basis(f.where("baseline_10 is not null"), "baseline_10", knots).select("case_id", "s1", "s2", "s3")


def poisson_sql(source: str, outcome: str, one: str, two: str, cluster: str, steps: int = 12) -> str:
    """CTEs of a Poisson model with log link and two terms: Newton steps one after the other with the inverse of the 3 x 3 information matrix, and the cluster sandwich; ``fit`` has a row for each term."""
    sums = "sum(mu) as a, sum(mu * x) as b, sum(mu * z) as c, sum(mu * x * x) as d, sum(mu * x * z) as e, sum(mu * z * z) as f, sum(y - mu) as g0, sum(x * (y - mu)) as g1, sum(z * (y - mu)) as g2"
    inverse = "(d * f - e * e) / det as i00, (c * e - b * f) / det as i01, (b * e - c * d) / det as i02, (a * f - c * c) / det as i11, (b * c - a * e) / det as i12, (a * d - b * b) / det as i22"
    det = "a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) as det"
    parts = [f"pr as (select {outcome}::double as y, {one} as x, {two} as z, {cluster} as k from {source} where {outcome} is not null and {one} is not null and {two} is not null and {cluster} is not null)", "n0 as (select ln(avg(y)) as b0, 0.0::double as b1, 0.0::double as b2 from pr)"]
    for k in range(steps + 1):
        parts.append(f"m{k} as (select *, {inverse} from (select *, {det} from (select any_value(b0) as b0, any_value(b1) as b1, any_value(b2) as b2, {sums} from (select pr.*, n{k}.*, exp(b0 + b1 * x + b2 * z) as mu from pr, n{k}))))")
        parts.append(f"n{k + 1} as (select b0 + i00 * g0 + i01 * g1 + i02 * g2 as b0, b1 + i01 * g0 + i11 * g1 + i12 * g2 as b1, b2 + i02 * g0 + i12 * g1 + i22 * g2 as b2 from m{k})")
    last = f"m{steps}"
    parts += [
        f"sc as (select k, sum(y - mu) as u0, sum(x * (y - mu)) as u1, sum(z * (y - mu)) as u2 from (select pr.*, exp(b0 + b1 * x + b2 * z) as mu from pr, {last}) group by 1)",
        "me as (select sum(u0 * u0) as m00, sum(u0 * u1) as m01, sum(u0 * u2) as m02, sum(u1 * u1) as m11, sum(u1 * u2) as m12, sum(u2 * u2) as m22, count(*) as g from sc)",
        f"ll as (select count(*) as n, sum(y) as events, sum(y * (b0 + b1 * x + b2 * z) - exp(b0 + b1 * x + b2 * z)) as ll from pr, {last})",
    ]
    rows = " union all ".join(f"select {i} as i, b{i} as estimate, {', '.join(f'i{min(i, j)}{max(i, j)} as v{j}' for j in range(3))} from {last}" for i in range(3))
    var = " + ".join(f"v{i} * v{j} * m{min(i, j)}{max(i, j)}" for i in range(3) for j in range(3))
    parts += [f"te as ({rows})", f"fit as (select ['intercept', '{one}', '{two}'][i + 1] as term, estimate, sqrt(({var}) * g / (g - 1) * (n - 1) / (n - 3)) as se, n, events, g, ll from te, me, ll)"]
    return ", ".join(parts)


#: The error function by its series, for DuckDB; from 4 on it is 1 in all digits kept.
_ERF = "(case when {0} >= 4 then 1 else 2 / sqrt(pi()) * list_sum(list_transform(range(120), lambda t: (-1) ** t * ({0}) ** (2 * t + 1) / (gamma(t + 1) * (2 * t + 1)))) end)"


@add("poisson_cluster", f"""{_FRAME}, {poisson_sql('frame', 'event', 'log_twa', 'baseline_10', 'subject')} select 'model' as label, term, estimate, se, exp(estimate) as ratio, exp(estimate - {models.Z95} * se) as low, exp(estimate + {models.Z95} * se) as high,
1 - {_ERF.format('abs(estimate / se) / sqrt(2)')} as p, n, events, g as clusters, 3 as parameters, ll as log_likelihood, 6 - 2 * ll as aic, true as converged from fit""", "estimate se ratio low high p events log_likelihood aic", "n clusters parameters")
def poisson_cluster(spark, d):
    return models.poisson_cluster(files.settled(frame(spark, d).select("event", "log_twa", "baseline_10", "subject")), "event", ["log_twa", "baseline_10"], "subject")


def analysis_rows(spark, d):
    """A row per case and threshold for the models: exposures, covariates, outcomes by definition, and what populations are chosen by.

    Exposures are per 10 units: hidden area per valid hour, hidden share, share of an episode's area before its first low display.
    Outcomes: event (7 days), event_2d (48 h), event_late (with a baseline of the last two days before the anchor).
    """
    m = signal.means(spark, d, [4])
    m = m.select("case_id", "threshold", "true_auc", (ratio("hidden_auc", F.col("valid_min") / 60) / 10).alias("hidden_10"), (10 * F.col("hdr")).alias("hdr_10"), F.log1p(ratio("true_auc", F.col("valid_min") / 60)).alias("burden"))
    e = signal.pairs(spark, d, [4]).groupBy("case_id", "threshold").agg((10 * ratio(F.sum("auc_before"), F.sum("auc"))).alias("before_10"), (F.count("*") / 4 > 4).cast("int").alias("many"))
    o = outcome(spark, d)
    acute = F.coalesce(F.col("max_2d") - F.col("baseline") >= 5, F.lit(False)) | F.coalesce(ratio("max_2d", "baseline") >= 1.5, F.lit(False))
    late = anchors(spark, d).join(outcomes.latest_before(labs(spark, d), anchors(spark, d).select("case_id", "anchor"), 2 * DAY).withColumnRenamed("value", "baseline"), "case_id", "left")
    late = outcomes.windowed(labs(spark, d), late, 5.0, 1.5, 200.0).select("case_id", F.col("event").cast("int").alias("event_late"))
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("case_id"), (F.col("c_acctbal") / 1000).alias("balance"), F.when(F.col("c_nationkey") != 24, F.col("c_mktsegment")).alias("code"))
    first = F.row_number().over(Window.partitionBy(F.floor(F.col("case_id") / 3)).orderBy("case_id")) == 1
    o = o.select("case_id", F.floor(F.col("case_id") / 3).alias("subject"), F.col("event").cast("int").alias("event"), F.when(F.col("baseline") > 0, F.when(F.col("n_2d") > 0, acute)).cast("int").alias("event_2d"), (F.col("baseline") / 10).alias("baseline_10"), "n_7d", first.alias("is_first"))
    return m.join(e, ["case_id", "threshold"], "left").join(o, "case_id").join(late, "case_id", "left").join(people, "case_id", "left")


def model_specs(codes: list[str]) -> list[models.Spec]:
    """Three steps of adjustment, nine incremental models and three that keep cases with a recorded code only."""
    clinical = ("baseline_10", "balance", *codes)
    burden = (*clinical, "s1", "s2", "s3")
    low, main = "threshold = 35 and true_auc > 0", "threshold = 35"
    one = lambda label, rows=low, exposure="hdr_10", terms=burden, outcome="event": models.Spec(label, outcome, (exposure, *terms), rows)
    return [
        one("hidden, unadjusted", main, "hidden_10", ()), one("hidden, clinical", main, "hidden_10", clinical), one("hidden, clinical and burden", main, "hidden_10", burden),
        one("share"), one("share, threshold 20", "threshold = 20 and true_auc > 0"), one("share, threshold 60", "threshold = 60 and true_auc > 0"), one("area before display", f"{low} and before_10 is not null", "before_10"),
        one("share, 48 h", outcome="event_2d"), one("share, late baseline", outcome="event_late"), one("share, two measurements", f"{low} and n_7d >= 2"), one("share, baseline below 15", f"{low} and baseline_10 < 15"), one("share, one case each", f"{low} and is_first"),
        one("hidden, clinical, recorded code", f"{main} and code is not null", "hidden_10", clinical), one("hidden, clinical and burden, recorded code", f"{main} and code is not null", "hidden_10", burden), one("share, recorded code", f"{low} and code is not null"),
    ]


def models_of(spark, d):
    """All specifications fitted on one table of rows; the burden's spline has its knots at the threshold's smallest, median and largest value."""
    rows = files.settled(analysis_rows(spark, d))
    knots = ranks.with_quantiles(rows.groupBy("threshold").agg(F.min("burden").alias("lo"), F.max("burden").alias("hi")), rows, ["threshold"], {"mid": (F.col("burden"), 0.5)})
    rows, codes = models.dummies(outcomes.spline_basis(rows, "burden", knots, "threshold"), "code")
    return models.sequence_of_models(files.settled(rows), model_specs(codes), "subject")


@add("model_sequence")
def model_sequence(spark, d):
    return models_of(spark, d)


@add("model_stability")
def model_stability(spark, d):
    """The exposure's row of every model with what makes it unstable."""
    rows = models_of(spark, d).where("term in ('hidden_10', 'hdr_10', 'before_10')")
    gate = rows.select("label", "converged", F.col("ratio").alias("estimate"), "low", "high", "events", "parameters")
    return outcomes.stability(gate).select("label", "failed", "stable")


@add("stability_gate", """with g as (select c_nationkey as id, c_nationkey % 4 <> 1 as converged, avg(c_acctbal) / 4000 as estimate, min(c_acctbal) / 4000 + 0.26 as low, max(c_acctbal) / 4000 as high, count(*)::double as events, 8 as parameters from customer group by 1)
select id, concat_ws(',', case when not converged then 'converged' end, case when estimate is null or low is null or high is null then 'finite' end, case when not low > 0 then 'positive' end, case when not events / parameters >= 5 then 'events' end, case when not high / low <= 10 then 'width' end) as failed,
concat_ws(',', case when not converged then 'converged' end, case when not low > 0 then 'positive' end, case when not events / parameters >= 5 then 'events' end, case when not high / low <= 10 then 'width' end) = '' as stable from g""", "", "id")
def stability_gate(spark, d):
    g = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.avg("c_acctbal").alias("m"), F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"), F.count("*").alias("n"))
    rows = g.select("id", (F.col("id") % 4 != 1).alias("converged"), (F.col("m") / 4000).alias("estimate"), (F.col("lo") / 4000 + 0.26).alias("low"), (F.col("hi") / 4000).alias("high"), F.col("n").cast("double").alias("events"), F.lit(8).alias("parameters"))
    return outcomes.stability(rows).select("id", "failed", "stable")


@add("oof_risk")
def oof_risk(spark, d):
    code = table(spark, d, "customer").select(F.col("c_custkey").alias("case_id"), F.when(F.col("c_nationkey") != 24, F.col("c_mktsegment")).alias("code"))
    rows = frame(spark, d).join(code, "case_id", "left")
    return models.out_of_fold(files.settled(rows), "case_id", "event", ["log_twa", "baseline_10", "hdr"], ("code",))


@add("transport_weights")
def transport_weights(spark, d):
    f = files.settled(frame(spark, d))
    even = F.pmod("case_id", F.lit(2)) == 0
    return models.transport_weights(f.where(even), f.where(~even), "case_id", ["log_twa", "baseline_10", "hdr"])


_POL = f"{b.BASE}, {signal._POLICY}, pf as (select policy, case_id, sum(greatest(35 - value, 0)) * 720 as auc, count(value) * 720 as valid from masked group by 1, 2), pm as (select policy, sum(auc) / sum(valid) as twa, count(*) filter (auc > 0) as cases from pf group by 1)"


@add("policy_compare", f"{_POL} select p.policy, p.twa, p.cases, p.twa - o.twa as change, abs(p.twa - o.twa) <= 1e-12 as same from pm p, pm o where o.policy = 'original'", "twa change", "cases")
def policy_compare(spark, d):
    p = signal.policy_panels(b.panel(spark, d))
    f = p.groupBy("policy", "case_id").agg((F.sum(F.greatest(35 - F.col("value"), F.when(F.col("value").isNotNull(), 0.0))) * 720).alias("auc"), (F.count("value") * 720).alias("valid"))
    m = f.groupBy("policy").agg(ratio(F.sum("auc"), F.sum("valid")).alias("twa"), tally(F.col("auc") > 0).alias("cases"))
    base = m.where("policy = 'original'").select(F.col("twa").alias("t0"))
    return m.join(F.broadcast(base), F.lit(True)).select("policy", "twa", "cases", (F.col("twa") - F.col("t0")).alias("change"), (F.abs(F.col("twa") - F.col("t0")) <= 1e-12).alias("same"))  # one row
