"""Queries over resampling, agreement and summaries of groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from lacuna.functions.columns import ratio, tally
from lacuna.operators import deficit, hold, ranks, resample
from lacuna.sources import files

from . import bindings as b
from . import devices, signal
from .registry import Registry, table

R = Registry()
QUERIES, SQL = R.queries, R.sql
add = R.add
REPS, SEED = 1000, 20260706
GROUP = ["threshold", "step"]


def _means(spark, d):
    return signal.means(spark, d).withColumn("subject", F.floor(F.col("case_id") / 3))


SUB = f"{b.MEANS}, ms as (select *, case_id // 3 as subject from means)"


def boot_sql(groups: str, cluster: str, sums: str, columns: str, source: str, name: str = "rp", seed: int = SEED) -> str:
    """CTEs: name_c clusters of each group, name_w Poisson weights of each cluster and replicate, name the weighted sums by group and replicate."""
    g = ", ".join(groups.split())
    weight = " + ".join(f"(h >= {t})::int" for t in resample.POISSON)
    return f"""{name}_c as (select {g}, {cluster}, {sums} from {source} where {cluster} is not null group by {g}, {cluster}),
{name}_h as (select {cluster}, block * 4 + j as rep, ('0x' || substr(md5('{seed}|' || {cluster}::varchar || '|' || block), 1 + 8 * j::int, 8))::bigint as h from (select distinct {cluster} from {name}_c), range({-(-REPS // 4)}) b(block), range(4) q(j)),
{name}_w as (select {cluster}, rep, {weight} as weight from {name}_h where rep < {REPS}),
{name} as (select {g}, rep, {', '.join(f'sum({c} * weight) as {c}' for c in columns.split())}, sum(weight) as drawn from {name}_c join {name}_w using ({cluster}) where weight > 0 group by all)"""


def ratio_sql(groups: str, cluster: str, top: str, bottom: str, source: str, name: str = "rp") -> str:
    g = ", ".join(groups.split())
    return f"{boot_sql(groups, cluster, f'sum({top}) as top, sum({bottom}) as bottom', 'top bottom', source, name)}, {name}_q as (select {g}, quantile_cont(top / nullif(bottom, 0), 0.025) as low, quantile_cont(top / nullif(bottom, 0), 0.975) as high from {name} group by {g}), {name}_p as (select {g}, count(*) as clusters, sum(top) / nullif(sum(bottom), 0) as estimate from {name}_c group by {g})"


@add("bootstrap_ratio", f"{SUB}, {ratio_sql('threshold step', 'subject', 'hidden_auc', 'true_auc', 'ms')} select * from rp_p join rp_q using (threshold, step)", "threshold estimate low high", "step clusters")
def bootstrap_ratio(spark, d):
    return resample.bootstrap_ratio(_means(spark, d), GROUP, "subject", "hidden_auc", "true_auc", REPS, SEED)


def mean_sql(groups: str, cluster: str, value: str, source: str, name: str = "rp") -> str:
    g = ", ".join(groups.split())
    return f"{boot_sql(groups, cluster, f'avg({value}) as m, sum({value}) as s, count(*) as k', 'm', source, name)}, {name}_q as (select {g}, quantile_cont(m / drawn, 0.025) as low, quantile_cont(m / drawn, 0.975) as high from {name} group by {g}), {name}_p as (select {g}, sum(k) as rows, count(*) as clusters, sum(s) / sum(k) as estimate, avg(m) as equal from {name}_c group by {g})"


BIAS = f"{devices.PAIR}, bs as (select case_id, event_id, value - reference as bias, reference, (value + reference) / 2 as average, 'all' as part, case_id // 3 as subject from pair where paired)"


def bias(spark, d):
    p = devices.paired(spark, d).where("paired")
    return p.select("case_id", "event_id", (F.col("value") - F.col("reference")).alias("bias"), "reference", ((F.col("value") + F.col("reference")) / 2).alias("average"), F.lit("all").alias("part"), F.floor(F.col("case_id") / 3).alias("subject"))


@add("bootstrap_mean", f"{BIAS}, {mean_sql('part', 'case_id', 'bias', 'bs')} select * from rp_p join rp_q using (part)", "estimate equal low high", "rows clusters")
def bootstrap_mean(spark, d):
    return resample.bootstrap_mean(bias(spark, d), ["part"], "case_id", "bias", REPS, SEED)


@add("cluster_mean", f"{BIAS}, bb as (select *, case when reference < 35 then 'low' else 'normal' end as side from bs), {mean_sql('side', 'subject', 'bias', 'bb')} select * from rp_p join rp_q using (side)", "estimate equal low high", "rows clusters")
def cluster_mean(spark, d):
    rows = bias(spark, d).withColumn("side", F.when(F.col("reference") < 35, "low").otherwise("normal"))
    return resample.bootstrap_mean(rows, ["side"], "subject", "bias", REPS, SEED)


@add("bootstrap_multi", f"""{SUB}, {boot_sql('threshold step', 'subject', 'sum(hidden_auc) as h, sum(over_auc) as o, sum(true_auc) as t', 'h o t', 'ms')}
select threshold, step, quantile_cont(h / nullif(t, 0), 0.025) as hdr_low, quantile_cont(h / nullif(t, 0), 0.975) as hdr_high, quantile_cont((o - h) / nullif(t, 0), 0.025) as net_low, quantile_cont((o - h) / nullif(t, 0), 0.975) as net_high from rp group by 1, 2""", "threshold hdr_low hdr_high net_low net_high", "step")
def bootstrap_multi(spark, d):
    c = resample.clusters_of(_means(spark, d), GROUP, "subject", [F.sum("hidden_auc").alias("h"), F.sum("over_auc").alias("o"), F.sum("true_auc").alias("t")])
    return resample.interval(resample.replicates(c, GROUP, "subject", REPS, SEED, ["h", "o", "t"]), GROUP, {"hdr": ratio("h", "t"), "net": ratio(F.col("o") - F.col("h"), F.col("t"))})


@add("cluster_choice", f"{SUB}, {ratio_sql('threshold step', 'subject', 'hidden_auc', 'true_auc', 'ms', 'a')}, {ratio_sql('threshold step', 'case_id', 'hidden_auc', 'true_auc', 'ms', 'z')} select threshold, step, a_p.estimate as by_subject, z_p.estimate as by_case, abs(a_p.estimate - z_p.estimate) < 1e-9 as same_point, a_q.high - a_q.low as subject_width, z_q.high - z_q.low as case_width from a_p join a_q using (threshold, step) join z_p using (threshold, step) join z_q using (threshold, step)", "threshold by_subject by_case subject_width case_width", "step")
def cluster_choice(spark, d):
    m = _means(spark, d)
    a = resample.bootstrap_ratio(m, GROUP, "subject", "hidden_auc", "true_auc", REPS, SEED).select(*GROUP, F.col("estimate").alias("by_subject"), (F.col("high") - F.col("low")).alias("subject_width"))
    z = resample.bootstrap_ratio(m, GROUP, "case_id", "hidden_auc", "true_auc", REPS, SEED).select(*GROUP, F.col("estimate").alias("by_case"), (F.col("high") - F.col("low")).alias("case_width"))
    return a.join(z, GROUP).withColumn("same_point", F.abs(F.col("by_subject") - F.col("by_case")) < 1e-9)


_PARTS = {"hdr": "h / nullif(t, 0)", "odr": "o / nullif(t, 0)", "net": "(d - t) / nullif(t, 0)", "hdr_valid": "v / nullif(t - u, 0)", "odr_valid": "o / nullif(t - u, 0)", "unavailable_part": "u / nullif(t, 0)", "mismatch_part": "v / nullif(t, 0)"}
_SUMS = {"t": "true_auc", "h": "hidden_auc", "o": "over_auc", "d": "display_auc", "u": "hidden_unavailable_auc", "v": "hidden_valid_auc"}


def _ends(parts: dict) -> str:
    return ", ".join(f"quantile_cont({e}, {q}) as {n}_{side}" for n, e in parts.items() for side, q in (("low", 0.025), ("high", 0.975)))


@add("mechanism_bootstrap", f"{devices.MECH}, cs as ({b.sums_sql('case_id, mechanism, threshold')}), {boot_sql('mechanism threshold', 'case_id', ', '.join(f'sum({x}) as {k}' for k, x in _SUMS.items()), ' '.join(_SUMS), 'cs')}, n as (select mechanism, threshold, count(*) as cases from rp_c group by all) select n.*, q.* exclude (mechanism, threshold) from n join (select mechanism, threshold, {_ends(_PARTS)} from rp group by all) q using (mechanism, threshold)", "threshold " + " ".join(f"{n}_{s}" for n in _PARTS for s in ("low", "high")), "cases")
def mechanism_bootstrap(spark, d):
    """Intervals of each mechanism's ratios; a display that is unavailable has no deficit, so what it hides is the true area of its time."""
    keys = ["mechanism", "threshold"]
    c = resample.clusters_of(deficit.decompose(devices._mechanisms(spark, d), ["case_id", *keys], b.BIN_MIN), keys, "case_id", [F.sum(x).alias(k) for k, x in _SUMS.items()])
    ends = resample.interval(resample.replicates(c, keys, "case_id", REPS, SEED, list(_SUMS)), keys, {n: F.expr(e) for n, e in _PARTS.items()})
    return c.groupBy(*keys).agg(F.count("*").alias("cases")).join(ends, keys)


_CELLS = {"sensitivity": "tp / nullif(tp + fn, 0)", "specificity": "tn / nullif(tn + fp, 0)", "ppv": "tp / nullif(tp + fp, 0)", "npv": "tn / nullif(tn + fn, 0)"}


@add("confusion_bootstrap", f"{devices.PAIR}, {b.CUTS}, p as (select threshold, case_id // 3 as subject, reference < threshold as lo, value < threshold as dl from pair cross join thr where paired), {boot_sql('threshold', 'subject', 'count(*) filter (lo and dl) as tp, count(*) filter (lo and not dl) as fn, count(*) filter (not lo and dl) as fp, count(*) filter (not lo and not dl) as tn', 'tp fn fp tn', 'p')} select threshold, {_ends(_CELLS)} from rp group by 1", "threshold " + " ".join(f"{n}_{s}" for n in _CELLS for s in ("low", "high")))
def confusion_bootstrap(spark, d):
    p = deficit.with_thresholds(devices.paired(spark, d).where("paired"), b.THRESHOLDS).withColumn("subject", F.floor(F.col("case_id") / 3))
    lo, dl = F.col("reference") < F.col("threshold"), F.col("value") < F.col("threshold")
    c = resample.clusters_of(p, ["threshold"], "subject", [tally(lo & dl).alias("tp"), tally(lo & ~dl).alias("fn"), tally(~lo & dl).alias("fp"), tally(~lo & ~dl).alias("tn")])
    return resample.interval(resample.replicates(c, ["threshold"], "subject", REPS, SEED, ["tp", "fn", "fp", "tn"]), ["threshold"], {n: F.expr(e) for n, e in _CELLS.items()})


_BA = "count(bias) as n, avg(bias) as mean, stddev_samp(bias) as sd, median(abs(bias)) as median_abs, avg(bias) - 1.96 * stddev_samp(bias) as loa_low, avg(bias) + 1.96 * stddev_samp(bias) as loa_high"


@add("bland_altman", f"{BIAS} select part, {_BA} from bs group by 1", "mean sd median_abs loa_low loa_high", "n")
def bland_altman(spark, d):
    return resample.agreement(bias(spark, d), ["part"])


@add("bland_altman_strata", f"{BIAS}, s as (select 'right_closed' as convention, case when average <= 20 then '<=20' when average <= 35 then '20-35' when average <= 60 then '35-60' else '>60' end as stratum, bias from bs union all select 'left_closed', case when average < 20 then '<=20' when average < 35 then '20-35' when average < 60 then '35-60' else '>60' end, bias from bs) select convention, stratum, {_BA} from s group by 1, 2", "mean sd median_abs loa_low loa_high", "n")
def bland_altman_strata(spark, d):
    rows, out = bias(spark, d), None
    for name, op in (("right_closed", lambda x, e: x <= e), ("left_closed", lambda x, e: x < e)):
        s = F.when(op(F.col("average"), 20), "<=20").when(op(F.col("average"), 35), "20-35").when(op(F.col("average"), 60), "35-60").otherwise(">60")
        one = rows.select(F.lit(name).alias("convention"), s.alias("stratum"), "bias")
        out = one if out is None else out.unionByName(one)
    return resample.agreement(out, ["convention", "stratum"])


_MOM = "mo as (select case_id, count(bias) as n, sum(bias) as s, avg(bias) as m, var_pop(bias) * count(bias) as ss from bs group by 1)"


@add("random_intercept", f"""{BIAS}, {_MOM}, t as (select sum(n) as total, count(*) as k, sum(s) / sum(n) as grand, sum(ss) as ssw, sum(n * n) as nn from mo), u as (select total, k, ssw / (total - k) as within, (select sum(n * (m - grand) ** 2) from mo, t) / (k - 1) as msb, (total - nn / total) / (k - 1) as n0 from t),
v as (select *, greatest((msb - within) / n0, 0) as between_ from u), w as (select k, total, between_, within, sum(m / (between_ + within / n)) / sum(1 / (between_ + within / n)) as mean from mo, v group by 1, 2, 3, 4)
select k as clusters, total as rows, mean, between_ as "between", within, mean - 1.96 * sqrt(between_ + within) as loa_low, mean + 1.96 * sqrt(between_ + within) as loa_high from w""".replace('"between"', "between_var"), "mean between_var within loa_low loa_high", "clusters rows")
def random_intercept(spark, d):
    return resample.random_intercept(resample.cluster_moments(bias(spark, d), "case_id", "bias")).withColumnRenamed("between", "between_var")


@add("random_intercept_interval", f"""{BIAS}, {_MOM}, {boot_sql('part', 'case_id', 'max(n) as n, max(s) as s, max(m) as m, max(ss) as ss, max(n * n) as nn, max(n * m * m) as nmm', 'n s ss nn nmm', "(select *, 'all' as part from mo)")},
v as (select rep, ss / (n - drawn) as within, greatest(((nmm - s * s / n) / (drawn - 1) - ss / (n - drawn)) / ((n - nn / n) / (drawn - 1)), 0) as between_ from rp where drawn > 1 and n > drawn),
e as (select rep, between_, within, sum(weight * m / (between_ + within / n)) / sum(weight / (between_ + within / n)) as mean from v join rp_w using (rep) join rp_c using (case_id) where weight > 0 group by all)
select {_ends({'mean': 'mean', 'loa_low': 'mean - 1.96 * sqrt(between_ + within)', 'loa_high': 'mean + 1.96 * sqrt(between_ + within)'})} from e""", "mean_low mean_high loa_low_low loa_low_high loa_high_low loa_high_high")
def random_intercept_interval(spark, d):
    return resample.random_intercept_interval(resample.cluster_moments(bias(spark, d), "case_id", "bias"), "case_id", REPS, SEED)


_GRID = [0.0, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0]


@add("reml_profile", f"""{BIAS}, {_MOM}, g as (select unnest({_GRID}) as ratio), r as (select ratio, mo.*, n / (1 + n * ratio) as w from mo, g), mu as (select ratio, sum(w * m) / sum(w) as mu from r group by 1),
q as (select ratio, sum(n) as total, sum(ss + w * (m - mu) ** 2) as rss, sum(ln(1 + n * ratio)) as logs, ln(sum(w)) as logw from r join mu using (ratio) group by 1) select ratio, -0.5 * ((total - 1) * ln(rss / (total - 1)) + logs + logw) as loglik from q""", "ratio loglik")
def reml_profile(spark, d):
    return resample.reml_profile(resample.cluster_moments(bias(spark, d), "case_id", "bias"), _GRID)


@add("one_per_case", f"""{BIAS}, h as (select rep, bs.*, ('0x' || substr(md5('{SEED}|' || rep || '|' || event_id), 1, 8))::bigint as h from bs, range(20) r(rep)), k as (select * from h qualify row_number() over (partition by rep, case_id order by h, event_id) = 1)
select rep, {_BA} from k group by 1""", "mean sd median_abs loa_low loa_high", "rep n")
def one_per_case(spark, d):
    return resample.agreement(resample.one_per_cluster(bias(spark, d), "case_id", "event_id", 20, SEED), ["rep"])


_V = ["c_acctbal", "c_nationkey", "named"]


def _people(spark, d):
    return table(spark, d, "customer").withColumn("named", (F.col("c_mktsegment") == "BUILDING").cast("int")).withColumn("w", 1.0 + F.pmod("c_custkey", F.lit(3)))


@add("smd", "with p as (select *, (c_mktsegment = 'BUILDING')::int as named, c_custkey % 2 = 0 as g from customer) " + " union all ".join(
    f"select '{v}' as variable, avg({v}) filter (g) as mean_1, avg({v}) filter (not g) as mean_0, (avg({v}) filter (g) - avg({v}) filter (not g)) / sqrt((var_samp({v}) filter (g) + var_samp({v}) filter (not g)) / 2) as smd, abs((avg({v}) filter (g) - avg({v}) filter (not g)) / sqrt((var_samp({v}) filter (g) + var_samp({v}) filter (not g)) / 2)) > 0.2 as large from p" for v in _V), "mean_1 mean_0 smd")
def smd(spark, d):
    return resample.standardised_differences(_people(spark, d), F.pmod("c_custkey", F.lit(2)) == 0, _V)


def _weighted(v: str) -> str:
    m = lambda g: f"(sum(w * {v}) filter ({g}) / sum(w) filter ({g}))"
    var = lambda g: f"(sum(w * {v} * {v}) filter ({g}) / sum(w) filter ({g}) - {m(g)} ** 2)"
    s = f"({m('g')} - {m('not g')}) / sqrt(({var('g')} + {var('not g')}) / 2)"
    return f"select '{v}' as variable, {m('g')} as mean_1, {m('not g')} as mean_0, {s} as smd, abs({s}) > 0.2 as large from p"


@add("smd_weighted", "with p as (select *, (c_mktsegment = 'BUILDING')::int as named, c_custkey % 2 = 0 as g, 1.0 + c_custkey % 3 as w from customer) " + " union all ".join(map(_weighted, _V)), "mean_1 mean_0 smd")
def smd_weighted(spark, d):
    return resample.standardised_differences(_people(spark, d), F.pmod("c_custkey", F.lit(2)) == 0, _V, "w")


@add("characteristics", "select c_mktsegment, count(*) as n, median(c_acctbal) as middle, quantile_cont(c_acctbal, 0.25) as q1, quantile_cont(c_acctbal, 0.75) as q3, count(*) filter (c_nationkey < 5) as near_n, 100 * count(*) filter (c_nationkey < 5) / count(c_nationkey) as near_pct from customer group by 1", "middle q1 q3 near_pct", "n near_n")
def characteristics(spark, d):
    c = table(spark, d, "customer")
    out = c.groupBy("c_mktsegment").agg(F.count("*").alias("n"), tally(F.col("c_nationkey") < 5).alias("near_n"), (100 * ratio(tally(F.col("c_nationkey") < 5), F.count("c_nationkey"))).alias("near_pct"))
    return ranks.with_quantiles(out, c, ["c_mktsegment"], {n: (F.col("c_acctbal"), q) for n, q in (("middle", 0.5), ("q1", 0.25), ("q3", 0.75))})


@add("code_validity", "with k as (select case when c_nationkey = 24 then null else c_nationkey end as code from customer) select count(*) filter (code between 1 and 20) as valid, count(*) filter (code not between 1 and 20) as outside, (select string_agg(code::varchar, ',' order by code) from (select distinct code from k where code not between 1 and 20)) as outside_codes, count(*) filter (code is null) as missing from k", "", "valid outside missing")
def code_validity(spark, d):
    k = table(spark, d, "customer").select(F.when(F.col("c_nationkey") != 24, F.col("c_nationkey")).alias("code"))
    ok = F.col("code").between(1, 20)
    return k.agg(tally(ok).alias("valid"), tally(~ok).alias("outside"), F.array_join(F.transform(F.sort_array(F.collect_set(F.when(~ok, F.col("code")))), lambda x: x.cast("string")), ",").alias("outside_codes"), tally(F.col("code").isNull()).alias("missing"))


@add("quartile_table", "with e as (select quantile_cont(c_acctbal, 0.25) as a, quantile_cont(c_acctbal, 0.5) as m, quantile_cont(c_acctbal, 0.75) as z from customer), k as (select 1 + (c_acctbal > a)::int + (c_acctbal > m)::int + (c_acctbal > z)::int as bin, c_acctbal, c_nationkey from customer, e) select bin, count(*) as n, min(c_acctbal) as low, max(c_acctbal) as high, avg(c_nationkey) as mean_nation from k group by 1", "low high mean_nation", "bin n")
def quartile_table(spark, d):
    return resample.quantile_bins(table(spark, d, "customer"), "c_acctbal", 4, [F.count("*").alias("n"), F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"), F.avg("c_nationkey").alias("mean_nation")])


@add("pareto", "select p_brand, p_partkey, not exists (select 1 from part q where q.p_brand = p.p_brand and q.p_retailprice <= p.p_retailprice and q.p_size >= p.p_size and (q.p_retailprice < p.p_retailprice or q.p_size > p.p_size)) as optimal from part p")
def pareto(spark, d):
    return resample.pareto(table(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice", "p_size"), ["p_brand"], "p_retailprice", "p_size").select("p_brand", "p_partkey", "optimal")


@add("capture_curve", "with r as (select *, row_number() over (order by c_acctbal desc, c_custkey) as r, count(*) over () as n, count(*) filter (c_nationkey % 4 = 1) over () as k from customer), s as (select unnest([0.05, 0.1, 0.2, 0.3, 0.5]) as share) select share::double as share, count(*) as taken, count(*) filter (c_nationkey % 4 = 1) as captured, count(*) filter (c_nationkey % 4 = 1) / max(k) as capture_rate, count(*) / nullif(count(*) filter (c_nationkey % 4 = 1), 0) as needed from r, s where r <= ceil(n * share) group by 1", "share capture_rate needed", "taken captured")
def capture_curve(spark, d):
    return resample.capture(table(spark, d, "customer"), "c_acctbal", F.col("c_nationkey") % 4 == 1, "c_custkey", [0.05, 0.1, 0.2, 0.3, 0.5])


_STRAT = {"every4": "bin % 4 = 0", "every2": "bin % 2 = 0", "every12": "bin % 12 = 0", "continuous": "true"}
_PTS = "case when value is not null then greatest(35 - value, 0) else 0 end as r, case when value is not null and shown is not null then greatest(35 - shown, 0) else 0 end as d"


@add("strategy_summary", b.BASE + ", s as (" + " union all ".join(f"select '{n}' as strategy, value, ({c}) as sampled, last_value(case when ({c}) and value is not null then value end ignore nulls) over (partition by case_id order by bin rows between unbounded preceding and current row) as shown from panel" for n, c in _STRAT.items()) + f"), p as (select *, {_PTS} from s), q as (select strategy, count(*) filter (sampled) as samples, sum(greatest(r - d, 0)) as hidden, sum(greatest(d - r, 0)) as over_shown from p group by 1) select q.strategy, q.samples, q.hidden, q.over_shown, 1 - q.hidden / z.hidden as reduction, (q.samples - z.samples) / (select count(*) * 30.0 from cases) as extra_per_day from q, q z where z.strategy = 'every4'", "hidden over_shown reduction extra_per_day", "samples")
def strategy_summary(spark, d):
    p, out = b.panel(spark, d), None
    for name, rule in _STRAT.items():
        h = hold.held(p, F.expr(rule)).select(F.lit(name).alias("strategy"), "value", "shown", F.expr(rule).alias("sampled"))
        out = h if out is None else out.unionByName(h)
    valid = F.col("value").isNotNull()
    out = out.withColumns({"r": F.when(valid, F.greatest(35 - F.col("value"), F.lit(0.0))).otherwise(0.0), "d": F.when(valid & F.col("shown").isNotNull(), F.greatest(35 - F.col("shown"), F.lit(0.0))).otherwise(0.0)})
    q = out.groupBy("strategy").agg(tally(F.col("sampled")).alias("samples"), F.sum(F.greatest(F.col("r") - F.col("d"), F.lit(0.0))).alias("hidden"), F.sum(F.greatest(F.col("d") - F.col("r"), F.lit(0.0))).alias("over_shown"))
    base = q.where("strategy = 'every4'").select(F.col("samples").alias("s0"), F.col("hidden").alias("h0"))
    cases = p.agg(F.count_distinct("case_id").alias("c"))
    rows = q.join(F.broadcast(base), F.lit(True)).join(F.broadcast(cases), F.lit(True))  # one row each
    return rows.select("strategy", "samples", "hidden", "over_shown", (1 - F.col("hidden") / F.col("h0")).alias("reduction"), ((F.col("samples") - F.col("s0")) / (F.col("c") * 30.0)).alias("extra_per_day"))


@add("pairs_per_case", f"{BIAS}, n as (select case_id, count(*) as n from bs group by 1) select count(*) as cases, avg(n) as mean, stddev_samp(n) as sd, min(n) as least, quantile_cont(n, 0.25) as q1, median(n) as middle, quantile_cont(n, 0.75) as q3, max(n) as most from n", "mean sd q1 middle q3", "cases least most")
def pairs_per_case(spark, d):
    n = files.settled(bias(spark, d).groupBy("case_id").agg(F.count("*").alias("n")))
    out = n.agg(F.count("*").alias("cases"), F.avg("n").alias("mean"), F.stddev_samp("n").alias("sd"), F.min("n").alias("least"), F.max("n").alias("most"))
    return ranks.with_quantiles(out, n, [], {x: (F.col("n"), q) for x, q in (("q1", 0.25), ("middle", 0.5), ("q3", 0.75))})


@add("ecdf", f"{BIAS} select event_id, bias, cume_dist() over (order by bias) as share, 1 - cume_dist() over (order by bias) as remaining from bs", "bias share remaining")
def ecdf(spark, d):
    rows = files.settled(bias(spark, d).select("event_id", "bias"))
    counts = rows.groupBy("bias").agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("all"))
    upto = ranks.running(counts, [F.col("bias")], F.col("n"), "before").join(F.broadcast(total), F.lit(True))  # one row
    share = (F.col("before") + F.col("n")) / F.col("all")
    return rows.join(upto, "bias").select("event_id", "bias", share.alias("share"), (1 - share).alias("remaining"))
