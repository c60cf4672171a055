"""Queries over the shapes of result tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lacuna.functions.columns import tally
from lacuna.operators import episodes, hold, tables
from lacuna.sources import files

from . import bindings as b
from . import inference, signal
from .registry import Registry, table

R = Registry()
QUERIES, SQL = R.queries, R.sql
add = R.add


@add("wide_policy", f"{b.BASE}, {signal._POLICY}, n as (select policy, case_id, count(value) as n from masked group by 1, 2) select case_id, max(n) filter (policy = 'original') as original, max(n) filter (policy = 'runs2') as runs2, max(n) filter (policy = 'runs1') as runs1, max(n) filter (policy = 'startup6') as startup6 from n group by 1", "", "original runs2 runs1 startup6")
def wide_policy(spark, d):
    n = signal.policy_panels(b.panel(spark, d)).groupBy("policy", "case_id").agg(F.count("value").alias("n"))
    return tables.wide(n, ["case_id"], "policy", ["original", "runs2", "runs1", "startup6"], "n")


@add("union_missing", "select c_custkey as id, c_acctbal as balance, c_mktsegment as segment, null::integer as size from customer union all select p_partkey, null, null, p_size from part", "balance", "size")
def union_missing(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return tables.union_of(a, table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size")))


_CELLS = "case event_id % 6 when 0 then event_id::varchar when 1 then round(value, 2)::varchar when 2 then '' when 3 then 'TRUE' when 4 then event_type else ' ' || (event_id * 3) || ' ' end"


@add("typed_cells", f"with c as (select event_id, trim({_CELLS}) as t from events) select event_id, case when t = '' then 'blank' when lower(t) in ('true', 'false') then 'bool' when regexp_full_match(t, '[+-]?[0-9]+') then 'int' when regexp_full_match(t, '[+-]?([0-9]+\\.[0-9]*|\\.[0-9]+)') then 'float' else 'text' end as kind, case when lower(t) = 'true' then 1.0 when lower(t) = 'false' then 0.0 else try_cast(t as double) end as number from c", "number")
def typed_cells(spark, d):
    cell = F.expr("case event_id % 6 when 0 then cast(event_id as string) when 1 then cast(round(value, 2) as string) when 2 then '' when 3 then 'TRUE' when 4 then event_type else concat(' ', cast(event_id * 3 as string), ' ') end")
    return table(spark, d, "events").select("event_id", cell.alias("text")).withColumn("c", tables.typed_cell("text")).select("event_id", "c.kind", "c.number")


@add("format_ci", "with g as (select c_nationkey, avg(c_acctbal) as m, min(c_acctbal) as lo, case when c_nationkey % 6 = 0 then null else max(c_acctbal) end as hi, c_nationkey / 7000.0 as p from customer group by 1) select c_nationkey, case when hi is null then 'Not estimable' else printf('%.2f (%.2f to %.2f)', floor(m * 100 + 0.5) / 100, floor(lo * 100 + 0.5) / 100, floor(hi * 100 + 0.5) / 100) end as text, case when p < 0.001 then '<0.001' else printf('%.3f', floor(p * 1000 + 0.5) / 1000) end as p_text from g", "")
def format_ci(spark, d):
    g = table(spark, d, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("m"), F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi")).withColumns({"hi": F.when(F.col("c_nationkey") % 6 != 0, F.col("hi")), "p": F.col("c_nationkey") / 7000.0})
    return g.select("c_nationkey", tables.estimate_text("m", "lo", "hi").alias("text"), tables.p_text("p").alias("p_text"))


@add("json_flatten", "select event_type, 'k' as parameter, count(*) as n, sum((props->>'k')::bigint) as total, min((props->>'k')::bigint) as least, max((props->>'k')::bigint) as most from events group by 1", "", "n total least most")
def json_flatten(spark, d):
    e = table(spark, d, "events").select("event_type", F.explode(F.from_json("props", "map<string,string>")).alias("parameter", "value"))
    v = F.col("value").cast("long")
    return e.groupBy("event_type", "parameter").agg(F.count("*").alias("n"), F.sum(v).alias("total"), F.min(v).alias("least"), F.max(v).alias("most"))


@add("tidy_estimates", f"{inference.SUB}, {inference.ratio_sql('threshold step', 'subject', 'hidden_auc', 'true_auc', 'ms', 'a')}, {inference.ratio_sql('threshold step', 'subject', 'over_auc', 'true_auc', 'ms', 'z')} select 'hidden' as measure, threshold, step, estimate, low, high, low <= estimate and estimate <= high as sound from a_p join a_q using (threshold, step) union all select 'over', threshold, step, estimate, low, high, low <= estimate and estimate <= high from z_p join z_q using (threshold, step)", "threshold estimate low high", "step")
def tidy_estimates(spark, d):
    from lacuna.operators import resample

    m, out = inference._means(spark, d), None
    for name, top in (("hidden", "hidden_auc"), ("over", "over_auc")):
        one = resample.bootstrap_ratio(m, inference.GROUP, "subject", top, "true_auc", inference.REPS, inference.SEED).drop("clusters").withColumn("measure", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return tables.inside(out, "estimate", "low", "high")


_EPO = f"""{b.BASE}, {b.CUTS}, {signal._episodes_sql(0, 2 * b.STEP)}, sp as (select case_id, bin, value, s.phase::int as phase, last_value(case when (bin - s.phase) % 4 = 0 and bin >= s.phase and value is not null then value end ignore nulls) over w as shown, first_value(value ignore nulls) over (partition by case_id, s.phase order by bin rows between unbounded preceding and unbounded following) as fv,
  min(case when value is not null then bin end) over (partition by case_id, s.phase) as fb from panel cross join range(4) s(phase) window w as (partition by case_id, s.phase order by bin rows between unbounded preceding and current row)),
pd as (select 'unavailable' as policy, case_id, bin, phase, shown from sp union all select 'initialised', case_id, bin, phase, case when shown is null and bin >= fb then fv else shown end from sp),
q as (select policy, e.case_id, e.threshold, e.episode, phase, coalesce(bool_or(shown < e.threshold), false) as det from ep e join pd d on d.case_id = e.case_id and d.bin between start_bin and end_bin group by 1, 2, 3, 4, 5)
select policy, threshold, count(*) as pairs, count(*) filter (det) as detected from q group by 1, 2"""


@add("episode_policy", _EPO, "threshold", "pairs detected")
def episode_policy(spark, d):
    p = b.panel(spark, d)
    first = F.first("value", ignorenulls=True).over(Window.partitionBy("case_id", "step").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    each = F.array(*[F.struct(F.lit(n).alias("policy"), c.alias("shown")) for n, c in (("unavailable", F.col("shown")), ("initialised", F.coalesce("shown", "_first")))])
    rows = hold.samples(p, [4]).withColumn("_first", first).select("case_id", "step", "phase", "bin", F.explode(each).alias("_p")).select("case_id", "step", "phase", "bin", "_p.*")
    spans = signal.two_bin_episodes(spark, d).select("case_id", "episode", "start_bin", "end_bin", "threshold", F.col("threshold").alias("t"))
    q = episodes.detected(rows, spans, "start_bin", "end_bin", [4], ["policy", "case_id", "threshold", "episode"]).withColumn("det", F.col("first_bin").isNotNull())
    return q.groupBy("policy", "threshold").agg(F.count("*").alias("pairs"), tally(F.col("det")).alias("detected"))


@add("json_sink", f"{b.BASE} select case_id, count(*) as bins, count(value) as valid, sum(value) as total from panel group by 1", "total", "bins valid")
def json_sink(spark, d):
    """The panel written as JSON lines with null for missing values, and read back."""
    path = files.shared_path(spark, "panel")
    files.write_json(b.panel(spark, d), path, "case_id", "bin")
    p = spark.read.schema("case_id long, bin int, value double").json(path)
    return p.groupBy("case_id").agg(F.count("*").alias("bins"), F.count("value").alias("valid"), F.sum("value").alias("total"))
