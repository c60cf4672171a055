"""Queries over cohorts, joins, guards and text rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from lacuna.functions.columns import tally
from lacuna.operators import cohort, text_audit
from lacuna.sources import files

from . import bindings as b
from .registry import Registry, table

R = Registry()
QUERIES, SQL = R.queries, R.sql
add = R.add

_HIER = [("toy", ["ring", "bolt"]), ("tool", ["widget"])]
_BANNED = ["ring", "widget", "red"]


@add("text_category", "select p_partkey, case when lower(concat_ws(' ', p_name, p_type)) like '%ring%' then 'toy' when lower(concat_ws(' ', p_name, p_type)) like '%widget%' then 'tool' when lower(concat_ws(' ', p_name, p_type)) like '%red%' then 'other' else '' end as category from part")
def text_category(spark, d):
    return table(spark, d, "part").select("p_partkey", cohort.text_category(["p_name", "p_type"], _HIER, _BANNED).alias("category"))


def _customers(spark, d):
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    return table(spark, d, "customer").join(n, "c_custkey", "left")


_CUST = "cust as (select c.*, o.orders from customer c left join (select o_custkey, count(*) as orders from orders group by 1) o on o.o_custkey = c.c_custkey)"
_STEPS = [("positive_balance", "c_acctbal > 0"), ("segment", "lower(c_mktsegment) like '%b%' or c_mktsegment like 'M%'"), ("orders", "orders >= 8"), ("region", "c_nationkey % 5 <> 2")]


@add("cohort_flow", f"with {_CUST}, f as (select coalesce({', '.join(f'case when not coalesce({c}, false) then {i} end' for i, (_, c) in enumerate(_STEPS, 1))}, {len(_STEPS) + 1}) as f from cust), s as (select * from (values (0, 'start'), {', '.join(f'({i}, {n!r})' for i, (n, _) in enumerate(_STEPS, 1))}) s(step, name)) select step, name, count(*) filter (f > step) as remaining, count(*) filter (f = step) as excluded from f cross join s group by 1, 2", "", "step remaining excluded")
def cohort_flow(spark, d):
    return cohort.flow(_customers(spark, d), [(n, F.expr(c)) for n, c in _STEPS])


@add("exclusion_flow", "with k as (select * from (values ('AUTOMOBILE'), ('BUILDING'), ('FURNITURE'), ('HOUSEHOLD'), ('MACHINERY'), ('SHIPS')) k(c_mktsegment)) select k.c_mktsegment, count(c.c_custkey) as n from k left join customer c on c.c_mktsegment = k.c_mktsegment and c_acctbal < 0 group by 1", "", "n")
def exclusion_flow(spark, d):
    return cohort.counts_with_zeros(table(spark, d, "customer").where("c_acctbal < 0"), "c_mktsegment", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "SHIPS"])


_PRIO = ["2-HIGH", "1-URGENT", "3-MEDIUM"]
_PICK = "pick as (select o_custkey, o_orderkey, o_orderpriority, priority from (select *, case o_orderpriority when '2-HIGH' then 0 when '1-URGENT' then 1 when '3-MEDIUM' then 2 else 99 end as priority from orders) where priority < 99 qualify row_number() over (partition by o_custkey order by priority, o_orderkey) = 1)"


def _picked(spark, d):
    return cohort.choose(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority"), "o_custkey", "o_orderpriority", _PRIO, "o_orderkey")


@add("track_select", f"with {_PICK} select * from pick", "", "priority")
def track_select(spark, d):
    return _picked(spark, d)


@add("track_select_audit", f"with {_PICK}, a as (select o_orderpriority, count(*) as available, count(distinct o_custkey) as cases from orders group by 1), s as (select o_orderpriority, count(*) as selected from pick group by 1) select o_orderpriority, available, cases, coalesce(selected, 0) as selected from a left join s using (o_orderpriority)", "", "available cases selected")
def track_select_audit(spark, d):
    a = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("available"), F.count_distinct("o_custkey").alias("cases"))
    return a.join(_picked(spark, d).groupBy("o_orderpriority").agg(F.count("*").alias("selected")), "o_orderpriority", "left").fillna(0, ["selected"])


@add("candidate_head", "select c_custkey from customer where c_acctbal > 5000 order by 1 limit 25")
def candidate_head(spark, d):
    return cohort.head_candidates(table(spark, d, "customer").where("c_acctbal > 5000"), "c_custkey", 25)


@add("first_per_key", "select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) = 1")
def first_per_key(spark, d):
    return cohort.first_per_key(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], F.desc("o_totalprice"), "o_orderkey")


@add("guard_report", "select 'balance' as rule, count(*) filter (not coalesce(c_acctbal >= 0, false)) as violations from customer union all select 'segment', count(*) filter (not coalesce(length(c_mktsegment) > 8, false)) from customer union all select 'unique', coalesce(sum(n - 1), 0) from (select c_nationkey, count(*) as n from customer group by 1)", "", "violations")
def guard_report(spark, d):
    return cohort.guard_report(table(spark, d, "customer"), "c_nationkey", {"balance": F.col("c_acctbal") >= 0, "segment": F.length("c_mktsegment") > 8})


@add("ledger_check", "select c_nationkey, count(*) filter (c_acctbal > 0) as included, count(*) filter (not c_acctbal > 0) as left_out from customer group by 1", "", "included left_out")
def ledger_check(spark, d):
    c = table(spark, d, "customer").withColumn("flag", F.when(F.col("c_acctbal") > 0, " true").otherwise("False "))
    return cohort.ledger(c, "flag").groupBy("c_nationkey").agg(tally(F.col("included")).alias("included"), tally(~F.col("included")).alias("left_out"))


@add("duration_audit", f"with {b.SIG}, w as (select case_id, min(sec) as first_sec, max(sec) as last_sec, count(*) as n from sig group by 1) select case_id, (last_sec - first_sec) / 3600 as whole_hours, (least(last_sec, 1296000) - greatest(first_sec, 86400)) / 3600 as inner_hours, n * 10.0 as stored from w order by case_id limit 10", "whole_hours inner_hours stored")
def duration_audit(spark, d):
    w = b.readings(spark, d).groupBy("case_id").agg(F.min("sec").alias("lo"), F.max("sec").alias("hi"), F.count("*").alias("n"))
    return w.select("case_id", ((F.col("hi") - F.col("lo")) / 3600).alias("whole_hours"), ((F.least("hi", F.lit(1296000.0)) - F.greatest("lo", F.lit(86400.0))) / 3600).alias("inner_hours"), (F.col("n") * 10.0).alias("stored")).orderBy("case_id").limit(10)


@add("field_availability", "select 'c_acctbal' as field, 'customer' as source, count(c_acctbal) as present, count(*) filter (c_acctbal > 0) as positive from customer union all select 'c_nationkey', 'customer', count(c_nationkey), count(*) filter (c_nationkey > 0) from customer union all select 's_acctbal', 'supplier', count(s_acctbal), count(*) filter (s_acctbal > 0) from supplier union all select 's_nationkey', 'supplier', count(s_nationkey), count(*) filter (s_nationkey > 0) from supplier", "", "present positive")
def field_availability(spark, d):
    out = None
    for source, fields in {"customer": ["c_acctbal", "c_nationkey"], "supplier": ["s_acctbal", "s_nationkey"]}.items():
        t = table(spark, d, source)
        counts = F.array(*[F.struct(F.lit(f).alias("field"), F.count(f).alias("present"), tally(F.col(f) > 0).alias("positive")) for f in fields])
        one = t.agg(counts.alias("c")).select(F.explode("c").alias("c")).select("c.field", F.lit(source).alias("source"), "c.present", "c.positive")
        out = one if out is None else out.unionByName(one)
    return out


@add("claim_gate", "with g as (select c_nationkey, count(*) filter (c_acctbal > 9000) as gold from customer group by 1) select c_nationkey, gold, gold >= 5 as allowed, case when gold >= 5 then 'allowed' else 'too few: ' || gold || ' of 5' end as message from g", "", "gold")
def claim_gate(spark, d):
    g = table(spark, d, "customer").groupBy("c_nationkey").agg(tally(F.col("c_acctbal") > 9000).alias("gold"))
    return g.withColumn("allowed", F.col("gold") >= 5).withColumn("message", F.when(F.col("allowed"), "allowed").otherwise(F.concat(F.lit("too few: "), F.col("gold").cast("string"), F.lit(" of 5"))))


@add("id_list_hash", "select c_mktsegment, sha256(string_agg(c_custkey::varchar, chr(10) order by c_custkey)) as digest from customer where c_acctbal > 0 group by 1")
def id_list_hash(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 0")
    return cohort.ids_digest(c, ["c_mktsegment"], "c_custkey")


@add("text_privacy_scan", "with m as (select doc_id, r.rule, len(regexp_extract_all(coalesce(text, ''), r.pat)) as n from documents cross join (values ('email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}'), ('local_path', '(?:/Users/|/home/|C:\\\\Users\\\\)[A-Za-z0-9_]+'), ('key', '(?i)(?:token|secret|password) = '), ('long_number', '[0-9]{12,}')) r(rule, pat)) select rule, count(*) filter (n > 0) as texts, sum(n) as matches from m group by 1", "", "texts matches")
def text_privacy_scan(spark, d):
    return text_audit.scan(table(spark, d, "documents"), "doc_id", "text", text_audit.PRIVATE)


_PHRASES = {"absolute": r"\b(worthless|stupid|never)\b", "marks": r"(\*\*\*|###)", "shout": r"[A-Z]{6,}!!"}


#: Allowed where the claim is: the gate of ``claim_gate`` over all customers opens them.
_GATED = {"claims": r"\b(proven|certain|always)\b"}
_GATE = 5


@add("phrase_lint", f"with g as (select count(*) filter (c_acctbal > 9000) >= {_GATE} as allowed from customer), m as (select doc_id, r.rule, r.gated, len(regexp_extract_all(coalesce(text, ''), r.pat)) as n from documents cross join (values ('absolute', false, '\\b(?:worthless|stupid|never)\\b'), ('marks', false, '(?:\\*\\*\\*|###)'), ('shout', false, '[A-Z]{{6,}}!!'), ('claims', true, '\\b(?:proven|certain|always)\\b')) r(rule, gated, pat)) select rule, count(*) filter (n > 0) as texts, sum(n) as matches, count(*) filter (n > 0) = 0 or (gated and any_value(allowed)) as passes from m, g group by rule, gated", "", "texts matches")
def phrase_lint(spark, d):
    allowed = table(spark, d, "customer").agg((tally(F.col("c_acctbal") > 9000) >= _GATE).alias("allowed"))
    return text_audit.lint(table(spark, d, "documents"), "doc_id", "text", _PHRASES, _GATED, allowed)


@add("validated_join", "select o_orderkey, c_mktsegment, c_nationkey from orders left join customer on c_custkey = o_custkey")
def validated_join(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return cohort.validated_join(o, table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), "c_custkey", "many_to_one").drop("c_custkey")


@add("semi_anti", "select c_nationkey, count(*) filter (exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')) as with_f, count(*) filter (not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')) as without_f from customer group by 1", "", "with_f without_f")
def semi_anti(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    a = c.join(o, "c_custkey", "left_semi").select("c_nationkey", F.lit(1).alias("x"), F.lit(0).alias("y"))
    z = c.join(o, "c_custkey", "left_anti").select("c_nationkey", F.lit(0).alias("x"), F.lit(1).alias("y"))
    return a.unionByName(z).groupBy("c_nationkey").agg(F.sum("x").alias("with_f"), F.sum("y").alias("without_f"))


@add("membership_overlap", "with m as (select c_custkey, c_acctbal > 0 as a, c_custkey in (select o_custkey from orders where o_orderstatus = 'P') as b, c_nationkey < 10 as c from customer) select a, b, c, count(*) as n from m where a or b or c group by 1, 2, 3", "", "n")
def membership_overlap(spark, d):
    c = table(spark, d, "customer")
    p = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    m = cohort.membership({"a": c.where("c_acctbal > 0"), "b": c.join(p, "c_custkey", "left_semi"), "c": c.where("c_nationkey < 10")}, "c_custkey")
    return m.groupBy("a", "b", "c").agg(F.count("*").alias("n"))


@add("repeat_audit", "with n as (select o_custkey, count(*) as n from orders group by 1) select count(*) as clusters, count(*) filter (n > 1) as repeated, sum(n - 1) as extra, max(n) as most from n", "", "clusters repeated extra most")
def repeat_audit(spark, d):
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("clusters"), tally(F.col("n") > 1).alias("repeated"), F.sum(F.col("n") - 1).alias("extra"), F.max("n").alias("most"))


@add("flow_closure", f"with {_CUST} select c_nationkey, count(*) as total, count(*) filter (c_acctbal <= 0) as no_balance, count(*) filter (c_acctbal > 0 and coalesce(orders, 0) < 8) as few_orders, count(*) filter (c_acctbal > 0 and orders >= 8) as kept, true as closes from cust group by 1", "", "total no_balance few_orders kept")
def flow_closure(spark, d):
    out = _customers(spark, d).groupBy("c_nationkey").agg(F.count("*").alias("total"), tally(F.col("c_acctbal") <= 0).alias("no_balance"), tally((F.col("c_acctbal") > 0) & (F.coalesce("orders", F.lit(0)) < 8)).alias("few_orders"), tally((F.col("c_acctbal") > 0) & (F.col("orders") >= 8)).alias("kept"))
    return out.withColumn("closes", F.col("total") == F.col("no_balance") + F.col("few_orders") + F.col("kept"))


@add("dataset_manifest")
def dataset_manifest(spark, d):
    return files.manifest(spark, f"{d}/orders.parquet")


@add("marked_table", "select n_nationkey::varchar as n_nationkey, n_name, r_name, count(c_custkey) as customers from nation left join region on r_regionkey = n_regionkey left join customer on c_nationkey = n_nationkey group by 1, 2, 3", "", "customers")
def marked_table(spark, d):
    """A table written as CSV whose header begins with a byte order mark, read back by its own column names and joined."""
    path = files.shared_path(spark, "marked")
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    customers = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("string").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    files.write_table(nations.select("n_nationkey", "n_name", "r_name"), path)
    return files.read_table(spark, path).join(customers, "n_nationkey", "left").select("n_nationkey", "n_name", "r_name", F.coalesce("customers", F.lit(0)).alias("customers"))


@add("track_scan", f"with {b.SIG} select case_id as tid, count(value) as n, sum(value) as total from sig group by 1", "total", "tid n")
def track_scan(spark, d):
    """Readings of every user written as gzip CSV and read back by directory scan."""
    rows = b.readings(spark, d).select(F.col("case_id").alias("tid"), "sec", "value")
    return files.tracks_round_trip(rows).groupBy("tid").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@add("archive_members", f"with {b.SIG} select case_id, count(*) as n, sum(value) as total from sig group by 1", "total", "n")
def archive_members(spark, d):
    """Tables of a case packed into zip archives, and one member of each read back."""
    rows = b.readings(spark, d).groupBy("case_id").agg(F.concat_ws("\n", F.sort_array(F.collect_list(F.concat_ws(",", F.col("sec").cast("string"), F.col("value").cast("string"))))).alias("csv"))
    return files.archive_member(files.zipped(rows, "case_id", "csv"), "signal.csv").groupBy("case_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
