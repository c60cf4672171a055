"""Cohort building: predicates in order, choices among candidates, guards that report or fail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.columns import tally

from . import scan


def text_category(columns: list[str], hierarchy: list[tuple[str, list[str]]], banned: list[str]) -> Column:
    """First category of the hierarchy with a banned term in the joined text, then 'other' for other banned terms, else ''."""
    text = F.lower(F.concat_ws(" ", *[F.col(c) for c in columns]))
    named = {t for _, terms in hierarchy for t in terms}
    out = None
    for category, terms in hierarchy:
        hit = F.lit(False)
        for t in terms:
            if t in banned:
                hit = hit | text.contains(t)
        out = F.when(hit, category) if out is None else out.when(hit, category)
    rest = F.lit(False)
    for t in sorted(set(banned) - named):
        rest = rest | text.contains(t)
    return out.when(rest, "other").otherwise("")


def flow(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """step, name, remaining, excluded after each predicate in turn (NULL fails). One pass: the first failed step of each row is counted."""
    failed = F.coalesce(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(i)) for i, (_, c) in enumerate(steps, 1)], F.lit(len(steps) + 1))
    counts = df.groupBy(failed.alias("f")).agg(F.count("*").alias("n"))
    spine = [F.struct(F.lit(0).alias("step"), F.lit("start").alias("name")), *[F.struct(F.lit(i).alias("step"), F.lit(n).alias("name")) for i, (n, _) in enumerate(steps, 1)]]
    rows = counts.withColumn("s", F.explode(F.array(*spine))).select("s.step", "s.name", "f", "n")
    return rows.groupBy("step", "name").agg(F.sum(F.when(F.col("f") > F.col("step"), F.col("n")).otherwise(0)).alias("remaining"), F.sum(F.when(F.col("f") == F.col("step"), F.col("n")).otherwise(0)).alias("excluded"))


def counts_with_zeros(df: DataFrame, column: str, categories: list[str]) -> DataFrame:
    """category, n for every category, zero where none occurs."""
    spine = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in categories])).alias(column))
    return spine.join(df.groupBy(column).agg(F.count("*").alias("n")), column, "left").fillna(0, ["n"])


def choose(df: DataFrame, key: str, name: str, candidates: list[str], tie: str, contains: bool = False) -> DataFrame:
    """One row per key: the candidate earliest in the list (99 for others, which are dropped), ties by ``tie``."""
    rank = F.lit(99)
    for i, c in reversed(list(enumerate(candidates))):
        rank = F.when(F.col(name).contains(c) if contains else F.col(name) == c, i).otherwise(rank)
    w = Window.partitionBy(key).orderBy("priority", tie)
    return df.withColumn("priority", rank).where("priority < 99").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_per_key(df: DataFrame, keys: list[str], *order) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def head_candidates(df: DataFrame, key: str, most: int | str) -> DataFrame:
    """The ``most`` smallest keys, or all."""
    if most == "all":
        return df.select(key)
    if int(most) <= 0:
        raise ValueError("at least one candidate is needed")
    return df.select(key).orderBy(key).limit(int(most))


def guard_report(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """rule, violations: rows for which a rule is not true, and keys that repeat. Nothing is raised."""
    repeats = df.groupBy(key).agg((F.count("*") - 1).alias("x")).agg(F.coalesce(F.sum("x"), F.lit(0)).alias("violations")).select(F.lit("unique").alias("rule"), "violations")
    found = df.agg(*[tally(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    return found.unpivot([], list(rules), "rule", "violations").unionByName(repeats)


def ledger(df: DataFrame, flag: str) -> DataFrame:
    """Adds included: TRUE or FALSE from text; anything else fails."""
    text = F.upper(F.trim(F.col(flag)))
    return df.withColumn("included", F.when(text == "TRUE", True).when(text == "FALSE", False).otherwise(F.raise_error(F.concat(F.lit("ambiguous flag: "), F.coalesce(F.col(flag), F.lit("NULL")))).cast("boolean")))


def validated_join(left: DataFrame, right: DataFrame, key: str, kind: str, how: str = "left") -> DataFrame:
    """A join that fails where a side that must be unique repeats a key: kind is one_to_one, many_to_one or one_to_many."""
    def unique(df: DataFrame) -> DataFrame:
        n = F.count("*").over(Window.partitionBy(key))
        return df.withColumn("_n", n).where(F.when(F.col("_n") > 1, F.raise_error(F.lit(f"{key} repeats")).cast("boolean")).otherwise(True)).drop("_n")

    if kind not in ("one_to_one", "many_to_one", "one_to_many"):
        raise ValueError(f"unknown cardinality: {kind}")
    return (unique(left) if kind.startswith("one_") else left).join(unique(right) if kind.endswith("to_one") else right, key, how)


def duplicate_faults(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).agg(F.count("*").alias("keys"), tally(F.col("n") > 1).alias("repeated"))


def membership(cohorts: dict[str, DataFrame], key: str) -> DataFrame:
    """A flag per cohort for every key of any of them."""
    rows = None
    for name, df in cohorts.items():
        one = df.select(key, F.lit(name).alias("_c")).distinct()
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy(key).agg(*[F.bool_or(F.col("_c") == n).alias(n) for n in cohorts])


def ids_digest(df: DataFrame, groups: list[str], key: str) -> DataFrame:
    """groups and digest: SHA-256 of the exact list of a group's ids, in order, one a line. Ids are sorted and streamed through, lists of any length."""
    rows = df.select(*groups, F.col(key).alias("_key"), F.col(key).cast("string").alias("_text"))
    return scan.scanned(rows, groups, ["_key"], ["_text"], "digest string", scan.digest_of_lines)
