"""Shapes of result tables: wide and long, typed cells, formatted estimates."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def wide(df: DataFrame, keys: list[str], column: str, values: list[str], measure: str) -> DataFrame:
    """A column per value of ``column``; the values are given, so no extra job finds them."""
    return df.groupBy(*keys).pivot(column, values).agg(F.first(measure))


def union_of(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def typed_cell(text: str) -> Column:
    """kind and number of a text cell: blank, bool, int, float or text."""
    t = F.trim(F.col(text))
    kind = F.when(t.isNull() | (t == ""), "blank").when(F.lower(t).isin("true", "false"), "bool").when(t.rlike(r"^[+-]?[0-9]+$"), "int").when(t.rlike(r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)([eE][+-]?[0-9]+)?$"), "float").otherwise("text")
    return F.struct(kind.alias("kind"), F.when(kind.isin("int", "float"), t.try_cast("double")).when(kind == "bool", (F.lower(t) == "true").cast("double")).alias("number"))


def half_up(x: Column, digits: int) -> Column:
    """Rounded half up in plain arithmetic, the same in every engine."""
    return F.floor(x * 10**digits + 0.5).cast("double") / 10**digits


def estimate_text(estimate: str, low: str, high: str, digits: int = 2) -> Column:
    """'est (lo to hi)', or 'Not estimable'."""
    f = lambda c: F.format_string(f"%.{digits}f", half_up(F.col(c), digits))
    return F.when(F.col(estimate).isNull() | F.col(low).isNull() | F.col(high).isNull(), "Not estimable").otherwise(F.concat(f(estimate), F.lit(" ("), f(low), F.lit(" to "), f(high), F.lit(")")))


def p_text(p: str) -> Column:
    return F.when(F.col(p).isNull(), "Not estimable").when(F.col(p) < 0.001, "<0.001").otherwise(F.format_string("%.3f", half_up(F.col(p), 3)))


def inside(df: DataFrame, estimate: str, low: str, high: str) -> DataFrame:
    """Adds ``sound``: the estimate lies within its interval."""
    return df.withColumn("sound", (F.col(low) <= F.col(estimate)) & (F.col(estimate) <= F.col(high)))


def brought_up_to_date(stored: DataFrame, rows: DataFrame, changed: DataFrame, key: str, summarise: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A stored summary with the changed keys summarised again from ``rows`` and all others taken as they are.

    A key that is new must be among the changed ones. The result has a row for every key of ``rows``; another number is an error.
    """
    again = summarise(rows.join(changed, key, "left_semi"))
    out = stored.join(changed, key, "left_anti").unionByName(again)
    counts = out.agg(F.count("*").alias("_have"), F.count_distinct(key).alias("_keys")).join(F.broadcast(rows.agg(F.count_distinct(key).alias("_want"))), F.lit(True))  # one row each
    whole = F.assert_true((F.col("_have") == F.col("_want")) & (F.col("_keys") == F.col("_want")), F.lit("the summary does not cover the keys once"))
    return out.join(F.broadcast(counts), F.lit(True)).where(whole.isNull()).drop("_have", "_keys", "_want")  # one row


def consistent(one: DataFrame, other: DataFrame, keys: list[str], columns: list[str], tolerance: float = 1e-12) -> DataFrame:
    """``one`` with largest, the greatest relative difference of its columns from those of ``other``, and passed; a key that only one has does not pass."""
    rows = one.join(other.withColumnsRenamed({c: f"_{c}" for c in columns}), keys, "full_outer")
    off = [F.abs(F.col(c) - F.col(f"_{c}")) / F.greatest(F.abs(F.col(c)), F.lit(1.0)) for c in columns]
    rows = rows.withColumn("largest", F.greatest(*off) if len(off) > 1 else off[0])
    known = reduce(Column.__and__, [F.col(x).isNotNull() for c in columns for x in (c, f"_{c}")])
    return rows.withColumn("passed", known & F.coalesce(F.col("largest") <= tolerance, F.lit(False))).drop(*[f"_{c}" for c in columns])


def conserved(df: DataFrame, whole: str, parts: list[str]) -> DataFrame:
    """``df``, in which the parts of every row must add up to the whole."""
    fits = F.assert_true(F.col(whole) == reduce(Column.__add__, [F.col(c) for c in parts]), F.lit(f"{whole} is not the sum of {', '.join(parts)}"))
    return df.withColumn(whole, F.when(fits.isNull(), F.col(whole)))


def balanced(df: DataFrame, keys: list[str], name: str, count: str, rules: dict[str, list[str]]) -> DataFrame:
    """``df`` with a row for each ``name`` of the keys, in which the counts of a rule's parts must add up to that of its whole; a name without a row counts 0."""
    of = lambda *names: F.coalesce(F.sum(F.when(F.col(name).isin(*names), F.col(count))).over(Window.partitionBy(*keys)), F.lit(0))
    off = F.array_join(F.array_compact(F.array(*[F.when(of(whole) != of(*parts), F.lit(f"{whole} is not the sum of {', '.join(parts)}")) for whole, parts in rules.items()])), "; ")
    rows = df.withColumn("_off", off)
    return rows.withColumn(count, F.when(F.assert_true(F.col("_off") == "", F.col("_off")).isNull(), F.col(count))).drop("_off")
