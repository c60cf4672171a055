"""Running totals, numbering and exact quantiles of whole tables, without one task that holds them.

Rows are dealt by ranges of their order and written as a table with the number of their range; the totals of earlier ranges (one row for each) are
then added to running totals within a range. Quantiles go over counts by value, so that a frequent value is one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.sources.files import settled


def running(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all rows that come before in the given order, which must be total."""
    rows = settled(df.withColumn("_v", value).repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sums = rows.groupBy("_p").agg(F.sum("_v").alias("_s"))  # a row for each range
    base = sums.select("_p", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inner = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(F.broadcast(base), "_p").withColumn(name, F.col("_base") + F.coalesce(F.sum("_v").over(inner), F.lit(0))).drop("_p", "_v", "_base")


def numbered(df: DataFrame, order: list[Column], name: str = "n") -> DataFrame:
    """Adds ``name``: 1, 2, ... in the given total order."""
    return running(df, order, F.lit(1).cast("long"), name).withColumn(name, F.col(name) + 1)


def _meet(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """``a`` with the other columns of ``b`` on keys that may be NULL."""
    b = b.select(*[F.col(k).alias(f"_on_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in keys])
    return a.join(b, on).drop(*[f"_on_{k}" for k in keys])


def quantiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """keys and each wanted quantile (of a column's values, interpolated between neighbours; NULL without values), a row for every key of ``df``.

    Without keys there is one row. Keys may be NULL. For few groups of many rows; where groups are many and small, Spark's own percentile serves.
    """
    columns: dict[str, tuple[int, Column]] = {}
    for c, _ in wanted.values():
        columns.setdefault(str(c), (len(columns), c))
    parts = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), c.cast("double").alias("v")) for i, c in columns.values()]))
    place = [F.col(k) for k in keys]
    counts = df.select(*keys, parts.alias("_x")).select(*keys, F.col("_x.i").alias("_i"), F.col("_x.v").alias("_value"))
    counts = counts.groupBy(*keys, "_i", "_value").agg(F.count("*").alias("_n"))
    # NULLs keep their group but are no values
    number = F.when(F.col("_value").isNotNull(), F.col("_n")).otherwise(0)
    up = running(counts.withColumn("_n", number), [*place, F.col("_i"), F.col("_value")], F.col("_n"), "_before")
    spans = up.groupBy(*keys, "_i").agg(F.min("_before").alias("_start"), F.sum("_n").alias("_all"))
    rows = _meet(up, spans, [*keys, "_i"]).withColumns({"_from": F.col("_before") - F.col("_start"), "_to": F.col("_before") - F.col("_start") + F.col("_n")})
    out = []
    for name, (c, share) in wanted.items():
        at = (F.col("_all") - 1) * F.lit(share)
        mine = F.col("_i") == columns[str(c)][0]
        holds = lambda x: mine & (F.col("_from") <= x) & (x < F.col("_to"))  # noqa: B023, E731
        out += [F.max(F.when(holds(F.floor(at)), F.col("_value"))).alias(f"_l_{name}"), F.max(F.when(holds(F.ceil(at)), F.col("_value"))).alias(f"_h_{name}"), F.max(F.when(mine, at - F.floor(at))).alias(f"_w_{name}")]
    ends = rows.groupBy(*keys).agg(*out)
    return ends.select(*keys, *[(F.col(f"_l_{n}") + (F.col(f"_h_{n}") - F.col(f"_l_{n}")) * F.col(f"_w_{n}")).alias(n) for n in wanted])


def with_quantiles(out: DataFrame, df: DataFrame, keys: list[str], wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """``out`` (a row for each key) with the wanted quantiles of ``df``."""
    found = quantiles(df, keys, wanted)
    if not keys:
        return out.join(F.broadcast(found), F.lit(True))  # one row
    return _meet(out, found, keys)
