"""Column helpers. Missing is NULL everywhere; NaN is turned into NULL where data come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number(c: Column | str) -> Column:
    """A number, or NULL for text that is none and for NaN."""
    x = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    return F.when(~F.isnan(x), x)


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)


def total(c: Column) -> Column:
    """Sum in which no rows give 0."""
    return F.coalesce(F.sum(c), F.lit(0.0))


def tally(condition: Column) -> Column:
    """How many rows meet the condition."""
    return F.count(F.when(condition, F.lit(1)))


def seconds_since(ts: str, origin: str) -> Column:
    """Seconds from ``origin`` to a timestamp column, whatever the session's time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, cast('{origin}' as timestamp_ntz), cast({ts} as timestamp_ntz))") / 1e6


def dealt(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join that must not be sent whole to every task: Spark takes rows that an explode or a packed file multiplies for as few as before."""
    return df.hint("merge")


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def hashed(*parts) -> Column:
    """A number of 32 bits from the md5 of the parts, equal in every engine that has md5."""
    key = F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")
