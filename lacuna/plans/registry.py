"""How a plan module registers a query with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Digits kept of values below and from LARGE on.
DIGITS, FEWER, LARGE = 6, 2, 1e5


class Registry:
    """Queries and their SQL; both sides are rounded and cast alike, since sums of doubles depend on order."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None, doubles: str = "", longs: str = ""):
        doubled, whole = doubles.split(), longs.split()

        def keep(make: Callable[[SparkSession, str], DataFrame]):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                df = make(spark, sf_dir)
                short = lambda x: F.when(F.abs(x) < LARGE, F.round(x, DIGITS)).otherwise(F.round(x, FEWER)) + F.lit(0.0)
                return df.withColumns({c: short(F.col(c).cast("double")) for c in doubled} | {c: F.col(c).cast("long") for c in whole})

            self.queries[name] = run
            if sql:
                changed = [f"case when abs({c}::double) < {LARGE} then round({c}::double, {DIGITS}) else round({c}::double, {FEWER}) end + 0.0 as {c}" for c in doubled] + [f"{c}::bigint as {c}" for c in whole]
                self.sql[name] = f"select * {'replace (' + ', '.join(changed) + ')' if changed else ''} from ({sql}) q"
            return make

        return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
