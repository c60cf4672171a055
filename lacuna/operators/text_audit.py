"""Rules over texts: identifiers and secrets that must not leave, and phrases that must not be written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Patterns of what identifies people or machines.
PRIVATE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "local_path": r"(/Users/|/home/|C:\\Users\\)[A-Za-z0-9_]+",
    "key": r"(?i)(token|secret|password) = ",
    "long_number": r"[0-9]{12,}",
}


def scan(df: DataFrame, key: str, text: str, rules: dict[str, str]) -> DataFrame:
    """rule, texts that match, matches."""
    counts = F.array(*[F.struct(F.lit(n).alias("rule"), F.regexp_count(text, F.lit(p)).alias("n")) for n, p in rules.items()])
    rows = df.select(key, F.explode(counts).alias("c")).select(key, "c.rule", F.coalesce("c.n", F.lit(0)).alias("n"))
    return rows.groupBy("rule").agg(F.count(F.when(F.col("n") > 0, F.lit(1))).alias("texts"), F.sum("n").alias("matches"))


def lint(df: DataFrame, key: str, text: str, rules: dict[str, str], gated: dict[str, str], allowed: DataFrame) -> DataFrame:
    """rule, texts, matches, passes: a rule passes without matches, and a gated one also where the one row of ``allowed`` is true."""
    found = scan(df, key, text, rules | gated).join(F.broadcast(allowed.toDF("_allowed")), F.lit(True))  # one row
    open_gate = F.col("rule").isin(*gated) & F.coalesce(F.col("_allowed"), F.lit(False))
    return found.withColumn("passes", (F.col("texts") == 0) | open_gate).drop("_allowed")


def forbidden_columns(columns: list[str], banned: set[str]) -> list[str]:
    return sorted(c for c in columns if c.lower() in banned)


def json_keys(df: DataFrame, column: str) -> DataFrame:
    """key, n: the keys of the outermost objects of a JSON column; text that is no object has none."""
    return df.select(F.explode(F.json_object_keys(column)).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
