"""Helpers that several training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: U+0020 and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]+"

#: Records, and bytes, that an Arrow batch may hold. Texts can be long; this bounds a Python worker's memory.
BATCH_ROWS, BATCH_BYTES = 512, 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. A session of one machine may do without (tests) and has a temporary one; a cluster must name it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = own_folder(spark.sparkContext.applicationId)
    return found.rstrip("/")


@lru_cache
def own_folder(application: str) -> str:
    """One temporary folder for an application without spark.checkpoint.dir."""
    return tempfile.mkdtemp(prefix="spark-")


def settled(df: DataFrame) -> DataFrame:
    """``df`` as a table written once to the shared folder: it cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Sets the Arrow batch sizes that the text operators need; the settings belong to the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def meet(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``a`` joined with the other columns of ``b`` on keys that may be null; the rest of their names must differ."""
    b = b.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in b.columns if c not in keys])
    hit = F.lit(True)
    for n, k in enumerate(keys):
        same = F.col(k).eqNullSafe(F.col(f"__{k}"))
        hit = hit & same if n else same
    return a.join(b, hit, how).drop(*[f"__{k}" for k in keys])


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def running_sums(df: DataFrame, keys: list[str], order: str, values: list[str], block: int = 1024) -> DataFrame:
    """Adds ``before_<v>``: the sum of ``v`` over the key's rows whose integer ``order`` is smaller.

    (keys, order) must be unique; without keys there is one sequence. Two levels keep every window small: sums of blocks of
    ``block`` successive orders first, then the rows of one block.
    """
    from pyspark.sql import Window

    spot = [*keys, "_block"]
    rows = df.withColumn("_block", F.floor(F.col(order) / block))
    sums = rows.groupBy(*spot).agg(*[F.sum(v).alias(f"_sum_{v}") for v in values])
    outer = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*spot, *[F.coalesce(F.sum(f"_sum_{v}").over(outer), F.lit(0)).alias(f"_base_{v}") for v in values])
    inner = Window.partitionBy(*spot).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", *[F.coalesce(F.sum(v).over(inner), F.lit(0)).alias(f"_in_{v}") for v in values])
    return meet(rows, sums, spot).select(*df.columns, *[(F.col(f"_base_{v}") + F.col(f"_in_{v}")).alias(f"before_{v}") for v in values])
