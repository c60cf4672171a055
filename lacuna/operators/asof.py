"""As-of joins of the records of a case that are spread over tasks by time.

Both sides are put together and dealt by case and bucket of time. Within a bucket one window finds the last record before a row, or the first after it; what lies in other buckets
comes from the buckets' own last and first records, one row for each, carried on by a second, small window. So a case of any length is
as many groups as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a bucket.
BUCKET = 86_400.0


def neighbours(rows: DataFrame, mark: str, width: float = BUCKET, ahead: bool = True) -> DataFrame:
    """Adds back and, with ``ahead``, ahead: the last ``mark`` of the case at or before a row's ``sec``, and the first at or after it.

    ``mark`` is a struct whose first field is the record's own ``sec``, and NULL in rows that are no records. Of records at one time the largest is the last and the smallest the first. A row
    without a case or a time has no neighbours.
    """
    kept = rows.withColumn("_bucket", F.floor(F.col("sec") / width))
    group = Window.partitionBy("case_id", "_bucket")
    start = Window.unboundedPreceding
    # at the same time records come before other rows, in both directions
    other = F.col(mark).isNull().cast("int")
    found = {"back": F.last(mark, ignorenulls=True).over(group.orderBy("sec", other, mark).rowsBetween(start, 0))}
    ends = [F.max(mark).alias("_back")]
    carried = {"_back": F.max("_back").over(Window.partitionBy("case_id").orderBy("_bucket").rowsBetween(start, -1))}
    if ahead:
        found["ahead"] = F.last(mark, ignorenulls=True).over(group.orderBy(F.desc("sec"), other, F.desc(mark)).rowsBetween(start, 0))
        ends.append(F.min(mark).alias("_ahead"))
        carried["_ahead"] = F.min("_ahead").over(Window.partitionBy("case_id").orderBy(F.desc("_bucket")).rowsBetween(start, -1))
    edges = kept.groupBy("case_id", "_bucket").agg(*ends).select("case_id", "_bucket", *[c.alias(n) for n, c in carried.items()])
    kept = kept.withColumns(found).join(edges, ["case_id", "_bucket"], "left")
    known = F.col("case_id").isNotNull() & F.col("sec").isNotNull()
    return kept.withColumns({n: F.when(known, F.coalesce(n, f"_{n}")) for n in found}).drop("_bucket", *carried)
