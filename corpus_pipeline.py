"""A corpus pipeline: quality rules, near-duplicates, decontamination, secrets, mix.

Each stage is a function of (spark, docs, sf_dir). All but the last return the columns of ``docs``;
each result is written as Parquet and read again for the next stage, so a lost executor costs one stage at most.

Defined cases: an empty table goes through all stages as one; an empty benchmark takes nothing; a null or wordless text fails the quality rules;
rows that repeat are near-duplicates of each other, of which one stays; of equal ids and texts any row is the same, and texts that share an id are documents of their own;
a null doc_id is a document like others, and comes last where ties are settled by id; extra columns are kept up to the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import decontaminate, mixing, quality, secrets, simhash
from lacuna.llm.common import meet, settled, shared_dir, small_batches


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules or lie outside their group's estimate go."""
    named = docs.select(F.struct(*docs.columns).alias("row"), "text", quality.group_of("lang", "source").alias("group"))
    stats = settled(quality.with_statistics(named, "s").drop("text"))  # rows with their statistics, read again by columns
    return quality.judged(stats, quality.fitted(stats.select("group", "s"))).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component one row stays: that with the smallest id (a null one comes last), and of equal ids that with the smallest hash of the row."""
    small_batches(spark)
    flat = [x for c in docs.columns for x in (F.col(c).isNull(), F.col(c))]  # the hash alone would skip nulls
    keyed = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", F.xxhash64(*flat).alias("key"))
    prints = settled(keyed.select("doc_id", "key", F.pandas_udf(simhash.fingerprints_of, "long")("text").alias("fp")))
    roots = settled(simhash.placed(prints).select("fp", "root"))
    # by fingerprint and a part of the hash first, so that a component of any size is spread
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")
    least = prints.groupBy("fp", F.pmod("key", F.lit(64)).alias("part")).agg(F.min(rank).alias("rank"))
    least = settled(meet(least, roots, ["fp"]).groupBy("root").agg(F.min("rank").alias("rank")).select("rank.doc_id", "rank.key"))
    return meet(keyed, least, ["doc_id", "key"], "left_semi").dropDuplicates(["doc_id", "key"]).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return decontaminate.add_hits(rows, benchmark, "hit").where("size(hit.spans) = 0").select("row.*")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reported spans are replaced by [kind]; n_chars follows the text. Texts without spans stay as they are."""
    small_batches(spark)
    keyed = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    spans = secrets.find(docs.select("doc_id", "text"))
    spans = spans.where("size(strong) + size(linked) > 0").select("doc_id", "text_key", secrets.as_text(secrets.in_order(F.concat("strong", "linked"))).alias("listed")).dropDuplicates(["doc_id", "text_key"])
    rows = meet(keyed, settled(spans), ["doc_id", "text_key"], "left")
    rows = rows.withColumn("clean", F.when(F.col("listed").isNotNull(), F.pandas_udf(secrets.cut_out, "string")("text", "listed")).otherwise(F.col("text")))
    changed = {"text": F.col("clean")} | ({"n_chars": F.when(F.col("listed").isNotNull(), F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))} if "n_chars" in docs.columns else {})
    return rows.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document of the mix: doc_id, size, source_size, target, taken, copies, rate."""
    return mixing.mix(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Fingerprints, covariance estimates and the tilt are not expressible in SQL; tests compare with a brute-force version.
ORACLE_SQL = None
