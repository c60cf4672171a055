import hashlib
import random
import zlib

from pyspark.sql import functions as F

from lacuna.llm import sharding


def brute(rows, shards):
    """Multiset of (doc_id, size, crc, shard, slot): the middle of a row's bytes decides; rows by text digest and id."""
    def key(r):
        return int(hashlib.md5((r[1] or "").encode()).hexdigest()[:15], 16), -(1 << 63) if r[0] is None else r[0]

    size = lambda t: len((t or "").encode()) + 16
    total = sum(size(t) for _, t in rows)
    out, before, slots = [], 0, {}
    for i, t in sorted(rows, key=key):
        s = (2 * before + size(t)) * shards // (2 * total)
        out.append((i, size(t), zlib.crc32((t or "").encode()), "bytes", s, slots.get(s, 0), None))
        slots[s] = slots.get(s, 0) + 1
        before += size(t)
    return sorted(out, key=repr)


def test_shards_equal_brute_force(spark):
    r = random.Random(3)
    rows = [(k, "".join(r.choice("abé ") for _ in range(r.randint(0, 80)))) for k in range(300)]
    rows += [(1000 + k, "one text of a third of the rows") for k in range(200)]  # a hot text
    rows += [(7, "repeated"), (7, "repeated"), (7, "repeated"), (None, "no id"), (None, None), (5, None), (6, ""), (9, "long " * 5000)]
    r.shuffle(rows)
    docs = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "doc_id long, text string, shard string, k1 int").repartition(5)
    for shards in (1, 3, 40):
        got = sorted([tuple(x) for x in sharding.shard(docs, shards).collect()], key=repr)
        assert got == brute(rows, shards)
    few = sharding.sharded(docs, 7, probes=1, pieces=50)  # one probe a splitter: more rounds, the same borders
    assert sorted(few.select("row.doc_id", "size", "shard", "slot").collect(), key=repr) == sorted([(a, s, h, n) for a, s, _, _, h, n, _ in brute(rows, 7)], key=repr)


def test_tolerance_bounds_the_error(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.expr("repeat('x', cast(id % 37 as int))").alias("text"))
    total = sum(k % 37 + 16 for k in range(2000))
    got = sharding.sharded(docs, 4, tolerance=500, pieces=1).groupBy("shard").agg(F.sum("size").alias("s"), F.max("slot").alias("m"), F.count("*").alias("n")).collect()
    assert sum(x["s"] for x in got) == total and all(abs(x["s"] - total / 4) <= 1000 + 52 and x["m"] == x["n"] - 1 for x in got)


def test_small_and_empty_tables(spark):
    schema = "doc_id string, text string"
    assert sharding.shard(spark.createDataFrame([], schema)).collect() == []
    assert [tuple(x)[1:6] for x in sharding.shard(spark.createDataFrame([("a", "é")], schema), 4).collect()] == [(18, zlib.crc32("é".encode()), "bytes", 2, 0)]
    three = sharding.shard(spark.createDataFrame([("a", "p"), ("b", "q"), (None, None)], schema)).collect()
    assert len({x["shard"] for x in three}) == 3 and all(x["slot"] == 0 for x in three)


def test_files_of_shards(spark, tmp_path):
    docs = spark.createDataFrame([(k, "t" * k) for k in range(50)], "doc_id long, text string")
    sharding.write_shards(sharding.sharded(docs, 5), f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 50 and sorted(x[0] for x in back.select("_shard").distinct().collect()) == [0, 1, 2, 3, 4]
    assert all(b["doc_id"] is not None and b["text"] == "t" * b["doc_id"] for b in back.collect())
