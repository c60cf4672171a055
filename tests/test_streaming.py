from lacuna.streaming.bins import completed_bins


def test_only_complete_bins_are_emitted(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "case_id long, ts timestamp, value double"
    first = [(1, 10.0, 5), (1, 30.0, 25), (1, 1000.0, 26), (1, 50.0, 70)]
    for k, rows in enumerate([first, [(1, 99.0, 20), (1, 70.0, 400)]]):
        df = spark.createDataFrame([(c, float(s), v) for c, v, s in rows], "case_id long, sec double, value double")
        df.selectExpr("case_id", "timestamp_seconds(sec) as ts", "value").coalesce(1).write.mode("append").parquet(f"{source}/{k}")
    for k in range(2):
        stream = spark.readStream.schema(schema).parquet(f"{source}/*")
        query = completed_bins(stream, "1 minute", "30 seconds", 1.0, 300.0).writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out")).selectExpr("case_id", "unix_seconds(start) as s", "value").orderBy("s").collect()
    assert all(r["s"] < 400 for r in found) and 0 in [r["s"] for r in found]
