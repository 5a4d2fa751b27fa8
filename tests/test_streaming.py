from quiver.streaming.ingest import file_stream, ingest, run_to_table, windowed_counts


def test_batches_are_written_once(spark, tmp_path):
    src, target, mark = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark"
    df = spark.createDataFrame([(i, i % 3) for i in range(10)], "k int, g int")
    df.limit(6).write.parquet(src)
    read = lambda: file_stream(spark, src, df.schema, 1)
    ingest(read(), target, mark)
    ingest(read(), target, mark)
    assert spark.read.parquet(target).count() == 6
    df.filter("k >= 6").write.mode("append").parquet(src)
    ingest(read(), target, mark, lambda b: b.select("k"))
    assert sorted(r.k for r in spark.read.parquet(target).select("k").collect()) == list(range(10))


def test_windows_come_out_when_complete(spark, tmp_path):
    src = f"{tmp_path}/in"
    df = spark.createDataFrame([("a", "2025-01-01 00:10:00"), ("a", "2025-01-01 00:50:00"), ("b", "2025-01-01 01:10:00"), ("a", "2025-01-01 03:00:00")], "g string, at string").selectExpr("g", "CAST(at AS TIMESTAMP) AS at")
    df.coalesce(1).write.parquet(src)
    out = run_to_table(windowed_counts(file_stream(spark, src, df.schema), "at", ["g"], "1 hour", "30 minutes"), "w")
    assert sorted((r.g, r.start.hour, r.n) for r in out.collect()) == [("a", 0, 2), ("b", 1, 1)]
