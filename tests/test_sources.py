"""Round trips of the file formats, and streams."""

from pyspark.sql import functions as F

from tidewarp import sources, streaming


def test_batches(spark, tmp_path):
    rows = [(0, 0, 5), (0, 1, 7), (1, 0, 3)]
    sources.write_batches(spark.createDataFrame(rows, "batch_id bigint, place bigint, raw_len bigint"), str(tmp_path / "b"), 8)
    assert sorted(r["raw_len"] for r in sources.read_batches(spark, str(tmp_path / "b")).collect()) == [3, 5, 7]


def test_results_resume(spark, tmp_path):
    cols = "n_heads int, framework string, avg_time string, n_iters int"
    path = str(tmp_path / "exp" / "r.csv")
    first = spark.createDataFrame([(8, "a", "1.5", 3), (8, "b", "None", 3)], cols)
    assert sources.append_results(first, path, spark).count() == 2
    sources.append_results(spark.createDataFrame([(8, "a", "2.0", 3), (8, "b", "2.5", 3)], cols), path, spark)
    assert spark.read.schema(first.schema).option("header", True).csv(path).count() == 3


def test_logs_and_runs(spark, tmp_path):
    d = tmp_path / "ds" / "fw" / "run1"
    d.mkdir(parents=True)
    (d / "log.txt").write_text("x\nTraining loss: 2.5\n")
    assert {r["run"] for r in sources.read_logs(spark, str(tmp_path)).collect()} == {"run1"}
    r = sources.read_runs(spark, str(tmp_path)).first()
    assert (r["dataset"], r["framework"], r["run"], r["file"]) == ("ds", "fw", "run1", "log.txt")


def test_cache(spark, tmp_path):
    a = sources.cached(spark.range(3), str(tmp_path), split="x", n=3)
    b = sources.cached(spark.range(9), str(tmp_path), split="x", n=3)
    assert a.count() == b.count() == 3


def test_records_and_trace(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0)], "framework string, metric double")
    sources.write_records(df, str(tmp_path / "r"))
    assert sources.read_records(spark, str(tmp_path / "r"), df.schema).collect() == df.collect()
    spans = spark.createDataFrame([("w", "c", 1.0, 2.0, 0, 1)], "name string, cat string, start_ms double, dur_ms double, node int, device int")
    assert '"ph":"X"' in sources.trace_events(spans).first()["value"]


def test_pack_stream(spark, tmp_path):
    for i, rows in enumerate([[(0, 0, 400), (0, 1, 300), (0, 2, 250)], [(0, 3, 900), (0, 4, 100), (0, 5, 50)]]):
        spark.createDataFrame([(k, p, p, n) for k, p, n in rows], "key int, place bigint, id bigint, n bigint").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("key int, place bigint, id bigint, n bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming.pack_stream(s, "key", 1000).writeStream.format("memory").queryName("packed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r["ids"]) for r in spark.sql("select * from packed order by batch").collect()] == [(0, 1, 2), (3, 4)]


def test_windowed_counts(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 00:00:01' as ts, 'a' as event_type, 1D as value, 1L as user_id union all select timestamp'2024-01-01 01:00:00', 'a', 2D, 1L").write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema("ts timestamp, event_type string, value double, user_id bigint").parquet(str(tmp_path / "e"))
    q = streaming.windowed_counts(s, "5 minutes", "1 minute").writeStream.format("memory").queryName("counted").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counted").agg(F.sum("n")).first()[0] == 2
