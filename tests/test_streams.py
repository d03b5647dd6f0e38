from pyspark.sql import functions as F

from tablewright import streaming


def test_rows_of_a_stream_go_to_files(spark, tmp_path):
    rows = [(n, f"k{n % 3}", float(n)) for n in range(50)]
    spark.createDataFrame(rows, "n int, k string, v double").repartition(4).write.parquet(f"{tmp_path}/t")
    stream = spark.readStream.schema("n int, k string, v double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/t")
    sums = {k: sum(v for _, x, v in rows if x == k) for k in ("k0", "k1", "k2")}
    out = streaming.collected(streaming.running_sum(stream, "k", "n", "v"), "files1")
    assert out.count() == 50 and {r.k: r.m for r in out.groupBy("k").agg(F.max("cumsum").alias("m")).collect()} == sums
    total = streaming.groupby(stream, "k", "sum(v) as s")
    assert {r.k: r.s for r in streaming.collected(total, "files2", "complete").collect()} == sums
    updated = streaming.collected(total, "files3", "update")
    assert {r.k: r.s for r in updated.groupBy("k").agg(F.max("s").alias("s")).collect()} == sums
    # the driver holds no copy: no table of the session is made, and all is read from files
    for df in (out, updated):
        assert df.inputFiles() and "MemoryPlan" not in df._jdf.queryExecution().toString()


def test_stream_without_rows(spark, tmp_path):
    spark.createDataFrame([], "n int, k string, v double").write.parquet(f"{tmp_path}/t")
    stream = spark.readStream.schema("n int, k string, v double").parquet(f"{tmp_path}/t")
    assert streaming.collected(streaming.running_sum(stream, "k", "n", "v"), "none1").collect() == []
    assert streaming.collected(streaming.groupby(stream, "k", "sum(v) as s"), "none2", "complete").collect() == []
