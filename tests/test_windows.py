from pyspark.sql import functions as F

from skarnwell.streaming import watch


def test_windows_on_a_stream_drop_what_is_late(spark, tmp_path):
    src = tmp_path / "in"
    schema = "ts timestamp, k string, v double"

    def write(n, rows):
        spark.createDataFrame(rows, "s long, k string, v double").select(F.timestamp_seconds("s").alias("ts"), "k", "v").coalesce(1).write.parquet(f"{src}/{n}")

    write(0, [(0, "a", 1.0), (3599, "a", 2.0), (3600, "a", 4.0)])
    out = watch.tumbling(spark.readStream.schema(schema).parquet(f"{src}/*"), "ts", ["k"], "v", "1 hour", late="10 minutes")

    def run():
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        got = spark.read.schema("window_start timestamp, k string, n long, total double").parquet(str(tmp_path / "out"))
        return sorted((int(r.window_start.timestamp()), r.n, r.total) for r in got.collect())

    assert run() == []
    write(1, [(9000, "a", 1.0)])
    assert run() == [(0, 2, 3.0), (3600, 1, 4.0)]
    write(2, [(1, "a", 8.0), (20000, "a", 1.0)])
    assert run() == [(0, 2, 3.0), (3600, 1, 4.0), (7200, 1, 1.0)]


def test_sessions(spark):
    e = spark.createDataFrame([(0, 1), (10, 1), (100, 1), (0, 2)], "s long, u long").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted(r.n for r in watch.sessions(e, "ts", "u", "30 seconds").collect()) == [1, 1, 2]
