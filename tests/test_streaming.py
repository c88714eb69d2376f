from pyspark.sql import functions as F

from tamis.streaming import telemetry


def test_state_skips_late_logs(spark, tmp_path):
    path = str(tmp_path / "logs")
    spark.createDataFrame([(1, 10, 1.0), (1, 20, 3.0), (1, 15, 2.0), (2, 5, 1.0)], "part bigint, step bigint, seconds double").coalesce(1).write.parquet(path)
    got = telemetry.run_once(telemetry.log_deltas(telemetry.read_parquet_stream(spark, path)), "append").collect()
    assert sorted((r["part"], r["step"], r["d_step"], r["d_seconds"]) for r in got) == [(1, 15, 5, 1.0), (1, 20, 5, 1.0)]


def test_windows(spark, tmp_path):
    path = str(tmp_path / "events")
    spark.sql("SELECT timestamp'2026-01-01 00:10:00' + make_interval(0, 0, 0, 0, 0, id * 20) AS ts, 'a' AS k FROM range(6)").write.parquet(path)
    got = telemetry.run_once(telemetry.window_counts(telemetry.read_parquet_stream(spark, path), "ts", "k"), "complete").collect()
    assert sorted(r["n"] for r in got) == [3, 3]
    assert sorted(r["n"] for r in telemetry.run_once(telemetry.session_counts(telemetry.read_parquet_stream(spark, path), "ts", "k"), "complete").collect()) == [6]


def test_many_shuffled_logs_over_several_files(spark, tmp_path):
    path = str(tmp_path / "many")
    logs = spark.range(25_000).select(F.when(F.col("id") < 24_900, 1).otherwise(2).cast("bigint").alias("part"), F.col("id").alias("step"), (F.col("id") * 0.5).alias("seconds"))
    logs.orderBy(F.rand(3)).repartition(5).write.parquet(path)
    got = telemetry.run_once(telemetry.log_deltas(telemetry.read_parquet_stream(spark, path)), "append").collect()
    assert {(r["part"], r["step"]) for r in got} == {(1 if i < 24_900 else 2, i) for i in range(25_000) if i not in (0, 24_900)}
    assert len(got) == 24_998 and all((r["d_step"], r["d_seconds"]) == (1, 0.5) for r in got)
