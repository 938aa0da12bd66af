from tabscope.operators import profile
from tabscope.sources import readers
from tabscope.sources.shared import fresh_path
from tabscope.streaming import running


def batches(spark, path, parts):
    for low, high in parts:
        spark.range(low, high).selectExpr("CAST(id AS DOUBLE) AS x", "CAST(id % 3 AS STRING) AS k").coalesce(
            1
        ).write.mode("append").parquet(path)


def test_running_profile_equals_the_batch_profile(spark):
    path, out = fresh_path(spark, "in"), fresh_path(spark, "out")
    batches(spark, path, [(0, 10), (10, 50)])
    stream = spark.readStream.schema("x double, k string").option("maxFilesPerTrigger", 1).parquet(path)
    result = running.stream_profile(stream, points=(0.5,))
    running.start_running(result, out).awaitTermination()
    row = running.read_running(result, out).first()
    want = profile.profile_numeric(spark.read.parquet(path)).first()
    assert row["finite_count"] == want["finite_count"] and row["mean"] == want["mean"]
    assert abs(row["standard_deviation"] - want["standard_deviation"]) < 1e-9
    assert row["total_squares"] == sum(i * i for i in range(50)) and row["quantiles"] == [24.0]

    # The query goes on where it stopped.
    batches(spark, path, [(50, 60)])
    running.start_running(result, out).awaitTermination()
    assert running.read_running(result, out).first()["finite_count"] == 60


def test_json_lines_arrive_in_batches(spark):
    path = fresh_path(spark, "lines")
    spark.range(30).selectExpr("id % 2 AS k").repartition(3).write.json(path)
    stream = readers.stream_json_lines(spark, path, "k bigint", files_per_batch=1)
    final = running.run_to_end(running.stream_value_counts(stream, "k"), "lines")
    assert {r["k"]: r["count"] for r in final.collect()} == {0: 15, 1: 15}


def test_running_counts(spark):
    path = fresh_path(spark, "in")
    batches(spark, path, [(0, 10), (10, 50)])
    stream = spark.readStream.schema("x double, k string").parquet(path)
    final = running.run_to_end(running.stream_value_counts(stream, "k"), "counts")
    assert {r["k"]: r["count"] for r in final.collect()} == {"0": 17, "1": 17, "2": 16}


def test_batches_write_what_they_change(spark):
    path, out = fresh_path(spark, "in"), fresh_path(spark, "out")
    batches(spark, path, [(0, 3), (3, 6), (0, 1)])
    stream = spark.readStream.schema("x double, k string").option("maxFilesPerTrigger", 1).parquet(path)
    result = running.stream_value_counts(stream, "k")

    def counts():
        return {r["k"]: r["count"] for r in running.read_changes(result, "k", out).collect()}

    running.start_changes(result, out).awaitTermination()
    assert counts() == {"0": 3, "1": 2, "2": 2}
    changed = spark.read.parquet(f"{out}/changes").groupBy("batch").count().collect()
    assert sorted(r["count"] for r in changed) == [1, 3, 3]

    # Merged, the changes are gone and nothing else is different; a batch that runs again changes nothing.
    running.merge_changes(result, "k", out)
    running.merge_changes(result, "k", out)
    assert counts() == {"0": 3, "1": 2, "2": 2} and running._folders(spark, f"{out}/changes") == []
    batches(spark, path, [(7, 8)])
    running.start_changes(result, out).awaitTermination()
    assert counts() == {"0": 3, "1": 3, "2": 2}
    newest = spark.read.parquet(f"{out}/changes")
    assert [tuple(r) for r in newest.select("k", "count").collect()] == [("1", 3)]
    newest.drop("batch").write.mode("overwrite").parquet(f"{out}/changes-again")
    number = newest.first()["batch"]
    spark.read.parquet(f"{out}/changes-again").write.mode("overwrite").parquet(f"{out}/changes/batch={number}")
    assert counts() == {"0": 3, "1": 3, "2": 2}
    running.merge_changes(result, "k", out)
    assert counts() == {"0": 3, "1": 3, "2": 2} and len(running._folders(spark, f"{out}/merged")) == 1
