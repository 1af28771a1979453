from siftwork.operators import features
from siftwork.streaming import label_counts, windowed_counts

EVENTS = "/root/testdata/sf0.001"


def test_streamed_counts_equal_batch_counts(spark, tmp_path):
    batch = spark.read.parquet(f"{EVENTS}/events.parquet").selectExpr("user_id AS construct_id", "event_type AS label", "cast(ts AS timestamp) AS ts")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = label_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(spark.table("counts").collect()) == sorted(features.label_counts(batch).collect())
    run = windowed_counts(stream, "ts", late="10000 days").writeStream.outputMode("update").format("memory").queryName("windows").trigger(availableNow=True).start()
    run.awaitTermination(120)
    last = spark.sql("SELECT start, feature, max(value) AS value FROM windows GROUP BY ALL")
    assert last.agg({"value": "sum"}).first()[0] == batch.count()
