from pulsegrid.streaming.ingest import deduplicated, read_feed, run_batches, windowed_counts

SCHEMA = "id long, occurred_at timestamp, source string, type string"


def test_stream_reads_each_row_once(spark, tmp_path):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(minutes=i % 7), "sf_fire_cad", "fire") for i in range(20)]
    feed = str(tmp_path / "feed")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(feed)
    spark.createDataFrame(rows[:5], SCHEMA).coalesce(1).write.mode("append").parquet(feed)
    seen = []
    stream = deduplicated(read_feed(spark, feed, SCHEMA), ["id"], overlap="30 minutes")
    query = run_batches(stream, lambda df, _: seen.extend(r.id for r in df.collect()), str(tmp_path / "check"))
    query.awaitTermination()
    assert sorted(seen) == list(range(20))
    again = run_batches(stream, lambda df, _: seen.extend(r.id for r in df.collect()), str(tmp_path / "check"))
    again.awaitTermination()
    assert sorted(seen) == list(range(20))


def test_windowed_counts(spark, tmp_path):
    from datetime import datetime

    rows = [(i, datetime(2024, 1, 1, 0, 10 * i), "sf_fire_cad", "fire") for i in range(6)]
    feed = str(tmp_path / "feed")
    spark.createDataFrame(rows, SCHEMA).write.parquet(feed)
    counts = windowed_counts(read_feed(spark, feed, SCHEMA), "30 minutes")
    query = counts.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.calls for r in spark.table("counts").collect()) == [3, 3]
