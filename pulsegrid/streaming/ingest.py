"""The feeds as streams: deduplicated observations, windowed counts, and upserts by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pulsegrid.operators.ingest import scrub

OVERLAP = "2 minutes"


def read_feed(spark: SparkSession, path: str, schema: str, files_a_batch: int = 16) -> DataFrame:
    """Parquet files as they land; offsets live in the checkpoint of the query that reads them."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def deduplicated(feed: DataFrame, key: list[str], time: str = "occurred_at", overlap: str = OVERLAP) -> DataFrame:
    """Rows repeated by overlapping polls once; state is dropped behind the watermark."""
    return feed.withWatermark(time, overlap).dropDuplicatesWithinWatermark(key)


def windowed_counts(feed: DataFrame, window: str, late: str = OVERLAP, time: str = "occurred_at") -> DataFrame:
    """Calls by window, source and type; late rows count as long as the watermark allows."""
    grouped = feed.withWatermark(time, late).groupBy(F.window(time, window), "source", "type").agg(F.count("*").alias("calls"))
    return grouped.select(F.col("window.start").alias("start"), "source", "type", "calls")


def run_batches(feed: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand every micro-batch of what is there to ``handle``; a batch that is run again has the same id."""
    return feed.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_cycle(feed: DataFrame, mapper: Callable[[DataFrame], DataFrame], out: str, rejected: str, checkpoint: str) -> StreamingQuery:
    """One cycle of a feed: map, take personal data out of the metadata, keep the first of each record, and write.

    What cannot be mapped goes to the folder ``rejected`` with its reason.  Each
    micro-batch writes folders of its own number, so a batch that is run again
    replaces what it wrote before.
    """

    def handle(batch: DataFrame, number: int) -> None:
        rows = mapper(batch).withColumn("metadata", scrub(F.col("metadata"))["kept"])
        first = rows.where("rejected is null").groupBy("source", "source_record_id").agg(F.min_by(F.struct(*[c for c in rows.columns if c not in ("source", "source_record_id")]), F.struct("fetched_us", "us")).alias("r"))
        first.select("source", "source_record_id", "r.*").write.mode("overwrite").parquet(f"{out}/batch={number}")
        rows.where("rejected is not null").write.mode("overwrite").parquet(f"{rejected}/batch={number}")

    return run_batches(feed, handle, checkpoint)
