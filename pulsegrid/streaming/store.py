"""A store of records that micro-batches are merged into: a log of what changed, read as the latest row of every record.

A batch writes one folder of its number to each log and reads only lower numbers,
so a batch that runs again replaces what it wrote and finds what it found before.
Rows that a batch leaves unchanged are not written again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pulsegrid.operators import registry
from pulsegrid.operators.ingest import scrub
from pulsegrid.operators.stored import CALL, COLUMNS, KEY, UNIT_SOURCES, merge_stored, merge_units
from pulsegrid.session import cut_lineage
from pulsegrid.streaming.ingest import read_feed

#: Folders that records are dealt into by key, so that a batch reads the folders of its records.
BUCKETS = 64
_LOGS = {
    "observations": CALL + ", outcome string, batch int, bucket int",
    "units": "designator string, agency string, kind string, first_us long, last_us long, sightings long, batch int",
    "quarantine": "source string, payload_hash string, reason string, first_us long, times long, batch int",
    "outcomes": "source string, outcome string, records long, batch int",
    "cursor": "source string, published_us long, batch int",
}


class ObservationStore:
    """Logs under ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _folders(self, log: str, prefix: str) -> list[int]:
        """Numbers of the finished folders ``prefix=N`` of a log; there is one a batch."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{log}")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath() for s in fs.listStatus(root)]
        done = [p.getName() for p in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(n.split("=")[1]) for n in done if n.startswith(f"{prefix}="))

    def read(self, log: str, before: int | None = None) -> DataFrame:
        """A log's rows of batches below ``before``; of observations, those of the last snapshot and since."""
        schema = _LOGS[log]
        since, frames = -1, []
        if log == "observations":
            snapshots = [n for n in self._folders("snapshots", "snapshot") if before is None or n < before]
            if snapshots:
                since = snapshots[-1]
                frames.append(self.spark.read.schema(schema.replace(", batch int", "")).parquet(f"{self.path}/snapshots/snapshot={since}").withColumn("batch", F.lit(since)))
        batches = [n for n in self._folders(log, "batch") if n > since and (before is None or n < before)]
        if batches:
            frames.append(self.spark.read.schema(schema).option("basePath", f"{self.path}/{log}").parquet(*[f"{self.path}/{log}/batch={n}" for n in batches]))
        if not frames:
            return self.spark.createDataFrame([], schema)
        out = frames[0]
        for frame in frames[1:]:
            out = out.unionByName(frame)
        return out

    def state(self, before: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """The latest row of every record, or of those of ``keys`` (``source, source_record_id, bucket``)."""
        rows = self.read("observations", before)
        if keys is not None:
            rows = rows.join(keys, [*KEY, "bucket"], "left_semi")
        rest = [c for c in COLUMNS if c not in KEY]
        return rows.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*KEY, "r.*").select(*COLUMNS)

    def units(self) -> DataFrame:
        return merge_units(self.read("units"), "batch")

    def cursor(self) -> dict[str, int]:
        """How far each source was read, by the batches that ended; a row a source."""
        return {r.source: r.at for r in self.read("cursor").groupBy("source").agg(F.max("published_us").alias("at")).collect()}

    def _write(self, rows: DataFrame, log: str, batch: int, *parts: str) -> None:
        rows.write.mode("overwrite").partitionBy(*parts).parquet(f"{self.path}/{log}/batch={batch}")

    def apply(self, rows: DataFrame, batch: int) -> None:
        """Merge mapped ``rows`` as batch number ``batch``; the cursor moves last, once all else is written."""
        rows = cut_lineage(rows, drop_shuffles=True)
        bucket = F.pmod(F.xxhash64(*KEY), F.lit(BUCKETS)).cast("int")
        good = rows.where("rejected is null")
        keys = good.select(*KEY).distinct().withColumn("bucket", bucket)
        merged = cut_lineage(merge_stored(self.state(batch, keys), good), drop_shuffles=True)
        self._write(merged.where("outcome in ('created', 'updated')").withColumn("bucket", bucket), "observations", batch, "bucket")
        seen = good.where(F.col("source").isin(*UNIT_SOURCES)).select("us", "source", F.explode("units").alias("unit"), F.col("unit_times"))
        seen = seen.select("us", "source", "unit", F.try_element_at("unit_times", F.col("unit"))["unit_type"].alias("unit_type"))
        self._write(registry.unit_registry(seen), "units", batch)
        bad = rows.where("rejected is not null").select("source", F.sha2(F.to_json(F.struct("source_record_id", "raw_type", "metadata")), 256).alias("payload_hash"), F.col("rejected").alias("reason"), F.col("fetched_us").alias("us"))
        self._write(registry.quarantine(bad), "quarantine", batch)
        self._write(merged.groupBy("source", "outcome").agg(F.count("*").alias("records")), "outcomes", batch)
        self._write(good.groupBy("source").agg(F.max("published_us").alias("published_us")), "cursor", batch)

    def work(self, batch: int) -> DataFrame:
        """``id, source, outcome`` of what a batch created or updated: what is to be normalized, and if updated correlated again."""
        return self.read("observations", batch + 1).where((F.col("batch") == batch) & F.col("outcome").isNotNull()).select("id", "source", "outcome")

    def compact(self, upto: int) -> None:
        """Write the state after batch ``upto`` as a snapshot that later reads start from; the logs stay."""
        bucket = F.pmod(F.xxhash64(*KEY), F.lit(BUCKETS)).cast("int")
        rows = self.state(upto + 1).withColumn("outcome", F.lit(None).cast("string")).withColumn("bucket", bucket)
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/snapshots/snapshot={upto}")


def ingest_into(feed: DataFrame, mapper: Callable[[DataFrame], DataFrame], store: ObservationStore, checkpoint: str, every_seconds: int | None = None) -> StreamingQuery:
    """Every micro-batch mapped, without personal data, and merged into the store; with no interval what is there, once."""

    def handle(batch: DataFrame, number: int) -> None:
        store.apply(mapper(batch).withColumn("metadata", scrub(F.col("metadata"))["kept"]), number)

    trigger = {"availableNow": True} if every_seconds is None else {"processingTime": f"{every_seconds} seconds"}
    return feed.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**trigger).start()


@dataclass(frozen=True)
class Source:
    """A feed's folder and mapper; it is polled every ``poll_seconds`` (none: once), and not at all if it is not enabled."""

    name: str
    path: str
    mapper: Callable[[DataFrame], DataFrame]
    poll_seconds: int | None = None
    enabled: bool = True
    files_a_batch: int = 16


def start_sources(spark: SparkSession, sources: Iterable[Source], folder: str) -> dict[str, StreamingQuery]:
    """One query and one store for every enabled source, under ``folder``."""
    started = {}
    for s in sources:
        if s.enabled:
            feed = read_feed(spark, s.path, "payload string, fetched_us long", s.files_a_batch)
            started[s.name] = ingest_into(feed, s.mapper, ObservationStore(spark, f"{folder}/{s.name}/store"), f"{folder}/{s.name}/checkpoint", s.poll_seconds)
    return started
