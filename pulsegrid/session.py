"""Session factory and the few session-wide settings that results depend on."""

from __future__ import annotations

import gc
import os
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession

#: UTC makes timestamps comparable across engines.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(app: str = "pulsegrid", master: str | None = None, partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; on a cluster use the session that is there."""
    builder = SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
    builder = builder.master(master or f"local[{os.cpu_count()}]")
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", "8g")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Spark's own switch to drop what a query shuffled once the query has ended.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame, drop_shuffles: bool = False) -> DataFrame:
    """Checkpoint in the shared folder named by ``spark.checkpoint.dir``.

    Only where that setting is absent in local mode, as in tests, a folder is set here.  What
    was shuffled for it is of no more use then and is released, with ``drop_shuffles`` at once.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", "")
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="pulsegrid-checkpoint-"))
    before = spark.conf.get(_DROP_SHUFFLES, "false")
    spark.conf.set(_DROP_SHUFFLES, "true" if drop_shuffles else before)
    try:
        done = df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)
    del df  # or its own shuffles would be held
    _collect(spark)
    return done


def discard(*frames: DataFrame) -> None:
    """Delete the checkpoint files of frames that :func:`cut_lineage` gave, once nothing that is still to run reads them.

    What was checkpointed from them does not need them: a checkpoint is never made again.
    """
    for frame in frames:
        plan = frame._jdf.queryExecution().analyzed()
        if plan.getClass().getSimpleName() != "LogicalRDD":
            raise ValueError("only a frame as cut_lineage gave it has files of its own")
        file = plan.rdd().getCheckpointFile()
        if file.isDefined():
            path = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def _collect(spark: SparkSession) -> None:
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release(spark: SparkSession) -> None:
    """Let go of what no frame in use reads any more, the last step's shuffles among it.

    Spark's context cleaner drops the shuffle files of collected frames (checkpoint
    files go by :func:`discard`), but a driver with memory to spare may not collect for hours, and the
    last plan is held until the next one has run.  What is dropped may have held
    other frames, so there is a second round once the cleaner has had its time.
    """
    for _ in range(3):
        spark.range(1).count()
        _collect(spark)
        time.sleep(0.5)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
