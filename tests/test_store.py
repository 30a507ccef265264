"""The store of records and the stale sweep as streams: any cut of the feed gives what the whole gives."""

import json

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import lifecycle, stored
from pulsegrid.operators.range_join import MINUTE
from pulsegrid.sources import feeds
from pulsegrid.streaming.ingest import read_feed
from pulsegrid.streaming.stale import stale_stream
from pulsegrid.streaming.store import ObservationStore, Source, ingest_into, start_sources

FEED = "payload string, fetched_us long"
VOLATILE = ("fetched_us", "published_us")


def unit_row(call, unit, minute, fetched, **more):
    record = {"call_number": call, "unit_id": unit, "received_dttm": f"2024-01-01T00:{minute:02d}:00.000", "call_type": "Alarms", "unit_type": "ENGINE", "dispatch_dttm": f"2024-01-01T01:{minute:02d}:00.000", "data_loaded_at": f"2024-01-02T00:00:{fetched:02d}.000", "caller_phone": "x"}
    return json.dumps({k: v for k, v in (record | more).items() if v is not None}), fetched


ROWS = [
    unit_row("1", "E01", 5, 1), unit_row("2", "E07", 6, 2, call_type=None, address=None), unit_row("1", "T02", 3, 3, address="1 Main St", priority="2"), unit_row(None, "E03", 1, 4),
    unit_row("1", "E01", 5, 5), unit_row("3", "M3", 9, 6, unit_type="MEDIC"), unit_row("2", "B01", 2, 7, call_type="Fire", number_of_alarms="2"), unit_row("1", "E01", 5, 8, on_scene_dttm="2024-01-01T02:00:00.000"),
    unit_row("2", "E07", 6, 9), unit_row("4", None, 8, 10), ("no json", 11), unit_row("5", "E01", None or 9, 12, received_dttm=""), unit_row("3", "M3", 9, 13, unit_type="MEDIC"),
]


def plain(df):
    keep = [c for c in stored.COLUMNS if c not in VOLATILE]
    rows = []
    for r in df.select(*keep).collect():
        d = r.asDict(recursive=True)
        d["metadata"] = {k: v for k, v in (d["metadata"] or {}).items() if k not in ("data_as_of", "data_loaded_at")}
        rows.append(json.dumps(d, sort_keys=True, default=str))
    return sorted(rows)


def cut(rows, batches):
    size = -(-len(rows) // batches)
    return [rows[i : i + size] for i in range(0, len(rows), size)]


@pytest.mark.parametrize("batches", [1, 3, 13])
def test_any_cut_gives_the_same_store(spark, tmp_path, batches):
    whole = stored.fold_records(feeds.fire_observations(spark.createDataFrame(ROWS, FEED)).where("rejected is null").withColumn("metadata", F.map_filter("metadata", lambda k, v: k != "caller_phone")))
    feed, store = str(tmp_path / "feed"), ObservationStore(spark, str(tmp_path / "store"))
    for rows in cut(ROWS, batches):
        spark.createDataFrame(rows, FEED).coalesce(1).write.mode("append").parquet(feed)
        ingest_into(read_feed(spark, feed, FEED), feeds.fire_observations, store, str(tmp_path / "checkpoint")).awaitTermination()
    assert plain(store.state()) == plain(whole)
    assert {r.designator: (r.kind, r.sightings) for r in store.units().collect()}["E01"] == ("engine", 3)
    assert sum(r.times for r in store.read("quarantine").collect()) == 3
    assert set(store.cursor()) == {"sf_fire_cad", "sf_ems_cad"}


def test_repeated_batch_changes_nothing(spark, tmp_path):
    """Run again with its number a batch writes what it wrote; sent again as a new batch all is unchanged, and nothing is written."""
    store = ObservationStore(spark, str(tmp_path))
    rows = feeds.fire_observations(spark.createDataFrame(ROWS, FEED))
    store.apply(rows, 0)
    before = plain(store.state())
    assert {r.outcome for r in store.work(0).collect()} == {"created"}
    store.apply(rows, 0)
    assert plain(store.state()) == before
    store.apply(rows, 1)
    assert plain(store.state()) == before
    assert {r.outcome: r.records for r in store.read("outcomes").where("batch = 1").groupBy("outcome").agg(F.sum("records").alias("records")).collect()} == {"unchanged": 4}
    assert store.work(1).isEmpty()
    store.apply(feeds.fire_observations(spark.createDataFrame([unit_row("1", "Z9", 1, 50)], FEED)), 2)
    assert [(r.id, r.outcome) for r in store.work(2).collect()] == [("obs_sf_fire_cad_1", "updated")]
    changed = plain(store.state())
    store.compact(2)
    assert plain(store.state()) == changed
    store.apply(feeds.fire_observations(spark.createDataFrame([unit_row("1", "Z9", 1, 51)], FEED)), 3)
    assert store.work(3).isEmpty()
    assert plain(store.state()) == changed


def test_only_changed_records_are_written(spark, tmp_path):
    """A re-normalized range is applied as a batch of its own, which holds the changed records alone."""
    store = ObservationStore(spark, str(tmp_path))
    store.apply(feeds.fire_observations(spark.createDataFrame(ROWS, FEED)), 0)
    again = feeds.fire_observations(spark.createDataFrame([unit_row("2", "E07", 6, 60, number_of_alarms="3"), unit_row("3", "M3", 9, 61, unit_type="MEDIC")], FEED))
    store.apply(again, 1)
    assert [r.source_record_id for r in store.read("observations").where("batch = 1").collect()] == ["2"]


def test_enabled_sources_run(spark, tmp_path):
    spark.createDataFrame(ROWS, FEED).write.parquet(str(tmp_path / "in"))
    started = start_sources(spark, [Source("fire", str(tmp_path / "in"), feeds.fire_observations), Source("off", "nowhere", feeds.fire_observations, enabled=False)], str(tmp_path / "out"))
    assert set(started) == {"fire"}
    started["fire"].awaitTermination()
    assert ObservationStore(spark, str(tmp_path / "out/fire/store")).state().count() == 4


def test_merge_of_nothing(spark):
    none = spark.createDataFrame([], stored.CALL)
    assert stored.merge_stored(none, none).isEmpty()
    some = stored.fold_records(feeds.fire_observations(spark.createDataFrame(ROWS, FEED)).where("rejected is null"))
    assert {r.outcome for r in stored.merge_stored(some, none).collect()} == {"untouched"}
    assert {r.outcome for r in stored.merge_stored(none, some).collect()} == {"created"}


CALLS = "incident_id string, us long, id long, type string, closed boolean"


@pytest.mark.parametrize("batches", [1, 4, 9])
def test_stale_stream_equals_transitions(spark, tmp_path, batches):
    """Timers by type, calls that make an incident active again, closed ones, nulls, and calls out of order within the watermark's delay."""
    at = lambda m: (m + 10_000) * MINUTE
    rows = [("a", at(0), 1, "medical", False), ("b", at(1), 2, None, False), ("c", at(2), 3, "fire", False), ("a", at(30), 4, "unknown", False), ("b", at(29), 5, "collision", False), ("d", at(31), 6, "theft", True), ("a", at(95), 7, "theft", None),
            ("c", at(94), 8, "fire", False), ("b", at(150), 9, "theft", False), (None, at(151), 10, "x", False), ("e", at(300), 11, "hazard", False), ("a", at(301), 12, "theft", True), ("d", at(302), 13, "theft", False)]
    end = ("tick", at(2000), 99, "theft", False)
    feed = str(tmp_path / "feed")
    query = None
    for some in [*cut(rows, batches), [end], [("tick", at(2001), 100, "theft", False)]]:
        spark.createDataFrame(some, CALLS).coalesce(1).write.mode("append").parquet(feed)
        stream = stale_stream(read_feed(spark, feed, CALLS))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
    found = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).where("incident_id <> 'tick'").collect())
    df = spark.createDataFrame([r for r in rows if r[0]], CALLS).withColumn("closed", F.coalesce("closed", F.lit(False))).withColumn("type", F.coalesce("type", F.lit("unknown")))
    want = sorted(tuple(r) for r in lifecycle.stale_transitions(df, at(1900)).collect())
    assert found == want
    assert len(want) == 6
    # at every step of the clock, what has fallen silent and not been called since is what a sweep finds
    for clock in (at(100), at(200), at(260), at(400), at(700)):
        last = df.where(F.col("us") <= clock).groupBy("incident_id").agg(F.max("us").alias("us"), F.max("closed").alias("closed"), F.coalesce(F.min_by("type", F.when(F.col("type") != "unknown", F.struct("us", "id"))), F.lit("unknown")).alias("type"))
        swept = last.select("incident_id", lifecycle.stale(F.when(F.col("closed"), "resolved").otherwise("active"), F.col("type"), F.col("us"), F.lit(clock)).alias("s")).where("s = 'unknown'")
        said = {r[0] for r in found if r[2] <= clock and not any(x[0] == r[0] and r[1] < x[1] <= clock for x in rows)}
        assert {r.incident_id for r in swept.collect()} == said


def test_rows_of_records_are_shuffled_once(spark):
    """Whatever is folded of a record is folded from one shuffle of its rows, which no reader narrows for itself."""
    done = stored.fold_records(feeds.fire_observations(spark.createDataFrame(ROWS, FEED)).where("rejected is null"))
    assert "ENSURE_REQUIREMENTS" not in done._jdf.queryExecution().executedPlan().toString()
    assert len(done.collect()) == 4
    final = done._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(set(map(str.strip, (x for x in final.splitlines() if "Exchange hashpartitioning" in x and "Reused" not in x)))) == 1
