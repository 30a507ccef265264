"""Gazetteer loads, the gate, digests and checks by hand cases."""

from pyspark.sql import functions as F

from pulsegrid.operators import reporting
from pulsegrid.sources import gazetteer
from pulsegrid.plans.feeds import VOCABULARY


def test_areas_and_segments_that_cannot_be_read(spark):
    rows = ['{"nhood":"A","the_geom":{"type":"Polygon","coordinates":[[[0,1],[2,1],[2,3],[0,3]],[[1,1],[1,2],[2,2]]]}}', '{"nhood":"B"}', "no json", '{"nhood":"","the_geom":{"type":"Polygon","coordinates":[]}}', '{"nhood":"C","the_geom":{"type":"Polygon","coordinates":[]}}', None]
    df = spark.createDataFrame([(r,) for r in rows], "payload string")
    found = gazetteer.areas(df).collect()
    assert [(r.name, r.south, r.north, r.west, r.east, len(r.geometry), len(r.geometry[0])) for r in found] == [("A", 1.0, 3.0, 0.0, 2.0, 1, 2)]
    assert gazetteer.segments(df, VOCABULARY).isEmpty()


def test_corner_ties_and_nulls(spark):
    name = "1ST ST \\ MISSION ST"
    rows = [(name, 2.0, 5.0), (name, 1.0, 5.0), (None, 1.0, 5.0), (name, None, 5.0), ("Not Available", 1.0, 1.0)]
    found = gazetteer.corners(spark.createDataFrame(rows, "intersection_name string, lat double, lng double"), VOCABULARY).collect()
    assert [(r.canonical, r.lat, r.records) for r in found] == [("1st St & Mission St", 1.0, 1)]


def test_load_replaces_by_key(spark):
    schema = "k string, v long"
    stored, new = spark.createDataFrame([("a", 1), ("b", 2)], schema), spark.createDataFrame([("b", 3), ("b", 9), ("c", 4)], schema)
    assert sorted(tuple(r) for r in gazetteer.loaded(stored, new, "k", "v").collect()) == [("a", 1), ("b", 9), ("c", 4)]


def test_gate(spark):
    hour = reporting.HOUR
    calls = spark.createDataFrame([(i, "s", str(i), i * hour, "fire") for i in range(80)], "id long, source string, source_record_id string, us long, type string")
    kept = spark.createDataFrame([("s", str(i), "h") for i in range(80)], "source string, source_record_id string, payload_hash string")
    ask = lambda *a: [(r.passes, r.reasons) for r in reporting.data_gate(*a).collect()]
    assert ask(calls, kept, 0, 80 * hour) == [(True, [])]
    assert ask(calls, kept, 2, 90 * hour) == [(False, ["behind", "lost gaps"])]
    assert ask(calls.limit(0), kept.limit(0), 0, 0) == [(False, ["coverage", "no observations"])]
    assert ask(calls.withColumn("type", F.lit(None).cast("string")), kept, 0, 80 * hour) == [(False, ["nothing typed"])]


def test_windows_and_box():
    assert reporting.window_start("1h", 10**12) == 10**12 - reporting.HOUR
    assert reporting.window_start("all", 5) is reporting.window_start("soon", 5) is reporting.window_start(None, 5) is None


def test_digest_of_a_quiet_area(spark):
    incidents = spark.createDataFrame([("i", "A", 5, 5, "fire", None, "active", ["fire"], ["E1"]), ("j", "A", 5, 5, "fire", "low", "resolved", ["fire"], []), ("k", None, 5, 5, "fire", None, "active", [], [])],
        "incident_id string, neighborhood string, first_us long, last_us long, primary_type string, severity string, status string, agencies array<string>, units array<string>")
    areas = spark.createDataFrame([("A",), ("B",)], "neighborhood string")
    found = {r.neighborhood: (r.incidents, r.open, r.latest, r.gravest, r.by_type, r.by_agency) for r in reporting.activity_digest(incidents, areas, 0, 10).collect()}
    assert found == {"A": (2, 1, "i", "j", "fire=2", "fire=2"), "B": (0, 0, None, None, "", "")}


def test_a_record_is_read_once(spark):
    """Neither a filter nor the fields make a record's JSON be parsed again."""
    from pulsegrid.plans import catalogue

    for name, most in {"quarantined": 1, "feed_fire_calls": 1, "historical_range": 4}.items():  # the archive is read for what it takes and for what it refuses, by two schemas each
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json") <= most, name
