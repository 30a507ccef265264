"""Feeds, locations, geocoding, questions, timelines and evaluation on small cases written out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import locations, times
from pulsegrid.operators import evaluation, geocode, ingest, questions, ranking, registry, taxonomy, timeline
from pulsegrid.sources import feeds
from pulsegrid.streaming import ingest as streams

SUFFIXES = {name: "St" for name in ("IRVING", "MISSION", "CLEMENT", "MARKET", "ELLIS", "HYDE")}
WORDS = locations.Vocabulary(SUFFIXES, frozenset(f"{n}TH" for n in range(4, 49)), frozenset(("IRVING", "CLEMENT")))


def values(spark, kind, rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"id int, x {kind}")


def test_locations(spark):
    cases = {
        "19TH AV/IRVING ST": ("intersection", "19th Ave & Irving St", 0.95), "19th and Irving": ("intersection", "19th Ave & Irving St", 0.95),
        "IRVING / 19TH": ("intersection", "19th Ave & Irving St", 0.95), "MISSION ST AT 24TH ST": ("intersection", "24th St & Mission St", 0.95),
        "19th and Mission": ("intersection", "19th St & Mission St", 0.95), "MISSION ST \\ 03RD ST": ("intersection", "3rd St & Mission St", 0.95),
        "ELLIS ST \\ HYDE ST": ("intersection", "Ellis St & Hyde St", 0.95), "ARMY ST \\ MISSION ST": ("intersection", "Cesar Chavez St & Mission St", 0.95),
        "12TH ST/MISSION ST/OTIS ST/SOUTH VAN NESS AVE": ("intersection", "12th St & Mission St & Otis St & South Van Ness Ave", 0.8),
        "2300 BLOCK OF MISSION ST": ("block", "2300 block of Mission St", 0.9), "1234 MARKET ST": ("address", "1234 Market St", 0.9),
        "CALL BOX: 199 13TH ST,SF": ("address", "199 13th St", 0.8), "CALL BOX: ST LUKES HOSPITAL": ("landmark", "St Lukes Hospital", 0.4),
        "S VAN NESS AVE": ("block", "South Van Ness Ave", 0.4), "OSHAUGHNESSY BLVD": ("block", "O'Shaughnessy Blvd", 0.4), "Not Available": ("unknown", "", 0.0),
        "???": ("unknown", "", 0.0), "zzzz": ("unknown", "", 0.0), "": ("unknown", "", 0.0), "N/A": ("unknown", "", 0.0), "FERRY TERMINAL": ("landmark", "Ferry Terminal", 0.5),
    }
    rows = values(spark, "string", [*cases, None]).select("id", locations.normalize_location(F.col("x"), WORDS).alias("p")).orderBy("id").collect()
    got = [(r.p.kind, r.p.canonical, round(r.p.confidence, 6)) for r in rows]
    assert got == [*cases.values(), ("unknown", "", 0.0)]
    once = [c for k, c, _ in cases.values() if k in ("intersection", "address")]
    again = values(spark, "string", once).select("id", locations.normalize_location(F.col("x"), WORDS)["canonical"].alias("c")).orderBy("id").collect()
    assert [r.c for r in again] == once
    names = values(spark, "string", ["19TH", "06TH ST", "THIRD ST", "SHAW ALY", "MCALLISTER ST", "THE EMBARCADERO", " "])
    assert [r.s for r in names.select("id", locations.street_name(F.col("x"), WORDS).alias("s")).orderBy("id").collect()] == ["19th", "6th St", "3rd St", "Shaw Aly", "McAllister St", "The Embarcadero", None]


def test_local_times_around_the_clock_changes(spark):
    said = ["2024-01-05T12:00:00.000", "2024-07-05 12:00:00", "2024-03-10T02:30:00", "2024-11-03T01:30:00", "2024-07-05T12:00:00Z", "soon", None, ""]
    utc = ["2024-01-05T20:00:00", "2024-07-05T19:00:00", "2024-03-10T09:30:00", "2024-11-03T08:30:00", "2024-07-05T12:00:00", None, None, None]
    rows = values(spark, "string", said).select("id", F.date_format(F.timestamp_micros(times.parse_local(F.col("x"))), "yyyy-MM-dd'T'HH:mm:ss").alias("t")).orderBy("id").collect()
    assert [r.t for r in rows] == utc


def test_units(spark):
    cases = [("E07A", None, None), ("3A12", None, None), ("3A12", None, "sf_fire_cad"), ("3A123", None, None), ("M18", "Rescue Captain", None), ("T-04", None, None), ("ZZ", None, None), ("--", None, None)]
    want = [("E07A", "fire", "engine", 7), ("3A12", "police", "patrol", 12), ("3A12", "other", "unknown", None), ("3A123", "other", "unknown", None), ("M18", "ems", "rescue", 18), ("T04", "fire", "truck", 4), ("ZZ", "other", "unknown", None), ("", "other", "unknown", None)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "id int, u string, t string, s string")
    assert [tuple(r.p) for r in rows.select("id", ingest.parse_unit(F.col("u"), F.col("t"), F.col("s")).alias("p")).orderBy("id").collect()] == want


def test_feeds_keep_what_they_cannot_map(spark):
    sent = [
        {"cad_number": " 17 ", "received_datetime": "2026-01-05T04:00:00.000", "call_type_final": "416", "intersection_point": {"coordinates": [-122.4, 37.7]}, "sensitive_call": True, "disposition": ""},
        {"id": "x1", "received_datetime": "2026-01-05T04:00:00.000", "intersection_point": {"coordinates": [-122.4]}}, {"received_datetime": "2026-01-05T04:00:00.000"}, {"id": "x2"},
    ]
    feed = spark.createDataFrame([(json.dumps(s), 1) for s in sent] + [(None, 1)], "payload string, fetched_us long")
    rows = feeds.police_observations(feed).collect()
    assert sorted(r.rejected or "" for r in rows) == ["", "", "no JSON record", "received_datetime missing or unparseable", "record has neither cad_number nor id"]
    first = next(r for r in rows if r.source_record_id == "17")
    assert (first.id, first.lat, first.lng, first.sensitive, first.metadata) == ("obs_sf_police_cad_17", 37.7, -122.4, True, {"cad_number": " 17 ", "call_type_final": "416"})
    assert next(r for r in rows if r.source_record_id == "x1").lat is None
    fire = [{"call_number": "1", "unit_id": u, "received_dttm": f"2026-01-05T04:0{m}:00.000", "call_type": "Alarms", "on_scene_dttm": s} for u, m, s in (("T2", 3, "b"), ("E1", 1, "a"), ("E1", 2, "c"))]
    rows = feeds.fire_observations(spark.createDataFrame([(json.dumps(f), i) for i, f in enumerate(fire)], "payload string, fetched_us long"))
    call = feeds.merge_unit_rows(rows).collect()
    assert len(call) == 1 and call[0].units == ["E1", "T2"] and call[0].metadata["unit_count"] == "2" and call[0].unit_times["E1"].on_scene == "c" and call[0].metadata["on_scene_dttm"] == "c"
    assert feeds.police_observations(feed.limit(0)).count() == 0


def test_a_feed_streams_into_a_table(spark, tmp_path):
    sent = [{"cad_number": str(i % 5), "received_datetime": "2026-01-05T04:00:00.000", "officer_name": "x"} for i in range(10)] + [{"id": ""}]
    spark.createDataFrame([(json.dumps(s), i) for i, s in enumerate(sent)], "payload string, fetched_us long").write.parquet(str(tmp_path / "in"))
    feed = streams.read_feed(spark, str(tmp_path / "in"), "payload string, fetched_us long")
    query = streams.ingest_cycle(feed, feeds.police_observations, str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / "state"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5 and spark.read.parquet(str(tmp_path / "bad")).count() == 1


def test_geocoding(spark):
    line = [(37.0, -122.0), (37.0, -122.01), (37.0, -122.03)]
    at = lambda f: geocode.point_along(F.col("l"), F.lit(f))
    rows = spark.createDataFrame([(line,), ([(1.0, 2.0)],), ([],)], "l array<struct<lat:double,lng:double>>").select(at(0.0).alias("a"), at(0.5).alias("b"), at(2.0).alias("c")).collect()
    assert rows[0].b.lng == pytest.approx(-122.015) and rows[0].a.lng == -122.0 and rows[0].c.lng == pytest.approx(-122.03) and rows[1].b.lat == 1.0 and rows[2].b is None
    square = lambda a, b, c, d: [(a, b), (a, d), (c, d), (c, b)]
    hole, apart = [[square(0, 0, 10, 10), square(4, 4, 6, 6)]], [[square(20, 20, 21, 21)], [square(30.0, 30.0, 31.0, 31.0)]]
    areas = spark.createDataFrame([("a", 0, [[[(float(x), float(y)) for x, y in ring] for ring in p] for p in g]) if n == "a" else (n, 1, [[[(float(x), float(y)) for x, y in ring] for ring in p] for p in g]) for n, g in (("a", hole), ("b", apart))], "name string, position int, geometry array<array<array<struct<lat:double,lng:double>>>>")
    points = spark.createDataFrame([(0, 1.0, 1.0), (1, 5.0, 5.0), (2, 30.5, 30.5), (3, 25.0, 25.0), (4, None, 1.0)], "id int, lat double, lng double")
    assert {r.id: r.area for r in geocode.area_of_points(points, areas).collect()} == {0: "a", 2: "b"}


def test_taxonomy_files(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"version": "1", "source": "s", "mappings": [{"rawCode": "1a", "normalizedType": "fire", "typeConfidence": 0.9}, {"rawLabelPattern": "smoke|burn", "normalizedType": "hazard", "typeConfidence": 0.5}]}, indent=1))
    rules = taxonomy.read_taxonomy(spark, str(tmp_path))
    rows = spark.createDataFrame([("s", "1A", None), ("s", "2", "Burning"), ("t", "1A", "smoke"), ("s", None, None)], "source string, raw_type string, subtype string")
    assert sorted((r.type, r.matched_by, r.type_confidence) for r in taxonomy.classify(rows, rules).collect()) == [("fire", "code", 0.9), ("hazard", "pattern", 0.5), ("unknown", "unmapped", 0.2), ("unknown", "unmapped", 0.2)]


def test_questions(spark):
    asked = ["How many car break-ins in the Mission today?", "anything happening near SOMA?", "is it safe in the tenderloin", "stabbings over the last two days in Outer Sunset", "", None]
    rows = values(spark, "string", asked).select("id", questions.parse(F.col("x")).alias("q")).orderBy("id").collect()
    told = [(r.q.intent, r.q.area, r.q.minutes, r.q.category, r.q.unresolved) for r in rows[:5]]
    assert told == [
        ("count", "Mission", 1440, "car break-ins", []), ("highlight", "South of Market", 180, None, []), ("list", "Tenderloin", 180, None, ["safe"]),
        ("list", "Sunset/Parkside", 2880, "stabbings", []), ("list", None, 180, None, []),
    ]
    assert rows[2].q.unanswerable == "calls to dispatch do not measure how safe a place is"


def test_timeline_of_two_agencies(spark):
    rows = [("i", "b", 2, "sf_ems_cad", "medical", "high", ["M18"], None), ("i", "a", 1, "sf_police_cad", "unknown", None, ["3A12"], "Hyde St"), ("i", "c", 3, "sf_ems_cad", "fire", "low", ["M18"], None)]
    members = spark.createDataFrame(rows, "incident_id string, observation_id string, us long, source string, type string, severity string, units array<string>, location string")
    got = [(r.observation_id, r.kind, r.text) for r in timeline.timeline(members).orderBy("us", "kind").collect()]
    assert got == [
        ("a", "initial_report", "Unknown reported at Hyde St — first report from Police."), ("a", "unit_dispatched", "Police dispatched 3A12."), ("b", "additional_unit", "EMS added M18."),
        ("b", "agency_joined", "EMS joined the response."), ("b", "escalation", "Severity assessed as high."), ("b", "type_changed", "Type changed from Unknown to Medical."),
    ]


def test_evaluation_and_ranks(spark):
    rows = spark.createDataFrame([("x", "same", 1, 1), ("x", "same", 2, 1), ("y", "same", 1, 1), ("y", "same", 2, 2), ("z", "different", 1, 1), ("z", "different", 2, 1)], "case string, label string, observation int, incident int")
    m = evaluation.metrics(evaluation.case_outcomes(rows)).first()
    assert (m.cases, m.cases_correct, m.precision, m.recall, m.f1, m.false_merges, m.missed_merges, m.split_cases) == (3, 1, 0.5, 0.5, 0.5, 1, 1, 1)
    none = evaluation.metrics(evaluation.case_outcomes(rows.limit(0))).first()
    assert (none.cases, none.precision, none.recall) == (0, 1.0, 1.0)
    moved = spark.createDataFrame([("probable", 2.5, 0.9), ("probable", 1.0, 0.9), ("probable", 2.5, 0.5), ("merged", 0.0, 0.9), ("probable", None, 0.9)], "d string, l double, c double")
    assert [r.m for r in moved.select(ranking.judged(F.col("d"), F.col("l"), F.col("c")).alias("m")).collect()] == ["merged", "created", "probable", "merged", "probable"]
    same = spark.sql("select map('a', '1', 'data_as_of', 'x') a, map('a', '1') b, cast(null as map<string,string>) n").select(registry.same_metadata(F.col("a"), F.col("b")).alias("s"), registry.same_metadata(F.col("a"), F.col("n")).alias("t")).first()
    assert (same.s, same.t) == (True, False)
