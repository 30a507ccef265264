"""Operators on small cases that can be checked by hand or brute force."""

import random

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions.geo import box_of, haversine_meters, in_polygon
from pulsegrid.operators import fold, ingest, lifecycle, scoring
from pulsegrid.operators.components import connected_components
from pulsegrid.operators.range_join import MINUTE, near_in_place_and_time, near_in_time
from pulsegrid.operators.search import tokens
from pulsegrid.plans.analytics import conditions

OBS = "id long, us long, source string, type string, raw_type string, lat double, lng double, neighborhood string, units array<string>"


def fold_of(spark, rows):
    return {r.observation_id: r for r in fold.correlate(spark.createDataFrame(rows, OBS)).collect()}


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(None, 1), (7, 7)]
    parent = {x: x for e in edges for x in e if None not in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_range_joins_equal_brute_force(spark):
    r = random.Random(2)
    rows = [(i, r.randrange(0, 200) * MINUTE, 37.7 + r.random() * 0.02 if r.random() < 0.9 else None, -122.4 + r.random() * 0.02, r.choice("ab")) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, us long, lat double, lng double, area string")
    got = {(x.id, x.o_id) for x in near_in_time(df, df, 25 * MINUTE, 15 * MINUTE, ("area",)).collect()}
    assert got == {(a[0], b[0]) for a in rows for b in rows if a[4] == b[4] and a[1] - 25 * MINUTE <= b[1] <= a[1] + 15 * MINUTE}
    every = df.crossJoin(df.select(*[F.col(c).alias(f"o_{c}") for c in df.columns]))
    every = every.where(haversine_meters(F.col("lat"), F.col("lng"), F.col("o_lat"), F.col("o_lng")) <= 400).where(f"o_us between us - {25 * MINUTE} and us + {15 * MINUTE}")
    met = near_in_place_and_time(df, df, 400.0, 25 * MINUTE, 15 * MINUTE)
    assert sorted((x.id, x.o_id) for x in met.collect()) == sorted((x.id, x.o_id) for x in every.collect())
    assert "NestedLoop" not in met._jdf.queryExecution().executedPlan().toString()


def test_polygon_with_hole(spark):
    square = lambda lo, hi: F.array(*[F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lng")) for a, b in ((lo, lo), (lo, hi), (hi, hi), (hi, lo))])
    rings = F.array(square(0.0, 10.0), square(4.0, 6.0))
    rows = spark.createDataFrame([(1.0, 1.0), (5.0, 5.0), (11.0, 1.0), (None, 1.0)], "lat double, lng double")
    got = [x.i for x in rows.select(in_polygon(rings, F.col("lat"), F.col("lng")).alias("i")).collect()]
    assert got == [True, False, False, False]
    assert tuple(rows.select(box_of(rings).alias("b")).first().b) == (0.0, 10.0, 0.0, 10.0)


def test_police_and_ems_are_one_incident(spark):
    got = fold_of(spark, [
        (1, 0, "sf_police_cad", "collision", "518", 37.78, -122.41, None, ["3A12"]),
        (2, 4 * MINUTE, "sf_ems_cad", "medical", "M", 37.78, -122.41, None, ["M18"]),
    ])
    assert got[2].incident_id == 1 and got[2].decision == "merged"
    assert got[2].agencies == ["ems", "police"] and got[2].units == ["3A12", "M18"]


def test_contradicting_types_are_only_probable(spark):
    got = fold_of(spark, [
        (1, 0, "sf_police_cad", "collision", "518", 37.78, -122.41, None, []),
        (2, 0, "sf_police_cad", "theft", "488", 37.78, -122.41, None, []),
        (3, 300 * MINUTE, "sf_police_cad", "theft", "488", 37.78, -122.41, None, []),
        (4, 0, "sf_police_cad", "theft", "488", None, None, None, []),
    ])
    assert (got[2].decision, got[2].incident_id, got[2].probable_incident_id) == ("probable", 2, 1)
    assert got[3].decision == "created" and got[4].decision == "created"


def test_components_fold_as_one_sequence(spark):
    r = random.Random(5)
    rows = []
    for i in range(200):
        located = r.random() < 0.8
        lat = 37.7 + r.randrange(4) * 0.002 if located else None
        rows.append((i, r.randrange(90) * MINUTE, r.choice(["sf_police_cad", "sf_ems_cad"]), r.choice(["collision", "medical", "unknown"]), "x", lat, -122.4 if located else None, r.choice(["A", "B", None]), r.sample(["M1", "M2"], 1)))
    import pandas as pd

    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in OBS.split(", ")]).sort_values(["us", "id"]).assign(component=0)
    whole = pd.concat(fold.Fold().run(frame.iloc[k : k + 30] for k in range(0, len(frame), 30)))
    got = fold_of(spark, rows)
    assert {x.observation_id: (x.incident_id, x.decision) for x in whole.itertuples()} == {k: (v.incident_id, v.decision) for k, v in got.items()}


def test_correlation_links_runs_of_points_and_slots_of_areas(spark, monkeypatch):
    import pandas as pd

    r = random.Random(8)
    rows = []
    for i in range(900):
        located = r.random() < 0.8
        lat = 37.7 + r.randrange(2) * 0.002 if located else None
        us = 355 * MINUTE + i * 2 * MINUTE // 3  # a slot begins within
        rows.append((i, us, r.choice(["sf_police_cad", "sf_ems_cad"]), r.choice(["collision", "medical", "theft", "unknown", None]), "x", lat, -122.4 if located else None, r.choice(["A", "B", None]), r.sample(["M1", "M2"], 1)))
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in OBS.split(", ")]).sort_values(["us", "id"]).assign(component=0)
    whole = pd.concat(fold.Fold().run(iter([frame])))
    links = []
    monkeypatch.setattr(fold, "connected_components", lambda edges: links.append(edges.count()) or connected_components(edges))
    got = fold_of(spark, rows)
    score = lambda v: None if v is None or v != v else round(v, 9)
    of = lambda x: (x.incident_id, x.decision, score(x.score), None if pd.isna(x.probable_incident_id) else x.probable_incident_id, list(x.agencies), list(x.units), x.primary_type)
    assert {x.observation_id: of(x) for x in whole.itertuples()} == {k: of(v) for k, v in got.items()}
    assert links[0] < 50 and fold.AREA_MOST < scoring.MERGE


def test_weights():
    assert scoring.weights_are_valid(scoring.WEIGHTS) and not scoring.weights_are_valid({"a": 0.5})


def test_payload_hash_ignores_order_and_volatile_fields(spark):
    rows = spark.createDataFrame([({"a": "1", "b": "2", "data_as_of": "x"},), ({"b": "2", "a": "1"},), ({"a": "1", "b": "3"},)], "m map<string,string>")
    a, b, c = (x.h for x in rows.select(ingest.payload_hash(F.col("m")).alias("h")).collect())
    assert a == b != c


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", "p", 1), (2, "a", "p", 1), (3, "a", "p", 1)], "id int, x string, keep string, made int")
    new = spark.createDataFrame([(1, "a", None, 9), (2, "b", "q", 9), (4, "c", None, 9)], "id int, x string, keep string, made int")
    got = {r.id: tuple(r)[1:] for r in ingest.upsert(old, new, "id", ["x"], ["keep"], ["made"]).collect()}
    assert got == {1: ("a", "p", 1, "unchanged"), 2: ("b", "q", 1, "updated"), 3: ("a", "p", 1, "untouched"), 4: ("c", None, 9, "created")}


@pytest.mark.parametrize("now, signalled, then", [("active", "dispatched", "active"), ("reported", "resolved", "resolved"), ("active", "unknown", "active"), ("unknown", "reported", "reported")])
def test_status_only_moves_ahead(spark, now, signalled, then):
    assert spark.range(1).select(lifecycle.next_status(F.lit(now), F.lit(signalled)).alias("s")).first().s == then


def test_codes_take_the_place_of_types(spark):
    rows = spark.createDataFrame([("sf_police_cad", "518", "collision"), ("sf_police_cad", "488", "theft")], "source string, raw_type string, type string")
    assert rows.where(conditions(codes=("488",), types=("collision",))).first().raw_type == "488"


def test_token_table(spark):
    rows = spark.createDataFrame([(1, "A b, a"), (2, None), (3, "")], "id int, t string")
    assert {(x.id, x.token, x.tf) for x in tokens(rows, "id", "t").collect()} == {(1, "a", 2), (1, "b", 1)}


def test_route(spark):
    rows = spark.createDataFrame([("medic", None), ("ENGINE", "Medical Incident"), ("ENGINE", "Alarm"), (None, None)], "u string, c string")
    assert [x.s for x in rows.select(ingest.route(F.col("u"), F.col("c")).alias("s")).collect()] == ["sf_ems_cad", "sf_ems_cad", "sf_fire_cad", "sf_fire_cad"]


def test_sweep_reaches_incidents_quiet_for_longer_than_four_hours(spark):
    from pulsegrid.operators import fold
    from pulsegrid.plans.analytics import NOW
    from pulsegrid.plans.catalogue import QUERIES
    from pulsegrid.sources.observations import observations

    sf = "/root/testdata/sf0.001"
    rows = {x.id: x for x in observations(spark, sf).collect() if x.us <= NOW}
    last, closed = {}, set()
    for x in fold.correlate(observations(spark, sf).where(f"us <= {NOW}")).collect():
        last[x.incident_id] = max(last.get(x.incident_id, 0), rows[x.observation_id].us)
        if rows[x.observation_id].k % 4 == 0:
            closed.add(x.incident_id)
    got = {x.incident_id: x for x in QUERIES["stale_incidents"](spark, sf).collect()}
    assert {k: x.last_us for k, x in got.items()} == last
    old = [x for x in got.values() if x.last_us < NOW - 240 * 60_000_000]
    assert old and all(x.status == ("resolved" if x.incident_id in closed else "unknown") for x in old)


def test_counts_elsewhere_equal_pairs(spark):
    """Ties, windows over the edges of bins, equal rows, nulls and negative times against all pairs."""
    import random

    from pulsegrid.operators.range_join import counts_elsewhere

    r = random.Random(4)
    rows = [(i, r.choice((-40, -7, 0, 3, 7, 14, 15, 29, 30)) + r.choice((0, 0, 100)), r.choice("ab"), r.choice("xyz")) for i in range(160)]
    rows += [(200, None, "a", "x"), (201, 3, None, "x"), (202, 3, "a", None)]
    df = spark.createDataFrame(rows, "id long, us long, source string, area string")
    good = [x for x in rows if None not in x]
    for back, ahead in ((7, 7), (0, 15), (14, 0), (0, 0)):
        want = {a[0]: n for a in good if (n := sum(a[1] - back <= b[1] <= a[1] + ahead and a[2] != b[2] and a[3] != b[3] for b in good))}
        assert {x.id: x.elsewhere for x in counts_elsewhere(df, "id", ("source", "area"), back, ahead).collect()} == want
    assert counts_elsewhere(df.limit(0), "id", ("source", "area"), 7, 7).isEmpty()


def test_checkpoints_are_cut_and_discarded(spark):
    """A cut frame has files of its own, which go by name; a plain frame has none; Spark's switch is as it was."""
    import os
    from urllib.parse import urlparse

    import pytest

    from pulsegrid.session import _DROP_SHUFFLES, cut_lineage, discard

    before = spark.conf.get(_DROP_SHUFFLES, "false")
    cut = cut_lineage(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count(), drop_shuffles=True)
    assert cut.count() == 7
    assert spark.conf.get(_DROP_SHUFFLES, "false") == before
    path = urlparse(cut._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get()).path
    assert os.path.isdir(path)
    kept = cut_lineage(cut.where("k > 2"))
    discard(cut)
    assert not os.path.exists(path)
    assert kept.count() == 4
    with pytest.raises(ValueError):
        discard(spark.range(3))


def test_counts_elsewhere_deal_rows_once(spark):
    """Rows are dealt by bin before they are copied for each set of columns, and meet again by id alone."""
    from pulsegrid.operators.range_join import counts_elsewhere

    df = spark.createDataFrame([(1, 3, "a", "x"), (2, 4, "b", "y")], "id long, us long, source string, area string")
    plan = counts_elsewhere(df, "id", ("source", "area"), 7, 7)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(bin" in plan and "hashpartitioning(id" in plan and plan.count("Exchange ") == 2


def test_questions_look_for_each_phrase_once(spark):
    """Area and category are elements of an array, so that what names them again does not read the text again."""
    from pulsegrid.operators import questions

    said = spark.createDataFrame([("shots fired in the mission, shots fired",), ("offices",)], "q string")
    column = questions.parse(F.col("q"))
    assert str(column._jc.toString()).count("shots fired") <= 3
    got = [(x.p.category, x.p.area) for x in said.select(column.alias("p")).collect()]
    assert got == [("shootings and weapon calls", "Mission"), (None, None)]
