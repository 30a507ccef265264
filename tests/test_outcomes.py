"""The correlation against a plain sequential form, and baselines, visibility, places, stems and labels by hand cases."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import baseline, evaluation, fold, geocode, location_cache, scoring, stemming, visibility
from pulsegrid.operators.range_join import MINUTE
from pulsegrid.plans import incidents, outcomes
from pulsegrid.sources.observations import AGENCIES, observations

DATA = "/root/testdata/sf0.001"


def meters(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371008.8 * math.asin(min(1.0, math.sqrt(h)))


def alike(a, b):
    if "unknown" in (a, b):
        return None
    if a == b:
        return 1.0
    return scoring.AFFINITY.get(a, {}).get(b, scoring.AFFINITY.get(b, {}).get(a, 0.0))


def one_after_another(rows):
    """Every call against every incident there is, without blocking, components or pruning."""
    made, out = [], {}
    for o in sorted(rows, key=lambda r: (r.us, r.id)):
        agency, best = AGENCIES[o.source], None
        for i in made:
            if not o.us - 25 * MINUTE <= i["first"] <= o.us:
                continue
            if o.lat is not None:
                if i["at"] is None or meters((o.lat, o.lng), i["at"]) > 400:
                    continue
                place = 1 - meters((o.lat, o.lng), i["at"]) / 400
            elif o.neighborhood is not None and o.neighborhood == i["area"]:
                place = 0.35
            else:
                continue
            parts = [(0.35, place), (0.25, max(0, 1 - max(0, o.us - i["last"]) / (25 * MINUTE))), (0.2, alike(o.type, i["type"]))]
            if i["agencies"] == {agency} and o.units and i["units"]:
                parts.append((0.1, len(set(o.units) & i["units"]) / len(set(o.units) | i["units"])))
            used = [(w, s) for w, s in parts if s is not None]
            score = sum(w * s for w, s in used) / sum(w for w, _ in used)
            if len(used) == 2:
                score = min(score, 0.84)
            rank = (score, place, -i["first"], -i["id"])
            if best is None or rank > best[0]:
                best = (rank, i)
        score = best[0][0] if best else None
        if best and score >= 0.85 - 1e-9:
            i, verdict = best[1], "merged"
        else:
            verdict = "probable" if best and score >= 0.65 - 1e-9 else "created"
            i = {"id": o.id, "first": o.us, "last": o.us, "at": None if o.lat is None else (o.lat, o.lng), "area": o.neighborhood, "type": "unknown", "units": set(), "agencies": set()}
            made.append(i)
        i["last"], i["units"], i["agencies"] = max(i["last"], o.us), i["units"] | set(o.units), i["agencies"] | {agency}
        i["type"] = o.type if i["type"] == "unknown" else i["type"]
        out[o.id] = (i["id"], verdict, None if score is None else round(score, 6), i["type"])
    return out, made


@pytest.fixture(scope="module")
def sequential(spark):
    rows = observations(spark, DATA).collect()
    return rows, *one_after_another(rows)


def test_correlation_equals_one_call_after_another(spark, sequential):
    """Decisions, incidents and their sets over the whole table; done again on what is attached nothing changes."""
    rows, want, made = sequential
    found = {r.observation_id: (r.incident_id, r.decision, r.score, r.primary_type) for r in incidents.correlate_fold(spark, DATA).collect()}
    assert found == want
    told = {r.incident_id: (r.source_count, r.agencies, r.units, r.verification) for r in incidents.incidents(spark, DATA).collect()}
    sizes = {i["id"]: sum(w[0] == i["id"] for w in want.values()) for i in made}
    assert told == {i["id"]: (sizes[i["id"]], sorted(i["agencies"]), sorted(i["units"]), "multi-source" if len(i["agencies"]) > 1 else "reported") for i in made}


def test_stale_incidents_equal_a_sweep_of_the_sequential_form(spark):
    rows = [r for r in observations(spark, DATA).collect() if r.us <= outcomes.NOW]
    want, made = one_after_another(rows)
    closed = {want[r.id][0] for r in rows if r.k is not None and r.k % 4 == 0}
    limit = {"collision": 90, "medical": 60, "fire": 180, "rescue": 180, "hazard": 180}
    status = lambda i: "resolved" if i["id"] in closed else "unknown" if outcomes.NOW - i["last"] >= limit.get(i["type"], 45) * MINUTE else "active"
    found = {r.incident_id: (r.last_us, r.status) for r in incidents.stale_incidents(spark, DATA).collect()}
    assert found == {i["id"]: (i["last"], status(i)) for i in made}


def test_replayed_cases_equal_one_case_after_another(spark, sequential):
    """Each labelled case on an empty state: outcomes and the counts of pairs."""
    rows = {r.id: r for r in sequential[0]}
    cases = {}
    for r in outcomes.label_cases(spark, DATA).collect():
        cases.setdefault((r.case, r.label), []).append(r.id)
    want = {}
    for (case, label), ids in cases.items():
        done = one_after_another([rows[i] for i in ids])[0]
        pairs = [done[a][0] == done[b][0] for n, a in enumerate(ids) for b in ids[n + 1 :]]
        same = label == "same"
        want[case] = (len({d[0] for d in done.values()}), sum(pairs) * same, sum(pairs) * (not same), sum(not p for p in pairs) * same, sum(not p for p in pairs) * (not same))
    found = {r.case: (r.incidents, r.tp, r.fp, r.fn, r.tn) for r in outcomes.replayed_cases(spark, DATA).collect()}
    assert found == want
    total = [sum(w[k] for w in want.values()) for k in range(1, 4)]
    m = outcomes.replayed_metrics(spark, DATA).collect()[0]
    precision, recall = (total[0] / max(1, total[0] + x) if total[0] + x else 1.0 for x in total[1:])
    assert (m.cases, m.false_merges, m.missed_merges) == (len(want), total[1], total[2])
    assert m.precision == pytest.approx(precision)
    assert m.recall == pytest.approx(recall)


def test_one_observation_in_two_cases(spark):
    row = (1, 0, "sf_fire_cad", "fire", "x", 37.7, -122.4, "N1", ["E1"])
    cases = spark.createDataFrame([("a", *row), ("b", *row), ("b", 2, 5, *row[2:]), (None, *row)], "case string, id long, us long, source string, type string, raw_type string, lat double, lng double, neighborhood string, units array<string>")
    assert sorted((r.case, r.observation_id, r.incident_id, r.decision) for r in fold.replay(cases).collect()) == [("a", 1, 1, "created"), ("b", 1, 1, "created"), ("b", 2, 1, "merged")]


def test_labels_need_reports(spark):
    schema = "id long, us long, neighborhood string, report string"
    rows = [(1, 0, "N", "r1"), (2, 5, "N", "r1"), (2, 5, "N", "r1"), (3, 9, "N", "r2"), (4, 11, None, "r3"), (5, 12, "N", None)]
    found = sorted(tuple(r) for r in evaluation.report_cases(spark.createDataFrame(rows, schema)).collect())
    assert found == [("different-r1", "different", 1), ("different-r1", "different", 3), ("same-r1", "same", 1), ("same-r1", "same", 2)]
    assert evaluation.report_cases(spark.createDataFrame([], schema)).isEmpty()


def test_baseline_counts_quiet_hours(spark):
    """Zeros are there, a single call alarms nobody, a young area is not judged, a burst is busier and silence quieter."""
    at, hour, week = 5000 * baseline.WEEK, baseline.HOUR, baseline.WEEK
    calls = [("A", "fire", at - k * week) for k in (1, 2, 3, 4, 4)] + [("A", "theft", at - k * week + 3 * hour) for k in (1, 2, 3, 4) for _ in range(9)]
    calls += [("A", "fire", at)] * 3 + [("A", "medical", at + 5 * hour)] + [("B", "fire", at - week)] * 3 + [("A", "odd", at - week + 7 * hour), (None, "fire", at - week), ("A", "fire", None)]
    df = spark.createDataFrame(calls, "neighborhood string, type string, us long")
    base = baseline.hourly_baseline(df, at)
    assert base.count() == 2 * len(baseline.TYPES) * 168
    told = {(r.neighborhood, r.type, r.hour_of_week): (r.expected, round(r.deviation, 3), r.observed, r.comparison) for r in baseline.compared(df, base, at, at + 24 * hour).collect()}
    assert len(told) == 2 * len(baseline.TYPES) * 24
    assert told["A", "fire", 0] == (1.25, 0.433, 3, "busier")
    assert told["A", "theft", 3] == (9.0, 0.0, 0, "quieter")
    assert told["A", "medical", 5] == (0.0, 0.0, 1, "typical")
    assert told["A", "unknown", 7] == (0.25, 0.433, 0, "typical")
    assert told["B", "fire", 0] == (0.75, 1.299, 0, "not enough history")


def test_baseline_deviates_as_sql_does(spark):
    """Of 1, 1, 0 and 4 calls, the last week first, stddev_pop is a bit less than 1.5, so silence is quieter; in another order it is not."""
    at, week = 5000 * baseline.WEEK, baseline.WEEK
    counts = {"A": (1, 1, 0, 4), "B": (4, 0, 1, 1)}
    calls = [(area, "theft", at - (k + 1) * week) for area, weeks in counts.items() for k, n in enumerate(weeks) for _ in range(n)]
    df = spark.createDataFrame(calls + [("B", "fire", at - 4 * week)], "neighborhood string, type string, us long")
    told = baseline.compared(df, baseline.hourly_baseline(df, at), at, at + baseline.HOUR).where("type = 'theft'")
    con = duckdb.connect()
    for r in told.collect():
        values = ", ".join(f"({i}, {n})" for i, n in enumerate(counts[r.neighborhood]))
        (deviation,) = con.execute(f"select stddev_pop(n order by i) from (values {values}) v(i, n)").fetchone()
        assert (r.expected, r.deviation, r.observed) == (1.5, deviation, 0)
        assert r.comparison == {"A": "quieter", "B": "typical"}[r.neighborhood]


def test_visibility(spark):
    rows = spark.createDataFrame(
        [("i", 1, 0, "sf_fire_cad", "fire", 0), ("i", 2, 1, "sf_police_cad", "weapon", 1), ("i", 3, 2, "sf_police_cad", "assault", None), ("j", 4, 0, "sf_fire_cad", "fire", 1)],
        "incident_id string, id long, us long, source string, type string, sensitive int",
    )
    when = rows.select("id", visibility.publish_us(F.col("us"), F.col("source"), F.col("type"), F.col("sensitive")).alias("t"))
    assert {r.id: r.t for r in when.collect()} == {1: 3 * MINUTE, 2: None, 3: 2 + 15 * MINUTE, 4: None}
    assert {r.incident_id: r.public_us for r in visibility.incidents_public(rows).collect()} == {"i": 15 * MINUTE, "j": None}


def test_versions_as_of(spark):
    """Ties take the larger version, a bucket without versions the last one before, and nothing public is null."""
    day = visibility.BUCKET
    versions = spark.createDataFrame([("r", 1, 10, "a"), ("r", 2, 10, "b"), ("r", 3, 3 * day, None), ("r", 4, None, "never"), (None, 5, 1, "x")], "record string, version long, publish_us long, text string")
    requests = spark.createDataFrame([(1, "r", 9), (2, "r", 10), (3, "r", 2 * day), (4, "r", 3 * day), (5, "r", 9 * day), (6, "s", 5), (7, None, 5)], "request_id long, record string, at_us long")
    found = {r.request_id: (r.version, r.text) for r in visibility.as_of(versions, requests, ["text"]).collect()}
    assert found == {1: (None, None), 2: (2, "b"), 3: (2, "b"), 4: (3, None), 5: (3, None), 6: (None, None), 7: (None, None)}
    assert visibility.as_of(versions.limit(0), requests, ["text"]).count() == 7


def test_places_are_resolved_once(spark):
    parsed = "struct<kind:string,canonical:string,streets:array<string>,address_number:int>"
    schema = f"id long, lat double, lng double, neighborhood string, parsed {parsed}"
    corner = ("intersection", "A & B", ["A", "B"], None)
    rows = spark.createDataFrame([(1, None, None, None, corner), (2, None, None, None, corner), (3, 1.0, 2.0, None, corner), (4, None, None, None, ("unknown", None, [], None)), (5, None, None, None, ("intersection", "C & D", ["C", "D"], None))], schema)
    asked = []

    def resolve(new):
        asked.append(sorted(r.id for r in new.collect()))
        corners = spark.createDataFrame([("A & B", 37.0, -122.0)], "canonical string, lat double, lng double")
        segments = spark.createDataFrame([], "street string, position int, left_from int, left_to int, right_from int, right_to int, line array<struct<lat:double,lng:double>>, neighborhood string")
        areas = spark.createDataFrame([], "name string, position int, geometry array<array<array<struct<lat:double,lng:double>>>>")
        return geocode.geocode(new, corners, segments, areas)

    cache = location_cache.grown(spark.createDataFrame([], location_cache.CACHE), rows, resolve)
    kept = spark.createDataFrame(cache.collect(), location_cache.CACHE)
    location_cache.grown(kept, rows, resolve)
    assert asked == [["A & B", "C & D"], []]
    found = {r.id: (r.geo_lat, r.method) for r in location_cache.placed(rows, kept).collect()}
    assert found == {1: (37.0, "intersection_lookup"), 2: (37.0, "intersection_lookup"), 3: (1.0, "source_coordinates"), 4: (None, "unresolved"), 5: (None, "unresolved")}


#: Words and stems as printed with the published algorithm.
STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing",
    "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky",
    "relational": "relat", "conditional": "condit", "rational": "ration", "valenci": "valenc", "digitizer": "digit", "conformabli": "conform", "radicalli": "radic", "differentli": "differ", "vileli": "vile", "analogousli": "analog",
    "vietnamization": "vietnam", "predication": "predic", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "callousness": "callous", "formaliti": "formal", "sensitiviti": "sensit", "sensibiliti": "sensibl",
    "triplicate": "triplic", "formative": "form", "formalize": "formal", "electriciti": "electr", "electrical": "electr", "hopeful": "hope", "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin",
    "gyroscopic": "gyroscop", "adjustable": "adjust", "defensible": "defens", "irritant": "irrit", "replacement": "replac", "adjustment": "adjust", "dependent": "depend", "adoption": "adopt", "homologou": "homolog", "communism": "commun",
    "activate": "activ", "angulariti": "angular", "homologous": "homolog", "effective": "effect", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "m3": "m3", "é": "é", "by": "by",
}


def test_stems():
    assert {w: stemming.porter(w) for w in STEMS} == STEMS


def test_search_over_fields(spark, tmp_path):
    rows = spark.createDataFrame([(1, "Robberies", None, ["M3", "E1"]), (2, "robbery in progress", "robbing", []), (3, None, None, None), (4, "quiet", "sailing", ["M30"]), (5, "a", "b", ["c"]), (6, "d", "e", ["f"])], "id long, a string, b string, units array<string>")
    index = stemming.inverted_index(rows, ("a", "b", "units"))
    stemming.write_index(index, str(tmp_path / "index"))
    kept = spark.read.parquet(str(tmp_path / "index"))
    assert {r.id for r in stemming.search(kept, "robbery", 10).collect()} == {1, 2}
    assert {r.id for r in stemming.search(kept, "m3", 10).collect()} == {1, 4}
    assert stemming.search(kept, " ?! ", 10).isEmpty()
    assert len(stemming.search(kept, "robbery m3", 1).collect()) == 1
