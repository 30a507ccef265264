"""Merging with redirects, late binding and re-normalization by hand cases."""

import random

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import late_binding, merging, near_blocks, renormalize
from pulsegrid.operators.range_join import MINUTE

MEMBERS = "incident_id string, observation_id long, us long, source string, type string, severity string, units array<string>"


def members_of(spark):
    rows = [
        ("c", 1, 30, "sf_police_cad", "unknown", None, []), ("c", 2, 35, "sf_police_report", "theft", "low", []), ("a", 3, 10, "sf_fire_cad", "fire", "critical", ["E1"]),
        ("b", 4, 10, "sf_ems_cad", "medical", "moderate", ["M2", "E1"]), ("d", 5, 50, "sf_police_cad", "assault", None, ["P1"]), ("e", 6, 60, "sf_police_cad", "theft", None, []),
        ("f", 7, 61, "sf_fire_cad", "fire", None, []), ("g", 8, 5, "sf_fire_cad", "fire", None, []),
    ]
    return spark.createDataFrame(rows, MEMBERS)


def incidents_of(spark, members):
    state = {"a": ("resolved", 100), "b": ("resolved", 90), "c": ("resolved", 120), "d": ("active", None), "e": ("dispatched", None), "f": ("unknown", None), "g": ("active", None)}
    status = spark.createDataFrame([(k, *v) for k, v in state.items()], "incident_id string, status string, resolved_us long")
    return merging.fold_members(members).join(status, "incident_id").withColumn("merged_into_id", F.lit(None).cast("string"))


def by_id(df, *columns):
    return {r["incident_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_chains_and_circles_leave_one_incident_each(spark):
    """a-b-c is a chain and a circle, d-e-f a circle; an id that is not there, a null and a request to itself join nothing; again with the same requests nothing changes."""
    members = members_of(spark)
    incidents = incidents_of(spark, members)
    requests = spark.createDataFrame([("c", "b"), ("b", "a"), ("a", "c"), ("d", "e"), ("e", "f"), ("f", "d"), ("g", "nowhere"), ("nowhere", "a"), ("g", "g"), (None, "a")], "a string, b string")
    done = merging.merge_incidents(incidents, members, requests)
    assert by_id(done.incidents, "merged_into_id") == {"a": (None,), "b": ("a",), "c": ("a",), "d": (None,), "e": ("d",), "f": ("d",), "g": (None,)}
    live = by_id(done.incidents.where("merged_into_id is null"), "primary_type", "severity", "source_count", "agencies", "units", "verification", "status", "resolved_us", "first_us", "last_us")
    assert live["a"] == ("fire", "critical", 3, ["ems", "fire", "police"], ["E1", "M2"], "multi-source", "resolved", 120, 10, 35)
    assert live["d"] == ("assault", None, 3, ["fire", "police"], ["P1"], "multi-source", "active", None, 50, 61)
    assert by_id(incidents.where("incident_id = 'g'"), "primary_type", "status", "units") == by_id(done.incidents.where("incident_id = 'g'"), "primary_type", "status", "units")
    assert sorted((r.incident_id, r.observation_id) for r in done.members.collect()) == [("a", 1), ("a", 2), ("a", 3), ("a", 4), ("d", 5), ("d", 6), ("d", 7), ("g", 8)]
    assert sorted((r.incident_id, r.merged_id, r.kind) for r in done.entries.collect()) == [("a", "b", "merged"), ("a", "c", "merged"), ("d", "e", "merged"), ("d", "f", "merged")]
    again = merging.merge_incidents(done.incidents, done.members, requests)
    assert again.entries.isEmpty()
    assert sorted(map(str, again.incidents.collect())) == sorted(map(str, done.incidents.select(*again.incidents.columns).collect()))
    assert sorted(map(str, again.members.collect())) == sorted(map(str, done.members.collect()))


def test_later_merge_moves_earlier_redirects(spark):
    members = members_of(spark)
    first = merging.merge_incidents(incidents_of(spark, members), members, spark.createDataFrame([("c", "b")], "a string, b string"))
    then = merging.merge_incidents(first.incidents, first.members, spark.createDataFrame([("c", "g")], "a string, b string"))
    assert by_id(then.incidents, "merged_into_id")["b"] == ("g",)
    assert sorted((r.from_id, r.into_id) for r in then.redirects.collect()) == [("b", "g"), ("c", "g")]
    asked = spark.createDataFrame([("c",), ("g",)], "asked string")
    assert sorted((r.asked, r.incident_id, r.merged_from) for r in merging.lookup(asked, then.incidents, then.redirects).collect()) == [("c", "g", "c"), ("g", "g", None)]


def test_redirects_end(spark):
    """A chain of forty, a circle with a tail, a redirect to itself, nulls, nothing at all."""
    chain = [(i, i + 1) for i in range(100, 140)]
    rows = [*chain, (1, 2), (2, 3), (3, 1), (9, 8), (8, 2), (5, 5), (None, 4), (6, None)]
    ends = {r.from_id: r.into_id for r in merging.follow(spark.createDataFrame(rows, "from_id long, into_id long")).collect()}
    assert ends == {**{i: 140 for i in range(100, 140)}, 2: 1, 3: 1, 8: 1, 9: 1}
    assert merging.follow(spark.createDataFrame([], "from_id long, into_id long")).isEmpty()


def test_eligibility(spark):
    rows = [(None, "active", None, 0), ("x", "active", None, 0), (None, "resolved", 100 * MINUTE, 120 * MINUTE), (None, "resolved", 100 * MINUTE, 121 * MINUTE), (None, "resolved", None, 0), (None, None, None, 0)]
    df = spark.createDataFrame(rows, "m string, s string, r long, at long")
    assert [r[0] for r in df.select(merging.eligible(F.col("m"), F.col("s"), F.col("r"), F.col("at"))).collect()] == [True, False, True, False, True, True]


def test_requests_are_stars(spark):
    scores = spark.createDataFrame([(1, "x", 0.9), (1, "y", 0.85), (1, "z", 0.9), (1, "w", 0.5), (2, "x", 0.99)], "observation_id long, incident_id string, score double")
    assert sorted((r.a, r.b) for r in merging.merge_requests(scores).collect()) == [("y", "x"), ("z", "x")]


def test_late_binding(spark):
    """A corner within a day confirms, an area alone never does, one article to an incident, nothing from before it or after two weeks."""
    hour = late_binding.HOUR
    incidents = spark.createDataFrame(
        [("i1", 0, 10, "c1", "N1", "fire", ["fire"]), ("i2", 0, 10, "c2", "N2", "theft", ["police"]), ("i3", 0, 10, None, "N3", "fire", ["fire"]), ("i4", 0, 10, "c4", None, "theft", [])],
        "incident_id string, first_us long, last_us long, corner string, neighborhood string, primary_type string, agencies array<string>",
    )
    articles = spark.createDataFrame(
        [(1, 3 * hour, "c1", "N1", "fire", None), (2, 5 * hour, "c1", "N1", "fire", None), (3, 80 * hour, "c2", "N2", "theft", "police"), (4, hour, None, "N3", "fire", "fire"), (5, 15 * 24 * hour, "c4", None, "theft", None), (6, -2 * hour, "c4", None, "theft", None), (7, 5, None, None, "theft", None)],
        "article_id long, us long, corner string, neighborhood string, type string, agency string",
    )
    done = late_binding.attach(articles, incidents)
    assert sorted((r.article_id, r.incident_id, r.verdict) for r in done.collect()) == [(1, "i1", "confirmed"), (3, "i2", "confirmed"), (4, "i3", "possible")]
    told = late_binding.enriched(incidents, done)
    assert by_id(told, "last_us", "last_enriched_us") == {"i1": (10, 3 * hour), "i2": (10, 80 * hour), "i3": (10, hour), "i4": (10, None)}


def test_only_changed_rows(spark):
    """Null to empty and back are changes, equal nulls are none; a second pass changes nothing."""
    schema = "id long, us long, type string, area string"
    stored = spark.createDataFrame([(1, 5, None, "x"), (2, 5, "", "x"), (3, 6, "a", None), (4, 7, "a", "x"), (5, None, "a", "x")], schema)
    recomputed = spark.createDataFrame([(1, 5, None, "x"), (2, 5, None, "x"), (3, 6, "a", ""), (4, 7, "b", "x"), (9, 7, "b", "x")], schema)
    changed = renormalize.changed_rows(stored, recomputed, "id", ["type", "area"])
    assert sorted((r.id, r.outcome) for r in changed.collect()) == [(2, "updated"), (3, "updated"), (4, "updated"), (9, "created")]
    after = renormalize.apply_changes(stored, changed, "id")
    assert renormalize.changed_rows(after, recomputed, "id", ["type", "area"]).isEmpty()
    assert sorted(r.id for r in renormalize.in_range(stored, 5, 6).collect()) == [1, 2, 3]
    known = stored.withColumn("backfilled", F.col("id") == 1)
    flags = renormalize.backfilled(known, recomputed.select("id"), ["id"])
    assert {r.id: r.backfilled for r in flags.collect()} == {1: True, 2: False, 3: False, 4: False, 9: True}


def test_nearest_links_join_what_all_pairs_join(spark):
    import random

    from pulsegrid.operators import scoring
    from pulsegrid.operators.components import connected_components
    from pulsegrid.operators.range_join import MINUTE, near_in_place_and_time

    r = random.Random(4)
    rows = [
        (i, str(i // 2), r.randrange(5 * 240) * MINUTE // 5, r.choice(["sf_police_cad", "sf_fire_cad", "sf_ems_cad"]), r.choice(["collision", "medical", "assault", "theft", "unknown", None]), r.choice(["x", "594", None]),
         r.choice([37.7, 37.7009, 37.71, 37.72, 37.73, None]), -122.4, None, []) for i in range(700)
    ]
    calls = spark.createDataFrame(rows, "id long, incident_id string, us long, source string, type string, raw_type string, lat double, lng double, neighborhood string, units array<string>")
    pairs = scoring.score_pairs(near_in_place_and_time(calls, calls, scoring.METERS, scoring.BACK * MINUTE, scoring.AHEAD * MINUTE).where("source <> o_source"))
    both = pairs.select(F.col("id").alias("observation_id"), F.explode(F.array("incident_id", "o_incident_id")).alias("incident_id"), "score")
    old, new = merging.merge_requests(both), merging.linked_requests(calls)
    sets = lambda edges: {x.node: x.component for x in connected_components(edges).collect()}
    assert sets(old) == sets(new) != {}
    assert new.count() < pairs.where(F.col("score") >= scoring.MERGE - scoring.SLACK).count()


def test_circles_end_the_jumping(spark, monkeypatch):
    """Circles of three and a tail of nine in 4,000 rows: as many rounds as the longest way asks for, not as the rows do."""
    rows = [(3 * c + i, 3 * c + (i + 1) % 3) for c in range(1330) for i in range(3)] + [(5000 + i, 5001 + i) for i in range(8)] + [(5008, 2)] + [(10 - 20, 0), (-11, -12)]
    rounds = []
    cut = merging.cut_lineage
    monkeypatch.setattr(merging, "cut_lineage", lambda df, *a, **k: (rounds.append(1), cut(df, *a, **k))[1])
    ends = {r.from_id: r.into_id for r in merging.follow(spark.createDataFrame(rows, "from_id long, into_id long")).collect()}
    want = {3 * c + i: 3 * c for c in range(1330) for i in (1, 2)} | {5000 + i: 0 for i in range(9)} | {-10: 0, -11: -12}
    assert ends == want
    assert len(rounds) <= 8


@pytest.mark.parametrize("rows_at_once", [1, 200_000])
def test_late_binding_is_that_of_all_pairs(spark, monkeypatch, rows_at_once):
    """Ties, long incidents, some that end before they begin or without an end, unknown types, places that are missing; no join is built."""
    monkeypatch.setattr(near_blocks, "ROWS", rows_at_once)
    r, hour = random.Random(5), late_binding.HOUR
    corners, areas = [f"c{n}" for n in range(9)], [f"N{n}" for n in range(4)]
    kinds = ["fire", "medical", "theft", "collision", "unknown", None]
    incidents, articles = [], []
    for n in range(260):
        first = r.choice([r.randrange(0, 900) * hour, r.randrange(0, 900 * hour)])
        last = first + r.choice([0, 1, 5 * hour, 300 * hour, 500 * hour, -2 * hour])
        incidents.append((f"i{n}", first, last if n % 30 else None, r.choice([None, *corners]), r.choice([None, *areas]), r.choice(kinds), r.choice([[], ["fire"], ["fire", "police"], None])))
        at = r.choice([first, last, first - hour, first + 14 * late_binding.DAY, r.randrange(0, 1000) * hour]) + r.choice([0, 0, 1, -1])
        articles.append((n, at, r.choice([None, *corners]), r.choice([None, *areas]), r.choice(kinds), r.choice(["fire", "police", None])))
    articles = spark.createDataFrame(articles, "article_id long, us long, corner string, neighborhood string, type string, agency string")
    incidents = spark.createDataFrame(incidents, "incident_id string, first_us long, last_us long, corner string, neighborhood string, primary_type string, agencies array<string>")
    may = [x for x in late_binding.late_candidates(articles, incidents).collect() if x.score >= late_binding.POSSIBLE]
    for_article, for_incident = {}, {}
    for x in may:
        for best, of, other in ((for_article, x.article_id, x.incident_id), (for_incident, x.incident_id, x.article_id)):
            best[of] = min(best.get(of, (9, 0, other)), (-x.score, x.gap_us, other))
    want = {}
    for x in may:
        if for_article[x.article_id][2] == x.incident_id and for_incident[x.incident_id][2] == x.article_id:
            sure = x.score >= late_binding.CONFIRMED and x.at_corner and (x.gap_us <= late_binding.CONSISTENT or x.named)
            want[x.article_id, x.incident_id] = (x.score, "confirmed" if sure else "possible", x.us)
    done = late_binding.attach(articles, incidents)
    assert len(want) > 30 and {(x.article_id, x.incident_id): (x.score, x.verdict, x.enriched_us) for x in done.collect()} == want
    assert "Join" not in done._jdf.queryExecution().executedPlan().toString()


def test_links_are_those_of_all_pairs_at_ties_and_repeated_ids(spark):
    """Calls of one moment at every source, ids that come twice in other places, and no more rows than incidents, where links of calls were several times as many."""
    from pulsegrid.operators import scoring
    from pulsegrid.operators.components import connected_components
    from pulsegrid.operators.range_join import near_in_place_and_time

    r = random.Random(8)
    rows = []
    for n in range(420):
        at, kind, lat = r.randrange(0, 16 * 60) * 3 * MINUTE, r.choice(["theft", "medical", "collision"]), r.choice([37.7, 37.7009, 37.73])
        for c in range(3):
            i = 3 * n + c
            rows.append((i if n % 50 else 3 * (n // 2) + c, f"u{i}" if i % 3 else f"u{i - 3 * (n % 2)}", at, ("sf_police_cad", "sf_fire_cad", "sf_ems_cad")[c], kind, r.choice(["x", "594", None]), lat, r.choice([-122.4, -122.4008]), None, []))
    calls = spark.createDataFrame(rows, "id long, incident_id string, us long, source string, type string, raw_type string, lat double, lng double, neighborhood string, units array<string>").cache()
    pairs = scoring.score_pairs(near_in_place_and_time(calls, calls, scoring.METERS, scoring.BACK * MINUTE, scoring.AHEAD * MINUTE).where("source <> o_source"))
    own = calls.select(F.col("id").alias("x"), "incident_id")
    scores = pairs.select(F.col("id").alias("observation_id"), F.explode(F.array("id", "o_id")).alias("x"), "score").join(own, "x")
    sets = lambda edges: {x.node: x.component for x in connected_components(edges).collect()}
    new = merging.linked_requests(calls)
    want = sets(merging.merge_requests(scores))
    assert sets(new) == want and len(set(want.values())) > 20
    point = calls.where("lat = 37.73 and lng = -122.4 and us < 24 * 3600000000L")
    assert 0 < merging.linked_requests(point).count() <= point.select("incident_id").distinct().count()


def test_no_redirects_are_followed_before_they_are_asked_for(spark, monkeypatch):
    members = members_of(spark)
    incidents = incidents_of(spark, members)
    follow = merging.follow
    monkeypatch.setattr(merging, "follow", None)
    done = merging.merge_incidents(incidents, members, spark.createDataFrame([("c", "b"), ("b", "a")], "a string, b string"))
    assert by_id(done.incidents, "merged_into_id")["c"] == ("a",)
    monkeypatch.setattr(merging, "follow", follow)
    assert sorted((r.from_id, r.into_id) for r in done.redirects.collect()) == [("b", "a"), ("c", "a")]


def test_stars_join_what_any_edges_join(spark):
    """Random edges, stars, chains, loops, repeats and nulls; of stars only what is less than another's node goes through rounds."""
    from pulsegrid.operators import components

    r = random.Random(6)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(160)] + [(1000 + i, 900) for i in range(50)] + [(900, 800), (2000, 2001), (2001, 2002), (2002, 2003), (7, 7), (None, 3), (3, None), (1001, 900)]
    df = spark.createDataFrame(edges, "a long, b long")
    told = lambda found: sorted((x.node, x.component) for x in found.collect())
    assert told(components.connected_stars(df)) == told(components.connected_components(df.where("a <> b")))
    assert components.connected_stars(df.where("a > 5000")).isEmpty()
