"""Baselines, visibility, resolved places, stemmed search, labels from reports and same-agency scores as queries, with their SQL forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators import baseline, evaluation, fold, location_cache, scoring, stemming, visibility
from pulsegrid.operators.range_join import MINUTE, near_in_place_and_time
from pulsegrid.plans import feeds
from pulsegrid.plans.analytics import DAY, HOUR, NOW, _WITH
from pulsegrid.plans.incidents import _AFFINITY_ROWS, _DISTANCE
from pulsegrid.session import cut_lineage
from pulsegrid.sources.observations import observations

#: The day that is compared: 2024-01-30, with the four weeks before it as history.
DAY_AT = NOW + 14 * DAY


def hourly_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every area, type and hour of a day against the same hour of the four weeks before, zeros included."""
    calls = observations(spark, sf_dir).select("neighborhood", "type", "us")
    done = baseline.compared(calls, baseline.hourly_baseline(calls, DAY_AT), DAY_AT, DAY_AT + DAY)
    return done.select("neighborhood", "type", "hour_of_week", F.round("expected", 6).alias("expected"), F.round("deviation", 6).alias("deviation"), "observed", "comparison")


def public_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of all calls is public at NOW, as it is published."""
    return visibility.public_rows(observations(spark, sf_dir), NOW).drop("occurred_at")


def incidents_public(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).withColumn("incident_id", F.concat_ws("-", "user_id", F.floor(F.col("us") / DAY)))
    return visibility.incidents_public(rows)


def public_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For requests at moments of their own, the version of a user's record that was public then."""
    rows = observations(spark, sf_dir)
    when = visibility.publish_us(F.col("us"), F.col("source"), F.col("type"), F.col("sensitive"))
    versions = rows.select(F.col("user_id").alias("record"), F.col("id").alias("version"), when.alias("publish_us"), "type", "neighborhood")
    requests = rows.where("id % 3 = 0").select(F.col("id").alias("request_id"), ((F.col("user_id") + F.col("id")) % 50).alias("record"), (F.col("us") + 5 * MINUTE).alias("at_us"))
    return visibility.as_of(versions, requests, ["type", "neighborhood"])


def cached_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of two batches: those of the first are in the cache when the second comes, and only what is new is resolved."""
    rows = observations(spark, sf_dir).select("id", "lat", "lng", "neighborhood", feeds.normalize_location(feeds._raw_location(), feeds.VOCABULARY).alias("parsed"))
    rows = cut_lineage(rows)  # texts are parsed once
    resolve = lambda new: feeds.geo.geocode(new, *feeds.gazetteer(spark))
    empty = spark.createDataFrame([], location_cache.CACHE)
    first = cut_lineage(location_cache.grown(empty, rows.where("id % 4 = 0"), resolve))
    fresh = location_cache.new_places(first, rows).select(F.col("id").alias("canonical"), F.lit("new").alias("outcome"))
    both = location_cache.grown(first, rows, resolve)
    uses = rows.groupBy(F.col("parsed.canonical").alias("canonical")).agg(F.count("*").alias("uses"))
    done = both.join(fresh, "canonical", "left").join(uses, "canonical")
    return done.select("canonical", "method", F.round("geo_lat", 9).alias("lat"), F.round("geo_lng", 6).alias("lng"), "uses", F.coalesce("outcome", F.lit("cached")).alias("outcome"))


def observations_fts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best calls for three words, over all fields, with their rows (a top-k report)."""
    rows = observations(spark, sf_dir)
    street = F.element_at(F.array(F.lit("Mission Street"), F.lit("Clement Street"), F.lit("Irving Crossing")), (F.col("user_id") % 3 + 1).cast("int"))
    texts = rows.select("id", "raw_type", F.when(F.col("k") % 3 == 0, F.lit("reported thefts; officers responding")).alias("subtype"), street.alias("location"), "neighborhood", "units", "type")
    best = stemming.search(stemming.inverted_index(texts), "Collisions crossings N3", 50)
    return best.join(rows.select("id", "us", "type", "neighborhood"), "id").select("id", F.round("score", 6).alias("score"), "us", "type", "neighborhood")


def _reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with the number of the report that names them: a user's calls of one quarter of an hour."""
    rows = observations(spark, sf_dir)
    slot = F.floor(F.col("us") / (15 * MINUTE)).cast("long")
    return rows.withColumn("report", F.when(F.col("id") % 10 != 9, F.concat_ws("-", F.col("user_id"), slot)))


def label_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.report_cases(_reported(spark, sf_dir))


def replayed_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled cases replayed through the correlation, each on an empty state, with how many pairs it got right."""
    rows = _reported(spark, sf_dir)
    cases = evaluation.report_cases(rows)
    done = fold.replay(cases.join(rows, "id")).select("case", F.col("observation_id").alias("id"), F.col("incident_id").alias("incident"))
    return evaluation.case_outcomes(done.join(cases, ["case", "id"]).withColumnRenamed("id", "observation"))


def replayed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of the correlation itself over the labelled cases."""
    done = evaluation.metrics(replayed_cases(spark, sf_dir))
    return done.select("cases", "cases_correct", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "false_merges", "missed_merges", "split_cases")


def same_agency_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one agency, whose units count, with codes that contradict a type."""
    code = F.when(F.col("id") % 3 == 0, F.when(F.col("id") % 2 == 0, "594").otherwise("595")).otherwise(F.col("raw_type"))
    rows = observations(spark, sf_dir).withColumn("raw_type", code)
    met = near_in_place_and_time(rows, rows, scoring.METERS, scoring.BACK * MINUTE, scoring.AHEAD * MINUTE).where("source = o_source and id <> o_id")
    done = scoring.score_pairs(met)
    return done.select("id", F.col("o_id").alias("other"), F.round("s_units", 6).alias("s_units"), F.round("s_type", 6).alias("s_type"), F.round("score", 6).alias("score"), scoring.decision(F.col("score")).alias("decision"))


QUERIES = {
    f.__name__: f
    for f in (
        hourly_baseline, public_observations, incidents_public, public_as_of, cached_locations, observations_fts, label_cases, replayed_cases, replayed_metrics, same_agency_scores,
    )
}

_DELAY = f"{MINUTE} * greatest(case source when 'sf_police_cad' then 10 else 3 end, case type when 'assault' then 15 when 'weapon' then 30 else 0 end)"
#: Words of the made texts and their stems, as the published algorithm gives them.
_STEMS = {
    "collision": "collis", "medical": "medic", "assault": "assault", "theft": "theft", "unknown": "unknown", "error": "error", "click": "click", "view": "view", "purchase": "purchas", "signup": "signup",
    "reported": "report", "thefts": "theft", "officers": "offic", "responding": "respond", "mission": "mission", "street": "street", "clement": "clement", "irving": "irv", "crossing": "cross",
}
_KINDS = ", ".join(f"('{t}')" for t in baseline.TYPES)
_REPORTED = f"{_WITH}, r as (select *, case when id % 10 <> 9 then user_id || '-' || (us // {15 * MINUTE}) end as report from obs)"

ORACLE_SQL = {
    "hourly_baseline": f"""{_WITH}, c as (select neighborhood, type, us from obs where neighborhood is not null),
        a as (select neighborhood, min(us) <= {DAY_AT - 28 * DAY} as enough from c where us < {DAY_AT} group by 1), t(type) as (values {_KINDS}),
        h as (select (({DAY_AT} // {HOUR}) + i) % 168 as h, {DAY_AT} + i * {HOUR} as begin from range(24) x(i)), w as (select j as week from range(1, 5) y(j)),
        n as (select a.neighborhood, t.type, h.h, w.week, enough, begin, (begin - week * {7 * DAY}) // {HOUR} as slot from a, t, h, w),
        k as (select neighborhood, type, us // {HOUR} as slot, count(*) as n from c group by all),
        e as (select n.neighborhood, n.type, h, any_value(enough) as enough, any_value(begin) as begin, avg(coalesce(k.n, 0)) as expected, stddev_pop(coalesce(k.n, 0)) as deviation from n left join k using (neighborhood, type, slot) group by 1, 2, 3),
        o as (select e.*, coalesce(k.n, 0) as observed from e left join k on k.neighborhood = e.neighborhood and k.type = e.type and k.slot = begin // {HOUR})
        select neighborhood, type, cast(h as int) as hour_of_week, round(expected, 6) as expected, round(deviation, 6) as deviation, observed,
          case when not enough then 'not enough history' when observed > expected + greatest(deviation, 1) then 'busier' when observed < expected - greatest(deviation, 1) then 'quieter' else 'typical' end as comparison from o""",
    "public_observations": f"""{_WITH} select id, source, type, neighborhood, floor(lat * 10000 + 0.5) / 10000 as lat, floor(lng * 10000 + 0.5) / 10000 as lng from obs where sensitive = 0 and us + {_DELAY} <= {NOW}""",
    "incidents_public": f"""{_WITH} select user_id || '-' || (us // {DAY}) as incident_id, min(us) filter (where sensitive = 0) + max({_DELAY}) filter (where sensitive = 0) as public_us from obs group by 1""",
    "public_as_of": f"""{_WITH}, v as (select user_id as record, id as version, us + {_DELAY} as publish_us, type, neighborhood from obs where sensitive = 0),
        u as (select * from v qualify row_number() over (partition by record, publish_us order by version desc) = 1),
        q as (select id as request_id, (user_id + id) % 50 as record, us + {5 * MINUTE} as at_us from obs where id % 3 = 0)
        select request_id, q.record, at_us, version, type, neighborhood from q asof left join u on q.record = u.record and q.at_us >= u.publish_us""",
    "cached_locations": f"""{feeds._PLACES}, g as (select *, kind = 'intersection' and shape in (0, 7) and s = 'Mission' and n <= 24 as corner,
          kind in ('address', 'block') and s = 'Irving' and number % 20 <> 0 and number between 1 and 119 as seg from q where canonical is not null and canonical <> '')
        select canonical, case when bool_or(corner) then 'intersection_lookup' when bool_or(seg) then 'block_interpolation' else 'unresolved' end as method,
          round(case when bool_or(corner) then 37.7::double + any_value(n) * 0.001::double when bool_or(seg) then 37.71::double end, 9) as lat,
          round(case when bool_or(corner) then -122.4::double when bool_or(seg) then -122.41::double - (any_value(number) % 20 - 1) / 18.0::double * 0.01::double end, 6) as lng,
          count(*) as uses, case when bool_or(id % 4 = 0) then 'cached' else 'new' end as outcome from g group by canonical""",
    "observations_fts": f"""{_WITH}, x as (select *, concat_ws(' ', raw_type, case when k % 3 = 0 then 'reported thefts officers responding' end, ['mission street', 'clement street', 'irving crossing'][user_id % 3 + 1], lower(neighborhood), lower(units[1]), type) as words from obs),
        s(w, stem) as (values {", ".join(f"('{w}', '{s}')" for w, s in _STEMS.items())}),
        t as (select id, us, type, neighborhood, len(string_split(words, ' ')) as size, unnest(string_split(words, ' ')) as w from x), p as (select t.*, coalesce(stem, w) as stem from t left join s using (w)),
        q(term) as (values ('collis'), ('cross'), ('n3')), h as (select id, any_value(us) as us, any_value(type) as type, any_value(neighborhood) as neighborhood, any_value(size) as size, term, count(*) as tf from p join q on starts_with(stem, term) group by id, term),
        d as (select term, count(*) as df from h group by term), c as (select count(*) as docs, avg(size) as mean from (select distinct id, size from t)),
        r as (select id, any_value(us) as us, any_value(type) as type, any_value(neighborhood) as neighborhood, round(sum(greatest(ln((docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 9) as score from h join d using (term), c group by id)
        select id, round(score, 6) as score, us, type, neighborhood from r order by r.score desc, id limit 50""",
    "label_cases": f"""{_REPORTED}, s as (select report, count(*) as n from r where report is not null group by 1), f as (select report, min(us) as us, arg_min(id, (us, id)) as id, arg_min(coalesce(neighborhood, ''), (us, id)) as area from r where report is not null group by 1),
        l as (select report, id, lead(id) over (partition by area, us // {DAY} order by us, id) as next from f where area <> '')
        select 'same-' || report as "case", 'same' as label, id from r join s using (report) where n > 1
        union all select 'different-' || report, 'different', unnest([id, next]) from l where next is not null""",
    "same_agency_scores": f"""{_WITH}, o as (select *, case when id % 3 = 0 then case when id % 2 = 0 then '594' else '595' end else raw_type end as code from obs), aff(x, y, v) as (values {_AFFINITY_ROWS}),
        pairs as (select a.id, b.id as other, a.type, b.type as o_type, a.code, b.code as o_code, abs(a.us - b.us) as gap, a.units as u1, b.units as u2, {_DISTANCE} as distance from o a join o b on a.source = b.source and a.id <> b.id and b.us between a.us - {25 * MINUTE} and a.us + {15 * MINUTE} where {_DISTANCE} <= 400),
        t as (select *, greatest(0, 1 - distance / 400.0)::double as s_location, greatest(0.0, 1 - gap / {25.0 * MINUTE})::double as s_time, case when len(u1) > 0 and len(u2) > 0 then case when u1[1] = u2[1] then 1.0 else 0.0 end end::double as s_units,
          case when type <> 'unknown' and o_type <> 'unknown' then case when type = o_type then 1.0 when (code in ('594', '595') and o_type = 'medical') or (o_code in ('594', '595') and type = 'medical') then 0.0
            else coalesce((select max(v) from aff where x = type and y = o_type), (select max(v) from aff where x = o_type and y = type), 0.0) end end::double as s_type from pairs),
        r as (select *, (0.35 * s_location + 0.25 * s_time + coalesce(0.2 * s_type, 0) + coalesce(0.1 * s_units, 0)) / (0.6 + case when s_type is null then 0 else 0.2 end + case when s_units is null then 0 else 0.1 end) as raw from t),
        s as (select *, case when s_type is null and s_units is null then least(raw, 0.84) else raw end as score from r)
        select id, other, round(s_units, 6) as s_units, round(s_type, 6) as s_type, round(score, 6) as score, case when score >= 0.85 - 1e-9 then 'merged' when score >= 0.65 - 1e-9 then 'probable' else 'created' end as decision from s""",
}
