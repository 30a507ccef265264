"""Gazetteer loads, archive scans, digests, rollups, the data gate, revisions and checks as queries, with their SQL forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators import merging, renormalize, reporting
from pulsegrid.operators.ingest import quarantine_reason
from pulsegrid.plans import feeds as feed_plans
from pulsegrid.plans.analytics import DAY, HOUR, NOW, _WITH, conditions
from pulsegrid.plans.merging import _fold
from pulsegrid.plans.timelines import _MEMBERS, _members
from pulsegrid.session import table
from pulsegrid.sources import feeds, gazetteer
from pulsegrid.sources.observations import observations


def gazetteer_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners of all calls, whose points differ a little from record to record: the one most records agree on."""
    n = F.col("user_id") % 30 + 1
    name = F.when(F.col("id") % 9 == 0, "Not Available").otherwise(F.concat(F.upper(feed_plans.ordinal(n)), F.lit(" ST \\ MISSION ST")))
    lat = F.lit(37.7) + n * F.lit(0.001) + F.when(F.col("id") % 4 == 0, F.lit(0.0001)).otherwise(F.lit(0.0))
    rows = observations(spark, sf_dir).select(name.alias("intersection_name"), F.when(F.col("id") % 11 != 0, F.round(lat, 6)).alias("lat"), F.lit(-122.4).alias("lng"))
    return gazetteer.corners(rows, feed_plans.VOCABULARY)


def gazetteer_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as centerline records: some not active, without a line, or with ranges of zero."""
    key = F.col("p_partkey")
    line = F.struct(F.lit("LineString").alias("type"), F.array(F.array(F.lit(-122.4) - key / 1e5, F.lit(37.7) + key / 1e5), F.array(F.lit(-122.41), F.lit(37.75))).alias("coordinates"))
    record = F.to_json(F.struct(
        F.when(key % 13 != 0, key.cast("string")).alias("cnn"), F.element_at(F.array(*map(F.lit, feed_plans.STREETS)), (key % 3 + 1).cast("int")).alias("street"), F.lit("ST").alias("st_type"), (key % 7 * 100).cast("string").alias("lf_fadd"),
        (key % 7 * 100 + 98).cast("string").alias("lf_toadd"), F.when(key % 5 == 0, "x").otherwise(F.lit("101")).alias("rt_fadd"), F.lit("199").alias("rt_toadd"), F.when(key % 2 == 0, F.concat(F.lit("N"), key % 41)).alias("nhood"),
        (key % 11 != 0).alias("active"), F.when(key % 17 != 0, line).alias("line"),
    ))
    done = gazetteer.segments(table(spark, sf_dir, "part").select(record.alias("payload")), feed_plans.VOCABULARY)
    return done.select("cnn", "street", "left_from", "left_to", "right_from", "right_to", "neighborhood", *[F.round(c, 9).alias(c) for c in ("south", "north", "west", "east")])


def gazetteer_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as polygon records: squares, squares of two, and some that cannot be read."""
    key = F.col("s_suppkey")
    west = F.lit(-123.0) + key / 1000
    ring = lambda w: F.array(F.array(w, F.lit(37.0)), F.array(w + 0.5, F.lit(37.0)), F.array(w + 0.5, F.lit(37.5)), F.array(w, F.lit(37.5)))
    one, two = F.to_json(F.array(ring(west))), F.to_json(F.array(F.array(ring(west)), F.array(ring(west + 2))))
    shape = F.when(key % 3 == 0, F.concat(F.lit('{"type":"Polygon","coordinates":'), one, F.lit("}"))).when(key % 3 == 1, F.concat(F.lit('{"type":"MultiPolygon","coordinates":'), two, F.lit("}"))).otherwise('{"type":"Point","coordinates":[1,2]}')
    payload = F.concat(F.lit('{"nhood":"A'), key, F.lit('","the_geom":'), shape, F.lit("}"))
    done = gazetteer.areas(table(spark, sf_dir, "supplier").select(payload.alias("payload")))
    return done.select("name", F.size("geometry").cast("long").alias("polygons"), *[F.round(c, 9).alias(c) for c in ("south", "north", "west", "east")])


def historical_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archived police records of three days, with what the archive's checks refuse and why, and whether they are new."""
    record = "cad_number string, id string, received_datetime string"
    raw = feed_plans.police_feed(spark, sf_dir).select("payload", "fetched_us", F.explode(F.array(F.from_json("payload", record))).alias("r"))
    asked = renormalize.in_range(raw, NOW - 5 * DAY, NOW - 2 * DAY, "fetched_us")
    checked = asked.withColumn("reason", quarantine_reason(F.col("r.cad_number"), F.col("r.id"), F.col("r.received_datetime")))
    good = feeds.police_observations(checked.where("reason is null")).where("rejected is null").select("source_record_id")
    stored = observations(spark, sf_dir).where("id % 2 = 0").select(F.col("id").cast("string").alias("source_record_id"), (F.col("id") % 4 == 0).alias("backfilled"))
    flagged = renormalize.backfilled(stored, good, ["source_record_id"]).groupBy(F.when(F.col("backfilled"), "backfilled").otherwise("live").alias("outcome")).agg(F.count("*").alias("records"))
    refused = checked.where("reason is not null").groupBy(F.regexp_replace("reason", "x[0-9]+", "x").alias("outcome")).agg(F.count("*").alias("records"))
    return flagged.unionByName(refused)


def all_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three feeds as one table of observations, counted by source and by what was refused."""
    fire, police, reports = feeds.fire_observations(feed_plans.fire_feed(spark, sf_dir)), feeds.police_observations(feed_plans.police_feed(spark, sf_dir)), feeds.report_observations(feed_plans.report_feed(spark, sf_dir))
    every = police.unionByName(fire).unionByName(reports)
    return every.groupBy("source", F.col("rejected").isNotNull().alias("refused")).agg(F.count("*").alias("records"), F.count("lat").alias("located"))


def data_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate as of NOW over calls up to two hours before it, of which a few records came twice."""
    rows = observations(spark, sf_dir).where(F.col("us") <= NOW - 2 * HOUR)
    record = F.when(F.col("id") % 500 == 1, F.col("id") - 1).otherwise(F.col("id"))
    calls = rows.select("id", "source", record.alias("source_record_id"), "us", "type").withColumn("source", F.lit("s"))
    payloads = rows.select(F.lit("s").alias("source"), F.col("user_id").alias("source_record_id"), F.col("id").alias("payload_hash"))
    done = reporting.data_gate(calls, payloads, 1, NOW)
    return done.select(F.round("hours", 6).alias("hours"), "passes", F.array_join("reasons", ";").alias("reasons"))


def _incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = _members(spark, sf_dir)
    more = members.groupBy("incident_id").agg(F.min_by("neighborhood", F.when(F.col("neighborhood").isNotNull(), F.struct("us", "observation_id"))).alias("neighborhood"), F.max(F.coalesce(F.col("k") % 4 == 0, F.lit(False))).alias("closed"))
    gone = F.when(F.element_at(F.split("incident_id", "-"), 1).cast("int") % 10 == 3, F.lit("x"))
    return merging.fold_members(members).join(more, "incident_id").withColumns({"status": F.when(F.col("closed"), "resolved").otherwise("active"), "merged_into_id": gone})


def activity_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every area's day before NOW, quiet areas too."""
    areas = observations(spark, sf_dir).select("neighborhood").where("neighborhood is not null")
    return reporting.activity_digest(_incidents(spark, sf_dir), areas, NOW - DAY, NOW)


def top_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.top_types(observations(spark, sf_dir), NOW)


def trend_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by type over 35 days, which is by week, and over ten, which is by day."""
    rows = observations(spark, sf_dir)
    both = [reporting.trend(rows, NOW, days).withColumn("days", F.lit(days)) for days in (35, 10)]
    return both[0].unionByName(both[1])


def settled_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents by day, area, type and agency of days that are settled at NOW, under two versions of the pipeline."""
    return reporting.settled_rollup(_incidents(spark, sf_dir), NOW, {0: "1", NOW // DAY - 5: "2"})


def comparable_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).where(conditions())
    return reporting.comparable_calls(rows, NOW - 30 * DAY).select("type", "neighborhood", "place", "id", "us")


def payload_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of a user's record, which publishes three rows; what changed by field, without volatile ones."""
    payload = F.map_filter(F.create_map(
        F.lit("rowid"), F.when(F.col("user_id") % 2 == 0, (F.col("id") % 3).cast("string")), F.lit("id"), F.col("id").cast("string"), F.lit("data_as_of"), F.col("us").cast("string"), F.lit("type"), F.col("type"),
        F.lit("area"), F.col("neighborhood"),
    ), lambda k, v: v.isNotNull())
    rows = observations(spark, sf_dir).select(F.col("user_id").alias("record"), "us", F.col("id").alias("payload_id"), payload.alias("payload"))
    return reporting.payload_revisions(rows).where("field <> 'id'")


def feed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that open a day of the feed."""
    return reporting.day_separators(observations(spark, sf_dir).select("id", "us")).where("new_day").select("id", "us", "day")


def record_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that is wrong with each order as a record."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("clerk "), "o_custkey")).alias("name"), F.when(F.col("o_orderkey") % 5 == 0, "many").otherwise(F.col("o_totalprice").cast("string")).alias("price"),
        F.when(F.col("o_orderkey") % 7 == 0, "yes").otherwise("TRUE").alias("open"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 11 == 0, "soon").when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate").cast("string")).alias("at"),
    )
    checks = {"name": reporting.text, "price": reporting.number, "open": reporting.truth, "status": reporting.one_of("F", "O"), "at": reporting.optional(reporting.instant)}
    return rows.select("id", F.array_join(reporting.violations(checks), "; ").alias("violations"))


def city_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of each named window that ends at NOW, and how many of them lie within the city's box."""
    rows = observations(spark, sf_dir).where(F.col("us") <= NOW)
    windows = F.array(*[F.struct(F.lit(name).alias("window"), F.lit(reporting.window_start(name, NOW) or 0).alias("start")) for name in reporting.WINDOWS])
    met = rows.select("us", reporting.within_city(F.col("lat"), F.col("lng")).alias("within"), F.inline(windows)).where("us >= start")
    return met.groupBy("window").agg(F.count("*").alias("calls"), F.count_if("within").alias("within"))


QUERIES = {
    f.__name__: f
    for f in (
        gazetteer_corners, gazetteer_segments, gazetteer_areas, historical_range, all_feeds, data_gate, activity_digest, top_types, trend_weeks, settled_rollup, comparable_calls, payload_revisions, feed_days,
        record_checks, city_windows,
    )
}

_INC = f"""{_MEMBERS}, f as ({_fold('m')}), more as (select incident_id, arg_min(neighborhood, (us, observation_id)) filter (where neighborhood is not null) as neighborhood, coalesce(bool_or(k % 4 = 0), false) as closed from m group by 1),
  i as (select f.*, more.neighborhood, closed, case when cast(string_split(incident_id, '-')[1] as int) % 10 = 3 then 'x' end as merged from f join more using (incident_id))"""
_WINDOW_ROWS = ", ".join(f"('{n}', {reporting.window_start(n, NOW) or 0})" for n in reporting.WINDOWS)

ORACLE_SQL = {
    "gazetteer_corners": f"""{_WITH}, c as (select user_id % 30 + 1 as n, id, round(37.7::double + (user_id % 30 + 1) * 0.001::double + case when id % 4 = 0 then 0.0001::double else 0.0::double end, 6) as lat from obs where id % 9 <> 0 and id % 11 <> 0),
        g as (select n, lat, count(*) as records from c group by all), b as (select * from g qualify row_number() over (partition by n order by records desc, lat) = 1)
        select {feed_plans._ordinal('n')} || ' St & Mission St' as canonical, {feed_plans._ordinal('n')} || ' St' as street_a, 'Mission St' as street_b, lat, -122.4::double as lng, records from b""",
    "gazetteer_segments": """select p_partkey::varchar as cnn, ['Mission St', 'Irving St', 'Clement St'][p_partkey % 3 + 1] as street, nullif(cast(p_partkey % 7 * 100 as int), 0) as left_from, cast(p_partkey % 7 * 100 + 98 as int) as left_to,
        case when p_partkey % 5 <> 0 then 101 end as right_from, 199 as right_to, case when p_partkey % 2 = 0 then 'N' || (p_partkey % 41) end as neighborhood, round(least(37.7::double + p_partkey / 1e5::double, 37.75::double), 9) as south,
        round(greatest(37.7::double + p_partkey / 1e5::double, 37.75::double), 9) as north, round(least(-122.4::double - p_partkey / 1e5::double, -122.41::double), 9) as west, round(greatest(-122.4::double - p_partkey / 1e5::double, -122.41::double), 9) as east
        from part where p_partkey % 13 <> 0 and p_partkey % 11 <> 0 and p_partkey % 17 <> 0""",
    "gazetteer_areas": """select 'A' || s_suppkey as name, s_suppkey % 3 + 1 as polygons, 37.0::double as south, 37.5::double as north, round(-123.0::double + s_suppkey / 1000.0::double, 9) as west,
        round(-123.0::double + s_suppkey / 1000.0::double + case when s_suppkey % 3 = 1 then 2.5 else 0.5 end, 9) as east from supplier where s_suppkey % 3 < 2""",
    "historical_range": f"""{_WITH}, r as (select id, k, case when k % 17 = 0 and k % 19 = 0 then 'missing key' when k % 17 = 0 then 'key is not numeric:   ' end as reason from obs where us between {NOW - 5 * DAY} and {NOW - 2 * DAY}),
        g as (select id::varchar as record from r where reason is null and k % 23 <> 0),
        s as (select id::varchar as record, id % 4 = 0 as b from obs where id % 2 = 0)
        select case when coalesce(b, true) then 'backfilled' else 'live' end as outcome, count(*) as records from g left join s using (record) group by 1 union all select reason, count(*) from r where reason is not null group by 1""",
    "all_feeds": f"""{_WITH}, a as (select 'sf_police_cad' as source, k % 17 = 0 and k % 19 = 0 or k % 23 = 0 as refused, lat from obs
          union all select case when l_linenumber % 3 = 0 or l_orderkey % 5 = 0 then 'sf_ems_cad' else 'sf_fire_cad' end, l_linenumber >= 7, null from lineitem
          union all select 'sf_police_report', o_orderkey % 13 = 0 or o_orderkey % 7 = 0, case when o_orderkey % 3 <> 0 and o_orderkey % 2 = 0 then 37.75 end from orders)
        select source, refused, count(*) as records, count(lat) as located from a group by all""",
    "data_gate": f"""{_WITH}, r as (select id, us, type, user_id, case when id % 500 = 1 then id - 1 else id end as record from obs where us <= {NOW - 2 * HOUR}),
        c as (select count(*) as total, count_if(type <> 'unknown') as typed, min(us) as first, max(us) as last, count(*) / count(distinct user_id) as versions from r), d as (select count(*) as repeated from (select record from r group by 1 having count(*) > 1)),
        e as (select (last - first) / {float(HOUR)}::double as hours, list_filter([case when (last - first) / {float(HOUR)} < 72 then 'coverage' end, case when ({NOW} - last) / {float(HOUR)} > 3 then 'behind' end, case when repeated > 0 then 'repeated records' end,
          case when versions > 10 then 'payload versions' end, 'lost gaps', case when total = 0 then 'no observations' end, case when total > 0 and typed = 0 then 'nothing typed' end], lambda x: x is not null) as reasons from c, d)
        select round(hours, 6) as hours, len(reasons) = 0 as passes, array_to_string(reasons, ';') as reasons from e""",
    "activity_digest": f"""{_INC}, w as (select *, case severity when 'low' then 0 when 'high' then 2 when 'critical' then 3 else -1 end as rank, case when units = '' then 0 else len(string_split(units, ',')) end as n_units from i where first_us >= {NOW - DAY} and first_us < {NOW} and neighborhood is not null),
        t as (select neighborhood, string_agg(primary_type || '=' || n, ',' order by primary_type) as by_type from (select neighborhood, primary_type, count(*) as n from w group by all) group by 1),
        g as (select neighborhood, string_agg(a || '=' || n, ',' order by a) as by_agency from (select neighborhood, a, count(*) as n from (select neighborhood, unnest(string_split(agencies, ',')) as a from w) group by all) group by 1),
        s as (select neighborhood, count(*) as incidents, count_if(not closed) as open, arg_min(incident_id, (-first_us, incident_id)) as latest, arg_min(incident_id, (-rank, -n_units, -first_us, incident_id)) as gravest from w group by 1)
        select neighborhood, coalesce(incidents, 0) as incidents, coalesce(open, 0) as open, latest, gravest, coalesce(by_type, '') as by_type, coalesce(by_agency, '') as by_agency
        from (select distinct neighborhood from obs where neighborhood is not null) left join s using (neighborhood) left join t using (neighborhood) left join g using (neighborhood)""",
    "top_types": f"""{_WITH}, c as (select d as days, type, count(*) as calls from obs, (values (7), (30), (90)) x(d) where us <= {NOW} and us >= {NOW} - d * {DAY} group by all)
        select days, type, calls, cast(row_number() over (partition by days order by calls desc, type) as int) as place from c qualify place <= 14""",
    "trend_weeks": f"""{_WITH}, t as (select distinct type from obs), b as (select 35 as days, {NOW} - i * {7 * DAY} as start_us, {7 * DAY} as w from range(1, 6) x(i) union all select 10, {NOW} - i * {DAY}, {DAY} from range(1, 11) y(i))
        select t.type, start_us, count(obs.id) as calls, days from t cross join b left join obs on obs.type = t.type and us >= start_us and us < start_us + w group by all""",
    "settled_rollup": f"""{_INC}, r as (select first_us // {DAY} as day, neighborhood, primary_type as type, unnest(string_split(agencies, ',')) as agency from i where merged is null and (first_us // {DAY} + 1) * {DAY} + {4 * HOUR} <= {NOW})
        select day, neighborhood, type, agency, count(*) as incidents, case when day >= {NOW // DAY - 5} then '2' else '1' end as version from r group by all""",
    "comparable_calls": f"""{_WITH} select type, neighborhood, cast(row_number() over (partition by type, neighborhood order by us desc, id) as int) as place, id, us from obs where neighborhood is not null and us >= {NOW - 30 * DAY} qualify place <= 400""",
    "payload_revisions": f"""{_WITH}, l as (select user_id as record, case when user_id % 2 = 0 then (id % 3)::varchar else '' end as series, us, id, type, neighborhood from obs),
        p as (select *, lag(type) over w as pt, lag(neighborhood) over w as pn, row_number() over w as n from l window w as (partition by record, series order by us, id))
        select record, series, us, 'type' as field, pt as before, type as after from p where n > 1 and pt is distinct from type
        union all select record, series, us, 'area', pn, neighborhood from p where n > 1 and pn is distinct from neighborhood""",
    "feed_days": f"""{_WITH} select arg_max(id, (us, -id)) as id, max(us) as us, us // {DAY} as day from obs group by us // {DAY}""",
    "record_checks": """select o_orderkey as id, array_to_string(list_filter([case when o_orderkey % 3 = 0 then 'name: text is missing' end, case when o_orderkey % 5 = 0 then 'price: no number' end,
        case when o_orderkey % 7 = 0 then 'open: neither true nor false' end, case when o_orderstatus not in ('F', 'O') then 'status: none of F, O' end, case when o_orderkey % 11 = 0 then 'at: no time' end], lambda x: x is not null), '; ') as violations from orders""",
    "city_windows": f"""{_WITH}, w(name, start) as (values {_WINDOW_ROWS}) select name as "window", count(*) as calls, count_if(lat between 37.705 and 37.812 and lng between -122.517 and -122.357) as within from obs join w on us >= start and us <= {NOW} group by name""",
}
