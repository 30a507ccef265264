"""Feeds, times, locations and taxonomies as queries, with their SQL forms.

The test tables hold no raw feeds, so records are written as JSON text from
``events``, ``orders`` and ``lineitem`` by rule and read back through the
mappers; the SQL forms state the expected rows from the same tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.locations import Vocabulary, normalize_location, ordinal, street_vocabulary
from pulsegrid.functions.times import ZONE, elapsed, local_offset, naive_local, numeric_window, parse_local, relative_time
from pulsegrid.operators import geocode as geo
from pulsegrid.operators import stored, taxonomy
from pulsegrid.plans.analytics import DAY, HOUR, NOW, _WITH
from pulsegrid.session import table
from pulsegrid.sources import feeds
from pulsegrid.sources.observations import observations

#: Names of streets in made locations, and what is known of them.
STREETS = ("MISSION", "IRVING", "CLEMENT")
_ENDS = {1: "ST", 2: "ND", 3: "RD"}
NUMBERED = tuple(f"{n}{'TH' if 11 <= n % 100 <= 13 else _ENDS.get(n % 10, 'TH')}" for n in range(1, 49))
VOCABULARY = Vocabulary({s: "St" for s in STREETS}, frozenset(NUMBERED), frozenset(STREETS[1:]))


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[value.alias(name) for name, value in fields.items()]))


def _naive(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSS")


def police_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Police records of all events: some without keys, with unreadable times or empty fields."""
    k, at = F.col("k"), F.col("occurred_at")
    record = _json(
        cad_number=F.when(k % 17 == 0, "  ").otherwise(F.col("id").cast("string")), id=F.when(k % 19 != 0, F.concat(F.lit("x"), "id")),
        received_datetime=F.when(k % 23 == 0, "soon").otherwise(_naive(at)), call_type_final=F.when(k % 3 == 0, F.col("raw_type")), call_type_original=F.lit("orig"),
        call_type_final_desc=F.when(k % 5 != 0, F.concat(F.lit("label "), "raw_type")), priority_original=F.lit("C"), priority_final=F.when(k % 4 == 0, "A"),
        disposition=F.when(k % 2 == 0, "HAN").otherwise(""), sensitive_call=F.when(F.col("sensitive") == 1, "true").otherwise("False"),
        intersection_name=F.concat(F.lit("A"), F.col("user_id") % 12, F.lit(" ST \\ B ST")),
        intersection_point=F.when(F.col("lat").isNotNull(), F.struct(F.array("lng", "lat").alias("coordinates"))), analysis_neighborhood=F.col("neighborhood"),
        data_loaded_at=_naive(at + F.expr("interval 30 minutes")),
    )
    return observations(spark, sf_dir).select(record.alias("payload"), F.col("us").alias("fetched_us"))


def fire_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as unit rows of fire and medical calls."""
    n, order = F.col("l_linenumber"), F.col("l_orderkey")
    at = F.timestamp_micros(F.unix_micros(F.col("l_shipdate").cast("timestamp")) + n * HOUR)
    record = _json(
        call_number=F.when(n < 7, order.cast("string")).otherwise(" "), unit_id=F.concat(F.lit("E"), F.col("l_suppkey") % 50), received_dttm=_naive(at),
        unit_type=F.when(n % 3 == 0, "medic ").when(n % 3 == 1, "ENGINE"), call_type=F.when(order % 5 == 0, "Medical Incident").otherwise("Alarms"),
        priority=F.lit("2"), final_priority=F.when(n == 2, "3"), address=F.when(n % 2 == 0, F.concat(F.lit("ADDR "), F.col("l_partkey"))), on_scene_dttm=_naive(at),
    )
    return table(spark, sf_dir, "lineitem").select(record.alias("payload"), (n * F.lit(10**9).cast("long") + F.col("l_partkey")).alias("fetched_us"))


def report_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as written reports, with fields that are not on the list."""
    key = F.col("o_orderkey")
    category = F.element_at(F.array(*map(F.lit, ("Larceny Theft", "Assault ", "ARSON", "Weird", ""))), (F.col("o_custkey") % 5 + 1).cast("int"))
    record = _json(
        row_id=F.when(key % 13 != 0, key.cast("string")).otherwise(""), incident_datetime=F.when(key % 7 != 0, _naive(F.col("o_orderdate").cast("timestamp"))).otherwise(""),
        incident_category=category, incident_code=F.lit("06244"), cad_number=F.when(key % 3 == 0, key.cast("string")), latitude=F.when(key % 3 != 0, "37.75"),
        longitude=F.when(key % 2 == 0, "-122.41"), suspect=F.when(key % 2 == 0, "x"), remarks=F.when(key % 5 == 0, "y"),
    )
    return table(spark, sf_dir, "orders").select(record.alias("payload"), F.lit(0).cast("long").alias("fetched_us"))


def feed_police(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = feeds.police_observations(police_feed(spark, sf_dir))
    return done.select(
        F.col("source_record_id").alias("record"), "us", "raw_type", "subtype", "priority", "sensitive", "lat", "lng", "neighborhood",
        F.size("metadata").cast("long").alias("n_metadata"), "published_us", "rejected",
    )


def feed_fire_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = feeds.merge_unit_rows(feeds.fire_observations(fire_feed(spark, sf_dir)))
    return done.select("source", F.col("source_record_id").alias("call"), "us", F.array_join("units", ",").alias("units"), "raw_type", "priority", "location_raw", F.col("metadata")["unit_count"].alias("unit_count"))


def stored_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit rows of fire and medical calls that come after others of the same calls are stored: what each call is then, and whether that is new."""
    rows = feeds.fire_observations(fire_feed(spark, sf_dir)).where("rejected is null")
    number = F.floor(F.col("fetched_us") / 10**9)
    done = stored.merge_stored(stored.fold_records(rows.where(number <= 3)), rows.where(number >= 3))
    return done.select(
        "source", F.col("source_record_id").alias("call"), "us", F.array_join("units", ",").alias("units"), "raw_type", "priority", "location_raw", F.col("metadata")["unit_count"].alias("unit_count"), "outcome"
    )


def stored_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report rows that come again: the last one stands, a place that was known is not blanked."""
    key = F.col("o_orderkey")
    none = {"fetched_us": F.lit(0), **dict.fromkeys(("agency", "priority", "intersection", "location_raw"), F.lit(None))}
    base = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("obs_"), key).alias("id"), F.lit("sf_police_report").alias("source"), key.cast("string").alias("source_record_id"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"),
        F.lit(None).alias("published_us"), F.col("o_orderstatus").alias("raw_type"), F.col("o_orderpriority").alias("subtype"), F.lit("theft").alias("type"), F.concat(F.lit("N"), F.col("o_custkey") % 41).alias("neighborhood"),
        F.lit(37.75).alias("lat"), F.lit(-122.41).alias("lng"), F.lit(False).alias("sensitive"), F.lit(1.0).alias("confidence"), F.array(F.lit("x")).alias("units"), F.create_map(F.lit("data_as_of"), F.lit("1"), F.lit("a"), F.lit("b")).alias("metadata"),
    ).withColumns({**none, "unit_times": F.lit(None)})
    typed = lambda df: df.select(*[F.col(c.split(" ")[0]).cast(c.split(" ", 1)[1]).alias(c.split(" ")[0]) for c in stored.CALL.split(", ")])
    order = F.col("source_record_id").cast("long")
    again = base.where(order % 3 != 0).withColumns({
        "fetched_us": F.lit(1), "neighborhood": F.when(order % 4 == 0, F.lit("N99")), "lat": F.when(order % 5 == 0, F.lit(37.8)), "subtype": F.when(order % 7 == 0, F.lit(None)).otherwise(F.col("subtype")),
        "type": F.lit("other"), "metadata": F.create_map(F.lit("data_as_of"), F.lit("2"), F.lit("a"), F.when(order % 8 == 0, F.lit("c")).otherwise(F.lit("b"))),
    })
    done = stored.merge_stored(typed(base.where(order % 2 == 0)), typed(again))
    return done.select("source_record_id", "subtype", "type", "neighborhood", "lat", F.col("metadata")["data_as_of"].alias("as_of"), F.col("metadata")["a"].alias("a"), "outcome")


def feed_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = feeds.report_observations(report_feed(spark, sf_dir))
    return done.select(F.col("source_record_id").alias("record"), "us", "type", "lat", "lng", F.size("metadata").cast("long").alias("n_metadata"), "rejected")


def feed_dropped_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.dropped_fields(report_feed(spark, sf_dir), feeds.REPORT)


def feed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of 1,000 rows in the order of time and id, behind a cursor with overlap; rows and last key by page."""
    rows = observations(spark, sf_dir).where(feeds.since_cursor(F.col("us"), NOW - 7 * DAY) & feeds.after_cursor("us", "id", NOW - 7 * DAY - 60_000_000, 0))
    paged = feeds.keyset_pages(rows.select("us", "id"), "us", "id", 1000)
    return paged.groupBy("page").agg(F.count("*").alias("records"), F.max(F.struct("us", "id")).alias("last")).select("page", "records", F.col("last.us").alias("last_us"), F.col("last.id").alias("last_id"))


def local_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates at a half past each hour as wall clock of the city: instant, offset, and the string back."""
    at = F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + (F.col("o_orderkey") % 24) * HOUR + HOUR // 2)
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), _naive(at).alias("text"))
    rows = rows.select("id", "text", parse_local(F.col("text")).alias("us"), parse_local(F.concat("text", F.lit("Z"))).alias("zoned_us"))
    return rows.select("id", "us", "zoned_us", (local_offset(F.col("us")) / HOUR).cast("int").alias("offset_hours"), naive_local(F.col("us")).alias("back"))


def told_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long ago events were, and how long from each to a fixed moment."""
    gap = F.pmod(F.col("id") * 7919, F.lit(9000)) * 1_000_000
    rows = observations(spark, sf_dir)
    return rows.select("id", relative_time(F.col("us"), F.lit(NOW)).alias("told"), elapsed(F.col("us"), F.col("us") + gap - 1_000_000).alias("took"))


def numeric_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, ("in the last %s hours", "past %s days", "%s weeks", "over the previous month", "last %s moons", "nothing"))), (F.col("id") % 6 + 1).cast("int"))
    rows = observations(spark, sf_dir).select("id", numeric_window(F.replace(said, F.lit("%s"), (F.col("user_id") % 9 + 1).cast("string"))).alias("w"))
    return rows.select("id", F.col("w.minutes").alias("minutes"), F.col("w.label").alias("label"))


def _raw_location() -> Column:
    """Eight kinds of location text by id."""
    n, user = F.col("user_id") % 48 + 1, F.col("user_id")
    street = F.element_at(F.array(*map(F.lit, STREETS)), (user % 3 + 1).cast("int"))
    numbered = F.upper(ordinal(n))
    texts = (
        F.concat(F.when(n < 10, "0").otherwise(""), numbered, F.lit(" ST \\ "), street, F.lit(" ST")), F.concat(street, F.lit(" ST/"), numbered, F.lit(" AVE")),
        F.concat(100 * (user % 9 + 1), F.lit(" BLOCK OF "), street, F.lit(" ST")), F.concat(user + 1, F.lit(" "), street, F.lit("  STREET")),
        F.concat(F.lit("CALL BOX: "), user + 1, F.lit(" "), street, F.lit(" ST,SF")), F.lit("Not Available"), F.concat(F.lit("General Hospital "), street),
        F.concat(numbered, F.lit(" and "), street),
    )
    return F.element_at(F.array(*texts), (F.col("id") % 8 + 1).cast("int"))


def normalize_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = observations(spark, sf_dir).select("id", normalize_location(_raw_location(), VOCABULARY).alias("p"))
    return done.select("id", F.col("p.kind").alias("kind"), F.col("p.canonical").alias("canonical"), F.size("p.streets").alias("n_streets"), F.col("p.address_number").alias("number"), F.round("p.confidence", 6).alias("confidence"))


def street_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary of made corners: avenues crossed by two streets, a street of two suffixes, one without."""
    n, user = F.upper(ordinal(F.col("user_id") % 48 + 1)), F.col("user_id") % 4
    name = (
        F.when(user == 0, F.concat(F.lit("IRVING ST \\ "), n, F.lit(" AVE"))).when(user == 1, F.concat(F.lit("CLEMENT ST \\ 0"), n, F.lit(" AVE")))
        .when(user == 2, F.concat(F.lit("MISSION ST \\ "), n, F.lit(" ST"))).otherwise(F.concat(F.lit("BROADWAY \\ OAK "), F.when(F.col("id") % 2 == 0, "ST").otherwise("WAY")))
    )
    return street_vocabulary(observations(spark, sf_dir).select(name.alias("intersection_name")))


def gazetteer(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Made corners, street segments and areas."""
    number = lambda x: F.lit(float(x))
    corners = spark.range(1, 25).select(F.concat(ordinal(F.col("id")), F.lit(" St & Mission St")).alias("canonical"), (number(37.7) + F.col("id") * number(0.001)).alias("lat"), number(-122.4).alias("lng"))
    point = lambda lat, lng: F.struct(lat.alias("lat"), lng.alias("lng"))
    begin = F.col("id") * 20
    line = F.array(point(number(37.71), number(-122.41)), point(number(37.71), number(-122.42)))
    segments = spark.range(0, 6).select(
        F.lit("Irving St").alias("street"), "id", F.col("id").alias("position"), (begin + 1).alias("left_from"), (begin + 19).alias("left_to"), (begin + 18).alias("right_from"),
        (begin + 2).alias("right_to"), line.alias("line"), F.when(F.col("id") == 0, "First").alias("neighborhood"),
    ).drop("id")
    square = lambda w, e: F.array(F.array(F.array(*[point(number(a), number(b)) for a, b in ((37.69, w), (37.69, e), (37.8, e), (37.8, w))])))
    areas = spark.range(2).select(F.when(F.col("id") == 0, "West").otherwise("East").alias("name"), F.col("id").alias("position"), F.when(F.col("id") == 0, square(-122.6, -122.45)).otherwise(square(-122.45, -122.39)).alias("geometry"))
    return corners, segments, areas


def _geocoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).select("id", "source", "sensitive", "lat", "lng", F.when(F.col("k") % 5 == 0, F.col("neighborhood")).alias("neighborhood"), normalize_location(_raw_location(), VOCABULARY).alias("parsed"))
    return geo.geocode(rows, *gazetteer(spark))


def geocode_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _geocoded(spark, sf_dir)
    return done.select("id", F.round("geo_lat", 9).alias("lat"), F.round("geo_lng", 6).alias("lng"), F.col("geo_area").alias("area"), "method", F.col("geo_confidence").alias("confidence"), "reason")


def geocode_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.geocode_report(_geocoded(spark, sf_dir))


def agreed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The point most records of an area's corner agree on, at block precision."""
    rows = observations(spark, sf_dir).select(F.col("neighborhood").alias("canonical"), geo.snap(F.col("lat")).alias("lat"), geo.snap(F.col("lng")).alias("lng")).where("canonical is not null")
    return geo.busiest_point(rows)


def _rules(spark: SparkSession) -> DataFrame:
    rule = "source string, version string, position int, rawCode string, rawLabelPattern string, rawLabel string, normalizedType string, subtype string, defaultSeverity string, typeConfidence double"
    rows = [
        ("sf_police_cad", "1", 0, "ERROR", None, "Collision", "collision", None, "high", 0.9), ("sf_police_cad", "1", 1, None, "label v", None, "assault", "view", None, 0.6),
        ("sf_police_cad", "1", 2, None, "LABEL", None, "disturbance", None, "low", 0.5), ("sf_fire_cad", "1", 0, "click", None, "Medical aid", "medical", "aid", None, 0.8),
        ("sf_fire_cad", "1", 1, None, "purchase|view", None, "theft", None, None, 0.55),
    ]
    return spark.createDataFrame(rows, rule)


def classify_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).select("id", "source", "raw_type", F.concat(F.lit("Label "), "raw_type").alias("subtype"))
    stored = taxonomy.replace_source(_rules(spark).where("source <> 'sf_fire_cad'").unionByName(_rules(spark).where("source = 'sf_fire_cad'").withColumn("normalizedType", F.lit("old"))), _rules(spark).where("source = 'sf_fire_cad'"))
    return taxonomy.classify(rows, stored).select("id", "type", F.col("type_subtype").alias("subtype"), "severity", "type_confidence", "matched_by")


def priority_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.element_at(F.array(*map(F.lit, ("A", " b", "C", "3", "E", "zz", "1"))), (F.col("k") % 7 + 1).cast("int"))
    return observations(spark, sf_dir).select("id", taxonomy.priority_rank(F.col("source"), code).alias("rank"))


QUERIES = {
    f.__name__: f
    for f in (
        feed_police, feed_fire_calls, stored_ingest, stored_reports, feed_reports, feed_dropped_fields, feed_pages, local_times, told_times, numeric_windows, normalize_locations, street_names,
        geocode_cascade, geocode_report, agreed_points, classify_types, priority_ranks,
    )
}


def _off(us: str) -> str:
    return f"(epoch_us(timezone('{ZONE}', make_timestamptz({us}))) - ({us}))"


def _local(us: str) -> str:
    return f"({us} - {_off(f'({us} - {_off(us)})')})"


def _ordinal(n: str, upper: bool = False) -> str:
    ends = [e.upper() if upper else e for e in ("th", "st", "nd", "rd")]
    return f"(({n}) || case when ({n}) % 100 between 11 and 13 then '{ends[0]}' when ({n}) % 10 = 1 then '{ends[1]}' when ({n}) % 10 = 2 then '{ends[2]}' when ({n}) % 10 = 3 then '{ends[3]}' else '{ends[0]}' end)"


_PLACES = f"""{_WITH}, l as (select *, id % 8 shape, user_id % 48 + 1 n, ['Mission', 'Irving', 'Clement'][user_id % 3 + 1] s from obs),
  p as (select *, {_ordinal('n')} o, case shape when 0 then 'intersection' when 1 then 'intersection' when 2 then 'block' when 3 then 'address' when 4 then 'address'
      when 5 then 'unknown' when 6 then 'landmark' else 'intersection' end kind from l),
  q as (select *, case shape when 0 then o || ' St & ' || s || ' St' when 1 then o || ' Ave & ' || s || ' St' when 2 then (100 * (user_id % 9 + 1)) || ' block of ' || s || ' St'
      when 3 then (user_id + 1) || ' ' || s || ' St' when 4 then (user_id + 1) || ' ' || s || ' St' when 5 then '' when 6 then 'General Hospital ' || s
      else o || case when s = 'Mission' then ' St & ' else ' Ave & ' end || s || ' St' end canonical,
      case shape when 2 then 100 * (user_id % 9 + 1) when 3 then user_id + 1 when 4 then user_id + 1 end number from p)"""
_GEO = f"""{_PLACES}, g as (select *, lat is not null own, not (lat is not null) and kind = 'intersection' and shape in (0, 7) and s = 'Mission' and n <= 24 corner,
      lat is null and kind in ('address', 'block') and s = 'Irving' and number % 20 <> 0 and number between 1 and 119 seg from q),
  h as (select *, case when own then 'source_coordinates' when corner then 'intersection_lookup' when seg then 'block_interpolation' else 'unresolved' end as method,
      (number % 20 - 1) / 18.0::double as share from g),
  done as (select *, case when own then lat when corner then 37.7::double + n * 0.001::double when seg then 37.71::double end geo_lat,
      case when own then lng when corner then -122.4::double when seg then -122.41::double - share * 0.01::double end geo_lng from h)"""

ORACLE_SQL = {
    "feed_police": f"""{_WITH} select case when k % 17 <> 0 then id::varchar when k % 19 <> 0 then 'x' || id end as record,
        case when k % 23 <> 0 then {_local('(us // 1000 * 1000)')} end as us, case when k % 3 = 0 then raw_type else 'orig' end as raw_type, case when k % 5 <> 0 then 'label ' || raw_type end as subtype,
        case when k % 4 = 0 then 'A' else 'C' end as priority, sensitive = 1 as sensitive, lat, lng, neighborhood,
        cast(4 + (k % 3 = 0)::int + (k % 5 <> 0)::int + (k % 4 = 0)::int + (k % 2 = 0)::int as bigint) as n_metadata, {_local('(us // 1000 * 1000 + 1800000000)')} as published_us,
        case when k % 17 = 0 and k % 19 = 0 then 'record has neither cad_number nor id' when k % 23 = 0 then 'received_datetime missing or unparseable' end as rejected from obs""",
    "feed_fire_calls": f"""with r as (select *, case when l_linenumber % 3 = 0 or l_orderkey % 5 = 0 then 'sf_ems_cad' else 'sf_fire_cad' end as source,
          epoch_us(l_shipdate::timestamp) + l_linenumber * {HOUR} as t0 from lineitem where l_linenumber < 7)
        select source, l_orderkey::varchar as call, min({_local('t0')}) as us, array_to_string(list_sort(list(distinct 'E' || (l_suppkey % 50))), ',') as units,
          case when l_orderkey % 5 = 0 then 'Medical Incident' else 'Alarms' end as raw_type, arg_min(case when l_linenumber = 2 then '3' else '2' end, l_linenumber) as priority,
          arg_min('ADDR ' || l_partkey, l_linenumber::bigint * 1000000000 + l_partkey) filter (where l_linenumber % 2 = 0) as location_raw, count(distinct l_suppkey % 50)::varchar as unit_count
        from r group by source, l_orderkey""",
    "stored_ingest": f"""with r as (select *, case when l_linenumber % 3 = 0 or l_orderkey % 5 = 0 then 'sf_ems_cad' else 'sf_fire_cad' end as source,
          epoch_us(l_shipdate::timestamp) + l_linenumber * {HOUR} as t0 from lineitem where l_linenumber < 7)
        select source, l_orderkey::varchar as call, min({_local('t0')}) as us, array_to_string(list_sort(list(distinct 'E' || (l_suppkey % 50))), ',') as units,
          case when l_orderkey % 5 = 0 then 'Medical Incident' else 'Alarms' end as raw_type, arg_min(case when l_linenumber = 2 then '3' else '2' end, l_linenumber) as priority,
          arg_min('ADDR ' || l_partkey, l_linenumber::bigint * 1000000000 + l_partkey) filter (where l_linenumber % 2 = 0) as location_raw, count(distinct l_suppkey % 50)::varchar as unit_count,
          case when min(l_linenumber) > 3 then 'created' when max(l_linenumber) < 3 then 'untouched' when max(l_linenumber) > 3 then 'updated' else 'unchanged' end as outcome
        from r group by source, l_orderkey""",
    "stored_reports": """with o as (select o_orderkey as k, k % 2 = 0 as s, k % 3 <> 0 as n, o_orderpriority as p, 'N' || (o_custkey % 41) as area from orders where k % 2 = 0 or k % 3 <> 0),
        m as (select *, case when n and k % 7 = 0 then null else p end as subtype, case when n and k % 4 = 0 then 'N99' when s then area end as neighborhood, case when n and k % 5 = 0 then 37.8::double when s then 37.75::double end as lat,
          case when n and k % 8 = 0 then 'c' else 'b' end as a from o),
        w as (select *, case when not s then 'created' when not n then 'untouched' when subtype is distinct from p or neighborhood is distinct from area or lat is distinct from 37.75::double or a <> 'b' then 'updated' else 'unchanged' end as outcome from m)
        select k::varchar as source_record_id, subtype, case when s then 'theft' else 'other' end as type, neighborhood, lat, case when outcome in ('created', 'updated') then '2' else '1' end as as_of, a, outcome from w""",
    "feed_reports": f"""select case when o_orderkey % 13 <> 0 then o_orderkey::varchar end as record, case when o_orderkey % 7 <> 0 then {_local('epoch_us(o_orderdate::timestamp)')} end as us,
        case o_custkey % 5 when 0 then 'theft' when 1 then 'assault' when 2 then 'fire' end as type, case when o_orderkey % 3 <> 0 and o_orderkey % 2 = 0 then 37.75::double end as lat,
        case when o_orderkey % 3 <> 0 and o_orderkey % 2 = 0 then -122.41::double end as lng,
        cast(1 + (o_orderkey % 3 = 0)::int + (o_custkey % 5 <> 4)::int as bigint) as n_metadata,
        case when o_orderkey % 13 = 0 then 'report has no row_id' when o_orderkey % 7 = 0 then 'incident_datetime missing or unparseable' end as rejected from orders""",
    "feed_dropped_fields": """select * from (select 'suspect' as field, count_if(o_orderkey % 2 = 0) as records from orders union all select 'remarks', count_if(o_orderkey % 5 = 0) from orders) where records > 0""",
    "feed_pages": f"""{_WITH}, r as (select us, id, cast(floor((row_number() over (order by us, id) - 1) / 1000) as bigint) as page from obs
          where us >= {NOW - 7 * DAY - 120_000_000} and (us > {NOW - 7 * DAY - 60_000_000} or (us = {NOW - 7 * DAY - 60_000_000} and id > 0)))
        select page, count(*) as records, max(us) as last_us, arg_max(id, (us, id)) as last_id from r group by page""",
    "local_times": f"""with r as (select o_orderkey as id, epoch_us(o_orderdate::timestamp) + (o_orderkey % 24) * {HOUR} + {HOUR // 2} as t0 from orders),
        s as (select id, t0, {_local('t0')} as us from r)
        select id, us, t0 as zoned_us, cast({_off('us')} / {HOUR} as int) as offset_hours, strftime(make_timestamp(us + {_off('us')}), '%Y-%m-%dT%H:%M:%S.000') as back from s""",
    "told_times": f"""{_WITH}, g as (select id, {NOW} - us as gap, (id * 7919) % 9000 - 1 as took from obs), m as (select *, cast(floor(abs(gap) / 60000000.0 + 0.5) as bigint) as mins from g),
        h as (select *, cast(floor(mins / 60.0 + 0.5) as bigint) as hours from m), d as (select *, cast(floor(hours / 24.0 + 0.5) as bigint) as days from h), w as (select *, cast(floor(days / 7.0 + 0.5) as bigint) as weeks from d),
        v as (select *, case when mins < 60 then mins || ' min' when hours < 24 then hours || ' h' when days < 14 then days || ' d' when weeks < 9 then weeks || ' w' else cast(floor(days / 30.0 + 0.5) as bigint) || ' mo' end as value from w)
        select id, case when mins < 1 then 'just now' when gap < 0 then 'in ' || value else value || ' ago' end as told,
          case when took < 0 then null when took < 60 then took || ' s' when took % 60 = 0 then (took // 60) || ' min' else (took // 60) || ' min ' || (took % 60) || ' s' end as took from v""",
    "numeric_windows": f"""{_WITH}, w as (select id, id % 6 shape, cast(user_id % 9 + 1 as int) n from obs)
        select id, case shape when 0 then n * 60 when 1 then n * 1440 when 2 then n * 10080 when 3 then 43200 end as minutes,
          case shape when 0 then 'the last ' || n || ' hour' || case when n = 1 then '' else 's' end when 1 then 'the last ' || n || ' day' || case when n = 1 then '' else 's' end
            when 2 then 'the last ' || n || ' week' || case when n = 1 then '' else 's' end when 3 then 'the last month' end as label from w""",
    "normalize_locations": f"""{_PLACES} select id, kind, canonical, case kind when 'intersection' then 2 when 'block' then 1 when 'address' then 1 else 0 end as n_streets,
        cast(number as int) as number, case shape when 0 then 0.95 when 1 then 0.95 when 7 then 0.95 when 4 then 0.8 when 5 then 0.0 when 6 then 0.5 else 0.9 end::double as confidence from q""",
    "street_names": f"""{_WITH}, names as (select distinct case user_id % 4 when 0 then 'IRVING ST \\ ' || {_ordinal('user_id % 48 + 1', True)} || ' AVE' when 1 then 'CLEMENT ST \\ 0' || {_ordinal('user_id % 48 + 1', True)} || ' AVE'
            when 2 then 'MISSION ST \\ ' || {_ordinal('user_id % 48 + 1', True)} || ' ST' else 'BROADWAY \\ OAK ' || case when id % 2 = 0 then 'ST' else 'WAY' end end as name from obs),
        parts as (select name, unnest(string_split(name, ' \\ ')) as part from names),
        split as (select *, regexp_extract(part, ' (ST|AVE|WAY)$', 1) as said, ltrim(regexp_replace(part, ' (ST|AVE|WAY)$', ''), '0') as base from parts),
        marked as (select *, max(regexp_matches(base, '^[0-9]') and said = 'AVE') over (partition by name) as avenue from split),
        counted as (select base as name, case said when 'ST' then 'St' when 'AVE' then 'Ave' when 'WAY' then 'Way' end as suffix, count(*) as n, count_if(avenue and not regexp_matches(base, '^[0-9]')) as corners from marked group by 1, 2)
        select name, case when max(n) filter (where suffix is not null) >= 0.8 * sum(n) filter (where suffix is not null) then arg_max(suffix, (n, suffix)) filter (where suffix is not null) end as suffix,
          coalesce(max(n) filter (where suffix is not null) < 0.8 * sum(n) filter (where suffix is not null), false) as ambiguous, sum(corners) >= 5 as crosses_avenue from counted group by name""",
    "geocode_cascade": f"""{_GEO} select id, round(geo_lat, 9) as lat, round(geo_lng, 6) as lng,
        coalesce(case when k % 5 = 0 then neighborhood end, case when seg and not own and number < 20 then 'First' end, case when geo_lng is null then null when geo_lng < -122.45 then 'West' else 'East' end) as area,
        method, case method when 'source_coordinates' then 0.95 when 'intersection_lookup' then 0.9 when 'block_interpolation' then 0.6 else 0.0 end::double as confidence,
        case when method = 'unresolved' then case kind when 'unknown' then 'unparseable_location_text' when 'intersection' then 'intersection_not_in_gazetteer' else 'no_matching_street_segment' end end as reason from done""",
    "geocode_report": f"{_GEO} select source, method, count(*) as records, count(geo_lat) as located, count_if(sensitive = 0) as locatable from done group by all",
    "agreed_points": f"""{_WITH}, p as (select neighborhood as canonical, floor(lat * 10000 + 0.5) / 10000 as lat, floor(lng * 10000 + 0.5) / 10000 as lng, count(*) as records
          from obs where neighborhood is not null and lat is not null group by all)
        select canonical, lat, lng, records from p qualify row_number() over (partition by canonical order by records desc, lat desc, lng desc) = 1""",
    "classify_types": f"""{_WITH}, m as (select id, source, raw_type, case when source = 'sf_police_cad' and raw_type = 'error' then 1 when source = 'sf_police_cad' and raw_type = 'view' then 2 when source = 'sf_police_cad' then 3
            when source = 'sf_fire_cad' and raw_type = 'click' then 4 when source = 'sf_fire_cad' and raw_type in ('purchase', 'view') then 5 else 6 end as r from obs)
        select id, ['collision', 'assault', 'disturbance', 'medical', 'theft', 'unknown'][r] as type, case r when 2 then 'view' when 4 then 'aid' end as subtype, case r when 1 then 'high' when 3 then 'low' end as severity,
          [0.9, 0.6, 0.5, 0.8, 0.55, 0.2][r]::double as type_confidence, case when r in (1, 4) then 'code' when r = 6 then 'unmapped' else 'pattern' end as matched_by from m""",
    "priority_ranks": f"""{_WITH}, c as (select id, source, ['A', 'B', 'C', '3', 'E', 'ZZ', '1'][k % 7 + 1] as code from obs)
        select id, cast(case when source = 'sf_police_cad' then case code when 'A' then 1 when 'B' then 2 when 'C' then 4 end
          else case code when 'E' then 1 when '3' then 2 when '1' then 4 when 'A' then 2 when 'B' then 3 end end as int) as rank from c""",
}
