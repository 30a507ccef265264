"""Incidents, their members and their history as queries, with their SQL forms.

Here an incident is a user's calls of a day: a grouping that SQL can state, with
the columns that the correlation's incidents have.  The correlation itself is in
:mod:`pulsegrid.plans.incidents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators import evaluation, near_blocks, registry, scoring, timeline
from pulsegrid.operators.range_join import MINUTE, counts_elsewhere, near_in_time
from pulsegrid.plans import feeds as feed_plans
from pulsegrid.plans.analytics import DAY, HOUR, NOW, _WITH, conditions
from pulsegrid.plans.incidents import _SCORED, _candidates
from pulsegrid.session import table
from pulsegrid.sources import feeds
from pulsegrid.sources.observations import DISPATCH_SOURCES, observations


def incident_of_call() -> Column:
    """The incident of an observation: its user's day."""
    return F.concat_ws("-", "user_id", F.floor(F.col("us") / DAY))


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.element_at(F.array(F.lit(None).cast("string"), F.lit("low"), F.lit("high"), F.lit("critical")), (F.col("k") % 4 + 1).cast("int"))
    rows = observations(spark, sf_dir)
    return rows.select(
        incident_of_call().alias("incident_id"), F.col("id").alias("observation_id"), "us", "source", "type", severity.alias("severity"), "units",
        F.when(F.col("k") % 3 == 0, F.concat(F.lit("L"), F.col("user_id") % 12)).alias("location"), "neighborhood", "k",
    )


def _incidents(members: DataFrame) -> DataFrame:
    """One row per incident; sets are small, as agencies are few and units come from its calls of one day."""
    order = F.struct("us", "observation_id")
    first = F.min_by("type", F.when(F.col("type") != "unknown", order))
    return members.groupBy("incident_id").agg(
        F.coalesce(first, F.lit("unknown")).alias("primary_type"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count("*").alias("source_count"),
        F.count_distinct(timeline.dispatch_agency(F.col("source"))).alias("agencies"), F.count_distinct(F.get("units", F.lit(0))).alias("n_units"),
    )


def incident_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.timeline(_members(spark, sf_dir))


def incident_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The incident before and after each call."""
    done = timeline.incident_states(_members(spark, sf_dir))
    return done.select("observation_id", "n", F.array_join("new_units", ",").alias("new_units"), F.array_join("new_agencies", ",").alias("new_agencies"), "type_before", "type_after", "severity_before", "severity_after")


def incident_of_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every call with its incident, as a lookup of one call reads it."""
    members = _members(spark, sf_dir)
    return members.select("observation_id", "incident_id").join(_incidents(members), "incident_id")


def incident_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One incident and its calls in order."""
    members = _members(spark, sf_dir).where("incident_id = '3-19740'")
    return members.join(_incidents(members), "incident_id").select("incident_id", "observation_id", "us", "source", "primary_type", "source_count")


def observation_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).where("id = 77").select("id", "source", "us", "type", "neighborhood", "lat", "lng")


def incidents_of_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents behind the collisions of two areas: how many calls of each matched, and when the last did."""
    members = _members(spark, sf_dir)
    met = members.where(conditions(areas=("N3", "N4"), types=("collision",)))
    found = met.groupBy("incident_id").agg(F.count("*").alias("matched"), F.max("us").alias("matched_us"))
    return _incidents(members).join(found, "incident_id").select("incident_id", "matched", "matched_us", "source_count", "primary_type")


def incident_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many incidents the calls of a filter belong to."""
    met = _members(spark, sf_dir).where(conditions(since=NOW - 7 * DAY, until=NOW, types=("theft",)))
    return met.agg(F.count_distinct("incident_id").alias("incidents"))


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = near_blocks.best_of_other_sources(observations(spark, sf_dir))
    return best.select("id", F.col("o_id").alias("other"), "score", scoring.decision(F.col("score")).alias("decision"))


def near_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probable matches under both incidents they touch: that of the call and that of its candidate."""
    members = _members(spark, sf_dir).select("observation_id", "incident_id")
    probable = _decided(spark, sf_dir).where("decision = 'probable'").select(F.explode(F.array_distinct(F.array("id", "other"))).alias("observation_id"), "id", F.round("score", 6).alias("score"))
    return probable.join(members, "observation_id").select("incident_id", F.col("id").alias("observation_id"), "score").distinct()


def decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).groupBy("decision").agg(F.count("*").alias("calls"))


def earliest_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).where(F.col("source").isin(*DISPATCH_SOURCES)).agg(F.min("us").alias("us"))


def corner_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls at a corner over ten days and the ten before."""
    rows = observations(spark, sf_dir).where(F.col("lat").isNotNull() & (F.col("us") >= NOW - 20 * DAY) & (F.col("us") < NOW))
    late = F.col("us") >= NOW - 10 * DAY
    return rows.groupBy(F.round("lat", 4).alias("lat"), F.round("lng", 4).alias("lng")).agg(F.count_if(late).alias("total"), F.count_if(~late).alias("earlier"))


def _sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(F.concat(F.lit("e-0"), F.col("user_id") % 20), F.concat(F.lit("3a"), F.col("user_id") % 20), F.concat(F.lit("QX"), F.col("user_id") % 20, F.lit("B")), F.lit("--")), (F.col("id") % 4 + 1).cast("int"))
    return observations(spark, sf_dir).select(name.alias("unit"), "us", F.when(F.col("k") % 20 == 0, "private").alias("unit_type"), F.when(F.col("k") % 2 == 0, F.lit("sf_fire_cad")).alias("source"))


def unit_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.unit_registry(_sightings(spark, sf_dir))


def incident_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.incident_units(_members(spark, sf_dir))


def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types and areas there are, with how often."""
    rows = observations(spark, sf_dir)
    both = F.array(F.struct(F.lit("type").alias("field"), F.col("type").alias("value")), F.struct(F.lit("neighborhood").alias("field"), F.col("neighborhood").alias("value")))
    return rows.select(F.inline(both)).where("value is not null").groupBy("field", "value").agg(F.count("*").alias("calls"))


def map_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 3,000 most recent located calls, a top-k report."""
    return observations(spark, sf_dir).where("lat is not null").select("id", "us", "lat", "lng", "source", "type").orderBy(F.desc("us"), "id").limit(3000)


def payload_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of payloads against those that are stored."""
    rows = observations(spark, sf_dir).select("source", F.col("user_id").alias("source_record_id"), F.col("type").alias("payload_hash"), F.col("us").alias("fetched_us"), "id")
    done = registry.store_payloads(rows.where("id % 3 = 0 and id % 5 < 2"), rows.where("id % 5 >= 2"))
    return done.groupBy("source", "outcome").agg(F.count("*").alias("payloads"))


def quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Police records that cannot be mapped, one row a content."""
    feed = feed_plans.police_feed(spark, sf_dir)
    done = feeds.police_observations(feed)
    rows = done.select("source", F.coalesce("raw_type", F.lit("")).alias("payload_hash"), F.col("rejected").alias("reason"), F.col("fetched_us").alias("us"))
    return registry.quarantine(rows)


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).select("id", "type", "neighborhood")
    found = rows.where("id % 2 = 0").select("id", F.when(F.col("id") % 4 == 0, "fire").alias("type"), F.lit("N0").alias("neighborhood"))
    return registry.enrich(rows, found, "id", ["type", "neighborhood"])


def _polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = observations(spark, sf_dir).where(F.col("us") <= NOW).groupBy("source").agg(F.max("us").alias("last_success_us"))
    idle = spark.range(1).select(F.lit("radio").alias("source"), F.lit(None).cast("long").alias("last_success_us"))
    late = spark.range(1).select(F.lit("news").alias("source"), F.lit(NOW - 3 * DAY).alias("last_success_us"))
    return last.unionByName(idle).unionByName(late).withColumn("poll_seconds", F.lit(300))


def open_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silent sources as of NOW, and what two days later can still be filled."""
    gaps = registry.open_gaps(_polls(spark, sf_dir), NOW)
    return gaps.withColumn("s", registry.gap_state(F.col("from_us"), F.col("to_us"), F.lit(NOW + 20 * HOUR))).select("source", "from_us", "to_us", "note", "s.*")


def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.health(_polls(spark, sf_dir), NOW)


def _metadata() -> Column:
    at = lambda m, hours: F.when(F.col("k") % m == 0, F.date_format(F.timestamp_micros(F.col("us") + hours * HOUR), "yyyy-MM-dd'T'HH:mm:ss.SSS"))
    fields = {
        "received_datetime": F.when(F.col("k") % 11 != 0, F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss.SSS")), "dispatch_dttm": at(2, 1),
        "onscene_datetime": at(3, 2), "close_datetime": at(7, 3), "disposition": F.when(F.col("k") % 14 == 0, " goa ").when(F.col("k") % 21 == 0, "HAN"),
        "onview_flag": F.when(F.col("k") % 5 == 0, "Y"), "number_of_alarms": F.when(F.col("k") % 9 == 0, "3"), "battalion": F.when(F.col("k") % 4 == 0, "B02"),
        "station_area": F.when(F.col("k") % 8 == 0, "13"), "supervisor_district": F.lit("5.0"), "call_type_group": F.when(F.col("k") % 6 == 0, "Potentially Life-Threatening"),
    }
    pairs = F.create_map(*[x for name, value in fields.items() for x in (F.lit(name), value)])
    return F.map_filter(pairs, lambda k, v: v.isNotNull())


def status_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of each call's record against a status so far, with the reason and timeline entry."""
    now = F.element_at(F.array(*map(F.lit, ("unknown", "reported", "dispatched", "active", "resolved"))), (F.col("user_id") % 5 + 1).cast("int"))
    rows = observations(spark, sf_dir).select("id", now.alias("was"), timeline.signals(_metadata()).alias("s"))
    rows = rows.withColumn("d", timeline.status_decision(F.col("was"), F.col("s")))
    return rows.select("id", "was", F.col("d.status").alias("status"), F.col("d.reason").alias("reason"), F.col("d.resolved_us").alias("resolved_us"), F.col("d.kept").alias("kept"), timeline.status_entry(F.col("d"))["kind"].alias("kind"))


def record_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).select("id", timeline.record_facts(_metadata()).alias("f"))
    told = F.array_join(F.transform("f", lambda f: F.concat(f["label"], F.lit(": "), f["value"], F.when(f["notable"], "!").otherwise(""))), "; ")
    return rows.select("id", told.alias("facts"))


def scene_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dispatch to scene of every fire call, by its first unit there."""
    n, order = F.col("l_linenumber"), F.col("l_orderkey")
    stamp = lambda minutes: F.date_format(F.timestamp_micros(F.lit(NOW) + minutes * MINUTE), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    times = F.struct(stamp(order % 50).alias("dispatch"), F.lit(None).cast("string").alias("response"), F.when(n % 2 == 1, stamp(order % 50 + n * 3)).alias("on_scene"), F.lit(None).cast("string").alias("available"), F.lit("ENGINE").alias("unit_type"))
    units = table(spark, sf_dir, "lineitem").groupBy(order.alias("id")).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct(F.concat(F.lit("U"), n).alias("unit"), times.alias("t"))))).alias("unit_times"))
    return timeline.scene_time(units.withColumn("metadata", F.create_map().cast("map<string,string>")))


def report_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    kind = F.element_at(F.array(F.lit("Coplogic Initial"), F.lit("Initial Supplement"), F.lit("Vehicle Initial"), F.lit(None).cast("string")), (key % 4 + 1).cast("int"))
    fields = F.create_map(F.lit("report_type_description"), kind, F.lit("incident_description"), F.when(key % 3 == 0, "Theft, from car"), F.lit("incident_category"), F.when(key % 5 != 0, "Larceny"), F.lit("resolution"), F.when(key % 2 == 0, "Open"))
    return table(spark, sf_dir, "orders").select(key.alias("id"), timeline.report_text(fields).alias("text"))


def report_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as reports that name orders as calls: outcome, incident and lag."""
    items = table(spark, sf_dir, "lineitem")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    call = F.when(F.col("l_suppkey") % 10 != 0, F.concat(F.when(F.col("l_linenumber") == 7, "x").otherwise(""), "l_orderkey"))
    reports = items.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), call.alias("call"), micros("l_shipdate").alias("reported_us"), (F.col("l_linenumber") == 5).alias("attached"))
    calls = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("call"), F.concat(F.lit("inc_"), "o_orderkey").alias("incident_id"), micros("o_orderdate").alias("first_us"))
    return timeline.join_reports(reports, calls).select("id", "outcome", "incident_id", "lag_days")


def truth_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fire and medical rows of one call number: pairs known to be one event."""
    rows = observations(spark, sf_dir).select("id", "us", "source", F.floor(F.col("id") / 3).alias("call"))
    fire, ems = rows.where("source = 'sf_fire_cad'"), rows.where("source = 'sf_ems_cad'").select("call", F.col("id").alias("ems"), F.col("us").alias("ems_us"))
    return fire.join(ems, "call").select(F.col("id").alias("fire"), "ems", (F.abs(F.col("us") - F.col("ems_us")) <= 20 * MINUTE).alias("close"))


def _at_corner(spark: SparkSession, sf_dir: str, ahead: int) -> DataFrame:
    corner = F.concat_ws("/", F.round("lat", 4), F.round("lng", 4))
    rows = observations(spark, sf_dir).where("lat is not null").select("id", "us", "source", "type", corner.alias("corner"))
    met = near_in_time(rows, rows, 0, ahead, ("corner",))
    return met.where("source <> o_source and o_us > us").withColumn("gap", F.col("o_us") - F.col("us"))


def corner_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sources at one corner, the second within 20 minutes: at most three of each pair of types, the latest."""
    met = _at_corner(spark, sf_dir, 20 * MINUTE)
    return evaluation.shape_cap(met.select(F.col("id").alias("a"), F.col("o_id").alias("b"), "us", F.concat_ws("|", "type", "o_type").alias("shape")), 3).select("a", "b", "shape")


def apart_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sources at one corner 45 to 240 minutes apart, by pair of types."""
    met = _at_corner(spark, sf_dir, 240 * MINUTE).where(F.col("gap") >= 45 * MINUTE)
    return met.groupBy("type", "o_type").agg(F.count("*").alias("pairs"), F.min("gap").alias("least_gap"))


def elsewhere_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every located call, how many of other sources in other areas are within three minutes."""
    rows = observations(spark, sf_dir).where("lat is not null and neighborhood is not null").select("id", "us", "source", "neighborhood")
    return counts_elsewhere(rows, "id", ("source", "neighborhood"), 3 * MINUTE, 3 * MINUTE)


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as labelled cases: line items are observations, a return flag per order says whether they belong together."""
    items = table(spark, sf_dir, "lineitem")
    label = F.when(F.col("l_orderkey") % 3 == 0, "different").otherwise("same")
    return items.select(F.col("l_orderkey").alias("case"), label.alias("label"), F.col("l_linenumber").alias("observation"), F.when(F.col("l_orderkey") % 4 == 0, F.lit(0)).otherwise(F.col("l_suppkey") % 2).alias("incident"))


def evaluation_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.case_outcomes(_cases(spark, sf_dir))


def evaluation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = evaluation.metrics(evaluation.case_outcomes(_cases(spark, sf_dir)))
    return done.select("cases", "cases_correct", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"), F.round("f1", 9).alias("f1"), "false_merges", "missed_merges", "split_cases")


def evaluation_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights and thresholds over candidate pairs, of which those of one type are taken to be the same event."""
    pairs = scoring.score_pairs(_candidates(observations(spark, sf_dir)))
    rows = pairs.select(F.when(F.col("type") == F.col("o_type"), "same").otherwise("different").alias("label"), "s_location", "s_time", "s_type", "s_units")
    done = evaluation.sweep(rows)
    return done.select("weights", "threshold", "tp", "fp", "fn", F.round("f1", 6).alias("f1"))


def replay_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a replay grouped: incidents, those of several calls, and of several agencies."""
    made = _incidents(_members(spark, sf_dir))
    return made.agg(F.count("*").alias("incidents"), F.count_if(F.col("source_count") > 1).alias("multi_source"), F.count_if(F.col("agencies") > 1).alias("cross_agency"), F.sum("source_count").alias("observations"))


QUERIES = {
    f.__name__: f
    for f in (
        incident_timeline, incident_states, incident_of_observation, incident_by_id, observation_by_id, incidents_of_search, incident_total, near_misses, decision_counts,
        earliest_dispatch, corner_totals, unit_registry, incident_units, distinct_values, map_points, payload_outcomes, quarantined, enriched, open_gaps, source_health,
        status_decisions, record_facts, scene_times, report_texts, report_lag, truth_pairs, corner_pairs, apart_pairs, elsewhere_calls, evaluation_outcomes,
        evaluation_metrics, evaluation_sweep, replay_summary,
    )
}

_AGENCY = "case source when 'sf_police_cad' then 'police' when 'sf_fire_cad' then 'fire' else 'ems' end"
_LABEL = "case source when 'sf_police_cad' then 'Police' when 'sf_fire_cad' then 'Fire' else 'EMS' end"
_MEMBERS = f"""{_WITH}, m as (select user_id || '-' || cast(floor(us / {DAY}.0) as bigint) as incident_id, id as observation_id, us, source, type, [null, 'low', 'high', 'critical'][k % 4 + 1] as severity,
    units[1] as unit, case when k % 3 = 0 then 'L' || (user_id % 12) end as location, neighborhood, k from obs),
  inc as (select incident_id, coalesce(arg_min(type, (us, observation_id)) filter (where type <> 'unknown'), 'unknown') as primary_type, min(us) as first_us, max(us) as last_us, count(*) as source_count,
    count(distinct source) as agencies, count(distinct unit) as n_units from m group by incident_id)"""
_STATES = f"""{_MEMBERS}, r as (select *, {_AGENCY} as agency, case severity when 'low' then 0 when 'high' then 2 when 'critical' then 3 else -1 end as rank from m),
  s as (select *, row_number() over w as n, unit is not null and row_number() over (partition by incident_id, unit order by us, observation_id) = 1 as new_unit,
      row_number() over (partition by incident_id, agency order by us, observation_id) = 1 as new_agency,
      coalesce(first_value(case when type <> 'unknown' then type end ignore nulls) over (w rows between unbounded preceding and 1 preceding), 'unknown') as type_before,
      coalesce(first_value(case when type <> 'unknown' then type end ignore nulls) over (w rows between unbounded preceding and current row), 'unknown') as type_after,
      coalesce(max(rank) over (w rows between unbounded preceding and 1 preceding), -1) as rank_before, max(rank) over (w rows between unbounded preceding and current row) as rank_after,
      coalesce(count(unit) over (w rows between unbounded preceding and 1 preceding), 0) > 0 as had_units
    from r window w as (partition by incident_id order by us, observation_id)),
  t as (select *, ['low', 'moderate', 'high', 'critical'][nullif(rank_before, -1) + 1] as severity_before, ['low', 'moderate', 'high', 'critical'][nullif(rank_after, -1) + 1] as severity_after from s)"""
_TYPE = lambda c: f"upper({c}[1]) || {c}[2:]"
_SIGNALS = f"""{_WITH}, s as (select id, user_id, k, us, ['unknown', 'reported', 'dispatched', 'active', 'resolved'][user_id % 5 + 1] was,
    case when k % 7 = 0 then 'resolved' when k % 3 = 0 then 'active' when k % 2 = 0 then 'dispatched' when k % 11 <> 0 then 'reported' else 'unknown' end said,
    case when k % 14 = 0 then 'goa' when k % 21 = 0 then 'HAN' end as disposition from obs),
  p as (select *, list_position(['unknown', 'reported', 'dispatched', 'active', 'resolved'], was) a, list_position(['unknown', 'reported', 'dispatched', 'active', 'resolved'], said) b from s)"""
_CASES = """with c as (select l_orderkey as "case", case when l_orderkey % 3 = 0 then 'different' else 'same' end as label, row_number() over () as o, case when l_orderkey % 4 = 0 then 0 else l_suppkey % 2 end as i from lineitem),
  pairs as (select a."case", count(*) filter (where a.i = b.i) as together, count(*) filter (where a.i <> b.i) as apart from c a join c b on a."case" = b."case" and a.o < b.o group by 1),
  outcomes as (select "case", any_value(label) as label, count(distinct i) as incidents, count(*) as n, coalesce(max(together), 0) as together, coalesce(max(apart), 0) as apart from c left join pairs using ("case") group by 1),
  scored as (select "case", label, incidents, case label when 'same' then incidents = 1 else incidents = n end as correct, case label when 'same' then together else 0 end as tp, case label when 'same' then 0 else together end as fp,
    case label when 'same' then apart else 0 end as fn, case label when 'same' then 0 else apart end as tn from outcomes)"""
_BEST = f"""{_SCORED}, best as (select id, other, raw, case when raw >= 0.85 - 1e-9 then 'merged' when raw >= 0.65 - 1e-9 then 'probable' else 'created' end decision
    from scored qualify row_number() over (partition by id order by raw desc, s_location desc, o_us, other) = 1)"""
_GRID = ", ".join(f"('{name}', {w['location']}, {w['time']}, {w['type']}, {w['units']})" for name, w in evaluation.WEIGHTS.items())

ORACLE_SQL = {
    "incident_timeline": f"""{_STATES} select incident_id, observation_id, us, unnest(list_filter([
          case when n = 1 then {{'kind': 'initial_report', 'text': {_TYPE('type_after')} || ' reported' || coalesce(' at ' || location, '') || ' — first report from ' || {_LABEL} || '.'}} end,
          case when new_unit and not had_units then {{'kind': 'unit_dispatched', 'text': {_LABEL} || ' dispatched ' || unit || '.'}} end,
          case when new_unit and had_units then {{'kind': 'additional_unit', 'text': {_LABEL} || ' added ' || unit || '.'}} end,
          case when n > 1 and new_agency then {{'kind': 'agency_joined', 'text': {_LABEL} || ' joined the response.'}} end,
          case when n > 1 and type_before <> type_after then {{'kind': 'type_changed', 'text': 'Type changed from ' || {_TYPE('type_before')} || ' to ' || {_TYPE('type_after')} || '.'}} end,
          case when n > 1 and rank_after > rank_before then {{'kind': 'escalation', 'text': case when rank_before < 0 then 'Severity assessed as ' || severity_after || '.' else 'Severity raised from ' || severity_before || ' to ' || severity_after || '.' end}} end
        ], lambda x: x is not null), recursive := true) from t""",
    "incident_states": f"""{_STATES} select observation_id, n, case when new_unit then unit else '' end as new_units, case when new_agency then agency else '' end as new_agencies, type_before, type_after, severity_before, severity_after from t""",
    "incident_of_observation": f"{_MEMBERS} select observation_id, inc.* from m join inc using (incident_id)",
    "incident_by_id": f"{_MEMBERS} select incident_id, observation_id, us, source, primary_type, source_count from m join inc using (incident_id) where incident_id = '3-19740'",
    "observation_by_id": f"{_WITH} select id, source, us, type, neighborhood, lat, lng from obs where id = 77",
    "incidents_of_search": f"""{_MEMBERS} select incident_id, count(*) as matched, max(m.us) as matched_us, any_value(source_count) as source_count, any_value(primary_type) as primary_type
        from m join inc using (incident_id) where neighborhood in ('N3', 'N4') and type = 'collision' group by incident_id""",
    "incident_total": f"{_MEMBERS} select count(distinct incident_id) as incidents from m where type = 'theft' and us >= {NOW - 7 * DAY} and us < {NOW}",
    "near_misses": f"""{_BEST}, mm as (select id as observation_id, user_id || '-' || cast(floor(us / {DAY}.0) as bigint) as incident_id from obs)
        select distinct incident_id, b.id as observation_id, round(raw, 6) as score from best b join mm on mm.observation_id = b.id or mm.observation_id = b.other where decision = 'probable'""",
    "decision_counts": f"{_BEST} select decision, count(*) as calls from best group by 1",
    "earliest_dispatch": f"{_WITH} select min(us) as us from obs where source like 'sf_%_cad'",
    "corner_totals": f"""{_WITH} select round(lat, 4) as lat, round(lng, 4) as lng, count_if(us >= {NOW - 10 * DAY}) as total, count_if(us < {NOW - 10 * DAY}) as earlier from obs
        where lat is not null and us >= {NOW - 20 * DAY} and us < {NOW} group by 1, 2""",
    "unit_registry": f"""{_WITH}, s as (select us, cast(id % 4 as int) q, user_id % 20 n, k % 20 = 0 hinted, k % 2 = 0 fire from obs where id % 4 <> 3),
        u as (select us, case q when 0 then 'E0' || n when 1 then '3A' || n else 'QX' || n || 'B' end as designator, case when q = 1 and not fire then 'police' when hinted then 'ems' when q = 0 then 'fire' else 'other' end as agency,
          case when q = 1 and not fire then 'patrol' when hinted then 'ambulance' when q = 0 then 'engine' else 'unknown' end as kind from s)
        select designator, coalesce(arg_min(agency, (us, kind)) filter (where agency <> 'other'), 'other') as agency, coalesce(arg_min(kind, (us, kind)) filter (where kind <> 'unknown'), 'unknown') as kind,
          min(us) as first_us, max(us) as last_us, count(*) as sightings from u group by designator""",
    "incident_units": f"{_MEMBERS} select incident_id, unit as designator, min(us) as first_us, max(us) as last_us from m where unit is not null group by all",
    "distinct_values": f"""{_WITH} select 'type' as field, type as value, count(*) as calls from obs group by all union all select 'neighborhood', neighborhood, count(*) from obs where neighborhood is not null group by all""",
    "map_points": f"{_WITH} select id, us, lat, lng, source, type from obs where lat is not null order by us desc, id limit 3000",
    "payload_outcomes": f"""{_WITH}, b as (select *, us = min(us) over (partition by source, user_id, type) as first from obs where id % 5 >= 2), s as (select distinct source, user_id, type from obs where id % 3 = 0 and id % 5 < 2)
        select source, case when s.type is null and first then 'stored' else 'known' end as outcome, count(*) as payloads from b left join s using (source, user_id, type) group by all""",
    "quarantined": f"""{_WITH}, r as (select 'sf_police_cad' as source, case when k % 3 = 0 then raw_type else 'orig' end as payload_hash,
          case when k % 17 = 0 and k % 19 = 0 then 'record has neither cad_number nor id' when k % 23 = 0 then 'received_datetime missing or unparseable' end as reason, us from obs)
        select source, payload_hash, arg_min(reason, (us, reason)) as reason, min(us) as first_us, count(*) as times from r where reason is not null group by source, payload_hash""",
    "enriched": f"{_WITH} select id, case when id % 4 = 0 then 'fire' else type end as type, case when id % 2 = 0 then 'N0' else neighborhood end as neighborhood from obs",
    "open_gaps": f"""{_WITH}, p as (select source, max(us) as last_us from obs where us <= {NOW} group by source union all select 'radio', null union all select 'news', {NOW - 3 * DAY}), g as (select *, {NOW} - last_us as silent from p where {NOW} - last_us > 900000000)
        select source, last_us as from_us, {NOW}::bigint as to_us, 'no successful poll for ' || cast(floor(silent / 1000000.0 + 0.5) as bigint) || 's' as note, silent + {20 * HOUR} <= {40 * HOUR} as live, false as archived, silent + {20 * HOUR} > {64 * HOUR} as lost from g""",
    "source_health": f"""{_WITH}, p as (select source, max(us) as last_us from obs where us <= {NOW} group by source union all select 'radio', null union all select 'news', {NOW - 3 * DAY})
        select source, case when last_us is null then 'never' when {NOW} - last_us > 900000000 then 'stale' else 'ok' end as state from p""",
    "status_decisions": f"""{_SIGNALS}, d as (select *, case when said = 'unknown' and was <> 'unknown' then 1 when b > 1 and a > b then 2 else 0 end as hold from p)
        select id, was, case when hold > 0 then was else said end as status, case when hold = 1 then 'kept ' || was || ': this record carried no lifecycle timestamps'
            when hold = 2 then 'kept ' || was || ': a later record reported only "' || said || '", which is not evidence the event went backwards'
            when said = 'resolved' then case when disposition = 'goa' then 'closed by the agency with disposition goa — nothing found' else 'closed by the agency' || coalesce(' with disposition ' || disposition, '') end
            when said = 'active' then 'a unit reported on scene' when said = 'dispatched' then 'units were dispatched' when said = 'reported' then 'the call was received' else 'no lifecycle timestamps on this record' end as reason,
          case when hold = 0 and said = 'resolved' then {feed_plans._local(f'(us // 1000 * 1000 + {3 * HOUR})')} end as resolved_us, hold > 0 as kept,
          case when (case when hold > 0 then was else said end) = 'resolved' then 'closed' else 'status_changed' end as kind from d""",
    "record_facts": f"""{_SIGNALS} select id, concat_ws('; ', case when k % 5 = 0 then 'how it came in: an officer came across this themselves — it was not phoned in!' end,
          case when k % 6 = 0 then 'call group: Potentially Life-Threatening!' end, case when k % 9 = 0 then 'alarms: 3-alarm response!' end,
          case when k % 4 = 0 then 'station: battalion B02' || case when k % 8 = 0 then ' · station 13' else '' end end, 'supervisor district: 5',
          case disposition when 'goa' then 'outcome: closed with nothing found (goa)!' when 'HAN' then 'outcome: closed as handled at the scene (HAN)' end) as facts from p""",
    "scene_times": f"select l_orderkey as id, min(l_linenumber) filter (where l_linenumber % 2 = 1) * {3 * MINUTE}::bigint as to_scene_us from lineitem group by 1",
    "report_texts": """select o_orderkey as id, 'SFPD filed ' || ['an online-filed initial report', 'a supplement', 'a vehicle report', 'a report'][o_orderkey % 4 + 1] || ': '
        || case when o_orderkey % 3 = 0 then 'Theft, from car' when o_orderkey % 5 <> 0 then 'Larceny' else 'an incident' end || '.' || case when o_orderkey % 2 = 0 then ' Case status: Open.' else '' end as text from orders""",
    "report_lag": f"""select l_orderkey || '-' || l_linenumber as id, case when l_suppkey % 10 = 0 then 'unjoinable' when l_linenumber = 5 then 'already_attached' when l_linenumber = 7 or o_orderkey is null then 'no_matching_call' else 'joined' end as outcome,
        case when l_suppkey % 10 <> 0 and l_linenumber not in (5, 7) and o_orderkey is not null then 'inc_' || o_orderkey end as incident_id,
        case when l_suppkey % 10 <> 0 and l_linenumber not in (5, 7) and o_orderkey is not null then floor((epoch_us(l_shipdate::timestamp) - epoch_us(o_orderdate::timestamp)) / {DAY // 10}.0::double + 0.5) / 10 end as lag_days
        from lineitem left join orders on l_orderkey = o_orderkey""",
    "truth_pairs": f"{_WITH} select f.id as fire, e.id as ems, abs(f.us - e.us) <= {20 * MINUTE} as close from obs f join obs e on f.id // 3 = e.id // 3 where f.source = 'sf_fire_cad' and e.source = 'sf_ems_cad'",
    "corner_pairs": f"""{_WITH} select a.id as a, b.id as b, a.type || '|' || b.type as shape from obs a join obs b on round(a.lat, 4) = round(b.lat, 4) and round(a.lng, 4) = round(b.lng, 4) and b.us > a.us and b.us - a.us <= {20 * MINUTE} and a.source <> b.source
        qualify row_number() over (partition by a.type || '|' || b.type order by a.us desc, a.id, b.id) <= 3""",
    "apart_pairs": f"""{_WITH} select a.type as type, b.type as o_type, count(*) as pairs, min(b.us - a.us) as least_gap from obs a join obs b on round(a.lat, 4) = round(b.lat, 4) and round(a.lng, 4) = round(b.lng, 4)
        and b.us - a.us between {45 * MINUTE} and {240 * MINUTE} and a.source <> b.source group by all""",
    "elsewhere_calls": f"""{_WITH} select a.id as id, count(*) as elsewhere from obs a join obs b on b.us between a.us - {3 * MINUTE} and a.us + {3 * MINUTE} and a.source <> b.source and a.neighborhood <> b.neighborhood
        where a.lat is not null and b.lat is not null group by a.id""",
    "evaluation_outcomes": f"{_CASES} select * from scored",
    "evaluation_metrics": f"""{_CASES}, s as (select count(*) as cases, count_if(correct) as cases_correct, sum(tp) tp, sum(fp) fp, sum(fn) fn, count_if(label = 'same' and incidents > 1) as split_cases from scored),
        r as (select *, case when tp + fp = 0 then 1.0 else tp / (tp + fp) end p, case when tp + fn = 0 then 1.0 else tp / (tp + fn) end r from s)
        select cases, cases_correct, round(p, 9)::double as precision, round(r, 9)::double as recall, round(case when p + r = 0 then 0 else 2 * p * r / (p + r) end, 9)::double as f1, fp::bigint as false_merges, fn::bigint as missed_merges, split_cases from r""",
    "evaluation_sweep": f"""{_SCORED}, u as (select p.*, (select units from obs where id = p.id) as ua, (select units from obs where id = p.other) as ub from parts p), g(weights, wl, wt, wy, wu) as (values {_GRID}), th(threshold) as (values {', '.join(f'({t})' for t in evaluation.THRESHOLDS)}),
        x as (select weights, threshold::double as threshold, type = o_type as same, case when s_type is null then least((wl * s_location + wt * s_time) / (wl + wt), 0.84) else (wl * s_location + wt * s_time + wy * s_type) / (wl + wt + wy) end >= threshold - 1e-9 as said from parts, g, th),
        c as (select weights, threshold, count_if(said and same) tp, count_if(said and not same) fp, count_if(not said and same) fn from x group by all), m as (select *, case when tp + fp = 0 then 1.0 else tp::double / (tp + fp) end p, case when tp + fn = 0 then 1.0 else tp::double / (tp + fn) end r from c)
        select weights, threshold, tp, fp, fn, round(case when p + r = 0 then 0.0 else 2 * p * r / (p + r) end, 6)::double as f1 from m""",
    "replay_summary": f"{_MEMBERS} select count(*) as incidents, count_if(source_count > 1) as multi_source, count_if(agencies > 1) as cross_agency, sum(source_count)::bigint as observations from inc",
}
