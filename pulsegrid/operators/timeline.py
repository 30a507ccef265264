"""What happened to an incident, member by member, and what its records say.

``members``: incident_id, observation_id, us, source, type, severity, units,
location.  Members of an incident are taken in the order of time and id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.times import DAY, elapsed, parse_local
from pulsegrid.operators.lifecycle import RANKS
from pulsegrid.sources.observations import mapped

#: Labels, order of severities, and what a closing code means.
AGENCY_LABELS = {"police": "Police", "fire": "Fire", "ems": "EMS"}
TYPE_LABELS = {
    "fire": "Fire", "medical": "Medical", "collision": "Collision", "assault": "Assault", "weapon": "Weapon", "robbery": "Robbery", "burglary": "Burglary",
    "theft": "Theft", "disturbance": "Disturbance", "missing_person": "Missing Person", "hazard": "Hazard", "rescue": "Rescue", "traffic": "Traffic",
    "public_safety": "Public Safety", "police_activity": "Police Activity",
}
SEVERITIES = ("low", "moderate", "high", "critical")
DISPOSITIONS = {
    "GOA": "nothing_found", "UTL": "nothing_found", "NOM": "nothing_found", "ND": "nothing_found", "REP": "report_taken", "CIT": "enforcement",
    "ARR": "enforcement", "HAN": "handled", "ADV": "handled", "CAN": "nothing_found", "VOI": "nothing_found",
}
OUTCOMES = {
    "nothing_found": "closed with nothing found", "report_taken": "closed with a report taken", "enforcement": "closed with a citation or an arrest",
    "handled": "closed as handled at the scene", "referred": "referred elsewhere", "unknown": "closed without a recorded outcome",
}


def dispatch_agency(source: Column) -> Column:
    return F.coalesce(mapped(source, {"sf_police_cad": "police", "sf_fire_cad": "fire", "sf_ems_cad": "ems"}), F.lit("other"))


def agency_label(agency: Column) -> Column:
    return F.coalesce(mapped(agency, AGENCY_LABELS), F.lit("Another agency"))


def type_label(kind: Column) -> Column:
    return F.coalesce(mapped(kind, TYPE_LABELS), F.lit("Unknown"))


def severity_rank(severity: Column) -> Column:
    """0 to 3 from low to critical; -1 for null and other words."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), severity) - 1, F.lit(-1)).cast("int")


def _first_seen(members: DataFrame, values: Column, name: str) -> DataFrame:
    """``incident_id, observation_id, <name>``: the values each member is the first of its incident to have, in order."""
    flat = members.select("incident_id", F.struct("us", "observation_id").alias("at"), F.explode(values).alias("value"))
    first = flat.groupBy("incident_id", "value").agg(F.min("at").alias("at"))
    return first.groupBy("incident_id", F.col("at.observation_id").alias("observation_id")).agg(F.array_sort(F.collect_list("value")).alias(name))


def incident_states(members: DataFrame) -> DataFrame:
    """Each member with its incident before and after it.

    Adds ``n`` (1 for the opening member), ``new_units``, ``new_agencies``,
    ``had_units``, ``type_before``, ``type_after``, ``severity_before`` and
    ``severity_after``.  The type only changes off ``unknown``, severity only
    rises.  No step holds an incident whole: sets are taken by first sight.
    """
    agency = dispatch_agency(F.col("source"))
    rows = members.join(_first_seen(members, F.col("units"), "new_units"), ["incident_id", "observation_id"], "left")
    rows = rows.join(_first_seen(members, F.array(agency), "new_agencies"), ["incident_id", "observation_id"], "left")
    order = Window.partitionBy("incident_id").orderBy("us", "observation_id")
    so_far, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    known = F.when(F.col("type") != "unknown", F.col("type"))
    rank = severity_rank(F.col("severity"))
    worst = lambda w: F.when(F.max(rank).over(w) >= 0, F.element_at(F.array(*map(F.lit, SEVERITIES)), F.max(rank).over(w) + 1))
    none = F.array().cast("array<string>")
    return rows.select(
        *members.columns, F.row_number().over(order).alias("n"), F.coalesce("new_units", none).alias("new_units"), F.coalesce("new_agencies", none).alias("new_agencies"),
        (F.coalesce(F.sum(F.size(F.coalesce("new_units", none))).over(before), F.lit(0)) > 0).alias("had_units"),
        F.coalesce(F.first(known, ignorenulls=True).over(before), F.lit("unknown")).alias("type_before"),
        F.coalesce(F.first(known, ignorenulls=True).over(so_far), F.lit("unknown")).alias("type_after"),
        worst(before).alias("severity_before"), worst(so_far).alias("severity_after"),
    )


def timeline(members: DataFrame) -> DataFrame:
    """``incident_id, observation_id, us, kind, text``: one entry per kind and member, and one per joining agency."""
    # fixed values: the kinds and sentences of entries
    rows = incident_states(members)
    agency = agency_label(dispatch_agency(F.col("source")))
    first = F.col("n") == 1
    units = F.array_join("new_units", ", ")
    where = F.coalesce(F.concat(F.lit(" at "), "location"), F.lit(""))
    entry = lambda when, kind, *parts: F.when(when, F.struct(F.lit(kind).alias("kind"), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("text")))
    some = F.size("new_units") > 0
    rose = severity_rank(F.col("severity_after")) > severity_rank(F.col("severity_before"))
    raised = F.when(F.col("severity_before").isNull(), F.concat(F.lit("Severity assessed as "), "severity_after", F.lit("."))).otherwise(F.concat(F.lit("Severity raised from "), "severity_before", F.lit(" to "), "severity_after", F.lit(".")))
    entries = F.array(
        entry(first, "initial_report", type_label(F.col("type_after")), " reported", where, " — first report from ", agency, "."),
        entry(some & ~F.col("had_units"), "unit_dispatched", agency, " dispatched ", units, "."),
        entry(some & F.col("had_units"), "additional_unit", agency, " added ", units, "."),
        entry(~first & (F.size("new_agencies") > 0), "agency_joined", agency_label(F.get("new_agencies", F.lit(0))), " joined the response."),
        entry(~first & (F.col("type_before") != F.col("type_after")), "type_changed", "Type changed from ", type_label(F.col("type_before")), " to ", type_label(F.col("type_after")), "."),
        F.when(~first & rose, F.struct(F.lit("escalation").alias("kind"), raised.alias("text"))),
    )
    told = rows.select("incident_id", "observation_id", "us", F.inline(F.filter(entries, lambda e: e.isNotNull())))
    return told.dropDuplicates(["incident_id", "observation_id", "kind"])


def signals(metadata: Column) -> Column:
    """``struct<received, dispatched, enroute, on_scene, closed, disposition>`` of a metadata map, times as instants.

    A time that cannot be read counts as absent; police closing codes come before fire ones.
    """
    at = lambda *keys: F.coalesce(*[parse_local(F.try_element_at(metadata, F.lit(k))) for k in keys])
    text = lambda key: F.nullif(F.trim(F.try_element_at(metadata, F.lit(key))), F.lit(""))
    return F.struct(
        at("received_datetime", "received_dttm", "entry_datetime", "entry_dttm").alias("received"), at("dispatch_datetime", "dispatch_dttm").alias("dispatched"),
        at("enroute_datetime", "response_dttm").alias("enroute"), at("onscene_datetime", "on_scene_dttm").alias("on_scene"), at("close_datetime").alias("closed"),
        F.coalesce(text("disposition"), text("call_final_disposition")).alias("disposition"),
    )


def resolution(disposition: Column) -> Column:
    return F.coalesce(mapped(F.upper(F.trim(disposition)), DISPOSITIONS), F.lit("unknown"))


def status_decision(current: Column, s: Column) -> Column:
    """``struct<status, reason, resolved_us, resolution, kept>`` of the signals against the status so far.

    A record without times keeps the status, and so does one that says an
    earlier step; ``kept`` marks both.
    """
    why = resolution(s["disposition"])
    closed = F.when(why == "nothing_found", F.concat(F.lit("closed by the agency with disposition "), s["disposition"], F.lit(" — nothing found")))
    closed = closed.otherwise(F.concat(F.lit("closed by the agency"), F.coalesce(F.concat(F.lit(" with disposition "), s["disposition"]), F.lit(""))))
    say = lambda status, reason, at=None, res=None, kept=False: F.struct(
        (F.lit(status) if isinstance(status, str) else status).alias("status"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"),
        (F.lit(None) if at is None else at).cast("long").alias("resolved_us"), (F.lit(None) if res is None else res).cast("string").alias("resolution"), F.lit(kept).alias("kept"),
    )
    said = (
        F.when(s["closed"].isNotNull(), say("resolved", closed, s["closed"], why)).when(s["on_scene"].isNotNull(), say("active", "a unit reported on scene"))
        .when(s["dispatched"].isNotNull() | s["enroute"].isNotNull(), say("dispatched", "units were dispatched"))
        .when(s["received"].isNotNull(), say("reported", "the call was received")).otherwise(say("unknown", "no lifecycle timestamps on this record"))
    )
    ranks = F.create_map(*[F.lit(x) for kv in (RANKS | {"contained": 2.5}).items() for x in (kv[0], float(kv[1]))])
    rank = lambda status: F.coalesce(F.try_element_at(ranks, status), F.lit(-1.0))
    silent = F.concat(F.lit("kept "), current, F.lit(": this record carried no lifecycle timestamps"))
    back = F.concat(F.lit("kept "), current, F.lit(': a later record reported only "'), said["status"], F.lit('", which is not evidence the event went backwards'))
    return (
        F.when((said["status"] == "unknown") & (current != "unknown"), say(current, silent, kept=True))
        .when((rank(said["status"]) >= 0) & (rank(current) > rank(said["status"])), say(current, back, kept=True)).otherwise(said)
    )


def status_entry(decision: Column) -> Column:
    """``struct<kind, text>`` of a status for the timeline."""
    return F.struct(F.when(decision["status"] == "resolved", "closed").otherwise("status_changed").alias("kind"), F.concat(F.lit("Status "), decision["status"], F.lit(": "), decision["reason"]).alias("text"))


def stale_reason(last_us: Column, now_us: Column) -> Column:
    minutes = F.floor((now_us - last_us) / 60_000_000 + 0.5).cast("long")
    return F.concat(F.lit("no further reports for "), minutes, F.lit(" minutes — status unknown, not resolved"))


def report_kind(report_type: Column) -> Column:
    value = F.lower(report_type)
    online = F.when(value.contains("coplogic"), "online-filed ").otherwise("")
    kind = F.when(value.contains("supplement"), "supplement").when(value.contains("vehicle"), "vehicle report").otherwise("initial report")
    return F.when(F.coalesce(report_type, F.lit("")) == "", "report").otherwise(F.concat(online, kind))


def with_article(noun: Column) -> Column:
    return F.concat(F.when(noun.rlike("(?i)^[aeiou]"), "an ").otherwise("a "), noun)


def report_text(metadata: Column) -> Column:
    """The sentence a written report adds to the timeline of its call."""
    text = lambda key: F.nullif(F.trim(F.try_element_at(metadata, F.lit(key))), F.lit(""))
    what = F.coalesce(text("incident_description"), text("incident_category"), F.lit("an incident"))
    outcome = F.coalesce(F.concat(F.lit(" Case status: "), text("resolution"), F.lit(".")), F.lit(""))
    return F.concat(F.lit("SFPD filed "), with_article(report_kind(text("report_type_description"))), F.lit(": "), what, F.lit("."), outcome)


def lag_days(reported_us: Column, first_us: Column) -> Column:
    """Days from the incident's first record to the report, to a tenth."""
    return F.floor((reported_us - first_us) / (DAY / 10) + 0.5) / 10


def join_reports(reports: DataFrame, calls: DataFrame) -> DataFrame:
    """Reports with ``outcome`` and, where joined, the incident of the police call they name.

    ``reports``: id, call, reported_us, attached (bool); ``calls``: call,
    incident_id, first_us.  A call is looked up once however many reports name it.
    """
    one = calls.groupBy("call").agg(F.min(F.struct("incident_id", "first_us")).alias("c"))
    met = reports.join(one, "call", "left")
    outcome = (
        F.when(F.coalesce("call", F.lit("")) == "", "unjoinable").when(F.col("attached"), "already_attached").when(F.col("c").isNull(), "no_matching_call").otherwise("joined")
    )
    joined = outcome == "joined"
    return met.select("id", "call", outcome.alias("outcome"), F.when(joined, F.col("c.incident_id")).alias("incident_id"), F.when(joined, lag_days(F.col("reported_us"), F.col("c.first_us"))).alias("lag_days"))


def unit_responses(rows: DataFrame) -> DataFrame:
    """``id, unit, unit_type, dispatched, on_scene, to_scene_us, took, place`` of ``id, unit_times`` rows.

    ``place`` orders the units of a record: on scene first, by time, then by name.
    """
    flat = rows.select("id", F.explode("unit_times").alias("unit", "t"))
    timed = flat.select("id", "unit", F.nullif(F.trim("t.unit_type"), F.lit("")).alias("unit_type"), parse_local(F.col("t.dispatch")).alias("dispatched"), parse_local(F.col("t.on_scene")).alias("on_scene"))
    gap = F.col("on_scene") - F.col("dispatched")
    order = Window.partitionBy("id").orderBy(F.col("on_scene").isNull(), "on_scene", "unit")
    return timed.select("*", F.when(gap >= 0, gap).alias("to_scene_us"), elapsed(F.col("dispatched"), F.col("on_scene")).alias("took"), F.row_number().over(order).alias("place"))


def scene_time(rows: DataFrame) -> DataFrame:
    """``id, to_scene_us``: of the first unit on scene, else of the call itself, else null."""
    first = unit_responses(rows).where("place = 1 and on_scene is not null").select("id", F.col("to_scene_us").alias("own"))
    at = lambda key: parse_local(F.try_element_at("metadata", F.lit(key)))
    gap = at("onscene_datetime") - at("dispatch_datetime")
    return rows.join(first, "id", "left").select("id", F.coalesce("own", F.when(gap >= 0, gap)).alias("to_scene_us"))


def record_facts(metadata: Column) -> Column:
    """``array<struct<label, value, notable>>``: what a record says beyond its normalized fields, in a fixed order."""
    text = lambda key: F.nullif(F.trim(F.try_element_at(metadata, F.lit(key))), F.lit(""))
    fact = lambda when, label, value, notable: F.when(when, F.struct(F.lit(label).alias("label"), value.alias("value"), F.coalesce(notable, F.lit(False)).alias("notable")))
    before, after = text("call_type_original_desc"), text("call_type_final_desc")
    alarms = F.coalesce(text("number_of_alarms"), F.lit("1")).try_cast("double")
    part = lambda word, key: F.concat(F.lit(f"{word} "), text(key))
    closing = F.coalesce(text("disposition"), text("call_final_disposition"))
    yes, no = F.lit(True), F.lit(False)
    facts = F.array(
        fact(text("onview_flag") == "Y", "how it came in", F.lit("an officer came across this themselves — it was not phoned in"), yes),
        fact(before != after, "changed en route", F.concat(F.lit("reported as "), before, F.lit(", closed as "), after), yes),
        fact(text("police_district").isNotNull(), "police district", text("police_district"), no),
        fact(text("call_type_group").isNotNull(), "call group", text("call_type_group"), F.lower(text("call_type_group")).contains("life-threatening")),
        fact(F.lower(text("als_unit")) == "true", "medical", F.lit("an advanced life support unit was assigned"), no),
        fact(alarms > 1, "alarms", F.concat(F.regexp_replace(alarms.cast("string"), r"\.0$", ""), F.lit("-alarm response")), yes),
        fact(F.coalesce(text("battalion"), text("station_area")).isNotNull(), "station", F.concat_ws(" · ", part("battalion", "battalion"), part("station", "station_area")), no),
        fact(text("supervisor_district").isNotNull(), "supervisor district", F.regexp_replace(text("supervisor_district"), r"\.0$", ""), no),
        fact(closing.isNotNull(), "outcome", F.concat(mapped(resolution(closing), OUTCOMES), F.lit(" ("), closing, F.lit(")")), resolution(closing) == "nothing_found"),
    )
    return F.filter(facts, lambda f: f.isNotNull())
