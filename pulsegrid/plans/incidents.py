"""Ingest, range joins, scoring and correlation as queries, with their SQL forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators import fold, ingest, lifecycle, near_blocks, scoring
from pulsegrid.operators.range_join import MINUTE, near_in_place_and_time, near_in_time
from pulsegrid.plans.analytics import NOW, _WITH
from pulsegrid.session import table
from pulsegrid.sources.observations import observations


def _candidates(rows: DataFrame) -> DataFrame:
    """Located pairs of different sources, each in the correlation window, with ``distance``."""
    met = near_in_place_and_time(rows, rows, scoring.METERS, scoring.BACK * MINUTE, scoring.AHEAD * MINUTE)
    return met.where("source <> o_source")


def range_join_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = _candidates(observations(spark, sf_dir))
    return met.select("id", F.col("o_id").alias("other"), F.round("distance", 3).alias("meters"))


def candidates_by_neighborhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls without a point fall back on their area."""
    rows = observations(spark, sf_dir)
    met = near_in_time(rows.where("lat is null"), rows, scoring.BACK * MINUTE, scoring.AHEAD * MINUTE, ("neighborhood",))
    return met.where("id <> o_id").select("id", F.col("o_id").alias("other"))


def nearby_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many other calls are within an hour and 500 m of each located call."""
    rows = observations(spark, sf_dir)
    return near_blocks.count_near(rows, 500.0, 60 * MINUTE, 60 * MINUTE)


def other_agency_nearby(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir)
    return near_blocks.sources_near(rows, 450.0, 30 * MINUTE, 30 * MINUTE).groupBy("id").agg(F.count("*").alias("agencies"))


def score_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scoring.score_pairs(_candidates(observations(spark, sf_dir)))
    return scored.select("id", F.col("o_id").alias("other"), F.round("s_type", 6).alias("s_type"), F.round("score", 6).alias("score"))


def decide_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best candidate of every call, and what would be decided."""
    best = near_blocks.best_of_other_sources(observations(spark, sf_dir))
    return best.select("id", F.col("o_id").alias("other"), F.round("score", 6).alias("score"), scoring.decision(F.col("score")).alias("decision"))


def correlate_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.correlate(observations(spark, sf_dir)).select("observation_id", "incident_id", "decision", F.round("score", 6).alias("score"), "primary_type")


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.incident_summary(fold.correlate(observations(spark, sf_dir)))


def payload_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct contents of each user's record and when each was first seen; volatile fields do not count."""
    rows = observations(spark, sf_dir)
    record = F.create_map(F.lit("type"), "type", F.lit("area"), "neighborhood", F.lit("data_as_of"), F.col("us").cast("string"))
    sent = rows.select("source", F.col("user_id").alias("source_record_id"), ingest.payload_hash(record).alias("payload_hash"), F.col("us").alias("fetched_us"))
    return ingest.earliest_payloads(sent)


def upsert_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).select("id", "type", "neighborhood", "priority_rank")
    stored = rows.where("id % 10 < 8")
    sent = rows.where("id % 10 >= 4").withColumn("type", F.when(F.col("id") % 3 == 0, "fire").otherwise(F.col("type")))
    sent = sent.withColumns({"neighborhood": F.when(F.col("id") % 7 != 0, F.col("neighborhood")), "priority_rank": F.lit(9)})
    return ingest.upsert(stored, sent, "id", ["type"], ["neighborhood"], ["priority_rank"])


def quarantine_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    key = F.col("o_orderkey")
    call = F.when(key % 11 == 0, F.lit("Completion time: 3")).when(key % 7 == 0, F.lit("")).when(key % 5 == 0, F.concat(F.lit("x"), key)).otherwise(key.cast("string"))
    row_id = F.when(key % 2 == 0, key.cast("string"))
    reason = ingest.quarantine_reason(call, row_id, F.when(key % 13 != 0, F.lit("t")))
    return rows.select(F.coalesce(F.regexp_replace(reason, "[0-9]+", "#"), F.lit("accepted")).alias("reason")).groupBy("reason").agg(F.count("*").alias("records"))


def pii_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field names that hold personal data go; ``intersection_name`` stays."""
    row = F.create_map(F.lit("cad_number"), F.col("id").cast("string"), F.lit("intersection_name"), "neighborhood", F.lit("Caller_Phone"), F.lit("x"), F.lit("officer_id"), F.lit("y"))
    done = observations(spark, sf_dir).select("id", ingest.scrub(row).alias("s"))
    return done.select("id", F.array_join(F.array_sort(F.map_keys("s.kept")), ",").alias("kept"), F.array_join("s.dropped", ",").alias("dropped"))


def unit_row_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as unit rows of their order."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("call"), F.concat(F.lit("E"), F.col("l_suppkey")).alias("unit"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("us"),
        F.col("l_linestatus").alias("status"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).alias("place"),
    )
    done = ingest.fold_units(rows.groupBy("call", "unit", "us").agg(F.max("status").alias("status"), F.min("place").alias("place")))
    return done.select("call", F.array_join("units", ",").alias("units"), "unit_count", "us", "place")


def unit_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.element_at(F.array(*map(F.lit, ("Medic ", "e-", "t", "3A", "rc", "zz", "B"))), (F.col("id") % 7 + 1).cast("int"))
    done = observations(spark, sf_dir).select("id", ingest.parse_unit(F.concat(names, F.col("user_id") % 50)).alias("u"))
    return done.select("id", "u.*")


def revision_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = observations(spark, sf_dir).select(F.col("user_id").alias("record"), "us", F.col("id").alias("payload_id"), "type", "neighborhood")
    return ingest.revisions(sent, ["type", "neighborhood"])


def gap_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    polls = observations(spark, sf_dir).select("source", "us").distinct()
    return ingest.gaps(polls, 2 * MINUTE)


def status_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda m: F.when(F.col("k") % m == 0, F.col("us"))
    signal = lifecycle.status_from_signals(F.when(F.col("k") % 11 != 0, F.col("us")), at(2), at(3), at(7))
    now = F.element_at(F.array(*map(F.lit, ("unknown", "reported", "dispatched", "active", "resolved"))), (F.col("user_id") % 5 + 1).cast("int"))
    return observations(spark, sf_dir).select("id", now.alias("was"), signal.alias("signalled"), lifecycle.next_status(now, signal).alias("status"))


def stale_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).where(F.col("us").between(NOW - 240 * MINUTE, NOW))
    status = F.when(F.col("k") % 4 == 0, "resolved").otherwise("active")
    return rows.select("id", lifecycle.stale(status, F.col("type"), F.col("us"), F.lit(NOW)).alias("status"))


def stale_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sweep over every incident up to NOW, however long it has been quiet, by its last call; one closed call resolves it."""
    rows = observations(spark, sf_dir).where(F.col("us") <= NOW)
    said = rows.select(F.col("id").alias("observation_id"), "us", F.coalesce(F.col("k") % 4 == 0, F.lit(False)).alias("closed"))
    last = fold.correlate(rows).join(said, "observation_id").groupBy("incident_id").agg(
        F.max("us").alias("last_us"), F.max_by("primary_type", F.struct("us", "observation_id")).alias("type"), F.max("closed").alias("closed")
    )
    status = F.when(F.col("closed"), "resolved").otherwise("active")
    return last.select("incident_id", "last_us", lifecycle.stale(status, F.col("type"), F.col("last_us"), F.lit(NOW)).alias("status"))


def report_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as written reports of the orders as calls: joined, unjoinable, or without a call."""
    reports = table(spark, sf_dir, "lineitem").select("l_linenumber", F.when(F.col("l_suppkey") % 10 != 0, F.col("l_orderkey") + F.when(F.col("l_linenumber") == 7, 10**9).otherwise(0)).alias("call"))
    calls = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call"), F.lit(True).alias("there"))
    outcome = F.when(F.col("call").isNull(), "unjoinable").when(F.col("there").isNull(), "no_matching_call").otherwise("joined")
    return reports.join(calls, "call", "left").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("reports"))


def pairwise_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs within each order that share a supplier parity against those that share a return flag; counts, not pairs, are joined."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case"), (F.col("l_suppkey") % 2).alias("said"), F.col("l_returnflag").alias("true"))
    pairs = lambda *by: rows.groupBy("case", *by).count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2).cast("long").alias("n"))
    both, said, true, every = pairs("said", "true"), pairs("said"), pairs("true"), pairs()
    one = both.select(F.col("n").alias("tp")).crossJoin(said.select(F.col("n").alias("s"))).crossJoin(true.select(F.col("n").alias("t"))).crossJoin(every.select(F.col("n").alias("e")))  # one row each
    return one.select("tp", (F.col("s") - F.col("tp")).alias("fp"), (F.col("t") - F.col("tp")).alias("fn"), (F.col("e") - F.col("s") - F.col("t") + F.col("tp")).alias("tn"))


QUERIES = {
    f.__name__: f
    for f in (
        range_join_candidates, candidates_by_neighborhood, nearby_observations, other_agency_nearby, score_pairs, decide_batch, correlate_fold, incidents,
        payload_hash, upsert_outcome, quarantine_reasons, pii_scrub, unit_row_fold, unit_parse, revision_diff, gap_detection, status_transition, stale_sweep, stale_incidents,
        report_join, pairwise_metrics,
    )
}

_DISTANCE = """2 * 6371008.8 * asin(least(1.0, sqrt(sin(radians(b.lat - a.lat) / 2) ** 2
  + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lng - a.lng) / 2) ** 2)))"""
_AFFINITY_ROWS = ", ".join(f"('{x}', '{y}', {v})" for x, row in scoring.AFFINITY.items() for y, v in row.items())


def _pairs_sql(back: int, ahead: int, meters: float) -> str:
    return f"""{_WITH}, pairs as (select a.id, b.id as other, a.us, b.us as o_us, a.type, b.type as o_type, a.source, b.source as o_source, {_DISTANCE} as distance
        from obs a join obs b on b.us between a.us - {back * MINUTE} and a.us + {ahead * MINUTE} where {_DISTANCE} <= {meters})"""


_SCORED = f"""{_pairs_sql(25, 15, 400.0)}, aff(x, y, v) as (values {_AFFINITY_ROWS}),
  typed as (select *, case when type <> 'unknown' and o_type <> 'unknown' then case when type = o_type then 1.0 else
      coalesce((select max(v) from aff where x = type and y = o_type), (select max(v) from aff where x = o_type and y = type), 0.0) end end::double as s_type
    from pairs where source <> o_source),
  parts as (select *, greatest(0.0, 1 - distance / 400.0) s_location, greatest(0.0, 1 - abs(us - o_us) / {25.0 * MINUTE}) s_time from typed),
  scored as (select *, case when s_type is null then least((0.35 * s_location + 0.25 * s_time) / 0.6, 0.84)
    else (0.35 * s_location + 0.25 * s_time + 0.2 * s_type) / 0.8 end as raw from parts)"""

ORACLE_SQL = {
    "range_join_candidates": f"{_pairs_sql(25, 15, 400.0)} select id, other, round(distance, 3) meters from pairs where source <> o_source",
    "candidates_by_neighborhood": f"""{_WITH} select a.id, b.id as other from obs a join obs b on a.neighborhood = b.neighborhood
        and b.us between a.us - {25 * MINUTE} and a.us + {15 * MINUTE} where a.lat is null and a.id <> b.id""",
    "nearby_observations": f"{_pairs_sql(60, 60, 500.0)} select id, count(*) near from pairs where id <> other group by id",
    "other_agency_nearby": f"{_pairs_sql(30, 30, 450.0)} select id, count(distinct o_source) agencies from pairs where source <> o_source group by id",
    "score_pairs": f"{_SCORED} select id, other, round(s_type, 6) s_type, round(raw, 6) score from scored",
    "decide_batch": f"""{_SCORED} select id, other, round(raw, 6) score, case when raw >= 0.85 - 1e-9 then 'merged' when raw >= 0.65 - 1e-9 then 'probable' else 'created' end decision
        from scored qualify row_number() over (partition by id order by raw desc, s_location desc, o_us, other) = 1""",
    "payload_hash": f"""{_WITH} select source, user_id source_record_id,
        sha256(case when neighborhood is not null then 'area=' || neighborhood || chr(10) else '' end || 'type=' || type) payload_hash, min(us) fetched_us from obs group by all""",
    "upsert_outcome": f"""{_WITH}, s as (select id, type, neighborhood, priority_rank from obs where id % 10 < 8),
        n as (select id, case when id % 3 = 0 then 'fire' else type end type, case when id % 7 <> 0 then neighborhood end neighborhood, 9 as priority_rank from obs where id % 10 >= 4)
        select coalesce(s.id, n.id) id, coalesce(n.type, s.type) type, coalesce(n.neighborhood, s.neighborhood) neighborhood, coalesce(s.priority_rank, n.priority_rank) priority_rank,
          case when s.id is null then 'created' when n.id is null then 'untouched' when n.type <> s.type then 'updated' else 'unchanged' end outcome
        from s full join n on s.id = n.id""",
    "quarantine_reasons": """select case when o_orderkey % 11 = 0 then 'export footer row' when o_orderkey % 7 = 0 and o_orderkey % 2 = 1 then 'missing key'
        when o_orderkey % 13 = 0 then 'missing time' when o_orderkey % 7 <> 0 and o_orderkey % 5 = 0 then 'key is not numeric: x#' else 'accepted' end reason, count(*) records from orders group by 1""",
    "pii_scrub": f"{_WITH} select id, 'cad_number,intersection_name' kept, 'Caller_Phone,officer_id' dropped from obs",
    "unit_row_fold": """select l_orderkey as call, array_to_string(list_sort(list(distinct 'E' || l_suppkey)), ',') units, count(distinct l_suppkey) unit_count,
        min(epoch_us(l_shipdate)) us, (list(l_returnflag order by l_shipdate, 'E' || l_suppkey, l_returnflag) filter (where l_linenumber % 2 = 0))[1] place from lineitem group by 1""",
    "unit_parse": f"""{_WITH}, p as (select id, user_id % 50 n, id % 7 m from obs)
        select id, case m when 0 then 'MEDIC' when 1 then 'E' when 2 then 'T' when 3 then '3A' when 4 then 'RC' when 5 then 'ZZ' else 'B' end || n as designator,
          case m when 0 then 'ems' when 3 then 'police' when 4 then 'ems' when 5 then 'other' else 'fire' end agency,
          case m when 0 then 'medic' when 1 then 'engine' when 2 then 'truck' when 3 then 'patrol' when 4 then 'rescue' when 5 then 'unknown' else 'battalion' end unit_class,
          cast(n as int) as number from p""",
    "revision_diff": f"""{_WITH}, l as (select user_id as record, us, type, neighborhood, lag(type) over w pt, lag(neighborhood) over w pn, row_number() over w n
          from obs window w as (partition by user_id order by us, id))
        select record, us, 'type' as field, pt as before, type as after from l where n > 1 and pt is distinct from type
        union all select record, us, 'neighborhood', pn, neighborhood from l where n > 1 and pn is distinct from neighborhood""",
    "gap_detection": f"""{_WITH}, p as (select distinct source, us from obs), l as (select source, lag(us) over (partition by source order by us) from_us, us to_us from p)
        select * from l where to_us - from_us > {6 * MINUTE}""",
    "status_transition": f"""{_WITH}, s as (select id, ['unknown', 'reported', 'dispatched', 'active', 'resolved'][user_id % 5 + 1] was, case when k % 7 = 0 then 'resolved'
          when k % 3 = 0 then 'active' when k % 2 = 0 then 'dispatched' when k % 11 <> 0 then 'reported' else 'unknown' end signalled from obs)
        select *, case when list_position(['unknown', 'reported', 'dispatched', 'active', 'resolved'], signalled) > list_position(['unknown', 'reported', 'dispatched', 'active', 'resolved'], was)
          then signalled else was end status from s""",
    "stale_sweep": f"""{_WITH} select id, case when k % 4 = 0 then 'resolved' when {NOW} - us >= {MINUTE} * cast(case type when 'collision' then 90 when 'medical' then 60 else 45 end as bigint) then 'unknown' else 'active' end status
        from obs where us between {NOW - 240 * MINUTE} and {NOW}""",
    "report_join": """select case when l_suppkey % 10 = 0 then 'unjoinable' when l_linenumber = 7 or o_orderkey is null then 'no_matching_call' else 'joined' end outcome, count(*) reports
        from lineitem left join orders on l_orderkey = o_orderkey group by 1""",
    "pairwise_metrics": """with r as (select l_orderkey c, l_suppkey % 2 s, l_returnflag t, row_number() over () n from lineitem),
        p as (select a.s = b.s ps, a.t = b.t pt from r a join r b on a.c = b.c and a.n < b.n)
        select count_if(ps and pt) tp, count_if(ps and not pt) fp, count_if(pt and not ps) fn, count_if(not ps and not pt) tn from p""",
}
