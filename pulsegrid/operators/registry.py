"""What is kept beside the observations: units, payloads, quarantined records, gaps, and enrichment of stored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.ingest import VOLATILE, parse_unit

#: Polls that may be missed, hours the live feed keeps, and hours until the archive has a record.
POLL_MULTIPLE, RETENTION_HOURS, ARCHIVE_HOURS = 3, 40, 24
_HOUR = 3_600_000_000


def unit_registry(sightings: DataFrame) -> DataFrame:
    """``designator, agency, kind, first_us, last_us, sightings`` of ``unit, us, unit_type, source`` rows.

    In the order of time and text, the first class that is known stays, and so
    does the first agency.  Units without a letter or digit are left out.
    """
    parsed = sightings.select("us", "unit", parse_unit(F.col("unit"), F.col("unit_type"), F.col("source")).alias("u"))
    rows = parsed.where("u.designator <> ''").select("us", "unit", "u.designator", "u.agency", "u.unit_class")
    order = F.struct("us", "unit", "unit_class", "agency")
    known = lambda c, none: F.coalesce(F.min_by(c, F.when(F.col(c) != none, order)), F.lit(none))
    return rows.groupBy("designator").agg(
        known("agency", "other").alias("agency"), known("unit_class", "unknown").alias("kind"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count("*").alias("sightings")
    )


def incident_units(members: DataFrame) -> DataFrame:
    """``incident_id, designator, first_us, last_us`` of ``incident_id, us, units`` rows."""
    flat = members.select("incident_id", "us", F.explode("units").alias("unit")).select("incident_id", "us", parse_unit(F.col("unit"))["designator"].alias("designator"))
    return flat.where("designator <> ''").groupBy("incident_id", "designator").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"))


def store_payloads(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """``incoming`` with ``outcome``: stored, or known where the same source, record and content is there or came earlier in the batch."""
    key = ["source", "source_record_id", "payload_hash"]
    first = incoming.groupBy(*key).agg(F.min("fetched_us").alias("__first"))
    there = stored.select(*key).distinct().withColumn("__there", F.lit(True))
    joined = incoming.join(first, key).join(there, key, "left")
    new = F.col("__there").isNull() & (F.col("fetched_us") == F.col("__first"))
    return joined.withColumn("outcome", F.when(new, "stored").otherwise("known")).drop("__first", "__there")


def quarantine(records: DataFrame) -> DataFrame:
    """``source, payload_hash, reason, first_us, times`` of ``source, payload_hash, reason, us`` rows that have a reason: one row a content."""
    bad = records.where("reason is not null")
    return bad.groupBy("source", "payload_hash").agg(F.min_by("reason", F.struct("us", "reason")).alias("reason"), F.min("us").alias("first_us"), F.count("*").alias("times"))


def same_metadata(a: Column, b: Column) -> Column:
    """Whether two maps agree in all but volatile keys; null is an empty map."""
    plain = lambda m: F.array_sort(F.map_entries(F.map_filter(F.coalesce(m, F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*VOLATILE))))
    return plain(a).eqNullSafe(plain(b))


def enrich(stored: DataFrame, found: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The stored rows with what was found for them; a null leaves a value as it is.  Keys of ``found`` are unique."""
    new = found.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = stored.join(new, key, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in stored.columns])


def open_gaps(sources: DataFrame, now_us: int) -> DataFrame:
    """``source, from_us, to_us, note`` of ``source, last_success_us, poll_seconds`` rows that are silent for over POLL_MULTIPLE polls."""
    silent = F.lit(now_us) - F.col("last_success_us")
    seconds = F.floor(silent / 1_000_000 + 0.5).cast("long")
    late = sources.where(silent > F.col("poll_seconds") * (POLL_MULTIPLE * 1_000_000))
    return late.select("source", F.col("last_success_us").alias("from_us"), F.lit(now_us).alias("to_us"), F.concat(F.lit("no successful poll for "), seconds, F.lit("s")).alias("note"))


def gap_state(from_us: Column, to_us: Column, now_us: Column) -> Column:
    """``struct<live, archived, lost>``: whether the feed, or the archive, still has the gap, or neither will any more."""
    age, end_age = now_us - from_us, now_us - to_us
    live, archived = age <= RETENTION_HOURS * _HOUR, end_age >= ARCHIVE_HOURS * _HOUR
    return F.struct(live.alias("live"), archived.alias("archived"), (~live & ~archived & (age > (RETENTION_HOURS + ARCHIVE_HOURS) * _HOUR)).alias("lost"))


def health(sources: DataFrame, now_us: int) -> DataFrame:
    """``source, state``: never, stale where silent for over POLL_MULTIPLE polls, else ok."""
    silent = F.lit(now_us) - F.col("last_success_us")
    state = F.when(F.col("last_success_us").isNull(), "never").when(silent > F.col("poll_seconds") * (POLL_MULTIPLE * 1_000_000), "stale").otherwise("ok")
    return sources.select("source", state.alias("state"))
