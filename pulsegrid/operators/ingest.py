"""Raw records to observations: hashing, validation, scrubbing, folding and change-aware upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fields that change with every publication and say nothing.
VOLATILE = ("data_as_of", "data_loaded_at")
#: Field names that hold personal data.
PERSONAL = (
    r"(?i)(officer|badge|star_number|employee|responder|caller|complainant|reporting_party|^rp_|victim|suspect|person_name|first_name|last_name|"
    r"full_name|phone|email|ssn|\bdob\b|date_of_birth|driver_license)"
)
#: Unit types of medical rows.
MEDICAL_UNITS = ("MEDIC", "PRIVATE", "AMBULANCE", "RESCUE CAPTAIN")


def payload_hash(record: Column) -> Column:
    """SHA-256 of a ``map<string, string>`` without volatile fields, keys in order."""
    kept = F.map_filter(record, lambda k, v: ~k.isin(*VOLATILE) & v.isNotNull())
    pairs = F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.sha2(F.array_join(pairs, "\n"), 256)


def earliest_payloads(records: DataFrame) -> DataFrame:
    """The first ``fetched_us`` of each (source, source_record_id, payload_hash)."""
    return records.groupBy("source", "source_record_id", "payload_hash").agg(F.min("fetched_us").alias("fetched_us"))


def scrub(record: Column) -> Column:
    """``struct<kept map, dropped array>``: fields whose names hold personal data are taken out."""
    return F.struct(
        F.map_filter(record, lambda k, v: ~k.rlike(PERSONAL)).alias("kept"),
        F.array_sort(F.filter(F.map_keys(record), lambda k: k.rlike(PERSONAL))).alias("dropped"),
    )


def quarantine_reason(call: Column, row_id: Column, received: Column) -> Column:
    """Why a call record is refused; null if it is good."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return (
        F.when(F.lower(call).contains("completion time"), "export footer row")
        .when(blank(call) & blank(row_id), "missing key")
        .when(blank(received), "missing time")
        .when((F.coalesce(call, F.lit("")) != "") & ~F.trim(call).rlike(r"^[0-9]+$"), F.concat(F.lit("key is not numeric: "), F.substring(call, 1, 40)))
    )


def route(unit_type: Column, call_type: Column) -> Column:
    """Source of a fire department row."""
    medical = F.upper(F.trim(unit_type)).isin(*MEDICAL_UNITS) | (F.lower(F.trim(call_type)) == "medical incident")
    return F.when(F.coalesce(medical, F.lit(False)), "sf_ems_cad").otherwise("sf_fire_cad")


def fold_units(rows: DataFrame) -> DataFrame:
    """One row per ``call``: units in order, earliest time, latest status, first known place, times by unit.

    ``rows``: call, unit, us, status, place.  Later rows override, ties by unit.
    """
    at = F.struct("us", "unit")
    times = F.map_from_entries(F.array_sort(F.collect_set(F.struct("unit", "last"))))
    by_unit = rows.groupBy("call", "unit").agg(
        F.max("us").alias("last"), F.min("us").alias("first"), F.max_by("status", at).alias("status"),
        F.min(F.when(F.col("place").isNotNull(), F.struct("us", "unit", "place"))).alias("placed"),
    )
    return by_unit.groupBy("call").agg(
        F.array_sort(F.collect_set("unit")).alias("units"), F.count("*").alias("unit_count"), F.min("first").alias("us"),
        F.max_by("status", F.struct("last", "unit")).alias("status"), F.min("placed")["place"].alias("place"), times.alias("unit_times"),
    )


def upsert(stored: DataFrame, incoming: DataFrame, key: str, replaced: list[str], kept_if_null: list[str], derived: list[str]) -> DataFrame:
    """The merged table with ``outcome``: created, updated, unchanged, or untouched.

    ``replaced`` take the incoming value, ``kept_if_null`` are never blanked,
    ``derived`` are never written on update.  Keys are unique on either side.
    """
    new = incoming.select(F.col(key), *[F.col(c).alias(f"n_{c}") for c in replaced + kept_if_null + derived], F.lit(True).alias("n_"))
    old = stored.select(F.col(key), *[F.col(c).alias(f"s_{c}") for c in replaced + kept_if_null + derived], F.lit(True).alias("s_"))
    both = old.join(new, key, "full_outer")
    here, there = F.col("s_").isNotNull(), F.col("n_").isNotNull()
    value = {c: F.when(there, F.col(f"n_{c}")).otherwise(F.col(f"s_{c}")) for c in replaced}
    value |= {c: F.coalesce(f"n_{c}", f"s_{c}") for c in kept_if_null}
    value |= {c: F.when(here, F.col(f"s_{c}")).otherwise(F.col(f"n_{c}")) for c in derived}
    changed = F.lit(False)
    for c in replaced + kept_if_null:
        changed |= ~value[c].eqNullSafe(F.col(f"s_{c}"))
    outcome = F.when(~here, "created").when(~there, "untouched").when(changed, "updated").otherwise("unchanged")
    return both.select(key, *[v.alias(c) for c, v in value.items()], outcome.alias("outcome"))


def revisions(payloads: DataFrame, fields: list[str]) -> DataFrame:
    """``record, us, field, before, after``: what changed against the record's previous payload."""
    order = Window.partitionBy("record").orderBy("us", "payload_id")
    entry = lambda c: F.struct(F.lit(c).alias("field"), F.lag(c).over(order).alias("before"), F.col(c).alias("after"))
    seen = payloads.select("record", "us", F.row_number().over(order).alias("n"), F.array(*map(entry, fields)).alias("all")).where("n > 1")
    changes = F.filter("all", lambda e: ~e["before"].eqNullSafe(e["after"]))
    return seen.select("record", "us", F.inline(changes))


def gaps(polls: DataFrame, interval_us: int, bucket_us: int = 86_400_000_000) -> DataFrame:
    """``source, from_us, to_us`` where successful polls are over three intervals apart.

    Polls are compared within buckets of time, and buckets by their first and
    last poll, so that a source's history is not one task.
    """
    dealt = polls.select("source", "us", F.floor(F.col("us") / bucket_us).alias("bucket"))
    within = dealt.select("source", F.lag("us").over(Window.partitionBy("source", "bucket").orderBy("us")).alias("from_us"), F.col("us").alias("to_us"))
    ends = dealt.groupBy("source", "bucket").agg(F.min("us").alias("low"), F.max("us").alias("high"))
    across = ends.select("source", F.lag("high").over(Window.partitionBy("source").orderBy("bucket")).alias("from_us"), F.col("low").alias("to_us"))
    return within.unionByName(across).where(F.col("to_us") - F.col("from_us") > 3 * interval_us)


#: Unit prefix to class and agency.
UNIT_PREFIXES = {
    "MEDIC": ("medic", "ems"), "ENGINE": ("engine", "fire"), "TRUCK": ("truck", "fire"), "SCRT": ("medic", "ems"), "QRV": ("medic", "ems"),
    "EMS": ("command", "ems"), "RWC": ("support", "fire"), "VAN": ("support", "fire"), "RC": ("rescue", "ems"), "RS": ("rescue", "fire"),
    "RB": ("rescue", "fire"), "CP": ("command", "fire"), "AM": ("ambulance", "ems"), "KM": ("ambulance", "ems"), "BLS": ("ambulance", "ems"),
    "M": ("medic", "ems"), "E": ("engine", "fire"), "T": ("truck", "fire"), "B": ("battalion", "fire"), "D": ("command", "fire"),
}


#: Unit type of a fire department row to class and agency.
UNIT_TYPES = {
    "ENGINE": ("engine", "fire"), "TRUCK": ("truck", "fire"), "CHIEF": ("battalion", "fire"), "MEDIC": ("medic", "ems"), "PRIVATE": ("ambulance", "ems"),
    "BLS": ("ambulance", "ems"), "RESCUE CAPTAIN": ("rescue", "ems"), "RESCUE SQUAD": ("rescue", "fire"), "SUPPORT": ("support", "fire"),
    "CP": ("command", "fire"), "INVESTIGATION": ("support", "fire"),
}


def parse_unit(raw: Column, unit_type: Column | None = None, source: Column | None = None) -> Column:
    """``struct<designator, agency, unit_class, number>`` of a unit's name.

    A digit, a letter and one or two digits are a patrol car, but for sources of
    the fire department.  A known ``unit_type`` decides before the letters of
    the name, which may be followed by a number and one more letter.
    """
    designator = F.regexp_replace(F.upper(raw), "[^A-Z0-9]", "")
    car, split = "^[0-9][A-Z]([0-9]{1,2})$", "^([A-Z]+)0*([0-9]+)[A-Z]?$"
    patrol = designator.rlike(car)
    if source is not None:
        patrol &= ~F.coalesce(source.isin("sf_fire_cad", "sf_ems_cad"), F.lit(False))
    known = lambda values, key: F.try_element_at(F.create_map(*[F.lit(x) for k, (c, a) in values.items() for x in (k, f"{c} {a}")]), key)
    letters = F.when(designator.rlike(split), F.regexp_extract(designator, split, 1)).otherwise(designator)
    hinted = F.lit(None).cast("string") if unit_type is None else known(UNIT_TYPES, F.upper(F.trim(unit_type)))
    both = F.split(F.coalesce(hinted, known(UNIT_PREFIXES, letters), F.lit("unknown other")), " ")
    number = F.when(patrol, F.regexp_extract(designator, car, 1)).otherwise(F.regexp_extract(designator, split, 2))
    return F.struct(
        designator.alias("designator"), F.when(patrol, "police").otherwise(both[1]).alias("agency"), F.when(patrol, "patrol").otherwise(both[0]).alias("unit_class"),
        F.nullif(number, F.lit("")).try_cast("int").alias("number"),
    )
