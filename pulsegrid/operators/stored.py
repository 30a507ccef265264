"""Records met with what is stored of them: one row a record, folded from the stored row and all that came since.

Rows have the columns of :data:`CALL`, as the mappers of :mod:`pulsegrid.sources.feeds`
give them.  Fire and medical feeds publish a row a unit, which add up; of other
feeds the last row stands, but never blanks a place that was known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.registry import same_metadata

KEY = ["source", "source_record_id"]
#: Sources whose rows add up, and columns that a later row may fill but not blank.
UNIT_SOURCES = ("sf_fire_cad", "sf_ems_cad")
FILLED = ("location_raw", "intersection", "neighborhood")
#: A unit's times as the feeds name them.
TIMES = "struct<dispatch:string,response:string,on_scene:string,available:string,unit_type:string>"
CALL = (
    "id string, source string, source_record_id string, agency string, us long, fetched_us long, published_us long, raw_type string, subtype string, type string, priority string, "
    f"location_raw string, intersection string, neighborhood string, lat double, lng double, sensitive boolean, confidence double, units array<string>, unit_times map<string,{TIMES}>, metadata map<string,string>"
)
COLUMNS = [c.split(" ")[0] for c in CALL.split(", ")]


def fold_records(rows: DataFrame, turn: str | None = None) -> DataFrame:
    """One row per source and record of CALL's columns; rows are taken by ``turn``, fetch time and unit.

    Rows without a record id are left out.  Values that add up are folded by
    key, never listed by record, so a record with very many rows is no large one.
    """
    return _folded(rows, turn).select(*COLUMNS)


def _folded(rows: DataFrame, turn: str | None = None) -> DataFrame:
    """As :func:`fold_records`, with the last ``__turn`` a record has a row of; the result is dealt by record."""
    known = rows.where("source is not null and source_record_id is not null").withColumn("__turn", F.col(turn) if turn else F.lit(0))
    # all that follows reads what is shuffled here: once, whole and not exploded.  Inlined, as else each reader would have its own columns and rows shuffled
    rest = [c for c in (*COLUMNS, "__turn") if c not in KEY]
    dealt = known.select(*KEY, *rest).repartition(*KEY).select(*KEY, F.inline(F.array(F.struct(*rest, F.col("source").isin(*UNIT_SOURCES).alias("__adds")))))
    order = F.struct("__turn", "fetched_us", F.coalesce(F.get("units", F.lit(0)), F.lit("")))
    dealt = dealt.withColumn("__order", order)
    at = F.col("__order")
    adds = F.col("source").isin(*UNIT_SOURCES)
    first = lambda c, there=None: F.min_by(c, at if there is None else F.when(there, at))
    last = lambda c, there=None: F.max_by(c, at if there is None else F.when(there, at))
    place = F.struct("location_raw", "neighborhood", "lat", "lng", "intersection")
    known = F.coalesce("location_raw", "neighborhood", F.col("lat").cast("string")).isNotNull()
    chosen = lambda name: F.when(adds, first(F.col(name))).otherwise(last(F.col(name))).alias(name)
    point = F.struct("lat", "lng")
    whole = dealt.groupBy(*KEY).agg(
        first(F.col("id")).alias("id"), F.when(adds, F.min("us")).otherwise(last(F.col("us"))).alias("us"), F.max("fetched_us").alias("fetched_us"), F.max("published_us").alias("published_us"),
        F.when(adds, first(F.col("raw_type"), F.col("raw_type").isNotNull())).otherwise(last(F.col("raw_type"))).alias("raw_type"), first(F.col("type"), F.col("type").isNotNull()).alias("type"),
        *[chosen(c) for c in ("agency", "subtype", "priority", "sensitive", "confidence")], first(place, known).alias("place"), last(point, F.col("lat").isNotNull()).alias("point"),
        *[last(F.col(c), F.col(c).isNotNull()).alias(c) for c in FILLED], last(F.col("metadata")).alias("last_metadata"), last(F.col("units")).alias("last_units"), F.max("__turn").alias("__turn"),
    )
    many = dealt.where("__adds")
    pairs = many.select(*KEY, "__order", F.explode("metadata")).groupBy(*KEY, "key").agg(F.max_by("value", "__order").alias("value"))
    facts = pairs.groupBy(*KEY).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("facts"))
    seen = many.select(*KEY, "__order", F.explode("units").alias("unit"), F.col("unit_times"))
    timed = F.try_element_at("unit_times", F.col("unit"))
    by_unit = seen.groupBy(*KEY, "unit").agg(F.max_by(timed, F.when(timed.isNotNull(), F.col("__order"))).alias("times"))
    units = by_unit.groupBy(*KEY).agg(
        F.array_sort(F.collect_list("unit")).alias("all_units"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("times").isNotNull(), F.struct("unit", "times"))), lambda a, b: F.when(a["unit"] < b["unit"], -1).otherwise(1))).alias("unit_times")
    )
    joined = whole.join(facts, KEY, "left").join(units, KEY, "left")
    listed = F.coalesce(F.when(adds, F.col("all_units")).otherwise(F.col("last_units")), F.array().cast("array<string>"))
    count = F.create_map(F.lit("unit_count"), F.size(listed).cast("string"))
    bare = F.map_filter(F.coalesce("facts", F.create_map().cast("map<string,string>")), lambda k, v: k != "unit_count")
    out = {c: F.col(c) for c in COLUMNS} | {c: F.when(adds, F.col(f"place.{c}")).otherwise(F.col(c)) for c in FILLED}
    out |= {c: F.when(adds, F.col(f"place.{c}")).otherwise(F.col(f"point.{c}")) for c in ("lat", "lng")}
    out |= {"units": listed, "metadata": F.when(adds, F.map_concat(bare, count)).otherwise(F.col("last_metadata"))}
    return joined.select(*[out[c].alias(c) for c in COLUMNS], "__turn")


def _same(name: str) -> Column:
    new, old = F.col(name), F.col(f"s_{name}")
    if name == "metadata":
        return same_metadata(new, old)
    if name == "unit_times":
        entries = lambda m: F.array_sort(F.map_entries(m), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1))
        return entries(new).eqNullSafe(entries(old))
    return new.eqNullSafe(old)


def merge_stored(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """All records of either side with ``outcome``: created, updated, unchanged or untouched.

    What differs only in fetch time, publication times or volatile metadata is
    unchanged, and its stored row stays as it is.  Cutting a feed into batches in
    the order it was fetched gives the same rows but for those fields.  Nulls in
    any column are values like others; an empty side is fine.
    """
    both = stored.select(*COLUMNS).withColumn("__turn", F.lit(0)).unionByName(incoming.select(*COLUMNS).withColumn("__turn", F.lit(1)))
    old = stored.select(*KEY, *[F.col(c).alias(f"s_{c}") for c in COLUMNS if c not in KEY], F.lit(True).alias("s_"))
    joined = _folded(both, "__turn").join(old, KEY, "left")
    same = F.lit(True)
    for c in COLUMNS:
        if c not in (*KEY, "id", "fetched_us", "published_us", "type"):
            same &= _same(c)
    outcome = F.when(F.col("s_").isNull(), "created").when(F.col("__turn") == 0, "untouched").when(same, "unchanged").otherwise("updated")
    told = joined.withColumn("outcome", outcome)
    stays = F.col("outcome").isin("unchanged", "untouched")
    return told.select(*KEY, *[F.when(stays, F.col(f"s_{c}")).otherwise(F.col(c)).alias(c) for c in COLUMNS if c not in KEY], "outcome")


def merge_units(parts: DataFrame, order: str) -> DataFrame:
    """Unit registries of batches as one: first and last sight, all sightings, and in ``order`` the first class and agency that are known."""
    known = lambda c, none: F.coalesce(F.min_by(c, F.when(F.col(c) != none, F.col(order))), F.lit(none)).alias(c)
    return parts.groupBy("designator").agg(known("agency", "other"), known("kind", "unknown"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.sum("sightings").alias("sightings"))
