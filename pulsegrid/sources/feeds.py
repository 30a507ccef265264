"""Raw feed records to observations.

A feed is a DataFrame with the record as JSON text in ``payload`` and the time
it was fetched in ``fetched_us``.  Every mapper gives one row per record with
the same columns (see COLUMNS); what cannot be mapped keeps its row with the
reason in ``rejected``, so a batch never fails on one record and nothing is
lost silently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.times import parse_local
from pulsegrid.operators.ingest import route
from pulsegrid.sources.observations import mapped

COLUMNS = (
    "id", "source", "source_record_id", "agency", "us", "fetched_us", "published_us", "raw_type", "subtype", "type", "priority", "location_raw",
    "intersection", "neighborhood", "lat", "lng", "sensitive", "units", "unit_times", "metadata", "confidence", "rejected",
)
#: The fields of the three feeds that are read, and those kept as metadata.
POLICE = (
    "id cad_number received_datetime entry_datetime dispatch_datetime enroute_datetime onscene_datetime close_datetime call_type_original "
    "call_type_original_desc call_type_final call_type_final_desc call_type_final_notes priority_original priority_final agency disposition onview_flag "
    "sensitive_call intersection_name intersection_id supervisor_district analysis_neighborhood police_district call_last_updated_at data_as_of data_loaded_at"
).split()
POLICE_METADATA = (
    "cad_number entry_datetime dispatch_datetime enroute_datetime onscene_datetime close_datetime call_type_original call_type_original_desc call_type_final "
    "call_type_final_desc call_type_final_notes priority_original priority_final disposition onview_flag supervisor_district police_district intersection_id "
    "call_last_updated_at data_as_of data_loaded_at"
).split()
FIRE = (
    "call_number unit_id incident_number call_type call_type_group received_dttm entry_dttm dispatch_dttm response_dttm on_scene_dttm available_dttm "
    "call_final_disposition address zipcode_of_incident battalion station_area original_priority priority final_priority als_unit number_of_alarms unit_type "
    "fire_prevention_district supervisor_district neighborhoods_analysis_boundaries rowid data_as_of data_loaded_at"
).split()
FIRE_METADATA = (
    "call_number incident_number call_type_group entry_dttm dispatch_dttm response_dttm on_scene_dttm available_dttm call_final_disposition battalion "
    "station_area original_priority priority final_priority als_unit number_of_alarms supervisor_district fire_prevention_district zipcode_of_incident "
    "data_as_of data_loaded_at"
).split()
REPORT = (
    "row_id incident_id incident_number cad_number incident_datetime incident_date incident_time incident_year incident_day_of_week report_datetime "
    "report_type_code report_type_description incident_code incident_category incident_subcategory incident_description resolution filed_online intersection "
    "cnn analysis_neighborhood police_district supervisor_district supervisor_district_2012 latitude longitude point data_as_of data_loaded_at"
).split()
REPORT_METADATA = (
    "cad_number incident_id incident_number incident_category incident_subcategory incident_description incident_code resolution report_type_description "
    "report_datetime filed_online police_district supervisor_district data_as_of data_loaded_at"
).split()
#: Category of a written report to type.
CATEGORY_TYPES = {
    "larceny theft": "theft", "burglary": "burglary", "motor vehicle theft": "theft", "motor vehicle theft?": "theft", "recovered vehicle": "theft",
    "stolen property": "theft", "vehicle impounded": "theft", "vehicle misplaced": "theft", "robbery": "robbery", "fraud": "theft", "embezzlement": "theft",
    "forgery and counterfeiting": "theft", "assault": "assault", "homicide": "assault", "rape": "assault", "sex offense": "assault",
    "human trafficking (a), commercial sex acts": "assault", "human trafficking (b), involuntary servitude": "assault",
    "human trafficking, commercial sex acts": "assault", "offences against the family and children": "assault", "malicious mischief": "disturbance",
    "vandalism": "disturbance", "disorderly conduct": "disturbance", "suspicious occ": "disturbance", "suspicious": "disturbance", "liquor laws": "disturbance",
    "gambling": "disturbance", "civil sidewalks": "disturbance", "weapon": "weapon", "weapons offense": "weapon", "weapons offence": "weapon",
    "weapons carrying etc": "weapon", "arson": "fire", "fire report": "fire", "traffic collision": "collision", "traffic violation arrest": "traffic",
    "missing person": "missing_person", "suicide": "medical", "warrant": "police_activity", "drug offense": "police_activity",
    "drug violation": "police_activity", "miscellaneous investigation": "police_activity", "courtesy report": "police_activity",
    "case closure": "police_activity", "lost property": "public_safety", "non-criminal": "public_safety",
}


def _record(feed: DataFrame, fields: list[str], extra: str = "") -> DataFrame:
    schema = ", ".join(f"{f} string" for f in fields) + extra
    # exploded, as a record that is only selected would be read again for every field and filter
    return feed.select("payload", "fetched_us", F.explode(F.array(F.from_json("payload", schema))).alias("r"))


def _field(name: str) -> Column:
    return F.col("r").getField(name)


def _said(*names: str) -> Column:
    """The first of the fields that is there, or null if that is empty."""
    return F.nullif(F.coalesce(*[_field(n) for n in names]), F.lit(""))


def _key(name: str) -> Column:
    return F.nullif(F.trim(_field(name)), F.lit(""))


def metadata_of(fields: list[str]) -> Column:
    """The fields as a map, without those that are null or empty."""
    pairs = F.create_map(*[x for f in fields for x in (F.lit(f), _field(f))])
    return F.map_filter(pairs, lambda k, v: v.isNotNull() & (v != ""))


def _point(holder: str) -> tuple[Column, Column]:
    """Latitude and longitude of a GeoJSON point; both or none."""
    at = F.col("r").getField(holder)["coordinates"]
    lng, lat = F.get(at, F.lit(0)), F.get(at, F.lit(1))
    both = lng.isNotNull() & lat.isNotNull()
    return F.when(both, lat), F.when(both, lng)


def _observation(rows: DataFrame, source: Column, record_id: Column, received: Column, missing_id: str, missing_time: str, **values: Column) -> DataFrame:
    nothing = {"type": "string", "intersection": "string", "sensitive": "boolean", "unit_times": "map<string,struct<dispatch:string,response:string,on_scene:string,available:string,unit_type:string>>", "priority": "string"}
    out = {k: F.lit(None).cast(kind) for k, kind in nothing.items()}
    out |= {"units": F.array().cast("array<string>"), "confidence": F.lit(0.6)} | values
    out |= {"source": source, "source_record_id": record_id, "us": received, "id": F.concat(F.lit("obs_"), source, F.lit("_"), record_id), "fetched_us": F.col("fetched_us")}
    out["published_us"] = parse_local(_field("data_loaded_at"))
    out["rejected"] = F.when(F.col("r").isNull(), "no JSON record").when(record_id.isNull(), missing_id).when(received.isNull(), missing_time)
    return rows.select(*[out[c].alias(c) for c in COLUMNS])


def police_observations(feed: DataFrame) -> DataFrame:
    """One observation per police call; its key is the call number, else the row's id."""
    rows = _record(feed, POLICE, ", intersection_point struct<coordinates: array<double>>")
    lat, lng = _point("intersection_point")
    return _observation(
        rows, F.lit("sf_police_cad"), F.coalesce(_key("cad_number"), _key("id")), parse_local(_field("received_datetime")),
        "record has neither cad_number nor id", "received_datetime missing or unparseable",
        agency=_said("agency"), raw_type=_said("call_type_final", "call_type_original"), subtype=_said("call_type_final_desc", "call_type_original_desc"),
        priority=_said("priority_final", "priority_original"), location_raw=_said("intersection_name"), intersection=_said("intersection_name"),
        neighborhood=_said("analysis_neighborhood"), lat=lat, lng=lng, sensitive=F.lower(_field("sensitive_call")) == "true", metadata=metadata_of(POLICE_METADATA),
    )


def fire_observations(feed: DataFrame) -> DataFrame:
    """One observation per unit row of a fire department call, as fire or medical by :func:`route`; see :func:`merge_unit_rows`."""
    rows = _record(feed, FIRE, ", case_location struct<coordinates: array<double>>")
    lat, lng = _point("case_location")
    source = route(_field("unit_type"), _field("call_type"))
    unit = _key("unit_id")
    times = F.create_map(
        unit, F.struct(*[_field(f).alias(n) for n, f in (("dispatch", "dispatch_dttm"), ("response", "response_dttm"), ("on_scene", "on_scene_dttm"), ("available", "available_dttm"), ("unit_type", "unit_type"))])
    )
    return _observation(
        rows, source, _key("call_number"), parse_local(_field("received_dttm")), "record has no call_number", "received_dttm missing or unparseable",
        agency=F.when(source == "sf_ems_cad", "SFFD EMS").otherwise("SFFD"), raw_type=_said("call_type"), subtype=_said("call_type"),
        priority=_said("final_priority", "priority", "original_priority"), location_raw=_said("address"), neighborhood=_said("neighborhoods_analysis_boundaries"),
        lat=lat, lng=lng, units=F.when(unit.isNotNull(), F.array(unit)).otherwise(F.array().cast("array<string>")), unit_times=F.when(unit.isNotNull(), times),
        metadata=metadata_of(FIRE_METADATA),
    )


def report_observations(feed: DataFrame) -> DataFrame:
    """One observation per offence row of a written report; the type follows from the category."""
    rows = _record(feed, REPORT)
    number = lambda f: F.when(_field(f) != "", _field(f).try_cast("double"))
    lat, lng = number("latitude"), number("longitude")
    both = lat.isNotNull() & lng.isNotNull()
    return _observation(
        rows, F.lit("sf_police_report"), _key("row_id"), parse_local(_field("incident_datetime")), "report has no row_id", "incident_datetime missing or unparseable",
        agency=F.lit("SFPD"), raw_type=_said("incident_code"), subtype=_said("incident_description"), type=mapped(F.lower(F.trim(_field("incident_category"))), CATEGORY_TYPES),
        location_raw=_said("intersection"), intersection=_said("intersection"), neighborhood=_said("analysis_neighborhood"), lat=F.when(both, lat),
        lng=F.when(both, lng), metadata=metadata_of(REPORT_METADATA), confidence=F.lit(1.0),
    )


def dropped_fields(feed: DataFrame, kept: list[str]) -> DataFrame:
    """``field, records``: how often the feed has a field that is not on the list."""
    names = F.array_except(F.json_object_keys("payload"), F.array(*map(F.lit, kept)))
    return feed.select(F.explode(names).alias("field")).groupBy("field").agg(F.count("*").alias("records"))


def overlaid(under: Column, over: Column) -> Column:
    """Two maps as one, the second over the first; null is an empty map.  No key is ever there twice, so no session setting matters."""
    under = F.coalesce(under, F.map_filter(over, lambda k, v: F.lit(False)))
    kept = F.map_filter(under, lambda k, v: ~F.array_contains(F.map_keys(over), k))
    return F.when(over.isNull(), under).otherwise(F.map_concat(kept, over))


def merge_unit_rows(rows: DataFrame) -> DataFrame:
    """The unit rows of each (source, record) as one observation, and how many units it has in ``metadata``.

    In the order of fetching and payload: the earliest time, all units in order,
    the first type and location that are known, later metadata over earlier.
    """
    order = F.struct("fetched_us", F.coalesce(F.element_at("units", 1), F.lit("")))
    place = F.struct("location_raw", "neighborhood", "lat", "lng")
    known = F.coalesce("location_raw", "neighborhood", F.col("lat").cast("string")).isNotNull()
    first = lambda c, there: F.min_by(F.when(there, c), F.when(there, order))
    by_order = lambda x, y: F.when(x["o"] < y["o"], -1).when(x["o"] > y["o"], 1).otherwise(0)
    listed = F.array_sort(F.collect_list(F.struct(order.alias("o"), "metadata", "unit_times")), by_order)
    last_wins = lambda field: F.aggregate(F.col("all"), F.create_map().cast(rows.schema[field].dataType), lambda a, x: overlaid(a, x[field]))
    folded = rows.where("rejected is null").groupBy("source", "source_record_id").agg(
        F.first("id").alias("id"), F.min_by("agency", order).alias("agency"), F.min("us").alias("us"), F.max("fetched_us").alias("fetched_us"),
        first(F.col("raw_type"), F.col("raw_type").isNotNull()).alias("raw_type"), F.min_by("priority", order).alias("priority"),
        first(place, known).alias("place"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("units")))).alias("units"), listed.alias("all"),
    )
    units = F.size("units").cast("string")
    return folded.select(
        "id", "source", "source_record_id", "agency", "us", "fetched_us", "raw_type", "priority", "place.*", "units", last_wins("unit_times").alias("unit_times"),
        overlaid(last_wins("metadata"), F.create_map(F.lit("unit_count"), units)).alias("metadata"),
    )


def after_cursor(time_col: str, id_col: str, time: str, record_id: str) -> Column:
    """The keyset predicate: rows behind (time, id) in that order."""
    return (F.col(time_col) > time) | ((F.col(time_col) == time) & (F.col(id_col) > record_id))


def since_cursor(time_us: Column, cursor_us: int | None, overlap_seconds: int = 120) -> Column:
    """Rows from a little before the cursor on, as late rows are published behind it; no cursor: all."""
    return F.lit(True) if cursor_us is None else time_us >= cursor_us - overlap_seconds * 1_000_000


def keyset_pages(rows: DataFrame, time_col: str, id_col: str, page_size: int) -> DataFrame:
    """Adds ``page``: the number of the keyset page a row is on, without a sort of all rows in one task.

    Pages are counted over the rows of a partition of the sorted table, and
    partitions start where the counts of those before them end.
    """
    ordered = rows.sort(time_col, id_col).withColumn("__p", F.spark_partition_id()).withColumn("__n", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = ordered.groupBy("__p").agg(F.count("*").alias("n"))  # a row a partition
    before = sizes.alias("a").join(F.broadcast(sizes.alias("b")), F.col("b.__p") < F.col("a.__p"), "left").groupBy(F.col("a.__p").alias("__p")).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("__before"))
    return ordered.join(F.broadcast(before), "__p").withColumn("page", F.floor((F.col("__n") + F.col("__before")) / page_size).cast("long")).drop("__p", "__n", "__before")
