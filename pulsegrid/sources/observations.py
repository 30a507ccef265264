"""Observations: the normalized row every analytic works on, projected from an ``events`` table.

The projection is arithmetic only, so the same rows can be stated in SQL (see OBSERVATIONS_SQL).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.session import table

#: Event type to normalized type.
TYPES = {"error": "collision", "click": "medical", "view": "assault", "purchase": "theft", "signup": "unknown"}
#: Source to agency; written reports belong to the agency of the calls.
AGENCIES = {"sf_police_cad": "police", "sf_fire_cad": "fire", "sf_ems_cad": "ems", "sf_police_report": "police"}
#: Sources that are dispatch calls.
DISPATCH_SOURCES = ("sf_police_cad", "sf_fire_cad", "sf_ems_cad")


def mapped(column: Column, values: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for key, value in values.items():
        out = F.when(column == key, F.lit(value)).otherwise(out)
    return out


def agency_of(source: Column) -> Column:
    return F.coalesce(mapped(source, AGENCIES), source)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, source, occurred_at, us, k, user_id, raw_type, type, priority_rank, sensitive, lat, lng, neighborhood, units``."""
    k = F.get_json_object("props", "$.k").cast("int")
    hidden = F.col("k") % 10 < 3
    number = lambda x: F.lit(float(x))
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "user_id", "event_type", F.col("ts").cast("timestamp").alias("occurred_at"), k.alias("k")
    )
    lat = number(37.7) + (F.col("user_id") % 12) * number(0.006) + (F.col("k") % 2) * number(0.0009)
    return rows.select(
        "id", F.element_at(F.array(*map(F.lit, DISPATCH_SOURCES)), (F.col("id") % 3 + 1).cast("int")).alias("source"),
        "occurred_at", F.unix_micros("occurred_at").alias("us"), "k", "user_id",
        F.col("event_type").alias("raw_type"), F.coalesce(mapped(F.col("event_type"), TYPES), F.lit("unknown")).alias("type"),
        (F.col("k") % 5 + 1).alias("priority_rank"), F.when(hidden, 1).otherwise(0).alias("sensitive"),
        F.when(~hidden, lat).alias("lat"),
        F.when(~hidden, number(-122.5) + (F.col("user_id") % 7) * number(0.006)).alias("lng"),
        F.when(~hidden | (F.col("k") % 20 == 1), F.concat(F.lit("N"), F.col("user_id") % 41)).alias("neighborhood"),
        F.when(F.col("k") % 2 == 0, F.array(F.concat(F.lit("M"), F.col("user_id") % 9))).otherwise(F.array().cast("array<string>")).alias("units"),
    )


#: The same rows as a DuckDB CTE named ``obs``.
OBSERVATIONS_SQL = """
obs as (
  select event_id as id, user_id, ts as occurred_at, epoch_us(ts) as us, k, event_type as raw_type,
    case event_id % 3 when 0 then 'sf_police_cad' when 1 then 'sf_fire_cad' else 'sf_ems_cad' end as source,
    case event_type when 'error' then 'collision' when 'click' then 'medical' when 'view' then 'assault'
      when 'purchase' then 'theft' else 'unknown' end as type,
    k % 5 + 1 as priority_rank, case when k % 10 < 3 then 1 else 0 end as sensitive,
    case when k % 10 >= 3 then 37.7::double + (user_id % 12) * 0.006::double + (k % 2) * 0.0009::double end as lat,
    case when k % 10 >= 3 then -122.5::double + (user_id % 7) * 0.006::double end as lng,
    case when k % 10 >= 3 or k % 20 = 1 then 'N' || (user_id % 41) end as neighborhood,
    case when k % 2 = 0 then ['M' || (user_id % 9)] else []::varchar[] end as units
  from (select *, cast(json_extract_string(props, '$.k') as int) as k from events))
"""
