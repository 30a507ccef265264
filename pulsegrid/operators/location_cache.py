"""Places resolved once: a table of canonical texts with their points, which grows by what is new."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE = "canonical string, geo_lat double, geo_lng double, geo_area string, method string, geo_confidence double, reason string"
_COLUMNS = [c.split()[0] for c in CACHE.split(", ")]


def new_places(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """``id, lat, lng, neighborhood, parsed`` of the canonical texts of ``rows`` that the cache lacks, one row each.

    ``rows``: ``parsed`` with at least kind, canonical, streets and
    address_number.  Texts without a canonical form resolve to nothing and are
    not kept.
    """
    named = rows.select(F.col("parsed.canonical").alias("id"), "parsed").where("id is not null and id <> ''")
    unique = named.groupBy("id").agg(F.min("parsed").alias("parsed"))
    fresh = unique.join(cache.select(F.col("canonical").alias("id")), "id", "left_anti")
    none = {"lat": F.lit(None).cast("double"), "lng": F.lit(None).cast("double"), "neighborhood": F.lit(None).cast("string")}
    return fresh.withColumns(none).select("id", "lat", "lng", "neighborhood", "parsed")


def grown(cache: DataFrame, rows: DataFrame, resolve: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The cache with what ``resolve`` (as ``geocode.geocode``) finds for the texts that are new; a second time nothing is resolved."""
    found = resolve(new_places(cache, rows)).withColumnRenamed("id", "canonical")
    return cache.select(*_COLUMNS).unionByName(found.select(*_COLUMNS))


def placed(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """``rows`` with the record's own point, else that of the cache, and how it was found."""
    kept = cache.select(F.col("canonical").alias("__canonical"), *[F.col(c).alias(f"__{c}") for c in _COLUMNS[1:]])
    joined = rows.join(kept, F.col("parsed.canonical") == F.col("__canonical"), "left")
    own = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    method = F.when(own, "source_coordinates").otherwise(F.coalesce("__method", F.lit("unresolved")))
    return joined.select(
        *rows.columns, F.when(own, F.col("lat")).otherwise(F.col("__geo_lat")).alias("geo_lat"), F.when(own, F.col("lng")).otherwise(F.col("__geo_lng")).alias("geo_lng"), method.alias("method")
    )
