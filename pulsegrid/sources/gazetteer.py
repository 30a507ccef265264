"""Reference data from raw feeds: corners with their points, street segments with number ranges, and areas with polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.geo import box_of_geometry
from pulsegrid.functions.locations import Vocabulary, normalize_location, street_name
from pulsegrid.session import cut_lineage

_POINT = "struct<lat:double,lng:double>"
_RING = "array<array<double>>"


def corners(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``canonical, street_a, street_b, lat, lng, records`` of ``intersection_name, lat, lng`` records.

    Records are counted by name and point before any name is read, so each name
    is read once; of a corner's points that of the most records counts, then the
    smallest name and point.  Names that are no corner of two streets are left out.
    """
    counted = rows.where("intersection_name is not null and lat is not null and lng is not null").groupBy("intersection_name", "lat", "lng").agg(F.count("*").alias("records"))
    names = cut_lineage(counted.select("intersection_name").distinct().withColumn("p", normalize_location(F.col("intersection_name"), vocabulary)))
    read = counted.join(names.where("p.kind = 'intersection' and size(p.streets) >= 2"), "intersection_name")
    order = F.struct((-F.col("records")).alias("less"), "intersection_name", "lat", "lng")
    best = read.groupBy(F.col("p.canonical").alias("canonical")).agg(F.min_by(F.struct(F.col("p.streets").alias("streets"), "lat", "lng", "records"), order).alias("b"))
    return best.select("canonical", F.get("b.streets", F.lit(0)).alias("street_a"), F.get("b.streets", F.lit(1)).alias("street_b"), "b.lat", "b.lng", "b.records")


def _points(pairs: Column) -> Column:
    """``[lng, lat]`` pairs as points; pairs that are not whole are left out."""
    made = F.transform(pairs, lambda p: F.struct(F.get(p, F.lit(1)).alias("lat"), F.get(p, F.lit(0)).alias("lng")))
    return F.filter(made, lambda p: p["lat"].isNotNull() & p["lng"].isNotNull())


def _number(text: Column) -> Column:
    n = text.try_cast("double")
    return F.when((n > 0) & (n < 1e9), F.floor(n + 0.5).cast("int"))


def segments(feed: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``cnn, street, left_from, left_to, right_from, right_to, line, neighborhood, south, north, west, east`` of centerline records in ``payload``.

    Records without a key, street or line and those that are not active are left
    out; numbers that are not above 0 are null.
    """
    fields = "cnn string, street string, st_type string, lf_fadd string, lf_toadd string, rt_fadd string, rt_toadd string, nhood string, active string, line struct<type:string,coordinates:array<array<double>>>"
    r = feed.select(F.from_json("payload", fields).alias("r")).select("r.*")
    line = _points(F.col("line.coordinates"))
    named = street_name(F.trim(F.concat_ws(" ", "street", "st_type")), vocabulary)
    rows = r.where("cnn is not null and cnn <> '' and street is not null and street <> '' and coalesce(active, 'true') <> 'false'").select(
        "cnn", named.alias("street"), *[_number(F.col(f)).alias(n) for f, n in (("lf_fadd", "left_from"), ("lf_toadd", "left_to"), ("rt_fadd", "right_from"), ("rt_toadd", "right_to"))], line.alias("line"), F.col("nhood").alias("neighborhood")
    )
    lat, lng = F.transform("line", lambda p: p["lat"]), F.transform("line", lambda p: p["lng"])
    box = {"south": F.array_min(lat), "north": F.array_max(lat), "west": F.array_min(lng), "east": F.array_max(lng)}
    return rows.where(F.size("line") > 0).where("street is not null and street <> ''").select("*", *[v.alias(k) for k, v in box.items()])


def areas(feed: DataFrame) -> DataFrame:
    """``name, geometry, south, north, west, east`` of polygon records in ``payload``; a polygon is a multipolygon of one.

    Records without a name or a polygon that can be read are left out.
    """
    r = feed.select(F.from_json("payload", "nhood string, the_geom struct<type:string,coordinates:string>").alias("r")).select("r.nhood", "r.the_geom.*")
    rings = lambda polygon: F.transform(polygon, _points)
    one = F.array(rings(F.from_json("coordinates", f"array<{_RING}>")))
    many = F.transform(F.from_json("coordinates", f"array<array<{_RING}>>"), rings)
    shape = F.when(F.col("type") == "MultiPolygon", many).when(F.col("type") == "Polygon", one)
    rows = r.select(F.col("nhood").alias("name"), shape.alias("geometry")).where("name is not null and name <> '' and geometry is not null")
    boxed = rows.withColumn("box", box_of_geometry(F.col("geometry"))).where("box.south is not null")
    return boxed.select("name", "geometry", "box.*")


def loaded(stored: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """The stored table with incoming rows in place of those of their key; of several incoming rows of a key the last by ``order``."""
    rest = [c for c in stored.columns if c != key]
    last = incoming.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")
    return stored.join(last.select(key), key, "left_anti").unionByName(last.select(*stored.columns))
