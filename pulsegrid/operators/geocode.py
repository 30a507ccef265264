"""Location text to a point: the record's own point, then corners, then address ranges, and areas by polygon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.geo import box_of_geometry, haversine_meters, in_geometry

#: Confidence of a method.
CONFIDENCE = {"source_coordinates": 0.95, "intersection_lookup": 0.9, "block_interpolation": 0.6, "unresolved": 0.0}
#: Degrees of a map cell in which polygons and points meet.
CELL = 0.01


def snap(value: Column) -> Column:
    """A coordinate at block precision, four decimals."""
    return F.floor(value * 10_000 + 0.5) / 10_000


def point_along(line: Column, fraction: Column) -> Column:
    """The point ``struct<lat, lng>`` at a fraction of the length of ``array<struct<lat, lng>>``; null for an empty line."""
    steps = F.zip_with(F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0))), F.slice(line, 2, F.greatest(F.size(line), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b"), F.coalesce(haversine_meters(a["lat"], a["lng"], b["lat"], b["lng"]), F.lit(0.0)).alias("d")))
    steps = F.filter(steps, lambda s: s["b"].isNotNull())
    total = F.aggregate(steps, F.lit(0.0), lambda t, s: t + s["d"])
    target = F.least(F.greatest(fraction, F.lit(0.0)), F.lit(1.0)) * total
    between = lambda s, left: F.struct(
        (s["a"]["lat"] + (s["b"]["lat"] - s["a"]["lat"]) * F.coalesce(F.try_divide(left, s["d"]), F.lit(0.0))).alias("lat"),
        (s["a"]["lng"] + (s["b"]["lng"] - s["a"]["lng"]) * F.coalesce(F.try_divide(left, s["d"]), F.lit(0.0))).alias("lng"),
    )
    # walks the steps until the target lies in one
    start = F.struct(target.alias("left"), F.lit(None).cast("struct<lat:double,lng:double>").alias("at"))
    walked = F.aggregate(
        steps, start,
        lambda w, s: F.when(w["at"].isNotNull(), w).when(w["left"] > s["d"], F.struct((w["left"] - s["d"]).alias("left"), w["at"].alias("at"))).otherwise(F.struct(w["left"].alias("left"), between(s, w["left"]).alias("at"))),
    )
    end = F.element_at(line, -1)
    plain = lambda p: F.struct(p["lat"].cast("double").alias("lat"), p["lng"].cast("double").alias("lng"))
    moved = F.when(total == 0, plain(F.element_at(line, 1))).otherwise(F.coalesce(walked["at"], plain(end)))
    return F.when(F.size(line) > 0, moved)


def area_of_points(points: DataFrame, polygons: DataFrame, order: str = "position") -> DataFrame:
    """``id, area`` of located points: the first polygon, by ``order``, that holds the point.

    ``points``: id, lat, lng; ``polygons``: name, position, geometry (an array of
    polygons of rings of ``struct<lat, lng>``).  Both meet on map cells of the
    polygons' boxes, so no point is tried against all polygons.
    """
    cell = lambda v: F.floor(v / CELL).cast("long")
    boxed = polygons.withColumn("box", box_of_geometry(F.col("geometry")))
    spread = (
        boxed.withColumn("__row", F.explode(F.sequence(cell(F.col("box.south")), cell(F.col("box.north")))))
        .withColumn("__col", F.explode(F.sequence(cell(F.col("box.west")), cell(F.col("box.east")))))
        .select(F.col("name").alias("area"), F.col(order).alias("__order"), "geometry", "__row", "__col")
    )
    placed = points.where("lat is not null and lng is not null").select("id", "lat", "lng", cell(F.col("lat")).alias("__row"), cell(F.col("lng")).alias("__col"))
    met = placed.join(spread, ["__row", "__col"]).where(in_geometry(F.col("geometry"), F.col("lat"), F.col("lng")))
    return met.groupBy("id").agg(F.min_by("area", "__order").alias("area"))


def geocode(rows: DataFrame, intersections: DataFrame, segments: DataFrame, polygons: DataFrame) -> DataFrame:
    """Adds ``geo_lat, geo_lng, geo_area, method, geo_confidence, reason`` to ``id, lat, lng, neighborhood, parsed`` rows.

    The record's own point comes first; a corner is looked up by its canonical
    name; an address or block is placed along the first segment, by its
    ``position``, of its street whose left or right range holds the number (0
    and null are no range).  An area that the record names stays, else it is the
    segment's, else that of the polygon around the point.  What stays unresolved
    says why.  Ids are taken to be unique.
    """
    own = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    corners = intersections.groupBy(F.col("canonical").alias("__canonical")).agg(F.min(F.struct("lat", "lng")).alias("corner"))
    kind, canonical = F.col("parsed.kind"), F.col("parsed.canonical")
    on = (canonical == corners["__canonical"]) & (kind == "intersection") & ~own
    placed = rows.join(corners, on, "left").drop("__canonical")

    def holds(side: str) -> Column:
        a, b = F.col(f"{side}_from"), F.col(f"{side}_to")
        return (a != 0) & (b != 0) & F.col("number").between(F.least(a, b), F.greatest(a, b))

    def share(side: str) -> Column:
        low, high = F.least(f"{side}_from", f"{side}_to"), F.greatest(f"{side}_from", f"{side}_to")
        return F.coalesce(F.try_divide(F.col("number") - low, high - low), F.lit(0.0))

    asked = rows.where(~own & kind.isin("address", "block") & F.col("parsed.address_number").isNotNull()).select("id", F.element_at("parsed.streets", 1).alias("street"), F.col("parsed.address_number").alias("number"))
    met = asked.join(segments, "street").where(F.coalesce(holds("left"), F.lit(False)) | F.coalesce(holds("right"), F.lit(False)))
    fraction = F.when(F.coalesce(holds("left"), F.lit(False)), share("left")).otherwise(share("right"))
    first = met.select("id", "position", F.col("neighborhood").alias("area"), point_along(F.col("line"), fraction).alias("at")).where("at is not null")
    first = first.groupBy("id").agg(F.min(F.struct("position", "at", "area")).alias("segment"))
    placed = placed.join(first, "id", "left")
    method = F.when(own, "source_coordinates").when(F.col("corner").isNotNull(), "intersection_lookup").when(F.col("segment").isNotNull(), "block_interpolation").otherwise("unresolved")
    lat = F.when(own, F.col("lat")).otherwise(F.coalesce("corner.lat", "segment.at.lat"))
    lng = F.when(own, F.col("lng")).otherwise(F.coalesce("corner.lng", "segment.at.lng"))
    done = placed.withColumns({"geo_lat": lat, "geo_lng": lng, "method": method})
    areas = area_of_points(done.select("id", F.col("geo_lat").alias("lat"), F.col("geo_lng").alias("lng")), polygons)
    reason = F.when(kind == "unknown", "unparseable_location_text").when(kind == "intersection", "intersection_not_in_gazetteer").otherwise("no_matching_street_segment")
    levels = F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])
    return done.join(areas, "id", "left").select(
        *rows.columns, "geo_lat", "geo_lng", F.coalesce("neighborhood", "segment.area", "area").alias("geo_area"), "method",
        levels[F.col("method")].alias("geo_confidence"), F.when(F.col("method") == "unresolved", reason).alias("reason"),
    )


def busiest_point(rows: DataFrame) -> DataFrame:
    """``canonical, lat, lng, records``: the point that most records of a corner agree on; ties by latitude, then longitude."""
    counted = rows.where("lat is not null and lng is not null").groupBy("canonical", "lat", "lng").agg(F.count("*").alias("records"))
    best = counted.groupBy("canonical").agg(F.max_by(F.struct("lat", "lng", "records"), F.struct("records", "lat", "lng")).alias("b"))
    return best.select("canonical", "b.*")


def geocode_report(done: DataFrame) -> DataFrame:
    """``source, method, records, located, locatable``: how a batch was placed; withheld locations do not count as locatable."""
    return done.groupBy("source", "method").agg(
        F.count("*").alias("records"), F.count("geo_lat").alias("located"), F.count_if(F.coalesce(F.col("sensitive"), F.lit(0)) == 0).alias("locatable")
    )
