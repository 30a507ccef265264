"""What the public may see and when: delays, restricted calls, and records as they were public at a moment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.geocode import snap
from pulsegrid.operators.range_join import MINUTE
from pulsegrid.sources.observations import mapped

#: Minutes until a call is public: by default, and for types and sources that ask for more; the longest counts.
DELAY = 3
TYPE_DELAYS = {"weapon": 30, "assault": 15}
SOURCE_DELAYS = {"sf_police_report": 0, "sf_police_cad": 10}
#: Columns that are published; a point is given at block precision.
PUBLIC = ("id", "source", "occurred_at", "type", "neighborhood", "lat", "lng")
#: Microseconds of one bucket in which versions and requests are ordered together.
BUCKET = 24 * 60 * MINUTE


def visibility(sensitive: Column) -> Column:
    """``restricted`` for calls that their source marks as sensitive, else ``delayed``."""
    return F.when(F.coalesce(sensitive.cast("boolean"), F.lit(False)), "restricted").otherwise("delayed")


def delay_us(source: Column, kind: Column) -> Column:
    minutes = lambda c, values: mapped(c, {k: str(v) for k, v in values.items()}).cast("int")
    return F.greatest(F.coalesce(minutes(source, SOURCE_DELAYS), F.lit(DELAY)), F.coalesce(minutes(kind, TYPE_DELAYS), F.lit(0))).cast("long") * MINUTE


def publish_us(us: Column, source: Column, kind: Column, sensitive: Column) -> Column:
    """When a call becomes public; null if never."""
    return F.when(visibility(sensitive) != "restricted", us + delay_us(source, kind))


def public_rows(rows: DataFrame, at_us: int) -> DataFrame:
    """What of the observations is public at a moment, in the published columns alone."""
    shown = rows.where(F.coalesce(publish_us(F.col("us"), F.col("source"), F.col("type"), F.col("sensitive")) <= at_us, F.lit(False)))
    return shown.select(*[snap(F.col(c)).alias(c) if c in ("lat", "lng") else F.col(c) for c in PUBLIC])


def incidents_public(members: DataFrame) -> DataFrame:
    """``incident_id, public_us``: the first call that may be published and the longest delay of those; null if none may."""
    may = F.col("sensitive").isNull() | (F.col("sensitive").cast("int") == 0)
    wait = delay_us(F.col("source"), F.col("type"))
    return members.groupBy("incident_id").agg((F.min(F.when(may, F.col("us"))) + F.max(F.when(may, wait))).alias("public_us"))


def as_of(versions: DataFrame, requests: DataFrame, columns: list[str]) -> DataFrame:
    """``request_id, record, at_us`` with the ``columns`` of the record's latest version public by then; null if there is none.

    ``versions``: record, version, publish_us and ``columns``; those never
    published are left out.  Of one moment the largest version counts.  Versions
    and requests are ordered within buckets of time, and buckets by their last
    version, so a record with a long history is not one task.
    """
    held = F.struct("publish_us", "version", *columns)
    out = versions.where("record is not null and publish_us is not null").select("record", F.col("publish_us").alias("t"), F.lit(0).alias("asked"), F.lit(None).cast(requests.schema["request_id"].dataType).alias("request_id"), F.col("version").alias("__version"), held.alias("v"))
    nothing = F.lit(None).cast(out.schema["v"].dataType)
    ask = requests.select("record", F.col("at_us").alias("t"), F.lit(1).alias("asked"), "request_id", F.lit(None).cast(out.schema["__version"].dataType).alias("__version"), nothing.alias("v"))
    both = out.unionByName(ask).withColumn("bucket", F.floor(F.col("t") / BUCKET))
    order = Window.partitionBy("record", "bucket").orderBy("t", "asked", "__version")
    told = both.withColumn("own", F.last("v", ignorenulls=True).over(order)).where("asked = 1")
    ends = both.groupBy("record", "bucket").agg(F.max_by("v", F.when(F.col("v").isNotNull(), F.struct("t", "__version"))).alias("end"))
    before = Window.partitionBy("record").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("record", "bucket", F.last("end", ignorenulls=True).over(before).alias("carried"))
    done = told.join(carried, ["record", "bucket"], "left").withColumn("v", F.coalesce("own", "carried"))
    return done.select("request_id", "record", F.col("t").alias("at_us"), F.col("v.version").alias("version"), *[F.col(f"v.{c}").alias(c) for c in columns])
