"""Digests, rollups, the data gate, revisions of payloads and checks of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.ingest import VOLATILE
from pulsegrid.operators.range_join import MINUTE
from pulsegrid.operators.timeline import dispatch_agency, severity_rank

HOUR = 60 * MINUTE
DAY = 24 * HOUR
#: Names of windows and their minutes (0: no bound), the one taken by default, and the city's box.
WINDOWS = {"15m": 15, "1h": 60, "4h": 240, "8h": 480, "24h": 1440, "3d": 4320, "7d": 10080, "30d": 43200, "90d": 129600, "all": 0}
DEFAULT_WINDOW = "24h"
CITY = {"south": 37.705, "north": 37.812, "west": -122.517, "east": -122.357}
#: Fixed values of the gate: hours of coverage, hours behind, versions a record.
COVERAGE_HOURS, BEHIND_HOURS, VERSIONS = 72, 3, 10
#: Hours after a day until its counts no longer move: the longest quiet limit and the longest delay, rounded up.
SETTLE_HOURS = 4
#: Types reported, comparable calls read, and days of trend beyond which weeks are shown.
TOP_TYPES, COMPARABLE, WEEKLY_BEYOND = 14, 400, 30


def window_start(name: str | None, now_us: int) -> int | None:
    """The lower bound of a named window; none for ``all`` and for names that are not known."""
    minutes = WINDOWS.get(name or "", 0)
    return now_us - minutes * MINUTE if minutes else None


def within_city(lat: Column, lng: Column) -> Column:
    return lat.between(CITY["south"], CITY["north"]) & lng.between(CITY["west"], CITY["east"])


def data_gate(observations: DataFrame, payloads: DataFrame, lost_gaps: int, now_us: int) -> DataFrame:
    """One row ``hours, passes, reasons``: whether ingestion has run long enough, is current, and repeats nothing.

    ``observations``: id, source, source_record_id, us, type; ``payloads``:
    source, source_record_id, payload_hash.
    """
    whole = observations.agg(F.count("*").alias("total"), F.count_if(F.coalesce(F.col("type"), F.lit("unknown")) != "unknown").alias("typed"), F.min("us").alias("first"), F.max("us").alias("last"))
    again = observations.groupBy("source", "source_record_id").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated"))
    kept = payloads.groupBy("source", "source_record_id").agg(F.count("*").alias("n")).agg(F.sum("n").alias("versions"), F.count("*").alias("records"))
    one = whole.crossJoin(again).crossJoin(kept)  # one row each
    hours = F.coalesce((F.col("last") - F.col("first")) / HOUR, F.lit(0.0))
    checks = [
        (hours < COVERAGE_HOURS, "coverage"), ((F.lit(now_us) - F.col("last")) / HOUR > BEHIND_HOURS, "behind"), (F.col("repeated") > 0, "repeated records"),
        (F.try_divide(F.col("versions"), F.col("records")) > VERSIONS, "payload versions"), (F.lit(lost_gaps) > 0, "lost gaps"), (F.col("total") == 0, "no observations"),
        ((F.col("total") > 0) & (F.col("typed") == 0), "nothing typed"),
    ]
    reasons = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for bad, name in checks]))
    return one.select(hours.alias("hours"), (F.size(reasons) == 0).alias("passes"), reasons.alias("reasons"))


def activity_digest(incidents: DataFrame, areas: DataFrame, from_us: int, to_us: int) -> DataFrame:
    """A row for every area of ``areas``: incidents, open ones, counts by type and agency, the latest and the gravest.

    ``incidents``: incident_id, neighborhood, first_us, last_us, primary_type,
    severity, status, agencies, units.  Gravest is the highest severity, then
    most units, then the latest, then the smallest id.  A quiet area has zeros.
    """
    rows = incidents.where((F.col("first_us") >= from_us) & (F.col("first_us") < to_us) & F.col("neighborhood").isNotNull())
    grave = F.struct(-severity_rank(F.col("severity")), -F.size("units"), -F.col("first_us"), F.col("incident_id"))
    whole = rows.groupBy("neighborhood").agg(
        F.count("*").alias("incidents"), F.count_if(F.col("status") != "resolved").alias("open"), F.min_by("incident_id", F.struct(-F.col("first_us"), F.col("incident_id"))).alias("latest"), F.min_by("incident_id", grave).alias("gravest")
    )
    told = lambda of, name: of.groupBy("neighborhood", "value").agg(F.count("*").alias("n")).groupBy("neighborhood").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("value", "n"))), lambda x: F.concat_ws("=", x["value"], x["n"].cast("string"))), ",").alias(name)
    )
    by_type = told(rows.select("neighborhood", F.col("primary_type").alias("value")), "by_type")
    by_agency = told(rows.select("neighborhood", F.explode("agencies").alias("value")), "by_agency")
    joined = areas.select("neighborhood").distinct().join(whole, "neighborhood", "left").join(by_type, "neighborhood", "left").join(by_agency, "neighborhood", "left")
    return joined.fillna(0, ["incidents", "open"]).fillna("", ["by_type", "by_agency"])


def top_types(rows: DataFrame, now_us: int, days: tuple[int, ...] = (7, 30, 90), most: int = TOP_TYPES) -> DataFrame:
    """``days, type, calls, place``: the commonest types of windows that end now (a top-k report); all windows from one count by type."""
    counts = rows.where(F.col("us") <= now_us).groupBy("type").agg(*[F.count_if(F.col("us") >= now_us - d * DAY).alias(f"d{d}") for d in days])
    flat = counts.select("type", F.inline(F.array(*[F.struct(F.lit(d).alias("days"), F.col(f"d{d}").alias("calls")) for d in days]))).where("calls > 0")
    place = F.row_number().over(Window.partitionBy("days").orderBy(F.desc("calls"), "type"))
    return flat.withColumn("place", place).where(F.col("place") <= most).select("days", "type", "calls", "place")


def trend(rows: DataFrame, now_us: int, days: int) -> DataFrame:
    """``type, start_us, calls``: a type's calls by day, or by week where ``days`` is above WEEKLY_BEYOND; buckets end now, empty ones too."""
    width = (7 if days > WEEKLY_BEYOND else 1) * DAY
    n = -(-days * DAY // width)
    seen = rows.where((F.col("us") >= now_us - n * width) & (F.col("us") < now_us)).groupBy("type", F.floor((F.lit(now_us) - 1 - F.col("us")) / width).alias("back")).agg(F.count("*").alias("calls"))
    grid = rows.select("type").distinct().select("type", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("back"))
    return grid.join(seen, ["type", "back"], "left").select("type", (F.lit(now_us) - (F.col("back") + 1) * width).alias("start_us"), F.coalesce("calls", F.lit(0)).alias("calls"))


def settled_rollup(incidents: DataFrame, now_us: int, versions: dict[int, str]) -> DataFrame:
    """``day, neighborhood, type, agency, incidents, version`` of days that are settled; merged incidents do not count.

    ``versions``: from which day on a version of the pipeline holds.  Made again
    from the same incidents, the same rows.
    """
    day = F.floor(F.col("first_us") / DAY)
    live = incidents.where("merged_into_id is null").where((day + 1) * DAY + SETTLE_HOURS * HOUR <= now_us)
    version = F.lit(None).cast("string")
    for start in sorted(versions):
        version = F.when(F.col("day") >= start, F.lit(versions[start])).otherwise(version)
    rows = live.select(day.alias("day"), "neighborhood", F.col("primary_type").alias("type"), F.explode("agencies").alias("agency"))
    return rows.groupBy("day", "neighborhood", "type", "agency").agg(F.count("*").alias("incidents")).withColumn("version", version)


def comparable_calls(rows: DataFrame, since_us: int, most: int = COMPARABLE) -> DataFrame:
    """The newest ``most`` calls of every type and area (a top-k report), with ``place``."""
    order = Window.partitionBy("type", "neighborhood").orderBy(F.desc("us"), "id")
    return rows.where((F.col("us") >= since_us) & F.col("neighborhood").isNotNull()).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def payload_revisions(payloads: DataFrame) -> DataFrame:
    """``record, series, us, field, before, after`` of ``record, us, payload_id, payload`` rows, the payload a map.

    Feeds publish several rows of a record; a payload is only compared with the
    one before of its own row, which ``rowid`` or ``row_id`` names, never ``id``.
    Volatile fields say nothing.  A null payload is an empty one.
    """
    named = lambda key: F.nullif(F.trim(F.try_element_at("payload", F.lit(key))), F.lit(""))
    rows = payloads.withColumn("payload", F.coalesce("payload", F.create_map().cast("map<string,string>"))).withColumn("series", F.coalesce(named("rowid"), named("row_id"), F.lit("")))
    order = Window.partitionBy("record", "series").orderBy("us", "payload_id")
    seen = rows.select("record", "series", "us", "payload", F.lag("payload").over(order).alias("was")).where("was is not null")
    fields = F.filter(F.array_sort(F.array_union(F.map_keys("payload"), F.map_keys("was"))), lambda k: ~k.isin(*VOLATILE))
    changes = F.filter(
        F.transform(fields, lambda k: F.struct(k.alias("field"), F.try_element_at("was", k).alias("before"), F.try_element_at("payload", k).alias("after"))), lambda c: ~c["before"].eqNullSafe(c["after"])
    )
    return seen.select("record", "series", "us", F.inline(changes))


def day_separators(rows: DataFrame) -> DataFrame:
    """Rows of a feed, newest first, with ``new_day`` where the day differs from the row above; ordered within days, days by their last row."""
    day = F.floor(F.col("us") / DAY)
    within = Window.partitionBy("day").orderBy(F.desc("us"), "id")
    return rows.withColumn("day", day).withColumn("new_day", F.row_number().over(within) == 1)


#: Checks that records are held against; each says what it asks for.
def text(value: Column) -> Column:
    return F.when(value.isNull() | (value == ""), F.lit("text is missing"))


def number(value: Column) -> Column:
    n = value.try_cast("double")
    return F.when(n.isNull() | F.isnan(n), F.lit("no number"))


def truth(value: Column) -> Column:
    return F.when(~F.coalesce(F.lower(value).isin("true", "false"), F.lit(False)), F.lit("neither true nor false"))


def one_of(*allowed: str):
    return lambda value: F.when(~F.coalesce(value.isin(*allowed), F.lit(False)), F.lit(f"none of {', '.join(allowed)}"))


def instant(value: Column) -> Column:
    return F.when(value.try_cast("timestamp").isNull(), F.lit("no time"))


def optional(check):
    return lambda value: F.when(value.isNotNull(), check(value))


def violations(checks: dict) -> Column:
    """All that is wrong with a record, ``field: what``, in the order of the checks; empty for a good one."""
    return F.array_compact(F.array(*[F.when(check(F.col(f"`{f}`")).isNotNull(), F.concat(F.lit(f"{f}: "), check(F.col(f"`{f}`")))) for f, check in checks.items()]))


def agency_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(dispatch_agency(F.col("source")).alias("agency")).agg(F.count("*").alias("calls"))
