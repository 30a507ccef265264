"""What is usual by area, type and hour of the week, and how a day compares with it.

Counts are of reported dispatch calls, nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.range_join import MINUTE
from pulsegrid.operators.timeline import TYPE_LABELS

HOUR = 60 * MINUTE
DAY, WEEK, HOURS = 24 * HOUR, 168 * HOUR, 168
#: Weeks of history, deviations that are still usual, and the least band, so that one call in a quiet area alarms nobody.
WEEKS, DEVIATIONS, LEAST_BAND = 4, 1.0, 1.0
TYPES = (*TYPE_LABELS, "unknown")


def hour_of_week(us: Column) -> Column:
    """0 to 167, from Thursday midnight UTC as the epoch began."""
    return F.pmod(F.floor(us / HOUR), F.lit(HOURS)).cast("int")


def hourly_baseline(calls: DataFrame, at_us: int, weeks: int = WEEKS) -> DataFrame:
    """``neighborhood, type, hour_of_week, expected, deviation, enough`` for every area, type and hour, those without calls too.

    Weeks are the ``weeks`` before ``at_us``; a week without a call in the hour
    counts as zero.  ``enough`` says whether the area's first call is that old.
    Calls without an area are left out, types that are not listed count as
    unknown.  Areas are the only side of the grid that comes from the rows.
    """
    kind = F.when(F.col("type").isin(*TYPES), F.col("type")).otherwise("unknown")
    rows = calls.where("neighborhood is not null and us is not null").select("neighborhood", kind.alias("type"), "us")
    areas = rows.where(F.col("us") < at_us).groupBy("neighborhood").agg((F.min("us") <= at_us - weeks * WEEK).alias("enough"))
    hours = F.explode(F.sequence(F.lit(0), F.lit(HOURS - 1))).alias("hour_of_week")
    grid = areas.select("*", F.explode(F.array(*map(F.lit, TYPES))).alias("type")).select("*", hours)
    past = rows.where((F.col("us") >= at_us - weeks * WEEK) & (F.col("us") < at_us))
    by_week = past.groupBy("neighborhood", "type", hour_of_week(F.col("us")).alias("hour_of_week"), F.floor((F.lit(at_us) - 1 - F.col("us")) / WEEK).alias("week")).agg(F.count("*").alias("n"))
    key = ["neighborhood", "type", "hour_of_week"]
    last_first = F.array(*[F.coalesce(F.sum(F.when(F.col("week") == w, F.col("n"))), F.lit(0)) for w in range(weeks)])
    sums = by_week.groupBy(*key).agg(last_first.alias("counts"))
    whole = grid.join(sums, key, "left").withColumn("counts", F.coalesce("counts", F.array_repeat(F.lit(0).cast("long"), weeks)))
    return whole.select(*key, _spread("counts", weeks)["mean"].alias("expected"), _spread("counts", weeks)["deviation"].alias("deviation"), "enough")


def _spread(counts: str, n: int) -> dict[str, Column]:
    """Mean and population deviation of an array of ``n`` counts.

    The deviation is the running one of ``stddev_pop``, over the counts in their
    order, so that a count that differs from the mean by the deviation alone is
    judged as SQL judges it, to the last bit.
    """
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))

    def add(a: Column, x: Column) -> Column:
        mean = a["mean"] + (x - a["mean"]) / (a["n"] + 1)
        return F.struct((a["n"] + 1).alias("n"), mean.alias("mean"), (a["squares"] + (x - a["mean"]) * (x - mean)).alias("squares"))

    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return {"mean": total / n, "deviation": F.aggregate(counts, start, add, lambda a: F.sqrt(a["squares"] / n))}


def compared(calls: DataFrame, baseline: DataFrame, from_us: int, to_us: int) -> DataFrame:
    """The baseline's rows of the hours in ``[from_us, to_us)``, a week at most, with ``observed`` and ``comparison``."""
    first, n = int(from_us // HOUR), int(-(-to_us // HOUR) - from_us // HOUR)
    rows = calls.where((F.col("us") >= from_us) & (F.col("us") < to_us) & F.col("neighborhood").isNotNull())
    kind = F.when(F.col("type").isin(*TYPES), F.col("type")).otherwise("unknown")
    seen = rows.groupBy("neighborhood", kind.alias("type"), hour_of_week(F.col("us")).alias("hour_of_week")).agg(F.count("*").alias("observed"))
    within = F.pmod(F.col("hour_of_week") - F.lit(first % HOURS), F.lit(HOURS)) < n
    whole = baseline.where(within).join(seen, ["neighborhood", "type", "hour_of_week"], "left").fillna(0, ["observed"])
    band = F.greatest(F.col("deviation") * DEVIATIONS, F.lit(LEAST_BAND))
    told = F.when(~F.col("enough"), "not enough history").when(F.col("observed") > F.col("expected") + band, "busier").when(F.col("observed") < F.col("expected") - band, "quieter").otherwise("typical")
    return whole.withColumn("comparison", told)
