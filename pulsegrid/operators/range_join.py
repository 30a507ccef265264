"""Range joins without nested loops: both sides meet on time bins and map cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.geo import METERS_A_DEGREE, haversine_meters

MINUTE = 60_000_000
#: Windows that a bin of running counts is wide; few then reach over its edge.
BIN_WINDOWS = 10


def _around(value: Column, less: float, more: float, width: float) -> Column:
    """The bins that ``[value - less, value + more]`` touches."""
    bin_of = lambda v: F.floor(v / F.lit(width)).cast("long")
    return F.sequence(bin_of(value - F.lit(less)), bin_of(value + F.lit(more)))


def near_in_time(left: DataFrame, right: DataFrame, back: int, ahead: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs with ``l.us - back <= r.us <= l.us + ahead`` (microseconds) and equal ``keys``.

    Columns of the right side get the prefix ``o_``.  Rows with a null time or
    key meet nothing.  A bin is as wide as the window, so a left row is repeated
    at most three times and a right row never.
    """
    width = max(1, back + ahead)
    probe = left.withColumn("__bin", F.explode(_around(F.col("us"), back, ahead, width)))
    build = right.select(*[F.col(c).alias(f"o_{c}") for c in right.columns]).withColumn("__bin", F.floor(F.col("o_us") / F.lit(width)).cast("long"))
    on = (probe["__bin"] == build["__bin"]) & build["o_us"].between(F.col("us") - back, F.col("us") + ahead)
    for key in keys:
        on &= F.col(key) == F.col(f"o_{key}")
    return probe.join(build, on).drop("__bin")


def counts_elsewhere(rows: DataFrame, id_col: str, differ: tuple[str, ...], back: int, ahead: int) -> DataFrame:
    """``id, elsewhere``: how many rows within ``[us - back, us + ahead]`` differ in every one of the columns ``differ``.

    No pair is built: a window's rows are a difference of running counts, and
    those that differ in all columns are all rows, less those equal in one, plus
    those equal in two, and so on.  Rows are copied once for each set of columns,
    into bins of time, so the work is in proportion to the rows.  Rows with a
    null time or column count nowhere; rows that count none are left out.
    """
    width = BIN_WINDOWS * max(1, back + ahead + 1)
    known = rows.where(" and ".join(f"`{c}` is not null" for c in ("us", *differ))).select(F.col(id_col).alias("id"), "us", *differ)
    subsets = [[c for i, c in enumerate(differ) if n >> i & 1] for n in range(1 << len(differ))]
    sets = F.array(*[F.struct(F.lit(n).alias("subset"), *[(F.col(c) if c in s else F.lit(None).cast(rows.schema[c].dataType)).alias(f"__{c}") for c in differ]) for n, s in enumerate(subsets)])
    bin_of = lambda v: F.floor(v / F.lit(width)).cast("long")
    low, high, bins = F.col("us") - back, F.col("us") + ahead, F.sequence(bin_of(F.col("us") - back), bin_of(F.col("us") + ahead))
    # in its first bin, what comes before the window counts against; in each, what comes up to its end counts for
    place = lambda bin_, t, end: F.struct(bin_.alias("bin"), t.alias("t"), F.lit(end).alias("end"))
    ends = F.transform(bins, lambda b: place(b, F.least(high, (b + 1) * width - 1), 2))
    # a number that is told is not made smaller for rows that grow by the sets once they are dealt
    parts = len(subsets) * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = known.select("id", *differ, F.inline(F.concat(F.array(place(bin_of(F.col("us")), F.col("us"), 1), place(bin_of(low), low, 0)), ends))).repartition(parts, "bin")
    # sets are told apart within a task, so that a row's counts meet there
    keyed = dealt.select("id", "bin", "t", "end", F.inline(sets))
    order = Window.partitionBy("subset", *[f"__{c}" for c in differ], "bin").orderBy("t", "end").rowsBetween(Window.unboundedPreceding, 0)
    counted = keyed.withColumn("n", F.sum((F.col("end") == 1).cast("long")).over(order)).where("end <> 1")
    sign = F.element_at(F.array(*[F.lit((-1) ** len(s)) for s in subsets]), F.col("subset") + 1)
    signed = sign * F.col("n") * (F.col("end") - 1)  # -1 at the start of a window, 1 at its end
    return counted.groupBy("id").agg(F.sum(signed).alias("elsewhere")).where(F.col("elsewhere") > 0)


def near_in_place_and_time(left: DataFrame, right: DataFrame, meters: float, back: int, ahead: int) -> DataFrame:
    """Pairs within ``meters`` and the time window, with ``distance``; rows without a point meet nothing.

    Bins hold time and map cells, so a busy hour is divided by place and a busy
    place by time.  Cells are wide enough that neighbours of a point lie in at
    most 2 x 2 of them up to 60 degrees of latitude.
    """
    width, high = max(1, back + ahead), meters / METERS_A_DEGREE * 1.001
    wide = 2 * high
    located = left.where("lat is not null and lng is not null")
    probe = (
        located.withColumn("__bin", F.explode(_around(F.col("us"), back, ahead, width)))
        .withColumn("__row", F.explode(_around(F.col("lat"), high, high, 2 * high)))
        .withColumn("__col", F.explode(_around(F.col("lng"), wide, wide, 2 * wide)))
    )
    build = right.where("lat is not null and lng is not null").select(
        *[F.col(c).alias(f"o_{c}") for c in right.columns],
        F.floor(F.col("us") / F.lit(width)).cast("long").alias("__bin"),
        F.floor(F.col("lat") / F.lit(2 * high)).cast("long").alias("__row"), F.floor(F.col("lng") / F.lit(2 * wide)).cast("long").alias("__col"),
    )
    met = probe.join(build, ["__bin", "__row", "__col"]).where(F.col("o_us").between(F.col("us") - back, F.col("us") + ahead))
    distance = haversine_meters(F.col("lat"), F.col("lng"), F.col("o_lat"), F.col("o_lng"))
    return met.withColumn("distance", distance).where(F.col("distance") <= meters).drop("__bin", "__row", "__col")
