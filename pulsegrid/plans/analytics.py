"""Questions and viewer counters over observations, with their SQL forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.operators.search import bm25
from pulsegrid.session import table
from pulsegrid.sources.observations import DISPATCH_SOURCES, OBSERVATIONS_SQL, observations

#: The moment questions are asked at: 2024-01-16 00:00 UTC, in microseconds.
NOW = 1_705_363_200_000_000
HOUR = 3_600_000_000
DAY = 24 * HOUR
_WITH = "with " + OBSERVATIONS_SQL


def conditions(
    sources: tuple[str, ...] = DISPATCH_SOURCES, areas: tuple[str, ...] = (), types: tuple[str, ...] = (), codes: tuple[str, ...] = (),
    since: int | None = None, until: int | None = None, geocoded: bool | None = None, unmapped: bool = False,
) -> Column:
    """One predicate: or within a dimension, and across; codes take the place of types."""
    found = [F.col("source").isin(*sources)] if sources else []
    if areas:
        found.append(F.col("neighborhood").isin(*areas))
    if codes:
        found.append(F.col("raw_type").isin(*codes))
    elif types:
        found.append(F.col("type").isin(*types))
    if since is not None:
        found.append(F.col("us") >= since)
    if until is not None:
        found.append(F.col("us") < until)
    if geocoded is not None:
        found.append(F.col("lat").isNotNull() if geocoded else F.col("lat").isNull())
    if unmapped:
        found.append(F.col("type").isNull() | (F.col("type") == "unknown"))
    out = F.lit(True)
    for c in found:
        out &= c
    return out


def ask_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by type in area N3 over seven days, against the seven days before: one scan, one shuffle."""
    window = 7 * DAY
    rows = observations(spark, sf_dir).where(conditions(areas=("N3",), since=NOW - 2 * window, until=NOW))
    now = F.col("us") >= NOW - window
    return rows.groupBy("type").agg(F.count_if(now).alias("calls"), F.count_if(~now).alias("before"))


def ask_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).where(conditions(types=("collision", "medical"), since=NOW - 2 * DAY, until=NOW))
    now = F.col("us") >= NOW - DAY
    return rows.agg(
        F.count_if(now).alias("total"), F.count_if(now & (F.col("sensitive") == 1)).alias("withheld"), F.count_if(~now).alias("previous"),
        F.count_distinct(F.when(now, F.col("neighborhood"))).alias("areas"),
    )


def ask_code_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 latest calls of ranked codes, better codes first (a top-k report)."""
    codes = ("view", "error", "click")
    rows = observations(spark, sf_dir).where(conditions(codes=codes, types=("theft",), since=NOW - DAY, until=NOW))
    place = F.array_position(F.array(*map(F.lit, codes)), F.col("raw_type"))
    return rows.select("id", "raw_type", "us", place.alias("code_rank")).orderBy("code_rank", F.desc("us"), "id").limit(50)


def filter_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the list: offset 20, 100 rows, newest first (paging is the feature)."""
    rows = observations(spark, sf_dir).where(conditions(geocoded=True, since=NOW - 5 * DAY, until=NOW))
    return rows.select("id", "source", "type", "us", "neighborhood").orderBy(F.desc("us"), "id").offset(20).limit(100)


def window_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    located, typed = F.col("lat").isNotNull(), F.col("type") != "unknown"
    open_ = F.col("sensitive") == 0
    percent = lambda a, b: F.when(b > 0, F.floor(1000 * a / b + 0.5) / 10)
    return observations(spark, sf_dir).where(conditions()).agg(
        F.count("*").alias("total"), F.count_if(located).alias("geocoded"), F.count_if(typed).alias("typed"), F.count_if(open_).alias("locatable"),
        F.count_if(open_ & located).alias("locatable_geocoded"), F.min("us").alias("first_us"), F.max("us").alias("last_us"),
        percent(F.count_if(typed), F.count("*")).alias("typed_percent"), percent(F.count_if(open_ & located), F.count_if(open_)).alias("located_percent"),
    )


def count_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).groupBy("source").agg(F.count("*").alias("calls"))


def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many (user, hour) keys were reported more than once."""
    keys = observations(spark, sf_dir).groupBy("user_id", F.expr(f"us div {HOUR}").alias("hour")).count()
    return keys.where("count > 1").agg(F.count("*").alias("keys"), F.coalesce(F.sum("count"), F.lit(0)).alias("rows"))


def payload_versions_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir)
    return rows.agg(F.count("*").alias("rows"), F.count_distinct("source", "user_id").alias("records")).withColumn("ratio", F.round(F.col("rows") / F.col("records"), 6))


def unmapped_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).where(conditions(unmapped=True))
    return rows.groupBy("source", "raw_type", "priority_rank").agg(F.count("*").alias("calls"))


def source_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every configured source, with zero for those that sent nothing."""
    known = spark.range(4).select(F.element_at(F.array(*map(F.lit, (*DISPATCH_SOURCES, "sf_police_report"))), (F.col("id") + 1).cast("int")).alias("source"))
    seen = observations(spark, sf_dir).groupBy("source").agg(F.count("*").alias("calls"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    return known.join(seen, "source", "left").select("source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("calls", "first_us", "last_us")])


def corner_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What else happened in N5, without the calls of user 5's own incident (an anti join)."""
    rows = observations(spark, sf_dir)
    own = rows.where("user_id = 5").select("id")
    area = rows.where("neighborhood = 'N5'").join(own, "id", "left_anti")
    half = F.col("us") >= NOW - 7 * DAY
    return area.groupBy("type").agg(F.count("*").alias("calls"), F.count_if(half).alias("recent"), F.count_if(~half).alias("earlier"))


def neighborhood_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).where("neighborhood is not null").groupBy("neighborhood").agg(F.count("*").alias("calls"))


def median_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median value by area and type where ten or more calls are comparable, else the type's over the city."""
    rows = observations(spark, sf_dir).where("neighborhood is not null").select("neighborhood", "type", F.expr("k * 7 + user_id % 13").alias("seconds"))
    area = rows.groupBy("neighborhood", "type").agg(F.count("*").alias("n"), F.median("seconds").alias("m"))
    city = rows.groupBy("type").agg(F.median("seconds").alias("city"))
    joined = area.join(F.broadcast(city), "type")  # one row a type
    return joined.select("neighborhood", "type", F.when(F.col("n") >= 10, F.col("m")).otherwise(F.col("city")).alias("seconds"), (F.col("n") < 10).alias("widened"))


def daily_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).where("neighborhood is not null")
    return rows.groupBy(F.expr(f"us div {DAY}").alias("day"), "neighborhood", "type", "source").agg(F.count("*").alias("calls"), F.count_if(F.col("priority_rank") <= 2).alias("urgent"))


def trend_vs_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each type over seven days: total, per day, busiest day, change against the seven days before."""
    rows = observations(spark, sf_dir).where(conditions(since=NOW - 14 * DAY, until=NOW))
    days = rows.groupBy("type", F.expr(f"us div {DAY}").alias("day")).agg(F.count("*").alias("n"))
    recent = F.col("day") >= (NOW - 7 * DAY) // DAY
    per = days.groupBy("type").agg(
        F.coalesce(F.sum(F.when(recent, F.col("n"))), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(~recent, F.col("n"))), F.lit(0)).alias("before"),
        F.max(F.when(recent, F.struct("n", (-F.col("day")).alias("d")))).alias("top"),
    )
    change = F.when(F.col("before") > 0, F.floor(100 * (F.col("total") - F.col("before")) / F.col("before") + 0.5).cast("long"))
    return per.select("type", "total", F.round(F.col("total") / 7, 6).alias("per_day"), (-F.col("top.d")).alias("busiest_day"), change.alias("change_percent"))


def activity_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by area and hour of the day against their mean over 30 days: quieter, typical or busier."""
    rows = observations(spark, sf_dir).where("neighborhood is not null")
    hours = rows.groupBy("neighborhood", F.expr(f"us div {DAY}").alias("day"), F.expr(f"(us div {HOUR}) % 24").alias("hour")).agg(F.count("*").alias("n"))
    base = hours.groupBy("neighborhood", "hour").agg(F.sum("n").alias("calls"), F.max("n").alias("most"), F.count("*").alias("days"))
    mean = F.col("calls") / 30
    return base.select("neighborhood", "hour", "calls", F.when(F.col("most") > 4 * mean, "busier").when(F.col("most") * 2 < mean, "quieter").otherwise("typical").alias("peak"))


def histogram_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative buckets of event values by source."""
    bounds = F.explode(F.array(*[F.lit(float(b)) for b in (10, 25, 50, 100, 250, 500)]))
    rows = observations(spark, sf_dir).groupBy("source", "k").agg(F.count("*").alias("n"))  # a hundred values a source
    return rows.withColumn("le", bounds).where("k <= le").groupBy("source", "le").agg(F.sum("n").alias("calls"))


def latest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five newest payloads of each user's record."""
    order = Window.partitionBy("user_id").orderBy(F.desc("us"), F.desc("id"))
    return observations(spark, sf_dir).select("user_id", "id", "us", F.row_number().over(order).alias("version")).where("version <= 5")


def point_in_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Located calls by polygon: two squares, one with a hole."""
    from pulsegrid.functions.geo import in_polygon

    ring = lambda s, n, w, e: F.array(*[F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lng")) for a, b in ((s, w), (s, e), (n, e), (n, w), (s, w))])
    west = F.array(ring(37.699, 37.731, -122.501, -122.481), ring(37.711, 37.7135, -122.495, -122.487))
    east = F.array(ring(37.699, 37.771, -122.479, -122.461))
    rows = observations(spark, sf_dir).where("lat is not null")
    lat, lng = F.col("lat"), F.col("lng")
    area = F.when(in_polygon(west, lat, lng), "west").when(in_polygon(east, lat, lng), "east").otherwise("outside")
    return rows.groupBy(area.alias("area")).agg(F.count("*").alias("calls"))


def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for three words (a top-k report)."""
    return bm25(table(spark, sf_dir, "documents"), ["the", "and", "of"], "doc_id", "text", 20)


def customer_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by nation and year with subtotals."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    rolled = joined.rollup("n_name", F.year("o_orderdate").alias("year")).agg(F.count("*").alias("orders"))
    return rolled.withColumn("year", F.col("year").cast("long"))


QUERIES = {
    f.__name__: f
    for f in (
        ask_breakdown, ask_total, ask_code_order, filter_observations, window_counters, count_by_source, duplicate_keys, payload_versions_ratio,
        unmapped_codes, source_coverage, corner_history, neighborhood_counts, median_response, daily_rollup, trend_vs_prior, activity_baseline,
        histogram_buckets, latest_versions, point_in_area, search_documents, customer_rollup,
    )
}

ORACLE_SQL = {
    "ask_breakdown": f"""{_WITH} select type, count_if(us >= {NOW - 7 * DAY}) calls, count_if(us < {NOW - 7 * DAY}) before
        from obs where neighborhood = 'N3' and us >= {NOW - 14 * DAY} and us < {NOW} group by type""",
    "ask_total": f"""{_WITH} select count_if(us >= {NOW - DAY}) total, count_if(us >= {NOW - DAY} and sensitive = 1) withheld, count_if(us < {NOW - DAY}) previous,
        count(distinct case when us >= {NOW - DAY} then neighborhood end) areas
        from obs where type in ('collision', 'medical') and us >= {NOW - 2 * DAY} and us < {NOW}""",
    "ask_code_order": f"""{_WITH} select id, raw_type, us, case raw_type when 'view' then 1 when 'error' then 2 else 3 end code_rank
        from obs where raw_type in ('view', 'error', 'click') and us >= {NOW - DAY} and us < {NOW} order by code_rank, us desc, id limit 50""",
    "filter_observations": f"""{_WITH} select id, source, type, us, neighborhood from obs where lat is not null and us >= {NOW - 5 * DAY} and us < {NOW}
        order by us desc, id limit 100 offset 20""",
    "window_counters": f"""{_WITH} select count(*) total, count(lat) geocoded, count_if(type <> 'unknown') typed, count_if(sensitive = 0) locatable,
        count_if(sensitive = 0 and lat is not null) locatable_geocoded, min(us) first_us, max(us) last_us,
        floor(1000.0 * count_if(type <> 'unknown') / count(*) + 0.5) / 10 typed_percent,
        floor(1000.0 * count_if(sensitive = 0 and lat is not null) / count_if(sensitive = 0) + 0.5) / 10 located_percent from obs""",
    "count_by_source": f"{_WITH} select source, count(*) calls from obs group by source",
    "duplicate_keys": f"""{_WITH} select count(*) as keys, cast(coalesce(sum(n), 0) as bigint) as rows
        from (select count(*) n from obs group by user_id, us // {HOUR} having count(*) > 1)""",
    "payload_versions_ratio": f"""{_WITH} select count(*) as rows, count(distinct (source, user_id)) records,
        round(count(*) / count(distinct (source, user_id)), 6) ratio from obs""",
    "unmapped_codes": f"{_WITH} select source, raw_type, priority_rank, count(*) calls from obs where type = 'unknown' group by all",
    "source_coverage": f"""{_WITH} select s.source, count(id) calls, coalesce(min(us), 0) first_us, coalesce(max(us), 0) last_us
        from (select unnest(['sf_police_cad', 'sf_fire_cad', 'sf_ems_cad', 'sf_police_report']) source) s left join obs using (source) group by s.source""",
    "corner_history": f"""{_WITH} select type, count(*) calls, count_if(us >= {NOW - 7 * DAY}) recent, count_if(us < {NOW - 7 * DAY}) earlier
        from obs where neighborhood = 'N5' and id not in (select id from obs where user_id = 5) group by type""",
    "neighborhood_counts": f"{_WITH} select neighborhood, count(*) calls from obs where neighborhood is not null group by 1",
    "median_response": f"""{_WITH}, r as (select neighborhood, type, k * 7 + user_id % 13 s from obs where neighborhood is not null),
        a as (select neighborhood, type, count(*) n, median(s) m from r group by all), c as (select type, median(s) city from r group by 1)
        select neighborhood, type, case when n >= 10 then m else city end as seconds, n < 10 widened from a join c using (type)""",
    "daily_rollup": f"""{_WITH} select us // {DAY} as day, neighborhood, type, source, count(*) calls, count_if(priority_rank <= 2) urgent
        from obs where neighborhood is not null group by all""",
    "trend_vs_prior": f"""{_WITH}, d as (select type, us // {DAY} as day, count(*) n from obs where us >= {NOW - 14 * DAY} and us < {NOW} group by all),
        p as (select type, cast(coalesce(sum(n) filter (where day >= {(NOW - 7 * DAY) // DAY}), 0) as bigint) total,
          cast(coalesce(sum(n) filter (where day < {(NOW - 7 * DAY) // DAY}), 0) as bigint) b from d group by type),
        t as (select type, day from d where day >= {(NOW - 7 * DAY) // DAY} qualify row_number() over (partition by type order by n desc, day) = 1)
        select p.type, total, round(total / 7, 6) per_day, t.day busiest_day,
          case when b > 0 then cast(floor(100.0 * (total - b) / b + 0.5) as bigint) end change_percent from p left join t on p.type = t.type""",
    "activity_baseline": f"""{_WITH}, h as (select neighborhood, us // {DAY} as day, (us // {HOUR}) % 24 as hour, count(*) n from obs where neighborhood is not null group by all)
        select neighborhood, hour, cast(sum(n) as bigint) calls, case when max(n) > 4 * (sum(n) / 30) then 'busier' when max(n) * 2 < sum(n) / 30 then 'quieter' else 'typical' end peak
        from h group by neighborhood, hour""",
    "histogram_buckets": f"""{_WITH} select source, le::double as le, count(*) calls from obs, (select unnest([10, 25, 50, 100, 250, 500]) le) b
        where k <= le group by all""",
    "latest_versions": f"""{_WITH} select user_id, id, us, row_number() over (partition by user_id order by us desc, id desc) as version from obs qualify version <= 5""",
    "point_in_area": f"""{_WITH} select case when lat > 37.699 and lat < 37.731 and lng > -122.501 and lng < -122.481
          and not (lat > 37.711 and lat < 37.7135 and lng > -122.495 and lng < -122.487) then 'west'
        when lat > 37.699 and lat < 37.771 and lng > -122.479 and lng < -122.461 then 'east' else 'outside' end area, count(*) calls
        from obs where lat is not null group by 1""",
    "search_documents": r"""with w as (select doc_id id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') w from documents),
        a as (select count(*) docs, avg(len(w)) filter (where w is not null) mean from w),
        f as (select id, len(w) size, q, len(list_filter(w, lambda x: x = q)) tf from w, (select unnest(['the', 'and', 'of']) q)),
        d as (select q, count(*) df from f where tf > 0 group by q)
        select id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) score
        from f join d using (q), a where tf > 0 group by id order by score desc, id limit 20""",
    "customer_rollup": """select n_name, cast(year(o_orderdate) as bigint) as year, count(*) orders from orders join customer on o_custkey = c_custkey
        join nation on c_nationkey = n_nationkey group by rollup (n_name, year(o_orderdate))""",
}
