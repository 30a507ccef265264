"""Incident status: signals, monotone transitions, staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.range_join import MINUTE

#: Order of statuses, and minutes of quiet after which a type's status is unknown.
RANKS = {"unknown": -1, "reported": 0, "dispatched": 1, "active": 2, "resolved": 3}
QUIET = {"fire": 180, "rescue": 180, "hazard": 180, "collision": 90, "medical": 60}
QUIET_DEFAULT = 45


def status_from_signals(received: Column, dispatched: Column, on_scene: Column, closed: Column) -> Column:
    return (
        F.when(closed.isNotNull(), "resolved").when(on_scene.isNotNull(), "active").when(dispatched.isNotNull(), "dispatched")
        .when(received.isNotNull(), "reported").otherwise("unknown")
    )


def next_status(now: Column, signalled: Column) -> Column:
    """Status only moves ahead; silence changes nothing."""
    ranks = F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv])
    return F.when(F.try_element_at(ranks, signalled) > F.try_element_at(ranks, now), signalled).otherwise(now)


def stale(status: Column, kind: Column, last_us: Column, now_us: Column) -> Column:
    """``unknown`` where an open incident has been quiet for its type's limit."""
    limits = F.create_map(*[F.lit(x) for kv in QUIET.items() for x in kv])
    limit = F.coalesce(F.try_element_at(limits, kind), F.lit(QUIET_DEFAULT)).cast("long") * MINUTE
    return F.when((status != "resolved") & (now_us - last_us >= limit), "unknown").otherwise(status)


def quiet_limit(kind: Column) -> Column:
    """Microseconds of quiet after which an incident of a type is stale."""
    limits = F.create_map(*[F.lit(x) for kv in QUIET.items() for x in kv])
    return F.coalesce(F.try_element_at(limits, kind), F.lit(QUIET_DEFAULT)).cast("long") * MINUTE


def stale_transitions(rows: DataFrame, until_us: int) -> DataFrame:
    """``incident_id, last_us, stale_us``: every time up to ``until_us`` at which an open incident's status became unknown.

    ``rows``: incident_id, us, id, type, closed.  An incident has the first type
    that is known; each call makes it active again, until one closes it for good.
    """
    order = Window.partitionBy("incident_id").orderBy("us", "id")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    kind = F.coalesce(F.first(F.when(F.col("type") != "unknown", F.col("type")), ignorenulls=True).over(so_far), F.lit("unknown"))
    told = rows.select("incident_id", "us", F.max("closed").over(so_far).alias("closed"), F.lead("us").over(order).alias("next_us"), (F.col("us") + quiet_limit(kind)).alias("stale_us"))
    quiet = ~F.col("closed") & (F.col("next_us").isNull() | (F.col("next_us") >= F.col("stale_us"))) & (F.col("stale_us") <= until_us)
    return told.where(quiet).select("incident_id", F.col("us").alias("last_us"), "stale_us")
