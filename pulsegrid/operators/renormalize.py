"""A time range taken again after a rule changed, or filled from an archive: only what differs is written and correlated anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_range(rows: DataFrame, from_us: int, to_us: int, time: str = "us") -> DataFrame:
    """Rows of a closed range; rows without a time are in none."""
    return rows.where(F.col(time).between(from_us, to_us))


def row_hash(columns: list[str]) -> Column:
    """128 bits of the columns, null and empty apart; maps are not among them."""
    marked = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return F.struct(F.xxhash64(F.lit(0), *marked).alias("a"), F.xxhash64(F.lit(1), *marked).alias("b"))


def changed_rows(stored: DataFrame, recomputed: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The recomputed rows whose ``columns`` differ from the stored row's, with ``outcome``: created or updated.

    Of the stored table only keys and hashes are shuffled.  Keys are unique on either side.
    """
    old = stored.select(key, row_hash(columns).alias("__old"))
    joined = recomputed.withColumn("__new", row_hash(columns)).join(old, key, "left")
    there = F.col("__old").isNotNull()
    return joined.where(~F.col("__new").eqNullSafe(F.col("__old"))).withColumn("outcome", F.when(there, "updated").otherwise("created")).drop("__new", "__old")


def live_incidents(changed: DataFrame, key: str, members: DataFrame, incidents: DataFrame) -> DataFrame:
    """``key, incident_id`` of changed rows whose incident is neither resolved nor merged: what is to be correlated again."""
    live = incidents.where("merged_into_id is null and (status is null or status <> 'resolved')").select("incident_id")
    return changed.select(key).join(members.select(key, "incident_id"), key).join(live, "incident_id").select(key, "incident_id")


def apply_changes(stored: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """The table as a full rebuild would give it: changed rows in place of the stored ones, all others as they are."""
    return stored.join(changed.select(key), key, "left_anti").unionByName(changed.select(*stored.columns))


def backfilled(stored: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """``incoming`` with ``backfilled``: true for records that were not there, else what the stored row says."""
    known = stored.select(*key, F.coalesce("backfilled", F.lit(False)).alias("__known"))
    return incoming.join(known, key, "left").withColumn("backfilled", F.coalesce("__known", F.lit(True))).drop("__known")
