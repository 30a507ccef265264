"""The stale sweep as a stream: a timer for every open incident, which fires when its type's quiet limit has passed."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pulsegrid.operators.lifecycle import QUIET, QUIET_DEFAULT
from pulsegrid.operators.range_join import MINUTE
from pulsegrid.streaming.ingest import OVERLAP

#: How long a closed or silent incident is remembered; a call that comes later opens it anew.
KEPT = 14 * 24 * 60 * MINUTE
_STATE = "last_us long, kind string, closed boolean, told boolean, us array<long>, ids array<long>, kinds array<string>, ends array<boolean>"


def _limit(kind: str) -> int:
    return QUIET.get(kind, QUIET_DEFAULT) * MINUTE


def step(key: tuple, rows: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Calls are held until the watermark has passed them and then taken in order, so the cut of the stream does not matter."""
    last, kind, closed, told, *held = state.get if state.exists else (None, "unknown", False, True, [], [], [], [])
    waiting = list(zip(*held, strict=True))
    if not state.hasTimedOut:
        for batch in rows:
            waiting += zip(batch["us"].tolist(), batch["id"].tolist(), batch["type"].tolist(), batch["closed"].tolist(), strict=True)
        waiting.sort(key=lambda r: r[:2])
    clock = state.getCurrentWatermarkMs() * 1000
    found = []

    def quiet(until: int) -> None:
        nonlocal told
        if not told and not closed and until - last >= _limit(kind):
            told = True
            found.append((key[0], last, last + _limit(kind)))

    ripe = [r for r in waiting if r[0] <= clock]
    for us, _, said, end in ripe:
        quiet(us)
        last, kind, closed, told = us, (said if kind == "unknown" and said else kind), closed or bool(end), False
    if last is not None:
        quiet(clock)
    waiting = waiting[len(ripe) :]
    due = [waiting[0][0]] if waiting else []
    if last is not None:
        due.append(last + (KEPT if told or closed else _limit(kind)))
    if clock >= min(due):
        state.remove()
    else:
        state.update((last, kind, closed, told, *([list(c) for c in zip(*waiting, strict=True)] if waiting else [[], [], [], []])))
        state.setTimeoutTimestamp(max(-(-min(due) // 1000), state.getCurrentWatermarkMs() + 1))
    if found:
        yield pd.DataFrame(found, columns=["incident_id", "last_us", "stale_us"])


def stale_stream(calls: DataFrame, late: str = OVERLAP) -> DataFrame:
    """``incident_id, last_us, stale_us`` as they happen, for a stream of ``incident_id, us, id, type, closed``.

    The clock is the watermark: calls of any incident move it, and it runs
    ``late`` behind them; calls later than that are not seen.  The same rows as
    ``lifecycle.stale_transitions`` up to that moment, but for incidents that a
    call meets after KEPT.  Rows without a time or an incident are left out.
    """
    rows = calls.where("us is not null and incident_id is not null").select(
        F.col("incident_id").cast("string").alias("incident_id"), "us", F.col("id").cast("long").alias("id"), F.coalesce("type", F.lit("unknown")).alias("type"),
        F.coalesce("closed", F.lit(False)).alias("closed"), F.timestamp_micros("us").alias("at"),
    )
    grouped = rows.withWatermark("at", late).groupBy("incident_id")
    return grouped.applyInPandasWithState(step, "incident_id string, last_us long, stale_us long", _STATE, "append", GroupStateTimeout.EventTimeTimeout)
