"""Attach-or-create correlation: chains of calls with a point, one ordered fold a chain, and reads of its incidents by area."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.geo import EARTH_METERS
from pulsegrid.operators.components import connected_components
from pulsegrid.operators.range_join import MINUTE, near_in_place_and_time
from pulsegrid.operators.scoring import AFFINITY, BACK, CODE_OVERRIDES, MERGE, METERS, PROBABLE, SAME_AREA, SLACK, THIN_EVIDENCE, WEIGHTS
from pulsegrid.session import cut_lineage
from pulsegrid.sources.observations import AGENCIES, agency_of

_RESULT = "observation_id long, incident_id long, decision string, score double, probable_incident_id long, agencies array<string>, units array<string>, primary_type string"
_COLUMNS = [c.split()[0] for c in _RESULT.split(", ")]
_STATE = "us long, first long, last long, area string, code string"
_STATE_COLUMNS = [c.split()[0] for c in _STATE.split(", ")]
#: The highest score of a call that has only an area.
AREA_MOST = (WEIGHTS["location"] * SAME_AREA + WEIGHTS["time"] + WEIGHTS["type"] + WEIGHTS["units"]) / (WEIGHTS["location"] + WEIGHTS["time"] + WEIGHTS["type"] + WEIGHTS["units"])
#: Time by which calls of one area are dealt.
SLOT = 360 * MINUTE


def chains(located: DataFrame) -> DataFrame:
    """The calls with ``component``: those that chain through calls within METERS and BACK minutes of each other.

    The calls of one point form runs without a longer gap.  Runs of near points
    are linked where two calls are that close, and if any two are, so are two of
    the first and last of a bin of time; so links are in proportion to calls
    and near points, not to pairs of calls.
    """
    at = Window.partitionBy("lat", "lng").orderBy("us", "id")
    begins = F.coalesce(F.col("us") - F.lag("us").over(at) > BACK * MINUTE, F.lit(True))
    marked = located.withColumn("__begins", F.when(begins, F.col("id")))
    runs = marked.withColumn("run", F.last("__begins", ignorenulls=True).over(at.rowsBetween(Window.unboundedPreceding, 0))).drop("__begins")
    ends = runs.groupBy("run", "lat", "lng", F.floor(F.col("us") / F.lit(BACK * MINUTE)).alias("bin")).agg(F.array_distinct(F.array(F.min("us"), F.max("us"))).alias("ends"))
    ends = ends.select("run", "lat", "lng", F.explode("ends").alias("us"))
    near = near_in_place_and_time(ends, ends, METERS, BACK * MINUTE, 0).where("run <> o_run")
    parts = connected_components(cut_lineage(near.select(F.col("run").alias("a"), F.col("o_run").alias("b")).distinct())).withColumnRenamed("node", "run")
    return runs.join(parts, "run", "left").withColumn("component", F.coalesce("component", "run")).drop("run")


def _meters(a, b) -> float:
    p, q = math.radians(a.lat), math.radians(b["lat"])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b["lng"] - a.lng) / 2) ** 2
    return 2 * EARTH_METERS * math.asin(min(1.0, math.sqrt(h)))


@cache
def _affinity(a: str, b: str, code_a: str, code_b: str) -> float | None:
    if not a or not b or "unknown" in (a, b):
        return None
    if a == b:
        return 1.0
    for found in (CODE_OVERRIDES.get(code_a, {}).get(b), CODE_OVERRIDES.get(code_b, {}).get(a), AFFINITY.get(a, {}).get(b), AFFINITY.get(b, {}).get(a)):
        if found is not None:
            return found
    return 0.0


@cache
def _weight(*names: str) -> float:
    return sum(WEIGHTS[name] for name in names)


def _score(o, incident: dict) -> tuple[float, float | None] | None:
    """(score, location score) against an open incident; null if it is no candidate."""
    if not -BACK * MINUTE <= incident["first"] - o.us <= 0:
        return None
    if not math.isnan(o.lat):
        if o.lat == incident["lat"] and o.lng == incident["lng"]:
            place = 1.0
        elif math.isnan(incident["lat"]) or (distance := _meters(o, incident)) > METERS:
            return None
        else:
            place = max(0.0, 1 - distance / METERS)
    elif o.neighborhood is not None and o.neighborhood == incident["area"]:
        place = SAME_AREA
    else:
        return None
    time = max(0.0, 1 - max(0, o.us - incident["last"]) / (BACK * MINUTE))
    names, parts = ["location", "time"], [WEIGHTS["location"] * place, WEIGHTS["time"] * time]
    alike = _affinity(o.type, incident["type"], o.raw_type, incident["code"])
    if alike is not None:
        names.append("type")
        parts.append(WEIGHTS["type"] * alike)
    if incident["units"] and len(o.units) and incident["agencies"] == {AGENCIES.get(o.source, o.source)}:
        names.append("units")
        parts.append(WEIGHTS["units"] * (len(set(o.units) & incident["units"]) / len(set(o.units) | incident["units"])))
    raw = sum(parts) / _weight(*names)
    return (raw if len(names) > 2 else min(raw, THIN_EVIDENCE)), place


def _opened(o) -> dict:
    """The incident that a call opens."""
    return {"id": o.id, "first": o.us, "last": o.us, "lat": o.lat, "lng": o.lng, "area": o.neighborhood, "type": o.type or "unknown", "code": o.raw_type, "units": set(o.units), "agencies": {AGENCIES.get(o.source, o.source)}}


def _plain(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.assign(neighborhood=rows["neighborhood"].astype(object).where(rows["neighborhood"].notna(), None))


def _decided(out: list[tuple]) -> pd.DataFrame:
    done = pd.DataFrame(out, columns=_COLUMNS)
    return done.assign(probable_incident_id=done["probable_incident_id"].astype("Int64"))


class Fold:
    """Decisions in the order of time and id; of incidents only those that may still be met are held."""

    def __init__(self):
        self.component, self.incidents = None, []

    def decide(self, o) -> tuple:
        self.incidents = [i for i in self.incidents if i["first"] >= o.us - BACK * MINUTE]
        scored = [(s[0], s[1], -i["first"], -i["id"], i) for i in self.incidents if (s := _score(o, i))]
        best = max(scored, key=lambda s: s[:4], default=None)
        score = best[0] if best else None
        agency = AGENCIES.get(o.source, o.source)
        if best and score >= MERGE - SLACK:
            incident, verdict = best[4], "merged"
            incident["units"] |= set(o.units)
            incident["agencies"].add(agency)
            incident["last"] = max(incident["last"], o.us)
            if incident["type"] == "unknown":
                incident["type"] = o.type or "unknown"
        else:
            verdict = "probable" if best and score >= PROBABLE - SLACK else "created"
            incident = _opened(o)
            self.incidents.append(incident)
        maybe = best[4]["id"] if verdict == "probable" else None
        self.at = incident
        return o.id, incident["id"], verdict, score, maybe, sorted(incident["agencies"]), sorted(incident["units"]), incident["type"]

    def run(self, batches: Iterator[pd.DataFrame], states: bool = False) -> Iterator[pd.DataFrame]:
        """Rows sorted by component, time and id, in any batches; with ``states`` also what of the incident later calls are scored by."""
        for rows in batches:
            out, after = [], []
            for o in _plain(rows).itertuples(index=False):
                if o.component != self.component:
                    self.component, self.incidents = o.component, []
                out.append(self.decide(o))
                if states:
                    after.append((o.us, *(self.at[name] for name in ("first", "last", "area", "code"))))
            done = _decided(out)
            yield pd.concat([done, pd.DataFrame(after, columns=_STATE_COLUMNS)], axis=1) if states else done


class Reader(Fold):
    """Calls that have only an area, among the changes of the area's incidents, in the order of time and id.

    Such a call never attaches (see ``correlate``), so it reads incidents and changes none.
    """

    def __init__(self):
        super().__init__()
        self.known = {}

    def change(self, o) -> None:
        state = {"id": o.incident_id, "first": o.first, "last": o.last, "lat": math.nan, "lng": math.nan, "area": o.neighborhood, "type": o.type, "code": o.raw_type, "units": set(o.units), "agencies": set(o.agencies)}
        if o.incident_id in self.known:
            self.known[o.incident_id].update(state)
        else:
            self.known[o.incident_id] = state
            self.incidents.append(state)

    def run(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by area, slot, time and id; those before the slot's begin (``warm``) only make its first incidents known."""
        for rows in batches:
            out = []
            for o in _plain(rows).itertuples(index=False):
                if (o.neighborhood, o.slot) != self.component:
                    self.component, self.incidents, self.known = (o.neighborhood, o.slot), [], {}
                if o.changed:
                    self.change(o)
                elif o.warm:
                    self.incidents.append(_opened(o))
                else:
                    out.append(self.decide(o))
                if len(self.known) > 2 * len(self.incidents) + 64:
                    self.known = {i["id"]: i for i in self.incidents}
            if out:
                yield _decided(out)


def correlate(observations: DataFrame) -> DataFrame:
    """One row per observation: its incident (the id of the observation that opened it) and the decision.

    ``agencies``, ``units`` and ``primary_type`` are those of the incident after
    the observation.  Calls with a point meet only incidents that one with a
    point opened, so each of their chains is folded on its own.  Those with an
    area alone score AREA_MOST at most, below MERGE: they change no incident, and
    read the changes of their area's incidents by slots of time.  The others
    open incidents of their own.
    """
    if AREA_MOST >= MERGE - SLACK:
        raise ValueError("an area alone must not reach the threshold of a merge")
    columns = ["id", "us", "source", "type", "raw_type", "lat", "lng", "neighborhood", "units"]
    point, area = F.col("us").isNotNull() & F.col("lat").isNotNull() & F.col("lng").isNotNull(), F.col("us").isNotNull() & F.col("neighborhood").isNotNull()
    rows = observations.select(*columns)
    # a chain is read in order within its partition, batch by batch, and never held whole
    dealt = chains(rows.where(point)).select("component", *columns).repartition("component").sortWithinPartitions("component", "us", "id")
    met = cut_lineage(dealt.mapInPandas(lambda batches: Fold().run(batches, states=True), f"{_RESULT}, {_STATE}"))
    lost = rows.where(~point & area)
    told = met.where("area is not null").select(
        F.col("area").alias("neighborhood"), "us", F.col("observation_id").alias("id"), F.lit(True).alias("changed"), F.lit(None).cast("string").alias("source"), F.col("primary_type").alias("type"),
        F.col("code").alias("raw_type"), "units", "incident_id", "first", "last", "agencies",
    ).join(lost.select("neighborhood").distinct(), "neighborhood", "left_semi")
    asked = lost.select("neighborhood", "us", "id", F.lit(False).alias("changed"), "source", "type", "raw_type", "units", F.col("id").alias("incident_id"), F.col("us").alias("first"), F.col("us").alias("last"), F.array().cast("array<string>").alias("agencies"))
    slots = F.sequence(F.floor(F.col("us") / SLOT), F.floor((F.col("us") + BACK * MINUTE) / SLOT))
    both = told.unionByName(asked).withColumn("slot", F.explode(slots)).withColumn("warm", F.col("us") < F.col("slot") * SLOT).withColumns({"lat": F.lit(math.nan), "lng": F.lit(math.nan)})
    read = both.repartition("neighborhood", "slot").sortWithinPartitions("neighborhood", "slot", "us", "id").mapInPandas(lambda batches: Reader().run(batches), _RESULT)
    alone = rows.where(~point & ~area).select(
        F.col("id").alias("observation_id"), F.col("id").alias("incident_id"), F.lit("created").alias("decision"), F.lit(None).cast("double").alias("score"),
        F.lit(None).cast("long").alias("probable_incident_id"), F.array(agency_of(F.col("source"))).alias("agencies"), F.array_sort("units").alias("units"),
        F.coalesce("type", F.lit("unknown")).alias("primary_type"),
    )
    return met.select(*_COLUMNS).unionByName(read).unionByName(alone)


def replay(cases: DataFrame) -> DataFrame:
    """The decisions of every ``case`` on an empty state of its own, all in one job: ``case`` and the columns of :func:`correlate`.

    ``cases`` has the columns of observations and ``case``; an observation may be in several.
    """
    columns = ["id", "us", "source", "type", "raw_type", "lat", "lng", "neighborhood", "units"]
    rows = cases.select(F.col("case").alias("component"), *columns).where("component is not null")
    kind = rows.schema["component"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold = Fold()
        for batch in batches:
            for done in fold.run(iter([batch])):
                yield done.assign(case=batch["component"].to_numpy())

    return rows.repartition("component").sortWithinPartitions("component", "us", "id").mapInPandas(run, f"{_RESULT}, case {kind}")


def incident_summary(decisions: DataFrame) -> DataFrame:
    """One row per incident: counts, agencies, units, verification."""
    grouped = decisions.groupBy("incident_id").agg(
        F.count("*").alias("source_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("agencies")))).alias("agencies"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("units")))).alias("units"),
    )
    return grouped.withColumn("verification", F.when(F.size("agencies") >= 2, "multi-source").otherwise("reported"))
