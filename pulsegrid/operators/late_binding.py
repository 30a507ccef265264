"""Articles and other outcome sources that come hours or days after the event, attached to incidents long closed.

A path of its own: its window looks back two weeks, its time score does not mind
hours, and it has two thresholds.  What it attaches never reopens an incident,
changes its status or its last activity, or merges it with another.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.near_blocks import whole_blocks
from pulsegrid.operators.range_join import MINUTE, near_in_time
from pulsegrid.operators.scoring import type_affinity

HOUR = 60 * MINUTE
DAY = 24 * HOUR
#: How far an article looks back from its time, and ahead, as clocks differ.
BACK, AHEAD = 14 * DAY, HOUR
#: Until when a gap costs nothing, and within what a time counts as consistent.
FRESH, CONSISTENT = 6 * HOUR, DAY
#: Scores of a confirmed and of a possible attachment.
CONFIRMED, POSSIBLE = 0.93, 0.75
#: Weights of place, time and type; the place score of an equal area, and the highest score without a corner.
WEIGHTS = {"place": 0.45, "time": 0.25, "type": 0.3}
SAME_AREA, AREA_MOST = 0.8, 0.92
#: Width of a slot of time; a last time that is not known, as that of no end; a place that none has.
SLOT, FAR, NONE = 2 * (BACK + AHEAD), 1 << 61, 2**63 - 1


def late_score(at_corner: Column, gap_us: Column, kind: Column, o_kind: Column) -> Column:
    """Score of an article against an incident; an unknown type does not apply, and an area alone never reaches CONFIRMED."""
    place = F.when(at_corner, F.lit(1.0)).otherwise(F.lit(SAME_AREA))
    time = F.greatest(F.lit(0.0), F.lit(1.0) - F.greatest(F.lit(0), gap_us - FRESH) / F.lit(float(BACK - FRESH)))
    nothing = F.lit("")
    alike = type_affinity(kind, o_kind, nothing, nothing)
    known = WEIGHTS["place"] * place + WEIGHTS["time"] * time
    score = F.when(alike.isNull(), known / (WEIGHTS["place"] + WEIGHTS["time"])).otherwise(known + WEIGHTS["type"] * alike)
    return F.round(F.when(at_corner, score).otherwise(F.least(score, F.lit(AREA_MOST))), 9)


def late_candidates(articles: DataFrame, incidents: DataFrame) -> DataFrame:
    """``article_id, incident_id, score, gap_us, at_corner, named`` of pairs at one corner, or of one type in one area.

    ``articles``: article_id, us, corner, neighborhood, type, agency.
    ``incidents``: incident_id, first_us, last_us, corner, neighborhood,
    primary_type, agencies.  Null corners and areas meet nothing.
    """
    told = articles.select("article_id", "us", "corner", "neighborhood", F.coalesce("type", F.lit("unknown")).alias("kind"), "agency")
    there = incidents.select("incident_id", F.col("first_us").alias("us"), "last_us", "corner", "neighborhood", F.col("primary_type").alias("kind"), "agencies")
    corner = near_in_time(told, there, BACK, AHEAD, ("corner",)).withColumn("at_corner", F.lit(True))
    area = near_in_time(told, there, BACK, AHEAD, ("neighborhood", "kind")).withColumn("at_corner", F.lit(False))
    elsewhere = ~F.coalesce(F.col("corner") == F.col("o_corner"), F.lit(False))
    both = corner.unionByName(area.where(elsewhere & (F.col("kind") != "unknown")))
    gap = F.greatest(F.lit(0), F.col("us") - F.col("o_last_us"))
    return both.select(
        "article_id", F.col("o_incident_id").alias("incident_id"), late_score(F.col("at_corner"), gap, F.col("kind"), F.col("o_kind")).alias("score"), gap.alias("gap_us"), "at_corner",
        F.coalesce(F.array_contains("o_agencies", F.col("agency")), F.lit(False)).alias("named"), "us",
    )


def _least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of ``values[low:high]`` for each pair of places, NONE where that is empty; by spans of powers of two."""
    out = np.full(len(low), NONE)
    level = np.frexp(np.maximum(high - low, 0).astype("float64"))[1] - 1
    for k in range(int(level.max(initial=-1)) + 1):
        at = np.nonzero(level == k)[0]
        out[at] = np.minimum(values[low[at]], values[high[at] - (1 << k)])
        values = np.minimum(values[: -(1 << k)], values[1 << k :])
    return out


def _least_over(n: int, low: np.ndarray, high: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each of ``n`` places the least value of the spans ``low:high`` that cover it, NONE where none does."""
    level = np.frexp(np.maximum(high - low, 0).astype("float64"))[1] - 1
    out = np.full(n, NONE)
    for k in range(int(level.max(initial=-1)), -1, -1):
        # a span of 2 ** (k + 1) is two of 2 ** k
        if k < level.max():
            half = 1 << k
            out[half:] = np.minimum(out[half:], out[:-half])
        at = level == k
        np.minimum.at(out, low[at], values[at])
        np.minimum.at(out, high[at] - (1 << k), values[at])
    return out


def _order(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of the columns, the last one first, and each row's place in it."""
    order = np.lexsort(columns)
    place = np.empty(len(order), "int64")
    place[order] = np.arange(len(order))
    return order, place


def _nearest(rows: pd.DataFrame) -> pd.DataFrame | None:
    """Of some blocks, for each row that is at home there its first by gap, then id, in every class of the other side.

    A class is what is of one kind in a block.  In it the score falls with the
    gap alone, so nothing else of the class can be a row's best.
    """
    a, i = (rows[rows["told"] == side] for side in (True, False))
    a, i = (x[x["block"].isin(y["block"].unique())].reset_index(drop=True) for x, y in ((a, i), (i, a)))
    if not len(a) or not len(i):
        return None
    base = min(a["at"].min(), i["at"].min())
    at, first = (x["at"].to_numpy() - base for x in (a, i))
    span = int(max(at.max(), first.max())) + 2
    last = np.clip(i["last_at"].to_numpy() - base, -1, span - 1)
    a_id, i_id = (_order(pd.factorize(x[c], sort=True)[0]) for x, c in ((a, "article_id"), (i, "incident_id")))

    def place(keys: np.ndarray, group: np.ndarray, time: np.ndarray, side: str) -> np.ndarray:
        return np.searchsorted(keys, group * span + np.clip(time, -1 if side == "right" else 0, span - 1), side=side)

    def asking(left: pd.DataFrame, right: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows at home and classes of the other side in their block; the class of each row there."""
        group = right.groupby(["block", "kind"], sort=False).ngroup().to_numpy()
        classes = pd.DataFrame({"block": right["block"], "group": group}).drop_duplicates()
        home = left.loc[left["home"], ["block"]].reset_index().merge(classes, on="block")
        return home["index"].to_numpy(), home["group"].to_numpy(), group

    # an article: the least id of incidents in reach that last until it, else the one that lasted longest
    row, group, of = asking(a, i)
    order = np.lexsort((at[row], group))
    row, group = row[order], group[order]
    keys = group * span + at[row]
    low, high = place(keys, of, first - AHEAD, "left"), place(keys, of, np.minimum(first + BACK, last), "right")
    until = _least_over(len(row), low, high, i_id[1])
    sorted_ = np.lexsort((first, of))
    longest, at_longest = _order(i_id[1], -last)
    keys = (of * span + first)[sorted_]
    low, high = place(keys, group, at[row] - BACK, "left"), place(keys, group, at[row] + AHEAD, "right")
    before = _least(at_longest[sorted_], low, high)
    met = np.minimum(until, before) < NONE
    theirs = np.where(until < NONE, i_id[0][np.minimum(until, len(i) - 1)], longest[np.minimum(before, len(i) - 1)])
    found = [(True, row[met], theirs[met])]
    # an incident: the least id of articles in reach up to its last time, else the next one
    row, group, of = asking(i, a)
    sorted_ = np.lexsort((a_id[1], at, of))
    keys = (of * span + at)[sorted_]
    low, high = place(keys, group, first[row] - AHEAD, "left"), place(keys, group, np.minimum(first[row] + BACK, last[row]), "right")
    until = _least(a_id[1][sorted_], low, high)
    after = place(keys, group, np.maximum(first[row] - AHEAD, last[row] + 1), "left")
    met = (until < NONE) | (after < place(keys, group, first[row] + BACK, "right"))
    theirs = np.where(until < NONE, a_id[0][np.minimum(until, len(a) - 1)], sorted_[np.minimum(after, len(a) - 1)])
    found.append((False, theirs[met], row[met]))

    def named(ours: pd.DataFrame, theirs: pd.DataFrame) -> list[bool]:
        return [agency is not None and agencies is not None and agency in agencies for agency, agencies in zip(ours["agency"], theirs["agencies"], strict=True)]

    out = []
    for told, x, y in found:
        ours, theirs = a.iloc[x].reset_index(drop=True), i.iloc[y].reset_index(drop=True)
        # an article's own rows alone say what becomes of a pair
        by_name = named(ours, theirs) if told else False
        gap = np.maximum(0, ours["us"] - theirs["last_us"])
        out.append(pd.DataFrame({"told": told, "article_id": ours["article_id"], "incident_id": theirs["incident_id"], "gap_us": gap, "at_corner": ours["at_corner"], "kind": ours["kind"], "o_kind": theirs["kind"], "named": by_name, "us": ours["us"]}))
    return pd.concat(out)


def _best(articles: DataFrame, incidents: DataFrame) -> DataFrame:
    """``told, article_id, incident_id, score, gap_us, at_corner, named, us``: the best of each article (``told``) and of each incident.

    No pair is built: rows are dealt into blocks of a corner, or of an area and
    type, in slots of time, at home in one slot and copied to the few that they reach.
    """
    kinds = {f.name: f.dataType for df in (articles, incidents) for f in df.schema}
    none = lambda c: F.lit("0").cast(kinds[c]).alias(c)
    place = ("corner", "neighborhood")
    kind = lambda c: F.coalesce(c, F.lit("unknown")).alias("kind")
    told = articles.select(
        F.lit(True).alias("told"), "article_id", none("incident_id"), "us", F.lit(0).cast("long").alias("last_us"), *place, kind("type"), "agency", F.lit(None).cast(kinds["agencies"]).alias("agencies"),
        F.lit(BACK).alias("back"), F.lit(AHEAD).alias("ahead"),
    )
    there = incidents.select(
        F.lit(False).alias("told"), none("article_id"), "incident_id", F.col("first_us").alias("us"), F.coalesce("last_us", F.lit(FAR)).alias("last_us"), *place, kind("primary_type"), F.lit(None).cast(kinds["agency"]).alias("agency"), "agencies",
        F.lit(AHEAD).alias("back"), F.lit(BACK).alias("ahead"),
    )
    rows = told.where("article_id is not null").unionByName(there.where("incident_id is not null")).where("us is not null")
    corner = F.struct(F.lit(True).alias("at_corner"), F.col("corner").cast("string").alias("place"), F.lit("").alias("only"))
    area = F.struct(F.lit(False).alias("at_corner"), F.when(F.col("kind") != "unknown", F.col("neighborhood").cast("string")).alias("place"), F.col("kind").alias("only"))
    placed = rows.select("*", F.inline(F.array(corner, area))).where("place is not null").drop(*place)
    bins = F.sequence(*[F.floor(t / F.lit(SLOT)).cast("long") for t in (F.col("us") - F.col("back"), F.col("us") + F.col("ahead"))])
    dealt = placed.withColumn("slot", F.explode(bins)).withColumn("home", F.col("slot") == F.floor(F.col("us") / F.lit(SLOT))).drop("back", "ahead")
    dealt = dealt.withColumns({"at": F.col("us") - F.col("slot") * SLOT, "last_at": F.col("last_us") - F.col("slot") * SLOT})
    schema = f"told boolean, article_id {kinds['article_id'].simpleString()}, incident_id {kinds['incident_id'].simpleString()}, gap_us bigint, at_corner boolean, kind string, o_kind string, named boolean, us bigint"
    near = whole_blocks(dealt, ["at_corner", "place", "only", "slot"], _nearest, schema)
    scored = near.withColumn("score", late_score(F.col("at_corner"), F.col("gap_us"), F.col("kind"), F.col("o_kind"))).where(F.col("score") >= POSSIBLE)
    order = F.struct((-F.col("score")).alias("less"), "gap_us", "incident_id", "article_id", "at_corner", "named", "us", "score")
    of = [F.when(F.col("told"), F.col("article_id")).alias("of_article"), F.when(~F.col("told"), F.col("incident_id")).alias("of_incident")]
    return scored.groupBy("told", *of).agg(F.min(order).alias("b")).select("told", *[f"b.{c}" for c in ("article_id", "incident_id", "score", "gap_us", "at_corner", "named", "us")])


def attach(articles: DataFrame, incidents: DataFrame) -> DataFrame:
    """``article_id, incident_id, score, verdict, enriched_us``: pairs that are each other's best, confirmed or possible.

    Best is the highest score, then the smallest gap, then the smallest id, as of
    all :func:`late_candidates`; rows without an id attach to nothing.
    Confirmed asks for CONFIRMED and a corner, with a consistent time or the name
    of an agency that was there.  Below POSSIBLE nothing attaches.
    """
    pairs = _best(articles, incidents).groupBy("article_id", "incident_id").agg(
        F.count_if("told").alias("by_article"), F.count_if(~F.col("told")).alias("by_incident"), F.max_by(F.struct("score", "gap_us", "at_corner", "named", "us"), "told").alias("b")
    )
    mutual = pairs.where("by_article > 0 and by_incident > 0").select("article_id", "incident_id", "b.*")
    sure = (F.col("score") >= CONFIRMED) & F.col("at_corner") & ((F.col("gap_us") <= CONSISTENT) | F.col("named"))
    verdict = F.when(sure, "confirmed").otherwise("possible")
    return mutual.select("article_id", "incident_id", "score", verdict.alias("verdict"), F.col("us").alias("enriched_us"))


def enriched(incidents: DataFrame, attachments: DataFrame) -> DataFrame:
    """The incidents as they are, with ``last_enriched_us``: the latest of what was attached late, null if nothing was."""
    last = attachments.groupBy("incident_id").agg(F.max("enriched_us").alias("last_enriched_us"))
    return incidents.join(last, "incident_id", "left")
