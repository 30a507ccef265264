"""Scores of observation pairs; null means that a feature does not apply, which is not 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.range_join import MINUTE
from pulsegrid.sources.observations import agency_of

#: Radius, minutes and thresholds of the correlation.
METERS, BACK, AHEAD = 400.0, 25, 15
SAME_AREA, THIN_EVIDENCE = 0.35, 0.84
MERGE, PROBABLE, SLACK = 0.85, 0.65, 1e-9
WEIGHTS = {"location": 0.35, "time": 0.25, "type": 0.2, "units": 0.1, "text": 0.1}
#: Affinity of unequal types; either order counts.
AFFINITY = {
    "collision": {"medical": 0.85, "traffic": 0.7, "rescue": 0.6, "fire": 0.4},
    "assault": {"medical": 0.8, "weapon": 0.75, "disturbance": 0.5},
    "weapon": {"assault": 0.75, "medical": 0.7, "police_activity": 0.3},
    "fire": {"medical": 0.7, "hazard": 0.6, "rescue": 0.6},
    "medical": {"assault": 0.8, "collision": 0.85, "fire": 0.7, "rescue": 0.6, "weapon": 0.7, "disturbance": 0.6, "public_safety": 0.55},
    "rescue": {"fire": 0.6, "medical": 0.6, "collision": 0.6, "hazard": 0.5},
    "hazard": {"fire": 0.6, "rescue": 0.5, "traffic": 0.3},
    "traffic": {"collision": 0.7, "hazard": 0.3},
    "robbery": {"assault": 0.6, "weapon": 0.5, "theft": 0.5, "medical": 0.4},
    "burglary": {"theft": 0.6, "police_activity": 0.3},
    "theft": {"burglary": 0.6, "robbery": 0.5},
    "disturbance": {"assault": 0.5, "medical": 0.6, "public_safety": 0.4, "police_activity": 0.3},
    "public_safety": {"disturbance": 0.4, "medical": 0.55, "police_activity": 0.3},
    "police_activity": {"public_safety": 0.3, "disturbance": 0.3},
    "missing_person": {"public_safety": 0.4},
}
#: Agency codes that contradict a type.
CODE_OVERRIDES = {"594": {"medical": 0.0}, "595": {"medical": 0.0}}


def weights_are_valid(weights: dict[str, float]) -> bool:
    return all(w >= 0 for w in weights.values()) and abs(sum(weights.values()) - 1) <= 1e-6


def type_affinity(a: Column, b: Column, code_a: Column, code_b: Column) -> Column:
    """1 for equal types, null where one is missing or unknown, else the override or affinity, else 0."""
    known = a.isNotNull() & b.isNotNull() & (a != "unknown") & (b != "unknown")
    both: dict[str, float] = {}
    for x, row in AFFINITY.items():
        for y, value in row.items():
            both.setdefault(f"{y}|{x}", value)
    for x, row in AFFINITY.items():
        both.update({f"{x}|{y}": value for y, value in row.items()})
    codes = {f"{c}|{t}": v for c, row in CODE_OVERRIDES.items() for t, v in row.items()}
    literal = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
    pair = lambda m, x, y: F.try_element_at(literal(m), F.concat_ws("|", x, y))
    other = F.coalesce(pair(codes, code_a, b), pair(codes, code_b, a), pair(both, a, b), F.lit(0.0))
    return F.when(known, F.when(a == b, F.lit(1.0)).otherwise(other))


def score_pairs(pairs: DataFrame) -> DataFrame:
    """Adds the feature scores and ``score`` to pairs of columns ``x`` and ``o_x``; ``distance`` may be null."""
    near = F.when(F.col("distance").isNotNull(), F.greatest(F.lit(0.0), 1 - F.col("distance") / METERS))
    area = F.when(F.col("neighborhood") == F.col("o_neighborhood"), F.lit(SAME_AREA))
    gap = F.abs(F.col("us") - F.col("o_us")) / F.lit(float(BACK * MINUTE))
    common = F.size(F.array_intersect("units", "o_units")) / F.size(F.array_union("units", "o_units"))
    same_agency = agency_of(F.col("source")) == agency_of(F.col("o_source"))
    scored = pairs.withColumns(
        {
            "s_location": F.coalesce(near, area),
            "s_time": F.greatest(F.lit(0.0), 1 - gap),
            "s_type": type_affinity(F.col("type"), F.col("o_type"), F.col("raw_type"), F.col("o_raw_type")),
            "s_units": F.when(same_agency & (F.size("units") > 0) & (F.size("o_units") > 0), common),
        }
    )
    parts = [(F.col(f"s_{name}"), weight) for name, weight in WEIGHTS.items() if name != "text"]  # texts are never compared
    total = sum((F.coalesce(s * w, F.lit(0.0)) for s, w in parts), F.lit(0.0))
    applied = sum((F.when(s.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for s, w in parts), F.lit(0.0))
    raw = F.when(applied > 0, total / applied).otherwise(F.lit(0.0))
    thin = F.col("s_type").isNull() & F.col("s_units").isNull()
    return scored.withColumn("score", F.when(thin, F.least(raw, F.lit(THIN_EVIDENCE))).otherwise(raw))


def best_candidate(scored: DataFrame) -> DataFrame:
    """One pair for each ``id``: highest score, then location score, then earliest, then smallest id; combined before the shuffle."""
    order = F.struct(F.col("score"), F.coalesce("s_location", F.lit(-1.0)), -F.col("o_us"), -F.col("o_id"))
    rest = [c for c in scored.columns if c != "id"]
    return scored.groupBy("id").agg(F.max_by(F.struct(*rest), order).alias("best")).select("id", "best.*")


def decision(score: Column) -> Column:
    return F.when(score >= MERGE - SLACK, "merged").when(score >= PROBABLE - SLACK, "probable").otherwise("created")
