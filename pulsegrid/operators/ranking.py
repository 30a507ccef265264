"""Highlights and the re-ranking of search hits by given relevance answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.sources.observations import mapped

#: Weight of a type among highlights, levels and gates of answers.
TYPE_WEIGHT = {
    "weapon": 5, "robbery": 4, "fire": 4, "assault": 4, "rescue": 3, "collision": 3, "burglary": 2, "hazard": 2, "missing_person": 3, "medical": 1,
    "theft": 1, "disturbance": 1, "traffic": 0, "police_activity": 0, "public_safety": 1, "unknown": 0,
}
TOP_LEVEL, RELEVANCE_GATE, RETRIEVAL_GATE, RETRIEVAL_SPREAD, RETRIEVAL_TYPES, WORTH_REORDERING = 4, 0.35, 0.6, 0.15, 3, 0.5
CATCH_ALL = ("public_safety", "police_activity", "unknown")
JUDGE_GATE, JUDGE_MERGE, JUDGE_CREATE = 0.6, 2.4, 1.2


def type_weight(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TYPE_WEIGHT.items() for x in kv]), F.coalesce(kind, F.lit("unknown"))), F.lit(0))


def highlight_score(kind: Column, priority: Column, units: Column, others: Column) -> Column:
    """Type weight, urgency of priority 1 and 2, three or more units, and other agencies nearby (``others``: how many sources)."""
    urgent = F.when(priority <= 2, 3 - priority).otherwise(0)
    crowd = F.when(F.size(units) >= 3, 2).otherwise(0)
    nearby = F.when(others > 0, 2 + others).otherwise(0)
    return (type_weight(kind) + F.coalesce(urgent, F.lit(0)) + F.coalesce(crowd, F.lit(0)) + F.coalesce(nearby, F.lit(0))).cast("long")


def highlights(rows: DataFrame, limit: int = 3) -> DataFrame:
    """The ``limit`` best rows (a top-k report) by ``score``, the most recent first among equals, then by id."""
    return rows.orderBy(F.desc("score"), F.desc("us"), "id").limit(limit)


def merged_hits(keyword: DataFrame, category: DataFrame, limit: int) -> DataFrame:
    """``id, lexical, via``: keyword hits, then category hits that are none of them, up to ``limit`` (a top-k report).

    ``keyword``: id, lexical; ``category``: id, us.
    """
    both = keyword.select("id", "lexical", F.lit("keyword").alias("via"), F.lit(None).cast("long").alias("us"))
    both = both.unionByName(category.join(keyword.select("id"), "id", "left_anti").select("id", F.lit(0.0).alias("lexical"), F.lit("category").alias("via"), "us"))
    return both.orderBy(F.desc("via"), F.desc("lexical"), F.desc("us"), "id").limit(limit).select("id", "lexical", "via")


def rerank(hits: DataFrame, group: str = "query") -> DataFrame:
    """Adds ``final``: 0.8 of relevance over its top level and 0.2 of the lexical score scaled to 0..1 among the hits of a query.

    ``hits``: query, id, lexical, relevance, confidence.  Answers below the gate
    of confidence, or none, leave the lexical score alone; equal scores are 0.5.
    """
    low, high = F.min("lexical").over(Window.partitionBy(group)), F.max("lexical").over(Window.partitionBy(group))
    scaled = F.when(high == low, F.lit(0.5)).otherwise((F.col("lexical") - low) / (high - low))
    sure = F.col("relevance").isNotNull() & (F.col("confidence") >= RELEVANCE_GATE)
    return hits.withColumn("final", F.when(sure, 0.8 * F.col("relevance") / TOP_LEVEL + 0.2 * scaled).otherwise(scaled))


def worth_reordering(hits: DataFrame, group: str = "query") -> DataFrame:
    """``query, spread, reorder``: relevance only changes an order where it differs enough; a missing answer counts as 0."""
    relevance = F.coalesce(F.when(F.col("confidence") >= RELEVANCE_GATE, F.col("relevance")), F.lit(0.0))
    spread = hits.groupBy(group).agg((F.max(relevance) - F.min(relevance)).alias("spread"))
    return spread.withColumn("reorder", F.col("spread") >= WORTH_REORDERING)


def retrieval_plan(answers: DataFrame, group: str = "query") -> DataFrame:
    """``query, types``: the up to three likeliest types of a query, of those near the best; catch-all types are never taken.

    ``answers``: query, type, likelihood; types are few, so a query's fit one row.
    """
    sure = answers.where((F.col("likelihood") >= RETRIEVAL_GATE) & ~F.col("type").isin(*CATCH_ALL))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("likelihood")).alias("minus"), "type")))
    near = F.filter("l", lambda x: x["minus"] <= F.col("l")[0]["minus"] + RETRIEVAL_SPREAD)
    chosen = sure.groupBy(group).agg(listed.alias("l")).select(group, F.transform(F.slice(near, 1, RETRIEVAL_TYPES), lambda x: x["type"]).alias("types"))
    return answers.select(group).distinct().join(chosen, group, "left").select(group, F.coalesce("types", F.array().cast("array<string>")).alias("types"))


def judged(decision: Column, level: Column, confidence: Column) -> Column:
    """A decision after the verdict of a judge, whose level is 0 to 3: only ``probable`` moves, and only for a sure verdict."""
    moved = F.when(level >= JUDGE_MERGE, "merged").when(level <= JUDGE_CREATE, "created").otherwise("probable")
    return F.when((decision == "probable") & (confidence >= JUDGE_GATE) & level.isNotNull(), moved).otherwise(decision)


def agency_names(sources: Column) -> Column:
    return mapped(sources, {"sf_police_cad": "police", "sf_fire_cad": "fire", "sf_ems_cad": "ems"})
