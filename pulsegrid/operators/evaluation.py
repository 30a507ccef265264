"""Labelled cases against a grouping: outcomes, metrics and sweeps of weights and thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.scoring import SLACK, THIN_EVIDENCE
from pulsegrid.operators.scoring import WEIGHTS as DEFAULT

#: Weights and thresholds that a sweep tries.
WEIGHTS = {
    "default": DEFAULT, "place": {"location": 0.5, "time": 0.2, "type": 0.15, "units": 0.1, "text": 0.05},
    "time": {"location": 0.25, "time": 0.4, "type": 0.2, "units": 0.1, "text": 0.05}, "type": {"location": 0.25, "time": 0.2, "type": 0.4, "units": 0.1, "text": 0.05},
}
THRESHOLDS = (0.75, 0.8, 0.85, 0.9)


def report_cases(joined: DataFrame, day_us: int = 86_400_000_000) -> DataFrame:
    """``case, label, id``: labelled cases from written reports, of ``id, us, neighborhood, report`` rows of dispatch calls.

    Calls of one report are one event (``same``, where there are two or more).
    The first call of a report and that of the next report of its area and day
    are two (``different``).  Calls without a report label nothing.
    """
    told = joined.where("report is not null")
    sizes = told.select("report", "id").distinct().groupBy("report").agg(F.count("*").alias("n")).where("n > 1")
    same = told.join(sizes, "report").select(F.concat(F.lit("same-"), "report").alias("case"), F.lit("same").alias("label"), "id").distinct()
    first = told.groupBy("report").agg(F.min(F.struct("us", "id", "neighborhood")).alias("f")).select("report", "f.*").where("neighborhood is not null")
    after = Window.partitionBy("neighborhood", F.floor(F.col("us") / day_us)).orderBy("us", "id")
    next_to = first.withColumn("next", F.lead("id").over(after)).where("next is not null")
    apart = next_to.select(F.concat(F.lit("different-"), "report").alias("case"), F.lit("different").alias("label"), F.explode(F.array("id", "next")).alias("id"))
    return same.unionByName(apart)


def case_outcomes(assigned: DataFrame) -> DataFrame:
    """``case, label, incidents, correct, tp, fp, fn, tn`` of ``case, label, observation, incident`` rows.

    Pairs are counted from the sizes of the groups, never listed.
    """
    pairs = lambda n: (n * (n - 1) / 2).cast("long")
    groups = assigned.groupBy("case", "label", "incident").agg(F.count("*").alias("n"))
    cases = groups.groupBy("case", "label").agg(F.count("*").alias("incidents"), F.sum("n").alias("n"), F.sum(pairs(F.col("n"))).alias("together"))
    same, apart = F.col("label") == "same", pairs(F.col("n")) - F.col("together")
    none = F.lit(0).cast("long")
    return cases.select(
        "case", "label", "incidents", F.when(same, F.col("incidents") == 1).otherwise(F.col("incidents") == F.col("n")).alias("correct"),
        F.when(same, F.col("together")).otherwise(none).alias("tp"), F.when(same, none).otherwise(F.col("together")).alias("fp"),
        F.when(same, apart).otherwise(none).alias("fn"), F.when(same, none).otherwise(apart).alias("tn"),
    )


def _rates(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision and recall, 1 where nothing is asked, and F1, 0 where both are."""
    precision = F.when(tp + fp == 0, F.lit(1.0)).otherwise(F.try_divide(tp, tp + fp))
    recall = F.when(tp + fn == 0, F.lit(1.0)).otherwise(F.try_divide(tp, tp + fn))
    return precision, recall, F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))


def metrics(outcomes: DataFrame) -> DataFrame:
    """One row: cases, correct ones, precision, recall, F1, false and missed merges, and cases of one event that were split."""
    split = F.count_if((F.col("label") == "same") & (F.col("incidents") > 1))
    whole = outcomes.agg(F.count("*").alias("cases"), F.count_if("correct").alias("cases_correct"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")], split.alias("split_cases"))
    precision, recall, f1 = _rates(F.col("tp"), F.col("fp"), F.col("fn"))
    return whole.select("cases", "cases_correct", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), F.col("fp").alias("false_merges"), F.col("fn").alias("missed_merges"), "split_cases")


def sweep(pairs: DataFrame, weights: dict[str, dict[str, float]] = WEIGHTS, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """``weights, threshold, tp, fp, fn, precision, recall, f1``: what each would merge of labelled, scored pairs.

    ``pairs``: label, s_location, s_time, s_type, s_units.  One pass counts the
    whole grid; only a row a grid point and task is shuffled.
    """
    same = F.col("label") == "same"

    def score(w: dict[str, float]) -> Column:
        parts = [(F.col(f"s_{name}"), w[name]) for name in ("location", "time", "type", "units")]
        total = sum((F.coalesce(s * v, F.lit(0.0)) for s, v in parts), F.lit(0.0))
        applied = sum((F.when(s.isNotNull(), F.lit(v)).otherwise(F.lit(0.0)) for s, v in parts), F.lit(0.0))
        raw = F.coalesce(F.try_divide(total, applied), F.lit(0.0))
        return F.when(F.col("s_type").isNull() & F.col("s_units").isNull(), F.least(raw, F.lit(THIN_EVIDENCE))).otherwise(raw)

    grid = [(name, t, score(w) >= t - SLACK) for name, w in weights.items() for t in thresholds]
    counted = pairs.agg(*[F.struct(F.count_if(said & same).alias("tp"), F.count_if(said & ~same).alias("fp"), F.count_if(~said & same).alias("fn")).alias(f"g{i}") for i, (_, _, said) in enumerate(grid)])
    rows = F.array(*[F.struct(F.lit(name).alias("weights"), F.lit(t).alias("threshold"), F.col(f"g{i}.tp").alias("tp"), F.col(f"g{i}.fp").alias("fp"), F.col(f"g{i}.fn").alias("fn")) for i, (name, t, _) in enumerate(grid)])
    precision, recall, f1 = _rates(F.col("tp"), F.col("fp"), F.col("fn"))
    return counted.select(F.inline(rows)).select("weights", "threshold", "tp", "fp", "fn", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def shape_cap(pairs: DataFrame, most: int) -> DataFrame:
    """The latest ``most`` pairs ``a, b, us`` of each ``shape`` (a top-k report by shape)."""
    order = Window.partitionBy("shape").orderBy(F.desc("us"), "a", "b")
    return pairs.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most).drop("__n")
