"""Classification of raw codes and labels, and priorities, by configuration tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Agency priority codes on the shared scale of 1 (most urgent) to 5.
_FIRE_SCALE = {"E": 1, "3": 2, "2": 3, "1": 4, "A": 2, "B": 3}
PRIORITIES = {"sf_police_cad": {"A": 1, "B": 2, "C": 4}, "sf_fire_cad": _FIRE_SCALE, "sf_ems_cad": _FIRE_SCALE}
#: Confidence of a record that no rule knows.
UNMAPPED = 0.2
_RULE = "rawCode string, rawLabelPattern string, rawLabel string, normalizedType string, subtype string, defaultSeverity string, typeConfidence double"


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """The rules of all configuration files in a folder: ``source, version, position`` and the rule's fields."""
    files = spark.read.schema(f"version string, source string, mappings array<struct<{', '.join(f.replace(' ', ': ') for f in _RULE.split(', '))}>>").option("multiLine", True).json(path)
    return files.select("source", "version", F.posexplode("mappings").alias("position", "m")).select("source", "version", "position", "m.*")


def replace_source(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The stored rules with every source that ``incoming`` has replaced as a whole."""
    return stored.join(incoming.select("source").distinct(), "source", "left_anti").unionByName(incoming)


def classify(rows: DataFrame, taxonomy: DataFrame, code: str = "raw_type", label: str = "subtype") -> DataFrame:
    """Adds ``type, type_subtype, severity, type_confidence, matched_by``.

    The rule of the exact code, in any case, wins; else the first rule of the
    source whose pattern the label holds; else the type is ``unknown``.  Rules
    are configuration, some hundred a source; Spark broadcasts them if they are
    as small as they should be, and joins by source and code otherwise.
    """
    rule = F.struct("normalizedType", "subtype", "defaultSeverity", "typeConfidence")
    codes = taxonomy.where("coalesce(rawCode, '') <> ''").groupBy(F.col("source").alias("__source"), F.upper("rawCode").alias("__code")).agg(F.max_by(rule, "position").alias("__exact"))
    patterned = taxonomy.where("coalesce(rawCode, '') = '' and coalesce(rawLabelPattern, '') <> ''")
    patterns = patterned.groupBy(F.col("source").alias("__source")).agg(F.array_sort(F.collect_list(F.struct("position", F.concat(F.lit("(?i)"), "rawLabelPattern").alias("pattern"), rule.alias("rule")))).alias("__patterns"))
    on_code = (F.col("source") == codes["__source"]) & (F.upper(code) == codes["__code"])
    joined = rows.join(codes, on_code, "left").drop("__source", "__code").join(patterns, F.col("source") == patterns["__source"], "left").drop("__source")
    first = F.get(F.filter("__patterns", lambda p: F.rlike(F.col(label), p["pattern"])), F.lit(0))["rule"]
    found = F.coalesce("__exact", first)
    by = F.when(F.col("__exact").isNotNull(), "code").when(first.isNotNull(), "pattern").otherwise("unmapped")
    named = joined.withColumns({"matched_by": by, "__rule": found})
    return named.withColumns(
        {
            "type": F.coalesce("__rule.normalizedType", F.lit("unknown")), "type_subtype": F.col("__rule.subtype"), "severity": F.col("__rule.defaultSeverity"),
            "type_confidence": F.coalesce("__rule.typeConfidence", F.lit(UNMAPPED)),
        }
    ).drop("__rule", "__exact", "__patterns")


def priority_rank(source: Column, code: Column) -> Column:
    """The shared rank of an agency's code; null for a source or code that has none."""
    ranks = F.create_map(*[x for s, scale in PRIORITIES.items() for c, r in scale.items() for x in (F.lit(f"{s}|{c}"), F.lit(r))])
    return F.try_element_at(ranks, F.concat(source, F.lit("|"), F.upper(F.trim(code))))
