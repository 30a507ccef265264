"""Training-data pipeline over ``documents``: quality, lines, near copies, benchmark passages, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its
predecessor kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import decontam, hyperminhash, line_dedup, packing, quality
from pulsegrid.llm.queries import TOKENIZER
from pulsegrid.session import cut_lineage, table

#: Words of a shingle in the near-duplicate stage.
SHINGLE = 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose verdict is kept."""
    return quality.judge_quality(docs).where("kept").select("row.*")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; a document of which no word is left goes. ``n_chars`` follows the text."""
    done = line_dedup.dedup_lines(docs).where(r"n_removed = 0 or row.text rlike '[^\\x20\\x09-\\x0D]'")
    return done.select("row.*").withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that of the smallest id."""
    gone = hyperminhash.near_duplicates(docs, shingle=SHINGLE, percent=80).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark passages."""
    gone = decontam.contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences."""
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("packing", pack),
]
#: SQL cannot express the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
