"""Full-text search: an inverted token table and BM25 as joins and sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.session import cut_lineage

K1, B = 1.2, 0.75


def tokens(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, token, tf, size``; null texts have none."""
    words = F.filter(F.split(F.lower(text_col), "[^\\p{L}\\p{N}]+", -1), lambda w: w != "")
    split = rows.select(F.col(id_col).alias("id"), words.alias("words"))
    flat = split.select("id", F.size("words").alias("size"), F.explode("words").alias("token"))
    return flat.groupBy("id", "size", "token").agg(F.count("*").alias("tf"))


def bm25(rows: DataFrame, query: list[str], id_col: str, text_col: str, limit: int) -> DataFrame:
    """The ``limit`` best rows (a top-k report): ``id, score``, ties by id.

    Texts are split once: what is kept of each is its size and how often it uses
    the query's tokens, and all counts of the corpus come from that.
    """
    words = F.filter(F.split(F.lower(text_col), "[^\\p{L}\\p{N}]+", -1), lambda w: w != "")
    split = rows.select(F.col(id_col).alias("id"), words.alias("words"))
    uses = [_uses(q) for q in query]
    slim = cut_lineage(split.select("id", F.size("words").alias("size"), *[u.alias(f"tf{i}") for i, u in enumerate(uses)]))
    counts = [F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(query))]
    whole = slim.agg(F.count("*").alias("docs"), F.avg("size").alias("mean"), *counts)
    score, any_ = F.lit(0.0), F.lit(False)
    for i in range(len(query)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("docs") - df + 0.5) / (df + 0.5))
        score += idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("size") / F.col("mean")))
        any_ |= tf > 0
    scored = slim.where(any_).crossJoin(F.broadcast(whole))  # one row
    return scored.select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def _uses(token: str) -> Column:
    return F.size(F.filter("words", lambda w: w == token))
