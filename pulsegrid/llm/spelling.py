"""Spelling variants: words one edit apart, met by an even-partition pigeonhole join.

A word of length ``l`` is cut into two segments at ``l // 2``.  One edit lies in
one of them, so two words one edit apart agree in the other, and by the same
argument in one half of the segment with the edit.  A word is indexed under the
four pieces this gives; it probes the pieces of words of its own length and,
shifted behind the edit, of words one shorter.  A pair counts at the first piece
it agrees in, so no candidate is seen twice, and is verified by its distance.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import byte_texts
from pulsegrid.session import cut_lineage

#: Of the hashes of (document, run), every DELETE_EVERY-th loses a code point.
DELETE_EVERY = 31
#: Code points and occurrences of a word, and how much more often its form must occur.
LEAST_LENGTH, LEAST_COUNT, MORE_OFTEN = 7, 2, 10
#: Words a task counts before it hands them on.
HELD = 200_000
_RUN = re.compile("[a-zÀ-ÿ]+")
#: Counts below 2**63 cannot rise by a factor of ten more often than this, and steps double.
_ROUNDS = 6


def document_words(doc_id: int | None, data: bytes | None, least: int = LEAST_LENGTH, every: int = DELETE_EVERY) -> Counter[str]:
    """Words of a text and how often; a run loses the code point its hash names if ``every`` divides the hash."""
    out: Counter[str] = Counter()
    if not data:
        return out
    start = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
    for run, n in Counter(_RUN.findall(data.lower().decode())).items():
        if len(run) >= least:
            h = zlib.crc32(run.encode(), start)
            if h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < least:
                    continue
            out[run] += n
    return out


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` over all texts; tasks count ahead of the shuffle, HELD words at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        told = lambda: pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), strict=True):
                held.update(document_words(doc_id, data, least_length))
                if len(held) > HELD:
                    yield told()
                    held.clear()
        if held:
            yield told()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _pieces(word: Column, length: Column, shift: int) -> list[Column]:
    """What a word keeps of an index word of ``length`` if the edit is in its fourth, third, second or first quarter."""
    half = F.floor(length / 2).cast("int")
    first, third = F.floor(half / 2).cast("int"), (half + F.floor((length - half) / 2)).cast("int")
    before = lambda at: F.substr(word, F.lit(1), at)
    behind = lambda at: F.substr(word, at + F.lit(1 + shift))
    return [before(third), F.concat(before(half), behind(third)), F.concat(before(first), behind(half)), behind(first)]


def near_words(words: DataFrame) -> DataFrame:
    """``a, a_n, b, b_n``: every pair of words one edit apart once, ``a`` the shorter, of equal length the smaller."""

    def keyed(name: str, length: Column, shift: int) -> DataFrame:
        held = words.select(F.col("word").alias(name), F.col("n").alias(f"{name}_n"), length.cast("int").alias(f"{name}_length"))
        keys = [F.struct(F.lit(i).alias("piece"), F.xxhash64(F.lit(i), F.col(f"{name}_length"), p).alias("key")) for i, p in enumerate(_pieces(F.col(name), F.col(f"{name}_length"), shift))]
        return held.select("*", F.inline(F.array(*keys)))

    index = keyed("a", F.length("word"), 0).withColumnRenamed("piece", "a_piece")
    met = None
    for shift in (0, 1):
        probe = keyed("b", F.length("word") - shift, shift)
        pieces = zip(_pieces(F.col("a"), F.col("a_length"), 0), _pieces(F.col("b"), F.col("a_length"), shift), strict=True)
        agree = F.coalesce(*[F.when(x == y, F.lit(i)) for i, (x, y) in enumerate(pieces)])
        on = (index["key"] == probe["key"]) & (F.col("a_length") == F.col("b_length")) & (F.col("a_piece") == F.col("piece")) & (agree == F.col("piece"))
        if not shift:
            on &= F.col("a") < F.col("b")
        on &= F.levenshtein("a", "b", 1) == 1
        found = index.join(probe, on).select("a", "a_n", "b", "b_n")
        met = found if met is None else met.unionByName(found)
    return met


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``word, form`` rows: forms followed to the last, twice as far each round."""
    at = cut_lineage(forms.select("word", F.col("form").alias("root")))
    for _ in range(_ROUNDS):
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        moved = cut_lineage(at.join(onward, "root", "left").select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("__moved")))
        at = moved.drop("__moved")
        if moved.where("__moved").isEmpty():
            break
    return at


def spelling_variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, more_often: int = MORE_OFTEN) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: every word with its commoner spelling.

    ``form`` is the near word of largest count (ties: the smallest) if that is at
    least ``more_often`` times the word's; ``root`` is where forms end, the word
    itself if it has none.  A null or empty text has no words, a null ``doc_id``
    hashes as an empty one; every row counts as a document of its own, so repeated
    rows count again; other columns are ignored.  No words: no rows.
    """
    words = cut_lineage(word_counts(docs, least_length, least_count))
    pairs = near_words(words)
    sides = F.array(*[F.struct(F.col(x).alias("word"), F.struct((-F.col(f"{y}_n")).alias("less"), F.col(y).alias("word")).alias("near")) for x, y in ("ab", "ba")])
    near = pairs.select(F.inline(sides)).groupBy("word").agg(F.count("*").alias("n_near"), F.min("near").alias("best"))
    joined = words.join(near, "word", "left")
    is_form = -F.col("best.less") >= F.col("n") * more_often
    told = cut_lineage(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")
    ))
    roots = _roots(told.where("form is not null"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
