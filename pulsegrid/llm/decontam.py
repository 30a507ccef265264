"""Benchmark decontamination with a distributed positional inverted index.

1. Count every benchmark term over the whole corpus (map-side sums).
2. A window is WINDOW consecutive words of an item.  Its anchor is its rarest
   term; a window with a term the corpus lacks can match nowhere and is left out.
3. Index the corpus for the anchor terms: postings of (term, document, position),
   each with the hashes of the WINDOW - 1 words on both sides.
4. Join postings with windows on the term and intersect, offset by offset, the
   window's terms with those around the position: all in place is a phrase
   match; most of them nearby, in any place, is a proximity match.

Terms of the benchmark are known to the scans only as a filter of fixed size,
so nothing that is broadcast grows with either input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from pulsegrid.llm.common import ALNUM_LOWER, byte_texts, hash_words, id_filter, passes, signed
from pulsegrid.session import cut_lineage

WINDOW = 13
#: Distinct terms a scan task counts before it passes its sums on.
FLUSH = 500_000


def term_hashes(data: bytes | None) -> np.ndarray:
    """Hashes of the words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return signed(hash_words(data.translate(ALNUM_LOWER).split())) if data else np.empty(0, np.int64)


def _windows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, first, terms = [], [], []
            for i, data in enumerate(byte_texts(batch.column(1))):
                h = term_hashes(data)
                for at in range(max(0, len(h) - size) + 1 if len(h) else 0):
                    ids.append(i)
                    first.append(at)
                    terms.append(h[at : at + size])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(ids, pa.int32())), pa.array(first, pa.int32()), pa.array(terms, pa.list_(pa.int64()))],
                ["item_id", "first", "terms"],
            )

    return run


def _counts(wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sums = wanted.value, {}

        def rows():
            return pa.record_batch({"term": pa.array(list(sums), pa.int64()), "n": pa.array(list(sums.values()), pa.int64())})

        for batch in batches:
            found = []
            for data in byte_texts(batch.column(0)):
                h = term_hashes(data)
                found.append(h[passes(words, h)])
            for term, n in zip(*(x.tolist() for x in np.unique(np.concatenate(found or [np.empty(0, np.int64)]), return_counts=True))):
                sums[term] = sums.get(term, 0) + n
            if len(sums) > FLUSH:
                yield rows()
                sums = {}
        yield rows()

    return run


def _postings(wanted, size: int):
    side = size - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = wanted.value
        posting = pa.struct([("term", pa.int64()), ("pos", pa.int32()), ("near", pa.list_(pa.int64()))])
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n_words, keys, offsets, terms, places, near = [], [], [0], [], [], []
                for data in byte_texts(part.column(1)):
                    h = term_hashes(data)
                    n_words.append(len(h))
                    keys.append(xxh3_64_intdigest(data or b"") >> 1)
                    hit = np.flatnonzero(passes(words, h))
                    if len(hit):
                        padded = np.concatenate([np.zeros(side, np.int64), h, np.zeros(side, np.int64)])
                        near.append(np.lib.stride_tricks.sliding_window_view(padded, 2 * side + 1)[hit].reshape(-1))
                        terms.append(h[hit])
                        places.append(hit.astype(np.int32))
                    offsets.append(offsets[-1] + len(hit))
                total = offsets[-1]
                join = lambda x, kind: pa.array(np.concatenate(x) if x else np.empty(0, kind))
                around = pa.ListArray.from_arrays(pa.array(np.arange(total + 1, dtype=np.int32) * (2 * side + 1)), join(near, np.int64))
                structs = pa.StructArray.from_arrays([join(terms, np.int64), join(places, np.int32), around], fields=list(posting))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(keys, pa.int64()), pa.array(n_words, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs)],
                    ["doc_id", "text_key", "n_words", "postings"],
                )

    return run


def _index(docs: DataFrame, benchmark: DataFrame, size: int, id_col: str, text_col: str, item_col: str, item_text: str, share: float | None = None):
    """(postings by document, windows by anchor).

    With ``share``, every window is anchored at each place of as many of its
    rarest terms as no text with that share of its distinct terms lacks at once.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text"))
    kind = items.schema["item_id"].dataType.simpleString()
    windows = items.mapInArrow(_windows(size), f"item_id {kind}, first int, terms array<long>")
    windows = cut_lineage(windows.select("item_id", "terms").distinct())  # an id may stand for several texts
    terms = windows.select("item_id", "terms", F.posexplode("terms").alias("at", "term"))
    wanted = spark.sparkContext.broadcast(id_filter(terms, "term"))
    counts = plain.select("text").mapInArrow(_counts(wanted), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    if share is None:
        rarest = (
            terms.join(counts, "term")
            .groupBy("item_id", "terms")
            .agg(F.min(F.struct("n", "at", "term")).alias("r"), F.count("*").alias("known"))
            .where("known = size(terms)")
        )
        anchors = rarest.select("item_id", "terms", F.col("r.at").alias("at"), F.col("r.term").alias("term"))
    else:
        ordered = F.sort_array(F.collect_set(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term")))
        rarest = terms.join(counts, "term", "left").groupBy("item_id", "terms").agg(ordered.alias("r"))
        k = F.size("r") - F.ceil(share * F.size("r") - 1e-9).cast("int") + 1
        chosen = rarest.select("item_id", "terms", F.slice(F.col("r.term"), F.lit(1), k).alias("r"), F.posexplode("terms").alias("at", "term"))
        anchors = chosen.where(F.array_contains("r", F.col("term"))).drop("r")
    anchors = cut_lineage(anchors)
    wanted = spark.sparkContext.broadcast(id_filter(anchors, "term"))
    postings = cut_lineage(
        plain.mapInArrow(
            _postings(wanted, size), "doc_id long, text_key long, n_words long, postings array<struct<term:long,pos:int,near:array<long>>>"
        )
    )
    return postings, anchors


def _met(postings: DataFrame, anchors: DataFrame) -> DataFrame:
    rows = postings.select("doc_id", F.explode("postings").alias("p")).select("doc_id", "p.term", "p.pos", "p.near")
    return rows.join(anchors, "term")


def contamination(
    docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, percent: int = 5,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items, contaminated``: one row per document id.

    A document word inside any occurrence of an item's window is hit; an item
    shorter than a window is one window.  ``contaminated``: some word is hit and
    ``100 * n_hit >= percent * n_words``.  ``items`` lists the ids of items with
    occurring windows, sorted as strings; items with a null id count in ``n_hit``
    and as one in ``n_items``, and are in no list.  Null texts have no words.  Rows that
    repeat an id with the same text count once; with different texts their words
    are added and hit places are told apart by place only.  Null ids keep a row.
    """
    postings, anchors = _index(docs, benchmark, size, id_col, text_col, item_col, item_text)
    start = F.col("pos") - F.col("at")
    phrase = F.slice("near", F.lit(size) - F.col("at"), F.size("terms")) == F.col("terms")
    hits = _met(postings, anchors).where(phrase).select(
        "doc_id", F.col("item_id").cast("string").alias("item_id"), F.struct(start.alias("s"), (start + F.size("terms")).alias("e")).alias("span")
    )
    # spans of a document are bounded by its length, items by the benchmark
    found = hits.groupBy("doc_id").agg(F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items"), F.max(F.col("item_id").isNull().cast("int")).alias("unnamed"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")),
        lambda a, x: F.struct(
            (a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["to"]))).alias("n"), F.greatest(a["to"], x["e"]).alias("to")
        ),
        lambda a: a["n"],
    )
    words = postings.select("doc_id", "text_key", "n_words").distinct().groupBy("doc_id").agg(F.sum("n_words").alias("n_words"))
    n_hit = F.coalesce(covered, F.lit(0).cast("long"))
    return (
        words.join(found, "doc_id", "left")
        .select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("unnamed", F.lit(0)).alias("unnamed"))
        .select(
            "doc_id", "n_words", "n_hit", (F.size("items") + F.col("unnamed")).cast("long").alias("n_items"), "items",
            ((F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))).alias("contaminated"),
        )
    )


def proximity_matches(
    docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, share: float = 0.8,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``doc_id, item_id, pos, terms_near, exact``: windows most of whose distinct terms stand within ``size`` words.

    ``pos`` is the place of one of the window's anchors in the document,
    ``terms_near`` the largest share of a window's distinct terms found less than
    ``size`` words from it.  Every stretch of ``size`` words of a document that
    holds ``share`` of a window's distinct terms has such a place.
    """
    postings, anchors = _index(docs, benchmark, size, id_col, text_col, item_col, item_text, share)
    near = F.size(F.array_intersect("near", "terms")) / F.size(F.array_distinct("terms"))
    exact = F.slice("near", F.lit(size) - F.col("at"), F.size("terms")) == F.col("terms")
    met = _met(postings, anchors).select("doc_id", "item_id", "pos", near.alias("terms_near"), exact.alias("exact"))
    met = met.where(F.col("terms_near") >= share - 1e-9)
    return met.groupBy("doc_id", "item_id", "pos").agg(F.max("terms_near").alias("terms_near"), F.max("exact").alias("exact"))


#: DuckDB form of the registered query.
SQL = """
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from benchmark),
bw as (select item_id, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda i: array_to_string(w[i:i + 12], ' '))) k, least(len(w), 13) n
       from b where len(w) > 0),
sizes as (select distinct n from bw),
dw as (select doc_id, n, unnest(range(1, len(w) - n + 2)) i, w from d, sizes where len(w) >= n),
hit as (select dw.doc_id, dw.i, dw.n, bw.item_id from (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') k from dw) dw join bw on dw.k = bw.k and dw.n = bw.n),
n_hit as (select doc_id, count(distinct p) c from (select doc_id, unnest(range(i, i + n)) p from hit) group by 1),
items as (select doc_id, list_sort(list(distinct cast(item_id as varchar))) l from hit group by 1)
select d.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(c, 0) as bigint) n_hit, cast(coalesce(len(l), 0) as bigint) n_items,
       sha256(coalesce(array_to_string(l, ','), '')) items_sha256, coalesce(c, 0) > 0 and 20 * coalesce(c, 0) >= len(w) contaminated
from d left join n_hit using (doc_id) left join items using (doc_id)
"""
