"""How far the sources of a language diverge, from term counts kept in mergeable radix tries.

A task counts its documents' terms in one byte trie a language, whose leaves
count by source.  Tries are cut into the subtrees of prefixes, dealt by language
and prefix, and merged range by range; the merged leaves that enough documents
hold are traversed in UTF-8 order, for the distances of all pairs of sources and
for the terms a source uses more than its language does.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import byte_texts
from pulsegrid.session import cut_lineage

#: Documents of a language that must hold a term, and terms reported for a source.
LEAST_DOCUMENTS, TOP = 30, 50
#: Added to every count, and what shares are told in.
SMOOTHING, SCALE = 5, 1_000_000_000
#: Counters a task holds before it hands its tries on; bytes of a prefix range; rows of a batch.
HELD, PREFIX, ROWS = 400_000, 3, 10_000
#: Terms traversed as one group, terms of one block, and sources compared with all others in one group.
SLICE, BLOCK, SOURCES = 4096, 512, 256
#: Bytes of terms stay, A-Z in lower case; all others part terms.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_RANGES = (
    "lang string, prefix binary, shared array<int>, labels array<binary>, documents array<long>, widths array<int>, sources array<string>, counts array<long>"
)
_KEPT = "lang string, term binary, documents long, sources array<string>, counts array<long>"
#: Bytes that keys are compared over; what they share beyond is stored again.
_COMPARED = 64


@dataclass(frozen=True)
class RadixTrie:
    """Byte strings with a count of documents and counts by source at their leaves, laid out in the order of its keys.

    A leaf's edge holds the bytes behind the ``shared`` ones, which are those of
    the path to the leaf before.  Source counts of leaf ``i`` stand at
    ``ends[i]:ends[i + 1]``.
    """

    shared: np.ndarray
    labels: list[bytes]
    documents: np.ndarray
    ends: np.ndarray
    names: list[str]
    source: np.ndarray
    counts: np.ndarray

    @staticmethod
    def of(documents: dict[bytes, int], by_source: dict[str, dict[bytes, int]]) -> RadixTrie:
        keys = sorted(documents)
        place = dict(zip(keys, range(len(keys)), strict=True))
        at = [np.fromiter(map(place.__getitem__, held), np.int64, len(held)) for held in by_source.values()]
        leaf = np.concatenate([np.empty(0, np.int64), *at])
        source = np.repeat(np.arange(len(by_source)), [len(x) for x in at])
        counts = np.concatenate([np.empty(0, np.int64), *[np.fromiter(held.values(), np.int64, len(held)) for held in by_source.values()]])
        order = np.argsort(leaf, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(leaf, minlength=len(keys)))]).astype(np.int64)
        shared = np.zeros(len(keys), np.int32)
        if len(keys) > 1:
            raw = np.array(keys, dtype=f"S{_COMPARED}").view(np.uint8).reshape(len(keys), _COMPARED)
            differs = (raw[1:] != raw[:-1]) | (raw[1:] == 0)  # keys hold no zero bytes
            shared[1:] = np.where(differs.any(1), differs.argmax(1), _COMPARED)
        labels = [k[n:] for k, n in zip(keys, shared.tolist(), strict=True)]
        return RadixTrie(shared, labels, np.fromiter(map(documents.__getitem__, keys), np.int64, len(keys)), ends, list(by_source), source[order], counts[order])

    def walk(self) -> Iterator[tuple[bytes, int, dict[str, int]]]:
        """Keys in the order of their bytes, which is that of UTF-8, with their leaves."""
        key, ends = b"", self.ends.tolist()
        sources, counts = [self.names[i] for i in self.source], self.counts.tolist()
        for i, (n, label, documents) in enumerate(zip(self.shared.tolist(), self.labels, self.documents.tolist(), strict=True)):
            key = key[:n] + label
            yield key, documents, dict(zip(sources[ends[i] : ends[i + 1]], counts[ends[i] : ends[i + 1]], strict=True))

    def ranges(self, lang: str) -> pa.RecordBatch:
        """A row for every subtree below a prefix of PREFIX bytes: a trie of its own."""
        first = np.flatnonzero(self.shared < PREFIX)
        cuts = np.append(first, len(self.labels)).astype(np.int32)
        shared, labels = self.shared.copy(), list(self.labels)
        key = b""
        for i in first.tolist():
            key = key[: shared[i]] + labels[i]  # shares less than a prefix with what is before, and so with the last first key
            labels[i], shared[i] = key, 0
        cut = lambda values, at=cuts: pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)
        names = pa.DictionaryArray.from_arrays(pa.array(self.source, pa.int32()), pa.array(self.names, pa.string())).cast(pa.string())
        held = self.ends[cuts]
        columns = [
            pa.array([lang] * len(first), pa.string()), pa.array([labels[i][:PREFIX] for i in first.tolist()], pa.binary()), cut(pa.array(shared, pa.int32())), cut(pa.array(labels, pa.binary())),
            cut(pa.array(self.documents, pa.int64())), cut(pa.array(np.diff(self.ends), pa.int32())), cut(names, held), cut(pa.array(self.counts, pa.int64()), held),
        ]
        return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _RANGES.split(", ")])


class Merging:
    """Subtrees of one prefix range as they come, added up leaf by leaf."""

    def __init__(self) -> None:
        self.leaves: dict[bytes, list] = {}

    def add(self, shared: list[int], labels: list[bytes], documents: list[int], widths: list[int], sources: list[str], counts: list[int]) -> None:
        key, at, leaves = b"", 0, self.leaves
        for n, label, d, width in zip(shared, labels, documents, widths, strict=True):
            key = key[:n] + label
            leaf = leaves.get(key)
            if leaf is None:
                leaves[key] = [d, dict(zip(sources[at : at + width], counts[at : at + width], strict=True))]
            else:
                leaf[0] += d
                held = leaf[1]
                for i in range(at, at + width):
                    held[sources[i]] = held.get(sources[i], 0) + counts[i]
            at += width

    def walk(self, least: int) -> Iterator[tuple[bytes, list]]:
        for key in sorted(k for k, leaf in self.leaves.items() if leaf[0] >= least):
            yield key, self.leaves[key]


def terms_of(data: bytes | None) -> list[bytes]:
    return data.translate(_TERM).split() if data else []


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's tries cut by prefix; they are handed on whenever HELD counters are there."""
    counts: defaultdict[str, defaultdict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))
    documents: defaultdict[str, Counter] = defaultdict(Counter)

    def told() -> Iterator[pa.RecordBatch]:
        for lang in list(documents):
            whole = RadixTrie.of(documents.pop(lang), counts.pop(lang)).ranges(lang)
            for at in range(0, whole.num_rows, ROWS):
                yield whole.slice(at, ROWS)

    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang, source, data in zip(langs, sources, byte_texts(batch.column(2)), strict=True):
            words = terms_of(data)
            if words:
                counts[lang][source].update(words)
                documents[lang].update(set(words))
        if sum(len(c) for by_source in counts.values() for c in by_source.values()) > HELD:
            yield from told()
    yield from told()


def _lists(column: pa.ListArray) -> Iterator[list]:
    """The lists of a column, all values of which are read at once."""
    values, ends = column.flatten(), np.cumsum(column.value_lengths().to_numpy()).tolist()
    if pa.types.is_integer(values.type):
        plain = values.to_numpy().tolist()
    elif pa.types.is_string(values.type):  # few different ones
        coded = values.dictionary_encode()
        names = coded.dictionary.to_pylist()
        plain = [names[i] for i in coded.indices.to_numpy().tolist()]
    else:
        plain = values.to_pylist()
    return (plain[a:b] for a, b in zip([0, *ends], ends, strict=False))


def _merge(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Ranges of many tries, in the order of language and prefix, as those of one; only what ``least`` documents hold is handed on."""
    kinds = [pa.string(), pa.binary(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())]

    def kept() -> Iterator[tuple]:
        now, held = None, Merging()
        for batch in batches:
            for lang, prefix, *subtree in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *map(_lists, batch.columns[2:]), strict=True):
                if (lang, prefix) != now:
                    yield from ((now[0], term, d, list(of), list(of.values())) for term, (d, of) in held.walk(least))
                    now, held = (lang, prefix), Merging()
                held.add(*subtree)
        yield from ((now[0], term, d, list(of), list(of.values())) for term, (d, of) in held.walk(least))

    rows = kept()
    while some := list(islice(rows, ROWS)):
        columns = [pa.array(list(c), k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _KEPT.split(", ")])


def kept_terms(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """``lang, term, documents, sources, counts`` of the terms that ``least`` documents of a language hold."""
    counted = docs.select("lang", "source", "text").mapInArrow(_count, _RANGES)
    dealt = counted.repartition("lang", "prefix").sortWithinPartitions("lang", "prefix")
    return dealt.mapInArrow(lambda batches: _merge(batches, least), _KEPT)


def shares(counts: np.ndarray, total: np.ndarray | int, vocabulary: int) -> np.ndarray:
    """``1 + floor(SCALE * (count + SMOOTHING) / (total + SMOOTHING * vocabulary))``, divided in two steps so that 64 bits hold counts up to 2.8e14."""
    a = 31250
    b = SCALE // a
    top, bottom = counts + SMOOTHING, total + SMOOTHING * vocabulary
    whole, rest = np.divmod(top * a, bottom)
    return 1 + whole * b + rest * b // bottom


def _traverse(leaves: pd.DataFrame, stats: pd.DataFrame, top: int) -> pd.DataFrame:
    """Sums of one slice of a language's terms: rows ``lang, source, part, item, value``.

    ``stats`` are the language's sources in order with their totals; those of the
    group's block are compared with all others.  Terms come in UTF-8 order, so of
    equal values the earlier term stays ahead.
    """
    stats = stats.sort_values("place", kind="stable")
    sources, totals = list(stats["source"]), stats["total"].to_numpy(np.int64)
    own, first, vocabulary = np.flatnonzero(stats["own"].to_numpy(bool)), bool(stats["own"].iloc[0]), int(stats["vocabulary"].iloc[0])
    place = {s: i for i, s in enumerate(sources)}
    leaves = leaves.sort_values("term", kind="stable")
    apart = np.zeros((len(own), len(sources)), np.int64)
    ahead: list[list[tuple[int, bytes]]] = [[] for _ in own]
    for start in range(0, len(leaves), BLOCK):
        block = leaves.iloc[start : start + BLOCK]
        terms = list(block["term"])
        counts = np.zeros((len(block), len(sources)), np.int64)
        for i, (names, each) in enumerate(zip(block["sources"], block["counts"], strict=True)):
            counts[i, [place[s] for s in names]] = each
        p = shares(counts, totals, vocabulary)
        q = shares(counts.sum(1), int(totals.sum()), vocabulary)
        for k, j in enumerate(own):
            apart[k] += np.abs(p - p[:, j : j + 1]).sum(0)
            more = np.where(counts[:, j] > 0, p[:, j] - q, 0)
            best = np.argsort(-more, kind="stable")[:top]
            ahead[k] = sorted(ahead[k] + [(int(-more[i]), terms[i]) for i in best if more[i] > 0])[:top]
    lang, rows = stats["lang"].iloc[0], []
    for k, j in enumerate(own):
        rows += [(lang, sources[j], "pair", s, int(apart[k, i])) for i, s in enumerate(sources) if i != j]
        rows += [(lang, sources[j], "term", t.decode(), -v) for v, t in ahead[k]]
    return pd.DataFrame(rows, columns=["lang", "source", "part", "item", "value"])


def source_divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every source of every language.

    Part ``pair``: each other source of the language and the sum over its kept
    terms of the difference of shares (0 if no term is kept).  Part ``term``: the
    ``top`` terms whose share in the source is above the language's.  Null lang,
    source and text are empty ones; every row is a document of its own, so repeated
    rows count again; other columns are ignored; no rows: no result.

    Terms are traversed in slices, and sources in blocks, so no task holds a
    language: what it holds is SLICE terms, and SOURCES times all sources.
    """
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = cut_lineage(kept_terms(texts, least))
    found = kept.select("lang", F.inline(F.arrays_zip("sources", "counts"))).groupBy("lang", F.col("sources").alias("source")).agg(F.sum("counts").alias("total"))
    groups = texts.groupBy("lang", "source").agg(F.lit(1).alias("there")).join(found, ["lang", "source"], "left")
    order = Window.partitionBy("lang").orderBy("source")
    numbered = cut_lineage(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), (F.row_number().over(order) - 1).alias("place")))
    sizes = numbered.groupBy("lang").agg(F.max("place").alias("last")).join(kept.groupBy("lang").agg(F.count("*").alias("vocabulary")), "lang", "left")
    sizes = sizes.select(
        "lang", F.coalesce("vocabulary", F.lit(0)).alias("vocabulary"), (F.floor(F.coalesce("vocabulary", F.lit(0)) / SLICE) + 1).alias("slices"), (F.floor(F.col("last") / SOURCES) + 1).alias("blocks")
    )
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    left = kept.join(sizes, "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("slices")).alias("slice"), each(F.col("blocks")).alias("block"), "term", "sources", "counts")
    right = numbered.join(sizes, "lang").select("*", each(F.col("slices")).alias("slice")).select("*", each(F.col("blocks")).alias("block"))
    right = right.select("lang", "slice", "block", "source", "total", "place", "vocabulary", (F.floor(F.col("place") / SOURCES) == F.col("block")).alias("own"))
    key = ["lang", "slice", "block"]
    sums = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(lambda a, b: _traverse(a, b, top), "lang string, source string, part string, item string, value long")
    whole = sums.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return whole.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top))


SQL = f"""
with d as (select row_number() over () as i, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
t as (select i, lang, source, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from d),
kept as (select lang, term from t group by all having count(distinct i) >= {LEAST_DOCUMENTS}),
counts as (select lang, source, term, count(*) as n from t join kept using (lang, term) group by all),
v as (select lang, count(*) as v from kept group by lang),
g as (select lang, source, coalesce(sum(n), 0) as total from (select distinct lang, source from d) left join counts using (lang, source) group by all),
l as (select lang, sum(total) as total from g group by lang),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + ({SCALE}::hugeint * (coalesce(c.n, 0) + {SMOOTHING})) // (g.total + {SMOOTHING} * v.v) as p
      from g join kept k on k.lang = g.lang join v on v.lang = g.lang left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
q as (select c.lang, c.term, 1 + ({SCALE}::hugeint * (sum(c.n) + {SMOOTHING})) // (any_value(l.total) + {SMOOTHING} * any_value(v.v)) as q from counts c join l on l.lang = c.lang join v on v.lang = c.lang group by all),
r as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce((select sum(abs(x.p - y.p)) from p x join p y on x.term = y.term where x.lang = a.lang and y.lang = a.lang and x.source = a.source and y.source = b.source), 0) as value
        from g a join g b on a.lang = b.lang and a.source <> b.source
      union all select p.lang, p.source, 'term', p.term, p.p - q.q from p join q on q.lang = p.lang and q.term = p.term where p.n > 0 and p.p > q.q),
s as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from r)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank from s where part = 'pair' or rank <= {TOP}
"""
