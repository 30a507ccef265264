"""Near-duplicate documents by HyperMinHash registers, banding and exact confirmation.

Every document has REGISTERS buckets.  A bucket holds, for the smallest hash of
the shingle set under the bucket's own permutation, the count of leading zeros
and MANTISSA further bits: 16 bits in place of a full hash.  Compressing never
parts equal minima, so banding the registers loses no candidate; what collides
by chance is taken out of the Jaccard estimate, and exact set intersection
decides.

Recall: with 40 bands of 5 registers a pair at Jaccard 0.8 shares a band with
probability 1 - (1 - 0.8**5)**40 > 0.9999998.

Groups are never expanded into all pairs.  Exactly equal sets collapse first.
Each band key names a centre, the member that meets most others, and every
member is compared with it: one row a member.  Members u and v of one centre c
that this leaves in different classes can only be similar if
``|u & c|`` and ``|v & c|`` are both large enough, or if they share shingles
outside c, at least as many as are missing.  The first are few and known by
their counts; the second meet by an exact prefix join on the shingles outside
the centre.  What meets passes the register estimate before its sets are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from pulsegrid.llm.common import byte_texts, id_filter, mix, passes, shingle_set, signed
from pulsegrid.operators.components import connected_components
from pulsegrid.session import cut_lineage

BANDS, ROWS, MANTISSA = 40, 5, 10
REGISTERS = BANDS * ROWS
_RNG = np.random.Generator(np.random.PCG64(20240101))
_A = (_RNG.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_C = _RNG.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
_SKETCH = "doc_id long, n_shingles long, set_key long, bands array<long>, registers binary"


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest 32-bit permuted hash for every register."""
    base = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    out = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(base), 2048):
        np.minimum(out, (_A[:, None] * base[None, at : at + 2048] + _C[:, None]).min(axis=1), out=out)
    return out


def compress(least: np.ndarray) -> np.ndarray:
    """Leading-zero count (6 bits) and the next MANTISSA bits of 32-bit minima."""
    wide = least.astype(np.uint64)
    length = np.frexp(least.astype(np.float64))[1].astype(np.uint64)
    zeros = np.uint64(32) - length
    rest = (wide << (zeros + np.uint64(1))) & np.uint64(0xFFFFFFFF)
    return ((zeros << np.uint64(MANTISSA)) | (rest >> np.uint64(32 - MANTISSA))).astype(np.uint16)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """(documents, BANDS) keys from (documents, REGISTERS) registers."""
    parts = registers.reshape(len(registers), BANDS, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(40), parts.shape[:2])
        for j in range(ROWS):
            key = mix(key * np.uint64(0xC2B2AE3D27D4EB4F) + parts[:, :, j])
    return key


@lru_cache(4096)
def _chance(n: int, m: int) -> float:
    zeros = np.arange(0, 33)[:, None]
    low = 2.0 ** -(zeros + 1) * (1 + np.arange(1 << MANTISSA)[None, :] / (1 << MANTISSA))
    high = low + 2.0 ** -(zeros + 1 + MANTISSA)
    p, q = ((1 - low) ** k - (1 - high) ** k for k in (n, m))
    return float((p * q).sum())


def chance_collision(n: int, m: int) -> float:
    """How likely registers of disjoint sets of these sizes agree; sizes are taken in steps of 10 %."""
    step = lambda k: int(round(1.1 ** round(np.log(max(k, 1)) / np.log(1.1))))
    return _chance(*sorted((step(n), step(m))))


def estimate(a: np.ndarray, b: np.ndarray, n: int, m: int) -> float:
    """Jaccard from agreeing registers, corrected for chance agreement."""
    c = chance_collision(n, m)
    return (float((a == b).mean()) - c) / (1 - c)


def _set_key(shingles: np.ndarray) -> int:
    return xxh3_64_intdigest(shingles.tobytes()) if len(shingles) else 0


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = byte_texts(part.column(1))
                least = np.full((len(texts), REGISTERS), 0xFFFFFFFF, np.uint32)
                sizes = np.zeros(len(texts), np.int64)
                keys = np.zeros(len(texts), np.uint64)
                with np.errstate(over="ignore"):
                    for i, data in enumerate(texts):
                        s = shingle_set(data, size)
                        sizes[i] = len(s)
                        if len(s):
                            least[i] = minima(s)
                            keys[i] = _set_key(s)
                regs = compress(least)
                bands = signed(band_keys(regs).reshape(-1))
                offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * BANDS)
                yield pa.record_batch(
                    {
                        "doc_id": part.column(0),
                        "n_shingles": pa.array(sizes),
                        "set_key": pa.array(signed(keys)),
                        "bands": pa.ListArray.from_arrays(offsets, pa.array(bands)),
                        "registers": pa.array([r.tobytes() for r in regs], pa.binary()),
                    }
                )

    return run


def _sets(size: int, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = wanted.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            keep = np.flatnonzero(passes(words, ids.astype(np.int64)))
            for at in range(0, len(keep), 512):
                part = batch.take(pa.array(keep[at : at + 512]))
                with np.errstate(over="ignore"):
                    sets = [signed(shingle_set(d, size)) for d in byte_texts(part.column(1))]
                offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
                keys = signed(np.array([_set_key(s) for s in sets], np.uint64))
                listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.record_batch({"node": part.column(0), "set_key": pa.array(keys), "shingles": listed})

    return run


def _plausible(least_estimate: float):
    """Keeps pairs whose corrected estimate reaches the given value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = [
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS)
                for c in ("ra", "rb")
            ]
            same = (regs[0] == regs[1]).mean(axis=1)
            na, nb = (batch.column(c).to_pylist() for c in ("na", "nb"))
            chance = np.array([chance_collision(x, y) for x, y in zip(na, nb)])
            keep = (same - chance) / (1 - chance) >= least_estimate
            yield batch.select(["a", "b", "na", "nb"]).filter(pa.array(keep))

    return run


def unlinked_pairs(rest: DataFrame, percent: int) -> DataFrame:
    """``a, b`` that can be linked among members of one centre that are in different classes.

    ``rest``: node, c, n, inside, outside, class, least_n, main, where ``main``
    is a class of the centre: of two members in different classes one at least is
    not in it, so only those look for partners.  Two members need
    ``need = percent / (100 + percent) * (n + n')`` shingles in common.  At most
    the smaller ``inside`` lie in the centre; the others are shared outside, so
    the pair meets in a prefix of its outside shingles, in any fixed order.
    """
    share = percent / (100 + percent)
    least = F.ceil(share * (F.col("n") + F.col("least_n")) - 1e-6) - F.col("inside")  # outside shingles a partner must share
    size = F.size("outside")
    rest = rest.withColumn("prefix", size - F.greatest(least, F.lit(1)) + 1).withColumn("size", size)
    flat = ["c", "node", "class", "n", "inside", "size"]
    placed = [*flat, "pos"]
    asks = F.col("class") != F.col("main")
    other = lambda df, *on: df.select(*on, *[F.col(x).alias(f"o_{x}") for x in placed if x not in on and x in df.columns])
    need = share * (F.col("n") + F.col("o_n")) - 1e-6
    inside = F.least("inside", "o_inside")
    fits = F.col("class") != F.col("o_class")
    fits &= 100 * F.least("n", "o_n") >= percent * F.greatest("n", "o_n")
    # enough in the centre: both counts suffice, which is rare between classes
    able = rest.where(F.col("inside") >= F.ceil(share * (F.col("n") + F.col("least_n")) - 1e-6)).select(*flat, "main")
    both = able.where(asks).join(other(able, "c"), "c").where(fits & (inside >= need))
    listed = rest.where("prefix > 0").select(*flat, "main", F.posexplode(F.slice(F.sort_array("outside"), 1, F.col("prefix").cast("int"))).alias("pos", "token"))
    met = listed.where(asks).join(other(listed, "c", "token"), ["c", "token"])
    # at the first token that both share, as many as are missing must still be left in either set
    left = F.least(F.col("size") - F.col("pos"), F.col("o_size") - F.col("o_pos"))
    met = met.where(fits & (inside < need) & (inside + left >= need))
    pairs = both.select("node", "o_node").unionByName(met.select("node", "o_node"))
    return pairs.select(F.least("node", "o_node").alias("a"), F.greatest("node", "o_node").alias("b")).distinct()


def confirm(pairs: DataFrame, side: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose estimate is plausible and whose whole sets are similar enough."""
    t = percent / 100
    margin = t - 5 * (t * (1 - t) / REGISTERS) ** 0.5
    a = side.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("registers").alias("ra"))
    b = side.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("registers").alias("rb"))
    likely = pairs.join(a, "a").join(b, "b").mapInArrow(_plausible(margin), "a long, b long, na long, nb long")
    sa = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    sb = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    met = F.size(F.array_intersect("sa", "sb"))
    sure = likely.join(sa, "a").join(sb, "b").where(100 * met >= percent * (F.size("sa") + F.size("sb") - met))
    return cut_lineage(sure.select("a", "b"))


def near_duplicates(
    docs: DataFrame, shingle: int = 2, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Classes of documents linked by ``100 * |A & B| >= percent * |A | B|`` over word-shingle sets.

    Returns ``doc_id, n_shingles, component_id, kept``, one row per input row:
    ``component_id`` is the smallest id reachable over links, ``kept`` marks the
    document of that id.  Null or blank texts have no shingles and link with
    nothing.  Rows that repeat an id and text share its class; an id is taken to
    name one text, and of several texts of one id one stands for it.  A row with a null id is its own class with a null ``component_id``
    and is kept.  Other columns of the input, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = cut_lineage(plain.mapInArrow(_sketches(shingle), _SKETCH))
    full = sketch.where("n_shingles > 0 and doc_id is not null")
    groups = full.groupBy("set_key").agg(F.min("doc_id").alias("node"))
    lone = full.select("set_key", F.col("doc_id").alias("node"), "n_shingles", "bands", "registers")
    # of several texts of an id, the one of the smallest key
    reps = lone.join(groups, ["set_key", "node"], "left_semi").groupBy("node").agg(F.min(F.struct("set_key", "n_shingles", "bands", "registers")).alias("r"))
    reps = cut_lineage(reps.select("node", "r.set_key", F.col("r.n_shingles").alias("n"), "r.bands", "r.registers"))

    keyed = reps.select(F.explode("bands").alias("key"), "node", "set_key", "n")
    shared = keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi")
    keyed = cut_lineage(keyed.join(shared.select("key", "size"), "key"))
    touched = keyed.groupBy("node").agg(F.first("set_key").alias("set_key"), F.first("n").alias("n"), F.sum("size").alias("met"))
    wanted = spark.sparkContext.broadcast(id_filter(touched, "node"))
    # an id may stand in several rows: the set that was chosen is taken
    sets = plain.where("doc_id is not null").mapInArrow(_sets(shingle, wanted), "node long, set_key long, shingles array<long>")
    sets = cut_lineage(sets.join(touched, ["node", "set_key"]).dropDuplicates(["node"]).drop("set_key"))

    # one comparison for each member of a key, with the key's centre
    member = keyed.join(touched.select("node", "met"), "node")
    centre = member.groupBy("key").agg(F.max(F.struct("met", (-F.col("node")).alias("minus"))).alias("c"))
    star = member.join(centre.select("key", (-F.col("c.minus")).alias("c")), "key").where("node <> c").select("node", "c").distinct()
    of_centre = sets.select(F.col("node").alias("c"), F.col("n").alias("c_n"), F.col("shingles").alias("c_set"))
    star = star.join(sets.select("node", "n", "shingles"), "node").join(of_centre, "c")
    outside = F.array_except("shingles", "c_set")
    star = star.select("node", "c", "n", "c_n", outside.alias("outside"), (F.col("n") - F.size(outside)).alias("inside"))
    star = cut_lineage(star)
    met = F.col("inside")
    linked = star.where(100 * met >= percent * (F.col("n") + F.col("c_n") - met)).select(F.col("node").alias("a"), F.col("c").alias("b"))

    def classes_of(links: DataFrame) -> DataFrame:
        part = connected_components(links).withColumnRenamed("component", "joined")
        return cut_lineage(touched.select("node").join(part, "node", "left").select("node", F.coalesce("joined", "node").alias("class")))

    classes = classes_of(linked)
    rest = star.join(classes, "node").join(classes.select(F.col("node").alias("c"), F.col("class").alias("c_class")), "c")
    # classes of a centre first, so that a hot centre is summed up before it meets in one task
    sizes = rest.groupBy("c", "class").agg(F.count("*").alias("size"), F.min("n").alias("least_n"), F.min("c_class").alias("c_class"))
    mixed = sizes.groupBy("c").agg(
        F.min(F.least("class", "c_class")).alias("lo"), F.max(F.greatest("class", "c_class")).alias("hi"), F.min("least_n").alias("least_n"),
        F.max_by("class", F.struct("size", "class")).alias("main"),
    )
    rest = cut_lineage(rest.join(mixed.where("lo < hi").select("c", "least_n", "main"), "c"))
    more = confirm(unlinked_pairs(rest, percent), reps, sets, percent)
    if not more.isEmpty():
        classes = classes_of(linked.unionByName(more))
    at = F.when(F.col("n_shingles") > 0, F.coalesce("class", "node")).otherwise(F.col("doc_id"))
    return (
        sketch.select("doc_id", "n_shingles", "set_key")
        .join(groups.join(classes, "node", "left"), "set_key", "left")
        .select("doc_id", "n_shingles", at.alias("component_id"))
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


#: DuckDB form of the registered query: all pairs by their common shingles, and what each document reaches.
SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select doc_id, unnest(list_distinct(case when len(w) < 2 then w else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end)) sh from d),
n as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id a, b.doc_id b, count(*) m from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * m >= 80 * (x.n + y.n - m)),
g as (select a, b from e union all select b, a from e),
r(node, c) as (select doc_id, doc_id from d union select g.b, r.c from r join g on r.node = g.a)
select doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, component_id, doc_id = component_id as kept
from d left join n using (doc_id) join (select node as doc_id, min(c) as component_id from r group by 1) using (doc_id)
"""
