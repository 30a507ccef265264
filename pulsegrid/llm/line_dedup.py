"""Line dedup by an exact set-similarity join, in column expressions alone.

A line is removed where an earlier line (by document id, then place) has the
same text, or a token set at Jaccard THRESHOLD or more.  Every line with a word
is judged; only lines of white space are left alone.

Equal texts collapse into classes first, combined before the shuffle, so a very
common line is one row.  Tokens are ordered by rarity: how often the slot of a
token's hash is used in the whole corpus, then the hash.  Sets that similar share
a token among the first n - ceil(t * n) + 1, so classes meet on these alone.  The
first token that both share leaves enough tokens after it in either set, which
the places tell; sizes and 64 or 128 marks of the tokens bound the overlap as well,
and only what passes all of them has its sets read.

Groups of near copies are not expanded into pairs: similar sets mostly share the
least and the largest hash of their rarer halves, and a first pass compares each
class with the earliest that shares such an extreme with it.  Only classes that
this does not remove look for further earlier ones.

Tables of fixed size, of rarities and filters, are scalar subqueries, as literals
would stand in every plan that the driver holds or logs.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.session import cut_lineage, discard, release

THRESHOLD = 0.8
LEAST_WORDS = 1
#: Tokens above which a set has 128 marks, as 64 tell longer sets less and less apart.
WIDE = 80
#: Parts in which the sets of candidate pairs are met.
SLICES = 1
#: Slots of the frequency table, the top bits of a token's hash: 256 KB whatever the input.
SLOT_BITS = 18
#: Longs of the class filter: 128 KB whatever the input.
FILTER_WORDS = 1 << 14
#: Mark of a class that is gone, above the places of its tokens.
_GONE = 1 << 31
#: Low bits of a class's number, from the hash of its text; above them is its place in the order, in steps of 2 ** -20.
_HASH_BITS = 36
_SPACES = " \t\n\x0b\x0c\r"


def _words(text: Column) -> Column:
    """Lower-cased words of a text, with empty ones between white space."""
    spaced = F.when(text.rlike(r"[\t\n\r\x0b\x0c]"), F.translate(text, "\t\n\r\x0b\x0c", "     ")).otherwise(text)
    return F.split(F.lower(spaced), " ", -1)


def _slot(token: Column) -> Column:
    return F.shiftrightunsigned(token, 64 - SLOT_BITS).cast("int")


def _at() -> Column:
    """The place of a line in the order of all lines."""
    return (F.col("doc_id").cast("decimal(38,0)") * F.lit(1 << 31) + F.col("line_no")).cast("decimal(38,0)")


def _lines(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, line_no, line, key`` of the lines that are judged; ``at`` orders them."""
    split = docs.select("doc_id", "text_key", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return split.where(F.btrim("line", F.lit(_SPACES)) != "").select(
        "doc_id", "text_key", "line_no", "line", _at().alias("at"), F.xxhash64("line").alias("key")
    )


def _table(values: DataFrame, size: int, empty: int, kind: str) -> Column:
    """An array of ``size`` numbers, ``value`` of each row at its ``at`` and ``empty`` elsewhere, as a scalar subquery."""
    rest = values.sparkSession.range(size).select(F.col("id").cast("int").alias("at"), F.lit(empty).cast("long").alias("value"))
    every = values.select("at", F.col("value").cast("long").alias("value")).unionByName(rest).groupBy("at").agg(F.bit_or("value").alias("value"))
    listed = F.array_sort(F.collect_list(F.struct("at", "value")))
    return _kept(every.agg(F.transform(listed, lambda x: x["value"].cast(kind)).alias("values"))).scalar()


def _rarity(docs: DataFrame) -> Column:
    """For every slot the logarithm of its use in all texts, in quarters, from 1 on, as an array of fixed size.

    It only orders tokens, so letter case and rare white space need not be told apart here.
    """
    words = docs.select(F.explode(F.split("text", " ", -1)).alias("w")).where("w <> ''")
    used = words.groupBy(_slot(F.xxhash64("w")).alias("at")).count()
    level = F.least(F.lit(126), F.floor(4 * F.log2(F.col("count") + 1)) + 1)
    return _table(used.select("at", level.alias("value")), 1 << SLOT_BITS, 0, "tinyint")


def _ordered(lines: DataFrame, rarity: Column) -> DataFrame:
    """Adds ``tokens``: the distinct tokens, rarest first, as longs of rarity and hash."""
    hashed = F.array_distinct(F.transform(F.array_remove(_words(F.col("line")), ""), lambda w: F.xxhash64(w)))
    packed = lambda t, levels: F.shiftleft(F.get(levels, _slot(t)).cast("long"), 56).bitwiseOR(t.bitwiseAND(F.lit((1 << 56) - 1)))
    # a subquery may not stand in a higher-order function; named once, the array of references is never made a row's own
    lines = lines.withColumn("hashed", hashed).withColumn("levels", F.array_repeat(rarity, F.size("hashed")))
    return lines.withColumn("tokens", F.sort_array(F.zip_with("hashed", "levels", packed))).drop("hashed", "levels")


def _marks(tokens: Column) -> Column:
    """64 bits, one of which each token turns over, so that more bits than sets differ in tokens never differ."""
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), t.bitwiseAND(F.lit(63)).cast("int"))))


def _wide(tokens: Column) -> Column:
    """The marks of every other token, those without bit 6, of a set of over WIDE tokens, else 0; with the marks of all these are 128."""
    return F.when(F.size(tokens) > WIDE, _marks(F.filter(tokens, lambda t: t.bitwiseAND(F.lit(64)) == 0))).otherwise(F.lit(0).cast("long"))


def _filter(keys: DataFrame) -> Column:
    """A bit for each long in ``key``, for a test before an exact join; full at many keys, and still right."""
    slot = F.pmod(F.xxhash64("key"), F.lit(FILTER_WORDS * 64))
    bits = keys.select(F.shiftright(slot, 6).cast("int").alias("at"), slot.bitwiseAND(F.lit(63)).cast("int").alias("bit")).groupBy("at").agg(
        F.bit_or(F.expr("shiftleft(1L, bit)")).alias("value")
    )
    return _table(bits, FILTER_WORDS, 0, "long")


def _passes(key: str, known: Column) -> Column:
    slot = F.pmod(F.xxhash64(key), F.lit(FILTER_WORDS * 64))
    return F.call_function("getbit", F.get(known, F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(F.lit(63)).cast("int")) == 1


def _kept(df: DataFrame) -> DataFrame:
    """A checkpoint, beside which nothing that was shuffled for it stays on disk."""
    return cut_lineage(df, drop_shuffles=True)


def _similar(pairs: DataFrame, docs: DataFrame, rarity: Column, classes: DataFrame, threshold: float) -> DataFrame:
    """``key`` of the later class of each pair of class numbers ``id, other`` whose sets are similar enough; ``pairs`` is a checkpoint, and goes."""
    named = pairs.select("id").unionByName(pairs.select(F.col("other").alias("id"))).distinct()
    named = _kept(classes.select("id", "key", "first_at").join(named, "id", "left_semi"))
    # only documents that a class stands in first are split
    there = docs.where(_passes("doc_id", _filter(named.select(F.floor(F.col("first_at") / F.lit(1 << 31)).cast("long").alias("key")))))
    once = _lines(there).select("key", "line").where(_passes("key", _filter(named))).dropDuplicates(["key"])
    sets = _kept(_ordered(once.join(named, "key"), rarity).select("id", "key", "tokens", "first_at"))
    discard(named)
    other = sets.select(*[F.col(c).alias(f"other_{c}") for c in sets.columns])
    met = F.size(F.array_intersect("tokens", "other_tokens"))
    enough = met >= threshold * (F.size("tokens") + F.size("other_tokens") - met) - 1e-9
    later = F.when(F.col("first_at") > F.col("other_first_at"), F.col("key")).otherwise(F.col("other_key"))
    # sets are dealt to pairs by and by, so that only a part of them lies on disk once more
    slices = []
    for n in range(SLICES):
        part = [df.where(F.pmod(F.xxhash64("id"), F.lit(SLICES)) == n) for df in (pairs, sets)]
        found = part[0].join(part[1], "id").join(other, F.col("other") == F.col("other_id")).where(enough).select(later.alias("key"))
        slices.append(_kept(found.distinct()))
    found = _kept(functools.reduce(DataFrame.unionByName, slices).distinct())
    discard(pairs, sets, *slices)
    return found


def _listed(classes: DataFrame) -> DataFrame:
    """A row for each prefix token of a class; ``packed`` holds the set's size, whether the class is gone, and the token's place."""
    packed = F.shiftleft(F.col("n").cast("long"), 32) + F.when(F.col("gone"), F.lit(_GONE)).otherwise(F.lit(0)) + F.col("pos")
    spread = classes.select("*", F.posexplode("prefix").alias("pos", "token")).select("token", "id", "marks", "wide", packed.alias("packed"))
    # told here, these need not be inferred for one side of a join alone
    return spread.where(" and ".join(f"{c} is not null" for c in spread.columns))


def _extremes(tokens: str) -> Column:
    """The least and the largest hash of the rarer half of the tokens: similar sets mostly share one."""
    half = F.transform(F.slice(tokens, 1, F.ceil(F.size(tokens) / 2).cast("int")), lambda t: F.shiftleft(t, 8))
    return F.struct(F.array_min(half).alias("least"), F.array_max(half).alias("largest"))


def _possible(threshold: float) -> Column:
    """Whether sizes, places and marks of ``a`` and ``b`` leave them similar, where the token is the first that both share."""
    n, m = (F.shiftright(f"{x}.packed", 32) for x in "ab")
    at, other_at = (F.col(f"{x}.packed").bitwiseAND(F.lit(_GONE - 1)) for x in "ab")
    sizes = F.least(n, m) >= threshold * F.greatest(n, m) - 1e-9
    overlap = threshold / (1 + threshold) * (n + m) - 1e-9  # of similar sets of these sizes
    # marks differ by tokens of one side alone, of which there may be few
    may_differ = (1 - threshold) / (1 + threshold) * (n + m) + 1e-9
    all_, some = (F.col(f"a.{x}").bitwiseXOR(F.col(f"b.{x}")) for x in ("marks", "wide"))
    apart = F.bit_count(all_) <= may_differ
    wide = (F.least(n, m) <= WIDE) | (F.bit_count(some) + F.bit_count(all_.bitwiseXOR(some)) <= may_differ)
    return sizes & (F.least(n - at, m - other_at) >= overlap) & apart & wide


def _stays(side: str) -> Column:
    return F.col(f"{side}.packed").bitwiseAND(F.lit(_GONE)) == 0


def _judged(docs: DataFrame, threshold: float) -> DataFrame:
    """``key, first_at, gone`` of the classes of equal lines that lose a line: ``gone`` where an earlier class is similar, else null."""
    lines, rarity = _lines(docs), _rarity(docs)
    n = F.size("tokens")
    prefix = F.slice("tokens", 1, n - F.ceil(threshold * n - 1e-9).cast("int") + 1)
    found = _ordered(lines.select("key", "at", "line"), rarity)
    told = {"n": n, "marks": _marks(F.col("tokens")), "wide": _wide(F.col("tokens")), "prefix": prefix, "ends": _extremes("tokens")}
    found = found.select("key", "at", *[c.alias(name) for name, c in told.items()])
    found = found.groupBy("key").agg(F.min("at").alias("first_at"), (F.count("*") > 1).alias("again"), *[F.first(c).alias(c) for c in told])
    # the order as far as its bits go, never against it; what shares a number is told apart by its key
    step = F.floor(F.log2(F.greatest(F.col("first_at").cast("double"), F.lit(0.0)) + 2) * (1 << 20)).cast("long")
    number = F.shiftleft(step, _HASH_BITS) + F.col("key").bitwiseAND(F.lit((1 << _HASH_BITS) - 1))
    classes = _kept(found.withColumn("id", number))
    # the earliest of the classes that share an extreme
    row = F.struct("id", "marks", "wide", F.shiftleft(F.col("n").cast("long"), 32).alias("packed"))
    ends = classes.select(F.posexplode(F.array("ends.least", "ends.largest")).alias("which", "end"), row.alias("b"))
    near = ends.withColumn("a", F.first("b").over(Window.partitionBy("which", "end").orderBy("b.id")))
    met = near.where((F.col("a.id") < F.col("b.id")) & _possible(threshold))
    gone = _similar(_kept(met.select(F.col("a.id").alias("id"), F.col("b.id").alias("other")).distinct()), docs, rarity, classes, threshold)
    # what is not yet gone looks through all its lists for earlier ones
    listed = _listed(classes.join(gone.withColumn("gone", F.lit(True)), "key", "left"))
    tied = F.shiftright("a.id", _HASH_BITS) == F.shiftright("b.id", _HASH_BITS)
    open_ = (F.col("a.id") < F.col("b.id")) & (_stays("b") | (tied & _stays("a")))
    met = listed.alias("a").join(listed.alias("b"), F.col("a.token") == F.col("b.token")).where(open_ & _possible(threshold))
    pairs = _kept(met.select(F.col("a.id").alias("id"), F.col("b.id").alias("other")).distinct())
    slim = _kept(classes.select("id", "key", "first_at", "again"))
    discard(classes)
    late = _similar(pairs, docs, rarity, slim, threshold)
    all_gone = gone.unionByName(late).distinct().withColumn("gone", F.lit(True))
    judged = _kept(slim.select("key", "first_at", "again").join(all_gone, "key", "left").where("gone or again").drop("again"))
    discard(slim, gone, late)
    return judged


def _removed(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """``doc_id, text_key, line_no`` of every line to remove; ``docs``: doc_id, text_key, text."""
    lines = _lines(docs).select("doc_id", "text_key", "line_no", "key").where(_passes("key", _filter(judged)))
    placed = lines.join(judged, "key")
    return placed.where(F.col("gone") | (_at() > F.col("first_at"))).select("doc_id", "text_key", "line_no")


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input columns with ``text`` without its removed lines, in ``row``, beside ``doc_id, n_lines, n_removed``.

    One row per input row.  A null text stays null with no lines.  Null ids are
    not judged and stay whole.  Rows that repeat an id and text are one document
    and stay alike; rows that repeat an id with other texts are ordered by place
    alone.  Lines keep their order and are joined by a line feed.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), row.alias("row"))
    text = F.col("row").getField(text_col)
    texts = keyed.where("doc_id is not null").select("doc_id", "text_key", text.alias("text")).where("text is not null")
    judged = _judged(texts, threshold)
    release(docs.sparkSession)
    # a document's line numbers are bounded by its length; kept, so that nothing but them is there when the texts are dealt
    gone = _kept(_removed(texts, judged).groupBy("doc_id", "text_key").agg(F.collect_set("line_no").alias("gone")))
    discard(judged)
    release(docs.sparkSession)
    joined = keyed.join(gone, ["doc_id", "text_key"], "left")
    all_lines = F.split(text, "\n", -1)
    kept = F.when(F.col("gone").isNull(), text).otherwise(
        F.array_join(F.filter(all_lines, lambda x, i: ~F.array_contains("gone", i)), "\n")
    )
    return joined.select(
        "doc_id", F.coalesce(F.size(all_lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.col("row").withField(f"`{text_col}`", kept).alias("row"),
    )


#: DuckDB form of the registered query, with an order of tokens of its own.
SQL = r"""
with l as (select doc_id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents where text is not null),
judged as (select * from l where regexp_matches(line, '[^\x20\x09-\x0D]')),
u as (select line, min((doc_id, line_no)) as first_at, list_distinct(regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+')) as w from judged group by line),
t as (select line, first_at, len(w) as n, unnest(w) as token from u),
f as (select token, count(*) as c from t group by 1),
o as (select line, first_at, n, token, row_number() over (partition by line order by c, token) as pos from t join f using (token)),
p as (select * from o where pos <= n - ceil(0.8 * n - 1e-9) + 1),
pairs as (select distinct a.line as x, b.line as y from p a join p b on a.token = b.token and a.first_at < b.first_at and least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) - 1e-9),
gone as (select distinct y as line from pairs join u a on a.line = x join u b on b.line = y
         where len(list_intersect(a.w, b.w)) >= 0.8 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) - 1e-9),
marked as (select doc_id, line_no, l.line, coalesce(u.line is not null and ((doc_id, line_no) > first_at or g.line is not null), false) as out from l left join u on u.line = l.line left join gone g on g.line = l.line),
done as (select doc_id, count(*) as n_lines, count_if(out) as n_removed, coalesce(string_agg(line, chr(10) order by line_no) filter (where not out), '') as kept from marked group by 1)
select doc_id, cast(coalesce(n_lines, 0) as bigint) as n_lines, cast(coalesce(n_removed, 0) as bigint) as n_removed, case when n_removed > 0 then kept else text end as text from documents left join done using (doc_id)
"""
