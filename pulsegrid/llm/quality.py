"""Quality rules from column expressions alone: repetition counts and distribution divergence.

The divergence compares a document's histograms of character classes and of
its language's common words with the fixed reference of that language by
Jensen-Shannon distance (base 2, 0 to 1).  A language without one is compared in
classes alone, with a reference pooled from the input in which every source weighs
the same.  Short documents are not judged by either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import ascii_lower
from pulsegrid.session import cut_lineage

#: Frequent function words by language code.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "with"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "ist", "ein", "für"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un"),
}
#: Character classes, as regex classes; what fits none is the last bin.
CLASSES = (r"\p{Ll}", r"\p{Lu}", r"\p{Nd}", r"[.,;:!?'\"()\-]", r"[#*$%&|<>]", r"[\x20\x09-\x0D]")
#: A document of fewer words is not judged by its histograms.
LEAST_WORDS = 40
#: Shares of the classes, and of the common words with all others last, by language: means over the documents of
#: sf0.1 with an even id that are labelled quality 1, have LEAST_WORDS words and pass the base rules.
REFERENCES = {
    "en": (
        (0.79377, 0.01457, 0.00095, 0.02437, 0.0, 0.16632, 3e-05),
        (0.0553, 0.0285, 0.0238, 0.017, 0.0116, 0.0135, 0.0109, 0.0091, 0.0078, 0.0083, 0.007, 0.0056, 0.8017),
    ),
    "de": (
        (0.8094, 0.01316, 0.00075, 0.02209, 0.0, 0.15457, 3e-05),
        (0.0546, 0.0282, 0.0225, 0.0171, 0.0145, 0.0111, 0.0101, 0.0093, 0.0077, 0.0051, 0.0048, 0.0056, 0.8094),
    ),
    "fr": (
        (0.79285, 0.01464, 0.00185, 0.02468, 0.0, 0.16588, 0.0001),
        (0.0543, 0.0296, 0.0212, 0.0158, 0.0136, 0.0122, 0.0117, 0.0095, 0.0085, 0.0066, 0.0066, 0.0065, 0.8039),
    ),
    "es": (
        (0.799, 0.01446, 0.0012, 0.02402, 0.0, 0.16131, 2e-05),
        (0.0539, 0.0279, 0.0232, 0.0164, 0.0139, 0.0114, 0.0, 0.0106, 0.0084, 0.0074, 0.0091, 0.0068, 0.8111),
    ),
}
#: Distances beyond which a document is rejected.  A text without common words is at 0.318 to 0.328; of the documents
#: of REFERENCES none is beyond 0.284 in words, and none beyond 0.231 in classes.
CLASS_DISTANCE, WORD_DISTANCE = 0.30, 0.285
WINDOW = 8


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """How many words lie in WINDOW-word windows that occur twice or more.

    Windows are compared by a 64-bit hash of their words' hashes.
    """
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))

    def covered(w: Column) -> Column:
        def places(s: Column) -> Column:
            same = lambda x, i: F.coalesce((F.get(s, i - 1)["h"] == x["h"]), F.lit(False)) | F.coalesce((F.get(s, i + 1)["h"] == x["h"]), F.lit(False))
            return F.array_sort(F.transform(F.filter(s, same), lambda x: x["i"]))

        ordered = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        total = lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda a, x: a + x
        )
        return _let(_let(ordered, places), total)

    judged = lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w))
    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(_let(_let(hashed, windows), judged)).cast("long")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two count arrays; null where one is empty."""
    plain = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    share = lambda x: _let(x, lambda a: F.transform(a, lambda v: F.try_divide(v.cast("double"), plain(F.transform(a, lambda u: u.cast("double"))))))
    term = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
    point = lambda a, b: (term(a, (a + b) / 2) + term(b, (a + b) / 2)) / 2
    return F.sqrt(F.greatest(F.lit(0.0), plain(F.zip_with(share(p), share(q), point))))


def quality_signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """The base counts and the two histograms of every row; input columns are kept in ``row``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lang = F.coalesce(F.col(lang_col), F.lit("")) if lang_col else F.lit("")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("t"), lang.alias("lang"))
    listed = F.lit(None).cast("array<string>")
    for code, words in COMMON_WORDS.items():
        listed = F.when(F.col("lang") == code, F.array(*map(F.lit, words))).otherwise(listed)
    every = sorted({w for words in COMMON_WORDS.values() for w in words})
    width = len(COMMON_WORDS["en"])
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rest = lambda classes: F.length(F.regexp_replace("t", classes, ""))
    size = F.length("t")
    rows = rows.withColumn("words", words_of(F.col("t")))
    common = F.filter(F.transform("words", ascii_lower), lambda w: w.isin(every))
    counts = lambda c: F.transform(listed, lambda x: F.size(F.filter(c, lambda w: w == x)))
    binned = _let(common, counts)
    known = [(size - rest(c)).cast("int") for c in CLASSES]
    out = rows.select(
        "doc_id", "row", "lang", F.size("words").cast("long").alias("n_words"),
        rest(r"[\x20\x09-\x0D]").cast("long").alias("word_chars"),
        (size - rest(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.array(*known, F.greatest(F.lit(0), F.length(F.regexp_replace("t", "[" + "".join(c.strip("[]") if c[0] == "[" else c for c in CLASSES) + "]", "")))).alias("classes"),
        binned.alias("common"),
    )
    other = lambda c: F.concat(c, F.array(F.greatest(F.lit(0), F.col("n_words").cast("int") - F.aggregate(c, F.lit(0), lambda a, x: a + x))))
    return out.withColumn("common", other(F.coalesce("common", F.array_repeat(F.lit(0), width))))


def _base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def references(signals: DataFrame, source_col: str | None = None) -> DataFrame:
    """``lang, pooled``: pooled shares of the classes of each language that has no fixed reference.

    Documents weigh the same within a source and sources within a language, so
    neither a few very long ones nor a hot source set the reference.
    """
    n = len(CLASSES) + 1
    judged = signals.where((F.col("n_words") >= LEAST_WORDS) & ~_base_failed() & ~F.col("lang").isin(list(REFERENCES)))
    source = F.col("row").getField(source_col) if source_col else F.lit(None)
    total = F.aggregate("classes", F.lit(0.0), lambda a, x: a + x)
    means = [F.avg(F.try_divide(F.col("classes")[i].cast("double"), total)).alias(f"m{i}") for i in range(n)]
    sources = judged.groupBy("lang", source.cast("string").alias("source")).agg(*means)
    return sources.groupBy("lang").agg(F.array(*[F.avg(f"m{i}") for i in range(n)]).alias("pooled"))


def _fixed(part: int) -> Column:
    """The fixed reference of the row's language, or null."""
    out = F.lit(None).cast("array<double>")
    for code, shares in REFERENCES.items():
        out = F.when(F.col("lang") == code, F.array(*map(F.lit, shares[part]))).otherwise(out)
    return out


def judge_quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", source_col: str = "source"
) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance, kept, row``.

    One row per input row; ``row`` holds the input columns.  Null text: no
    words, so ``base_failed``.  ``base_failed``: fewer than 20 words, or over
    30 % of them in repeated windows.  ``kept`` is false where it is, or where a
    distance to the language's reference is too large.  Null or unknown
    languages have no common words and are judged by character classes alone,
    pooled by ``source_col`` where the input has it.
    """
    signals = quality_signals(docs, id_col, text_col, lang_col)
    signals = cut_lineage(signals)  # read by the references and by the verdicts
    reference = references(signals, source_col if source_col in docs.columns else None)
    guarded = F.col("n_words") >= LEAST_WORDS
    classes = F.when(guarded, _divergence(F.col("classes"), F.coalesce(_fixed(0), F.col("pooled"))))
    words = F.when(guarded & F.col("lang").isin(list(COMMON_WORDS)), _divergence(F.col("common"), _fixed(1)))
    bad = (F.coalesce(F.col("class_distance"), F.lit(0.0)) > CLASS_DISTANCE) | (F.coalesce(F.col("word_distance"), F.lit(0.0)) > WORD_DISTANCE)
    return (
        signals.join(reference, "lang", "left")
        .withColumns({"base_failed": _base_failed(), "class_distance": classes, "word_distance": words})
        .withColumn("kept", ~F.col("base_failed") & ~bad)
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept", "row")
    )


def sql() -> str:
    """DuckDB form of the registered query, for languages that have a reference."""
    text = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
    nums = lambda xs: "[" + ", ".join(f"{x}::double" for x in xs) + "]"
    refs = ", ".join(f"('{c}', {text(COMMON_WORDS[c])}, {nums(s[0])}, {nums(s[1])})" for c, s in REFERENCES.items())
    quoted = [c.replace("'", "''") for c in CLASSES]
    inner = "".join(c[1:-1] if c[0] == "[" else c for c in quoted)
    counts = ", ".join([f"length(t) - length(regexp_replace(t, '{c}', '', 'g'))" for c in quoted] + [f"length(regexp_replace(t, '[{inner}]', '', 'g'))"])
    share = lambda x: f"list_transform({x}, lambda v: v / list_sum({x}))"
    term = "case when {0} > 0 then {0} * log2({0} / (({0} + {1}) / 2)) else 0.0 end"
    js = lambda p, q: f"sqrt(greatest(0.0, list_sum(list_transform(list_zip({share(p)}, {share(q)}), lambda z: ({term.format('z[1]', 'z[2]')} + {term.format('z[2]', 'z[1]')}) / 2))))"
    return rf"""
with refs(lang, listed, class_ref, word_ref) as (values {refs}),
d as (select doc_id, coalesce(text, '') as t, coalesce(lang, '') as lang, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
win as (select doc_id, i, array_to_string(words[i:i + 7], ' ') as k from (select doc_id, words, unnest(range(1, len(words) - 6)) as i from d where len(words) >= 8)),
rep as (select doc_id, i from win qualify count(*) over (partition by doc_id, k) > 1),
again as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 8)) as p from rep) group by 1),
b as (select d.doc_id, lang, t, words, cast(len(words) as bigint) as n_words, cast(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
    cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
    cast(coalesce(again.n, 0) as bigint) as n_repeat_words, [{counts}]::double[] as classes, list_transform(words, lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as low
  from d left join again using (doc_id)),
c as (select *, list_transform(listed, lambda x: len(list_filter(low, lambda w: w = x)))::double[] as common from b left join refs using (lang)),
f as (select *, list_append(common, greatest(0, n_words - list_sum(common))) as said, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from c),
j as (select *, case when n_words >= {LEAST_WORDS} then round({js('classes', 'class_ref')}, 6) end as class_distance, case when n_words >= {LEAST_WORDS} then round({js('said', 'word_ref')}, 6) end as word_distance from f)
select doc_id, n_words, word_chars, n_symbols, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance,
  not base_failed and not (coalesce(class_distance, 0) > {CLASS_DISTANCE} or coalesce(word_distance, 0) > {WORD_DISTANCE}) as kept from j
"""
