"""Full-text search over several fields of observations: words by their stems, an index that is kept, and ranks joined back."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.search import B, K1

#: Fields of an observation that are searched, as one text each.
FIELDS = ("raw_type", "subtype", "location", "neighborhood", "units", "type")
_VOWELS = "aeiou"
#: Suffixes of the published algorithm's second, third and fourth steps.
_SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_FOURTH = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _consonants(word: str) -> list[bool]:
    out: list[bool] = []
    for i, c in enumerate(word):
        out.append(c not in _VOWELS and not (c == "y" and i > 0 and out[i - 1]))
    return out


def _measure(stem: str) -> int:
    """How often a vowel is followed by a consonant."""
    kinds = _consonants(stem)
    return sum(not a and b for a, b in zip(kinds, kinds[1:]))


def _short(word: str) -> bool:
    kinds = _consonants(word)
    return len(word) >= 3 and kinds[-3:] == [True, False, True] and word[-1] not in "wxy"


def porter(word: str) -> str:
    """The stem of a lower-case word by Porter's algorithm of 1980; words of up to two letters, or with others than a to z, stay."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    voiced = lambda s: not all(_consonants(s))
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    cut = None
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    elif word.endswith("ed") and voiced(word[:-2]):
        cut = word[:-2]
    elif word.endswith("ing") and voiced(word[:-3]):
        cut = word[:-3]
    if cut is not None:
        doubled = len(cut) > 1 and cut[-1] == cut[-2] and _consonants(cut)[-1]
        if cut.endswith(("at", "bl", "iz")) or not doubled and _measure(cut) == 1 and _short(cut):
            cut += "e"
        elif doubled and cut[-1] not in "lsz":
            cut = cut[:-1]
        word = cut
    if word.endswith("y") and voiced(word[:-1]):
        word = word[:-1] + "i"
    for steps in (_SECOND, _THIRD):
        end = max((s for s in steps if word.endswith(s)), key=len, default=None)
        if end is not None and _measure(word[: -len(end)]) > 0:
            word = word[: -len(end)] + steps[end]
    end = max((s for s in _FOURTH if word.endswith(s)), key=len, default=None)
    if end is not None and _measure(word[: -len(end)]) > 1 and (end != "ion" or word[: -len(end)].endswith(("s", "t"))):
        word = word[: -len(end)]
    if word.endswith("e") and (_measure(word[:-1]) > 1 or _measure(word[:-1]) == 1 and not _short(word[:-1])):
        word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+", -1), lambda w: w != "")


def stemmed(words: DataFrame) -> DataFrame:
    """``token, stem`` of distinct ``token`` rows: each word is stemmed once, whatever the number of its uses."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(stem=batch["token"].map(porter))

    return words.select("token").distinct().mapInPandas(run, "token string, stem string")


def inverted_index(rows: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``id, size, stem, tf`` over all fields of ``id`` and text columns; ``units`` may be an array.

    Null fields have no words; a row without words is not in the index.
    """
    texts = [F.array_join(F.col(f), " ") if rows.schema[f].dataType.typeName() == "array" else F.col(f) for f in fields]
    words = F.concat(*[F.coalesce(_words(t), F.array().cast("array<string>")) for t in texts])
    flat = rows.select("id", words.alias("words")).select("id", F.size("words").alias("size"), F.explode("words").alias("token"))
    counted = flat.groupBy("id", "size", "token").agg(F.count("*").alias("tf"))
    return counted.join(stemmed(counted), "token").groupBy("id", "size", "stem").agg(F.sum("tf").alias("tf"))


def write_index(index: DataFrame, path: str) -> None:
    """Keep an index by the first letter of its stems, so that a search reads the folders of its words."""
    index.withColumn("letter", F.substring("stem", 1, 1)).write.mode("overwrite").partitionBy("letter").parquet(path)


def search(index: DataFrame, query: str, limit: int) -> DataFrame:
    """``id, score``: the ``limit`` best rows (a top-k report) of those with any word that begins with the stem of a query word.

    BM25, larger is better; a word that over half of the rows have counts for
    next to nothing.  Ties by id; a query without words finds nothing.
    """
    terms = list(dict.fromkeys(porter(w) for w in "".join(c if c.isalnum() else " " for c in query.lower()).split()))
    spark = index.sparkSession
    if not terms:
        return spark.createDataFrame([], "id long, score double")
    whole = index.groupBy("id").agg(F.first("size").alias("size")).agg(F.count("*").alias("docs"), F.avg("size").alias("mean"))
    matched = F.filter(F.array(*map(F.lit, terms)), lambda t: F.startswith(F.col("stem"), t))
    near = F.lit(False)
    for t in terms:
        near |= F.startswith(F.col("stem"), F.lit(t))
    hits = index.where(near).select("id", "size", "tf", F.explode(matched).alias("term")).groupBy("id", "size", "term").agg(F.sum("tf").alias("tf"))
    used = hits.groupBy("term").agg(F.count("*").alias("df"))  # a row a query word
    known = hits.join(F.broadcast(used), "term").crossJoin(F.broadcast(whole))  # one row
    idf = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.greatest(idf, F.lit(1e-6)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    return known.groupBy("id").agg(F.round(F.sum(part), 9).alias("score")).orderBy(F.desc("score"), "id").limit(limit)
