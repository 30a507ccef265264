"""Location text to one canonical form, as column expressions.

Which suffix a bare street name takes comes from a :class:`Vocabulary`, made
from intersection names by :func:`street_vocabulary`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Written suffix to suffix, and first words that are directions.
SUFFIXES = {
    "ST": "St", "STREET": "St", "AVE": "Ave", "AV": "Ave", "AVENUE": "Ave", "BLVD": "Blvd", "BOULEVARD": "Blvd", "DR": "Dr", "DRIVE": "Dr", "RD": "Rd",
    "ROAD": "Rd", "WAY": "Way", "WY": "Way", "LN": "Ln", "LANE": "Ln", "CT": "Ct", "COURT": "Ct", "PL": "Pl", "PLACE": "Pl", "TER": "Ter", "TERR": "Ter",
    "TERRACE": "Ter", "ALY": "Aly", "ALLEY": "Aly", "HWY": "Hwy", "HIGHWAY": "Hwy", "CIR": "Cir", "CIRCLE": "Cir", "PLZ": "Plz", "PLAZA": "Plz",
    "PARK": "Park", "PK": "Park", "EXPY": "Expy", "EXPRESSWAY": "Expy", "STPS": "Stps", "STEPS": "Stps", "WALK": "Walk", "ROW": "Row", "PATH": "Path",
    "BRG": "Brg", "TUNL": "Tunl",
}
DIRECTIONS = {"N": "North", "S": "South", "E": "East", "W": "West", "NORTH": "North", "SOUTH": "South", "EAST": "East", "WEST": "West"}
#: Names that stand for another.
ALIASES = {
    "ARMY ST": "Cesar Chavez St", "ARMY": "Cesar Chavez St", "CESAR CHAVEZ": "Cesar Chavez St", "CHAVEZ ST": "Cesar Chavez St", "THIRD ST": "3rd St",
    "THIRD STREET": "3rd St", "FIRST ST": "1st St", "SECOND ST": "2nd St", "FOURTH ST": "4th St", "FIFTH ST": "5th St", "SIXTH ST": "6th St",
    "SEVENTH ST": "7th St", "EIGHTH ST": "8th St", "NINTH ST": "9th St", "TENTH ST": "10th St", "GREAT HWY": "Great Highway", "GREAT HIGHWAY": "Great Highway",
    "THE GREAT HIGHWAY": "Great Highway", "EMBARCADERO": "The Embarcadero", "THE EMBARCADERO": "The Embarcadero", "EMBARCADERO ST": "The Embarcadero",
    "OSHAUGHNESSY BLVD": "O'Shaughnessy Blvd", "O SHAUGHNESSY BLVD": "O'Shaughnessy Blvd", "BROTHERHOOD WAY": "Brotherhood Way", "PORTOLA DR": "Portola Dr",
    "JOHN F KENNEDY DR": "John F Kennedy Dr", "JFK DR": "John F Kennedy Dr", "MLK JR DR": "Martin Luther King Jr Dr",
    "MARTIN LUTHER KING JR DR": "Martin Luther King Jr Dr", "SOUTH VAN NESS AVE": "South Van Ness Ave", "VAN NESS AVE": "Van Ness Ave",
    "BAYSHORE BLVD": "Bayshore Blvd", "GOLDEN GATE AVE": "Golden Gate Ave", "SAN JOSE AVE": "San Jose Ave", "19TH AVE": "19th Ave", "PANHANDLE": "The Panhandle",
}
#: Words whose case is their own.
CASES = {
    "MCALLISTER": "McAllister", "MCCOPPIN": "McCoppin", "MCLAREN": "McLaren", "OSHAUGHNESSY": "O'Shaughnessy", "O'SHAUGHNESSY": "O'Shaughnessy",
    "OFARRELL": "O'Farrell", "O'FARRELL": "O'Farrell", "O'REILLY": "O'Reilly", "DEHARO": "De Haro", "DE": "de", "LA": "la", "JR": "Jr", "II": "II",
    "III": "III", "JFK": "JFK", "MLK": "MLK", "US": "US", "SF": "SF",
}
#: Texts that say nothing, spelled ordinals, and words of landmarks.
SENTINELS = ("NOT AVAILABLE", "UNKNOWN", "N/A", "NA", "NONE", "NO LOCATION", "UNK", "TBD")
ORDINALS = {
    w: i + 1
    for i, w in enumerate(
        "FIRST SECOND THIRD FOURTH FIFTH SIXTH SEVENTH EIGHTH NINTH TENTH ELEVENTH TWELFTH THIRTEENTH FOURTEENTH FIFTEENTH SIXTEENTH SEVENTEENTH EIGHTEENTH "
        "NINETEENTH TWENTIETH".split()
    )
}
LANDMARKS = (
    "HOSPITAL", "THEATER", "THEATRE", "STATION", "TERMINAL", "AIRPORT", "PLAZA", "PARK", "CENTER", "CENTRE", "SCHOOL", "COLLEGE", "UNIVERSITY", "PIER",
    "STADIUM", "LIBRARY", "BLDG", "TOWER",
)
#: Share of a name's mentions that its commonest suffix needs, and corners that make a street one that crosses avenues.
SUFFIX_SHARE, AVENUE_CORNERS = 0.8, 5
#: What an ordinal looks like, and what parts two streets.
_ORDINAL = r"^0*(\d+)(?:ST|ND|RD|TH)$"
_PARTED = r"\s*(?:\\|/|&|\bAT\b|\bAND\b|\bX\b)\s*"


@dataclass(frozen=True)
class Vocabulary:
    """Suffixes by upper-case name, names with more than one suffix, and names that cross numbered avenues."""

    suffixes: dict[str, str] = field(default_factory=dict)
    ambiguous: frozenset[str] = frozenset()
    crosses_avenue: frozenset[str] = frozenset()


def _lookup(values: dict, key: Column, kind: str = "string") -> Column:
    if not values:
        return F.lit(None).cast(kind)
    # one text in place of a literal an entry keeps plans small; it is folded into a map once
    table = F.str_to_map(F.lit(";".join(f"{k}={v}" for k, v in values.items())), F.lit(";"), F.lit("="))
    return F.try_element_at(table, key).cast(kind)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ordinal(n: Column) -> Column:
    """``1st``, ``22nd``, ``113th``."""
    last, teens = n % 10, (n % 100).between(11, 13)
    end = F.when(teens, "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def title_word(word: Column) -> Column:
    """An upper-case word in its own case."""
    plain = lambda w: F.concat(F.substring(w, 1, 1), F.lower(F.substring(w, 2, 1000)))
    return F.coalesce(_lookup(CASES, word), F.array_join(F.transform(F.split(word, "'", -1), plain), "'"))


def title(text: Column) -> Column:
    return F.array_join(F.transform(F.split(F.upper(text), r"\s+", -1), title_word), " ")


def street_name(text: Column, vocabulary: Vocabulary, partners: Column | None = None) -> Column:
    """The canonical name of a street, or null for blank text; ``partners``: canonical names of the streets it crosses."""

    def canonical(words: Column) -> Column:
        n = F.size(words)

        def word(w: Column, i: Column) -> Column:
            number, spelled = F.regexp_extract(w, _ORDINAL, 1), _lookup(ORDINALS, w, "int")
            last = i == n - 1
            return F.coalesce(
                F.when(number != "", ordinal(number.try_cast("int"))), F.when(~last, ordinal(spelled)), F.when(last & (i > 0), _lookup(SUFFIXES, w)),
                F.when((i == 0) & (n > 1), _lookup(DIRECTIONS, w)), title_word(w),
            )

        bare = _lookup(SUFFIXES, F.element_at(words, -1)).isNull()
        return _let(F.array_join(F.transform(words, word), " "), lambda name: _suffixed(name, bare, vocabulary, partners))

    def named(cleaned: Column) -> Column:
        found = _let(canonical(F.split(cleaned, " ", -1)), lambda f: F.coalesce(_lookup(ALIASES, F.upper(f)), f))
        return F.when(cleaned != "", F.coalesce(_lookup(ALIASES, cleaned), found))

    return _let(F.upper(F.trim(F.regexp_replace(F.regexp_replace(text, "[.,]", " "), r"\s+", " "))), named)


def _suffixed(name: Column, bare: Column, vocabulary: Vocabulary, partners: Column | None) -> Column:
    key = F.upper(name)
    unclear = key.isin(*vocabulary.ambiguous) if vocabulary.ambiguous else F.lit(False)
    numbered = name.rlike(r"(?i)^\d+(?:st|nd|rd|th)$")
    inferred = F.lit(None).cast("string")
    if partners is not None and vocabulary.crosses_avenue:
        crosses = F.exists(partners, lambda p: F.upper(p).isin(*vocabulary.crosses_avenue) | F.upper(F.regexp_replace(p, r" \S+$", "")).isin(*vocabulary.crosses_avenue))
        inferred = F.when(crosses, "Ave").otherwise("St")
    elif partners is not None:
        inferred = F.lit("St")
    known = F.when(partners.isNotNull() & (F.size(partners) > 0), inferred) if partners is not None else inferred
    suffix = F.when(~unclear, _lookup(vocabulary.suffixes, key)).when(numbered, known)
    return F.when(bare & suffix.isNotNull(), F.concat(name, F.lit(" "), suffix)).otherwise(name)


def street_order(street: Column) -> Column:
    """Sorts numbered streets first by number, then the others by name."""
    number = F.regexp_extract(street, r"^(\d+)(?:st|nd|rd|th)\b", 1)
    return F.struct((number == "").alias("named"), F.coalesce(number.try_cast("int"), F.lit(0)).alias("number"), F.lower(street).alias("name"), street.alias("street"))


def _unknown() -> Column:
    return _parsed("unknown", F.lit(""), F.array().cast("array<string>"), F.lit(0.0))


def _parsed(kind: str, canonical: Column, streets: Column, confidence: Column, number: Column | None = None) -> Column:
    number = F.lit(None) if number is None else number
    return F.struct(
        F.lit(kind).alias("kind"), canonical.alias("canonical"), streets.alias("streets"), number.cast("int").alias("address_number"), confidence.cast("double").alias("confidence")
    )


def normalize_location(raw: Column, vocabulary: Vocabulary) -> Column:
    """``struct<kind, canonical, streets, address_number, confidence>`` of location text.

    ``kind``: intersection, block, address, landmark or unknown.  Null, blank and
    placeholder texts are unknown.  A call box is what it stands near, at less
    confidence; a box within a box is a landmark.
    """
    none = F.array().cast("array<string>")

    def corner(parts: Column) -> Column:
        first = F.transform(parts, lambda p: F.coalesce(street_name(p, vocabulary), p))
        named = F.transform(
            parts, lambda p, i: _let(F.filter(first, lambda x, j: j != i), lambda others: street_name(p, vocabulary, others))
        )
        unique = _let(F.array_distinct(F.filter(named, lambda s: s.isNotNull())), lambda u: F.transform(F.array_sort(F.transform(u, street_order)), lambda s: s["street"]))
        whole = _let(unique, lambda u: _parsed("intersection", F.array_join(u, " & "), u, F.when(F.size(u) == 2, 0.95).otherwise(0.8)))
        return F.when(F.size(F.filter(named, lambda s: s.isNotNull())) >= 2, whole).otherwise(_unknown())

    def single(text: Column) -> Column:
        block, address = r"^(\d+)\s+BLOCK\s+(?:OF\s+)?(.+)$", r"^(\d+)\s+(.+)$"
        part = lambda rule, k: F.regexp_extract(text, rule, k)
        in_block = _let(street_name(part(block, 2), vocabulary), lambda s: F.when(s.isNotNull(), _parsed("block", F.concat(part(block, 1), F.lit(" block of "), s), F.array(s), F.lit(0.9), part(block, 1).try_cast("int"))).otherwise(_unknown()))
        number = part(address, 1).try_cast("int")
        at = _let(street_name(part(address, 2), vocabulary), lambda s: F.when(s.isNotNull(), _parsed("address", F.concat(number.cast("string"), F.lit(" "), s), F.array(s), F.lit(0.9), number)).otherwise(_unknown()))
        known = F.lit(False)
        for hint in LANDMARKS:
            known |= text.contains(hint)
        street = _let(street_name(text, vocabulary), lambda s: F.when(s.rlike(r"\s"), _parsed("block", s, F.array(s), F.lit(0.4))).otherwise(_unknown()))
        return F.when(text.rlike(block), in_block).when(text.rlike(address), at).when(known, _parsed("landmark", title(text), none, F.lit(0.5))).otherwise(street)

    def plain(text: Column) -> Column:
        parts = F.filter(F.transform(F.split(text, _PARTED, -1), lambda p: F.trim(p)), lambda p: p != "")
        return _let(parts, lambda p: F.when(F.size(p) >= 2, corner(p)).when(F.size(p) == 1, single(p[0])).otherwise(_unknown()))

    nothing = lambda t: (t == "") | t.isin(*SENTINELS)
    box = r"^(?:CALL\s*BOX|CB)\s*[:#-]?\s*(.+)$"

    def read(upper: Column) -> Column:
        boxed = upper.rlike(box)
        inner = F.trim(F.regexp_replace(F.regexp_extract(upper, box, 1), r",\s*SF$", ""))

        def told(text: Column) -> Column:
            parsed = F.when(nothing(text) | text.rlike(box), _unknown()).otherwise(plain(text))
            beside = lambda p: F.when(p["kind"] != "unknown", p.withField("confidence", F.greatest(F.lit(0.0), p["confidence"] - 0.1))).otherwise(_parsed("landmark", title(text), none, F.lit(0.4)))
            return _let(parsed, lambda p: F.when(boxed, beside(p)).otherwise(p))

        return F.when(upper.isNull(), _unknown()).otherwise(_let(F.when(boxed, inner).otherwise(upper), told))

    return _let(F.upper(F.trim(F.regexp_replace(raw, r"\s+", " "))), read)


def street_vocabulary(intersections: DataFrame, name_col: str = "intersection_name") -> DataFrame:
    """``name, suffix, ambiguous, crosses_avenue``: one row per street name in distinct intersection names.

    ``suffix`` is the commonest one where it has SUFFIX_SHARE of the mentions;
    otherwise the name is ambiguous.  A name without a suffix has none of both.
    """
    parts = F.filter(F.transform(F.split(F.upper(F.col(name_col)), r"\\", -1), lambda p: F.trim(p)), lambda p: p != "")
    split = lambda p: F.struct(
        F.when((F.size(F.split(p, r"\s+", -1)) > 1) & _lookup(SUFFIXES, F.element_at(F.split(p, r"\s+", -1), -1)).isNotNull(), F.regexp_replace(p, r"\s+\S+$", "")).otherwise(p).alias("base"),
        F.when(F.size(F.split(p, r"\s+", -1)) > 1, _lookup(SUFFIXES, F.element_at(F.split(p, r"\s+", -1), -1))).alias("suffix"),
    )
    rows = intersections.select(name_col).where(F.col(name_col).isNotNull()).distinct().select(F.transform(parts, split).alias("p"))
    avenue = F.exists("p", lambda x: x["base"].rlike(_ORDINAL) & (x["suffix"] == "Ave"))
    flat = rows.select(F.inline("p"), avenue.alias("avenue"))
    number = F.regexp_extract("base", _ORDINAL, 1)
    flat = flat.select(F.when(number != "", F.upper(ordinal(number.try_cast("int")))).otherwise(F.col("base")).alias("name"), "suffix", (F.col("avenue") & (number == "")).alias("avenue"))
    counted = flat.groupBy("name", "suffix").agg(F.count("*").alias("n"), F.count_if("avenue").alias("corners"))
    named = F.when(F.col("suffix").isNotNull(), F.col("n"))
    best = F.max_by("suffix", F.struct(named, F.col("suffix")))
    out = counted.groupBy("name").agg(best.alias("best"), F.max(named).alias("top"), F.sum(named).alias("total"), F.sum("corners").alias("corners"))
    clear = F.col("top") >= SUFFIX_SHARE * F.col("total")
    return out.select("name", F.when(clear, F.col("best")).alias("suffix"), F.coalesce(~clear, F.lit(False)).alias("ambiguous"), (F.col("corners") >= AVENUE_CORNERS).alias("crosses_avenue"))


def read_vocabulary(rows: DataFrame) -> Vocabulary:
    """The vocabulary's rows, one a street of a city, as the constants that expressions take."""
    found = rows.collect()
    return Vocabulary(
        {r["name"]: r["suffix"] for r in found if r["suffix"]}, frozenset(r["name"] for r in found if r["ambiguous"]), frozenset(r["name"] for r in found if r["crosses_avenue"])
    )
