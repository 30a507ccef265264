"""Times as column expressions: the feeds' naive local strings, offsets, and how long ago something was.

Instants are microseconds since 1970 (``long``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the zone of strings without one.
ZONE = "America/Los_Angeles"
SECOND, MINUTE, HOUR, DAY = 1_000_000, 60_000_000, 3_600_000_000, 86_400_000_000
_NAIVE = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d{1,3})?$"

#: Minutes of a unit word, and number words.
UNIT_MINUTES = {
    "min": 1, "mins": 1, "minute": 1, "minutes": 1, "m": 1, "hour": 60, "hours": 60, "hr": 60, "hrs": 60, "h": 60,
    "day": 1440, "days": 1440, "d": 1440, "week": 10080, "weeks": 10080, "wk": 10080, "month": 43200, "months": 43200, "year": 525600, "years": 525600,
}
NUMBER_WORDS = {
    "a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "ten": 10, "twelve": 12, "fifteen": 15,
    "twenty": 20, "thirty": 30, "sixty": 60, "ninety": 90,
}
#: Phrases of the length of a window.
WINDOW = (
    r"\b(?:in|within|over|during|for)?\s*(?:the\s+)?(?:last|past|previous)\s+"
    r"(\d+|a|an|one|two|three|four|five|six|ten|twelve|fifteen|twenty|thirty|sixty|ninety)?\s*([a-z]+)"
)
BARE_WINDOW = r"\b(\d+)\s*(min|mins|minutes|hour|hours|hr|hrs|h|day|days|d|week|weeks|month|months)\b"


def local_offset(us: Column) -> Column:
    """Microseconds to add to an instant for the wall clock of ZONE."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), ZONE)) - us


def parse_local(text: Column) -> Column:
    """The instant of a feed's time string; null if it is none.

    A string without a zone is the wall clock of ZONE: its offset is that at the
    instant found with the offset of the same digits in UTC.  A string with a
    zone, or a date alone, says its own instant.
    """
    trimmed = F.trim(text)
    as_utc = F.unix_micros(F.try_to_timestamp(F.replace(trimmed, F.lit("T"), F.lit(" "))))
    # an element of an array, as the text would be read again wherever the instant is named
    naive = F.get(F.transform(F.array(as_utc), lambda u: u - local_offset(u - local_offset(u))), F.lit(0))
    return F.when(trimmed.rlike(_NAIVE), naive).otherwise(F.unix_micros(trimmed.try_cast("timestamp")))


def naive_local(us: Column) -> Column:
    """The instant as the feeds write it; milliseconds are always zero."""
    return F.date_format(F.timestamp_micros(us + local_offset(us)), "yyyy-MM-dd'T'HH:mm:ss.000")


def _round(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def relative_time(us: Column, now_us: Column) -> Column:
    """``5 min ago``, ``in 3 h``; days up to 14, weeks up to 9, then months."""
    gap = now_us - us
    minutes = _round(F.abs(gap) / MINUTE)
    hours = _round(minutes / 60)
    days = _round(hours / 24)
    weeks = _round(days / 7)
    value = (
        F.when(minutes < 60, F.concat(minutes, F.lit(" min"))).when(hours < 24, F.concat(hours, F.lit(" h")))
        .when(days < 14, F.concat(days, F.lit(" d"))).when(weeks < 9, F.concat(weeks, F.lit(" w"))).otherwise(F.concat(_round(days / 30), F.lit(" mo")))
    )
    told = F.when(gap < 0, F.concat(F.lit("in "), value)).otherwise(F.concat(value, F.lit(" ago")))
    return F.when(minutes < 1, F.lit("just now")).otherwise(told)


def elapsed(from_us: Column, to_us: Column) -> Column:
    """``4 min 52 s``; null where a time is missing or they are in the wrong order."""
    gap = to_us - from_us
    seconds = _round(gap / SECOND)
    minutes, rest = F.floor(seconds / 60).cast("long"), seconds % 60
    longer = F.when(rest == 0, F.concat(minutes, F.lit(" min"))).otherwise(F.concat(minutes, F.lit(" min "), rest, F.lit(" s")))
    return F.when(gap >= 0, F.when(seconds < 60, F.concat(seconds, F.lit(" s"))).otherwise(longer))


def numeric_window(text: Column) -> Column:
    """``struct<minutes, label>`` of the first window named in lower-case text, or null."""
    literal = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
    named = text.rlike(WINDOW)
    pick = lambda k: F.when(named, F.regexp_extract(text, WINDOW, k)).otherwise(F.regexp_extract(text, BARE_WINDOW, k))
    said, word = pick(1), pick(2)
    number = F.when(said == "", F.lit(1)).otherwise(F.coalesce(said.try_cast("int"), F.try_element_at(literal(NUMBER_WORDS), said)))
    unit = F.coalesce(F.try_element_at(literal(UNIT_MINUTES), F.regexp_replace(word, "s$", "")), F.try_element_at(literal(UNIT_MINUTES), word))
    name = (
        F.when(unit == 1, "minute").when(unit == 60, "hour").when(unit == 1440, "day").when(unit == 10080, "week").when(unit == 43200, "month").otherwise("year")
    )
    many = F.concat(F.lit("the last "), number, F.lit(" "), name, F.when(number == 1, "").otherwise("s"))
    label = F.when(said == "", F.concat(F.lit("the last "), name)).otherwise(many)
    found = (named | text.rlike(BARE_WINDOW)) & unit.isNotNull() & number.isNotNull()
    return F.when(found, F.struct((number * unit).alias("minutes"), label.alias("label")))
