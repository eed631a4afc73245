"""Dates and times in whatever form a payload writes them, in column expressions.

A text is searched for the first of a few forms, anywhere in it, so words around it don't matter: year first, day and
month name (with ordinals), month name and day, numbers with the day first, digits only, month and year, a year alone.
Differences from a guessing parser, on purpose: a date that begins with a four-digit year is never read day first; a
month name with two digits is a month of a year (``Mar-24``); what a text leaves out is the first month or day, and
midnight, never today's. Two digits of a year are in 1976 to 2075. Times without a zone, or with a zone's letters other
than UTC, are UTC. Impossible dates are null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for no date.
NONE = ("", "-", "None", "nan", "NaN", "NaT", "null", "N/A")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
LAST_OF_CENTURY = 75

NAME = r"(?<![a-z])(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)(?![a-z])\.?"
GAP = r"[\s\-/.,']*"
DAY = r"(?<!\d)(\d{1,2})(?:st|nd|rd|th)?(?!\d)"
YEAR = r"(\d{4}|\d{2})(?!\d)"
ALONE, NO_MORE = r"(?<!\d)(?<!\d[-/.])", r"(?![-/.]?\d)"
#: (pattern, groups of year, month, day), the first that is found counts; 0 stands for what is left out.
FORMS = (
    (r"(?<!\d)(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?!\d)", 1, 2, 3),
    (DAY + GAP + r"(?:of\s+)?" + NAME + GAP + YEAR, 3, 2, 1),
    (NAME + GAP + DAY + r"[\s\-/.,']+" + YEAR, 3, 1, 2),
    (r"(?<!\d)(\d{4})" + GAP + NAME + GAP + DAY, 1, 2, 3),
    (r"(?<!\d)(\d{1,2})[-/. ](\d{1,2})[-/. ]" + YEAR, 3, 2, 1),
    (r"(?<!\d)(\d{4})(\d{2})(\d{2})(?:t?\d{4,6})?(?!\d)", 1, 2, 3),
    (NAME + GAP + YEAR, 2, 1, 0),
    (r"(?<!\d)(\d{4})" + GAP + NAME, 1, 2, 0),
    (ALONE + r"(\d{4})[-/.](\d{1,2})" + NO_MORE, 1, 2, 0),
    (ALONE + r"(\d{1,2})[-/.](\d{4})" + NO_MORE, 2, 1, 0),
    (r"^\s*(\d{4})\s*$", 1, 0, 0),
)
CLOCK = r"(?<!\d)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,6})\d*)?)?\s*(am|pm|a\.m\.|p\.m\.)?"
ZONE = r"\d\s*(?:utc|gmt)?\s*([+-])(\d{2}):?(\d{2})(?!\d)"
#: What most payloads write, as whole texts: a date of 2024-03-15, of 15-mar-2024 or 15 mar 2024, a month of mar 2024.
PLAIN_CLOCK = r"(?:[ t]\d{2}:\d{2}(?::\d{2})?)?$"
PLAIN_DATE = r"^[1-9]\d{3}-\d{2}-\d{2}" + PLAIN_CLOCK
PLAIN_DAY = rf"^\d{{2}}[- ](?:{'|'.join(MONTHS)})[- ][1-9]\d{{3}}" + PLAIN_CLOCK
PLAIN_MONTH = rf"^(?:{'|'.join(MONTHS)})[- ][1-9]\d{{3}}$"
COMPACT = r"(?<!\d)\d{8}[t\s]?(\d{2})(\d{2})(\d{2})?(?!\d)"


def _text(c: Column) -> Column:
    c = F.trim(c.cast("string"))
    return F.lower(F.when(~c.isin(*NONE), c))


def _year(digits: Column) -> Column:
    n = digits.try_cast("int")
    return F.when(F.length(digits) == 4, n).when(n <= LAST_OF_CENTURY, n + 2000).otherwise(n + 1900)


def _month(word: Column) -> Column:
    by_name = F.array_position(F.array(*(F.lit(m) for m in MONTHS)), F.substring(word, 1, 3)).cast("int")
    return F.when(word.rlike("^[0-9]"), word.try_cast("int")).otherwise(by_name)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, whatever ``use`` makes of it."""
    return F.get(F.transform(F.array(value), use), 0)


def _made(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")


def day(c: Column) -> Column:
    """The date in a text, else null."""
    return _let(_text(c), _date)


def _date(text: Column) -> Column:
    """Plain texts by their places, which is what the forms would find in them; others are searched for the forms."""
    part = lambda at, n: F.substring(text, at, n)
    month = lambda at: F.lpad(F.array_position(F.array(*(F.lit(m) for m in MONTHS)), part(at, 3)).cast("string"), 2, "0")
    written = lambda *parts: F.concat_ws("-", *parts).try_cast("date")
    plain = F.when(text.rlike(PLAIN_DATE), part(1, 10).try_cast("date"))
    plain = plain.when(text.rlike(PLAIN_DAY), written(part(8, 4), month(4), part(1, 2)))
    plain = plain.when(text.rlike(PLAIN_MONTH), written(part(5, 4), month(1), F.lit("01")))
    return plain.otherwise(_searched(text))


def _searched(text: Column) -> Column:
    return _let(F.regexp_replace(text, CLOCK, " "), lambda plain: _let(_parts(plain), _of_parts))


def _parts(plain: Column) -> Column:
    """Year, month, day as they are written, and whether they are numbers with the day first."""
    found = F.lit(None).cast("string")
    for pattern, y, m, d in reversed(FORMS):
        numbers = (y, m, d) == (3, 2, 1) and NAME not in pattern
        written = "|".join([*(f"${g}" if g else "1" for g in (y, m, d)), "n" if numbers else ""])
        found = F.when(plain.rlike(pattern), F.regexp_replace(plain, f"(?s)^.*?{pattern}.*$", written)).otherwise(found)
    return F.split(found, "[|]")


def _of_parts(parts: Column) -> Column:
    year, month, on = _year(parts[0]), _month(parts[1]), parts[2].try_cast("int")
    # numbers: the other way round where only that is a date
    return F.coalesce(_made(year, month, on), F.when(parts[3] == "n", _made(year, on, month)))


def instant(c: Column) -> Column:
    """The date and time in a text as an instant; without a time its midnight."""
    return _let(_text(c), _instant)


def _instant(text: Column) -> Column:
    number = lambda x: F.coalesce(x.try_cast("long"), F.lit(0))
    groups = lambda pattern, n: F.array(*(F.regexp_extract(text, pattern, k) for k in range(1, n + 1)))

    def micros(clock: Column) -> Column:
        """Null for impossible times."""
        half, written = F.substring(clock[4], 1, 1), number(clock[0])
        hour = F.when((half == "p") & (written < 12), written + 12).when((half == "a") & (written == 12), F.lit(0)).otherwise(written)
        total = ((hour * 60 + number(clock[1])) * 60 + number(clock[2])) * 1_000_000 + number(F.rpad(clock[3], 6, "0"))
        return F.when((hour < 24) & (number(clock[1]) < 60) & (number(clock[2]) < 60), total)

    def offset(zone: Column) -> Column:
        size = (number(zone[1]) * 60 + number(zone[2])) * 60_000_000
        return F.when(zone[0] == "-", -size).otherwise(size)

    with_clock = text.rlike(CLOCK)
    digits = lambda d: ((number(d[0]) * 60 + number(d[1])) * 60 + number(d[2])) * 1_000_000
    time = F.when(with_clock, _let(groups(CLOCK, 5), micros)).otherwise(_let(groups(COMPACT, 3), digits))
    ahead = F.when(with_clock & text.rlike(ZONE), _let(groups(ZONE, 3), offset)).otherwise(F.lit(0))
    dated = F.when(with_clock, F.regexp_replace(text, r"(?<=[\d:]{4})\s*(?:utc|gmt)?\s*[+-]\d{2}:?\d{2}(?!\d)", " ")).otherwise(text)
    midnight = F.unix_date(_let(dated, _date)).cast("long") * 86_400_000_000
    return F.timestamp_micros(midnight + time - ahead)


def from_millis(c: Column) -> Column:
    """Milliseconds since 1970 as an instant."""
    return F.timestamp_micros((c.cast("string").try_cast("double") * 1000).cast("long"))
