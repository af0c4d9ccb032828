"""Free-text deadlines: completion, parsing and expiry.

``as_of`` is always given, never the clock, so a re-run gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from listingflow import vocabulary as V
from listingflow.functions.text import JS_SPACE, contains_any, let, trim

_NAMES = "|".join(
    "september|sept?" if m == "September" else f"{m.lower()}|{m[:3].lower()}" for m in V.MONTHS)
_MONTH_DAY = f"(?i)(?:{_NAMES}){JS_SPACE}+\\d{{1,2}}"
_MONTH_ONLY = f"(?i)^(?:{_NAMES})\\z"
_SLASH = r"^(\d{1,2})/(\d{1,2})\z"
_NAMED_DATE = rf"(?i)^({_NAMES})\.?(?: +(\d{{1,2}}))?(?:,| ) *(\d{{4}})\z"
_SLASH_DATE = r"^(\d{1,2})/(\d{1,2})/(\d{4})\z"
_ISO_DATE = r"^(\d{4}-\d{2}-\d{2})(?:[T ].*)?\z"
_DAY_FIRST = rf"(?i)^(\d{{1,2}})(?:st|nd|rd|th)? +({_NAMES})\.?,? +(\d{{4}})\z"
_YEAR_FIRST = r"^(\d{4})/(\d{1,2})/(\d{1,2})\z"
_SHORT_YEAR = r"^(\d{1,2})/(\d{1,2})/(\d{2})\z"
_YEAR_ONLY = r"^\d{4}\z"
#: What may stand before and after a date: a weekday, a time of day.
_AROUND = (r"(?i)^(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?\.?,? +"
           r"|(?:,| at)? +\d{1,2}(?::\d{2}){1,2}(?: ?[ap]\.?m\.?)?(?: [a-z]{2,4})?\z")
_ISO_INSTANT = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"
_SHORT_MONTHS = "".join(m[:3].lower() for m in V.MONTHS)


def _month_number(name: Column) -> Column:
    at = F.position(F.lower(F.substring(name, 1, 3)), F.lit(_SHORT_MONTHS))
    return ((at + 2) / 3).cast("int")


def _part(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(c, pattern, group)


def format_deadline(c: Column, year: int) -> Column:
    """Add the year to a deadline that names a month and day only.

    With several month-day pairs the earliest month wins, not the leftmost pair.
    """
    return let(c, lambda t: _with_year(t, year))


def _with_year(c: Column, year: int) -> Column:
    low = F.lower(c)
    complete = (c == "") | low.contains("no deadline") | low.contains("rolling") | \
        c.rlike(r"\d{4}")
    pairs = F.regexp_extract_all(c, F.lit(_MONTH_DAY), F.lit(0))
    first = F.array_min(F.transform(
        pairs, lambda p, i: F.struct(_month_number(p).alias("month"), i.alias("at"),
                                     p.alias("text"))))["text"]
    month_day = F.regexp_replace(first, f"{JS_SPACE}+", " ")
    month_only = F.when(trim(c).rlike(_MONTH_ONLY), trim(c))
    slash = F.when(c.rlike(_SLASH), let(
        F.transform(F.split(c, "/"), lambda n: n.cast("int")), _month_and_day))
    dated = F.concat(F.coalesce(month_day, month_only, slash), F.lit(f", {year}"))
    return F.when(complete, c).otherwise(F.coalesce(dated, c))


def _month_and_day(numbers: Column) -> Column:
    month, day = F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1))
    name = F.element_at(F.array(*map(F.lit, V.MONTHS)), month)
    return F.when(month.between(1, 12) & day.between(1, 31),
                  F.concat_ws(" ", name, day.cast("string")))


def parse_deadline(c: Column) -> Column:
    """The date a deadline names, or null. Month names may be short or long.

    Read are '2025-03-05' with or without a time, 'March 5, 2025', 'March 2025', '5 March 2025',
    '3/5/2025', '3/5/25' (years from 50 on are of the last century), '2025/3/5' and '2025', each
    with a weekday before it or a time of day after it. What names no day is its first.
    """
    return let(trim(c), _date)


def _date(text: Column) -> Column:
    """Null at once for a text without a digit, such as 'Rolling'."""
    return F.when(text.rlike("[0-9]"), let(F.regexp_replace(text, _AROUND, ""), _bare_date))


def _bare_date(t: Column) -> Column:
    day = _part(t, _NAMED_DATE, 2)
    named = F.when(t.rlike(_NAMED_DATE), F.concat_ws(
        "-", _part(t, _NAMED_DATE, 3), _month_number(t).cast("string"),
        F.when(day == "", "1").otherwise(day)))
    slash = F.when(t.rlike(_SLASH_DATE), F.regexp_replace(t, _SLASH_DATE, "$3-$1-$2"))
    iso = F.when(t.rlike(_ISO_DATE), F.substring(t, 1, 10))
    day_first = F.when(t.rlike(_DAY_FIRST), F.concat_ws(
        "-", _part(t, _DAY_FIRST, 3), _month_number(_part(t, _DAY_FIRST, 2)).cast("string"),
        _part(t, _DAY_FIRST, 1)))
    year_first = F.when(t.rlike(_YEAR_FIRST), F.regexp_replace(t, _YEAR_FIRST, "$1-$2-$3"))
    century = F.when(_part(t, _SHORT_YEAR, 3) >= "50", "19").otherwise("20")
    short_year = F.when(t.rlike(_SHORT_YEAR), F.concat(
        century, F.regexp_replace(t, _SHORT_YEAR, "$3-$1-$2")))
    year_only = F.when(t.rlike(_YEAR_ONLY), F.concat(t, F.lit("-1-1")))
    # Only a date that begins with its month's name begins with other than a digit.
    numeric = F.coalesce(iso, slash, day_first, year_first, short_year, year_only)
    return F.when(F.substring(t, 1, 1) > "9", named).otherwise(numeric).try_cast("date")


def parse_instant(c: Column) -> Column:
    """Like ``parse_deadline``, keeping the time of day of an ISO instant."""
    def instant(t):
        exact = F.when(t.rlike(_ISO_INSTANT), t.try_cast("timestamp").cast("timestamp_ntz"))
        return F.coalesce(exact, _date(t).cast("timestamp_ntz"))
    return let(trim(c), instant)


def is_expired(c: Column, as_of: str, mode: str = "end_of_day") -> Column:
    """Whether the deadline has passed at ``as_of`` ('yyyy-MM-dd[ HH:mm:ss]').

    end_of_day  a deadline holds until its day ends; open-ended or unreadable
                text never expires
    instant     a deadline passes when its day starts; unreadable text never does
    sql_view    a deadline must lie after the day of ``as_of``; unreadable text
                that is not open-ended has expired
    """
    today = F.lit(as_of[:10]).cast("date")
    if mode == "instant":
        now = F.lit(as_of).cast("timestamp_ntz")
        return F.coalesce(parse_instant(c) < now, F.lit(False))
    if mode == "sql_view":
        return let(c, lambda t: ~(
            t.isNull() | (t == "") | contains_any(F.lower(t), V.OPEN_ENDED_VIEW)
            | F.coalesce(parse_deadline(t) > today, F.lit(False))))
    if mode != "end_of_day":
        raise ValueError(f"unknown expiry mode {mode!r}")
    return let(c, lambda t: F.coalesce(
        ~contains_any(F.lower(t), V.OPEN_ENDED) & (parse_deadline(t) < today), F.lit(False)))
