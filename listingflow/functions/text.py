"""Text cleaning as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import groupby

from pyspark.sql import Column, functions as F

from listingflow import vocabulary as V

# Script sources and Python sources disagree on what white space is.
_WIDE_SPACES = (
    "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
JS_SPACES = "\t\n\x0b\f\r " + _WIDE_SPACES + "\ufeff"
PY_SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85" + _WIDE_SPACES
_WIDE = r"\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
JS_SPACE = rf"[\t-\r {_WIDE}\ufeff]"
PY_SPACE = rf"[\t-\r\x1c-\x1f \x85{_WIDE}]"
QUOTES = "'\""


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row.

    An expression that names its input ten times would otherwise compute it ten
    times wherever the optimizer inlines it, as it does when a filter moves down,
    and nested functions would multiply.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim(c: Column, spaces: str = JS_SPACES) -> Column:
    return F.btrim(c, F.lit(spaces))


def blank_to_null(c: Column) -> Column:
    return not_empty(trim(c))


def not_empty(c: Column) -> Column:
    """``c``, null where it is ''."""
    return F.nullif(c, F.lit(""))


def squeeze_spaces(c: Column, space: str = JS_SPACE, spaces: str = JS_SPACES) -> Column:
    """Runs of white space to one space, trimmed. A lone space is not a match."""
    others = space.replace(" ", "")
    return trim(F.regexp_replace(c, f"{others}{space}*+| {space}++", " "), spaces)


def clean_text(c: Column, quotes: bool = False, commas: bool = False,
               currency: bool = False) -> Column:
    """Drop the chosen characters and trim; null becomes ''."""
    drop = (QUOTES if quotes else "") + ("," if commas else "") + \
        (V.CURRENCY_SYMBOLS if currency else "")
    out = F.coalesce(c, F.lit(""))
    return trim(F.translate(out, drop, "") if drop else out)


def squeeze(c: Column, max_len: int | None = None) -> Column:
    """Single spaces, null becomes ''; longer than ``max_len`` is cut with '...'."""
    out = squeeze_spaces(F.coalesce(c, F.lit("")), PY_SPACE, PY_SPACES)
    if not max_len:
        return out
    return let(out, lambda t: F.when(
        F.length(t) > max_len,
        F.concat(F.substring(t, 1, max_len - 3), F.lit("..."))).otherwise(t))


def _unwrap(c: Column, quote: str) -> Column:
    inner = F.substring(c, F.lit(2), F.greatest(F.length(c) - 2, F.lit(0)))
    return F.when(c.startswith(quote) & c.endswith(quote), inner).otherwise(c)


def unwrap_quotes(c: Column) -> Column:
    """Squeeze, then take off a wrapping pair of double, then of single quotes."""
    return let(let(squeeze(c), lambda t: _unwrap(t, '"')), lambda t: _unwrap(t, "'"))


def _removed(c: Column, phrases: Iterable[str]) -> Column:
    for phrase in phrases:
        c = F.regexp_replace(c, f"(?i)\\Q{phrase}\\E", "")
    return c


def strip_phrases(c: Column, phrases: Iterable[str] = V.REDUNDANT_PHRASES) -> Column:
    """Remove phrases one after the other, ignoring case. The order matters."""
    return squeeze_spaces(_removed(c, phrases))


def strip_steps(phrases: Iterable[str] = V.REDUNDANT_PHRASES) -> list[Callable[[Column], Column]]:
    """``strip_phrases`` in steps that skip texts without their phrases, each for a ``withColumns`` of its own.

    A step takes phrases in a row that hold the same shortest one. A text without that one has none of them.
    """
    phrases = list(phrases)
    inner = [min((q.lower() for q in phrases if q.lower() in p.lower()), key=len) for p in phrases]

    def step(run, hints):
        if not "".join(run).isascii():      # the pattern folds the case of ASCII letters only
            return lambda c: _removed(c, run)
        return lambda c: F.when(contains_any(F.lower(c), hints), _removed(c, run)).otherwise(c)

    runs = [list(run) for _, run in groupby(zip(phrases, inner), key=lambda x: x[1] if inner.count(x[1]) > 1 else None)]
    return [*(step(*map(list, zip(*run))) for run in runs), squeeze_spaces]


def truncate(c: Column, max_len: int | None = V.MAX_TEXT_LENGTH) -> Column:
    """At most ``max_len`` characters, '...' included; all if None."""
    if max_len is None:
        return c
    return let(c, lambda t: F.when(
        F.length(t) > max_len,
        F.concat(trim(F.substring(t, 1, max_len - 3)), F.lit("..."))).otherwise(t))


def non_empty(c: Column, default: str = "unspecified") -> Column:
    return F.coalesce(blank_to_null(c), F.lit(default))


def clean_level(c: Column) -> Column:
    return F.nullif(F.lower(squeeze_spaces(F.regexp_replace(c, "(?i)study", ""))), F.lit(""))


def clip(c: Column, n: int | None) -> Column:
    """The first ``n`` characters; all if None."""
    return c if n is None else F.substring(c, 1, n)


def contains_any(c: Column, terms: Iterable[str], match: str = "substring") -> Column:
    """Whether ``c`` (lower case already) holds any of the terms."""
    terms = list(dict.fromkeys(terms))
    if match == "word":
        words = "|".join(f"\\Q{t}\\E" for t in terms)
        return c.rlike(f"(?<![\\p{{L}}\\p{{N}}])(?:{words})(?![\\p{{L}}\\p{{N}}])")
    # A text with a term also has each term inside that one.
    terms = [t for t in terms if not any(other != t and other in t for other in terms)]
    found = F.lit(False)
    for i, term in enumerate(terms):
        found = c.contains(term) if i == 0 else found | c.contains(term)
    return found
