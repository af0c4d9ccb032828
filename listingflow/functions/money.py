"""Award amounts out of free text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from listingflow import vocabulary as V
from listingflow.functions.text import QUOTES, let, squeeze_spaces

_WORD = "[A-Za-z0-9_]"
_NOT_AMOUNT = f"(?i)(?<!{_WORD})(?:{'|'.join(V.NON_AMOUNT_WORDS)})(?!{_WORD})"
_LEADING = r"^\s*([+-]?(?:Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?))"


def clean_amount(c: Column) -> Column:
    """Without currency symbols, commas, quotes and words such as 'varies'."""
    bare = F.translate(F.coalesce(c, F.lit("")), V.CURRENCY_SYMBOLS + "," + QUOTES, "")
    return squeeze_spaces(F.regexp_replace(bare, _NOT_AMOUNT, ""))


def leading_number(c: Column) -> Column:
    """The number the text starts with, else 0: '1000 - 5000' gives 1000."""
    # Casting text that is no number is slow, so what did not match is not cast.
    return let(F.regexp_extract(c, _LEADING, 1), lambda number: F.coalesce(
        F.when(number != "", number.try_cast("double")), F.lit(0.0)))


def award(c: Column) -> Column:
    return leading_number(clean_amount(c))


def amount_range(c: Column) -> Column:
    """struct<min,max> from the first two digit runs; one run counts for both."""
    runs = F.regexp_extract_all(F.translate(c, ",", ""), F.lit(r"\d+"), F.lit(0))

    def limits(found):
        low = F.get(found, F.lit(0)).try_cast("double")
        high = F.get(found, F.lit(1)).try_cast("double")
        return F.struct(low.alias("min"), F.coalesce(high, low).alias("max"))

    return let(runs, limits)


def amount_max(c: Column) -> Column:
    """The largest amount named in the text."""
    runs = F.regexp_extract_all(c, F.lit(r"\$?([0-9,]+(?:\.[0-9]{2})?)"), F.lit(1))
    digits = F.filter(F.transform(runs, lambda r: F.translate(r, ",", "")), lambda r: r != "")
    return F.array_max(F.transform(digits, lambda r: r.try_cast("double")))
