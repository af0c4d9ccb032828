"""Audience and award-type tags from text."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, functions as F

from listingflow import vocabulary as V
from listingflow.functions.text import contains_any, let


def _first_of(low: Column, rules: Iterable[tuple[str, list[str]]]) -> Column:
    """Label of the first rule with a phrase in the text, else null."""
    return F.coalesce(*[F.when(contains_any(low, words), label) for label, words in rules])


def _lower(c: Column, body: Callable[[Column], Column], lowered: bool) -> Column:
    """``body`` of the lower-case text. A column that is ``lowered`` is named as it is, without a lambda."""
    return body(c) if lowered else let(F.lower(c), body)


def _tags(c: Column, rules: dict, match: str, lowered: bool) -> Column:
    def joined(low):
        tags = []
        for tag, (words, guards) in rules.items():
            hit = contains_any(low, words, match)
            if guards:
                hit = hit & ~contains_any(low, guards, match)
            tags.append(F.when(hit, tag))
        return F.concat_ws(", ", *tags)     # skips nulls; null text gives ''

    return _lower(c, joined, lowered)


def _target(c: Column, lowered: bool, both: str, merit_only: str, need_only: str, neither: str) -> Column:
    def label(low):
        merit, need = contains_any(low, V.MERIT_PHRASES), contains_any(low, V.NEED_PHRASES)
        return F.when(merit, F.when(need, both).otherwise(merit_only)) \
            .otherwise(F.when(need, need_only).otherwise(neither))

    return _lower(F.coalesce(c, F.lit("")), label, lowered)


def target_label(c: Column, lowered: bool = False) -> Column:
    """'Merit', 'Need', 'Both' or 'Not specified'."""
    return _target(c, lowered, "Both", "Merit", "Need", "Not specified")


def target_type(c: Column, lowered: bool = False) -> Column:
    """The stored form: 'merit', 'need', or 'both' for everything else."""
    return _target(c, lowered, "both", "merit", "need", "both")


def academic_levels(c: Column, match: str = "substring", lowered: bool = False) -> Column:
    return _tags(c, V.ACADEMIC_LEVELS, match, lowered)


def ethnicities(c: Column, match: str = "substring", lowered: bool = False) -> Column:
    return _tags(c, V.ETHNICITIES, match, lowered)


def gender(c: Column, lowered: bool = False) -> Column:
    """Only an explicit restriction counts; otherwise null."""
    return _lower(c, lambda low: _first_of(low, V.EXPLICIT_GENDERS), lowered)


def parse_eligibility(c: Column) -> Column:
    """All audience fields of one eligibility text, as a struct."""
    def fields(low):
        def keyword(words):
            return F.coalesce(_first_of(low, [(w, [w]) for w in words]), F.lit(""))

        return F.struct(
            F.coalesce(_first_of(low, V.ELIGIBILITY_TARGETS), F.lit("both")).alias("target_type"),
            keyword(V.ELIGIBILITY_ETHNICITIES).alias("ethnicity"),
            F.coalesce(_first_of(low, V.ELIGIBILITY_GENDERS), F.lit("")).alias("gender"),
            keyword(V.ELIGIBILITY_LEVELS).alias("academic_level"),
            contains_any(low, V.ESSAY_WORDS).alias("essay_required"),
            contains_any(low, V.RECOMMENDATION_WORDS).alias("recommendations_required"))

    return let(F.lower(F.coalesce(c, F.lit(""))), fields)


def is_renewable(c: Column, rules: str = "table") -> Column:
    return let(F.lower(F.coalesce(c, F.lit(""))),
               lambda low: contains_any(low, V.RENEWABLE_WORDS[rules]))


def is_listing_page(url: Column, content: Column) -> Column:
    """Listing pages by URL word, or by content word plus an apply-with-details text."""
    def by_content(body):
        return (contains_any(body, V.PAGE_KEYWORDS) & body.contains(V.PAGE_ACTION_WORD)
                & contains_any(body, V.PAGE_DETAIL_WORDS))

    return (let(F.lower(F.coalesce(url, F.lit(""))), lambda u: contains_any(u, V.PAGE_KEYWORDS))
            | let(F.lower(F.coalesce(content, F.lit(""))), by_content))


def error_class(message: Column) -> Column:
    return F.coalesce(_first_of(F.lower(message), V.ERROR_CLASSES), F.lit("other"))
