"""Listing extraction from a table of HTML pages.

``select_rows`` is the only step outside the JVM: it reads elements off each
page in Arrow batches, no shuffle. All cleaning and classifying after it is
Column expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from listingflow import vocabulary as V
from listingflow.functions import classify, ids, money
from listingflow.functions import text as tx
from listingflow.functions.deadlines import format_deadline
from listingflow.functions.links import absolutise
from listingflow.sources import markup


@dataclass(frozen=True)
class Field:
    """What to read below a row element.

    selectors   tried in order; the first that yields non-blank text counts.
                An empty tuple reads the row element itself
    take        'text', or the name of an attribute
    pick        'first' or 'last' match, 'joined' text of all, or 'each' (array)
    then        read the elements that fit this selector below the match instead
    sibling     read the element right after the row instead, if it has this tag
    """

    selectors: tuple[str, ...] = ()
    take: str = "text"
    pick: str = "first"
    then: str | None = None
    sibling: str | None = None


def field(*selectors: str, **options) -> Field:
    return Field(selectors, **options)


def _reader(spec: Field) -> Callable[[markup.Page, int], str | list[str] | None]:
    """What reads the field of a row."""
    take, then = spec.take, spec.then

    def value(page, node):
        if then:
            inner = page.select(then, node)
            if take == "text":
                return "".join([page.text(i) for i in inner])
            return page.attribute(inner[0], take) if inner else None
        return page.text(node) if take == "text" else page.attribute(node, take)

    def below(page, row):
        if not spec.selectors:
            return value(page, row)
        for selector in spec.selectors:
            nodes = page.select(selector, row)
            if not nodes:
                continue
            if spec.pick == "joined":
                out = "".join([value(page, n) or "" for n in nodes])
            else:
                out = value(page, nodes[0 if spec.pick == "first" else -1])
            if out is not None and (len(spec.selectors) == 1 or out.strip()):
                return out
        return None

    def each(page, row):
        return [value(page, n) or "" for n in page.select(spec.selectors[0], row)] if spec.selectors else value(page, row)

    read = each if spec.pick == "each" else below
    if not spec.sibling:
        return read

    def beside(page, row):
        after = page.following(row)
        if after is None or page.tag(after) != spec.sibling:
            return [] if spec.pick == "each" else None
        return read(page, after)
    return beside


def _spark_type(spec: Field) -> T.DataType:
    return T.ArrayType(T.StringType()) if spec.pick == "each" else T.StringType()


def _arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, _arrow_type(f.dataType)) for f in kind.fields])
    return pa.int32() if isinstance(kind, T.IntegerType) else pa.string()


def _read_pages(pages: DataFrame, kept: list[str], read: Callable, added: T.StructType,
                *inputs: str) -> DataFrame:
    """``kept`` columns followed by ``added``: ``read(*inputs)`` yields tuples of the latter."""
    schema = T.StructType([pages.schema[k] for k in kept] + added.fields)
    types = [_arrow_type(f.dataType) for f in added.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = zip(*[batch.column(i).to_pylist() for i in inputs])
            source, rows = [], []
            for at, value in enumerate(values):
                for row in read(*value):
                    source.append(at)
                    rows.append(row)
            columns = list(zip(*rows)) if rows else [()] * len(types)
            arrays = [batch.column(k).take(pa.array(source, pa.int32())) for k in kept]
            arrays += [pa.array(c, t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return pages.select(*dict.fromkeys([*kept, *inputs])).mapInArrow(run, schema)


def select_rows(pages: DataFrame, row_selector: str, fields: Mapping[str, Field],
                keep: tuple[str, ...] = ("page_id",), html: str = "html",
                page_fields: Mapping[str, Field] | None = None) -> DataFrame:
    """One row per element that fits ``row_selector``, with its ``fields``.

    Given ``page_fields`` (may be empty) it is one row per page: these fields,
    and ``rows``, an array of structs in document order, so that page-level
    logic needs no grouping afterwards.
    """
    per_row = T.StructType([T.StructField("pos", T.IntegerType())] + [
        T.StructField(n, _spark_type(f)) for n, f in fields.items()])

    readers = [_reader(f) for f in fields.values()]
    page_readers = [_reader(f) for f in (page_fields or {}).values()]

    def rows_of(page):
        return [(i, *[read(page, e) for read in readers]) for i, e in enumerate(page.select(row_selector))]

    if page_fields is None:
        return _read_pages(pages, list(keep), lambda text: rows_of(markup.Page(text)), per_row,
                           html)

    def whole(text):
        page = markup.Page(text)
        yield rows_of(page), *[read(page, 0) for read in page_readers]

    per_page = T.StructType([T.StructField("rows", T.ArrayType(per_row))] + [
        T.StructField(n, _spark_type(f)) for n, f in page_fields.items()])
    return _read_pages(pages, list(keep), whole, per_page, html)


def select_labelled(pages: DataFrame, row_selector: str, label: Field,
                    wanted: Mapping[str, tuple[tuple[str, ...], Field]], keep: tuple[str, ...] = ("page_id",),
                    html: str = "html", page_fields: Mapping[str, Field] | None = None) -> DataFrame:
    """One row per page: what ``wanted`` says of the last row with one of its labels, then ``page_fields``.

    Labels are compared trimmed and in lower case. A column is null where no row has one of its labels.
    """
    label_of = _reader(label)
    columns = [(labels, _reader(f)) for labels, f in wanted.values()]
    page_readers = [_reader(f) for f in (page_fields or {}).values()]

    def read(text):
        page = markup.Page(text)
        last = {}
        for row in page.select(row_selector):
            said = label_of(page, row)
            if said is not None:
                last[said.strip(tx.JS_SPACES).lower()] = row
        values = []
        for labels, value_of in columns:
            row = max((last[name] for name in labels if name in last), default=None)
            values.append(None if row is None else value_of(page, row))
        yield *values, *[read(page, 0) for read in page_readers]

    added = T.StructType([T.StructField(n, _spark_type(f)) for n, f in [
        *((n, f) for n, (_, f) in wanted.items()), *(page_fields or {}).items()]])
    return _read_pages(pages, list(keep), read, added, html)


def _pages_with(pages: DataFrame, html: str, *marks: str) -> DataFrame:
    """Leave out pages that cannot match before they are sent to Python."""
    return pages.filter(tx.contains_any(F.lower(F.col(html)), marks))


def _clean(c: Column) -> Column:
    return tx.clean_text(c, quotes=True)


def _text_or(c: Column, default: str | Column) -> Column:
    default = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(tx.blank_to_null(c), default)


def _prose(c: Column, max_chars: int | None) -> Column:
    return tx.truncate(tx.strip_phrases(tx.truncate(c, max_chars)), max_chars)


def _audience(text: Column) -> dict[str, Column]:
    return {
        "target_type": classify.target_type(text),
        "ethnicity": tx.non_empty(classify.ethnicities(text)),
        "gender": tx.non_empty(classify.gender(text)),
    }


# --- listings in table rows ---------------------------------------------------------

ROW_FIELDS = {
    "cells": field("td", pick="each"),
    "links": field("td", pick="each", then="a"),
    "name_marks": field("td", pick="each", then=".detailPageLink"),
    "hrefs": field("td", pick="each", then="a", take="href"),
    "amount_marks": field("td", pick="each", then=".table-Numeric"),
}


def extract_rows(pages: DataFrame, base: str, year: int, fallback_source: str,
                 html: str = "html", keep: tuple[str, ...] = ("page_id",),
                 max_chars: int | None = V.MAX_TEXT_LENGTH) -> DataFrame:
    """Listings from table rows of five cells: name, level, type, amount, deadline.

    Cells count by their place among the row's ``td``, whatever else the row has. All
    links of the name cell make the name, the first gives the address. The name
    cell may go on with 'Organization: ...' and 'Purposes: ...'. Rows of other
    award types and header rows are left out. Prose is cut to ``max_chars`` (None: not).
    """
    rows = select_rows(_pages_with(pages, html, "<td"), "table tr", ROW_FIELDS, keep, html)
    cell = [F.get("cells", F.lit(i)) for i in range(5)]
    name = F.coalesce(tx.blank_to_null(F.get("links", F.lit(0))),
                      tx.trim(F.get("name_marks", F.lit(0))))
    listed = (rows.filter(F.size("cells") >= 5)
              .withColumn("raw_name", name)
              .filter(F.lower(cell[2]).contains(V.AWARD_TYPE_WORD)
                      & (F.coalesce(F.col("raw_name"), F.lit("")) != "")
                      & ~F.col("raw_name").isin(V.HEADER_TITLES)))
    org = F.regexp_extract(cell[0], r"(?i)Organization:\s*(.+?)(?:\n|<br>|Purposes:)", 1)
    purposes = tx.trim(F.regexp_extract(cell[0], r"(?i)Purposes:\s*(.+?)\z", 1))
    parsed = listed.withColumns({
        "organization": _clean(org),
        "purposes": purposes,
        "amount": _text_or(F.get("amount_marks", F.lit(3)), _text_or(cell[3], V.MISSING_AMOUNT_TABLE)),
        "raw_deadline": _text_or(cell[4], V.MISSING_DEADLINE),
    })
    offered = F.concat(F.lit("Scholarship offered by "),
                       _text_or(F.col("organization"), fallback_source))
    described = parsed.withColumn("description", F.when(
        F.col("purposes") != "", tx.truncate(_clean(F.col("purposes")), max_chars)).otherwise(offered))
    # Bound once, since several columns are made of them.
    described = described.withColumns({
        "award": money.award(F.col("amount")), "audience": F.concat_ws(" ", "raw_name", "description", "purposes")})
    href = F.get("hrefs", F.lit(0))
    link = F.when(F.coalesce(href, F.lit("")) == "", "").when(href.startswith("http"), href) \
        .otherwise(F.concat(F.lit(base), href))
    return described.select(
        *keep, "pos",
        _clean(F.col("raw_name")).alias("name"),
        _clean(format_deadline(F.col("raw_deadline"), year)).alias("deadline"),
        link.alias("url"),
        _prose(_clean(F.col("description")), max_chars).alias("description"),
        "organization",
        F.coalesce(tx.clean_level(cell[1]), F.lit("")).alias("academic_level"),
        *[c.alias(n) for n, c in _audience(F.col("audience")).items()],
        F.col("award").alias("min_award"), F.col("award").alias("max_award"))


# --- listings in blocks ----------------------------------------------------------------

BLOCK_FIELDS = {
    "summary": field(".scholarship-summary", take="class"),
    "body": field(".scholarship-description", take="class"),
    "amount": field(".scholarship-summary .lead strong", pick="joined"),
    "last_deadline": field(".scholarship-summary p", pick="last", then="strong"),
    "name": field(".scholarship-description h4 a", pick="joined"),
    "href": field(".scholarship-description h4 a", take="href"),
    "paragraphs": field(".scholarship-description p", pick="each"),
    "paragraph_classes": field(".scholarship-description p", take="class", pick="each"),
    "items": field(".scholarship-description ul.fa-ul li", pick="each", then=".trim"),
    "icons": field(".scholarship-description ul.fa-ul li", take="class", pick="each", then="i"),
}


def _routed(kind: str) -> Column:
    """Item texts whose icon is of one kind, in order, joined by ' | '."""
    pairs = F.arrays_zip("items", "icons")

    def fits(p):
        place = p["icons"].contains("fa-map-marker")
        level = p["icons"].contains("fa-graduation-cap")
        test = {"place": place, "level": level & ~place, "other": ~place & ~level}[kind]
        return test & (tx.trim(p["items"]) != "") & ~p["items"].contains(V.NO_RESTRICTION)

    return F.array_join(F.transform(F.filter(pairs, fits), lambda p: tx.trim(p["items"])), " | ")


def extract_blocks(pages: DataFrame, year: int, html: str = "html",
                   keep: tuple[str, ...] = ("page_id",), max_chars: int | None = V.MAX_TEXT_LENGTH) -> DataFrame:
    """Listings from ``.row`` blocks that hold a summary and a description. Prose is cut to ``max_chars`` (None: not)."""
    rows = select_rows(_pages_with(pages, html, "scholarship-summary"), ".row", BLOCK_FIELDS,
                       keep, html)
    name = tx.trim(F.col("name"))
    listed = (rows.filter(F.col("summary").isNotNull() & F.col("body").isNotNull())
              .filter((F.coalesce(name, F.lit("")) != "")
                      & ~tx.contains_any(name, V.PROMO_TITLES)))
    shown = F.filter(F.arrays_zip("paragraphs", "paragraph_classes"),
                     lambda p: ~p["paragraph_classes"].contains("visible-xs"))
    parsed = listed.withColumns({
        "prose": F.coalesce(tx.trim(F.get(shown, F.lit(0))["paragraphs"]), F.lit("")),
        "eligibility": _routed("other"),
        "levels": _routed("level"),
        "places": _routed("place"),
        "raw_deadline": _text_or(F.col("last_deadline"), V.MISSING_DEADLINE),
    })
    # Bound once, since several columns are made of them.
    parsed = parsed.withColumns({
        "award": money.award(_text_or(F.col("amount"), V.MISSING_AMOUNT_BLOCK)),
        "audience": F.concat_ws(" ", "name", "prose", "eligibility")})
    return parsed.select(
        *keep, "pos", _clean(F.col("name")).alias("name"),
        _clean(format_deadline(F.col("raw_deadline"), year)).alias("deadline"),
        F.coalesce("href", F.lit("")).alias("url"),
        _prose(_clean(F.col("prose")), max_chars).alias("description"),
        _prose(_clean(F.col("eligibility")), max_chars).alias("eligibility"),
        F.coalesce(tx.clean_level(F.col("levels")), F.lit("")).alias("academic_level"),
        _clean(F.col("places")).alias("geographic_restrictions"),
        *[c.alias(n) for n, c in _audience(F.col("audience")).items()],
        F.col("award").alias("min_award"), F.col("award").alias("max_award"))


# --- details from label / value pairs -----------------------------------------------------

def _if_given(c: Column, body) -> Column:
    """``body`` of a value, null without one."""
    return tx.let(c, lambda v: F.when(v.isNotNull(), body(v)))


LABEL_ROW = "#scholarshipDetailContent table tr"
LABEL = field("td")
_LABEL_VALUE = field("td", pick="last")
LABEL_FIELDS = {
    **{c: (labels, _LABEL_VALUE) for c, labels in {
        "organization": ("organization",), "level": ("level of study",), "eligibility": ("qualifications",),
        "funds": ("funds",), "duration": ("duration",), "deadline": ("deadline",),
        "places": tuple(V.LOCATION_LABELS), "to_apply": ("to apply",)}.items()},
    "more": (("for more information",), field("td:last-child a", take="href")),
}


def extract_labels(pages: DataFrame, year: int, html: str = "html",
                   keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """One detail row per page from label/value table rows; absent labels stay null."""
    rows = select_labelled(_pages_with(pages, html, "<td"), LABEL_ROW, LABEL, LABEL_FIELDS, keep, html)
    value = lambda name: tx.trim(F.col(f"said.{name}"))
    said = rows.select(*keep, F.struct(*LABEL_FIELDS).alias("said"))
    apply_text = tx.not_empty(F.regexp_extract(value("to_apply"), r"(https?://\S+)", 1))
    # Bound once, since two columns show it.
    bound = said.withColumn("award", _if_given(value("funds"), money.award))
    return bound.select(
        *keep, value("organization").alias("organization"),
        tx.clean_level(value("level")).alias("academic_level"),
        value("eligibility").alias("eligibility"),
        F.col("award").alias("min_award"), F.col("award").alias("max_award"),
        _if_given(value("duration"), lambda v: classify.is_renewable(v, "table"))
        .alias("renewable"),
        format_deadline(value("deadline"), year).alias("deadline"),
        value("places").alias("geographic_restrictions"),
        F.coalesce(apply_text, tx.not_empty(F.col("said.more"))).alias("apply_url"))


TERM_ROW = "#scholarship-view .callout-details dl dt, #scholarship-view .callout-misc dl dt"
TERM_PAGE_FIELDS = {
    "description": field("#description p"),
    "sponsor": field(".sponsor p", pick="joined"),
    "apply_url": field('#description a[href*=".pdf"], #description a[href*="apply"], '
                       '#description a[href*="application"]', take="href"),
}
TERM = field()
TERM_FIELDS = {c: ((label,), field(sibling="dd")) for c, label in {
    "deadline": "deadline:", "renewable": "renewable", "min_award": "min. award:", "max_award": "max. award:",
    "level": "enrollment level:", "country": "country:", "major": "major:"}.items()}


def extract_terms(pages: DataFrame, year: int, html: str = "html",
                  keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """One detail row per page from definition lists, sponsor and apply link."""
    rows = select_labelled(_pages_with(pages, html, "<dt", "scholarship-view"), TERM_ROW, TERM, TERM_FIELDS, keep, html,
                           TERM_PAGE_FIELDS)
    said = rows.select(*keep, F.struct(*TERM_FIELDS, *TERM_PAGE_FIELDS).alias("said"))
    value = lambda name: tx.trim(F.col(f"said.{name}"))
    sponsor = tx.blank_to_null(F.col("said.sponsor"))
    return said.select(
        *keep, tx.blank_to_null(F.col("said.description")).alias("description"),
        format_deadline(value("deadline"), year).alias("deadline"),
        _if_given(value("renewable"), lambda v: classify.is_renewable(v, "list"))
        .alias("renewable"),
        _if_given(value("min_award"), money.award).alias("min_award"),
        _if_given(value("max_award"), money.award).alias("max_award"),
        _if_given(value("level"),
                  lambda v: F.coalesce(tx.clean_level(v), F.lit(""))).alias("academic_level"),
        _if_given(value("country"), _clean).alias("country"),
        _if_given(value("major"), _clean).alias("eligibility"),
        _if_given(sponsor, lambda v: _clean(F.substring_index(v, "\n", 1)))
        .alias("organization"),
        tx.not_empty(F.col("said.apply_url")).alias("apply_url"))


# --- broad and configured extraction ------------------------------------------------------

def _broad_selector(terms) -> str:
    return ", ".join(f'{tag}[class*="{term}" i]' for tag in ("div", "tr", "li") for term in terms)


def extract_broad(pages: DataFrame, base: Column, terms=tuple(V.BROAD_CLASS_TERMS),
                  html: str = "html", keep: tuple[str, ...] = ("page_id",),
                  lengths: Mapping[str, int] = V.CLIP_LENGTHS) -> DataFrame:
    """Listings from any div, tr or li whose class holds one of the terms. Texts are cut to ``lengths`` by column (empty: none)."""
    fields = {n: Field(tuple(s)) for n, s in V.BROAD_SELECTORS.items()}
    fields["href"] = field("a", take="href")
    rows = select_rows(_pages_with(pages, html, *terms), _broad_selector(terms), fields, keep,
                       html)
    name = tx.trim(F.col("name"))
    limits = money.amount_range(F.col("amount"))
    return (rows.filter(F.coalesce(name, F.lit("")) != "")
            .select(*keep, "pos",
                    ids.short_id(name, tx.trim(F.col("organization"))).alias("listing_id"),
                    tx.clip(name, lengths.get("name")).alias("name"),
                    tx.blank_to_null(F.col("organization")).alias("organization"),
                    limits["min"].alias("min_award"), limits["max"].alias("max_award"),
                    tx.blank_to_null(F.col("deadline")).alias("deadline"),
                    tx.clip(tx.blank_to_null(F.col("description")),
                            lengths.get("description")).alias("description"),
                    F.when(F.coalesce("href", F.lit("")) != "",
                           absolutise(F.col("href"), base)).alias("url")))


SPEC_FIELDS = {"title": "name", "amount": "amount", "deadline": "deadline",
               "description": "description", "organization": "organization"}
SPEC_SCHEMA = "map<string,string>"
#: Up to so many sites with so many bytes of selectors are sent to every executor.
BROADCAST_SITES, BROADCAST_BYTES = 10_000, 32 << 20
_SALTS = 64


def _with_spec(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """Pages with their site's selectors; a large table of sites is joined with hot sites split."""
    spec = sites.select("site", F.from_json("selectors", SPEC_SCHEMA).alias("__spec"))
    size = sites.agg(F.count("*").alias("n"), F.sum(F.octet_length("selectors")).alias("bytes")).first()
    if size["n"] <= BROADCAST_SITES and (size["bytes"] or 0) <= BROADCAST_BYTES:
        return pages.join(F.broadcast(spec), "site")
    salted = pages.withColumn("__salt", F.pmod(F.xxhash64(*pages.columns), F.lit(_SALTS)).cast("int"))
    copies = spec.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return salted.join(copies, ["site", "__salt"]).drop("__salt")


def extract_by_spec(pages: DataFrame, sites: DataFrame, html: str = "html",
                    keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Page fields by the selectors of the page's site.

    ``sites`` has one row per ``site`` with ``selectors``, a JSON object; it is
    joined on ``site``, so each page carries its own selectors to the reader. The
    pages are not shuffled where the table of sites is small, by its measured size.
    """
    names = [*SPEC_FIELDS.values(), "href"]

    def read(text, selectors):
        page, selectors = markup.Page(text), dict(selectors)
        values = [_reader(Field((s,)))(page, 0) if (s := selectors.get(n)) else None
                  for n in SPEC_FIELDS]
        link = selectors.get("scholarshipLinks")
        yield *values, _reader(Field((link,), take="href"))(page, 0) if link else None

    added = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = _read_pages(_with_spec(pages, sites), [*keep, "site"], read, added, html, "__spec")
    return raw.select(*keep, "site", *[tx.blank_to_null(F.col(n)).alias(n) for n in names])


def page_titles_and_links(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Per page the first non-empty title and the first link, made absolute."""
    fields = {"title": field("h1", "title"), "href": field("a[href]", take="href")}
    rows = select_rows(pages, "html", fields, ("page_id", url), html)
    return rows.select("page_id", tx.squeeze(F.col("title")).alias("title"),
                       absolutise(F.col("href"), F.col(url)).alias("link"))
