"""URL helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from listingflow.functions.text import let

_ORIGIN = r"^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def page_url(base: Column, page: Column) -> Column:
    """``base`` for page 0, else with ?page=n."""
    return F.when(page > 0, F.concat(base, F.lit("?page="), page.cast("string"))).otherwise(base)


def _without_dots(p: Column) -> Column:
    """Resolve '.' and '..' segments of an absolute path."""
    def add(done, seg):
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return (F.when(seg == ".", done).when(seg == "..", up)
                .otherwise(F.concat(done, F.array(seg))))

    kept = F.aggregate(F.split(F.substring(p, F.lit(2), F.length(p)), "/"),
                       F.array().cast("array<string>"), add)
    tail = F.when(p.rlike(r"/\.{1,2}\z"), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), tail)


def absolutise(href: Column, base: Column) -> Column:
    """``href`` resolved against ``base``; an absolute address is kept."""
    return let(F.struct(href.alias("href"), base.alias("base")),
               lambda x: _absolute(x["href"], x["base"]))


def _absolute(href: Column, base: Column) -> Column:
    scheme = F.regexp_extract(base, _ORIGIN, 1)
    origin = F.concat(scheme, F.regexp_extract(base, _ORIGIN, 2))
    page = F.regexp_extract(base, r"^[^#]*", 0)
    document = F.regexp_extract(base, r"^[^?#]*", 0)
    here = path(base)
    folder = F.regexp_extract(F.when(here == "", "/").otherwise(here), r"^.*/", 0)
    target = F.when(href.startswith("/"), href).otherwise(F.concat(folder, href))
    target_path = F.regexp_extract(target, r"^[^?#]*", 0)
    target_rest = F.regexp_extract(target, r"^[^?#]*(.*)", 1)
    clean = F.when(target_path.rlike(r"/\.{1,2}(?:/|\z)"), _without_dots(target_path)) \
        .otherwise(target_path)
    return (F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
            .when(href == "", base)
            .when(href.startswith("//"), F.concat(scheme, href))
            .when(href.startswith("#"), F.concat(page, href))
            .when(href.startswith("?"), F.concat(document, href))
            .otherwise(F.concat(origin, clean, target_rest)))
