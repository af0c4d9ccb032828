"""Identifiers that depend on content only, so a re-run gives the same ids."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def content_id(*parts: Column, length: int = 32, lower: bool = False,
               missing: str = "undefined") -> Column:
    """md5 of the parts joined by '-'; a null part reads as ``missing``."""
    text = F.concat_ws("-", *[F.coalesce(p, F.lit(missing)) for p in parts])
    digest = F.md5(F.lower(text) if lower else text)
    return digest if length == 32 else F.substring(digest, 1, length)


def listing_id(name: Column, organization: Column, deadline: Column) -> Column:
    return content_id(name, organization, deadline)


def short_id(name: Column, organization: Column) -> Column:
    """16-digit id; an absent organization reads as 'Unknown'."""
    org = F.coalesce(F.nullif(organization, F.lit("")), F.lit("Unknown"))
    return content_id(name, org, length=16, lower=True)


def _step(acc: Column, unit: Column) -> Column:
    return (acc * 31 + unit).bitwiseAND(0xFFFFFFFF)


def url_hash(c: Column) -> Column:
    """31*h + unit over the UTF-16 units in 32 bits, absolute value in hex."""
    def add(acc, ch):
        point = F.ascii(ch).cast("bigint")
        rest = point - 0x10000
        pair = _step(_step(acc, 0xD800 + F.shiftright(rest, 10)),
                     0xDC00 + rest.bitwiseAND(0x3FF))
        return F.when(point < 0x10000, _step(acc, point)).otherwise(pair)

    magnitude = F.aggregate(F.split(c, ""), F.lit(0).cast("bigint"), add,
                            lambda h: F.when(h >= 1 << 31, (1 << 32) - h).otherwise(h))
    return F.substring(F.lower(F.hex(magnitude)), 1, 8)


def archive_key(scraper: Column, url: Column, fetched_at: Column) -> Column:
    """scraper/yyyy/MM/dd/instant-hash.html; ``fetched_at`` is UTC without zone."""
    stamp = F.date_format(fetched_at, "yyyy-MM-dd'T'HH-mm-ss-SSS'Z'")
    return F.concat(scraper, F.date_format(fetched_at, "/yyyy/MM/dd/"), stamp, F.lit("-"),
                    url_hash(url), F.lit(".html"))
