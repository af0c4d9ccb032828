"""Row filters, renames and defaults over listings, sites and pages."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from listingflow import vocabulary as V
from listingflow.functions import deadlines, links
from listingflow.functions.text import contains_any
from listingflow.schema import DEFAULTS


def drop_expired(df: DataFrame, as_of: str, mode: str = "end_of_day",
                 column: str = "deadline") -> DataFrame:
    return df.filter(~deadlines.is_expired(F.col(column), as_of, mode))


def active(df: DataFrame, as_of: str) -> DataFrame:
    """Active rows whose deadline is open-ended or still to come."""
    return df.filter(F.col("is_active")).transform(drop_expired, as_of, "sql_view")


ACTIVE_COLUMNS = [
    "listing_id", "name", "description", "organization", "min_award", "max_award", "deadline",
    "eligibility", "academic_level", "target_type", "source", "country", "created_at",
]


def active_simple(df: DataFrame, tie: str = "src_seq") -> DataFrame:
    """The short active view, newest first.

    ``tie`` is unique, so that the sort can split a day that holds much of the
    table over several tasks.
    """
    return (df.filter(F.col("is_active")).orderBy(F.desc("created_at"), tie)
            .select(*ACTIVE_COLUMNS))


def enabled(sites: DataFrame, type_: str | None = None) -> DataFrame:
    """Sites not switched off, of one type if given. A missing flag means enabled."""
    kept = sites.filter(F.coalesce(F.col("enabled"), F.lit(True)))
    return kept if type_ is None else kept.filter(F.col("type") == type_)


def exclude_rows(df: DataFrame, type_column: str | None = "award_type",
                 name_column: str = "name") -> DataFrame:
    """Keep rows of the award type with a real title (not blank, header or promotion)."""
    name = F.col(name_column)
    kept = df.filter((F.coalesce(name, F.lit("")) != "") & ~name.isin(V.HEADER_TITLES)
                     & ~contains_any(name, V.PROMO_TITLES))
    if type_column is None:
        return kept
    return kept.filter(F.lower(F.col(type_column)).contains(V.AWARD_TYPE_WORD))


def _host_below(host: Column, domains: list[str]) -> Column:
    return host.isin(domains) | F.exists(
        F.array(*map(F.lit, domains)), lambda d: F.endswith(host, F.concat(F.lit("."), d)))


def in_scope(pages: DataFrame, scope: Mapping = V.CRAWL_SCOPE, url: str = "url",
             content: str | None = None, depth: str | None = None) -> DataFrame:
    """Pages a crawl may keep. Every rule given in ``scope`` must hold."""
    address = F.col(url)
    host, path = links.host(address), links.path(address)
    keep = F.lit(True)
    if scope.get("allowed_domains"):
        keep = keep & _host_below(host, list(scope["allowed_domains"]))
    if scope.get("allowed_suffixes"):
        keep = keep & F.exists(F.array(*map(F.lit, scope["allowed_suffixes"])),
                               lambda s: F.endswith(host, s))
    if scope.get("blocked_domains"):
        keep = keep & ~_host_below(host, list(scope["blocked_domains"]))
    if scope.get("allowed_paths"):
        keep = keep & F.exists(F.array(*map(F.lit, scope["allowed_paths"])),
                               lambda p: F.startswith(path, p))
    if scope.get("blocked_paths"):
        keep = keep & ~F.exists(F.array(*map(F.lit, scope["blocked_paths"])),
                                lambda p: F.startswith(path, p))
    if scope.get("keyword_patterns"):
        text = address if content is None else F.concat_ws(" ", address, F.col(content))
        keep = keep & contains_any(F.lower(text), scope["keyword_patterns"])
    if depth and scope.get("max_depth") is not None:
        keep = keep & (F.col(depth) <= scope["max_depth"])
    return pages.filter(keep)


def host_suffixes(host: Column) -> Column:
    """A host and the domains above it: a.b.org, b.org and org."""
    labels = F.split(host, r"\.")
    return F.when(host != "", F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(
        F.slice(labels, i, F.size(labels)), ".")))


def scope_by_site(pages: DataFrame, sites: DataFrame, domains: DataFrame, site: str = "site", url: str = "url",
                  depth: str | None = None, max_depth: int | None = V.CRAWL_SCOPE["max_depth"]) -> DataFrame:
    """Pages that their site's crawl may keep.

    ``domains`` has site, domain and ``allowed``; of a site's domains that are the page's host or above it the longest
    decides, and a blocked one over an allowed one. A site's own host is allowed to it unless ``domains`` says
    otherwise; other hosts are not. Pages deeper than ``max_depth`` are left out, if they have a depth.

    Each distinct host of a site is expanded to the domains above it and hash-joined with the table, so the work
    follows the hosts and not pages times domains; pages are then joined with the hosts that are in.
    """
    known = domains.select(F.col(site).alias("__site"), F.lower("domain").alias("__domain"), "allowed")
    own = sites.select(F.col(site).alias("__site"), links.host(F.col("url")).alias("__domain"))
    known = known.unionByName(own.where("__domain <> ''").join(known, ["__site", "__domain"], "left_anti")
                              .withColumn("allowed", F.lit(True))) \
        .groupBy("__site", "__domain").agg(F.bool_and(F.coalesce("allowed", F.lit(False))).alias("allowed"))
    host = links.host(F.col(url))
    hosts = pages.select(F.col(site).alias("__site"), host.alias("__host")).distinct()
    longest = hosts.select("*", F.explode(host_suffixes(F.col("__host"))).alias("__domain")).join(known, ["__site", "__domain"]) \
        .groupBy("__site", "__host").agg(F.max_by("allowed", F.length("__domain")).alias("allowed"))
    kept = longest.where("allowed").select(F.col("__site").alias("__in"), "__host")
    if depth is not None and max_depth is not None:
        pages = pages.filter(F.coalesce(F.col(depth), F.lit(0)) <= max_depth)
    return pages.join(kept, (F.col(site) == F.col("__in")) & (host == F.col("__host")), "left_semi")


def rename_fields(df: DataFrame, mapping: Mapping[str, str] = V.FIELD_NAMES) -> DataFrame:
    """Source field names to canonical columns; other columns pass through."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def fill_defaults(df: DataFrame, profile: str = "curate") -> DataFrame:
    """Fill absent values ('' and 0 count as absent) by a default profile.

    Columns the input lacks are added; columns without a default are kept.
    """
    filled = {}
    for name, default in DEFAULTS[profile].items():
        if name not in df.columns:
            filled[name] = F.lit(default)
            continue
        kind, value = df.schema[name].dataType, F.col(name)
        if isinstance(kind, T.StringType):
            blank = F.trim(value) if default == "unspecified" else value
            value = F.when(blank != "", blank)
        elif isinstance(kind, T.NumericType):
            value = F.nullif(value, F.lit(0).cast(kind))
        filled[name] = F.coalesce(value, F.lit(default).cast(kind))
    return df.withColumns(filled)


def export_json(df: DataFrame, *keep: str) -> DataFrame:
    """One JSON text per row without the null fields; ``keep`` columns stay beside it."""
    fields = [F.date_format(f.name, "yyyy-MM-dd'T'HH:mm:ss").alias(f.name)
              if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))
              else F.col(f.name) for f in df.schema.fields]
    return df.select(*keep, F.to_json(F.struct(*fields)).alias("json"))


def import_json(df: DataFrame, schema: T.StructType, column: str = "json") -> DataFrame:
    """The reverse of ``export_json``; a trailing Z in times is accepted."""
    return df.select(F.from_json(column, schema).alias("row")).select("row.*")
