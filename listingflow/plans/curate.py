"""Whole jobs: curate a batch, migrate an export, clean up, run all sources."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from listingflow import vocabulary as V
from listingflow.functions import ids, text
from listingflow.functions.deadlines import is_expired
from listingflow.operators.dedupe import dedupe_first
from listingflow.operators.filters import drop_expired, fill_defaults
from listingflow.operators import rollups
from listingflow.operators.merge import new_only, overlay, upsert
from listingflow.session import observed, stored
from listingflow.sources.tables import Registry, conform, union_sources
from listingflow.sources.versioned import VersionedTable, named


#: What a detail page may tell better than a list of results.
DETAIL_COLUMNS = ("organization", "academic_level", "eligibility", "min_award", "max_award", "renewable", "deadline",
                  "geographic_restrictions", "apply_url")


def with_details(listings: DataFrame, details: DataFrame, max_chars: int | None = V.MAX_TEXT_LENGTH) -> DataFrame:
    """Listings with what their detail pages say, by address; what a page leaves empty stays as it was.

    The eligibility of a page loses its stock phrases and is cut to ``max_chars`` (None: not cut). Of several details of
    one address the one of least ``page_id`` is taken, of any if there is none.
    """
    columns = [c for c in DETAIL_COLUMNS if c in details.columns and c in listings.columns]
    order = [F.col("page_id")] if "page_id" in details.columns else [F.struct(*columns)]
    one = dedupe_first(details.filter("url is not null"), ["url"], order)
    stripped = {"eligibility": lambda c: text.strip_phrases(c) if max_chars is None
                else text.truncate(text.strip_phrases(c), max_chars)}
    return overlay(listings, one, "url", columns, clean=stripped)


def curate(df: DataFrame, target: DataFrame, as_of: str, job_id: str) -> DataFrame:
    """A batch against the table: expire, fill, identify, look up, count.

    One row per listing id. ``inserted`` is 1 where the first row of the id is
    new to ``target``; every further row of the id, or all of them where it was
    known, count as ``updated``. The batch is shuffled once, by id, for both the
    copies and the lookup: copies combine map-side, so an id with a third of the
    batch costs one row per task.
    """
    kept = drop_expired(df, as_of)
    identified = kept.withColumn("listing_id", ids.listing_id(
        F.col("name"), F.col("organization"), F.col("deadline")))
    filled = fill_defaults(identified, "curate").withColumn("job_id", F.lit(job_id))
    firsts = dedupe_first(filled, ["listing_id"], [F.col("src_seq")],
                          rows=F.count("*"))
    known = target.select("listing_id", F.lit(1).alias("__known"))
    inserted = F.when(F.col("__known").isNull(), 1).otherwise(0)
    return (firsts.join(known, "listing_id", "left")
            .withColumn("inserted", inserted)
            .withColumn("updated", F.col("rows") - F.col("inserted"))
            .drop("__known", "rows"))


def curate_metrics(curated: DataFrame) -> DataFrame:
    return curated.groupBy("job_id").agg(
        F.sum(F.col("inserted") + F.col("updated")).alias("processed"),
        F.sum("inserted").cast("bigint").alias("inserted"),
        F.sum("updated").alias("updated"))


def migrate(export: DataFrame, target: DataFrame, as_of: str,
            profile: str = "migrate_items", mode: str = "end_of_day") -> DataFrame:
    """Rows of an export to add: not known yet, not expired, defaults filled."""
    fresh = drop_expired(new_only(export, target), as_of, mode)
    return fill_defaults(fresh, profile)


def migrate_into(target: DataFrame, export: DataFrame, as_of: str, sites: DataFrame, jobs: DataFrame,
                 profile: str = "migrate_items", mode: str = "end_of_day") -> tuple[DataFrame, DataFrame]:
    """The whole migration: (the table with an ``action`` per row, figures and their numbers).

    Rows of the export that are new and not expired are upserted; the figures are what was scanned, migrated and
    skipped, and the totals of the table after it, of sites and of jobs. Ids are unique in the export.
    """
    known = stored(conform(target), "target")
    added = stored(conform(migrate(export, known, as_of, profile, mode)), "migrated")
    merged = stored(upsert(known, added, "listing_id", as_of), "merged")
    counted = migration_summary(export, known, as_of, mode).unpivot([], ["scanned", "migrated", "skipped"], "figure", "n")
    return merged, counted.unionByName(rollups.totals(merged, sites, jobs))


def migration_summary(export: DataFrame, target: DataFrame, as_of: str,
                      mode: str = "end_of_day") -> DataFrame:
    """scanned, migrated and skipped (known or expired) in one pass over the export."""
    known = target.select("listing_id", F.lit(True).alias("__known"))
    flagged = export.select("listing_id", "deadline").join(known, "listing_id", "left")
    taken = F.col("__known").isNull() & ~is_expired(F.col("deadline"), as_of, mode)
    migrated = F.count_if(taken)
    return flagged.agg(F.count("*").alias("scanned"), migrated.alias("migrated"),
                       (F.count("*") - migrated).alias("skipped"))


def cleanup(df: DataFrame, as_of: str) -> DataFrame:
    """Every row with its ``expired`` flag; what is flagged is to be deleted."""
    return df.withColumn("expired", is_expired(F.col("deadline"), as_of))


def cleanup_table(table: VersionedTable, as_of: str, group: int = 1000) -> DataFrame:
    """Deletes the expired rows of a stored table; gives part, scanned, expired, deleted and error of every part.

    The parts are counted by a scan of their deadlines. Those with an expired row are written anew without them, ``group``
    at a time, and readers switched over; the files of others stay as they are. A part that cannot be
    rewritten keeps its rows and has the error.
    """
    counts = cleanup(table.located().select("deadline", "table_part"), as_of).groupBy("table_part").agg(
        F.count("*").alias("scanned"), F.count_if("expired").alias("expired")).collect()
    found = {named(r["table_part"]): (r["scanned"], r["expired"]) for r in counts}
    failures = table.rewrite(sorted(p for p, (_, expired) in found.items() if expired),
                             lambda rows: rows.filter(~is_expired(F.col("deadline"), as_of)), group)
    report = [(p, scanned, expired, 0 if p in failures else expired, failures.get(p)) for p, (scanned, expired) in found.items()]
    return table.spark.createDataFrame(report, "part string, scanned bigint, expired bigint, deleted bigint, error string")


def run_all(spark: SparkSession, registry: Registry, data: str, names: Iterable[str] | None = None,
            store: bool = False) -> tuple[DataFrame | None, dict[str, str]]:
    """(listings of all sources that could be read, failures by name); see ``Registry.read_all``."""
    listings, failures = registry.read_all(spark, data, names, store)
    return (union_sources(listings.values()) if listings else None), failures


def ingest(spark: SparkSession, registry: Registry, data: str, target: DataFrame, as_of: str,
           job_id: str, details: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """All sources into the table: read side by side, overlay with ``details`` of their pages if given, curate, upsert.

    Returns the table with an ``action`` per row, and counts by source: 'completed' with
    inserted and updated listings, or 'failed'. A source's copies of a listing that another
    source gave first count as that one's updates. ``src_seq`` tells rows of all sources apart. Counts are observed
    while the curated batch is written.
    """
    schema = "source string, status string, inserted bigint, updated bigint"
    listings, failures = registry.read_all(spark, data, store=True)
    failed = [(name, "failed", 0, 0) for name in failures]
    known = stored(conform(target), "target")
    if not listings:
        return known.withColumn("action", F.lit("keep")), spark.createDataFrame(failed, schema)
    seen = Observation()
    sums = [F.sum(F.when(F.col("source") == name, F.col(c)).otherwise(0)).cast("bigint").alias(f"{c} {i}")
            for i, name in enumerate(listings) for c in ("inserted", "updated")]
    rows = union_sources(listings.values())
    rows = rows if details is None else with_details(rows, details)
    curated = stored(curate(rows, known, as_of, job_id).observe(seen, *sums), "curated")
    counts = observed(seen)
    done = [(name, "completed", *(counts.get(f"{c} {i}", 0) for c in ("inserted", "updated"))) for i, name in enumerate(listings)]
    merged = upsert(known, curated.select(*known.columns), "listing_id", as_of)
    return merged, spark.createDataFrame(done + failed, schema)
