"""The raw archive: fetched payloads partitioned by source and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from listingflow import vocabulary as V
from listingflow.functions.ids import archive_key
from listingflow.schema import ARCHIVE
from listingflow.sources.versioned import VersionedTable, named

PARTITIONS = ["scraper", "year", "month", "day"]


def archive_rows(fetched: DataFrame, content: str = "html") -> DataFrame:
    """Adds the key, date parts and metadata to scraper, url, fetched_at, content.

    ``content_type`` and ``error`` are read where the table has them: a fetch with an error
    message is archived as 'error', with the message and whatever content came.
    """
    def given(name: str, default: str | None = None):
        found = F.col(name) if name in fetched.columns else F.lit(None)
        return F.coalesce(found.cast("string"), F.lit(default))

    at, error = F.col("fetched_at"), given("error")
    size = F.coalesce(F.octet_length(content), F.lit(0))
    metadata = F.struct(
        F.col("url"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"),
        F.col("scraper").alias("scraperName"),
        F.when(error.isNull(), "success").otherwise("error").alias("status"),
        given("content_type", "text/html").alias("contentType"), size.alias("size"),
        error.alias("errorMessage"))
    return fetched.select(
        archive_key(F.col("scraper"), F.col("url"), at).alias("key"), "scraper",
        F.date_format(at, "yyyy").alias("year"), F.date_format(at, "MM").alias("month"),
        F.date_format(at, "dd").alias("day"), "url", at.alias("fetched_at"),
        size.alias("size"), F.to_json(metadata).alias("metadata"),
        F.col(content).alias("content"))


def write_archive(rows: DataFrame, path: str, mode: str = "append") -> None:
    """One folder per source and day.

    Rebalancing keeps files even: small days are combined and a source that
    fetched most of the pages is split over many tasks.
    """
    (rows.hint("rebalance", *PARTITIONS).write.mode(mode)
     .partitionBy(*PARTITIONS).parquet(path))


def read_archive(spark: SparkSession, path: str, scraper: str | None = None,
                 first: str | None = None, last: str | None = None) -> DataFrame:
    """Payloads of one source and a range of days; files of other folders are not read."""
    return between(spark.read.schema(ARCHIVE).parquet(path), scraper, first, last)


def between(rows: DataFrame, scraper: str | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """The part of an archive of one source and a range of days."""
    day = F.concat_ws("-", "year", "month", "day")
    if scraper is not None:
        rows = rows.filter(F.col("scraper") == scraper)
    if first is not None:
        rows = rows.filter((F.col("year") >= first[:4]) & (day >= first))
    if last is not None:
        rows = rows.filter((F.col("year") <= last[:4]) & (day <= last))
    return rows


def _placed(keys: DataFrame) -> DataFrame:
    """Keys with the folder that each names."""
    pattern = r"^(.*)/(\d{4})/(\d{2})/(\d{2})/[^/]*\z"
    return keys.filter(F.col("key").rlike(pattern)).select("key", *[
        F.regexp_extract("key", pattern, i + 1).alias(name) for i, name in enumerate(PARTITIONS)])


def read_by_keys(archive: DataFrame, keys: DataFrame) -> DataFrame:
    """Payloads by key. A key names its folder, so others are pruned when the query runs."""
    return archive.join(_placed(keys), ["key", *PARTITIONS], "left_semi")


def delete_keys(archive: DataFrame, keys: DataFrame) -> DataFrame:
    """The archive without the keys, as a plan; ``delete`` takes them out of a stored archive."""
    return archive.join(_placed(keys), ["key", *PARTITIONS], "left_anti")


def archive_table(spark: SparkSession, path: str) -> VersionedTable:
    """The archive as a table whose folders can be replaced: ``put`` adds rows to new folders, ``delete`` takes keys out."""
    return VersionedTable(spark, path, ARCHIVE, PARTITIONS)


def delete(table: VersionedTable, keys: DataFrame, group: int = 1000) -> dict[str, str]:
    """Deletes keys from a stored archive and returns the folders that failed, with the error; those keep their rows.

    Folders that hold one of the keys are written anew, ``group`` at a time, and readers are switched over by the
    manifest; the files of other folders stay as they are. Only key columns are read to find the folders, and only those
    of folders that a key names.
    """
    held = read_by_keys(table.located(), keys)
    parts = [named(r[0]) for r in held.select("table_part").distinct().collect()]
    return table.rewrite(parts, lambda rows: delete_keys(rows, keys), group)


def tier_report(archive: DataFrame, as_of: str) -> DataFrame:
    """Objects and bytes per storage class by age in days."""
    age = F.datediff(F.lit(as_of).cast("date"), F.col("fetched_at").cast("date"))
    tier = F.lit("standard")
    for days, name in sorted(V.ARCHIVE_TIERS):
        tier = F.when(age >= days, name).otherwise(tier)
    return archive.groupBy(tier.alias("tier")).agg(
        F.count("*").alias("n"), F.sum("size").cast("bigint").alias("bytes"))
