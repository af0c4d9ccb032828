"""Counts and totals over listings, jobs and applications."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from listingflow import vocabulary as V
from listingflow.functions.classify import error_class
from listingflow.functions.text import contains_any
from listingflow.operators.dedupe import keep_latest


def by_type(df: DataFrame, as_of: str) -> DataFrame:
    """Per target type over active rows: counts, mean and sum of the top award."""
    today = F.lit(as_of[:10]).cast("date")
    deadline = F.col("deadline")
    still_open = F.coalesce(
        (F.col("deadline_date") > today) | deadline.isNull() | (deadline == "")
        | contains_any(F.lower(deadline), V.OPEN_ENDED_ROLLUP), F.lit(False))
    return (df.filter(F.col("is_active")).groupBy("target_type").agg(
        F.count("*").alias("total_count"),
        F.count_if(still_open).alias("active_count"),
        F.round(F.avg("max_award"), 2).alias("avg_max_award"),
        F.round(F.sum("max_award"), 2).alias("total_award_pool")))


def type_counts(df: DataFrame) -> DataFrame:
    return (df.filter(F.col("target_type").isNotNull())
            .groupBy("target_type").agg(F.count("*").alias("n")))


def totals(listings: DataFrame, sites: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row per figure: listings, active listings, sites, jobs."""
    rows = listings.agg(F.count("*").alias("listings"),
                        F.count_if("is_active").alias("active_listings"))
    figures = rows.unpivot([], ["listings", "active_listings"], "figure", "n")
    for name, table in (("sites", sites), ("jobs", jobs)):
        figures = figures.union(table.agg(F.count("*").alias("n")).select(F.lit(name), "n"))
    return figures


def run_summary(runs: DataFrame) -> DataFrame:
    """Counters of successful runs and the number of errors of failed ones."""
    ok = F.col("success")
    return runs.agg(
        F.sum(F.when(ok, F.col("records_found")).otherwise(0)).alias("total_found"),
        F.sum(F.when(ok, F.col("records_inserted")).otherwise(0)).alias("total_inserted"),
        F.sum(F.when(ok, F.col("records_updated")).otherwise(0)).alias("total_updated"),
        F.sum(F.when(~ok, F.size("errors")).otherwise(0)).alias("total_errors"))


COUNTERS = ["records_found", "records_processed", "records_inserted", "records_updated"]


def job_metrics(events: DataFrame) -> DataFrame:
    return events.groupBy("job_id").agg(
        *[F.sum(c).alias(c) for c in COUNTERS],
        F.sum(F.size("errors")).alias("errors"))


def job_outcomes(jobs: DataFrame, by: str) -> DataFrame:
    """Jobs per run: all, completed, and the rest as failed."""
    done = F.count_if(F.col("status") == "completed")
    return jobs.groupBy(by).agg(F.count("*").alias("total"), done.alias("succeeded"),
                                (F.count("*") - done).alias("failed"))


def error_classes(jobs: DataFrame) -> DataFrame:
    return (jobs.select(F.explode("errors").alias("message"))
            .groupBy(error_class(F.col("message")).alias("error_class"))
            .agg(F.count("*").alias("n")))


def latest_status(events: DataFrame) -> DataFrame:
    """The last event of each job, with its end time once it has ended."""
    last = keep_latest(events, ["job_id"], [F.col("event_ts"), F.col("event_id")])
    ended = F.col("status").isin("completed", "failed")
    return last.select("job_id", "status", "event_ts",
                       F.when(ended, F.col("event_ts")).alias("completed_at"))


def cleanup_summary(report: DataFrame) -> DataFrame:
    """Totals over the parts of a cleanup: scanned, expired, deleted, and failed, those expired but still there."""
    totals = {c: F.coalesce(F.sum(c), F.lit(0)) for c in ("scanned", "expired", "deleted")}
    return report.agg(*[c.alias(n) for n, c in totals.items()], (totals["expired"] - totals["deleted"]).alias("failed"))


def recent(df: DataFrame, n: int, time: str, tie: str) -> DataFrame:
    return df.orderBy(F.desc(time), tie).limit(n)


def sample(df: DataFrame, n: int, key: str) -> DataFrame:
    return df.orderBy(key).limit(n)


def application_status(applications: DataFrame) -> DataFrame:
    """Applications by user, listing and organization, each by status.

    Each row is taken once for each of the three groupings, in one scan and one shuffle of counts combined map-side.
    """
    members = F.explode(F.array(*[
        F.struct(F.lit(label).alias("grouping"), F.col(c).cast("string").alias("member"))
        for label, c in (("user", "user_id"), ("listing", "listing_id"), ("organization", "organization"))])).alias("m")
    return applications.select("status", members).groupBy("m.grouping", "m.member", "status").agg(F.count("*").alias("n"))


def listing_applications(applications: DataFrame, listings: DataFrame) -> DataFrame:
    """Per listing and status with the listing's name.

    Applications are counted before the join, so a listing that drew a third of
    them enters it as a handful of rows.
    """
    counts = applications.groupBy("listing_id", "status").agg(F.count("*").alias("n"))
    return counts.join(listings.select("listing_id", "name"), "listing_id")
