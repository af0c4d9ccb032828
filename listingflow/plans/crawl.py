"""Request tables: what to fetch and what to ask. No request is made here."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from listingflow.functions.links import page_url

PAGE_PROMPT = (
    "Read the page below and give the award listing in it as one JSON object with the keys "
    "title, organization, amount, deadline, description, eligibility, academicLevel, targetType, "
    "ethnicity, gender, geographicRestrictions, renewable, country. "
    "Give null if there is no listing.\n\n%s")


def term_plan(sites: DataFrame) -> DataFrame:
    """One row per site and search term of the site's configuration."""
    return sites.select("site", F.posexplode("search_config.searchTerms").alias("pos", "term"),
                        F.col("search_config.maxResultsPerTerm").alias("max_results"))


def focus_plan(sites: DataFrame, total: int) -> DataFrame:
    """Terms with an equal share of ``total`` results each, rounded up."""
    share = F.ceil(F.lit(total) / F.size("search_config.searchTerms")).cast("int")
    return sites.select("site", F.explode("search_config.searchTerms").alias("term"),
                        share.alias("max_results"))


FOCUS_PROMPT = (
    "List at most %d awards that students can apply for now, on this subject: %s. Answer with a JSON array and nothing else. "
    "Give each award as an object with the keys title, organization, url, description, minAmount, maxAmount, eligibility, "
    "academicLevel, geographicRestrictions, deadline, renewable, country, applyUrl, source. Give null for what is not known.")


def focus_requests(plan: DataFrame, prompt: str = FOCUS_PROMPT) -> DataFrame:
    """One prompt per row of ``focus_plan``, that asks for its share of results on its subject."""
    return plan.withColumn("prompt", F.format_string(prompt, "max_results", "term"))


def page_plan(sites: DataFrame, pages: int = 3) -> DataFrame:
    """One row per site and page number from 1, with the address to fetch."""
    numbered = sites.select("site", "url", F.explode(F.sequence(F.lit(1), F.lit(pages)))
                            .alias("page"))
    first = F.when(F.col("page") == 1, 0).otherwise(F.col("page"))
    return numbered.withColumn("request_url", page_url(F.col("url"), first))


def request_rows(pages: DataFrame, content: str, *keep: str, max_chars: int = 3000) -> DataFrame:
    """One prompt per page over the first ``max_chars`` characters of its content."""
    return pages.select(*keep, F.format_string(PAGE_PROMPT, F.substring(content, 1, max_chars))
                        .alias("prompt"))
