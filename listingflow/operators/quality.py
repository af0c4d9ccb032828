"""Contract checks on listings, sites, jobs and applications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F
from pyspark.sql import types as T

from listingflow import vocabulary as V
from listingflow.session import observed

BROKEN = "broken"
_GOOD = "sound"


def listing_rules() -> dict[str, Column]:
    """Name -> violated? for the rules a listing row must obey on its own."""
    rules = {f"{c}_missing": F.col(c).isNull() for c in ("listing_id", "name")}
    rules["target_type_unknown"] = ~F.col("target_type").isin(V.TARGET_TYPES)
    for c, n in V.MAX_LENGTHS.items():
        rules[f"{c}_too_long"] = F.length(c) > n
    return rules


def _required(*columns: str) -> dict[str, Column]:
    return {f"{c}_missing": F.col(c).isNull() for c in columns}


def _longest(lengths: dict[str, int]) -> dict[str, Column]:
    return {f"{c}_too_long": F.length(c) > n for c, n in lengths.items()}


def site_rules() -> dict[str, Column]:
    """Rules of a configured site."""
    return _required("site", "type") | {"type_unknown": ~F.col("type").isin(V.SITE_TYPES)} \
        | _longest({"site": V.SITE_NAME_LENGTH, "url": V.SITE_URL_LENGTH})


def job_rules() -> dict[str, Column]:
    """Rules of a job's row."""
    return _required("job_id", "status") | {"status_unknown": ~F.col("status").isin(V.JOB_STATUSES)} \
        | _longest({"job_id": V.MAX_LENGTHS["job_id"]})


def application_rules() -> dict[str, Column]:
    """Rules of an application on its own; ``reference`` adds that its listing must be there."""
    return _required("id", "user_id", "listing_id") | {"status_unknown": ~F.col("status").isin(V.APPLICATION_STATUSES)} \
        | _longest({"organization": V.MAX_LENGTHS["organization"]})


def reference(df: DataFrame, column: str, other: DataFrame, key: str, flag: str) -> DataFrame:
    """``df`` with the flag ``flag`` where ``column`` has a value that ``other`` has no row for; a null refers to nothing.

    Only the keys of ``other`` are joined, once each, so no row is repeated.
    """
    keys = other.select(F.col(key).alias(f"__{key}")).where(f"`__{key}` is not null").distinct()
    joined = df.join(keys, F.col(column) == F.col(f"__{key}"), "left")
    return joined.withColumn(flag, F.col(column).isNotNull() & F.col(f"__{key}").isNull()).drop(f"__{key}")


def broken_rules(rules: dict[str, Column]) -> Column:
    """The names of the rules a row breaks; a rule that cannot be decided is not broken."""
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]))


def store_checked(df: DataFrame, rules: dict[str, Column], path: str) -> dict[str, int]:
    """Writes the rows with ``broken`` (rule names) to ``path``, sound and broken ones apart; returns rows by broken rule.

    One pass: the counts are observed while the rows are written. ``rows`` counts all and ``broken`` those with any.
    """
    seen = Observation()
    checked = df.withColumn(BROKEN, broken_rules(rules))
    counts = [F.count_if(F.array_contains(BROKEN, name)).alias(name) for name in rules]
    checked.withColumn(_GOOD, F.size(BROKEN) == 0).observe(
        seen, F.count("*").alias("rows"), F.count_if(F.size(BROKEN) > 0).alias("broken"), *counts) \
        .write.partitionBy(_GOOD).parquet(path)
    return dict.fromkeys(("rows", "broken", *rules), 0) | observed(seen)


def read_checked(df: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(sound rows, broken rows with ``broken``) of what ``store_checked`` wrote of ``df``; each reads its own folder."""
    schema = T.StructType([*df.schema.fields, T.StructField(BROKEN, T.ArrayType(T.StringType())), T.StructField(_GOOD, T.BooleanType())])
    rows = df.sparkSession.read.schema(schema).parquet(path)
    return rows.filter(_GOOD).drop(BROKEN, _GOOD), rows.filter(f"not {_GOOD}").drop(_GOOD)


def _any_broken(rules: dict[str, Column]) -> Column:
    broken = F.lit(False)
    for test in rules.values():
        broken = broken | F.coalesce(test, F.lit(False))
    return broken


def violations(df: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """rule, violations: all row rules in one pass, then the uniqueness of ``key``."""
    counts = df.agg(*[F.count_if(test).alias(name) for name, test in rules.items()])
    per_rule = counts.unpivot([], list(rules), "rule", "violations")
    repeats = (df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
               .filter("n > 1").agg(F.count("*").alias("violations")))
    return per_rule.unionByName(repeats.select(F.lit(f"{key}_repeated").alias("rule"),
                                               "violations"))


def split_by_contract(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows by the row rules."""
    broken = _any_broken(rules)
    return df.filter(~broken), df.filter(broken)


def award_bounds(df: DataFrame, column: str = "max_award",
                 bounds: tuple[float, float] = V.AWARD_BOUNDS) -> DataFrame:
    """Adds ``in_bounds``; rows outside or without an award are for quarantine."""
    low, high = bounds
    return df.withColumn("in_bounds", F.coalesce(F.col(column).between(low, high), F.lit(False)))
