"""Exports, relational tables, site configuration and the source registry."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from listingflow.operators.filters import rename_fields
from listingflow.schema import EXPORT_ITEM, LISTING, SEARCH_CONFIG
from listingflow.session import stored

Source = Callable[[SparkSession, str], DataFrame]


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of a key-value table export, in canonical columns."""
    items = spark.read.schema(EXPORT_ITEM).json(path)
    return (rename_fields(items)
            .withColumn("name", F.coalesce(F.nullif("name", F.lit("")), "title"))
            .withColumnsRenamed({"id": "listing_id", "jobId": "job_id", "srcSeq": "src_seq"})
            .withColumns({c: F.col(c).try_cast("timestamp_ntz")
                          for c in ("created_at", "updated_at")})
            .drop("title"))


def read_relational(spark: SparkSession, url: str, table: str, column: str | None = None,
                    lower: int | None = None, upper: int | None = None, partitions: int = 64,
                    options: Mapping[str, str] | None = None) -> DataFrame:
    """A relational table, in ranges of ``column`` so that executors read side by side."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if column is not None:
        reader = reader.options(partitionColumn=column, lowerBound=lower, upperBound=upper,
                                numPartitions=partitions)
    return reader.options(**(options or {})).load()


def append_rows(target: DataFrame, rows: DataFrame) -> DataFrame:
    """``target`` after an insert of rows whose names follow the source's spelling."""
    return target.unionByName(rename_fields(rows), allowMissingColumns=True)


def read_sites(rows: DataFrame) -> DataFrame:
    """Site rows with their JSON configuration typed."""
    return rows.withColumn("search_config", F.from_json("search_config", SEARCH_CONFIG))


def conform(df: DataFrame, schema: T.StructType = LISTING) -> DataFrame:
    """Exactly the columns and types of ``schema``; what the source lacks is null."""
    return df.select([
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields])


class Registry:
    """Listing sources by name. Aliases lead to one source, which is read once."""

    def __init__(self) -> None:
        self._sources: dict[str, Source] = {}
        self._aliases: dict[str, str] = {}

    def register(self, name: str, source: Source, aliases: Iterable[str] = ()) -> None:
        self._sources[name.lower()] = source
        self._aliases.update({a.lower(): name.lower() for a in aliases})

    def names(self) -> list[str]:
        return list(self._sources)

    def resolve(self, name: str) -> str | None:
        name = self._aliases.get(name.lower(), name.lower())
        return name if name in self._sources else None

    def read_all(self, spark: SparkSession, data: str, names: Iterable[str] | None = None, store: bool = False,
                 at_once: int = 8) -> tuple[dict[str, DataFrame], dict[str, str]]:
        """(listings, failures) by source name. One source failing leaves the others.

        With ``store`` each source is read into a written table of its own, ``at_once`` of them side by side, and one
        that breaks while its rows are read fails too. Without, listings are plans, and only what fails when it is planned is caught.
        """
        failures = {}
        chosen: dict[str, None] = {}
        for asked in self.names() if names is None else names:
            name = self.resolve(asked)
            if name is None:
                failures[asked] = f"unknown source {asked!r}"
            else:
                chosen[name] = None

        def read(name: str) -> DataFrame | str:
            try:
                rows = conform(self._sources[name](spark, data)).withColumn("source", F.lit(name))
                return stored(rows, f"source-{name}") if store else rows
            except Exception as error:
                return str(error).splitlines()[0]

        with ThreadPoolExecutor(max(1, at_once if store else 1)) as pool:
            found = dict(zip(chosen, pool.map(read, chosen), strict=True))
        failures |= {name: rows for name, rows in found.items() if isinstance(rows, str)}
        return {name: rows for name, rows in found.items() if not isinstance(rows, str)}, failures


def union_sources(listings: Iterable[DataFrame]) -> DataFrame:
    tables = iter(listings)
    out = next(tables)
    for table in tables:
        out = out.unionByName(table, allowMissingColumns=True)
    return out
