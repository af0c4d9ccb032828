"""Tables that are changed a part at a time.

The rows of a part, a combination of values of some columns, lie in folders of their own. A change writes the new contents of the
parts it touches to folders beside the old ones and then a manifest, which names the folders of every part. The manifest is one
file, so it is there or it is not: readers see the table before the change or after it, and folders that no
manifest names, of a job that died halfway, are never read. Parts that a change does not touch keep their files.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql import types as T

from listingflow.session import observed, stored

_VERSION = "table_version"
_PART = "table_part"
#: The column that holds the hash bucket of a key, and how many there are unless a table says otherwise.
BUCKET = "bucket"
BUCKETS = 32
_MANIFEST = "part string, folder string, head string"


@dataclass(frozen=True)
class Version:
    """A manifest: the folders of each part, the last batch of each stream, and what its change counted."""

    number: int
    folders: dict[str, tuple[str, ...]] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)
    properties: dict[str, str] = field(default_factory=dict)


class VersionedTable:
    """A table below ``path`` with the columns of ``schema``, those of ``parts`` included.

    One job changes a table at a time. The driver holds a row per part.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, parts: Sequence[str]) -> None:
        self.spark, self.path, self.schema, self.parts = spark, path.rstrip("/"), schema, list(parts)

    def _files(self, folder: str) -> list[str]:
        """Files below a folder, without reading them; none if nothing was written there."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return []
        return [unquote(f) for f in self.spark.read.schema("part string").parquet(f"{self.path}/{folder}").inputFiles()]

    def version(self) -> Version | None:
        """The manifest that holds; None before the first."""
        numbers = [int(m[1]) for f in self._files("manifest") if (m := re.search(rf"/{_VERSION}=(\d+)/[^/]+$", f))]
        if not numbers:
            return None
        number = max(numbers)
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/{_VERSION}={number}").collect()
        head = json.loads(next(r["head"] for r in rows if r["part"] is None))
        folders: dict[str, tuple[str, ...]] = {}
        for part, folder in sorted((r["part"], r["folder"]) for r in rows if r["part"] is not None):
            folders[part] = (*folders.get(part, ()), folder)
        return Version(number, folders, **head)

    def _rows(self, only: Iterable[str] | None, now: Version | None) -> DataFrame | None:
        folders = now.folders if now else {}
        chosen = [f for p in (folders if only is None else only) for f in folders.get(p, ())]
        if not chosen:
            return None
        return self.spark.read.schema(self.schema).option("basePath", f"{self.path}/data") \
            .parquet(*[f"{self.path}/{folder}" for folder in chosen])

    def read(self, only: Iterable[str] | None = None, now: Version | None = None) -> DataFrame:
        """The rows of all parts, or of those named, of the version that holds or of a given one."""
        rows = self._rows(only, now or self.version())
        return self.spark.createDataFrame([], self.schema) if rows is None else rows.select(*self.schema.names)

    def located(self) -> DataFrame:
        """All rows with ``table_part``, the part of a row as it is spelled in the address of its file."""
        part = F.regexp_extract("_metadata.file_path", rf"/{_VERSION}=\d+/(.*)/[^/]+$", 1)
        rows = self._rows(None, self.version())
        if rows is None:
            return self.read().withColumn(_PART, F.lit(""))
        return rows.select(*self.schema.names, part.alias(_PART))

    def put(self, rows: DataFrame, touched: Iterable[str] | None = None, batches: Mapping[str, int] | None = None,
            counts: Callable[[], Mapping[str, int]] | None = None,
            properties: Mapping[str, str] | Callable[[], Mapping[str, str]] | None = None,
            before: Version | None = None) -> Version:
        """Replaces the ``touched`` parts, all if None, by ``rows``. A touched part without a row is gone; rows of other
        parts are added to those.

        ``counts`` and ``properties``, if it can be, are asked once the rows are written. ``before`` is the version that holds, if it is known.
        """
        before = before or self.version()
        number = before.number + 1 if before else 0
        folder = f"data/{_VERSION}={number}"
        # What a job that died left under this number is written over.
        rows.select(*self.schema.names).write.mode("overwrite").partitionBy(*self.parts).parquet(f"{self.path}/{folder}")
        written = {f.split(f"/{folder}/", 1)[1].rpartition("/")[0] for f in self._files(folder)}
        gone = set(before.folders if before and touched is None else touched or ())
        folders = {p: f for p, f in (before.folders if before else {}).items() if p not in gone}
        folders |= {p: (*folders.get(p, ()), f"{folder}/{p}") for p in written}
        now = Version(number, folders, {**(before.batches if before else {}), **(batches or {})}, dict(counts() if counts else {}),
                      {**(before.properties if before else {}), **((properties() if callable(properties) else properties) or {})})
        self._switch(now)
        return now

    def add(self, rows: DataFrame) -> Version:
        """Adds rows; the folders that are there stay as they are."""
        return self.put(rows, ())

    def _switch(self, now: Version) -> None:
        head = json.dumps({"batches": now.batches, "counts": now.counts, "properties": now.properties})
        rows = [(None, None, head), *((p, f, None) for p, folders in now.folders.items() for f in folders)]
        columns = [pa.array(c, pa.string()) for c in zip(*rows, strict=True)]
        manifest = self.spark.createDataFrame(pa.table(columns, names=["part", "folder", "head"]))
        manifest.coalesce(1).write.parquet(f"{self.path}/manifest/{_VERSION}={now.number}")

    def rewrite(self, parts: Sequence[str], change: Callable[[DataFrame], DataFrame], group: int = 1000) -> dict[str, str]:
        """Replaces parts by what ``change`` makes of their rows, ``group`` at a time; returns the failures by part.

        A part that cannot be read or written stays as it was, and the others go on: a group that fails is halved.
        """
        failures: dict[str, str] = {}
        waiting = [list(parts[i:i + group]) for i in range(0, len(parts), group)]
        now = self.version()
        while waiting:
            some = waiting.pop()
            try:
                now = self.put(change(self.read(some, now)).hint("rebalance", *self.parts), some, before=now)
            except Exception as error:
                if len(some) > 1:
                    waiting += [some[:len(some) // 2], some[len(some) // 2:]]
                else:
                    failures[some[0]] = str(error).splitlines()[0]
        return failures


def named(part: str) -> str:
    """The name of a part from ``table_part``."""
    return unquote(part)


# --- by hash bucket of a key --------------------------------------------------------------------------------

def bucketed(spark: SparkSession, path: str, schema: T.StructType) -> VersionedTable:
    """The table of ``schema`` by hash bucket of its key."""
    full = T.StructType([*(f for f in schema.fields if f.name != BUCKET), T.StructField(BUCKET, T.IntegerType())])
    return VersionedTable(spark, path, full, [BUCKET])


def apply_batch(table: VersionedTable, rows: DataFrame, keys: Sequence[str], fold: Callable[[DataFrame, DataFrame], DataFrame],
                batch_id: int, source: str = "stream", counts: dict[str, Column] | None = None, buckets: int = BUCKETS) -> None:
    """One batch into a bucketed table: ``fold`` makes the new rows of the touched buckets out of theirs and the batch's.

    Does nothing if the table has this batch of ``source`` or a later one. ``counts`` are aggregates over the
    folded rows, taken while they are written and kept in the manifest. The number of buckets is that which the
    table was begun with.
    """
    now = table.version()
    if now is not None and batch_id <= now.batches.get(source, -1):
        return
    buckets = int(now.properties.get("buckets", buckets)) if now else buckets
    rows = rows.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    touched = None
    if now is not None:
        rows = stored(rows, "batch")
        touched = [f"{BUCKET}={r[0]}" for r in rows.select(BUCKET).distinct().collect()]
    merged = fold(table.read(touched or [], now), rows)
    seen = Observation()
    if counts:
        merged = merged.observe(seen, *[c.alias(name) for name, c in counts.items()])
    table.put(merged.hint("rebalance", BUCKET), touched, {source: batch_id},
              (lambda: dict.fromkeys(counts, 0) | observed(seen)) if counts else None, {"buckets": str(buckets)}, now)
