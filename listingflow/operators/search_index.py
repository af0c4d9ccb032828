"""Postings that are kept up to date.

A batch of rows becomes a segment of postings; rows that it replaces or deletes keep their old postings, which are dead. A table
of keys by hash bucket says which batch a key's live postings are of, so a batch is seen when that table is switched to
it. Segments of one size tier are merged into one without their dead postings, so there are some per tier and a number
of tiers that grows with the logarithm of the postings.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql import types as T

from listingflow.operators import search
from listingflow.operators.merge import fold_in
from listingflow.session import observed
from listingflow.sources.versioned import BUCKET, BUCKETS, VersionedTable, apply_batch, bucketed

#: Segments of a tier that are merged; a tier holds segments of up to so many times the rows of the one below.
TIER = 4
_STREAM = "index"


class PostingIndex:
    """An index of the text ``columns`` of rows with the unique ``key``, stored below ``path``."""

    def __init__(self, spark: SparkSession, path: str, key: str, kind: str, columns: list[str], buckets: int = BUCKETS) -> None:
        self.spark, self.key, self.columns, self.buckets = spark, key, columns, buckets
        schema = T.StructType.fromDDL(f"term string, {key} {kind}, tf bigint, seq bigint, segment bigint, {BUCKET} int")
        self.postings = VersionedTable(spark, f"{path}/postings", schema, ["segment", BUCKET])
        self.keys = bucketed(spark, f"{path}/keys", T.StructType.fromDDL(f"{key} {kind}, seq bigint, alive boolean"))

    def apply(self, rows: DataFrame | None, deleted: DataFrame | None, batch: int) -> None:
        """Inserts or replaces ``rows`` and deletes the keys of ``deleted``; a batch that was applied is passed over.

        A key that is in both is replaced. Batches are numbered upwards.
        """
        changed = None
        for part, alive in ((rows, True), (deleted, False)):
            if part is not None:
                keys = part.select(self.key, F.lit(batch).cast("bigint").alias("seq"), F.lit(alive).alias("alive"))
                changed = keys if changed is None else changed.unionByName(keys)
        if changed is None:
            return
        now = self.postings.version()
        if rows is not None and (now is None or now.batches.get(_STREAM, -1) < batch):
            self._write(search.build_postings(rows, self.key, self.columns).withColumn("seq", F.lit(batch).cast("bigint")), [], batch)
        apply_batch(self.keys, changed, [self.key], lambda held, new: fold_in(held, new, [self.key, BUCKET], ["seq", "alive"]),
                    batch, _STREAM, buckets=self.buckets)
        self._merge()

    def _write(self, postings: DataFrame, touched: list[str], batch: int | None) -> None:
        """A new segment in the place of the ``touched`` parts; its number of postings is counted while it is written."""
        now = self.postings.version()
        segment, seen = now.number + 1 if now else 0, Observation()
        placed = postings.withColumn("segment", F.lit(segment).cast("bigint")) \
            .withColumn(BUCKET, F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")).observe(seen, F.count("*").alias("n"))
        self.postings.put(placed.hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, "term"), touched,
                          {} if batch is None else {_STREAM: batch}, properties=lambda: {f"segment {segment}": str(observed(seen).get("n", 0))}, before=now)

    def segments(self) -> dict[int, int]:
        """The postings of each segment, dead ones included."""
        now = self.postings.version()
        if now is None:
            return {}
        there = {int(m[1]) for p in now.folders if (m := re.match(r"segment=(\d+)/", p))}
        return {s: int(now.properties[f"segment {s}"]) for s in there}

    def _parts(self, segments: Iterable[int] | None = None, buckets: Iterable[int] | None = None) -> list[str]:
        now = self.postings.version()
        found = [(p, re.match(rf"segment=(\d+)/{BUCKET}=(\d+)$", p)) for p in (now.folders if now else ())]
        return [p for p, m in found if (segments is None or int(m[1]) in set(segments)) and (buckets is None or int(m[2]) in set(buckets))]

    def _live(self, postings: DataFrame) -> DataFrame:
        alive = self.keys.read().filter("alive").select(self.key, "seq")
        return postings.join(alive, [self.key, "seq"], "left_semi")

    def _merge(self) -> None:
        while True:
            tiers: dict[int, list[int]] = {}
            for segment, n in self.segments().items():
                tiers.setdefault(int(math.log(max(n, 1), TIER)), []).append(segment)
            full = [found for _, found in sorted(tiers.items()) if len(found) >= TIER]
            if not full:
                return
            parts = self._parts(segments=full[0])
            self._write(self._live(self.postings.read(parts)).select("term", self.key, "tf", "seq"), parts, None)

    def rows(self) -> int:
        """How many keys are live."""
        return self.keys.read().filter("alive").count()

    def hits(self, query: Iterable[str]) -> DataFrame:
        """Live postings of the query's terms; folders of other terms are not read."""
        terms = list(dict.fromkeys(t.lower() for t in query))
        asked = self.spark.createDataFrame([(t,) for t in terms], "term string")
        buckets = [r[0] for r in asked.select(F.pmod(F.xxhash64("term"), F.lit(self.buckets))).collect()]
        return self._live(self.postings.read(self._parts(buckets=buckets)).filter(F.col("term").isin(terms))).select("term", self.key, "tf")

    def search(self, query: Iterable[str], k: int) -> DataFrame:
        """The ``k`` live keys that score highest; document frequencies count live rows."""
        query = list(query)
        return search.search(self.hits(query), self.key, query, k, self.rows())
