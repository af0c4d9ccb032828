"""Nearest neighbours by balanced posting lists around centroids.

Centroids come from a bounded sample. Every vector goes to the list of its nearest centroid and,
near a border, to others as well. A query walks an in-memory graph of the centroids and
searches the lists whose distance is within a ratio of the nearest's; the ratio is the one that
finds the wanted share of true neighbours, in the sample, of some of the queries themselves, whose vectors may be
unlike the rest. The walk sets out from centroids far from each other, and is widened until it finds that share too.
Lists are searched as Spark groups, large ones in tiles.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listingflow.llm.common import stored

#: Vectors that centroids and the ratio are fitted on, as an expectation.
SAMPLE = 20_000
#: Vectors per list aimed at, and the most lists, which bounds what is broadcast.
LIST_ROWS = 128
LISTS = 2048
#: A vector is replicated to at most so many lists whose distance is within the factor of the nearest's.
COPIES, BORDER = 8, 1.15
#: Share of true neighbours that the ratio is to find in the sample, by about so many queries.
RECALL, PROBES = 0.975, 512
#: Centroids that a walk sets out from, and how far beyond the ratio it goes on, in turn.
ENTRIES = 256
SLACKS = (1.05, 1.5, 2.0, float("inf"))
NEIGHBOURS = 10
#: Rows of a tile: a list is searched in tiles of so many vectors and so many queries.
TILE_VECTORS, TILE_QUERIES = 8192, 1024


def usable(embedding: Column) -> Column:
    """Whether a vector takes part: not null, not empty, not zero, all components finite numbers."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(embedding.isNotNull() & (F.size(embedding) > 0) & ~F.exists(embedding, odd)
                      & F.exists(embedding, lambda x: F.coalesce(x != 0, F.lit(False))), F.lit(False))


def vectors(table: DataFrame) -> tuple[DataFrame, int]:
    """vec_id and ``v`` (doubles) of the vectors that take part, one per vec_id, and their dimension.

    The dimension is the most frequent (the lesser of two); vectors of another take no part. Of rows that share an id
    the least vector counts; rows without an id take no part.
    """
    kept = table.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))) \
        .select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    sizes = kept.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    dimension = sizes[0]["n"] if sizes else 0
    return kept.where(F.size("v") == dimension).groupBy("vec_id").agg(F.min("v").alias("v")), dimension


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dimension)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


@dataclass(frozen=True)
class Index:
    """Centroids around ``origin``, their neighbour graph, and the ratio that prunes lists.

    A nearest centroid that is nearer than ``floor`` counts as that far, or a query that is a centroid would reach no other.
    """

    origin: np.ndarray
    centroids: np.ndarray
    graph: np.ndarray
    entries: np.ndarray
    floor: float
    ratio: float = 1.0
    slack: float = SLACKS[0]

    def lists(self, query: np.ndarray) -> list[int]:
        """Lists whose centroid is within ``ratio`` of the nearest, by a best-first walk of the graph.

        The walk goes on while what it meets is near enough to matter.
        """
        query = query - self.origin

        def distance(nodes: np.ndarray) -> np.ndarray:
            gap = self.centroids[nodes] - query
            return np.sqrt((gap * gap).sum(axis=1))

        start = distance(self.entries)
        seen = np.zeros(len(self.centroids), dtype=bool)
        seen[self.entries] = True
        heap = list(zip(start.tolist(), self.entries.tolist(), strict=True))
        heapq.heapify(heap)
        found = dict(zip(self.entries.tolist(), start.tolist(), strict=True))
        best = max(float(start.min()), self.floor)
        while heap and heap[0][0] <= best * max(self.ratio, 1.05) * self.slack:
            _, node = heapq.heappop(heap)
            fresh = self.graph[node][~seen[self.graph[node]]]
            if len(fresh):
                fresh = np.unique(fresh)
                seen[fresh] = True
                far = distance(fresh)
                best = max(min(best, float(far.min())), self.floor)
                found.update(zip(fresh.tolist(), far.tolist(), strict=True))
                for item in zip(far.tolist(), fresh.tolist(), strict=True):
                    heapq.heappush(heap, item)
        return [c for c, far in found.items() if far <= best * self.ratio]

    def postings(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of each posting of the vectors ``block``: the nearest, and others near enough."""
        far = np.sqrt(_squares(block - self.origin, self.centroids))
        near = np.argsort(far, axis=1, kind="stable")[:, :COPIES]
        reach = np.take_along_axis(far, near, axis=1)
        row, at = np.nonzero(reach <= BORDER * reach[:, :1])
        return row, near[row, at]


def _balanced(sample: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    """k-means whose lists are kept balanced: a cluster's distances grow with what it held above its share."""
    centers = sample[rng.choice(len(sample), k, replace=False)].copy()
    penalty = np.zeros(k)
    for _ in range(rounds):
        owner = np.concatenate([(_squares(part, centers) + penalty).argmin(axis=1)
                                for part in np.array_split(sample, max(1, len(sample) // 4096))])
        sizes = np.bincount(owner, minlength=k)
        totals = np.zeros_like(centers)
        np.add.at(totals, owner, sample)
        filled = sizes > 0
        centers[filled] = totals[filled] / sizes[filled, None]
        spread = float(((sample - centers[owner]) ** 2).sum(axis=1).mean())
        penalty += 0.05 * spread * (sizes / max(sizes.mean(), 1) - 1)
        penalty -= penalty.min()
    return centers


def _some(rows: DataFrame, total: int, most: int, dimension: int) -> np.ndarray:
    """About ``most`` vectors of ``total`` rows, chosen by a hash of their ids."""
    part = min(1.0, most / max(1, total))
    spread = 1 << 30
    picked = rows.where(F.pmod(F.xxhash64(F.lit("ann"), "vec_id"), F.lit(spread)) < int(part * spread)) \
        .orderBy("vec_id").toArrow()
    return _matrix(picked["v"], dimension) if picked.num_rows else np.zeros((0, dimension))


def fit(rows: DataFrame, queries: DataFrame, dimension: int, list_rows: int = LIST_ROWS, lists: int = LISTS) -> Index:
    """An index of ``rows`` from about ``SAMPLE`` of their vectors and ``PROBES`` of the queries."""
    total = rows.count()
    probes = _some(queries, queries.count(), PROBES, dimension)
    return fitted(_some(rows, total, SAMPLE, dimension), probes, min(lists, max(1, total // list_rows)))


def fitted(sample: np.ndarray, probes: np.ndarray, k: int) -> Index:
    """An index of ``k`` lists at most from a sample of the vectors and of the queries."""
    sample = np.unique(sample, axis=0) if len(sample) else np.zeros((1, sample.shape[1]))
    origin = sample.mean(axis=0)
    sample = sample - origin
    rng = np.random.default_rng(0)
    sample = sample[rng.permutation(len(sample))]
    k = min(k, len(sample))
    centroids = _balanced(sample, k, rng)
    near = np.argsort(_squares(centroids, centroids), axis=1, kind="stable")[:, :17]
    links = rng.integers(0, k, (k, 4))  # a few long ways keep the graph connected
    graph = np.concatenate([near, links, ((np.arange(k) + 1) % k)[:, None]], axis=1)
    own = np.sqrt(np.concatenate([_squares(part, centroids).min(axis=1)
                                  for part in np.array_split(sample, max(1, len(sample) // 4096))]))
    index = Index(origin, centroids, graph, _spread(centroids, ENTRIES), max(float(np.quantile(own, 0.1)), 1e-12))
    return _pruned(index, sample + origin, probes)


def _spread(centroids: np.ndarray, most: int) -> np.ndarray:
    """Centroids that are far from each other: each is the one farthest from those before it."""
    chosen = [0]
    far = _squares(centroids, centroids[:1])[:, 0]
    while len(chosen) < min(most, len(centroids)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _squares(centroids, centroids[chosen[-1:]])[:, 0])
        far[chosen] = 0
    return np.unique(chosen)


def _pruned(index: Index, sample: np.ndarray, probes: np.ndarray) -> Index:
    """``index`` with the ratio within which a list of ``RECALL`` of the probes' true neighbours in the sample lies.

    Of the slacks of the walk the first is taken by which the probes reach this share.
    """
    rows, lists = index.postings(sample)  # by row
    starts = np.searchsorted(rows, np.arange(len(sample) + 1))
    near: list[list[np.ndarray]] = []  # the lists of each neighbour of each probe
    needed: list[float] = []
    for part in np.array_split(probes, max(1, len(probes) // 64)):
        gaps = _squares(part - index.origin, sample - index.origin)
        for probe, gap in zip(part, gaps, strict=True):
            closest = np.argsort(gap, kind="stable")[:NEIGHBOURS + 1]
            closest = closest[~(sample[closest] == probe).all(axis=1)][:NEIGHBOURS]
            near.append([lists[starts[n]:starts[n + 1]] for n in closest])
            far = np.sqrt(((index.centroids - (probe - index.origin)) ** 2).sum(axis=1))
            needed += [float(far[own].min() / max(far.min(), index.floor)) for own in near[-1]]
    if not needed:
        return index
    # The next needed one above the share, and what rounding may take from it.
    index = replace(index, ratio=max(1.0, float(np.quantile(needed, RECALL, method="higher"))) * (1 + 1e-9))
    for slack in SLACKS:
        index = replace(index, slack=slack)
        reached = 0
        for probe, owners in zip(probes, near, strict=True):
            found = set(index.lists(probe))
            reached += sum(not found.isdisjoint(own.tolist()) for own in owners)
        if reached >= RECALL * len(needed):
            break
    return index


def _tile(queries: pa.Table, found: pa.Table, dimension: int, k: int) -> pa.Table:
    """The ``k`` nearest vectors of a tile to each of its queries, ties by id."""
    ids = found["vec_id"].to_numpy()
    v = _matrix(found["v"], dimension)
    out: list[tuple] = []
    names = queries["query_id"].to_numpy()
    q = _matrix(queries["v"], dimension)
    for start in range(0, len(q), 64):
        rough = _squares(q[start:start + 64], v)
        for i, row in enumerate(rough, start):
            own = ids != names[i]
            row = np.where(own, row, np.inf)
            upto = np.partition(row, min(k, len(row)) - 1)[min(k, len(row)) - 1]
            close = np.flatnonzero((row <= upto + 1e-9 * (1 + abs(upto) + (q[i] ** 2).sum())) & own)
            exact = np.sqrt(((v[close] - q[i]) ** 2).sum(axis=1))
            best = np.lexsort((ids[close], exact))[:k]
            out += [(int(names[i]), int(ids[close[b]]), float(exact[b])) for b in best]
    return pa.Table.from_pandas(pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype(
        {"query_id": "int64", "vec_id": "int64", "score": "float64"}), preserve_index=False)


def nearest(table: DataFrame, every: int = 100, k: int = NEIGHBOURS, list_rows: int = LIST_ROWS,
            lists: int = LISTS) -> DataFrame:
    """query_id, rank, vec_id and score: the ``k`` nearest found to each query, by Euclidean distance.

    Queries are the rows whose vec_id is divisible by ``every``; all other rows are
    candidates. See ``vectors`` for which rows take part. Equal distances go by smaller vec_id. A query that reaches fewer than
    ``k`` candidates in its lists is compared with all vectors, in blocks. Other columns
    are ignored; an empty table has an empty result.
    """
    spark = table.sparkSession
    kept, dimension = vectors(table)
    rows = stored(kept.withColumn("vec_id", F.col("vec_id").cast("long")), "vectors")
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    index = fit(rows, queries, dimension, list_rows, lists)
    shared = spark.sparkContext.broadcast(index)

    def post(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                at, one = shared.value.postings(_matrix(part.column("v"), dimension))
                taken = pa.Table.from_batches([part]).take(pa.array(at)).append_column("list", pa.array(one, pa.int32()))
                yield from taken.combine_chunks().to_batches()

    def probe(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.lists(q) for q in _matrix(batch.column("v"), dimension)] if batch.num_rows else []
            at = [i for i, one in enumerate(found) for _ in one]
            taken = pa.Table.from_batches([batch]).take(pa.array(at, pa.int64())) \
                .append_column("list", pa.array([c for one in found for c in one], pa.int32()))
            yield from taken.combine_chunks().to_batches()

    posted = stored(rows.mapInArrow(post, "vec_id long, v array<double>, list int"), "postings")
    probed = stored(queries.mapInArrow(probe, "vec_id long, v array<double>, list int")
                    .withColumnRenamed("vec_id", "query_id"), "probes")
    best = _search(probed, posted, dimension, k)
    ranked = Window.partitionBy("query_id").orderBy("score", "vec_id")
    top = stored(best.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k), "found")
    total = rows.count()
    # Written, or both sides of the search would be columns of one table.
    short = stored(queries.select(F.col("vec_id").alias("query_id"), "v")
                   .join(top.where(F.col("rank") == min(k, total - 1)), "query_id", "left_anti"), "short")
    if total > 1 and not short.isEmpty():
        rest = _search(short.withColumn("list", F.lit(0)), rows.withColumn("list", F.lit(0)), dimension, k)
        again = rest.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
        top = top.join(short, "query_id", "left_anti").select("query_id", "vec_id", "score", "rank").union(again)
    return top.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _search(queries: DataFrame, found: DataFrame, dimension: int, k: int) -> DataFrame:
    """query_id, vec_id and score of the nearest of each list, the same vector once."""
    def parts(frame: DataFrame, name: str, most: int) -> DataFrame:
        return frame.groupBy("list").agg(F.ceil(F.count("*") / most).cast("int").alias(name))

    # One row per list, so at most ``LISTS``.
    sizes = F.broadcast(parts(found, "vectors", TILE_VECTORS).join(parts(queries, "queries", TILE_QUERIES), "list"))
    grid = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = queries.join(sizes, "list").select(
        "list", "query_id", "v", F.pmod(F.xxhash64("query_id"), F.col("queries")).cast("int").alias("qt"), grid("vectors").alias("vt"))
    right = found.join(sizes, "list").select(
        "list", "vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.col("vectors")).cast("int").alias("vt"), grid("queries").alias("qt"))
    tile = ["list", "qt", "vt"]
    return left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(
        lambda a, b: _tile(a, b, dimension, k), "query_id long, vec_id long, score double") \
        .dropDuplicates(["query_id", "vec_id"])
