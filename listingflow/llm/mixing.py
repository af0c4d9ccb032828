"""Mixing sources to target weights with a splitting tree.

Documents are dealt to blocks of their source by a hash. A source's target becomes an
exact number of block draws: whole passes over its blocks in permuted order and
a part of one more pass. A tree splits these quotas among the output shards: at each node
the draws of the left half are multivariate hypergeometric, so every shard gets a random but exact share of
every source. Shards take their draws one after the other from the permuted
blocks, so no draw is taken twice, and order them by a hash of their own.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listingflow.llm.common import stored, word_count

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: A source is taken at most so many times.
MOST = 3
SHARDS = 16
#: Words and documents of a block. Blocks grow with the corpus, so that there are about ``BLOCKS`` by each at most, and
#: one per source; that bounds the table of blocks, which is broadcast.
BLOCK_WORDS = 5_000
BLOCK_DOCS = 500
BLOCKS = 100_000


@dataclass(frozen=True)
class Share:
    """A source's size, the words it is to give, and how its blocks are drawn."""

    source: str | None
    size: int
    target: float
    blocks: int
    passes: int
    rest: int


def targets(sizes: list[int], weights: list[int], most: int = MOST) -> list[float]:
    """Shares of all sizes by weight; what exceeds ``most`` times a size is reshared by weight."""
    result = [0.0] * len(sizes)
    open_, left = set(range(len(sizes))), sum(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if weights[i] * unit > most * sizes[i]}
        if not full:
            for i in open_:
                result[i] = float(weights[i] * unit)
            break
        for i in full:
            result[i] = float(most * sizes[i])
            left -= most * sizes[i]
        open_ -= full
    return result


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Draws of each source (columns) for each shard (rows); columns add up to ``quotas``."""
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    total = int(quotas.sum())
    drawn = np.zeros_like(quotas)
    wanted, rest = total * left // shards, total
    for i, n in enumerate(quotas):  # conditional draws, source by source
        rest -= int(n)
        if wanted and n:
            drawn[i] = rng.hypergeometric(int(n), rest, wanted) if rest else wanted
            wanted -= int(drawn[i])
    return np.concatenate([split_quotas(drawn, left, rng), split_quotas(quotas - drawn, shards - left, rng)])


def _hash(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(2**62))


@dataclass(frozen=True)
class Plan:
    """Documents with their block, blocks with their draws, the shares per source and their table (``of``, ...)."""

    docs: DataFrame
    blocks: DataFrame
    shares: list[Share]
    sources: DataFrame


def plan(docs: DataFrame, shards: int = SHARDS, seed: int = 7, block_words: int = BLOCK_WORDS,
         weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> Plan:
    """Sizes, blocks and draws. The driver holds one row per source, whatever the number of documents."""
    sized = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                               _hash(F.lit(seed), F.col("doc_id"), F.xxhash64("text")).alias("order")), "sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).collect()
    rows = sorted(per_source, key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "replace")))
    wanted = targets([r["size"] for r in rows], [weights[i % len(weights)] for i in range(len(rows))], most)
    words = max(block_words, sum(r["size"] for r in rows) // BLOCKS)
    most_docs = max(BLOCK_DOCS, sum(r["docs"] for r in rows) // BLOCKS)
    shares = []
    for row, target in zip(rows, wanted, strict=True):
        size, quota = row["size"], round(target)
        passes = min(quota // size, most) if size else 0
        shares.append(Share(row["source"], size, target, max(1, -(-size // words), -(-row["docs"] // most_docs)), passes,
                            quota - passes * size if passes < most else 0))
    schema = T.StructType([T.StructField("source", docs.schema["source"].dataType), T.StructField("source_size", T.LongType()),
                           T.StructField("target", T.DoubleType()), T.StructField("blocks", T.LongType()),
                           T.StructField("passes", T.LongType()), T.StructField("rest", T.LongType())])
    spark = docs.sparkSession
    table = spark.createDataFrame([(s.source, s.size, s.target, s.blocks, s.passes, s.rest) for s in shares], schema)
    table = table.withColumnRenamed("source", "of")
    placed = sized.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("of"))).drop("of") \
        .withColumn("block", F.pmod("order", F.col("blocks")))
    # Blocks in permuted order; the part of a pass takes them until its words are reached.
    by_source = Window.partitionBy("source").orderBy(_hash(F.lit(seed + 1), F.col("block")), "block")
    blocks = placed.groupBy("source", "block").agg(F.sum("size").alias("words"), F.max("passes").alias("passes"),
                                                   F.max("rest").alias("rest")) \
        .withColumn("place", F.row_number().over(by_source).cast("long") - 1) \
        .withColumn("n", F.count("*").over(Window.partitionBy("source"))) \
        .withColumn("before", F.sum("words").over(by_source) - F.col("words")) \
        .withColumn("part", F.least(F.col("words"), F.greatest(F.lit(0), F.col("rest") - F.col("before")))) \
        .withColumn("draws", F.col("passes") + (F.col("part") > 0).cast("long"))
    blocks = stored(blocks, "blocks")
    quotas = {r["source"]: r["draws"] for r in blocks.groupBy("source").agg(F.sum("draws").alias("draws")).collect()}
    rng = np.random.default_rng(seed)
    split = split_quotas(np.array([quotas.get(s.source, 0) for s in shares], dtype=np.int64), shards, rng) \
        if shares else np.zeros((shards, 0), dtype=np.int64)
    upto = np.cumsum(split, axis=0)
    cuts = spark.createDataFrame([(s.source, [int(x) for x in upto[:, i]]) for i, s in enumerate(shares)],
                                 T.StructType([schema["source"], T.StructField("upto", T.ArrayType(T.LongType()))]))
    # Draw k of a source is block place k % n in pass k // n; the shard whose range of draws has k takes it.
    draw = F.transform(F.sequence(F.lit(0).cast("long"), F.col("draws") - 1), lambda p: F.size(
        F.filter("upto", lambda u: u <= p * F.col("n") + F.col("place"))))
    drawn = blocks.join(cuts.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))) \
        .select("source", "block", "part", "words",
                F.when(F.col("draws") > 0, draw).otherwise(F.array().cast("array<int>")).alias("shards"))
    return Plan(placed, stored(drawn, "drawn"), shares, table)


def mix(docs: DataFrame, shards: int = SHARDS, seed: int = 7, block_words: int = BLOCK_WORDS,
        weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, ``order``, ``shards`` (one entry per copy) and ``taken``.

    Size is the number of words, 0 for null text. Sources go by code point with null last, weigh
    ``weights`` in turn, and share all sizes; none gives more than ``most`` times its
    size. Every document of a block that is drawn goes with it, once per draw. The one block
    per source that the target cuts is drawn in hash order up to the document nearest to the target, so a source misses its
    target by half a document at most. Ties go by id and hash; rows that are equal in both share their
    fate. Draws depend on the rows and ``seed`` only. Other columns are ignored.
    """
    made = plan(docs, shards, seed, block_words, weights, most)
    whole, partly = _drawn(made)
    return whole.unionByName(partly).select(
        "doc_id", "source", "size", "source_size", "target", "order", "shards",
        (F.col("size") * F.size("shards")).alias("taken"))


def _drawn(made: Plan) -> tuple[DataFrame, DataFrame]:
    """Documents with their shards: of blocks drawn whole, and of the one block per source that is cut.

    ``order`` names a document where an id is missing or repeated.
    """
    of_block = made.blocks.withColumnsRenamed({"source": "of", "block": "b"})
    joined = made.docs.join(F.broadcast(of_block), F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("b"))) \
        .drop("of", "b")
    cut = _is_cut()
    within = Window.partitionBy("source", "block").orderBy("order", F.col("doc_id").asc_nulls_last())
    partly = joined.where(cut).withColumn("reached", F.sum("size").over(within)) \
        .withColumn("shards", F.when(2 * F.col("reached") - F.col("size") <= 2 * F.col("part"), F.col("shards"))
                    .otherwise(F.slice("shards", 1, F.greatest(F.size("shards") - 1, F.lit(0))))).drop("reached")
    return joined.where(~cut), partly


def _is_cut() -> Column:
    return (F.col("part") > 0) & (F.col("part") < F.col("words"))


def mixed_documents(docs: DataFrame, shards: int = SHARDS, seed: int = 7, block_words: int = BLOCK_WORDS,
                    weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``docs`` as the mix takes them: a row per copy, none for what is not drawn, shuffled within each shard.

    Rows that share id and text are one document and are taken alike, each as often as the other. A row knows its block
    from its own hash, so texts are shuffled once, into their shards; only documents of cut blocks, one block per source,
    are looked up.
    """
    made = plan(docs, shards, seed, block_words, weights, most)
    fate = stored(_drawn(made)[1].select("doc_id", "order", F.col("shards").alias("fate")).distinct(), "cut-blocks")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source",
                        _hash(F.lit(seed), F.col("doc_id"), F.xxhash64("text")).alias("order"))
    of_source = made.sources.select("of", "blocks")
    placed = keyed.join(F.broadcast(of_source), F.col("source").eqNullSafe(F.col("of"))) \
        .withColumn("block", F.pmod("order", F.col("blocks"))).drop("of")
    of_block = made.blocks.withColumnsRenamed({"source": "of", "block": "b"})
    joined = placed.join(F.broadcast(of_block), F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("b")))
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.order") == F.col("f.order"))
    taken = joined.alias("d").join(fate.alias("f"), same, "left").select(
        "row", "d.order", F.posexplode(F.coalesce("fate", "shards")).alias("copy", "shard"))
    local = _hash(F.lit(seed + 2), F.col("shard"), F.col("order"), F.col("copy"))
    return taken.withColumn("place", local).repartitionByRange("shard", "place") \
        .sortWithinPartitions("shard", "place").select("row.*")
