"""SimHash near-duplicates through anchor points of a covering code.

Two fingerprints that differ in 3 bits differ in at most one bit in one of their
halves. For a half the anchors are the words of a Hamming code with a free bit
beside it: every 32-bit value has its own anchor within the covering radius of 1.
Each fingerprint goes to every anchor within radius plus threshold, about 17 per
half, so that any two that are close meet at the anchor of either. Only
there are they compared.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingflow.llm.common import bundles, stored
from listingflow.llm.graph import components

#: Rows of an anchor's tile: a larger bucket is cut into a grid of tiles.
TILE = 2048


def simhash(text: str, shingle: int = 3, block: int = 50_000) -> int:
    """The unsigned fingerprint of a text; 0 if it has no word."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    hashed = partial(xxhash.xxh64_intdigest, seed=42)
    n = max(1, len(words) - shingle + 1)

    def blocks() -> Iterator[np.ndarray]:
        for start in range(0, n, block):
            part = words[start:min(start + block, n) + shingle - 1]
            grams = map(b" ".join, zip(*(part[k:] for k in range(shingle)), strict=False)) \
                if len(words) >= shingle else [b" ".join(words)]
            yield np.fromiter(map(hashed, grams), dtype="<u8")

    return majority(blocks())


def majority(blocks: Iterable[np.ndarray]) -> int:
    """The unsigned fingerprint of hashes: a bit is 1 if it is set in over half of them; 0 of none."""
    counts, n = np.zeros(64, dtype=np.int64), 0
    for h in blocks:
        bits = np.unpackbits(h.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(((counts * 2 > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and the signed 64-bit ``fp`` of every whole text; null text is 0 as one without words."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for rows, texts in bundles(batches):
            values = np.array([simhash(t, shingle) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(values)], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def _syndrome(half: np.ndarray) -> np.ndarray:
    """The check bits of 32-bit values: the exclusive or of the places 1 to 31 of set bits; place 0 is free."""
    masks = [sum(1 << place for place in range(32) if place >> k & 1) for k in range(5)]
    return sum((np.bitwise_count(half & np.uint32(m)) & 1).astype(np.int64) << k for k, m in enumerate(masks))


def _offsets(reach: int) -> list[np.ndarray]:
    """By syndrome, what takes a value to each anchor within ``reach``; its own anchor comes first."""
    found: dict[int, list[int]] = {s: [] for s in range(32)}
    for weight in range(reach + 1):
        for places in combinations(range(32), weight):
            s = 0
            for place in places:
                s ^= place
            found[s].append(sum(1 << place for place in places))
    # The anchor of a value is the nearest with the same free bit.
    return [np.array(sorted(x, key=lambda e: (e.bit_count(), e & 1)), dtype=np.uint32) for x in found.values()]


def at_anchors(fps: DataFrame, threshold: int = 3) -> DataFrame:
    """``anchor``, ``fp`` and ``home`` for every anchor within covering radius plus threshold."""
    table = _offsets(1 + threshold // 2)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for k in (0, 1):
                half = (fp >> np.uint64(32 * k)).astype(np.uint32)
                syndrome = _syndrome(half)
                for s in np.unique(syndrome):
                    own = syndrome == s
                    anchors = (half[own, None] ^ table[s][None]).astype(np.int64) | (k << 32)
                    home = np.zeros(anchors.shape, dtype=bool)
                    home[:, 0] = True
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchors.ravel()), pa.array(np.repeat(fp[own].view(np.int64), anchors.shape[1])),
                         pa.array(home.ravel())], names=["anchor", "fp", "home"])

    return fps.select("fp").mapInArrow(run, "anchor long, fp long, home boolean")


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that each of ``n`` nodes reaches."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        while (jumped := new[new]).tobytes() != new.tobytes():
            new = jumped
        if (new == label).all():
            return label
        label = new


def _stars(group: np.ndarray, fp: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the rows of each group link, one at most for each fingerprint.

    Rows are sorted by group and have home rows first. Pairs of a home row and any row of a
    group are compared a slice at a time.
    """
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    sizes = np.diff(np.append(starts, len(group)))
    homes = np.add.reduceat(home.astype(np.int64), starts)
    rows = np.flatnonzero(home)
    width = np.repeat(sizes - homes, homes)
    first = np.repeat(starts + homes, homes)
    nodes, index = np.unique(fp, return_inverse=True)
    label = np.arange(len(nodes))
    upto = np.cumsum(width)
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + 500_000, "right")))
        w = width[at:to]
        x = np.repeat(rows[at:to], w)
        y = np.arange(len(x)) - np.repeat(np.cumsum(w) - w, w) + np.repeat(first[at:to], w)
        near = np.bitwise_count(fp[x] ^ fp[y]) <= threshold
        label = label[_labels(len(nodes), label[index[x[near]]], label[index[y[near]]])[label]] \
            if near.any() else label
        at = to
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def link_stars(fps: DataFrame, threshold: int = 3, tile: int = TILE) -> DataFrame:
    """Edges ``a``, ``b`` between distinct fingerprints whose components are those of all links.

    A link is a pair that differs in at most ``threshold`` bits. Buckets without a second
    fingerprint are dropped before comparing; those of more than ``tile`` rows are cut into a grid of tiles,
    so a task holds two tile sides and emits at most an edge per row of them, however dense the bucket.
    """
    members = stored(at_anchors(fps, threshold), "anchors")
    sizes = members.groupBy("anchor").agg(F.count("*").alias("n"), F.max("home").alias("used")) \
        .where("n > 1 and used").select("anchor", "n")
    parts = F.ceil(F.col("n") / tile).cast("int")
    chunk = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    grid = F.sequence(F.lit(0), F.col("parts") - 1)
    rows = members.join(sizes, "anchor").withColumn("parts", parts).withColumn("chunk", chunk)
    as_any = F.transform(grid, lambda i: F.struct((i * F.col("parts") + F.col("chunk")).alias("tile"),
                                                  F.lit(False).alias("home")))
    as_home = F.transform(grid, lambda j: F.struct((F.col("chunk") * F.col("parts") + j).alias("tile"),
                                                   F.lit(True).alias("home")))
    spread = rows.select("anchor", "fp", F.explode(F.when(F.col("home"), F.concat(as_any, as_home))
                                                   .otherwise(as_any)).alias("at")) \
        .select("anchor", "at.tile", "fp", "at.home")

    def run(batches) -> Iterator[pa.RecordBatch]:
        def edges(table: pa.Table) -> pa.RecordBatch:
            anchor, place = (table.column(c).to_numpy() for c in ("anchor", "tile"))
            change = np.append(False, (anchor[1:] != anchor[:-1]) | (place[1:] != place[:-1]))
            home = table.column("home").to_numpy()
            a, b = _stars(np.cumsum(change), table.column("fp").to_numpy().view(np.uint64), home, threshold)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))],
                                              names=["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < 100_000:
                continue
            table = pa.Table.from_batches(held)
            anchor, place = table.column("anchor").to_numpy(), table.column("tile").to_numpy()
            cut = np.flatnonzero((anchor != anchor[-1]) | (place != place[-1]))
            cut = int(cut[-1]) + 1 if len(cut) else 0  # the last tile may go on
            if cut:
                yield edges(table.slice(0, cut))
            held = table.slice(cut).to_batches()
        if held:
            yield edges(pa.Table.from_batches(held))

    return spread.repartition("anchor", "tile").sortWithinPartitions("anchor", "tile", F.desc("home")) \
        .mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, threshold: int = 3, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint, component_id, group_size and copies of every row.

    Fingerprints that differ in at most ``threshold`` bits (0 to 7) are linked, equal ones too. component_id
    is the smallest doc_id reachable, group_size the rows reached, copies the rows of the same fingerprint. Null and blank texts share
    fingerprint zero. Rows without a doc_id are compared like others but never name
    a component, unless none in it has an id: then component_id is null. Repeated rows are rows like
    others. Other columns are ignored.
    """
    if not 0 <= threshold <= 7:
        raise ValueError("threshold is 0 to 7")
    marked = stored(fingerprints(docs, shingle), "fingerprints")
    classes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")),
                     "classes")
    linked = components(stored(link_stars(classes, threshold), "stars")) \
        .select(F.col("node").alias("fp"), "component")
    linked = stored(linked, "components")
    groups = classes.join(linked, "fp").groupBy("component") \
        .agg(F.min("first").alias("group_first"), F.sum("copies").alias("group_size"))
    named = classes.join(linked.join(groups, "component").drop("component"), "fp", "left").select(
        "fp", F.when(F.col("group_size").isNull(), F.col("first")).otherwise(F.col("group_first")).alias("component_id"),
        F.coalesce("group_size", "copies").alias("group_size"), "copies")
    return marked.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id", "group_size", "copies")
