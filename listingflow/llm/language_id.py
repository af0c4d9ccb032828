"""Language by nearest centroid.

A text is a vector of hashed character 1- to 3-grams, weighted by TF-IDF and brought to length one.
Each language has several centroids, clustered from a bounded sample; the nearest by cosine gives the
language, and a text far from all is rejected. Document frequencies count every training text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingflow.llm.common import bundles, stored

DIMENSIONS = 4096
CLUSTERS = 4
#: Training texts that centroids are clustered from, over all languages, as an expectation; every one gives document frequencies.
SAMPLE = 1600
#: Training texts of a language at least, as an expectation, however many languages there are; the text of the least hash is always one.
LEAST = 16
#: A text is rejected if its cosine is less than this share of what 99 % of the sampled texts of the language
#: reach. For a text of fewer than ``FULL`` letters the bound falls with the root of their number,
#: as the cosine of a short text does.
SLACK = 0.5
FULL = 400

_LETTER = regex.compile(r"\p{L}").search


def features(text: str, dimensions: int = DIMENSIONS, block: int = 1 << 18) -> np.ndarray:
    """Counts of hashed 1- to 3-grams of the lower-cased text; each run of other than letters is one space.

    A text is taken ``block`` characters at a time, whatever its length; the last two points go on into the next block.
    """
    counts = np.zeros(dimensions, dtype=np.float64)
    lowered = text.lower()
    held, after_letter = np.array([32], dtype=np.uint64), True
    _count(held, 0, counts)
    for start in range(0, len(lowered), block):
        points = np.frombuffer(lowered[start:start + block].encode("utf-32-le", "replace"), dtype="<u4")
        letters = _is_letter(points)
        kept = points[letters | np.append(after_letter, letters[:-1])]
        after_letter = letters[-1]
        held = np.concatenate([held, np.where(_is_letter(kept), kept, 32).astype(np.uint64)])
        if len(kept):
            _count(held, len(held) - len(kept), counts)
        held = held[-2:]
    _count(np.append(held, np.uint64(32)), len(held), counts)
    return counts


def _count(points: np.ndarray, first: int, counts: np.ndarray) -> None:
    """Adds the 1- to 3-grams that end at index ``first`` or later."""
    dimensions = len(counts)
    h = points * np.uint64(0x9E3779B97F4A7C15)
    for n in range(3):
        if n:
            if len(points) <= n:
                return
            # The hash of a gram goes on from that of the gram without its last point.
            h = h[:len(points) - n] * np.uint64(0x100000001B3) + points[n:] + np.uint64(n + 1)
        new = h[max(0, first - n):]
        mixed = (new ^ (new >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        counts += np.bincount((mixed >> np.uint64(40)).astype(np.int64) % dimensions, minlength=dimensions)


def _letter_table() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x30000)])


_TABLE: list[np.ndarray] = []


def _is_letter(points: np.ndarray) -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_letter_table())
    return _TABLE[0][np.minimum(points, 0x2FFFF)]


@dataclass(frozen=True)
class Model:
    """``centroids[i]`` stands for ``languages[owner[i]]``; texts nearer than ``floor`` of it are accepted."""

    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    floor: np.ndarray

    def vector(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) * self.idf
        norm = np.sqrt((v * v).sum())
        return (v / norm if norm else v).astype(np.float32)

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine (0 to 1) and whether the text is rejected."""
        if not text or not _LETTER(text) or not len(self.owner):
            return "und", 0.0, True
        counts = features(text, len(self.idf))
        cosines = self.centroids @ self.vector(counts)
        best = int(cosines.argmax())
        score = float(min(1.0, max(0.0, cosines[best])))
        floor = self.floor[self.owner[best]] * min(1.0, (counts.sum() / 3 / FULL) ** 0.5)
        return self.languages[self.owner[best]], score, bool(score < floor)


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: crc32 of the id as text is 2 mod 4. False without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _cluster(vectors: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; fewer centroids if there are fewer vectors."""
    centers = vectors[rng.choice(len(vectors), min(k, len(vectors)), replace=False)].copy()
    for _ in range(rounds):
        owner = (vectors @ centers.T).argmax(axis=1)
        for i in range(len(centers)):
            if (owner == i).any():
                total = vectors[owner == i].sum(axis=0)
                centers[i] = total / max(np.linalg.norm(total), 1e-9)
    return centers


def fit(docs: DataFrame, dimensions: int = DIMENSIONS, clusters: int = CLUSTERS, sample: int = SAMPLE) -> Model:
    """A model from the documents with text, lang and id that are not held out.

    Every one counts for document frequency. Centroids come from about ``sample`` texts, equally many per
    language, or from about ``LEAST`` per language if that is more, chosen by a hash of the id; that is the bound on
    what reaches the driver, besides rows that share an id.
    """
    train = docs.select("doc_id", "text", "lang").where("doc_id is not null and text is not null and lang is not null").where(~held_out(F.col("doc_id")))
    spread = 1 << 30
    place = F.pmod(F.xxhash64(F.lit("lang"), "doc_id"), F.lit(spread))
    found = train.groupBy("lang").agg(F.count("*").alias("n"), F.min(place).alias("least")).collect()
    languages = sorted(r["lang"] for r in found)
    quota = max(LEAST, sample // max(1, len(languages)))
    upto = docs.sparkSession.createDataFrame(
        [(r["lang"], max(r["least"] + 1, int(spread * min(1.0, quota / r["n"])))) for r in found], "learned string, upto long")
    train = train.join(F.broadcast(upto), F.col("lang") == F.col("learned"))
    taken = place < F.col("upto")

    def count(batches) -> Iterator[pa.RecordBatch]:
        """For each sampled text its counts; at the end the document frequencies of the partition."""
        present = np.zeros(dimensions, dtype=np.int64)
        n = 0
        for rows, texts in bundles(batches):
            picked = []
            for text, lang, pick in zip(texts, rows.column("lang").to_pylist(), rows.column("taken").to_pylist(), strict=True):
                counts = features(text, dimensions)
                present += counts > 0
                n += 1
                if pick:
                    picked.append((lang, counts))
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang for lang, _ in picked], pa.string()), pa.array([None] * len(picked), pa.int32()),
                 pa.array([None] * len(picked), pa.int64()),
                 pa.array([f.astype(np.float32).tobytes() for _, f in picked], pa.binary())],
                names=["lang", "dim", "n", "counts"])
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(dimensions + 1, pa.string()), pa.array(np.arange(-1, dimensions), pa.int32()),
             pa.array(np.append(n, present)), pa.nulls(dimensions + 1, pa.binary())], names=["lang", "dim", "n", "counts"])

    # A frame is read twice below, so it is written: sampled counts and a row per dimension and partition.
    rows = stored(train.select("text", "lang", taken.alias("taken"))
                  .mapInArrow(count, "lang string, dim int, n long, counts binary"), "language-counts")
    df = np.zeros(dimensions + 1)
    for r in rows.where("dim is not null").groupBy("dim").agg(F.sum("n").alias("n")).collect():
        df[r["dim"] + 1] = r["n"]
    idf = np.log((1 + df[0]) / (1 + df[1:])) + 1
    model = Model(languages, idf, np.zeros((0, dimensions), np.float32), np.zeros(0, int), np.zeros(len(languages)))
    sampled: dict[str, list[np.ndarray]] = {lang: [] for lang in languages}
    for r in rows.where("lang is not null").select("lang", "counts").orderBy("lang", "counts").collect():
        sampled[r["lang"]].append(model.vector(np.frombuffer(r["counts"], dtype=np.float32).astype(np.float64)))
    rng = np.random.default_rng(0)
    centroids, owner, floor = [], [], np.zeros(len(languages))
    for i, lang in enumerate(languages):
        if sampled[lang]:
            vectors = np.stack(sampled[lang])
            own = _cluster(vectors, clusters, rng)
            centroids.append(own)
            owner += [i] * len(own)
            floor[i] = SLACK * float(np.quantile((vectors @ own.T).max(axis=1), 0.01))
    return Model(languages, idf, np.concatenate(centroids) if centroids else model.centroids,
                 np.array(owner, dtype=int), floor)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and rejected for every row; only the text is looked at.

    ``und`` with score 0, rejected, if the text is null or has no letter, or if nothing
    was learned. Other columns are ignored; repeated rows are judged alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for rows, texts in bundles(batches):
            judged = [shared.value.judge(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array([j[0] for j in judged], pa.string()),
                 pa.array([j[1] for j in judged], pa.float64()), pa.array([j[2] for j in judged], pa.bool_())],
                names=["doc_id", "lang_pred", "score", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame) -> DataFrame:
    """``predict`` with a model fitted on the same table, and ``held_out``."""
    return predict(docs, fit(docs)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def accepted(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose language is rejected; rows and columns stay as they are otherwise.

    The text is judged beside its row, so no join is needed and rows without an id are judged too. If no row has a
    language to learn from, nothing can be rejected and every row stays.
    """
    model = fit(docs)
    if not model.languages:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for rows, texts in bundles(batches):
            yield rows.filter(pa.array([not shared.value.judge(t)[2] for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
