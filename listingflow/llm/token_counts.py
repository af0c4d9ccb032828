"""Token counts by rank-synchronous array merging.

Words of a batch are one ragged numpy array of symbols. In each round every word
applies its own pair of lowest rank, all words at once; a word without a pair that
merges is counted and leaves the arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingflow.llm.common import bundles
from listingflow.llm.wordpieces import WordCache, WordPieces, compiled, read_vocabulary

_NONE = np.int32(2**31 - 1)


class RankMerger:
    """Counts what is left of words after all merges."""

    def __init__(self, content: bytes) -> None:
        self.pieces = WordPieces(content)
        vocab, size = self.pieces.vocab, self.pieces.size
        keys = np.array([vocab[a] * size + vocab[b] for a, b in self.pieces.merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self._keys = np.append(keys[order], np.int64(2**62))
        self._ranks = order.astype(np.int32)
        self._merged = np.array([vocab[a + b] for a, b in self.pieces.merges], dtype=np.int32)
        self._size = np.int64(size)
        self.cache = WordCache()

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left * self._size + right
        at = np.searchsorted(self._keys, wanted)
        hit = self._keys[at] == wanted
        ranks = np.full(len(wanted), _NONE, dtype=np.int32)
        ranks[hit] = self._ranks[at[hit]]
        return ranks

    def count(self, words: list[str], size: int = 200_000) -> list[int]:
        """Tokens of each word, in arrays of about ``size`` symbols or one word."""
        counts: list[int] = []
        chunk: list[bytes] = []
        held = 0
        for word in words:
            if word in self.pieces.special:
                counts += self._merge(chunk) + [1]
                chunk, held = [], 0
                continue
            data = word.encode("utf-8", "replace")
            if chunk and held + len(data) > size:
                counts += self._merge(chunk)
                chunk, held = [], 0
            chunk.append(data)
            held += len(data)
        return counts + self._merge(chunk)

    def _merge(self, words: list[bytes]) -> list[int]:
        if not words:
            return []
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        ends = np.cumsum(lengths)
        symbols = self.pieces.inner[data].astype(np.int64)
        symbols[ends - 1] = self.pieces.last[data[ends - 1]]
        counts = np.empty(len(words), dtype=np.int64)
        word = np.arange(len(words))
        owner = np.repeat(np.arange(len(words)), lengths)
        ranks = np.full(len(symbols), _NONE, dtype=np.int32)
        inside = np.flatnonzero(owner[:-1] == owner[1:])
        ranks[inside] = self._rank(symbols[inside], symbols[inside + 1])
        while len(word):
            starts = np.cumsum(lengths) - lengths
            lowest = np.minimum.reduceat(ranks, starts)
            ended = lowest == _NONE
            if ended.any():
                counts[word[ended]] = lengths[ended]
                stay = np.repeat(~ended, lengths)
                symbols, ranks = symbols[stay], ranks[stay]
                word, lengths, lowest = word[~ended], lengths[~ended], lowest[~ended]
                if not len(word):
                    break
            owner = np.repeat(np.arange(len(word)), lengths)
            hits = np.flatnonzero(ranks == lowest[owner])
            # A pair of equal symbols overlaps itself: in a run of hits every other one merges.
            follows = np.append(False, np.diff(hits) == 1)
            if follows.any():
                at = np.arange(len(hits))
                first = np.maximum.accumulate(np.where(follows, 0, at))
                hits = hits[(at - first) % 2 == 0]
            symbols[hits] = self._merged[ranks[hits]]
            stay = np.ones(len(symbols), dtype=bool)
            stay[hits + 1] = False
            lengths = lengths - np.bincount(owner[hits], minlength=len(word))
            place = hits - np.arange(len(hits))
            symbols, ranks, owner = symbols[stay], ranks[stay], owner[stay]
            touched = np.unique(np.concatenate([place, place[place > 0] - 1]))
            pairs = touched[touched + 1 < len(symbols)]
            same = owner[pairs] == owner[pairs + 1]
            ranks[touched] = _NONE
            pairs = pairs[same]
            ranks[pairs] = self._rank(symbols[pairs], symbols[pairs + 1])
        return counts.tolist()


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text.

    ``vocabulary`` is the path of a word BPE file on the driver; the default is the
    public one. Null text counts as the empty text: no bytes, no tokens. Rows are
    kept as they come, repeated or without an id; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def count(batches) -> Iterator[pa.RecordBatch]:
        merger = compiled(shared.value, RankMerger)
        for rows, texts in bundles(batches):
            words = [merger.pieces.words(text) for text in texts]
            merger.cache.fill(words, merger.count)
            sizes = [sum(map(merger.cache.__getitem__, found)) for found in words]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("n_bytes"), pa.array(sizes, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"])

    kept = docs.select("doc_id", "text",
                       F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long") \
        .withColumn("over_limit", F.col("n_tokens") > limit)
