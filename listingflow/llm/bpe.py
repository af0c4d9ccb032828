"""BPE encoding by dynamic programming over prefixes, and decoding.

Of the tokens that end a prefix of a word exactly one is the last token of the
prefix's encoding: the one whose rest is encoded with a last token it is
compatible with, that is, no merge crosses the border between the two. An
automaton over all tokens reports those that end at each place; a table keeps the
one that fits; following the table back from the word's end gives the ids.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listingflow.llm.common import bundles
from listingflow.llm.wordpieces import WordCache, WordPieces, compiled, read_vocabulary

_NEVER = 2**31


class PrefixEncoder:
    """Exact ids of words."""

    def __init__(self, content: bytes) -> None:
        self.pieces = WordPieces(content)
        vocab = self.pieces.vocab
        self._rank: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int]] = {}
        spelled = {int(i): chr(b) for b, i in enumerate(self.pieces.inner)}
        spelled |= {int(i): chr(256 + b) for b, i in enumerate(self.pieces.last)}
        #: For each token the pieces at its left and right border, from the whole down to one
        #: symbol, with the rank of the merge that takes each piece up.
        self._left = {i: [(i, _NEVER)] for i in spelled}
        self._right = {i: [(i, _NEVER)] for i in spelled}
        usable = set(spelled)
        for rank, (a, b) in enumerate(self.pieces.merges):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            if whole in spelled:
                raise ValueError(f"two merges make the token {a + b!r}")
            parts[whole] = (left, right)
            spelled[whole] = spelled[left] + spelled[right]
            self._rank[left, right] = rank
            self._left[whole] = [(whole, _NEVER), (left, rank), *self._left[left][1:]]
            self._right[whole] = [(whole, _NEVER), (right, rank), *self._right[right][1:]]
        for whole, (left, right) in parts.items():
            # A token can occur only if its own symbols merge into it.
            if left in usable and right in usable and self._borders(left, right, self._rank[left, right]):
                usable.add(whole)
        self._length = {i: len(spelled[i]) for i in usable}
        self._automaton = ahocorasick.Automaton()
        for i in usable:
            self._automaton.add_word(spelled[i], (len(spelled[i]), i))
        self._automaton.make_automaton()
        self._fits: dict[int, bool] = {}
        #: The ids of a word as bytes of 32-bit numbers, a fraction of what a tuple takes.
        self.cache = WordCache()

    def _borders(self, left: int, right: int, until: int) -> bool:
        """Whether no merge crosses the border before rank ``until``.

        Pieces that meet there merge if their pair's rank comes before both are taken
        up. Equal ranks go by place, left first.
        """
        rank = self._rank
        for a, taken in self._right[left]:
            for b, upto in self._left[right]:
                crossing = rank.get((a, b))
                if crossing is not None and crossing < min(taken, until) and crossing <= upto:
                    return False
        return True

    def _compatible(self, left: int, right: int) -> bool:
        if len(self._fits) >= 300_000:
            self._fits.clear()
        found = self._fits[left << 32 | right] = self._borders(left, right, _NEVER)
        return found

    def encode(self, word: str) -> list[int]:
        """The ids of one word."""
        if word in self.pieces.special:
            return [self.pieces.special[word]]
        spelled = word.encode("utf-8", "replace").decode("latin-1")
        spelled = spelled[:-1] + chr(256 + ord(spelled[-1]))
        last = [-1] * len(spelled)
        fits, test = self._fits, self._compatible
        for end, (length, token) in self._automaton.iter(spelled):
            if last[end] < 0:
                before = end - length
                if before < 0:
                    last[end] = token
                elif (prior := last[before]) >= 0 and \
                        (ok if (ok := fits.get(prior << 32 | token)) is not None else test(prior, token)):
                    last[end] = token
        ids, at = [], len(spelled) - 1
        while at >= 0:
            ids.append(last[at])
            at -= self._length[last[at]]
        return ids[::-1]

    def encode_all(self, words: list[str]) -> list[bytes]:
        return [array("i", self.encode(word)).tobytes() for word in words]

    def encode_texts(self, texts: list[str]) -> pa.ListArray:
        """The ids of whole texts."""
        words = [self.pieces.words(text) for text in texts]
        self.cache.fill(words, self.encode_all)
        lists = [b"".join(map(self.cache.__getitem__, found)) for found in words]
        offsets = np.cumsum([0, *(len(x) // 4 for x in lists)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(lists), dtype=np.int32)))


def decode_ids(strings: dict[int, str], column: pa.Array) -> pa.Array:
    """Texts of lists of ids: the tokens joined by one space, ids that are not listed left out."""
    lists = (row.values.to_numpy(zero_copy_only=False).tolist() if row.is_valid else () for row in column)
    return pa.array([" ".join([s for i in ids if (s := strings.get(i))]) for ids in lists], pa.string())


def encode(docs: DataFrame, vocabulary: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``ids``, the token ids of every whole text.

    ``vocabulary`` is the path of a word BPE file on the driver; the default is the
    public one. No begin, end or other added tokens; special strings inside a text
    are their own ids. Null text is encoded as the empty text: no ids. Rows are kept
    as they come, repeated or without an id; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    schema = docs.select(*keep).schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches) -> Iterator[pa.RecordBatch]:
        encoder = compiled(shared.value, PrefixEncoder)
        for rows, texts in bundles(batches):
            ids = encoder.encode_texts(texts)
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), ids], names=[*keep, "ids"])

    return docs.select(*keep, "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``text``, the tokens of ``ids`` as the vocabulary spells them.

    The file names no decoder, so tokens are joined by one space and special tokens
    stay. Null and empty ``ids`` give the empty text; an id that the vocabulary lacks is left out.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    schema = encoded.select(*keep).schema.add("text", "string")

    def run(batches) -> Iterator[pa.RecordBatch]:
        pieces = compiled(shared.value)
        strings = dict(enumerate(pieces.strings))
        for batch in batches:
            # A few rows at a time: a batch of long texts would be held several times over.
            for start in range(0, batch.num_rows, 64):
                rows = batch.slice(start, 64)
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(c) for c in keep), decode_ids(strings, rows.column("ids"))], names=[*keep, "text"])

    return encoded.select(*keep, "ids").mapInArrow(run, schema)


def encode_and_decode(docs: DataFrame, vocabulary: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``encode`` and ``decode`` of its ids in one pass: the columns ``keep``, ``ids`` and ``decoded``."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    schema = docs.select(*keep).schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", T.StringType())

    def run(batches) -> Iterator[pa.RecordBatch]:
        encoder = compiled(shared.value, PrefixEncoder)
        strings = dict(enumerate(encoder.pieces.strings))
        for rows, texts in bundles(batches):
            ids = encoder.encode_texts(texts)
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), ids, decode_ids(strings, ids)],
                                             names=[*keep, "ids", "decoded"])

    return docs.select(*keep, "text").mapInArrow(run, schema)


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text, for every row."""
    return encode_and_decode(docs, vocabulary).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
