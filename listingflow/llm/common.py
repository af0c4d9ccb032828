"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listingflow.session import scratch_dir, stored

#: What separates words, as a trim set and as a pattern.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

__all__ = ["BLANKS", "BLANK_RUN", "DOCUMENT_COLUMNS", "bundles", "read_table", "scratch_dir",
           "stored", "word_array", "word_count"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_array(text: Column) -> Column:
    """The words of a text; none for null and for blank text."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.array().cast("array<string>")) \
        .otherwise(F.split(trimmed, BLANK_RUN))


def word_count(text: Column) -> Column:
    """How many words a text has, as a long."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.lit(0)) \
        .otherwise(F.size(F.split(trimmed, BLANK_RUN))).cast("long")


def bundles(batches, size: int = 1_000_000) -> Iterator[tuple]:
    """(record batch, texts) for slices of at most ``size`` bytes of text, one row at least.

    The text is the column ``text``; null becomes the empty text. A slice is what
    a task holds as Python strings at a time, so memory does not follow the batch.
    """
    for batch in batches:
        column = batch.column("text")
        start, held, texts = 0, 0, []
        for i in range(batch.num_rows):
            text = column[i].as_py() or ""
            if texts and held + len(text) > size:
                yield batch.slice(start, i - start), texts
                start, held, texts = i, 0, []
            texts.append(text)
            held += len(text)
        if texts:
            yield batch.slice(start), texts
