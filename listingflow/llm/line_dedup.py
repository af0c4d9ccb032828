"""Repeated runs of lines, found by winnowing over line hashes.

A window starts at each line with a word and takes the lines that begin within its first ``min_words`` words, so it is the
shortest run from there with as many; another ends at each line and is the shortest run up to it. The least line
hash of a window is its fingerprint: copies of a window choose the same line. What is kept of a table are the fingerprints
with their positions, and those found at two positions or more are matches.

A match is extended both ways from its position, to the ends of the windows that chose it. Their line hashes in order tell
whether the copies agree so far, so a position is compared with the first one whose lines are the same and never with
each other one of its fingerprint. A line lies in a repeated run of ``min_words`` words or more if and only if
it lies in a repeated window of either kind: such a run, cut at either end as long as it holds the line and
enough words, ends up as the window of its first line or as that of its last. So the windows found again later make up the maximal runs.
Only hashes and places are shuffled until the runs of a document are known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listingflow.functions.text import let
from listingflow.llm.common import BLANKS, stored, word_count

#: A document is told by its id and the hash of its text.
_KEY = ("doc_id", "text_hash")


def lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """One row per line with a word: document, ``at`` (line number), ``nth`` (among lines with words), hash, and where it
    begins and ends in words; with the print and its position of the window from the line and of that up to it.

    Rows that share id and text are one document.
    """
    line = F.posexplode(F.split("text", "\n")).alias("at", "line")
    cut = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text") \
        .select(*_KEY, line).withColumn("line", F.btrim("line", F.lit(BLANKS))).where("line <> ''")
    rows = cut.select(*_KEY, "at", F.xxhash64("line").alias("hash"), word_count(F.col("line")).alias("words")) \
        .repartition(*_KEY).dropDuplicates([*_KEY, "at"])
    by_doc = Window.partitionBy(*_KEY).orderBy("at")
    placed = rows.withColumn("nth", F.row_number().over(by_doc) - 1).withColumn("ends", F.sum("words").over(by_doc)) \
        .withColumn("begins", F.col("ends") - F.col("words"))
    ahead, behind = _frames(min_words)

    def least(frame):
        return F.when(F.sum("words").over(frame) >= min_words, F.min(F.struct("hash", "nth")).over(frame))

    return placed.withColumns({"ahead": least(ahead), "behind": least(behind)})


def _frames(min_words: int):
    """The lines of the window from a line, and of that up to a line."""
    by_doc = Window.partitionBy(*_KEY)
    return (by_doc.orderBy("begins").rangeBetween(0, min_words - 1), by_doc.orderBy("ends").rangeBetween(1 - min_words, 0))


def positions(rows: DataFrame) -> DataFrame:
    """print, document and ``nth`` of every line that a window chose, once each."""
    chosen = F.explode(F.array_compact(F.array("ahead", "behind"))).alias("chosen")
    return rows.select(*_KEY, chosen).select(F.col("chosen.hash").alias("print"), *_KEY, F.col("chosen.nth").alias("nth")).distinct()


def matches(places: DataFrame) -> DataFrame:
    """The positions whose print is found at another position too.

    Written tables lie before and after the join, so a print with much of the table may be split over tasks.
    """
    shared = stored(places.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print"), "shared-prints")
    return stored(places.join(shared, "print", "left_semi").select(*_KEY, F.col("nth").alias("chosen")), "matches")


def extended(rows: DataFrame, matched: DataFrame, min_words: int = 50) -> DataFrame:
    """Document, start and stop (line numbers), first and last (``nth``) and ``run``, a hash of the line hashes in order, of
    the windows that chose a matched position."""
    ahead, behind = _frames(min_words)
    here = rows.join(matched.select(*_KEY).distinct(), list(_KEY), "left_semi")

    def run(chosen, frame, edge):
        start, stop = (F.struct("at", "nth"), edge) if frame is ahead else (edge, F.struct("at", "nth"))
        return F.when(F.col(chosen).isNotNull(), F.struct(
            F.col(f"{chosen}.nth").alias("chosen"), start.alias("start"), stop.alias("stop"),
            F.xxhash64(F.collect_list("hash").over(frame)).alias("run")))

    both = here.select(
        *_KEY, run("ahead", ahead, F.max(F.struct("at", "nth")).over(ahead)).alias("a"),
        run("behind", behind, F.min(F.struct("at", "nth")).over(behind)).alias("b"))
    # A window of both kinds is one.
    kinds = F.when(F.col("a.start.nth") == F.col("b.start.nth"), F.array("a")).otherwise(F.array("a", "b"))
    windows = both.select(*_KEY, F.explode(F.array_compact(F.coalesce(kinds, F.array("a", "b")))).alias("w"))
    return windows.select(*_KEY, F.col("w.chosen").alias("chosen"), "w.run",
                          F.col("w.start.at").alias("start"), F.col("w.stop.at").alias("stop"),
                          F.col("w.start.nth").alias("first"), F.col("w.stop.nth").alias("last")) \
        .join(matched, [*_KEY, "chosen"], "left_semi").drop("chosen")


def repeated_runs(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """doc_id, text_hash and ``runs``, the ranges (start, stop) of lines that lie in a run found earlier.

    Ranges that touch are one. Earlier is by doc_id, then line; rows without an id come last, and documents
    of the same id but other text are ordered by the text's hash.
    """
    rows = stored(lines(docs, min_words), "lines")
    matched = matches(stored(positions(rows), "positions"))
    windows = stored(extended(rows, matched, min_words), "windows")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "first")
    first = windows.groupBy("run").agg(F.min(place).alias("origin"), F.count("*").alias("n")).where("n > 1").select("run", "origin")
    later = windows.join(stored(first, "first-runs"), "run").where(place > F.col("origin")).select(*_KEY, "start", "stop", "first", "last")
    by_doc = Window.partitionBy(*_KEY).orderBy("first", "last")
    reached = F.max("last").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    islands = stored(later, "later-runs").withColumn("new", F.when(F.col("first") <= reached + 1, 0).otherwise(1)) \
        .withColumn("island", F.sum("new").over(by_doc)) \
        .groupBy(*_KEY, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return islands.groupBy(*_KEY).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("runs"))


def dedup_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """``docs`` with later repeated runs deleted from ``text``, and the column ``removed_runs``.

    A run is a sequence of consecutive lines with words, of at least ``min_words`` words in
    all; lines are equal if they are so without white space at either end. The earliest copy stays
    (least doc_id, then line, within a document as well), the others are deleted whole
    with the blank lines inside them. Shorter repeats stay, and so do lines that a run only touches. A text of
    nothing but repeats becomes empty; null stays null. Rows that share id and text are one
    document and are treated alike. removed_runs has the first and last line number (from 0)
    of each deleted stretch of lines. Other columns are kept whatever their names; a column removed_runs is replaced.
    """
    runs = repeated_runs(docs, min_words)
    marked = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), "text")
    joined = marked.alias("d").join(runs.alias("r"), F.col("d.doc_id").eqNullSafe(F.col("r.doc_id"))
                                    & (F.col("d.text_hash") == F.col("r.text_hash")), "left") \
        .select("row", "text", "runs")
    size = F.size("runs")

    def without(parts):
        gaps = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(
            F.when(i == 0, 0).otherwise(F.get("runs", i - 1)["stop"] + 1).alias("start"),
            F.when(i == size, F.size(parts)).otherwise(F.get("runs", i)["start"]).alias("stop")))
        return F.array_join(F.flatten(F.transform(
            gaps, lambda g: F.slice(parts, g["start"] + 1, g["stop"] - g["start"]))), "\n")

    cleaned = F.when(F.col("runs").isNull(), F.col("text")).otherwise(let(F.split("text", "\n"), without))
    removed = F.coalesce("runs", F.array().cast("array<struct<start:int,stop:int>>"))
    kept = [cleaned.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c != "removed_runs"]
    return joined.select(*kept, removed.alias("removed_runs"))
