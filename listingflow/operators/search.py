"""Keyword tags and ranked text search."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from listingflow import vocabulary as V
from listingflow.functions.text import let
from listingflow.session import stored

#: Folders that stored postings are dealt to by a hash of the term.
BUCKETS = 64


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _phrases(text: Column, longest: int) -> Column:
    """All runs of one to ``longest`` words of the text."""
    def runs_of(words, n):
        return F.transform(words, lambda w, i: F.array_join(F.slice(words, i + 1, F.lit(n)), " "))

    def runs(words):
        return F.concat(words, *[runs_of(words, n) for n in range(2, longest + 1)])

    return let(_tokens(text), runs)


def _keywords_in(text: Column, words: Iterable[str]) -> Column:
    """The keywords, in their order, that occur in the text as whole words.

    Words of the text are looked up in a constant set, so the cost follows the
    text and not the number of keywords.
    """
    plain = list(dict.fromkeys(w.lower() for w in words))
    longest = max(len(w.split()) for w in plain)
    return F.array_intersect(F.array(*map(F.lit, plain)), _phrases(text, longest))


def tag_keywords(df: DataFrame, text: Column, key: str,
                 dictionary: Mapping[str, list[str]] = V.KEYWORDS) -> DataFrame:
    """One row per row, category and keyword found in the text.

    The dictionary is a few constant lists, so it is part of the expression:
    no join and no shuffle.
    """
    entries: dict[str, list] = {}
    for category, words in dictionary.items():
        for word in words:
            entries.setdefault(word.lower(), []).append(
                F.struct(F.lit(category).alias("category"), F.lit(word).alias("keyword")))
    lookup = F.create_map(*[c for w, e in entries.items() for c in (F.lit(w), F.array(*e))])
    return (df.select(key, F.explode(_keywords_in(text, entries)).alias("found"))
            .select(key, F.explode(F.element_at(lookup, F.col("found"))).alias("hit"))
            .select(key, "hit.category", "hit.keyword"))


def keyword_union(text: Column, categories: Iterable[str],
                  dictionary: Mapping[str, list[str]] = V.KEYWORDS) -> Column:
    """Keywords found in the text, the categories' lists joined in order, no repeats."""
    return _keywords_in(text, [w for c in categories for w in dictionary[c]])


#: Bits of the filter that phrases of texts pass before they are joined, in longs.
FILTER_LONGS = 1 << 14


def _bits(phrase: Column) -> list[tuple[Column, Column]]:
    """Two places of a phrase in the filter: which long, and its mask."""
    h = F.xxhash64(phrase)
    places = (F.pmod(h, F.lit(64 * FILTER_LONGS)), F.pmod(F.shiftright(h, 32), F.lit(64 * FILTER_LONGS)))
    return [(F.floor(p / 64).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), (p % 64).cast("int"))) for p in places]


def phrase_filter(phrases: DataFrame, phrase: str = "phrase") -> DataFrame:
    """One row with ``bits``, a Bloom filter of the phrases: longs that an aggregate makes of any number of rows."""
    places = phrases.select(F.explode(F.array(*[F.struct(at.alias("at"), mask.alias("mask")) for at, mask in _bits(F.col(phrase))]))
                            .alias("b")).groupBy("b.at").agg(F.bit_or("b.mask").alias("mask"))
    every = phrases.sparkSession.range(FILTER_LONGS).select(F.col("id").cast("int").alias("at")).join(places, "at", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("mask", F.lit(0)).alias("mask")))),
                                 lambda x: x["mask"]).alias("bits"))


def tag_dictionary(df: DataFrame, text: Column, key: str, dictionary: DataFrame) -> DataFrame:
    """One row per row, category and keyword of ``dictionary`` (category, keyword) that the text has as whole words.

    The dictionary is a table of any size. Each run of words as long as some keyword is looked up once per text: a Bloom
    filter of the keywords passes few that are none, and those are joined by the phrase. A dictionary that fits is
    broadcast by the size that adaptive execution measures, and then texts are not shuffled; of texts only the key and
    phrases that pass are shuffled otherwise. Keywords without a letter or digit are never found.
    """
    entries = dictionary.select("category", "keyword", F.array_join(_tokens(F.col("keyword")), " ").alias("phrase")) \
        .where("phrase <> ''").distinct()
    entries = stored(entries, "dictionary")
    lengths = sorted(r[0] for r in entries.select(F.size(F.split("phrase", " "))).distinct().collect())
    if not lengths:
        return df.select(key).limit(0).withColumns({"category": F.lit(""), "keyword": F.lit("")})
    bits = stored(phrase_filter(entries), "dictionary-filter").select("bits").scalar()

    def runs(words: Column) -> Column:
        return F.array_distinct(F.concat(*[F.transform(
            F.filter(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), lambda i: i + n - 1 <= F.size(words)),
            lambda i: F.array_join(F.slice(words, i, F.lit(n)), " ")) for n in map(int, lengths)]))

    found = df.select(key, F.explode(let(_tokens(text), runs)).alias("phrase"))
    passes = F.lit(True)
    for at, mask in _bits(F.col("phrase")):
        passes = passes & (F.get(bits, at).bitwiseAND(mask) != 0)
    return found.where(passes).join(entries, "phrase").select(key, "category", "keyword")


def _counted(words: Column) -> Column:
    """Each word of a sorted array with how often it occurs."""
    n = F.size(words)
    starts = F.filter(F.sequence(F.lit(0), n - 1),
                      lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)))

    def runs(at: Column) -> Column:
        return F.transform(at, lambda i, j: F.struct(
            F.get(words, i).alias("term"),
            (F.coalesce(F.get(at, j + 1), n) - i).cast("bigint").alias("tf")))

    return F.when(n > 0, let(starts, runs))


def build_postings(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """term, key, tf over the text columns of a table whose ``key`` is unique.

    All words of a key are in its row, so they are counted there and nothing is shuffled.
    """
    found = let(F.sort_array(_tokens(F.concat_ws(" ", *columns))), _counted)
    return df.select(key, F.explode(found).alias("p")).select("p.term", key, "p.tf")


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def write_postings(postings: DataFrame, path: str) -> None:
    """Postings by hash of the term, sorted by it, so that a query reads few files and few row groups.

    Rebalancing splits the bucket of a very common term over several files.
    """
    (postings.withColumn("bucket", _bucket(F.col("term"))).hint("rebalance", "bucket")
     .sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(path))


def read_postings(spark: SparkSession, path: str, query: Iterable[str]) -> DataFrame:
    """Stored postings of the query's terms; folders of other terms are not read."""
    terms = list(dict.fromkeys(t.lower() for t in query))
    return (spark.read.parquet(path)
            .filter(F.col("bucket").isin([_bucket(F.lit(t)) for t in terms]) & F.col("term").isin(terms))
            .drop("bucket"))


def search(postings: DataFrame, key: str, query: Iterable[str], k: int, rows: int) -> DataFrame:
    """The ``k`` keys with the highest sum of tf * ln(1 + N / df) over the query terms.

    ``rows`` is N, the size of the table the postings were built from. No text is
    read; document frequencies hold one row per query term.
    """
    hits = postings.filter(F.col("term").isin(list(dict.fromkeys(t.lower() for t in query))))
    spread = hits.groupBy("term").agg(F.count("*").alias("df"))
    weights = spread.select("term", F.log1p(rows / F.col("df")).alias("weight"))
    scored = (hits.join(F.broadcast(weights), "term")   # one row per query term
              .groupBy(key).agg(F.sum(F.col("tf") * F.col("weight")).alias("score")))
    return (scored.select(key, F.round("score", 4).alias("score"))
            .orderBy(F.desc("score"), key).limit(k))
