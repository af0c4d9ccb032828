"""A ledger of rule failures as bits, and policies over it.

Every rule is evaluated once per document. The ledger keeps the measurements and
one bit per failed rule; a policy is a version's mask of the bits that reject. Policies
and their ablations are bit operations on the ledger and read no text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingflow.functions.text import let
from listingflow.llm.common import BLANKS, word_array

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5

#: Rules in the order of their bits: a name and when a document fails it. A bit is never reused.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "n_dup_lines > 5 and 10 * n_dup_lines > 3 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "shouting": "2 * n_upper > word_chars",
    "few_letters": "2 * n_letters < word_chars",
}
BITS = {name: 1 << i for i, name in enumerate(RULES)}

#: The rules that reject, by version.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "duplicate_lines"),
    "v2": tuple(RULES),
}
LATEST = "v2"


def mask(policy: str) -> int:
    return sum(BITS[rule] for rule in POLICIES[policy])


def _repeat_words(words: Column) -> Column:
    """Words inside a window of five that the text has twice or more."""
    n = F.size(words)

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(order: Column) -> Column:
            twin = F.filter(order, lambda x, i: (F.get(order, i - 1)["h"] == x["h"])
                            | (F.get(order, i + 1)["h"] == x["h"]))
            return F.sort_array(F.transform(twin, lambda x: x["i"]))

        def width(at: Column) -> Column:
            return F.aggregate(F.transform(at, lambda p, i: F.least(
                F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW)))),
                F.lit(0), lambda total, x: total + x)

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)) \
            .otherwise(let(let(placed, repeated), width))

    hashes = F.transform(F.sequence(F.lit(0), n - WINDOW),
                         lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    return F.when(n < WINDOW, F.lit(0)).otherwise(let(hashes, covered)).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of every whole text; all are 0 for null and for the empty text."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")

    def of_lines(found: Column) -> Column:
        return F.struct(F.size(found).cast("long").alias("n_lines"),
                        (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"))

    def of_words(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), F.array_join(words, "").alias("joined"),
                        _repeat_words(words).alias("n_repeat_words"))

    def of_joined(w: Column) -> Column:
        count = lambda pattern: F.regexp_count(w["joined"], F.lit(pattern)).cast("long")
        return F.struct(w["n_words"].alias("n_words"), F.char_length(w["joined"]).cast("long").alias("word_chars"),
                        count(SYMBOLS).alias("n_symbols"), w["n_repeat_words"].alias("n_repeat_words"),
                        F.length(F.regexp_replace(w["joined"], r"\P{Lu}+", "")).cast("long").alias("n_upper"),
                        F.length(F.regexp_replace(w["joined"], r"\P{L}+", "")).cast("long").alias("n_letters"))

    words = let(let(word_array(F.col("text")), of_words), of_joined)
    measured = docs.select("doc_id", words.alias("w"), let(lines, of_lines).alias("l"))
    return measured.select("doc_id", "w.n_words", "w.word_chars", "w.n_symbols", "l.n_dup_lines",
                           "w.n_repeat_words", "l.n_lines", "w.n_upper", "w.n_letters")


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements and ``failed``, a bit for each rule of ``RULES`` that the document fails.

    A row per row: repeated rows are judged alike, rows without an id too; null text is
    judged as empty. Other columns are ignored.
    """
    bits = [F.when(F.expr(test), F.lit(BITS[name])).otherwise(0).cast("long") for name, test in RULES.items()]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return measure(docs).withColumn("failed", total)


def apply_policy(entries: DataFrame, policy: str = LATEST) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under a policy; the base rules reject under any."""
    base = F.lit(mask("base")).cast("long")
    fails = lambda m: F.col("failed").bitwiseAND(F.lit(m).cast("long")) != 0
    return entries.withColumn("base_failed", F.col("failed").bitwiseAND(base) != 0) \
        .withColumn("kept", ~fails(mask(policy) | mask("base")))


def ablations(entries: DataFrame, policy: str = LATEST) -> DataFrame:
    """For each rule of a policy: rows it fails, rows only it fails, rows kept without it.

    Rows are counted by their bits first, at most 2 to the number of rules, so nothing larger is shuffled.
    """
    whole = mask(policy)
    patterns = entries.groupBy(F.col("failed").bitwiseAND(F.lit(whole).cast("long")).alias("bits")) \
        .agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BITS[r]).cast("long").alias("bit"))
                                for r in POLICIES[policy]])).alias("r")
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0
    return patterns.select("bits", "n", rules).groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(hit & rest, F.col("n")).otherwise(0)).alias("only_this"),
        F.sum(F.when(rest, F.col("n")).otherwise(0)).alias("kept_without"))


def judged(entries: DataFrame, policy: str = LATEST) -> DataFrame:
    """The ledger under ``policy`` (``base_failed``, ``kept``), a column kept_<version> for each other version, and per row
    ``sole_rule``, the only rule of the policy that the row fails, with ``brought_back``, how many rows that rule alone rejects.

    The ablations have a row per rule, so joining them shuffles nothing. Rows that fail no rule or several have neither.
    """
    found = apply_policy(entries, policy)
    for version in POLICIES:
        if version != policy:
            fails = F.col("failed").bitwiseAND(F.lit(mask(version) | mask("base")).cast("long")) != 0
            found = found.withColumn(f"kept_{version}", ~fails)
    sole = F.lit(None).cast("string")
    for rule in POLICIES[policy]:
        sole = F.when(F.col("failed").bitwiseAND(F.lit(mask(policy)).cast("long")) == BITS[rule], rule).otherwise(sole)
    report = ablations(entries, policy).select(F.col("rule").alias("sole_rule"), F.col("only_this").alias("brought_back"))
    return found.withColumn("sole_rule", sole).join(F.broadcast(report), "sole_rule", "left")
