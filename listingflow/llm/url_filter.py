"""URL filtering by rules and by a ratio of two character language models.

URLs that a rule or a label in the host rejects train one model, and those that a rule or a label accepts train the other.
What nothing judges counts as accepted too unless told otherwise, as learning from positive and unlabelled examples does. Both are
Markov models of variable order: the longest context seen, up to three characters, interpolated with shorter ones
(Witten-Bell). A URL's score is the difference of its log-likelihoods by character; the threshold is calibrated on labelled
URLs that trained neither, which also tell how often it is wrong.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules (host and path, verdict).
RULES: tuple[tuple[str, str], ...] = (
    ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"),
    ("com/fr/", "allow"), ("com/de/", "block"),
)
#: A host with one of these as a whole label, between dots or hyphens, is an example of what is rejected.
REJECTED_LABELS = ("adult", "ads", "bets", "casino", "pills", "poker", "porn", "spam", "viagra", "xxx")

#: Letters and signs that are told apart; digits are one symbol, others one more, and the border of a URL one.
_SIGNS = "-./_?=&%#:~"
_DIGIT = 26
_OTHER = _DIGIT + 1 + len(_SIGNS)
BORDER = _OTHER + 1
SYMBOLS = BORDER + 1
ORDER = 3
#: Scores are counted in bins of this width for calibration.
_BIN = 1 / 64


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(_after(url), r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule whose host is the URL's or above it and whose path begins the URL's; else null."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        found = F.when(fits, rule).otherwise(found)
    return found


def symbols(url: str) -> np.ndarray:
    """A URL as symbols, between borders."""
    points = np.frombuffer(url.lower().encode("utf-32-le", "replace"), dtype="<u4")
    return np.concatenate([np.full(ORDER, BORDER), _symbol_table()[np.minimum(points, 128)], [BORDER]])


_TABLE: list[np.ndarray] = []


def _symbol_table() -> np.ndarray:
    if not _TABLE:
        table = np.full(129, _OTHER)
        table[ord("a"):ord("z") + 1] = np.arange(26)
        table[ord("0"):ord("9") + 1] = _DIGIT
        for i, sign in enumerate(_SIGNS):
            table[ord(sign)] = _DIGIT + 1 + i
        _TABLE.append(table)
    return _TABLE[0]


def grams(url: str) -> np.ndarray:
    """The code of each symbol after the first borders with its context."""
    s = symbols(url).astype(np.int64)
    code = s[:len(s) - ORDER]
    for k in range(1, ORDER + 1):
        code = code * SYMBOLS + s[k:len(s) - ORDER + k]
    return code


def likelihoods(counts: np.ndarray) -> np.ndarray:
    """Log-probabilities of every symbol after every context, from counts by gram code."""
    below = np.full((1, SYMBOLS), 1 / SYMBOLS)
    for order in range(ORDER + 1):
        # Counts of a shorter context are those of all longer ones that end with it.
        c = counts.reshape(-1, SYMBOLS ** order, SYMBOLS).sum(axis=0)
        kinds = (c > 0).sum(axis=1, keepdims=True)
        total = c.sum(axis=1, keepdims=True)
        prior = np.tile(below, (len(c) // len(below), 1))
        below = (c + np.maximum(kinds, 1) * prior) / (total + np.maximum(kinds, 1))
    return np.log(below).ravel()


@dataclass(frozen=True)
class Model:
    """The difference of log-likelihoods by gram code, and the score from which a URL is allowed.

    ``false_block`` and ``false_allow`` are the shares of accepted and of rejected URLs, of those that trained no model, that
    the threshold judges wrong; None if there are none.
    """

    ratio: np.ndarray
    threshold: float
    false_block: float | None = None
    false_allow: float | None = None

    def score(self, url: str | None) -> float:
        """The mean difference by character; URLs that are null or empty have no score but the least."""
        return float(self.ratio[grams(url)].mean()) if url else -float("inf")


def _labelled(pages: DataFrame, rejected: Sequence[str], accepted: Sequence[str], unjudged_accepted: bool) -> DataFrame:
    """url and ``label`` (1 accepted, 0 rejected) of the examples. A rule decides before labels, rejection before acceptance."""
    host = host_of(F.col("url"))
    rule = rule_of(host, path_of(F.col("url")))
    parts = F.split(host, "[.-]")
    by_rule = F.when(rule.isin([r for r, v in RULES if v == "block"]), 0).when(rule.isNotNull(), 1)

    def named(labels: Sequence[str]) -> Column:
        return F.arrays_overlap(parts, F.array(*map(F.lit, labels))) if labels else F.lit(False)

    by_label = F.when(named(rejected), 0).when(named(accepted), 1)
    label = F.coalesce(by_rule, by_label, F.lit(1 if unjudged_accepted else None).cast("int"))
    return pages.where("url <> ''").select("url", label.alias("label")).where("label is not null")


def fit(pages: DataFrame, rejected: Sequence[str] = REJECTED_LABELS, accepted: Sequence[str] = (),
        unjudged_accepted: bool = True) -> Model:
    """A model of all examples; a fifth of them, by a hash of the URL, calibrates the threshold.

    Examples are URLs that a rule judges, those whose host has one of the labels ``rejected`` or ``accepted``, and the others as
    accepted ones unless not ``unjudged_accepted``.

    What the driver gathers is bounded by the alphabet: a count per gram of four symbols out of
    ``SYMBOLS``, and a count per bin of scores. The threshold maximises the mean of both classes'
    shares judged right; it is 0 if a class has no example.
    """
    held = F.crc32(F.col("url").cast("binary")) % 5 == 0
    labelled = _labelled(pages, rejected, accepted, unjudged_accepted).withColumn("held", held)

    def count(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("label").to_numpy()
            urls = batch.column("url").to_pylist()
            for label in (0, 1):
                codes = [grams(u) for u, x in zip(urls, labels, strict=True) if x == label]
                if codes:
                    code, n = np.unique(np.concatenate(codes), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), label, np.int32)), pa.array(code), pa.array(n)],
                                                     names=["label", "code", "n"])

    counted = labelled.where(~F.col("held")).select("url", "label").mapInArrow(count, "label int, code long, n long") \
        .groupBy("label", "code").agg(F.sum("n").alias("n"))
    counts = np.zeros((2, SYMBOLS ** (ORDER + 1)))
    table = counted.toArrow()
    counts[table["label"].to_numpy(), table["code"].to_numpy()] = table["n"].to_numpy()
    ratio = (likelihoods(counts[1]) - likelihoods(counts[0])).astype(np.float32)
    scored = score(labelled.where("held").select("url", "label"), Model(ratio, 0.0), ("label",))
    bins = scored.groupBy("label", F.floor(F.col("score") / _BIN).alias("bin")).count().collect()
    counted = [(r["bin"], r["label"], r["count"]) for r in bins]
    threshold = _threshold(counted)

    def wrong(label: int) -> float | None:
        total = sum(n for _, k, n in counted if k == label)
        return sum(n for b, k, n in counted if k == label and (b * _BIN >= threshold) != (label == 1)) / total if total else None

    return Model(ratio, threshold, wrong(1), wrong(0))


def _threshold(bins: list[tuple[int, int, int]]) -> float:
    """The edge of a bin from which allowing is right most often, counting both classes alike; the middle of several."""
    total = {k: sum(n for _, label, n in bins if label == k) for k in (0, 1)}
    if not total[0] or not total[1]:
        return 0.0

    def right(edge: int) -> float:
        return sum(n / total[label] for b, label, n in bins if (b >= edge) == (label == 1))

    edges = sorted({b for b, _, _ in bins} | {b + 1 for b, _, _ in bins})
    most = max(map(right, edges)) - 1e-9
    best = [b for b in edges if right(b) >= most]
    return (best[0] + best[-1]) / 2 * _BIN


def score(pages: DataFrame, model: Model, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The columns ``keep``, ``url`` and ``score``."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    schema = pages.select(*keep, "url").schema.add("score", "double")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([shared.value.score(u) for u in batch.column("url").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), batch.column("url"), found],
                                             names=[*keep, "url", "score"])

    return pages.select(*keep, "url").mapInArrow(run, schema)


def judge(pages: DataFrame, **examples) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row's URL, and the model's false_block and false_allow.

    The longest rule that fits decides, else the model fitted on the same table: ``allow`` from its
    threshold on. A null or empty URL has empty host and path, no rule, score minus infinity and is
    blocked. Repeated rows are judged alike, rows without an id too; other columns are ignored.
    """
    pages = pages.select("page_id", "url")
    model = fit(pages, **examples)
    parts = score(pages, model).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}) \
        .withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))}) \
        .withColumn("rule", rule_of(F.col("host"), F.col("path")))
    by_rule = F.lit(None).cast("string")
    for rule, verdict in RULES:
        by_rule = F.when(F.col("rule") == rule, verdict).otherwise(by_rule)
    by_model = F.when(F.col("score") >= model.threshold, "allow").otherwise("block")
    errors = [F.lit(e).cast("double").alias(name) for name, e in
              (("false_block", model.false_block), ("false_allow", model.false_allow))]
    return parts.select("page_id", "host", "path", "rule", F.coalesce(by_rule, by_model).alias("verdict"), "score", *errors)
