"""Column functions, case by case."""

import datetime

import pytest
from pyspark.sql import functions as F

from listingflow.functions import classify, deadlines, ids, links, money, replies
from listingflow.functions import text as tx


def apply(spark, fn, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    out = rows.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()
    return [r["o"] for r in out]


def check(spark, fn, cases, kind="string"):
    assert apply(spark, fn, [c[0] for c in cases], kind) == [c[1] for c in cases]


def test_clean_text(spark):
    check(spark, lambda c: tx.clean_text(c, quotes=True), [
        (None, ""), (" 'a' \"b\" ", "a b"), ("x,y $5", "x,y $5")])
    check(spark, lambda c: tx.clean_text(c, commas=True, currency=True), [
        ("1,000 €", "1000"), ("'q'", "'q'")])


def test_squeeze_and_unwrap(spark):
    check(spark, lambda c: tx.squeeze(c, 8), [
        (None, ""), ("a \n\t b", "a b"), ("abcdefghij", "abcde..."), ("abcd efgh", "abcd ...")])
    check(spark, tx.unwrap_quotes, [
        ('"a b"', "a b"), ("\"'a'\"", "a"), ('"', ""), ("'a", "'a"), (None, "")])


def test_strip_phrases_in_order(spark):
    check(spark, tx.strip_phrases, [
        ("The applicant must be tall", "The tall"), ("APPLICANTS MUST BE x", "x"),
        ("It has to be so", "It so"), (None, None), ("", "")])


def test_truncate(spark):
    check(spark, lambda c: tx.truncate(c, 8), [
        ("12345678", "12345678"), ("123456789", "12345..."), ("1234 6789", "1234..."),
        (None, None)])


def test_levels_and_defaults(spark):
    check(spark, tx.clean_level, [("Graduate  Study", "graduate"), ("STUDY", None), (None, None)])
    check(spark, tx.non_empty, [(" a ", "a"), ("  ", "unspecified"), (None, "unspecified")])


def test_clean_amount(spark):
    check(spark, money.clean_amount, [
        ("$1,000", "1000"), ("Amount varies", ""), ("€5 to be determined", "5"),
        ("amounts", "amounts"), ("'7'  TBD x", "7 x"), (None, "")])


def test_leading_number(spark):
    check(spark, money.leading_number, [
        ("1000 - 5000", 1000.0), ("x", 0.0), ("", 0.0), (None, 0.0), (".5a", 0.5), ("-3", -3.0),
        ("1e3", 1000.0), ("12.", 12.0)])


def test_amount_range(spark):
    out = apply(spark, money.amount_range, ["$1,000 - $2,500", "500", "none", None, "1,000.50"])
    assert [(r["min"], r["max"]) for r in out] == [
        (1000.0, 2500.0), (500.0, 500.0), (None, None), (None, None), (1000.0, 50.0)]


def test_amount_max(spark):
    check(spark, money.amount_max, [
        ("from $1,000 to 2,500.75", 2500.75), (", and , no", None), ("x", None), (None, None)])


def test_format_deadline(spark):
    check(spark, lambda c: deadlines.format_deadline(c, 2025), [
        ("March 5", "March 5, 2025"), ("by Sept  9 or mar 3", "mar 3, 2025"),
        ("December", "December, 2025"), (" jan ", "jan, 2025"), ("3/5", "March 5, 2025"),
        ("13/5", "13/5"), ("2/40", "2/40"), ("May 1, 2024", "May 1, 2024"),
        ("Rolling May 1", "Rolling May 1"), ("No deadline", "No deadline"), ("", ""),
        (None, None), ("soon", "soon"), ("MAY 7th", "MAY 7, 2025"), ("3/5\n", "3/5\n")])


def test_parse_deadline(spark):
    d = datetime.date
    check(spark, deadlines.parse_deadline, [
        ("1998-03-05", d(1998, 3, 5)), ("March 5, 1998", d(1998, 3, 5)),
        ("mar 5, 1998", d(1998, 3, 5)), ("Sept 9, 1998", d(1998, 9, 9)),
        ("3/5/1998", d(1998, 3, 5)), ("May, 1998", d(1998, 5, 1)),
        ("1998-03-05T10:00:00Z", d(1998, 3, 5)), ("February 30, 1998", None),
        ("Rolling", None), ("", None), (None, None), ("Marsh 5, 1998", None),
        ("5 March 1990", d(1990, 3, 5)), ("1990/03/05", d(1990, 3, 5)),
        ("Friday, March 5, 1990", d(1990, 3, 5)), ("3/5/90", d(1990, 3, 5)), ("3/5/25", d(2025, 3, 5)),
        ("March 5, 1990 11:59 PM", d(1990, 3, 5)), ("March 5, 1990 at 11:59 pm EST", d(1990, 3, 5)),
        ("1990", d(1990, 1, 1)), ("Monthly 1990", None), ("31 February 1990", None), ("at 11:59", None)])


def test_expiry_modes(spark):
    texts = ["1998-06-15", "1998-06-14", "June 16, 1998", "rolling 1997", "Various", "", None,
             "No deadline"]
    at = "1998-06-15 12:00:00"
    assert apply(spark, lambda c: deadlines.is_expired(c, at), texts) == [
        False, True, False, False, False, False, False, False]
    assert apply(spark, lambda c: deadlines.is_expired(c, at, "instant"), texts) == [
        True, True, False, False, False, False, False, False]
    assert apply(spark, lambda c: deadlines.is_expired(c, at, "sql_view"), texts) == [
        True, True, False, False, True, False, False, True]
    with pytest.raises(ValueError):
        deadlines.is_expired(F.lit(""), at, "no such mode")


def test_target_type(spark):
    check(spark, classify.target_label, [
        ("FAFSA and GPA", "Both"), ("merit based", "Merit"), ("low income", "Need"),
        ("anything", "Not specified"), (None, "Not specified")])
    check(spark, classify.target_type, [("GPA", "merit"), ("FAFSA", "need"), ("x", "both")])


def test_levels(spark):
    check(spark, classify.academic_levels, [
        ("Undergraduate", "undergraduate, graduate"), ("College freshman", "masters, freshman, college"),
        ("graduate college", "graduate"), (None, "")])
    check(spark, lambda c: classify.academic_levels(c, match="word"), [
        ("Undergraduate man", "undergraduate"), ("MS or Ph.D", "masters, doctorate")])


def test_gender(spark):
    check(spark, classify.gender, [
        ("Women only", "female"), ("men only", "male"), ("requirement", None), (None, None)])


def test_parse_eligibility(spark):
    row = apply(spark, classify.parse_eligibility,
                ["Need-based, Latino graduate women; essay and references"])[0]
    assert tuple(row) == ("need", "latino", "female", "graduate", True, True)
    assert tuple(apply(spark, classify.parse_eligibility, [None])[0]) == (
        "both", "", "", "", False, False)


def test_listing_page(spark):
    check(spark, lambda c: classify.is_listing_page(F.lit("https://x.org/a"), c), [
        ("An award: apply before the deadline", True), ("An award", False),
        ("apply, deadline", False), (None, False)])


def _script_hash(url):
    h = 0
    units = url.encode("utf-16-be")
    for i in range(0, len(units), 2):
        h = (h * 31 + (units[i] << 8 | units[i + 1])) & 0xFFFFFFFF
    return format(abs(h - (1 << 32) if h >= 1 << 31 else h), "x")[:8]


def test_url_hash(spark):
    urls = ["", "a", "https://example.org/x?y=1", "https://example.org/ü/\U0001f600/z" * 3]
    assert apply(spark, ids.url_hash, urls) == [_script_hash(u) for u in urls]


def test_reply_json(spark):
    def as_text(c):
        return replies.reply_json(c).cast("string")
    check(spark, as_text, [
        ('x ```json\n{"a":1}\n``` [2]', '{"a":1}'), ("so [1, 2] and", "[1,2]"),
        ('see {"a": {"b": 2}} ok', '{"a":{"b":2}}'), ("[1] text [2]", None), ("none", None),
        (None, None)])


def test_first_value_skips_unset(spark):
    def pick(c):
        return replies.first_value(F.try_parse_json(c), ["a", "b"], "z")
    check(spark, pick, [
        ('{"a": "", "b": 5}', "5"), ('{"a": 0, "b": "x"}', "x"), ('{"a": "0", "b": "x"}', "0"),
        ('{"a": false}', "z"), ('{"a": null, "b": true}', "true"), ("bad", "z")])


def test_organization_from_text(spark):
    check(spark, replies.organization_from_text, [
        ("The big o'neil foundation gives", "O'Neil"), ("University of x", "Unknown Organization"),
        ("a\tb College", "B"), (None, "Unknown Organization"), ("", "Unknown Organization")])


def test_absolutise(spark):
    base = "https://h.org/a/b?q=1#f"
    check(spark, lambda c: links.absolutise(c, F.lit(base)), [
        ("http://x/y", "http://x/y"), ("/p", "https://h.org/p"), ("c.html", "https://h.org/a/c.html"),
        ("../c", "https://h.org/c"), ("//k.org/z", "https://k.org/z"), ("?r=2", "https://h.org/a/b?r=2"),
        ("#g", "https://h.org/a/b?q=1#g"), ("mailto:a@b", "mailto:a@b"), ("", base), (None, None)])
