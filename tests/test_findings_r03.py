"""Pages are read with as few passes as they need."""

import re

from pyspark.sql import functions as F

from listingflow.functions import replies, text as tx
from listingflow.sources import feeds, markup, pages


def test_a_selector_is_searched_once_for_a_page(monkeypatch):
    searched = []
    search = markup.Page._search
    monkeypatch.setattr(markup.Page, "_search", lambda self, *a: searched.append(a) or search(self, *a))
    page = markup.Page("<div class=x>" + "<ul><li><b>a</b></li><li>b <b>c</b></li></ul>" * 20 + "</div>")
    rows = page.select(".x ul")
    assert [[page.text(n) for n in page.select("ul b", row)] for row in rows] == [["a", "c"]] * 20
    assert len(searched) == 2


def test_scripts_hold_no_tags():
    page = markup.Page("<p>a<SCRIPT>if (1 <p> 2)</p></script>b<p/>c<style><i></style><i>d</i>")
    assert [page.text(p) for p in page.select("p")] == ["ab", ""] and [page.text(i) for i in page.select("i")] == ["d"]


def test_the_last_row_of_a_label_is_read(spark):
    rows = [(1, "<table><tr><td> Funds&nbsp;</td><td>1</td></tr><tr><td>fUNDS</td><td> 2 </td></tr><tr><td>Aid</td></tr></table>"),
            (2, "<table><tr><td>Other</td><td>3</td></tr><tr></tr></table>"), (3, None)]
    wanted = {"one": (("funds",), pages.field("td", pick="last")), "any": (("funds", "aid", "other"), pages.field("td", pick="last"))}
    got = pages.select_labelled(spark.createDataFrame(rows, "page_id long, html string"), "table tr", pages.field("td"), wanted,
                                page_fields={"title": pages.field("h1")})
    assert sorted(tuple(r) for r in got.collect()) == [(1, " 2 ", "Aid", None), (2, None, "3", None), (3, None, None, None)]
    assert [t for _, t in got.dtypes] == ["bigint", "string", "string", "string"]


def test_fields_of_a_reply_item_are_read_in_one_pass(spark):
    item = '{"title": "0", "name": "n", "renewable": %s, "sponsor": {"b": [1]}, "deadline": 0, "application_deadline": "\\u00e9 \'x\'", ' \
        '"requirements": "Must be a senior. should be  tall", "min_amount": false, "amount": 12.50}'
    rows = [(1, f"x ```json\n[{item % 'false'}, 7, null, [1]]\n``` ]"), (2, f"so [{item % '"false"'}] ok"), (3, "[1] or [2]"),
            (4, '[1], "<end of text>"]'), (5, None), (6, '{"title": "a"}')]
    got = feeds.read_replies(spark.createDataFrame(rows, "page_id long, reply string"), "page_id")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"try_variant_get\(item#\d+, \$, Struct", plan)) == 1
    assert not re.search(r"try_variant_get\(item#\d+, \$\.\w+, StringType", plan)
    known = ["page_id", "pos", "name", "organization", "deadline", "eligibility", "min_award", "max_award", "renewable"]
    none = ("Scholarship", "", "Various deadlines", "Eligibility requirements vary", 0.0, 0.0, False)
    told = ("0", '{b:[1]}', "é x", "a senior. tall | senior", 12.5, 12.5)
    assert sorted(tuple(r) for r in got.select(known).collect()) == [
        (1, 0, *told, False), *((1, i, *none) for i in (1, 2, 3)), (2, 0, *told, False)]
    v = F.try_parse_json("reply")
    fields = spark.createDataFrame([(x,) for x in ('{"a": false, "b": "false"}', '{"a": "0", "b": 1}', '{"a": "", "b": 0}', "[1]", "3")], "reply string")
    texts = fields.withColumn("texts", replies.field_texts(v, ["a", "b"]))
    both = texts.select(replies.first_value(v, ["a", "b"], "z"), replies.first_value(v, ["a", "b"], "z", F.col("texts"))).collect()
    assert [tuple(r) for r in both] == [("false", "false"), ("0", "0"), ("z", "z"), ("z", "z"), ("z", "z")]


def test_a_reply_is_parsed_to_its_end(spark):
    texts = ["[1]", " [1] ", "[1] 2", "1, 2", "1]", '1, "<end of text>"', '1, "<end of text>"]', '1, "\\u003cend of text>"] x', "", " ", "null", '{"v": 1}, "v": 2',
             '"\\u0041"', '["<end of text>"]', "[1,", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(F.to_json(replies.parse_json(F.col("t")))).collect()]
    assert got == ["[1]", "[1]", None, None, None, None, None, None, None, None, "null", None, '"A"', '["<end of text>"]', None, None]


def test_phrases_are_stripped_in_steps_as_at_once(spark):
    texts = ["The applicant must be x", "applicant applicant must bemust be", "shouldmust be be", "MUST BE Should  be has to be", "a\u00a0 b\t c ",
             "sh\u017fould be \u0130 must be", "", "no", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("u", F.col("t"))
    for phrases in (tx.V.REDUNDANT_PHRASES, ["\u00c4b must be", "must be", "x"], ["ab", "b", "B", "a"]):
        steps = df
        for step in tx.strip_steps(phrases):
            steps = steps.withColumn("u", step(F.col("u")))
        assert [tuple(r) for r in steps.filter(~F.col("u").eqNullSafe(tx.strip_phrases(F.col("t"), phrases))).collect()] == []
