"""Listing-shaped inputs derived by Spark from the given tables.

The given prose holds no word of the listings domain, so listings come from
``orders`` and ``customer``, jobs from ``events``, sites from ``supplier``, and
payloads are rendered from the listings. ``listingflow.catalog.oracle`` states
the same inputs in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from listingflow.catalog.core import AS_OF, YEAR, table
from listingflow.functions import classify, deadlines, ids, money

ELIGIBILITY = {
    "1": "Applicants must be undergraduate students with financial need. Essay required.",
    "2": "Merit-based award; minimum GPA 3.0. The applicant must be a graduate student.",
    "3": "Women only. FAFSA and academic merit considered; two letters of recommendation.",
    "4": "Hispanic or African-American high school senior. Must be a resident.",
    "5": "Open to all.",
}


def text(c: Column) -> Column:
    return c.cast("string")


def listings_raw(spark: SparkSession, data: str, organization: bool = True) -> DataFrame:
    """One raw listing per order. The customer join is left out if no query column needs it."""
    orders = table(spark, data, "orders")
    if organization:
        customers = table(spark, data, "customer").select(
            F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
        orders = orders.join(customers, "o_custkey")
    seq, day, total = F.col("o_orderkey"), F.col("o_orderdate"), F.col("o_totalprice")
    n = F.floor(total).cast("bigint")
    thousands = F.floor(total / 1000).cast("bigint")
    kind, money_kind = seq % 9, seq % 6
    deadline = (
        F.when(kind == 0, F.date_format(day, "MMMM d, yyyy"))
        .when(kind == 1, F.date_format(day, "MMM d, yyyy"))
        .when(kind == 2, F.concat(text(F.month(day)), F.lit("/"), text(F.day(day))))
        .when(kind == 3, F.date_format(day, "yyyy-MM-dd"))
        .when(kind == 4, "Rolling").when(kind == 5, "").when(kind == 6, "No deadline specified")
        .when(kind == 7, "Various deadlines").otherwise(F.date_format(day, "MMMM d")))
    amount = (
        F.when(money_kind == 0, F.concat(F.lit("$"), text(n)))
        .when(money_kind == 1, F.concat(F.lit("$"), text(thousands), F.lit(",000 - $"),
                                        text(thousands + 1), F.lit(",000")))
        .when(money_kind == 2, "Amount varies").when(money_kind == 3, "")
        .when(money_kind == 4, F.concat(F.lit("up to €"), text(n), F.lit(".50")))
        .otherwise("TBD"))
    level = F.substring("o_orderpriority", 1, 1)
    eligibility = F.coalesce(*[F.when(level == k, v) for k, v in ELIGIBILITY.items()])
    suffix = F.when(seq % 3 == 0, " FUND").otherwise(" Fund")
    columns = [
        seq.alias("src_seq"),
        F.concat(F.lit("Award "), text(F.col("o_custkey") % 97), suffix).alias("name"),
        deadline.alias("deadline"), amount.alias("amount"), eligibility.alias("eligibility"),
        day.alias("created_at"), F.col("o_orderstatus").alias("status"),
        F.col("o_custkey").alias("user_id"),
        F.concat(F.lit("https://listings.example.org/a/"), text(seq)).alias("url"),
    ]
    if organization:
        columns.append(F.when(seq % 11 == 0, "")
                       .otherwise(F.concat(F.lit("Org "), "c_mktsegment")).alias("organization"))
    return orders.select(*columns)


def listings(spark: SparkSession, data: str) -> DataFrame:
    """Raw listings in canonical columns, cleaned and classified."""
    raw = listings_raw(spark, data)
    needs = F.col("eligibility")
    award = money.award(F.col("amount"))
    limits = money.amount_range(F.col("amount"))
    return raw.select(
        ids.listing_id(F.col("name"), F.col("organization"), F.col("deadline"))
        .alias("listing_id"),
        "name", "deadline", "url",
        F.concat(F.lit("Offered by "), "organization").alias("description"),
        "eligibility", "organization",
        classify.academic_levels(needs).alias("academic_level"),
        classify.target_type(needs).alias("target_type"),
        classify.ethnicities(needs).alias("ethnicity"),
        classify.gender(needs).alias("gender"),
        F.coalesce(limits["min"], F.lit(0.0)).alias("min_award"), award.alias("max_award"),
        classify.is_renewable(needs, "table").alias("renewable"),
        F.lit("US").alias("country"), (F.col("status") != "F").alias("is_active"),
        F.concat(F.lit("source-"), "status").alias("source"),
        "created_at", F.col("created_at").alias("updated_at"), "src_seq")


def with_dates(df: DataFrame) -> DataFrame:
    text_ = deadlines.format_deadline(F.col("deadline"), YEAR)
    return df.withColumn("deadline", text_).withColumn(
        "deadline_date", deadlines.parse_deadline(F.col("deadline")))


def details(spark: SparkSession, data: str) -> DataFrame:
    """What the detail page of a listing says, one row per order with lines."""
    lines = table(spark, data, "lineitem").groupBy("l_orderkey").agg(
        F.max("l_extendedprice").alias("price"), F.min("l_extendedprice").alias("low"),
        F.max("l_returnflag").alias("flag"), F.max("l_linestatus").alias("line_status"),
        F.max("l_linenumber").alias("lines"))
    return lines.select(
        F.concat(F.lit("https://listings.example.org/a/"), text(F.col("l_orderkey")))
        .alias("url"),
        F.when(F.col("lines") > 3, F.concat(F.lit("Detail org "), "flag")).otherwise("")
        .alias("organization"),
        F.when(F.col("line_status") == "O", "Nationwide").alias("academic_level"),
        F.when(F.col("flag") == "R", F.lit(0.0)).otherwise(F.floor("low").cast("double"))
        .alias("min_award"),
        F.floor("price").cast("double").alias("max_award"),
        F.when(F.col("lines") > 1, F.col("flag") == "A").alias("renewable"))


def job_events(spark: SparkSession, data: str) -> DataFrame:
    return job_events_from(table(spark, data, "events"))


def job_events_from(events: DataFrame) -> DataFrame:
    kind, found = F.col("event_type"), F.floor("value").cast("bigint")
    status = (F.when(kind == "signup", "pending").when(kind.isin("view", "click"), "running")
              .when(kind == "purchase", "completed").otherwise("failed"))
    message = (F.when(F.col("event_id") % 3 == 0, "Request timeout")
               .when(F.col("event_id") % 3 == 1, "ThrottlingException: Rate exceeded")
               .otherwise("Unexpected end of JSON"))
    failed = status == "failed"
    return events.select(
        "event_id",
        F.concat(F.lit("job-"), text(F.col("user_id")), F.date_format("ts", "-yyyy-MM-dd"))
        .alias("job_id"),
        F.date_format("ts", "yyyy-MM-dd").alias("run_day"),
        F.col("ts").alias("event_ts"), status.alias("status"),
        found.alias("records_found"), found.alias("records_processed"),
        F.when(failed, F.lit(0)).otherwise(F.floor(found / 2)).cast("bigint")
        .alias("records_inserted"),
        F.when(failed, F.lit(0)).otherwise(found - F.floor(found / 2)).cast("bigint")
        .alias("records_updated"),
        F.when(failed, F.array(message)).otherwise(F.array().cast("array<string>"))
        .alias("errors"))


def applications(spark: SparkSession, data: str) -> DataFrame:
    raw = listings_raw(spark, data)
    status = (F.when(F.col("status") == "P", "draft")
              .when(F.col("status") == "O", "submitted")
              .when(F.col("user_id") % 3 == 0, "approved")
              .when(F.col("user_id") % 3 == 1, "rejected").otherwise("withdrawn"))
    return raw.select(
        F.col("src_seq").alias("id"), "user_id",
        ids.listing_id(F.col("name"), F.col("organization"), F.col("deadline"))
        .alias("listing_id"),
        "organization", status.alias("status"), F.col("created_at").alias("submitted_at"))


def sites(spark: SparkSession, data: str) -> DataFrame:
    nation = text(F.col("s_nationkey"))
    terms = F.array_compact(F.array(
        F.concat(F.lit("awards nation "), nation), F.concat(F.lit("grants nation "), nation),
        F.when(F.col("s_acctbal") > 5000, F.concat(F.lit("funds nation "), nation))))
    kinds = F.array(*map(F.lit, ("api", "crawl", "search", "discovery")))
    config = F.to_json(F.struct(
        terms.alias("searchTerms"), (F.col("s_nationkey") + 10).alias("maxResultsPerTerm"),
        F.lit(False).alias("includeNews")))
    return table(spark, data, "supplier").select(
        F.col("s_name").alias("site"),
        F.concat(F.lit("https://site-"), text(F.col("s_suppkey")), F.lit(".example.org"))
        .alias("url"),
        F.element_at(kinds, (F.col("s_nationkey") % 4 + 1).cast("int")).alias("type"),
        F.when(F.col("s_acctbal") < 8000, F.col("s_acctbal") > 0).alias("enabled"),
        config.alias("search_config"))


def fetched_pages(spark: SparkSession, data: str) -> DataFrame:
    day = F.make_interval(days=(F.col("page_id") % 120).cast("int"))
    return table(spark, data, "pages").select(
        "page_id", F.concat(F.lit("scraper-"), text(F.col("page_id") % 3)).alias("scraper"),
        "url", (F.lit("2024-01-01").cast("timestamp_ntz") + day).alias("fetched_at"), "html",
        F.when(F.col("page_id") % 7 == 3, "HTTP 503").alias("error"),
        F.when(F.col("page_id") % 5 == 1, "application/xhtml+xml").alias("content_type"))


# --- rendered payloads ---------------------------------------------------------------------

def escape(c: Column) -> Column:
    out = F.replace(c, F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    return F.replace(out, F.lit('"'), F.lit("&quot;"))


def concat(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def purposes() -> Column:
    """Listing prose with characters that markup must escape."""
    return concat(F.col("eligibility"), ' R&D <fast> "track"')


def spread(df: DataFrame, key: Column | str) -> DataFrame:
    """Rows over the session's shuffle partitions.

    Rendered payloads are many times larger than the rows they come from, so
    neither the scan's splits nor adaptive coalescing sees how much work follows.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def grouped(rows: DataFrame, key: Column, item: str, sep: str) -> DataFrame:
    """Items joined per key in order. Keys are small ranges of a unique number."""
    return (spread(rows.withColumn("page_id", key), "page_id").groupBy("page_id")
            .agg(F.array_sort(F.collect_list(F.struct("src_seq", item))).alias("rows"))
            .select("page_id", F.array_join(F.col(f"rows.{item}"), sep).alias("body")))


def page_number(size: int) -> Column:
    return F.floor(F.col("src_seq") / size).cast("bigint")


def row_pages(spark: SparkSession, data: str) -> DataFrame:
    kind = F.when(F.col("status") == "P", "Loan") \
        .otherwise('Scholarship <b class="table-Numeric">77</b>')
    start = F.when(F.col("src_seq") % 3 == 0, '<tr><th scope="row">1</th><td>').otherwise("<tr><td>")
    level = F.when(F.col("status") == "O", "Undergraduate  Study").otherwise("High School")
    row = concat(
        start, '<a class="detailPageLink" href="/detail/', text(F.col("src_seq")), '">',
        escape(F.substring("name", 1, 2)), '</a><a href="/more">',
        escape(F.substring("name", 3, 10_000)), "</a>\nOrganization: ", escape(F.col("organization")),
        "\nPurposes: ", escape(purposes()), "</td><td> ", level, "</td><td>", kind,
        '</td><td><div class="table-Numeric">', F.col("amount"), "</div></td><td>",
        F.col("deadline"), "</td></tr>")
    rows = grouped(listings_raw(spark, data).withColumn("row", row), page_number(25), "row", "\n")
    head = "<html><body><table><tr><td><a>Award Name</a></td><td>Level</td>" \
        "<td>Scholarship</td><td>Amount</td><td>Deadline</td></tr>"
    return rows.select("page_id", concat(head, F.col("body"), "</table></body></html>")
                       .alias("html"))


def block_pages(spark: SparkSession, data: str) -> DataFrame:
    place = F.when(F.col("status") == "F", "No Geographic Restrictions").otherwise("Ohio")
    row = concat(
        '<div class="row"><div class="scholarship-summary"><div class="lead"><strong>',
        F.col("amount"), "</strong></div><p>Open <strong>now</strong></p><p>Deadline: <strong>",
        F.col("deadline"),
        '</strong></p></div><div class="scholarship-description"><h4><a href="', F.col("url"),
        '">', F.col("name"), '</a></h4><p class="visible-xs">short</p><p>', escape(purposes()),
        '</p><ul class="fa-ul"><li><i class="fa fa-map-marker"></i><span class="trim">', place,
        '</span></li><li><i class="fa fa-graduation-cap"></i><span class="trim"> Junior Study '
        '</span></li><li><i class="fa fa-graduation-cap"></i><span class="trim">Senior</span></li>'
        '<li><i class="fa fa-check"></i><span class="trim">', escape(F.col("eligibility")),
        '</span></li><li><i class="fa fa-check"></i><span class="trim">Org ',
        F.col("organization"), "</span></li></ul></div></div>")
    rows = grouped(listings_raw(spark, data).withColumn("row", row), page_number(25), "row", "")
    promo = '<div class="row"><div class="scholarship-summary"></div>' \
        '<div class="scholarship-description"><h4><a>Find Scholarships now</a></h4></div></div>'
    return rows.select("page_id", concat("<html><body>", promo, '<div class="row">no listing</div>',
                                         F.col("body"), "</body></html>").alias("html"))


def label_pages(spark: SparkSession, data: str) -> DataFrame:
    def line(label, value):
        return concat(f"<tr><td> {label} </td><td>", value, "</td></tr>")

    seq = text(F.col("src_seq"))
    apply_text = F.when(F.col("status") == "O", concat("Write to https://apply.example.org/",
                                                       seq, " soon")).otherwise("By letter")
    duration = F.when(F.col("status") == "F", "Annual award").otherwise("One time")
    html = concat(
        '<html><body><div id="scholarshipDetailContent"><table>',
        line("Organization", F.lit("first, replaced below")),
        line("Organization", F.col("organization")),
        line("Level of Study", F.lit("Graduate  Study")),
        line("Qualifications", escape(F.col("eligibility"))), line("Funds", F.col("amount")),
        line("Duration", duration), line("Deadline", F.col("deadline")),
        line("State", concat("State ", F.col("status"))), line("To Apply", apply_text),
        line("For More Information", concat('<a href="https://more.example.org/', seq, '">x</a>')),
        "</table></div><table><tr><td>Funds</td><td>1</td></tr></table></body></html>")
    return spread(listings_raw(spark, data), "src_seq").select(
        F.col("src_seq").alias("page_id"), html.alias("html"))


def term_pages(spark: SparkSession, data: str) -> DataFrame:
    def term(label, value):
        return concat(f"<dt>{label}</dt><dd>", value, "</dd>")

    renewable = F.when(F.col("status") == "F", "Yes, renewable").otherwise("No")
    html = concat(
        '<html><body><div id="scholarship-view"><div class="callout-details"><dl>',
        term("Deadline:", F.col("deadline")), term("Renewable", renewable),
        term("Min. Award:", F.lit("$1,000")), term("Max. Award:", F.col("amount")),
        '</dl></div><div class="callout-misc"><dl>',
        term("Enrollment Level:", F.lit("College Study")), term("Country:", F.lit('"US"')),
        term("Major:", escape(F.col("eligibility"))),
        '</dl></div></div><div id="description"><p>', escape(purposes()),
        '</p><a href="/other">o</a><a href="https://listings.example.org/apply/',
        text(F.col("src_seq")), '">go</a></div><div class="sponsor"><p>', F.col("organization"),
        "\nSecond line</p></div></body></html>")
    return spread(listings_raw(spark, data), "src_seq").select(
        F.col("src_seq").alias("page_id"), html.alias("html"))


def broad_pages(spark: SparkSession, data: str) -> DataFrame:
    org = F.when(F.col("organization") == "", "").otherwise(
        concat('<span class="sponsor">', F.col("organization"), "</span>"))
    row = concat(
        '<li class="big Result-card"><h3> </h3><strong>', F.col("name"), "</strong>", org,
        '<span class="funds">', F.col("amount"), '</span><em class="due-date">',
        F.col("deadline"), "</em><p>", escape(purposes()), '</p><a href="../d/',
        text(F.col("src_seq")), '?x=1">more</a></li>')
    rows = grouped(listings_raw(spark, data).withColumn("row", row), page_number(25), "row", "")
    return rows.select("page_id", concat(
        "<html><body><ul>", F.col("body"), "</ul><li class='plain'><b>no</b></li></body></html>")
        .alias("html"))


SPEC_TITLES = {"a": "h1.t", "b": ".head h2, .head h3"}


def spec_sites(spark: SparkSession, data: str) -> DataFrame:
    """One configured site per market segment, in two markup styles."""
    other = F.col("site").isin("AUTOMOBILE", "BUILDING")
    style_a = '{"title": "h1.t", "amount": ".amt", "deadline": "p:last-child strong", ' \
        '"scholarshipLinks": "a[href*=\\"/award/\\"]"}'
    style_b = '{"title": ".head h2, .head h3", "amount": "#sum", "deadline": ".due", ' \
        '"organization": ".org", "description": ".about p"}'
    return (table(spark, data, "customer").select(F.col("c_mktsegment").alias("site")).distinct()
            .withColumn("selectors", F.when(other, style_a).otherwise(style_b)))


def spec_pages(spark: SparkSession, data: str) -> DataFrame:
    style_a = concat(
        '<body><h1 class="x t">', F.col("name"), '</h1><b class="amt">', F.col("amount"),
        '</b><a href="/home">h</a><a href="/award/', text(F.col("src_seq")), '">w</a><div><p>a</p>'
        "<p>by <strong>", F.col("deadline"), "</strong></p></div></body>")
    style_b = concat(
        '<body><div class="head"><h3>', F.col("name"), '</h3></div><i id="sum">', F.col("amount"),
        '</i><u class="due">', F.col("deadline"), '</u><div class="org">', F.col("organization"),
        '</div><div class="about"><p>', escape(purposes()), "</p></div></body>")
    orders = listings_raw(spark, data)
    segments = table(spark, data, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("site"))
    html = F.when(F.col("site").isin("AUTOMOBILE", "BUILDING"), style_a).otherwise(style_b)
    return spread(orders.join(segments, "user_id"), "src_seq").select(
        F.col("src_seq").alias("page_id"), "site", html.alias("html"))


def broken_payloads(spark: SparkSession, data: str, content: str, name: str) -> DataFrame:
    """Payloads that do not parse, one per region, with negative numbers."""
    return table(spark, data, "region").select(
        (-1 - F.col("r_regionkey")).cast("bigint").alias("page_id"),
        concat(content, F.col("r_name")).alias(name))


def feed_payloads(spark: SparkSession, data: str, size: int = 25) -> DataFrame:
    about = F.when(F.col("status") == "O", concat("The ", F.col("organization"),
                                                  " Foundation offers R&D <aid>")) \
        .otherwise(F.col("eligibility"))
    told = F.when(F.col("src_seq") % 7 == 0, concat("<![CDATA[", about, "]]>")).otherwise(escape(about))
    item = concat("<item><title>", escape(F.col("name")), "</title><description>", told,
                  "</description><note><![CDATA[no </item> here]]></note><link>", F.col("url"), "</link></item>")
    item = F.when(F.col("src_seq") % 5 == 0, concat("<group><part>", item, "</part></group>")) \
        .otherwise(item)
    rows = grouped(listings_raw(spark, data).withColumn("row", item), page_number(size), "row", "")
    xml = concat('<?xml version="1.0"?><rss version="2.0"><channel><title>Feed</title>',
                 F.col("body"), "</channel></rss>")
    return rows.select("page_id", xml.alias("xml")).union(
        broken_payloads(spark, data, "<rss><channel><item><title>", "xml"))


def api_payloads(spark: SparkSession, data: str) -> DataFrame:
    """Lists, two wrapped forms and single objects, with the aliases mixed."""
    shape = F.col("src_seq") % 4
    limits = money.amount_range(F.col("amount"))
    by_range = F.to_json(F.struct(
        F.col("name").alias("title"), F.col("eligibility").alias("summary"),
        F.col("url").alias("link"), F.col("organization").alias("provider"),
        limits.alias("award_amount")))
    by_number = F.to_json(F.struct(
        F.lit("").alias("title"), F.col("name").alias("name"),
        F.col("eligibility").alias("description"), F.col("url"),
        F.col("organization").alias("organization"),
        money.award(F.col("amount")).alias("amount")))
    rows = listings_raw(spark, data).withColumns({
        "shape": shape, "row": F.when(shape < 2, by_range).otherwise(by_number)})
    number = F.when(F.col("shape") == 3, F.col("src_seq") * 4 + 3).otherwise(
        F.floor(F.col("src_seq") / 32).cast("bigint") * 4 + F.col("shape"))
    bodies = grouped(rows, number, "row", ",")
    kind = F.col("page_id") % 4
    payload = (F.when(kind == 0, concat("[", F.col("body"), "]"))
               .when(kind == 1, concat('{"scholarships": [', F.col("body"), "]}"))
               .when(kind == 2, concat('{"results": [', F.col("body"), "]}"))
               .otherwise(F.col("body")))
    return bodies.select("page_id", payload.alias("json")).union(
        broken_payloads(spark, data, '{"results": [', "json"))


def reply_payloads(spark: SparkSession, data: str) -> DataFrame:
    """Model replies: fenced blocks, bare arrays, and text without usable JSON."""
    item = F.to_json(F.struct(
        F.col("name").alias("scholarship_name"), F.col("organization").alias("sponsor"),
        purposes().alias("description"), F.col("amount").alias("minAmount"),
        money.award(F.col("amount")).alias("max_amount"),
        F.col("eligibility").alias("requirements"), F.lit("graduate").alias("academicLevel"),
        F.lit("Ohio").alias("location"), F.col("deadline"),
        (F.col("status") == "F").alias("renewable"), F.lit("").alias("country"),
        F.col("url").alias("applyUrl"), F.lit("https://w.example.org").alias("website")))
    rows = grouped(listings_raw(spark, data).withColumn("row", item), page_number(25), "row", ",\n")
    fenced = concat("Here you are:\n```json\n[", F.col("body"), "]\n```\nGood luck [really]!")
    bare = concat("Results: [", F.col("body"), "] as asked.")
    reply = F.when(F.col("page_id") % 2 == 0, fenced).otherwise(bare)
    return rows.select("page_id", reply.alias("reply")).union(
        broken_payloads(spark, data, "Sorry, nothing in [", "reply"))


def crawl_replies(spark: SparkSession, data: str) -> DataFrame:
    item = F.to_json(F.struct(
        F.col("name").alias("title"), F.col("organization"), F.col("deadline"),
        purposes().alias("description"), F.col("eligibility"),
        F.lit("PhD Study").alias("academicLevel"), F.lit("Merit").alias("targetType"),
        F.lit("").alias("gender"), F.lit("$2,500").alias("maxAward"),
        (F.col("status") == "F").alias("renewable")))
    reply = F.when(F.col("status") == "P", "null").otherwise(concat("Found: ", item, "."))
    return spread(listings_raw(spark, data), "src_seq").select(
        "src_seq", "url", reply.alias("reply"))


