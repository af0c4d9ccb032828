"""Queries over whole tables: dedupe, caps, merges, rollups, keywords, search."""

from pyspark.sql import functions as F

from listingflow import vocabulary as V
from listingflow.catalog import fixtures as fx, oracle as sql
from listingflow.catalog.core import AS_OF, query, table
from listingflow.functions import links, money
from listingflow.operators import dedupe, filters, merge, rollups, search
from listingflow.operators.search_index import PostingIndex
from listingflow.plans import crawl, curate
from listingflow.session import scratch_dir, stored
from listingflow.sources.tables import append_rows, read_sites

_KEY = "lower(name || '-' || coalesce(nullif(organization, ''), 'unknown'))"


# --- dedupe, caps, numbering -----------------------------------------------------------

@query("dedupe_first", f"""
WITH {sql.RAW}, firsts AS ({sql.first_row('raw', _KEY)})
SELECT src_seq, name, organization, deadline, amount FROM firsts""")
def dedupe_first(spark, data):
    rows = fx.listings_raw(spark, data).select(
        "src_seq", "name", "organization", "deadline", "amount")
    return dedupe.dedupe_first(rows, [dedupe.dedupe_key(F.col("name"), F.col("organization"))],
                               [F.col("src_seq")])


@query("result_cap", f"""
WITH {sql.RAW} SELECT 'all' AS focus, src_seq, name FROM
  (SELECT * FROM raw ORDER BY src_seq LIMIT 50)
UNION ALL SELECT eligibility, src_seq, name FROM raw
  QUALIFY row_number() OVER (PARTITION BY eligibility ORDER BY src_seq) <= 10""")
def result_cap(spark, data):
    """The first 50 overall and the first 10 of each focus."""
    rows = fx.listings_raw(spark, data, organization=False).select("eligibility", "src_seq", "name")
    overall = dedupe.cap(rows, 50, [F.col("src_seq")])
    per_focus = dedupe.cap(rows, 10, [F.col("src_seq")], by=[F.col("eligibility")])
    return (overall.select(F.lit("all").alias("focus"), "src_seq", "name")
            .unionAll(per_focus.select("eligibility", "src_seq", "name")))


_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1))"


@query("host_page_cap", f"""
SELECT {_HOST} AS host, page_id FROM pages
QUALIFY row_number() OVER (PARTITION BY {_HOST} ORDER BY page_id)
  <= {V.CRAWL_SCOPE['max_pages_per_domain']}""")
def host_page_cap(spark, data):
    rows = table(spark, data, "pages").select(links.host(F.col("url")).alias("host"), "page_id")
    return dedupe.cap(rows, V.CRAWL_SCOPE["max_pages_per_domain"], [F.col("page_id")],
                      by=[F.col("host")])


@query("request_batches", """
SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 5 AS batch
FROM documents""")
def request_batches(spark, data):
    """Batches of five requests per source."""
    rows = table(spark, data, "documents").select("source", "doc_id")
    return dedupe.batch_numbers(rows, "doc_id", ["source"], 5)


@query("request_rows", f"""
SELECT page_id, replace({sql.quoted(crawl.PAGE_PROMPT)}, '%s', substr(html, 1, 3000)) AS prompt
FROM pages""")
def request_rows(spark, data):
    return crawl.request_rows(table(spark, data, "pages"), "html", "page_id")


# --- lookups and merges ----------------------------------------------------------------

_SPLIT = f"""{sql.LISTINGS},
target AS ({sql.first_row("(SELECT * FROM listings WHERE created_at < TIMESTAMP '1999-01-01')",
                          'listing_id')}),
changed AS (SELECT * REPLACE (CASE WHEN academic_level = 'masters' THEN max_award + 1
  ELSE max_award END AS max_award) FROM listings WHERE created_at >= TIMESTAMP '1997-01-01'),
updates AS ({sql.first_row('changed', 'listing_id')})"""


def _split(spark, data):
    """The table up to 1999 and a later, overlapping batch with some awards changed."""
    rows = fx.listings(spark, data)
    cut = F.lit("1999-01-01").cast("timestamp_ntz")
    start = F.lit("1997-01-01").cast("timestamp_ntz")
    award = F.col("max_award")
    changed = rows.filter(F.col("created_at") >= start).withColumn(
        "max_award", F.when(F.col("academic_level") == "masters", award + 1).otherwise(award))
    key, order = [F.col("listing_id")], [F.col("src_seq")]
    return (dedupe.dedupe_first(rows.filter(F.col("created_at") < cut), key, order),
            dedupe.dedupe_first(changed, key, order))


@query("new_listings", f"""
WITH {_SPLIT} SELECT listing_id FROM updates WHERE listing_id NOT IN
  (SELECT listing_id FROM target)""")
def new_listings(spark, data):
    target, updates = _split(spark, data)
    return merge.new_only(updates.select("listing_id"), target)


@query("existing_listings", f"""
WITH {_SPLIT} SELECT listing_id FROM updates WHERE listing_id IN (SELECT listing_id FROM target)""")
def existing_listings(spark, data):
    target, updates = _split(spark, data)
    return merge.existing(updates.select("listing_id"), target)


def _upserted(spark, data):
    target, updates = _split(spark, data)
    return merge.upsert(stored(target, "target"), stored(updates, "updates"), "listing_id", AS_OF)


_MERGED_COLUMNS = ["listing_id", "src_seq", "name", "max_award", "created_at", "updated_at",
                   "action"]
_MERGED = f"""{_SPLIT},
merged AS (SELECT t.listing_id, CASE WHEN same IS false THEN u.src_seq ELSE t.src_seq END
    AS src_seq, CASE WHEN same IS false THEN u.name ELSE t.name END AS name,
    CASE WHEN same IS false THEN u.max_award ELSE t.max_award END AS max_award, t.created_at,
    CASE WHEN same IS false THEN TIMESTAMP '{AS_OF}' ELSE t.updated_at END AS updated_at,
    CASE WHEN u.listing_id IS NULL THEN 'keep' WHEN same THEN 'unchanged' ELSE 'update' END
      AS action
  FROM target t LEFT JOIN (SELECT u.*, {' AND '.join(
      f'u.{c} IS NOT DISTINCT FROM o.{c}' for c in (
          'name deadline url description eligibility organization academic_level target_type '
          'ethnicity gender min_award max_award renewable country is_active source').split())}
      AS same FROM updates u JOIN target o ON u.listing_id = o.listing_id) u
    ON t.listing_id = u.listing_id
  UNION ALL SELECT listing_id, src_seq, name, max_award, created_at, TIMESTAMP '{AS_OF}',
    'insert' FROM updates WHERE listing_id NOT IN (SELECT listing_id FROM target))"""


@query("upsert_listings", f"WITH {_MERGED} SELECT {', '.join(_MERGED_COLUMNS)} FROM merged")
def upsert_listings(spark, data):
    return _upserted(spark, data).select(*_MERGED_COLUMNS)


@query("upsert_stats", f"WITH {_MERGED} SELECT action, count(*) AS n FROM merged GROUP BY 1")
def upsert_stats(spark, data):
    return merge.merge_stats(_upserted(spark, data))


@query("insert_ignore", f"""
WITH {_SPLIT} SELECT listing_id, max_award FROM target UNION ALL
SELECT listing_id, max_award FROM updates
WHERE listing_id NOT IN (SELECT listing_id FROM target)""")
def insert_ignore(spark, data):
    target, updates = _split(spark, data)
    columns = ["listing_id", "max_award"]
    return merge.insert_ignore(target.select(*columns), updates.select(*columns), "listing_id")


_OVERLAID = ["organization", "academic_level", "min_award", "max_award", "renewable"]


@query("overlay_details", f"""
WITH {sql.LISTINGS}, {sql.DETAILS} SELECT l.url,
  coalesce(nullif(d.organization, ''), l.organization) AS organization,
  coalesce(nullif(d.academic_level, ''), l.academic_level) AS academic_level,
  CASE WHEN d.min_award > 0 THEN d.min_award ELSE l.min_award END AS min_award,
  CASE WHEN d.max_award > 0 THEN d.max_award ELSE l.max_award END AS max_award,
  coalesce(d.renewable, l.renewable) AS renewable
FROM listings l LEFT JOIN details d ON l.url = d.url""")
def overlay_details(spark, data):
    rows = fx.listings(spark, data).select("url", *_OVERLAID)
    return merge.overlay(rows, fx.details(spark, data), "url", _OVERLAID)


@query("overlay_cleaned", f"""
WITH {sql.LISTINGS}, {sql.DETAILS}, told AS (SELECT url, CASE WHEN l_flag = 'R' THEN '' ELSE
    repeat('The applicant must be a  resident. ', 9 * l_lines) END AS eligibility, l_lines
  FROM (SELECT 'https://listings.example.org/a/' || l_orderkey AS url, max(l_returnflag) AS l_flag, max(l_linenumber) AS l_lines
  FROM lineitem GROUP BY l_orderkey))
SELECT l.url, coalesce(nullif(d.organization, ''), l.organization) AS organization,
  CASE WHEN t.eligibility <> '' THEN {sql.truncate(sql.strip_phrases('t.eligibility'), 1000)} ELSE l.eligibility END AS eligibility
FROM listings l LEFT JOIN details d ON l.url = d.url LEFT JOIN told t ON l.url = t.url""")
def overlay_cleaned(spark, data):
    """Listings with their detail pages' fields, the eligibility without stock phrases and cut."""
    rows = fx.listings(spark, data).select("url", "organization", "eligibility")
    told = table(spark, data, "lineitem").groupBy("l_orderkey").agg(
        F.max("l_returnflag").alias("flag"), F.max("l_linenumber").alias("lines")).select(
        fx.concat("https://listings.example.org/a/", fx.text(F.col("l_orderkey"))).alias("url"),
        F.when(F.col("flag") == "R", "").otherwise(F.repeat(F.lit("The applicant must be a  resident. "), 9 * F.col("lines")))
        .alias("eligibility"))
    details = fx.details(spark, data).select("url", "organization").join(told, "url")
    return curate.with_details(rows, details)


@query("overlay_unconditional", f"""
WITH {sql.LISTINGS}, {sql.DETAILS} SELECT l.url,
  {', '.join(f'coalesce(d.{c}, l.{c}) AS {c}' for c in _OVERLAID)}
FROM listings l LEFT JOIN details d ON l.url = d.url""")
def overlay_unconditional(spark, data):
    rows = fx.listings(spark, data).select("url", *_OVERLAID)
    return merge.overlay(rows, fx.details(spark, data), "url", _OVERLAID, guarded=False)


@query("patch_rows", """
SELECT p_partkey, p_name, coalesce(CASE WHEN price > 0 THEN 'Sold ' || p_type END, p_type)
  AS p_type, coalesce(price, p_retailprice) AS p_retailprice
FROM part LEFT JOIN (SELECT l_partkey, max(l_extendedprice) AS price FROM lineitem
  WHERE l_returnflag = 'R' GROUP BY 1) ON p_partkey = l_partkey""")
def patch_rows(spark, data):
    """Parts patched from what was returned; the name is not on the allow list."""
    columns = ["p_partkey", "p_name", "p_type", "p_retailprice"]
    parts = table(spark, data, "part").select(*columns)
    returned = (table(spark, data, "lineitem").filter("l_returnflag = 'R'")
                .groupBy(F.col("l_partkey").alias("p_partkey"))
                .agg(F.max("l_extendedprice").alias("p_retailprice")))
    kinds = parts.select("p_partkey", fx.concat("Sold ", F.col("p_type")).alias("p_type"))
    changes = (returned.join(kinds, "p_partkey").withColumn("p_name", F.lit("not allowed"))
               .select(*columns))
    return merge.patch(parts, changes, "p_partkey", ["p_type", "p_retailprice"])


@query("append_rows", f"""
WITH {_SPLIT} SELECT listing_id, academic_level, max_award FROM target UNION ALL
SELECT listing_id, academic_level, max_award FROM updates""")
def append_rows_(spark, data):
    """An insert whose rows use the source's spelling."""
    target, updates = _split(spark, data)
    camel = updates.select("listing_id", F.col("academic_level").alias("academicLevel"),
                           F.col("max_award").alias("maxAward"))
    return append_rows(target.select("listing_id", "academic_level", "max_award"), camel)


@query("update_where", f"""
WITH {sql.RAW} SELECT src_seq, CASE WHEN status = 'F' AND name = 'Award 5 Fund'
  THEN 'patched' ELSE deadline END AS deadline FROM raw""")
def update_where(spark, data):
    rows = fx.listings_raw(spark, data, organization=False)
    return merge.update_where(rows, {"deadline": "patched"},
                              {"status": "F", "name": "Award 5 Fund"}) \
        .select("src_seq", "deadline")


@query("delete_where", f"""
WITH {sql.RAW} SELECT src_seq, status FROM raw WHERE NOT (status = 'F')""")
def delete_where(spark, data):
    rows = fx.listings_raw(spark, data, organization=False)
    return merge.delete_where(rows, {"status": "F"}).select("src_seq", "status")


@query("affected_rows", f"""
WITH {sql.RAW} SELECT count(*) FILTER (WHERE status = 'F' AND deadline = '') AS affected
FROM raw""")
def affected_rows(spark, data):
    rows = fx.listings_raw(spark, data, organization=False)
    return merge.affected(rows, {"status": "F", "deadline": ""})


# --- sites and plans -----------------------------------------------------------------------

@query("enabled_sites", f"""
WITH {sql.SITES} SELECT 'any' AS wanted, site FROM sites WHERE coalesce(enabled, true)
UNION ALL SELECT 'crawl', site FROM sites WHERE coalesce(enabled, true) AND type = 'crawl'""")
def enabled_sites(spark, data):
    rows = fx.sites(spark, data)
    return filters.enabled(rows).select(F.lit("any").alias("wanted"), "site").unionAll(
        filters.enabled(rows, "crawl").select(F.lit("crawl"), "site"))


@query("term_plan", f"""
WITH {sql.SITES}, {sql.SITE_TERMS} SELECT site, pos, term, s_nationkey + 10 AS max_results
FROM terms""")
def term_plan(spark, data):
    return crawl.term_plan(read_sites(fx.sites(spark, data)))


@query("focus_plan", f"""
WITH {sql.SITES}, {sql.SITE_TERMS} SELECT site, term, CAST(ceil(50 / (CASE WHEN s_acctbal > 5000
  THEN 3.0 ELSE 2.0 END)) AS INT) AS max_results FROM terms JOIN sites USING (site)""")
def focus_plan(spark, data):
    return crawl.focus_plan(read_sites(fx.sites(spark, data)), 50)


@query("focus_requests", f"""
WITH {sql.SITES}, {sql.SITE_TERMS}, plan AS (SELECT site, term, CAST(ceil(50 / (CASE WHEN s_acctbal > 5000
  THEN 3.0 ELSE 2.0 END)) AS INT) AS n FROM terms JOIN sites USING (site))
SELECT site, term, replace(replace({sql.quoted(crawl.FOCUS_PROMPT)}, '%d', n::varchar), '%s', term) AS prompt FROM plan""")
def focus_requests(spark, data):
    plan = crawl.focus_plan(read_sites(fx.sites(spark, data)), 50)
    return crawl.focus_requests(plan).select("site", "term", "prompt")


@query("crawl_plan", f"""
WITH {sql.SITES} SELECT site, page, url || CASE WHEN page > 1 THEN '?page=' || page ELSE '' END
  AS request_url FROM sites, (SELECT unnest([1, 2, 3]) AS page)""")
def crawl_plan(spark, data):
    return crawl.page_plan(fx.sites(spark, data)).select("site", "page", "request_url")


# --- rollups ---------------------------------------------------------------------------------

@query("type_counts", f"""
WITH {sql.LISTINGS} SELECT target_type, count(*) AS n FROM listings GROUP BY 1""")
def type_counts(spark, data):
    return rollups.type_counts(fx.listings(spark, data))


@query("table_totals", f"""
WITH {sql.RAW}, {sql.SITES}, {sql.JOB_EVENTS} SELECT 'listings' AS figure, count(*) AS n FROM raw
UNION ALL SELECT 'active_listings', count(*) FROM raw WHERE status <> 'F'
UNION ALL SELECT 'sites', count(*) FROM sites
UNION ALL SELECT 'jobs', count(DISTINCT job_id) FROM job_events""")
def table_totals(spark, data):
    rows = fx.listings_raw(spark, data, organization=False).select(
        (F.col("status") != "F").alias("is_active"))
    jobs = fx.job_events(spark, data).select("job_id").distinct()
    return rollups.totals(rows, fx.sites(spark, data), jobs)


@query("run_summary", f"""
WITH {sql.JOB_EVENTS}, runs AS (SELECT *, status = 'completed' AS success FROM job_events
  WHERE status IN ('completed', 'failed'))
SELECT CAST(sum(records_found) FILTER (WHERE success) AS BIGINT) AS total_found,
  CAST(sum(records_inserted) FILTER (WHERE success) AS BIGINT) AS total_inserted,
  CAST(sum(records_updated) FILTER (WHERE success) AS BIGINT) AS total_updated,
  count(message) FILTER (WHERE NOT success) AS total_errors FROM runs""")
def run_summary(spark, data):
    runs = fx.job_events(spark, data).filter(F.col("status").isin("completed", "failed"))
    return rollups.run_summary(runs.withColumn("success", F.col("status") == "completed"))


_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in rollups.COUNTERS)


@query("job_metrics", f"""
WITH {sql.JOB_EVENTS} SELECT job_id, {_SUMS}, count(message) AS errors
FROM job_events GROUP BY 1""")
def job_metrics(spark, data):
    return rollups.job_metrics(fx.job_events(spark, data))


_LATEST = f"""{sql.JOB_EVENTS}, latest AS (SELECT * FROM job_events QUALIFY row_number() OVER
  (PARTITION BY job_id ORDER BY event_ts DESC, event_id DESC) = 1)"""


@query("latest_job_status", f"""
WITH {_LATEST} SELECT job_id, status, event_ts,
  CASE WHEN status IN ('completed', 'failed') THEN event_ts END AS completed_at FROM latest""")
def latest_job_status(spark, data):
    return rollups.latest_status(fx.job_events(spark, data))


@query("job_outcomes", f"""
WITH {_LATEST} SELECT strftime(event_ts, '%Y-%m-%d') AS run_day, count(*) AS total,
  count(*) FILTER (WHERE status = 'completed') AS succeeded,
  count(*) FILTER (WHERE status <> 'completed') AS failed FROM latest GROUP BY 1""")
def job_outcomes(spark, data):
    jobs = rollups.latest_status(fx.job_events(spark, data))
    return rollups.job_outcomes(
        jobs.withColumn("run_day", F.date_format("event_ts", "yyyy-MM-dd")), "run_day")


@query("error_classes", f"""
WITH {sql.JOB_EVENTS} SELECT CASE WHEN lower(message) LIKE '%timeout%' THEN 'timeout'
  WHEN lower(message) LIKE '%throttlingexception%' THEN 'throttling' ELSE 'other' END
  AS error_class, count(*) AS n FROM job_events WHERE message IS NOT NULL GROUP BY 1""")
def error_classes(spark, data):
    return rollups.error_classes(fx.job_events(spark, data))


@query("recent_listings", f"""
WITH {sql.LISTINGS} SELECT listing_id, name, deadline, source, organization FROM listings
ORDER BY created_at DESC, src_seq LIMIT 5""")
def recent_listings(spark, data):
    return rollups.recent(fx.listings(spark, data), 5, "created_at", "src_seq").select(
        "listing_id", "name", "deadline", "source", "organization")


@query("recent_jobs", f"""
WITH {_LATEST} SELECT job_id, status, event_ts FROM latest ORDER BY event_ts DESC, job_id LIMIT 5""")
def recent_jobs(spark, data):
    jobs = rollups.latest_status(fx.job_events(spark, data))
    return rollups.recent(jobs, 5, "event_ts", "job_id").select("job_id", "status", "event_ts")


@query("sample_rows", f"WITH {sql.RAW} SELECT * EXCLUDE (site) FROM raw ORDER BY src_seq LIMIT 3")
def sample_rows(spark, data):
    return rollups.sample(fx.listings_raw(spark, data), 3, "src_seq")


@query("application_status", f"""
WITH {sql.APPLICATIONS}
{' UNION ALL '.join(f"SELECT '{g}' AS grouping, CAST({c} AS VARCHAR) AS member, status, "
                    f"count(*) AS n FROM applications GROUP BY 2, 3"
                    for g, c in (('user', 'user_id'), ('listing', 'listing_id'),
                                 ('organization', 'organization')))}""")
def application_status(spark, data):
    return rollups.application_status(fx.applications(spark, data))


@query("application_listings", f"""
WITH {sql.APPLICATIONS}, firsts AS (SELECT {sql.listing_id()} AS listing_id, name FROM
  ({sql.first_row('raw', sql.listing_id())}))
SELECT listing_id, status, count(*) AS n, any_value(name) AS name
FROM applications JOIN firsts USING (listing_id) GROUP BY 1, 2""")
def application_listings(spark, data):
    rows = fx.listings(spark, data).select("listing_id", "name", "src_seq")
    firsts = dedupe.dedupe_first(rows, ["listing_id"], [F.col("src_seq")])
    return rollups.listing_applications(fx.applications(spark, data), firsts)


# --- keywords and search ----------------------------------------------------------------------

_WORDS = ", ".join(f"('{c}', {i}, {sql.quoted(w)})" for c, words in V.KEYWORDS.items()
                   for i, w in enumerate(words))


@query("keyword_tags", f"""
WITH {sql.RAW}, words(category, pos, keyword) AS (VALUES {_WORDS})
SELECT src_seq, category, keyword FROM raw, words WHERE contains(' ' ||
  regexp_replace(lower(name || ' ' || eligibility), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' ',
  ' ' || lower(keyword) || ' ')""")
def keyword_tags(spark, data):
    text = F.concat_ws(" ", "name", "eligibility")
    return search.tag_keywords(fx.listings_raw(spark, data, organization=False), text, "src_seq")


_WORDS_OF = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


@query("dictionary_tags", f"""
WITH words AS (SELECT doc_id, lang, {_WORDS_OF.format('text')} AS w FROM documents WHERE text IS NOT NULL),
dictionary AS (SELECT DISTINCT coalesce(lang, 'none') AS category, array_to_string(w[2:1 + n], ' ') AS phrase
  FROM words, (SELECT unnest([1, 2, 4]) AS n) WHERE doc_id % 3 = 0 AND len(w) > n),
texts AS (SELECT item_id, {_WORDS_OF.format('text')} AS w FROM benchmark
  UNION ALL SELECT -1 - doc_id, w FROM words WHERE doc_id % 3 = 1),
runs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM texts), (SELECT unnest([1, 2, 4]) AS n) WHERE i + n - 1 <= len(w))
SELECT item_id, category, phrase AS keyword FROM runs JOIN dictionary USING (phrase)""")
def dictionary_tags(spark, data):
    """Texts tagged by a dictionary that is a table: words, pairs and runs of four words of every third document."""
    docs = table(spark, data, "documents").filter("text is not null")
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    given = docs.filter("doc_id % 3 = 0").select(F.coalesce("lang", F.lit("none")).alias("category"), words.alias("w"),
                                                 F.explode(F.array(*map(F.lit, (1, 2, 4)))).alias("n"))
    dictionary = given.filter("size(w) > n").select("category", F.array_join(F.slice("w", F.lit(2), F.col("n")), " ").alias("keyword"))
    texts = table(spark, data, "benchmark").select("item_id", "text").union(
        docs.filter("doc_id % 3 = 1").select(-1 - F.col("doc_id"), "text"))
    return search.tag_dictionary(texts, F.col("text"), "item_id", dictionary)


@query("keyword_union", f"""
WITH {sql.RAW}, words(category, pos, keyword) AS (VALUES {_WORDS}),
hits AS (SELECT src_seq, lower(keyword) AS keyword, min(CASE category WHEN 'demographic' THEN 0 ELSE 100 END + pos)
  AS place FROM raw, words WHERE category IN ('demographic', 'academic')
  AND contains(' ' || regexp_replace(lower(eligibility), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' ',
  ' ' || lower(keyword) || ' ') GROUP BY 1, 2)
SELECT src_seq, coalesce(string_agg(keyword, ', ' ORDER BY place), '') AS keywords
FROM raw LEFT JOIN hits USING (src_seq) GROUP BY 1""")
def keyword_union(spark, data):
    words = search.keyword_union(F.col("eligibility"), ["demographic", "academic", "demographic"])
    return fx.listings_raw(spark, data, organization=False).select(
        "src_seq", F.array_join(words, ", ").alias("keywords"))


_TERMS = ["the", "avec", "nicht", "que", "ththre"]


@query("text_search", f"""
WITH tokens AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS t
  FROM documents), hits AS (SELECT doc_id, t, count(*) AS tf FROM tokens
  WHERE t IN ({', '.join(map(sql.quoted, _TERMS))}) GROUP BY 1, 2),
weights AS (SELECT t, ln(1 + (SELECT count(*) FROM documents) / count(*)) AS w
  FROM hits GROUP BY 1)
SELECT doc_id, round(sum(tf * w), 4) AS score FROM hits JOIN weights USING (t)
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def text_search(spark, data):
    """Top 20 documents for five terms, from stored postings."""
    documents = table(spark, data, "documents")
    path = scratch_dir(spark, "postings") + "/terms"
    search.write_postings(search.build_postings(documents, "doc_id", ["text"]), path)
    return search.search(search.read_postings(spark, path, _TERMS), "doc_id", _TERMS, 20,
                         documents.count())


@query("search_after_changes", f"""
WITH live AS (SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN text || ' la the La' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 9),
tokens AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS t FROM live),
hits AS (SELECT doc_id, t, count(*) AS tf FROM tokens WHERE t IN ({', '.join(map(sql.quoted, _TERMS))}) GROUP BY 1, 2),
weights AS (SELECT t, ln(1 + (SELECT count(*) FROM live) / count(*)) AS w FROM hits GROUP BY 1)
SELECT doc_id, round(sum(tf * w), 4) AS score FROM hits JOIN weights USING (t)
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def search_after_changes(spark, data):
    """The same search over an index that took the documents in two batches, replaced some and lost some."""
    documents = table(spark, data, "documents").select("doc_id", "text")
    index = PostingIndex(spark, scratch_dir(spark, "index") + "/documents", "doc_id", "bigint", ["text"], 8)
    late = documents.filter("doc_id % 4 = 3")
    index.apply(documents.filter("doc_id % 4 <> 3"), None, 0)
    again = documents.filter("doc_id % 8 = 0").withColumn("text", F.concat("text", F.lit(" la the La")))
    index.apply(late.unionByName(again), documents.filter("doc_id % 10 = 9 and doc_id % 4 <> 3"), 1)
    index.apply(None, late.filter("doc_id % 10 = 9"), 2)
    return index.search(_TERMS, 20)


@query("text_postings", """
WITH tokens AS (SELECT page_id, unnest(regexp_extract_all(lower(url || ' ' || html),
  '[\\p{L}\\p{N}]+')) AS term FROM pages)
SELECT term, page_id, count(*) AS tf FROM tokens GROUP BY 1, 2""")
def text_postings(spark, data):
    return search.build_postings(table(spark, data, "pages"), "page_id", ["url", "html"])
