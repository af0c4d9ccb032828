"""Queries over pages and payloads: extraction, feeds, replies, the archive."""

from pyspark.sql import functions as F

from listingflow import vocabulary as V
from listingflow.catalog import fixtures as fx, oracle as sql
from listingflow.catalog.core import YEAR, query, table
from listingflow.functions import classify, links
from listingflow.functions.replies import organization_from_text
from listingflow.operators import filters
from listingflow.session import scratch_dir, stored
from listingflow.sources import archive, feeds, pages

_PROSE = sql.strip_phrases(sql.PROSE)


# --- listings and details out of HTML --------------------------------------------------------

@query("row_listings", f"""
WITH {sql.RAW}, t AS (SELECT *, name || ' ' || {sql.PROSE} || ' ' || {sql.PURPOSES} AS about,
  row_number() OVER (PARTITION BY src_seq // 25 ORDER BY src_seq) AS pos FROM raw)
SELECT src_seq // 25 AS page_id, CAST(pos AS INT) AS pos, name,
  {sql.format_deadline("coalesce(nullif(deadline, ''), 'No deadline specified')")} AS deadline,
  'https://awards.example.org/detail/' || src_seq AS url, {_PROSE} AS description, organization,
  CASE WHEN status = 'O' THEN 'undergraduate' ELSE 'high school' END AS academic_level,
  {sql.target_type('about')} AS target_type,
  coalesce(nullif({sql.ethnicities('about')}, ''), 'unspecified') AS ethnicity,
  coalesce({sql.gender('about')}, 'unspecified') AS gender,
  {sql.award('amount')} AS min_award, {sql.award('amount')} AS max_award
FROM t WHERE status <> 'P'""")
def row_listings(spark, data):
    return pages.extract_rows(fx.row_pages(spark, data), "https://awards.example.org", YEAR,
                              "the awards database")


@query("block_listings", f"""
WITH {sql.RAW}, t AS (SELECT *, name || ' ' || {sql.PURPOSES} || ' ' || eligibility || ' | Org ' ||
  organization AS about, eligibility || ' | ' || trim('Org ' || organization) AS needs,
  row_number() OVER (PARTITION BY src_seq // 25 ORDER BY src_seq) AS pos FROM raw)
SELECT src_seq // 25 AS page_id, CAST(pos + 1 AS INT) AS pos, name,
  {sql.format_deadline("coalesce(nullif(deadline, ''), 'No deadline specified')")} AS deadline, url,
  {_PROSE} AS description, {sql.strip_phrases('needs')} AS eligibility,
  'junior | senior' AS academic_level,
  CASE WHEN status = 'F' THEN '' ELSE 'Ohio' END AS geographic_restrictions,
  {sql.target_type('about')} AS target_type,
  coalesce(nullif({sql.ethnicities('about')}, ''), 'unspecified') AS ethnicity,
  coalesce({sql.gender('about')}, 'unspecified') AS gender,
  {sql.award('amount')} AS min_award, {sql.award('amount')} AS max_award FROM t""")
def block_listings(spark, data):
    return pages.extract_blocks(fx.block_pages(spark, data), YEAR)


@query("label_details", f"""
WITH {sql.RAW} SELECT src_seq AS page_id, organization, 'graduate' AS academic_level, eligibility,
  {sql.award('amount')} AS min_award, {sql.award('amount')} AS max_award,
  status = 'F' AS renewable, {sql.format_deadline('deadline')} AS deadline,
  'State ' || status AS geographic_restrictions,
  CASE WHEN status = 'O' THEN 'https://apply.example.org/' || src_seq
    ELSE 'https://more.example.org/' || src_seq END AS apply_url FROM raw""")
def label_details(spark, data):
    return pages.extract_labels(fx.label_pages(spark, data), YEAR)


@query("dl_details", f"""
WITH {sql.RAW} SELECT src_seq AS page_id, {sql.PURPOSES} AS description,
  {sql.format_deadline('deadline')} AS deadline, status = 'F' AS renewable,
  CAST(1000 AS DOUBLE) AS min_award, {sql.award('amount')} AS max_award, 'college' AS academic_level,
  'US' AS country, eligibility, coalesce(nullif(organization, ''), 'Second line') AS organization,
  'https://listings.example.org/apply/' || src_seq AS apply_url FROM raw""")
def dl_details(spark, data):
    return pages.extract_terms(fx.term_pages(spark, data), YEAR)


@query("broad_listings", f"""
WITH {sql.RAW}, t AS (SELECT *,
  row_number() OVER (PARTITION BY src_seq // 25 ORDER BY src_seq) AS pos FROM raw)
SELECT src_seq // 25 AS page_id, CAST(pos - 1 AS INT) AS pos,
  {sql.short_id('name', 'organization')} AS listing_id, name,
  nullif(organization, '') AS organization,
  {sql.low_award("coalesce(nullif(amount, ''), name)")} AS min_award,
  {sql.high_award("coalesce(nullif(amount, ''), name)")} AS max_award,
  nullif(deadline, '') AS deadline, {sql.PURPOSES} AS description,
  'https://awards.example.org/d/' || src_seq || '?x=1' AS url FROM t""")
def broad_listings(spark, data):
    base = fx.concat("https://awards.example.org/list/", fx.text(F.col("page_id")))
    return pages.extract_broad(fx.broad_pages(spark, data), base)


@query("spec_listings", f"""
WITH {sql.RAW}, t AS (SELECT *, site IN ('AUTOMOBILE', 'BUILDING') AS a FROM raw)
SELECT src_seq AS page_id, site, name, nullif(amount, '') AS amount,
  nullif(deadline, '') AS deadline,
  CASE WHEN NOT a THEN {sql.PURPOSES} END AS description,
  CASE WHEN NOT a THEN nullif(organization, '') END AS organization,
  CASE WHEN a THEN '/award/' || src_seq END AS href FROM t""")
def spec_listings(spark, data):
    return pages.extract_by_spec(fx.spec_pages(spark, data), fx.spec_sites(spark, data))


_UNESCAPED = "html"
for _name, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _UNESCAPED = f"replace({_UNESCAPED}, '{_name}', '{_char}')"


@query("page_links", f"""
WITH raw_links AS (SELECT page_id, url, {_UNESCAPED} AS plain,
  regexp_extract(html, '<a href="([^"]*)"', 1) AS href FROM pages)
SELECT page_id, trim(regexp_replace(regexp_extract(plain, '<h1>(.*?)</h1>', 1), '\\s+', ' ', 'g'))
  AS title, CASE WHEN href = '' THEN NULL WHEN href LIKE 'http%' THEN href
    ELSE regexp_extract(url, '^https?://[^/?#]*') || href END AS link FROM raw_links""")
def page_links(spark, data):
    return pages.page_titles_and_links(table(spark, data, "pages"))


# --- page filters ------------------------------------------------------------------------------

@query("relevant_pages", f"""
WITH {sql.RAW}, mixed AS (SELECT page_id, url, html FROM pages UNION ALL
  SELECT 1000000 + src_seq, url, CASE WHEN status = 'F' THEN '' ELSE '<p>Apply by the deadline</p>'
  END || name || eligibility FROM raw)
SELECT page_id FROM mixed WHERE {sql.any_of('lower(url)', V.PAGE_KEYWORDS)} OR
  ({sql.any_of('lower(html)', V.PAGE_KEYWORDS)} AND contains(lower(html), 'apply')
   AND {sql.any_of('lower(html)', V.PAGE_DETAIL_WORDS)})""")
def relevant_pages(spark, data):
    """Rendered listing pages mixed with pages of another kind."""
    hint = F.when(F.col("status") == "F", "").otherwise("<p>Apply by the deadline</p>")
    rendered = fx.listings_raw(spark, data, organization=False).select(
        (F.col("src_seq") + 1000000).alias("page_id"), "url",
        fx.concat(hint, F.col("name"), F.col("eligibility")).alias("html"))
    mixed = table(spark, data, "pages").select("page_id", "url", "html").unionByName(rendered)
    return mixed.filter(classify.is_listing_page(F.col("url"), F.col("html"))).select("page_id")


_SCOPE = {"allowed_domains": ["example.org", "example.com"], "blocked_domains":
          ["cheap-pills.example.com"], "allowed_paths": ["/en/", "/de/"],
          "blocked_paths": ["/en/4"], "keyword_patterns": ["utm_source", "page="]}


@query("in_scope_pages", """
WITH h AS (SELECT page_id, lower(url) AS u, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host,
  regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, host FROM h WHERE (host LIKE '%.example.org' OR host LIKE '%.example.com')
  AND NOT (host = 'cheap-pills.example.com' OR host LIKE '%.cheap-pills.example.com')
  AND (path LIKE '/en/%' OR path LIKE '/de/%') AND path NOT LIKE '/en/4%'
  AND (contains(u, 'utm_source') OR contains(u, 'page='))""")
def in_scope_pages(spark, data):
    kept = filters.in_scope(table(spark, data, "pages"), _SCOPE)
    return kept.select("page_id", links.host(F.col("url")).alias("host"))


def _crawled(spark, data):
    """Pages with the site that found them and the depth it found them at, sites, and the domains of their scopes."""
    host = links.host(F.col("url"))
    found = table(spark, data, "pages").select(
        "page_id", "url", F.concat(F.lit("site-"), fx.text(F.col("page_id") % 3)).alias("site"),
        F.when(F.col("page_id") % 11 != 0, F.col("page_id") % 6).alias("depth"))
    sites = found.groupBy("site").agg(F.min(F.struct("page_id", "url")).alias("first")).select("site", "first.url")
    below = F.substring_index(host, ".", -2)
    domains = found.filter("site = 'site-1'").select("site", below.alias("domain"), F.lit(True).alias("allowed")).union(
        found.filter("site <> 'site-0'").select("site", F.upper(host).alias("domain"), (F.length(host) % 3 != 0).alias("allowed")))
    return found, sites, domains.distinct()


@query("site_scope_pages", """
WITH found AS (SELECT page_id, url, 'site-' || page_id % 3 AS site, CASE WHEN page_id % 11 <> 0 THEN page_id % 6 END AS depth,
  lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^:/?#]*)', 1)) AS host FROM pages),
listed AS (SELECT DISTINCT site, array_to_string(string_split(host, '.')[-2:], '.') AS domain, true AS allowed FROM found
    WHERE site = 'site-1'
  UNION SELECT site, host, length(host) % 3 <> 0 FROM found WHERE site <> 'site-0'),
own AS (SELECT site, arg_min(host, page_id) AS domain FROM found GROUP BY 1),
scopes AS (SELECT site, domain, bool_and(allowed) AS allowed FROM (SELECT * FROM listed UNION ALL
  SELECT site, domain, true FROM own o WHERE NOT EXISTS (SELECT 1 FROM listed l WHERE l.site = o.site AND l.domain = o.domain))
  GROUP BY 1, 2),
judged AS (SELECT f.page_id, f.site, f.depth, arg_max(s.allowed, length(s.domain)) AS allowed FROM found f JOIN scopes s
  ON s.site = f.site AND (f.host = s.domain OR f.host LIKE '%.' || s.domain) GROUP BY 1, 2, 3)
SELECT page_id, site FROM judged WHERE allowed AND coalesce(depth, 0) <= 3""")
def site_scope_pages(spark, data):
    """Pages in the scope of their site: its own host, its domains, and three links deep."""
    found, sites, domains = _crawled(spark, data)
    return filters.scope_by_site(found, sites, domains, depth="depth").select("page_id", "site")


@query("default_scope_pages", f"""
WITH {sql.RAW}, u AS (SELECT src_seq, CASE status WHEN 'F' THEN 'https://www.uni.edu/awards/'
  WHEN 'O' THEN 'https://m.facebook.com/awards/' ELSE 'https://gov.org/login/award/' END ||
  src_seq AS url FROM raw) SELECT * FROM u WHERE url LIKE 'https://www.uni.edu/%'""")
def default_scope_pages(spark, data):
    """The built-in crawl scope over addresses made from listings."""
    start = (F.when(F.col("status") == "F", "https://www.uni.edu/awards/")
             .when(F.col("status") == "O", "https://m.facebook.com/awards/")
             .otherwise("https://gov.org/login/award/"))
    rows = fx.listings_raw(spark, data, organization=False).select(
        "src_seq", fx.concat(start, fx.text(F.col("src_seq"))).alias("url"))
    return filters.in_scope(rows)


# --- feeds, JSON payloads, replies ---------------------------------------------------------------

_ABOUT = "CASE WHEN status = 'O' THEN 'The ' || organization || ' Foundation offers R&D <aid>' " \
    "ELSE eligibility END"
_ORG = "CASE WHEN status <> 'O' THEN 'Unknown Organization' WHEN organization = '' THEN 'The' " \
    "ELSE upper(substr(site, 1, 1)) || lower(substr(site, 2)) END"


@query("rss_items", f"""
WITH {sql.RAW}, t AS (SELECT *, {_ABOUT} AS about, {_ORG} AS org,
  row_number() OVER (PARTITION BY src_seq // 25 ORDER BY src_seq) - 1 AS pos FROM raw)
SELECT src_seq // 25 AS page_id, CAST(pos AS INT) AS pos,
  substr(md5(lower(name || '-' || org)), 1, 16) AS listing_id, name, about AS description,
  org AS organization, url FROM t""")
def rss_items(spark, data):
    return feeds.read_feed(fx.feed_payloads(spark, data), "page_id")


@query("rss_file_items", f"""
WITH {sql.RAW}, t AS (SELECT *, {_ABOUT} AS about, {_ORG} AS org FROM raw)
SELECT substr(md5(lower(name || '-' || org)), 1, 16) AS listing_id, name, about AS description,
  org AS organization, url FROM t""")
def rss_file_items(spark, data):
    """The same feeds written as files, read by the XML source."""
    path = scratch_dir(spark, "feeds") + "/files"
    feed = fx.feed_payloads(spark, data, 1000).filter("page_id >= 0").select("xml")
    feed.write.option("maxRecordsPerFile", 1).text(path)
    return feeds.read_feed_files(spark, path)


@query("api_items", f"""
WITH {sql.RAW}, t AS (SELECT *, CASE WHEN src_seq % 4 = 3 THEN src_seq * 4 + 3
    ELSE (src_seq // 32) * 4 + src_seq % 4 END AS page_id FROM raw)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY src_seq) - 1 AS INT) AS pos,
  {sql.short_id('name', 'organization')} AS listing_id, name, eligibility AS description,
  nullif(organization, '') AS organization, url,
  CASE WHEN src_seq % 4 < 2 THEN {sql.low_award('amount')}
    ELSE nullif({sql.award('amount')}, 0) END AS min_award,
  CASE WHEN src_seq % 4 < 2 THEN {sql.high_award('amount')}
    ELSE nullif({sql.award('amount')}, 0) END AS max_award FROM t""")
def api_items(spark, data):
    return feeds.read_api(fx.api_payloads(spark, data), "page_id")


@query("reply_items", f"""
WITH {sql.RAW}, t AS (SELECT *, {sql.PURPOSES} || ' ' || eligibility AS audience,
  row_number() OVER (PARTITION BY src_seq // 25 ORDER BY src_seq) - 1 AS pos FROM raw),
u AS (SELECT *, {sql.levels("(audience || ' graduate')")} AS levels FROM t)
SELECT src_seq // 25 AS page_id, CAST(pos AS INT) AS pos, name,
  coalesce(nullif(deadline, ''), 'Various deadlines') AS deadline,
  'https://w.example.org' AS url, {_PROSE} AS description,
  {sql.strip_phrases('eligibility')} || ' | ' || levels AS eligibility, organization,
  lower(levels) AS academic_level, 'Ohio' AS geographic_restrictions,
  {sql.target_type('audience')} AS target_type,
  coalesce(nullif({sql.ethnicities('audience')}, ''), 'unspecified') AS ethnicity,
  coalesce({sql.gender('audience')}, 'unspecified') AS gender,
  {sql.award('amount')} AS min_award, {sql.award('amount')} AS max_award,
  status = 'F' AS renewable, 'US' AS country, url AS apply_url FROM u""")
def reply_items(spark, data):
    return feeds.read_replies(fx.reply_payloads(spark, data), "page_id")


@query("reply_texts", """
SELECT CAST(-1 - r_regionkey AS BIGINT) AS page_id, 'Sorry, nothing in [' || r_name AS reply
FROM region""")
def reply_texts(spark, data):
    """Replies of the whole reply table that hold no usable JSON, as raw text."""
    return feeds.unreadable(fx.reply_payloads(spark, data), "page_id")


@query("crawl_reply_items", f"""
WITH {sql.RAW} SELECT src_seq, name, deadline, url, {sql.PROSE} AS description, eligibility,
  organization, 'phd' AS academic_level, '' AS geographic_restrictions, 'merit' AS target_type,
  'unspecified' AS ethnicity, 'unspecified' AS gender, CAST(0 AS DOUBLE) AS min_award,
  CAST(2500 AS DOUBLE) AS max_award,
  status = 'F' AS renewable, 'US' AS country FROM raw WHERE status <> 'P'""")
def crawl_reply_items(spark, data):
    return feeds.read_crawl_replies(fx.crawl_replies(spark, data), "src_seq")


@query("org_from_text", f"""
WITH {sql.RAW} SELECT src_seq, {_ORG} AS organization FROM raw""")
def org_from_text(spark, data):
    about = F.when(F.col("status") == "O", fx.concat(
        "The ", F.col("organization"), " Foundation offers R&D <aid>")).otherwise(
        F.col("eligibility"))
    return fx.listings_raw(spark, data).select(
        "src_seq", organization_from_text(about).alias("organization"))


# --- the raw archive --------------------------------------------------------------------------------

@query("archive_tiers", f"""
WITH {sql.FETCHED}, t AS (SELECT date_diff('day', CAST(fetched_at AS DATE), DATE '2024-05-15')
  AS age, octet_length(encode(html)) AS size FROM fetched)
SELECT CASE WHEN age >= 90 THEN 'cold' WHEN age >= 30 THEN 'infrequent' ELSE 'standard' END
  AS tier, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM t GROUP BY 1""")
def archive_tiers(spark, data):
    rows = archive.archive_rows(fx.fetched_pages(spark, data))
    return archive.tier_report(rows, "2024-05-15")


@query("archive_metadata", f"""
WITH {sql.FETCHED} SELECT url, '{{"url":"' || url || '","timestamp":"' ||
  strftime(fetched_at, '%Y-%m-%dT%H:%M:%S') || '.000Z","scraperName":"' || scraper ||
  '","status":"' || CASE WHEN page_id % 7 = 3 THEN 'error' ELSE 'success' END || '","contentType":"' ||
  CASE WHEN page_id % 5 = 1 THEN 'application/xhtml+xml' ELSE 'text/html' END || '","size":' ||
  octet_length(encode(html)) || CASE WHEN page_id % 7 = 3 THEN ',"errorMessage":"HTTP 503"' ELSE '' END || '}}'
  AS metadata FROM fetched""")
def archive_metadata(spark, data):
    return archive.archive_rows(fx.fetched_pages(spark, data)).select("url", "metadata")


def _written_archive(spark, data):
    path = scratch_dir(spark, "archive") + "/raw"
    archive.write_archive(archive.archive_rows(fx.fetched_pages(spark, data)), path, "overwrite")
    return path


@query("archive_pruned_read", f"""
WITH {sql.FETCHED} SELECT url, scraper, CAST(fetched_at AS DATE) AS day, md5(html) AS digest
FROM fetched WHERE scraper = 'scraper-1'
  AND CAST(fetched_at AS DATE) BETWEEN DATE '2024-02-01' AND DATE '2024-03-31'""")
def archive_pruned_read(spark, data):
    """Write the archive, then read one source and two months of it."""
    path = _written_archive(spark, data)
    rows = archive.read_archive(spark, path, "scraper-1", "2024-02-01", "2024-03-31")
    return rows.select("url", "scraper", F.to_date("fetched_at").alias("day"),
                       F.md5("content").alias("digest"))


@query("archive_by_key", f"""
WITH {sql.FETCHED} SELECT url, md5(html) AS digest FROM fetched WHERE contains(url, '/de/')""")
def archive_by_key(spark, data):
    rows = archive.read_archive(spark, _written_archive(spark, data))
    wanted = rows.filter(F.contains("url", F.lit("/de/"))).select("key")
    return archive.read_by_keys(rows, wanted).select("url", F.md5("content").alias("digest"))


@query("archive_delete", f"""
WITH {sql.FETCHED} SELECT url, md5(html) AS digest FROM fetched WHERE NOT contains(url, '/fr/')""")
def archive_delete(spark, data):
    """What a stored archive holds after keys were deleted from it."""
    table = archive.archive_table(spark, scratch_dir(spark, "archive") + "/raw")
    rows = archive.archive_rows(fx.fetched_pages(spark, data))
    table.add(rows.hint("rebalance", *archive.PARTITIONS))
    doomed = rows.filter(F.contains("url", F.lit("/fr/"))).select("key")
    failures = archive.delete(table, stored(doomed, "doomed"))
    if failures:
        raise RuntimeError(f"folders not rewritten: {failures}")
    return table.read().select("url", F.md5("content").alias("digest"))
