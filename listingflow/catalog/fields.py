"""Queries over single fields: text, money, deadlines, classes, ids."""

from pyspark.sql import functions as F

from listingflow import vocabulary as V
from listingflow.catalog import fixtures as fx, oracle as sql
from listingflow.catalog.core import AS_OF, YEAR, query, table
from listingflow.functions import classify, deadlines, ids, money
from listingflow.functions import text as tx
from listingflow.operators import filters, quality, rollups
from listingflow.operators.dedupe import dedupe_first, dedupe_key
from listingflow.schema import LISTING
from listingflow.session import scratch_dir
from listingflow.sources.tables import union_sources


def _raw(spark, data, *columns, organization=False):
    return fx.listings_raw(spark, data, organization=organization)


_DATED = f"""dated AS (SELECT *, {sql.format_deadline('deadline')} AS dl FROM raw)"""


@query("active_awards_by_type", f"""
WITH {sql.RAW}, {_DATED},
kept AS (SELECT *, {sql.parse_deadline('dl')} AS d FROM dated WHERE NOT {sql.expired('dl')}),
firsts AS ({sql.first_row('kept', "lower(name || '-' || coalesce(nullif(organization, ''), 'unknown'))")})
SELECT {sql.target_type('eligibility')} AS target_type, count(*) AS total_count,
  count(*) FILTER (WHERE d > DATE '{AS_OF}' OR dl = '' OR lower(dl) LIKE '%rolling%')
    AS active_count,
  round(avg({sql.award('amount')}), 2) AS avg_max_award,
  round(sum({sql.award('amount')}), 2) AS total_award_pool
FROM firsts GROUP BY 1""")
def active_awards_by_type(spark, data):
    """Active awards by target type with totals, after expiry and dedupe."""
    raw = fx.with_dates(fx.listings_raw(spark, data))
    kept = filters.drop_expired(raw, AS_OF).select(
        "src_seq", "name", "organization", "deadline", "deadline_date", "eligibility", "amount")
    firsts = dedupe_first(kept, [dedupe_key(F.col("name"), F.col("organization"))],
                          [F.col("src_seq")])
    classified = firsts.select(
        "deadline", "deadline_date", F.lit(True).alias("is_active"),
        classify.target_type(F.col("eligibility")).alias("target_type"),
        money.award(F.col("amount")).alias("max_award"))
    return rollups.by_type(classified, AS_OF)


@query("clean_amounts", f"""
WITH {sql.RAW} SELECT src_seq, {sql.clean_amount('amount')} AS amount_clean,
  {sql.award('amount')} AS award FROM raw""")
def clean_amounts(spark, data):
    c = F.col("amount")
    return _raw(spark, data).select(
        "src_seq", money.clean_amount(c).alias("amount_clean"), money.award(c).alias("award"))


@query("amount_ranges", f"""
WITH {sql.RAW} SELECT src_seq, {sql.low_award('amount')} AS min_award,
  {sql.high_award('amount')} AS max_award FROM raw""")
def amount_ranges(spark, data):
    limits = money.amount_range(F.col("amount"))
    return _raw(spark, data).select("src_seq", limits["min"].alias("min_award"),
                                    limits["max"].alias("max_award"))


@query("amount_max", f"""
WITH {sql.RAW} SELECT src_seq, list_max(list_transform(
  regexp_extract_all(amount, '\\$?([0-9,]+(?:\\.[0-9]{{2}})?)', 1),
  lambda r: try_cast(replace(r, ',', '') AS DOUBLE))) AS amount_max FROM raw""")
def amount_max(spark, data):
    return _raw(spark, data).select("src_seq",
                                    money.amount_max(F.col("amount")).alias("amount_max"))


@query("format_deadlines", f"""
WITH {sql.RAW} SELECT src_seq, {sql.format_deadline('deadline')} AS deadline_text FROM raw""")
def format_deadlines(spark, data):
    return _raw(spark, data).select(
        "src_seq", deadlines.format_deadline(F.col("deadline"), YEAR).alias("deadline_text"))


@query("parse_deadlines", f"""
WITH {sql.RAW}, {_DATED} SELECT src_seq, {sql.parse_deadline('dl')} AS deadline_date FROM dated""")
def parse_deadlines(spark, data):
    return fx.with_dates(_raw(spark, data)).select("src_seq", "deadline_date")


@query("expired_flags", f"""
WITH {sql.RAW}, {_DATED} SELECT src_seq, {sql.expired('dl')} AS end_of_day,
  {sql.expired('dl', 'instant')} AS instant, {sql.expired('dl', 'sql_view')} AS sql_view
FROM dated""")
def expired_flags(spark, data):
    dated = fx.with_dates(_raw(spark, data))
    return dated.select("src_seq", *[
        deadlines.is_expired(F.col("deadline"), AS_OF, mode).alias(mode)
        for mode in ("end_of_day", "instant", "sql_view")])


@query("expired_instant", f"""
WITH {sql.RAW}, {_DATED} SELECT src_seq, dl AS deadline FROM dated
WHERE NOT {sql.expired('dl', 'instant')}""")
def expired_instant(spark, data):
    """Rows that the instant rule keeps."""
    dated = fx.with_dates(_raw(spark, data))
    return filters.drop_expired(dated, AS_OF, "instant").select("src_seq", "deadline")


@query("active_listings", f"""
WITH {sql.LISTINGS} SELECT src_seq, listing_id, name, deadline, target_type, max_award
FROM listings WHERE is_active AND NOT ({sql.expired('deadline', 'sql_view')})""")
def active_listings(spark, data):
    return filters.active(fx.listings(spark, data), AS_OF).select(
        "src_seq", "listing_id", "name", "deadline", "target_type", "max_award")


@query("active_listings_simple", f"""
WITH {sql.LISTINGS} SELECT {', '.join(filters.ACTIVE_COLUMNS)} FROM listings WHERE is_active
ORDER BY created_at DESC, src_seq""")
def active_listings_simple(spark, data):
    return filters.active_simple(fx.listings(spark, data))


@query("target_types", f"""
WITH {sql.RAW} SELECT src_seq, {sql.target_label('eligibility')} AS label,
  {sql.target_type('eligibility')} AS tag FROM raw""")
def target_types(spark, data):
    c = F.col("eligibility")
    return _raw(spark, data).select("src_seq", classify.target_label(c).alias("label"),
                                    classify.target_type(c).alias("tag"))


@query("academic_levels", f"""
WITH {sql.RAW} SELECT src_seq, {sql.levels('eligibility')} AS tag FROM raw""")
def academic_levels(spark, data):
    return _raw(spark, data).select(
        "src_seq", classify.academic_levels(F.col("eligibility")).alias("tag"))


def _word_levels():
    parts = []
    for tag, (words, guards) in V.ACADEMIC_LEVELS.items():
        def has(terms):
            inner = "|".join(t.replace(".", "\\.") for t in terms)
            return f"regexp_matches(lower(eligibility), '\\b({inner})\\b')"
        test = has(words) + (f" AND NOT {has(guards)}" if guards else "")
        parts.append(f"CASE WHEN {test} THEN '{tag}' END")
    return f"concat_ws(', ', {', '.join(parts)})"


@query("academic_levels_by_word", f"""
WITH {sql.RAW} SELECT src_seq, {_word_levels()} AS tag FROM raw""")
def academic_levels_by_word(spark, data):
    """Whole words only, so that 'ma' does not make everything a masters award."""
    return _raw(spark, data).select(
        "src_seq", classify.academic_levels(F.col("eligibility"), match="word").alias("tag"))


@query("ethnicities", f"""
WITH {sql.RAW} SELECT src_seq, {sql.ethnicities('eligibility')} AS tag FROM raw""")
def ethnicities(spark, data):
    return _raw(spark, data).select(
        "src_seq", classify.ethnicities(F.col("eligibility")).alias("tag"))


@query("genders", f"""
WITH {sql.RAW} SELECT src_seq, {sql.gender('eligibility')} AS tag FROM raw""")
def genders(spark, data):
    return _raw(spark, data).select("src_seq", classify.gender(F.col("eligibility")).alias("tag"))


def _words(words):
    return [(w, [w]) for w in words]


@query("parse_eligibility", f"""
WITH {sql.RAW}, low AS (SELECT src_seq, lower(eligibility) AS e FROM raw)
SELECT src_seq, coalesce({sql.first_of('e', V.ELIGIBILITY_TARGETS)}, 'both') AS target_type,
  coalesce({sql.first_of('e', _words(V.ELIGIBILITY_ETHNICITIES))}, '') AS ethnicity,
  coalesce({sql.first_of('e', V.ELIGIBILITY_GENDERS)}, '') AS gender,
  coalesce({sql.first_of('e', _words(V.ELIGIBILITY_LEVELS))}, '') AS academic_level,
  {sql.any_of('e', V.ESSAY_WORDS)} AS essay_required,
  {sql.any_of('e', V.RECOMMENDATION_WORDS)} AS recommendations_required FROM low""")
def parse_eligibility(spark, data):
    return _raw(spark, data).select(
        "src_seq", classify.parse_eligibility(F.col("eligibility")).alias("e")) \
        .select("src_seq", "e.*")


@query("strip_phrases", f"""
WITH {sql.RAW} SELECT src_seq, {sql.strip_phrases('eligibility')} AS text FROM raw""")
def strip_phrases(spark, data):
    return _raw(spark, data).select("src_seq", tx.strip_phrases(F.col("eligibility")).alias("text"))


@query("truncate_text", f"""
SELECT doc_id, CASE WHEN length(text) > 1000
  THEN trim(substr(text, 1, 997), E' \\t\\n\\r') || '...' ELSE text END AS text FROM documents""")
def truncate_text(spark, data):
    return table(spark, data, "documents").select("doc_id", tx.truncate(F.col("text")).alias("text"))


@query("clean_text", f"""
SELECT p_partkey, {sql.clean_text("' ''' || p_name || '\", ' || p_type || '$ '")} AS no_quotes,
  trim(translate(' ''' || p_name || '", ' || p_type || '$ ', ',$', '')) AS no_commas_or_currency
FROM part""")
def clean_text(spark, data):
    raw = fx.concat(" '", F.col("p_name"), '", ', F.col("p_type"), "$ ")
    return table(spark, data, "part").select(
        "p_partkey", tx.clean_text(raw, quotes=True).alias("no_quotes"),
        tx.clean_text(raw, commas=True, currency=True).alias("no_commas_or_currency"))


@query("squeeze_text", """
WITH s AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, md5(t) AS whole, length(t) AS n,
  CASE WHEN length(t) > 500 THEN substr(t, 1, 497) || '...' ELSE t END AS text FROM s""")
def squeeze_text(spark, data):
    c = F.col("text")
    return (table(spark, data, "documents")
            .select("doc_id", tx.squeeze(c).alias("t"), tx.squeeze(c, 500).alias("text"))
            .select("doc_id", F.md5("t").alias("whole"),
                    F.length("t").cast("bigint").alias("n"), "text"))


@query("unwrap_quotes", """
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_name || ' x' WHEN 1 THEN p_name || ' x'
  WHEN 2 THEN '"' || p_name || ' x' ELSE '' END AS text FROM part""")
def unwrap_quotes(spark, data):
    name = fx.concat(F.col("p_name"), "  x")
    kind = F.col("p_size") % 4
    raw = (F.when(kind == 0, fx.concat('"', name, '"'))
           .when(kind == 1, fx.concat(" \"'", name, "'\" "))
           .when(kind == 2, fx.concat('"', name)).otherwise('"'))
    return table(spark, data, "part").select("p_partkey", tx.unwrap_quotes(raw).alias("text"))


@query("clip_lengths", """
SELECT doc_id, substr(text, 1, 200) AS name, substr(text, 1, 500) AS description,
  substr(text, 1, 50) AS academic_level, substr(text, 1, 500) AS eligibility FROM documents""")
def clip_lengths(spark, data):
    return table(spark, data, "documents").select(
        "doc_id", *[tx.clip(F.col("text"), n).alias(c) for c, n in V.CLIP_LENGTHS.items()])


@query("clean_levels", """
SELECT p_partkey, nullif(lower(trim(regexp_replace(regexp_replace(
    CASE WHEN p_size % 5 = 0 THEN ' STUDY ' ELSE 'Study  ' || p_type || ' study' END,
    '(?i)study', '', 'g'), '\\s+', ' ', 'g'))), '') AS level,
  CASE WHEN p_size % 5 = 0 THEN 'unspecified' ELSE p_type END AS filled FROM part""")
def clean_levels(spark, data):
    blank = F.col("p_size") % 5 == 0
    raw = F.when(blank, " STUDY ").otherwise(fx.concat("Study  ", F.col("p_type"), " study"))
    padded = F.when(blank, "   ").otherwise(fx.concat(" ", F.col("p_type"), " "))
    return table(spark, data, "part").select(
        "p_partkey", tx.clean_level(raw).alias("level"), tx.non_empty(padded).alias("filled"))


@query("renewable_flags", f"""
WITH {sql.RAW}, t AS (SELECT src_seq, lower(CASE status WHEN 'F' THEN 'Annual, 4 years'
  WHEN 'O' THEN 'Yes' ELSE 'TRUE' END) AS d FROM raw)
SELECT src_seq, {', '.join(f"{sql.any_of('d', w)} AS {r}_rule" for r, w in V.RENEWABLE_WORDS.items())}
FROM t""")
def renewable_flags(spark, data):
    duration = F.when(F.col("status") == "F", "Annual, 4 years") \
        .when(F.col("status") == "O", "Yes").otherwise("TRUE")
    return _raw(spark, data).select("src_seq", *[
        classify.is_renewable(duration, r).alias(f"{r}_rule") for r in V.RENEWABLE_WORDS])


@query("content_ids", f"""
WITH {sql.RAW} SELECT src_seq, {sql.listing_id()} AS listing_id,
  {sql.short_id('name', 'organization')} AS short_id,
  substr(md5(lower(name || '-fixed-org')), 1, 16) AS fixed_org_id,
  md5(name || '-undefined-' || deadline) AS missing_org_id FROM raw""")
def content_ids(spark, data):
    name, org, deadline = F.col("name"), F.col("organization"), F.col("deadline")
    return _raw(spark, data, organization=True).select(
        "src_seq", ids.listing_id(name, org, deadline).alias("listing_id"),
        ids.short_id(name, org).alias("short_id"),
        ids.content_id(name, F.lit("Fixed-Org"), length=16, lower=True).alias("fixed_org_id"),
        ids.content_id(name, F.lit(None).cast("string"), deadline).alias("missing_org_id"))


@query("url_hashes", f"""
SELECT page_id, {sql.url_hash('url')} AS url_hash FROM pages""")
def url_hashes(spark, data):
    return table(spark, data, "pages").select("page_id", ids.url_hash(F.col("url")).alias("url_hash"))


@query("archive_keys", f"""
WITH {sql.FETCHED} SELECT page_id, scraper || strftime(fetched_at, '/%Y/%m/%d/') ||
  strftime(fetched_at, '%Y-%m-%dT%H-%M-%S') || '-000Z-' || {sql.url_hash('url')} || '.html' AS key
FROM fetched""")
def archive_keys(spark, data):
    return fx.fetched_pages(spark, data).select(
        "page_id", ids.archive_key(F.col("scraper"), F.col("url"), F.col("fetched_at")).alias("key"))


_KINDS = {"name": "text", "deadline": "text", "eligibility": "text", "organization": "text",
          "url": "text", "gender": "text", "max_award": "number"}


@query("default_fill", f"""
WITH {sql.RAW}, picked AS (SELECT src_seq, name, deadline, eligibility, organization, url,
  {sql.gender('eligibility')} AS gender, {sql.award('amount')} AS max_award FROM raw)
{' UNION ALL '.join(
    f"SELECT src_seq, '{p}' AS profile, {sql.defaults(p, _KINDS)} "
    f"{'' if p != 'curate' else ', NULL AS source'} FROM picked"
    for p in ('curate', 'migrate_bulk', 'migrate_items'))}""")
def default_fill(spark, data):
    """The three default profiles over the same rows, most columns absent."""
    some = fx.listings_raw(spark, data).select(
        "src_seq", "name", "deadline", "eligibility", "organization", "url",
        classify.gender(F.col("eligibility")).alias("gender"),
        money.award(F.col("amount")).alias("max_award"))
    types = {f.name: f.dataType for f in LISTING.fields}
    parts = []
    for profile in ("curate", "migrate_bulk", "migrate_items"):
        filled = filters.fill_defaults(some, profile).withColumn("profile", F.lit(profile))
        parts.append(filled.withColumns({
            c: F.col(c).cast("double" if c.endswith("_award") else types[c])
            for c in filled.columns if c in types}))
    return union_sources(parts)


@query("rename_fields", f"""
WITH {sql.RAW} SELECT src_seq, name, eligibility AS academic_level, url AS apply_url,
  {sql.award('amount')} AS max_award, organization AS "customField" FROM raw""")
def rename_fields(spark, data):
    camel = fx.listings_raw(spark, data).select(
        "src_seq", "name", F.col("eligibility").alias("academicLevel"),
        F.col("url").alias("applyUrl"), money.award(F.col("amount")).alias("maxAward"),
        F.col("organization").alias("customField"))
    return filters.rename_fields(camel)


@query("export_json", f"""
WITH {sql.RAW} SELECT src_seq, '{{"src_seq":' || src_seq || ',"name":"' || name || '"' ||
  CASE WHEN organization <> '' THEN ',"organization":"' || organization || '"' ELSE '' END ||
  ',"created_at":"' || strftime(created_at, '%Y-%m-%dT%H:%M:%S') || '"}}' AS json FROM raw""")
def export_json(spark, data):
    rows = fx.listings_raw(spark, data).select(
        "src_seq", "name", F.nullif("organization", F.lit("")).alias("organization"), "created_at")
    return filters.export_json(rows, "src_seq")


@query("import_json", f"""
WITH {sql.RAW} SELECT src_seq, name, nullif(organization, '') AS organization, created_at
FROM raw""")
def import_json(spark, data):
    """Export and back."""
    rows = fx.listings_raw(spark, data).select(
        "src_seq", "name", F.nullif("organization", F.lit("")).alias("organization"), "created_at")
    return filters.import_json(filters.export_json(rows), rows.schema)


@query("contract_violations", f"""
WITH {sql.LISTINGS}, l AS (SELECT *, CAST(NULL AS VARCHAR) AS job_id FROM listings)
{' UNION ALL '.join(
    [f"SELECT '{c}_missing' AS rule, count(*) FILTER (WHERE {c} IS NULL) AS violations FROM l"
     for c in ('listing_id', 'name')]
    + ["SELECT 'target_type_unknown', count(*) FILTER (WHERE target_type NOT IN "
       "('need', 'merit', 'both')) FROM l"]
    + [f"SELECT '{c}_too_long', count(*) FILTER (WHERE length({c}) > {n}) FROM l"
       for c, n in V.MAX_LENGTHS.items()]
    + ["SELECT 'listing_id_repeated', count(*) FROM (SELECT listing_id FROM l GROUP BY 1 "
       "HAVING count(*) > 1)"])}""")
def contract_violations(spark, data):
    rows = fx.listings(spark, data).withColumn("job_id", F.lit(None).cast("string"))
    return quality.violations(rows, quality.listing_rules(), "listing_id")


@query("contract_quarantine", f"""
WITH {sql.LISTINGS} SELECT src_seq, academic_level FROM listings
WHERE length(academic_level) > 20""")
def contract_quarantine(spark, data):
    """Rows that break a row rule, here a tight length for the level tags."""
    rules = {"academic_level_too_long": F.length("academic_level") > 20}
    _, bad = quality.split_by_contract(fx.listings(spark, data), rules)
    return bad.select("src_seq", "academic_level")


def _odd_rows(spark, data):
    """Sites, jobs and applications of which some break their rules, and the listings that applications name."""
    sites = fx.sites(spark, data).withColumn("type", F.when(F.col("site").endswith("7"), "feed").when(
        ~F.col("site").endswith("3"), F.col("type")))
    jobs = fx.job_events(spark, data).select("event_id", "job_id", F.when(
        F.col("event_id") % 10 == 0, "lost").otherwise(F.col("status")).alias("status"))
    named = fx.applications(spark, data).withColumn("user_id", F.when(F.col("id") % 13 != 0, F.col("user_id")))
    listings = fx.listings(spark, data).filter("is_active")
    return sites, jobs, quality.reference(named, "listing_id", listings, "listing_id", "unknown_listing")


@query("contract_all_tables", f"""
WITH {sql.LISTINGS}, {sql.JOB_EVENTS}, site AS (SELECT s_name AS site, CASE WHEN s_name LIKE '%7' THEN 'feed' WHEN s_name NOT LIKE '%3'
  THEN (['api', 'crawl', 'search', 'discovery'])[s_nationkey % 4 + 1] END AS type FROM supplier),
job AS (SELECT CASE WHEN event_id % 10 = 0 THEN 'lost' ELSE status END AS status FROM job_events),
app AS (SELECT src_seq AS id, CASE WHEN src_seq % 13 <> 0 THEN 1 END AS user_id, listing_id NOT IN
  (SELECT listing_id FROM listings WHERE is_active) AS unknown FROM listings)
SELECT 'site' AS entity, 'rows' AS rule, count(*) AS n FROM site
UNION ALL SELECT 'site', 'broken', count(*) FILTER (WHERE type IS NULL OR type = 'feed') FROM site
UNION ALL SELECT 'site', 'type_missing', count(*) FILTER (WHERE type IS NULL) FROM site
UNION ALL SELECT 'site', 'type_unknown', count(*) FILTER (WHERE type = 'feed') FROM site
UNION ALL SELECT 'job', 'rows', count(*) FROM job
UNION ALL SELECT 'job', 'broken', count(*) FILTER (WHERE status = 'lost') FROM job
UNION ALL SELECT 'job', 'status_unknown', count(*) FILTER (WHERE status = 'lost') FROM job
UNION ALL SELECT 'application', 'rows', count(*) FROM app
UNION ALL SELECT 'application', 'broken', count(*) FILTER (WHERE user_id IS NULL OR unknown) FROM app
UNION ALL SELECT 'application', 'user_id_missing', count(*) FILTER (WHERE user_id IS NULL) FROM app
UNION ALL SELECT 'application', 'listing_id_unknown', count(*) FILTER (WHERE unknown) FROM app""")
def contract_all_tables(spark, data):
    """Broken rules of sites, jobs and applications, counted while their rows are written."""
    sites, jobs, applications = _odd_rows(spark, data)
    listed = quality.application_rules() | {"listing_id_unknown": F.col("unknown_listing")}
    counts = []
    for entity, rows, rules in (("site", sites, quality.site_rules()), ("job", jobs, quality.job_rules()),
                                ("application", applications, listed)):
        found = quality.store_checked(rows, rules, scratch_dir(spark, f"checked-{entity}") + "/rows")
        counts += [(entity, rule, n) for rule, n in found.items() if n]
    return spark.createDataFrame(counts, "entity string, rule string, n bigint")


@query("broken_applications", f"""
WITH {sql.LISTINGS}, app AS (SELECT src_seq AS id, src_seq % 13 = 0 AS anonymous, listing_id NOT IN
  (SELECT listing_id FROM listings WHERE is_active) AS unknown FROM listings)
SELECT id, concat_ws(',', CASE WHEN anonymous THEN 'user_id_missing' END, CASE WHEN unknown THEN 'listing_id_unknown' END) AS broken
FROM app WHERE anonymous OR unknown""")
def broken_applications(spark, data):
    """Applications set aside when they were written, each with the rules it breaks."""
    rows = _odd_rows(spark, data)[2]
    path = scratch_dir(spark, "checked") + "/rows"
    quality.store_checked(rows, quality.application_rules() | {"listing_id_unknown": F.col("unknown_listing")}, path)
    return quality.read_checked(rows, path)[1].select("id", F.array_join("broken", ",").alias("broken"))


@query("award_bounds", f"""
WITH {sql.RAW}, a AS (SELECT src_seq, {sql.award('amount')} AS max_award FROM raw)
SELECT *, max_award BETWEEN 100 AND 100000 AS in_bounds FROM a""")
def award_bounds(spark, data):
    return quality.award_bounds(_raw(spark, data).select(
        "src_seq", money.award(F.col("amount")).alias("max_award")))


@query("excluded_titles", f"""
WITH {sql.RAW}, t AS (SELECT src_seq,
  CASE WHEN status = 'P' THEN 'Loan' ELSE 'Scholarship' END AS award_type,
  CASE WHEN user_id % 5 = 0 THEN 'Award Name' WHEN user_id % 5 = 1 THEN ''
    WHEN user_id % 5 = 2 THEN 'Find Scholarships here' ELSE name END AS name FROM raw)
SELECT * FROM t WHERE contains(lower(award_type), 'scholarship') AND name <> ''
  AND name <> 'Award Name' AND NOT contains(name, 'Find Scholarships')""")
def excluded_titles(spark, data):
    kind = F.col("user_id") % 5
    rows = _raw(spark, data).select(
        "src_seq", F.when(F.col("status") == "P", "Loan").otherwise("Scholarship")
        .alias("award_type"),
        F.when(kind == 0, "Award Name").when(kind == 1, "")
        .when(kind == 2, "Find Scholarships here").otherwise(F.col("name")).alias("name"))
    return filters.exclude_rows(rows)
