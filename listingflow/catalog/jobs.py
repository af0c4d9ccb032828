"""Queries that are whole jobs, batch and incremental."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from listingflow.catalog import fixtures as fx, oracle as sql, payloads  # noqa: F401 (its SQL is used)
from listingflow.catalog.core import AS_OF, ORACLE, YEAR, query, table
from listingflow.operators import rollups
from listingflow.operators.dedupe import dedupe_first
from listingflow.plans import curate as jobs
from listingflow.schema import CRAWL_RESULT
from listingflow.session import scratch_dir
from listingflow.sources import feeds, pages
from listingflow.sources.feeds import crawl_items
from listingflow.sources.tables import Registry, read_export
from listingflow.sources.versioned import VersionedTable
from listingflow.streaming import jobs as stream

_FIRSTS = f"""{sql.LISTINGS}, target AS ({sql.first_row(
    "(SELECT * FROM listings WHERE created_at < TIMESTAMP '1997-01-01')", 'listing_id')})"""
_CURATED = f"""{_FIRSTS}, kept AS (SELECT * FROM listings WHERE NOT {sql.expired('deadline')}),
grouped AS (SELECT listing_id, min(src_seq) AS src_seq, count(*) AS n FROM kept GROUP BY 1)"""


def _target(spark, data):
    rows = fx.listings(spark, data)
    old = rows.filter(F.col("created_at") < F.lit("1997-01-01").cast("timestamp_ntz"))
    return dedupe_first(old, ["listing_id"], [F.col("src_seq")])


@query("curate_batch", f"""
WITH {_CURATED} SELECT g.listing_id, g.src_seq, k.name, coalesce(k.gender, 'unspecified') AS gender,
  CAST(k.max_award AS DOUBLE) AS max_award,
  CASE WHEN t.listing_id IS NULL THEN 1 ELSE 0 END AS inserted,
  n - CASE WHEN t.listing_id IS NULL THEN 1 ELSE 0 END AS updated
FROM grouped g JOIN kept k USING (src_seq) LEFT JOIN target t ON t.listing_id = g.listing_id""")
def curate_batch(spark, data):
    curated = jobs.curate(fx.listings(spark, data), _target(spark, data), AS_OF, "job-1")
    return curated.select("listing_id", "src_seq", "name", "gender", "max_award", "inserted",
                          "updated")


@query("curate_counts", f"""
WITH {_CURATED} SELECT 'job-1' AS job_id, CAST(sum(n) AS BIGINT) AS processed,
  count(*) FILTER (WHERE t.listing_id IS NULL) AS inserted,
  CAST(sum(n) AS BIGINT) - count(*) FILTER (WHERE t.listing_id IS NULL) AS updated
FROM grouped g LEFT JOIN target t USING (listing_id)""")
def curate_counts(spark, data):
    return jobs.curate_metrics(
        jobs.curate(fx.listings(spark, data), _target(spark, data), AS_OF, "job-1"))


def _export(spark, data):
    """Listings written as JSON lines in the export's spelling, and read back."""
    rows = fx.listings(spark, data)
    items = rows.select(
        F.concat("listing_id", F.lit("-"), F.col("src_seq").cast("string")).alias("id"),
        F.when(F.col("is_active"), F.col("name")).alias("name"), F.col("name").alias("title"),
        F.nullif("deadline", F.lit("")).alias("deadline"), "url", "eligibility",
        F.nullif("organization", F.lit("")).alias("organization"),
        F.col("academic_level").alias("academicLevel"), F.col("target_type").alias("targetType"),
        F.nullif("ethnicity", F.lit("")).alias("ethnicity"), "gender",
        F.col("max_award").alias("maxAward"), F.col("is_active").alias("isActive"), "source",
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("createdAt"),
        F.col("src_seq").alias("srcSeq"))
    path = scratch_dir(spark, "export") + "/items"
    items.write.json(path)
    return read_export(spark, path)


_EXPORT_ID = "listing_id || '-' || src_seq"


@query("export_items", f"""
WITH {sql.LISTINGS} SELECT {_EXPORT_ID} AS listing_id, name, nullif(deadline, '') AS deadline,
  nullif(organization, '') AS organization, academic_level, target_type, max_award, is_active,
  created_at, src_seq FROM listings""")
def export_items(spark, data):
    return _export(spark, data).select(
        "listing_id", "name", "deadline", "organization", "academic_level", "target_type",
        "max_award", "is_active", "created_at", "src_seq")


_OLD = f"""{sql.LISTINGS}, export AS (SELECT * REPLACE ({_EXPORT_ID} AS listing_id) FROM listings),
target AS (SELECT listing_id FROM export WHERE created_at < TIMESTAMP '1996-01-01')"""


def _known(export):
    return export.filter(F.col("created_at") < F.lit("1996-01-01").cast("timestamp_ntz")) \
        .select("listing_id")


@query("migrate_export", f"""
WITH {_OLD} SELECT listing_id, name, nullif(deadline, '') AS deadline, target_type,
  coalesce(nullif(ethnicity, ''), 'unspecified') AS ethnicity,
  coalesce(gender, 'unspecified') AS gender, max_award, is_active, false AS renewable,
  'US' AS country FROM export WHERE listing_id NOT IN (SELECT listing_id FROM target)
  AND NOT {sql.expired('deadline')}""")
def migrate_export(spark, data):
    export = _export(spark, data)
    return jobs.migrate(export, _known(export), AS_OF).select(
        "listing_id", "name", "deadline", "target_type", "ethnicity", "gender", "max_award",
        "is_active", "renewable", "country")


@query("migration_summary", f"""
WITH {_OLD}, f AS (SELECT t.listing_id IS NULL AND NOT {sql.expired('deadline')} AS taken
  FROM export LEFT JOIN target t USING (listing_id))
SELECT count(*) AS scanned, count(*) FILTER (WHERE taken) AS migrated,
  count(*) FILTER (WHERE NOT taken) AS skipped FROM f""")
def migration_summary(spark, data):
    export = _export(spark, data)
    return jobs.migration_summary(export, _known(export), AS_OF)


@query("migrate_job", f"""
WITH {_OLD}, {sql.SITES}, {sql.JOB_EVENTS}, taken AS (SELECT e.is_active FROM export e LEFT JOIN target t USING (listing_id)
  WHERE t.listing_id IS NULL AND NOT {sql.expired('deadline')}),
held AS (SELECT is_active FROM export WHERE created_at < TIMESTAMP '1996-01-01')
SELECT 'scanned' AS figure, count(*) AS n FROM export UNION ALL SELECT 'migrated', count(*) FROM taken
UNION ALL SELECT 'skipped', (SELECT count(*) FROM export) - count(*) FROM taken
UNION ALL SELECT 'listings', count(*) FROM (SELECT * FROM taken UNION ALL SELECT * FROM held)
UNION ALL SELECT 'active_listings', count(*) FILTER (WHERE is_active) FROM (SELECT * FROM taken UNION ALL SELECT * FROM held)
UNION ALL SELECT 'sites', count(*) FROM sites UNION ALL SELECT 'jobs', count(DISTINCT job_id) FROM job_events""")
def migrate_job(spark, data):
    """The migration of an export into a table that holds its older rows, and the totals after it."""
    export = _export(spark, data)
    held = export.filter(F.col("created_at") < F.lit("1996-01-01").cast("timestamp_ntz"))
    runs = fx.job_events(spark, data).select("job_id").distinct()
    return jobs.migrate_into(held, export, AS_OF, fx.sites(spark, data), runs)[1]


_CLEANUP = f"""{sql.LISTINGS}, flagged AS (SELECT src_seq, deadline,
  {sql.expired('deadline')} AS expired FROM listings)"""


def _cleaned(spark, data):
    """A table of listings in four parts and the report of its cleanup.

    A part was written by an older job with another type of amount, so it can be counted but not rewritten.
    """
    path = scratch_dir(spark, "cleanup") + "/listings"
    rows = fx.listings_raw(spark, data, organization=False).select(
        "src_seq", "deadline", "amount", (F.col("src_seq") % 4).cast("int").alias("part"))
    columns = "src_seq bigint, deadline string, amount {}, part int"
    older, table = (VersionedTable(spark, path, T.StructType.fromDDL(columns.format(kind)), ["part"]) for kind in ("int", "string"))
    table.put(rows.filter("part <> 3").hint("rebalance", "part"))
    older.add(rows.filter("part = 3").withColumn("amount", F.lit(1)))
    return table, jobs.cleanup_table(table, AS_OF)


@query("cleanup_expired", f"""
WITH {_CLEANUP} SELECT src_seq, deadline FROM flagged WHERE NOT expired OR src_seq % 4 = 3""")
def cleanup_expired(spark, data):
    """The table that is left: expired rows are there only where their part could not be rewritten."""
    return _cleaned(spark, data)[0].read().select("src_seq", "deadline")


@query("cleanup_summary", f"""
WITH {_CLEANUP} SELECT count(*) AS scanned, count(*) FILTER (WHERE expired) AS expired,
  count(*) FILTER (WHERE expired AND src_seq % 4 <> 3) AS deleted,
  count(*) FILTER (WHERE expired AND src_seq % 4 = 3) AS failed FROM flagged""")
def cleanup_summary(spark, data):
    return rollups.cleanup_summary(_cleaned(spark, data)[1])


@query("crawl_items", """
WITH p AS (SELECT 'crawl-' || regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) || '-' ||
  (page_id // 50) AS crawl, page_id, url, html FROM pages)
SELECT crawl, CAST(row_number() OVER (PARTITION BY crawl ORDER BY page_id) - 1 AS INT) AS pos, url,
  md5(html) AS digest, 200 AS status_code FROM p""")
def crawl_results(spark, data):
    """Pages written as nested crawl jobs and read back with an explicit schema.

    A job covers a host within a range of 50 page numbers, so that a host with
    much of the table makes many jobs of bounded size.
    """
    page = F.struct(
        "url", F.lit("t").alias("title"), F.col("html").alias("content"),
        F.array("url").alias("links"), F.lit("2024-01-01T00:00:00Z").alias("timestamp"),
        F.struct(F.lit(200).alias("statusCode"), F.lit(0.5).alias("loadTime"),
                 F.length("html").alias("wordCount")).alias("metadata"))
    host = F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)
    part = fx.text(F.floor(F.col("page_id") / 50))
    crawls = (table(spark, data, "pages")
              .groupBy(fx.concat("crawl-", host, "-", part).alias("crawl"))
              .agg(F.array_sort(F.collect_list(F.struct("page_id", page.alias("p")))).alias("r"))
              .select("crawl", F.col("r.p").alias("results")))
    path = scratch_dir(spark, "crawl") + "/jobs"
    crawls.write.json(path)
    schema = f"crawl string, results array<{CRAWL_RESULT.simpleString()}>"
    rows = crawl_items(spark.read.schema(schema).json(path), "crawl")
    return rows.select("crawl", "pos", "url", F.md5("content").alias("digest"),
                       F.col("metadata.statusCode").alias("status_code"))


# --- the registry ------------------------------------------------------------------------------------

def _orders_with(status):
    def read(spark, data):
        rows = fx.listings_raw(spark, data).filter(F.col("status") == status)
        return rows.select("name", "organization", "deadline", "url", "eligibility", "src_seq")
    return read


def _failing(spark, data):
    return table(spark, data, "no_such_table")


def registry() -> Registry:
    """The sources of these queries: one per order status, one that cannot be read."""
    out = Registry()
    out.register("open", _orders_with("O"), aliases=["o", "open_python"])
    out.register("filled", _orders_with("F"))
    out.register("partial", _orders_with("P"))
    out.register("broken", _failing)
    return out


@query("union_sources", f"""
WITH {sql.RAW} SELECT CASE status WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE 'partial' END
  AS source, src_seq, name, organization FROM raw""")
def union_sources(spark, data):
    rows, _ = jobs.run_all(spark, registry(), data)
    return rows.select("source", "src_seq", "name", "organization")


@query("run_all_sources", f"""
WITH {sql.RAW} SELECT CASE status WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE 'partial' END
  AS source, 'completed' AS status, count(*) AS n FROM raw GROUP BY 1
UNION ALL SELECT 'broken', 'failed', 0 UNION ALL SELECT 'unheard', 'failed', 0""")
def run_all_sources(spark, data):
    """Rows per source, asked for by alias twice; two sources fail, the others go on."""
    asked = ["open", "o", "filled", "partial", "broken", "unheard"]
    rows, failures = jobs.run_all(spark, registry(), data, asked)
    counts = rows.groupBy("source").agg(F.lit("completed").alias("status"),
                                        F.count("*").alias("n"))
    failed = spark.createDataFrame([(n, "failed", 0) for n in failures], counts.schema)
    return counts.unionAll(failed)


# --- from pages and payloads to the table ----------------------------------------------------------

def _corrupt(spark, data):
    """Fails only when its rows are read: the stored addresses are no lists."""
    return spark.read.schema("url array<string>").parquet(f"{data}/pages.parquet")


def readers() -> Registry:
    """Listings out of table rows, feeds and API payloads, and a source that breaks while it is read."""
    out = Registry()

    def add(name, place, read):
        def numbered(spark, data):
            at = (F.col("page_id") * 1000 + F.col("pos")) * 10 + place
            return read(spark, data).withColumn("src_seq", at)
        out.register(name, numbered)

    add("rows", 0, lambda spark, data: pages.extract_rows(
        fx.row_pages(spark, data), "https://awards.example.org", YEAR, "the awards database"))
    add("feeds", 1, lambda spark, data: feeds.read_feed(fx.feed_payloads(spark, data), "page_id"))
    add("apis", 2, lambda spark, data: feeds.read_api(fx.api_payloads(spark, data), "page_id"))
    out.register("corrupt", _corrupt)
    return out


_INGESTED = f"""{_FIRSTS}, row_items AS ({ORACLE['row_listings']}), feed_items AS ({ORACLE['rss_items']}),
api AS ({ORACLE['api_items']}),
got AS (SELECT 'rows' AS source, (page_id * 1000 + pos) * 10 AS src_seq, name, organization, deadline FROM row_items
  UNION ALL SELECT 'feeds', (page_id * 1000 + pos) * 10 + 1, name, organization, NULL FROM feed_items
  UNION ALL SELECT 'apis', (page_id * 1000 + pos) * 10 + 2, name, organization, NULL FROM api),
named AS (SELECT *, md5(name || '-' || coalesce(organization, 'undefined') || '-' ||
    coalesce(deadline, 'undefined')) AS listing_id FROM got
  WHERE coalesce(NOT {sql.expired('deadline')}, true)),
found AS (SELECT listing_id, min(src_seq) AS src_seq, min_by(name, src_seq) AS name,
  min_by(source, src_seq) AS source, count(*) AS n FROM named GROUP BY 1)"""


@query("ingest_all", f"""
WITH {_INGESTED} SELECT f.listing_id, f.name, f.source, f.src_seq,
  CASE WHEN t.listing_id IS NULL THEN 'insert' ELSE 'update' END AS action
FROM found f LEFT JOIN target t USING (listing_id)
UNION ALL SELECT listing_id, name, source, src_seq, 'keep' FROM target
WHERE listing_id NOT IN (SELECT listing_id FROM found)""")
def ingest_all(spark, data):
    """Pages, feeds and API payloads read, curated and upserted."""
    merged, _ = jobs.ingest(spark, readers(), data, _target(spark, data), AS_OF, "job-1")
    return merged.select("listing_id", "name", "source", "src_seq", "action")


@query("ingest_counts", f"""
WITH {_INGESTED} SELECT f.source, 'completed' AS status,
  count(*) FILTER (WHERE t.listing_id IS NULL) AS inserted,
  CAST(sum(n) AS BIGINT) - count(*) FILTER (WHERE t.listing_id IS NULL) AS updated
FROM found f LEFT JOIN target t USING (listing_id) GROUP BY 1
UNION ALL SELECT 'corrupt', 'failed', 0, 0""")
def ingest_counts(spark, data):
    """What each source added; one fails while it is read and the others go on."""
    return jobs.ingest(spark, readers(), data, _target(spark, data), AS_OF, "job-1")[1]


# --- incremental jobs -----------------------------------------------------------------------------------

def _run(started):
    started.awaitTermination()
    if started.exception():
        raise started.exception()


def _order_stream(spark, data):
    """New files of the table's own path, one file or a folder of parts."""
    return stream.read_new(spark, f"{data}/orders.parquet", table(spark, data, "orders").schema)


def _keyed(orders, award):
    """Orders as listings with their key."""
    return orders.select(
        F.md5(F.concat_ws("-", F.col("o_custkey").cast("string"), "o_orderpriority"))
        .alias("listing_id"),
        F.concat(F.lit("Award "), F.col("o_custkey").cast("string")).alias("name"),
        F.floor(award).cast("double").alias("max_award"),
        F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("src_seq"))


def _listing_stream(spark, data):
    """New orders as listings."""
    return _keyed(_order_stream(spark, data), F.col("o_totalprice"))


_STREAM_ID = "md5(o_custkey || '-' || o_orderpriority)"


@query("stream_ingest", """
SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders""")
def stream_ingest(spark, data):
    work = scratch_dir(spark, "ingest")
    columns = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"]
    _run(stream.ingest(_order_stream(spark, data).select(*columns), f"{work}/out",
                       f"{work}/checkpoint"))
    return spark.read.parquet(f"{work}/out").select(*columns)


@query("stream_ingest_json", """
WITH lines AS (SELECT o_orderkey, '{"o_orderkey":' || o_orderkey || ',"o_custkey":' || CASE WHEN o_orderkey % 17 = 3
  THEN '"none"' ELSE o_custkey::varchar END || CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE '}' END AS line FROM orders)
SELECT CASE WHEN sound THEN o.o_orderkey END AS o_orderkey, CASE WHEN sound THEN o_custkey END AS o_custkey,
  CASE WHEN NOT sound THEN line END AS line FROM (SELECT *, o_orderkey % 17 <> 3 AND o_orderkey % 13 <> 0 AS sound FROM lines) l
JOIN orders o ON o.o_orderkey = l.o_orderkey""")
def stream_ingest_json(spark, data):
    """Orders as JSON lines, some cut off and some of another type: all rows, and the lines that are none."""
    work = scratch_dir(spark, "json")
    customer = F.when(F.col("o_orderkey") % 17 == 3, '"none"').otherwise(fx.text(F.col("o_custkey")))
    end = F.when(F.col("o_orderkey") % 13 == 0, "").otherwise("}")
    table(spark, data, "orders").select(fx.concat(
        '{"o_orderkey":', fx.text(F.col("o_orderkey")), ',"o_custkey":', customer, end).alias("line")).write.text(f"{work}/in")
    schema = T.StructType.fromDDL("o_orderkey bigint, o_custkey bigint")
    _run(stream.ingest_json(spark, f"{work}/in", schema, f"{work}/out", f"{work}/checkpoint"))
    sound, broken = stream.read_json_ingest(spark, f"{work}/out", schema)
    return sound.withColumn("line", F.lit(None).cast("string")).unionByName(broken, allowMissingColumns=True)


@query("stream_dedupe", f"""
WITH RECURSIVE seen AS (SELECT DISTINCT {_STREAM_ID} AS listing_id, o_orderdate AS seen_at FROM orders),
kept AS (SELECT listing_id, min(seen_at) AS seen_at FROM seen GROUP BY 1
  UNION ALL SELECT s.listing_id, min(s.seen_at) FROM kept k JOIN seen s
  ON s.listing_id = k.listing_id AND s.seen_at > k.seen_at + INTERVAL 30 DAY GROUP BY s.listing_id, k.seen_at)
SELECT listing_id, seen_at FROM kept""")
def stream_dedupe(spark, data):
    """Sightings kept by the 30-day dedupe."""
    work = scratch_dir(spark, "dedupe")
    rows = _listing_stream(spark, data)
    _run(stream.sighting_sink(rows, f"{work}/out", f"{work}/checkpoint", ["listing_id"], "created_at"))
    kept = stream.first_sightings(spark, f"{work}/out", rows.schema, ["listing_id"])
    return kept.withColumn("seen_at", F.col("seen_at").cast("timestamp_ntz"))


@query("stream_upsert", f"""
SELECT {_STREAM_ID} AS listing_id, 'Award ' || arg_max(o_custkey, o_orderkey) AS name,
  floor(arg_max(o_totalprice, o_orderkey)) AS max_award, max(o_orderkey) AS src_seq,
  min(o_orderdate) AS created_at, arg_max(o_orderdate, o_orderkey) AS updated_at FROM orders GROUP BY 1""")
def stream_upsert(spark, data):
    work = scratch_dir(spark, "upsert")
    rows = _listing_stream(spark, data)
    _run(stream.upsert_sink(rows, f"{work}/out", f"{work}/checkpoint", "listing_id"))
    return stream.current(spark, f"{work}/out", rows.schema).select(
        "listing_id", "name", "max_award", "src_seq", "created_at", "updated_at")


@query("stream_upsert_counts", f"""
WITH rows AS (SELECT {_STREAM_ID} AS id, o_orderkey AS seq, floor(o_totalprice / 100000) AS award, o_orderdate AS day FROM orders),
held AS (SELECT id, max(seq) AS seq, arg_max(award, seq) AS award FROM rows WHERE day < TIMESTAMP '1996-01-01' GROUP BY 1),
batch AS (SELECT id, max(seq) AS seq, arg_max(award, seq) AS award, count(*) AS n FROM rows
  WHERE day >= TIMESTAMP '1996-01-01' GROUP BY 1),
acted AS (SELECT n, CASE WHEN h.id IS NULL THEN 'insert' WHEN b.seq <= h.seq THEN 'stale'
  WHEN b.award = h.award THEN 'unchanged' ELSE 'update' END AS action FROM batch b LEFT JOIN held h USING (id))
SELECT action, count(*) AS n FROM acted GROUP BY 1 UNION ALL SELECT 'rows', CAST(sum(n) AS BIGINT) FROM acted""")
def stream_upsert_counts(spark, data):
    """What the manifest says that a batch did to a table that held the older orders; the batch runs twice, and counts once."""
    rows = _keyed(table(spark, data, "orders"), F.col("o_totalprice") / 100000)
    old = F.col("created_at") < F.lit("1996-01-01").cast("timestamp_ntz")
    held = stream.upsert_table(spark, scratch_dir(spark, "upsert") + "/table", rows.schema)
    stream.upsert_rows(held, rows.filter(old), "listing_id", 0, "load")
    for _ in range(2):
        stream.upsert_rows(held, rows.filter(~old), "listing_id", 0, "batch")
    counts = [(action, n) for action, n in held.version().counts.items() if n]
    return spark.createDataFrame(counts, "action string, n bigint")


def _event_stream(spark, data):
    """Job events off the events file, by the same rules as the batch table."""
    raw = stream.read_new(spark, f"{data}/events.parquet", table(spark, data, "events").schema)
    return fx.job_events_from(raw).withColumn("event_ts", F.col("event_ts").cast("timestamp"))


@query("hourly_job_metrics", f"""
WITH {sql.JOB_EVENTS} SELECT date_trunc('hour', event_ts) AS hour, count(*) AS events,
  {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in rollups.COUNTERS)}
FROM job_events GROUP BY 1""")
def hourly_job_metrics(spark, data):
    work = scratch_dir(spark, "hourly")
    _run(stream.hourly_sink(_event_stream(spark, data), f"{work}/out", f"{work}/checkpoint", rollups.COUNTERS))
    rows = stream.hourly_metrics(spark, f"{work}/out", rollups.COUNTERS)
    return rows.withColumn("hour", F.col("hour").cast("timestamp_ntz"))


_JOB_STATE = f"""WITH {sql.JOB_EVENTS}, last AS (SELECT job_id, arg_max(status, (event_ts, event_id)) AS status,
  max(event_ts) AS event_ts FROM job_events GROUP BY 1)"""


@query("stream_job_state", f"{_JOB_STATE} SELECT job_id, status, event_ts FROM last")
def stream_job_state(spark, data):
    work = scratch_dir(spark, "state")
    events = _event_stream(spark, data)
    _run(stream.state_sink(events, f"{work}/out", f"{work}/checkpoint"))
    rows = stream.job_state(spark, f"{work}/out", events.schema["job_id"].dataType.simpleString())
    return rows.select("job_id", "status", F.col("event_ts").cast("timestamp_ntz").alias("event_ts"))


@query("job_state_expiry", f"""{_JOB_STATE} SELECT job_id, status, event_ts, status IN ('completed', 'failed')
  AND event_ts < TIMESTAMP '2024-01-31' - INTERVAL 10 DAY AS expired FROM last""")
def job_state_expiry(spark, data):
    """The state of all jobs after those that ended long ago have left it."""
    work = scratch_dir(spark, "state")
    events = _event_stream(spark, data)
    kind = events.schema["job_id"].dataType.simpleString()
    _run(stream.state_sink(events, f"{work}/out", f"{work}/checkpoint"))
    stream.expire_jobs(spark, f"{work}/out", "2024-01-31", "10 days", kind)
    rows = stream.job_state(spark, f"{work}/out", kind)
    return rows.withColumn("event_ts", F.col("event_ts").cast("timestamp_ntz"))
