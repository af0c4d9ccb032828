"""Properties of operators, hot keys, and the plans they compile to."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from listingflow.operators import dedupe, filters, merge, quality, rollups, search
from listingflow.operators.search_index import PostingIndex
from listingflow.session import scratch_dir, scratch_scope, stored
from listingflow.sources import archive, markup, pages, tables
from listingflow import catalog
from listingflow.catalog import fixtures
from listingflow.plans import curate as curate_plans
from listingflow.plans.curate import cleanup_table, curate
from listingflow.sources import feeds
from listingflow.sources.versioned import VersionedTable
from listingflow.streaming import jobs as stream


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def hot(spark):
    """Rows of which a third share one key."""
    rng = random.Random(7)
    rows = [(i, "hot" if rng.random() < 0.34 else f"k{rng.randrange(40)}", rng.random())
            for i in rng.sample(range(10_000), 3000)]
    return spark.createDataFrame(rows, "seq bigint, key string, v double").repartition(8), rows


def test_dedupe_first_keeps_least_order(hot):
    df, rows = hot
    want = {}
    for seq, key, v in sorted(rows):
        want.setdefault(key, (seq, key, v))
    got = dedupe.dedupe_first(df, [F.col("key")], [F.col("seq")])
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.values())
    again = dedupe.dedupe_first(got, [F.col("key")], [F.col("seq")])
    assert sorted(tuple(r) for r in again.collect()) == sorted(want.values())


def test_dedupe_keeps_the_partitioning_of_its_key(spark, data):
    from listingflow.session import stored
    batch = stored(fixtures.listings(spark, data), "batch")
    target = stored(batch.select("listing_id").distinct(), "target")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = plan(curate(batch, target, "1998-06-15", "job"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found.count("Exchange hashpartitioning") == 2      # the batch and the table


def test_row_cells_go_by_their_place(spark):
    html = ('<table><tr><th>1</th><td><a href="/x">Be</a><a href="/y">ta</a></td><td>High School</td>'
            '<td>Scholarship <i class="table-Numeric">77</i></td><td>$500</td><td>May 1, 2025</td></tr></table>')
    rows = pages.extract_rows(spark.createDataFrame([(1, html)], "page_id int, html string"),
                              "https://a.example", 2025, "x").collect()
    assert [(r.name, r.url, r.min_award) for r in rows] == [("Beta", "https://a.example/x", 500.0)]


def test_selectors_of_a_hot_site(spark, monkeypatch):
    rows = [(i, "hot" if i % 10 else "other", f"<h1>T{i}</h1><h2>S{i}</h2>") for i in range(200)]
    table = spark.createDataFrame(rows, "page_id int, site string, html string")
    sites = spark.createDataFrame([("hot", '{"title": "h1"}'), ("other", '{"title": "h2"}')],
                                  "site string, selectors string")
    want = sorted((i, f"T{i}" if i % 10 else f"S{i}") for i in range(200))
    small = pages.extract_by_spec(table, sites)
    assert "hashpartitioning" not in plan(small)
    assert sorted((r.page_id, r.name) for r in small.collect()) == want
    monkeypatch.setattr(pages, "BROADCAST_SITES", 1)
    large = pages.extract_by_spec(table, sites)
    assert sorted((r.page_id, r.name) for r in large.collect()) == want


def test_feed_items_at_any_depth(spark):
    item = "<item><title>T{}</title><dc:creator>c</dc:creator><description>d</description></item>"
    head = '<rss xmlns:dc="urn:dc"><channel><title>F</title>'
    feeds_ = [head + item.format(1) + "<g><h>" + item.format(2) + "</h></g><!-- " + item.format(9)
              + " --></channel></rss>",
              head + item.format(3) + "</channel>", "", None, "<rss/>", '<item id="4"><title>T4</title></item>']
    got = feeds.read_feed(spark.createDataFrame(list(enumerate(feeds_)), "n int, xml string"), "n")
    assert sorted((r.n, r.pos, r.name) for r in got.collect()) == [(0, 0, "T1"), (0, 1, "T2"), (5, 0, "T4")]


def test_cap_limits_before_the_shuffle(hot):
    df, rows = hot
    got = dedupe.cap(df, 3, [F.col("seq")], by=[F.col("key")])
    want = []
    for key in {k for _, k, _ in rows}:
        want += sorted(r for r in rows if r[1] == key)[:3]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    before_shuffle = plan(got).rsplit("hashpartitioning", 1)[1]
    assert "WindowGroupLimit" in before_shuffle


def test_numbering_of_a_hot_group(hot):
    df, rows = hot
    got = dedupe.number_rows(df.select("seq", "key"), "seq", ["key"], slices=16)
    want, seen = [], {}
    for seq, key, _ in sorted(rows):
        seen[key] = seen.get(key, 0) + 1
        want.append((seq, key, seen[key]))
    assert sorted((r.seq, r.key, r.row_no) for r in got.collect()) == sorted(want)
    nulls = dedupe.number_rows(df.select("seq", F.lit(None).cast("string").alias("key")), "seq",
                               ["key"], slices=16)
    assert [r.row_no for r in nulls.orderBy("seq").collect()] == list(range(1, len(rows) + 1))
    # One far value does not put the rest into one range.
    far = df.select(F.when(F.col("seq") == rows[0][0], 10 ** 15).otherwise(F.col("seq")).alias("seq"))
    sizes = far.groupBy(dedupe._slice_of(far, "seq", 16)).count()
    assert sizes.agg(F.max("count")).first()[0] <= 2 * len(rows) / 16
    empty = dedupe.number_rows(df.select("seq", "key").limit(0), "seq", ["key"])
    assert empty.count() == 0
    batches = dedupe.batch_numbers(df.select("seq", "key"), "seq", ["key"], 5)
    assert batches.groupBy("key", "batch").count().agg(F.max("count")).first()[0] == 5


SCHEMA = ("listing_id string, name string, max_award double, created_at timestamp_ntz, "
          "updated_at timestamp_ntz, src_seq bigint")


def _table(spark, rows):
    at = datetime.datetime(2020, 1, 1)
    return spark.createDataFrame([(k, n, a, at, at, i) for i, (k, n, a) in enumerate(rows)], SCHEMA)


def test_upsert_twice_is_upsert_once(spark):
    target = _table(spark, [("a", "A", 1.0), ("b", "B", 2.0), ("c", "C", None)])
    updates = _table(spark, [("b", "B", 3.0), ("c", "C", None), ("d", "D", 4.0)])
    once = merge.upsert(target, updates, "listing_id", "2021-01-01")
    assert {r.listing_id: (r.action, r.max_award, r.updated_at.year, r.created_at.year)
            for r in once.collect()} == {
        "a": ("keep", 1.0, 2020, 2020), "b": ("update", 3.0, 2021, 2020),
        "c": ("unchanged", None, 2020, 2020), "d": ("insert", 4.0, 2021, 2020)}
    twice = merge.upsert(once.drop("action"), updates, "listing_id", "2021-01-01")
    assert {r.action for r in twice.collect()} == {"keep", "unchanged"}
    assert sorted(map(repr, twice.drop("action").collect())) == sorted(
        map(repr, once.drop("action").collect()))


def test_small_update_leaves_the_target_unshuffled(spark, data):
    folder = scratch_dir(spark, "plan")
    _table(spark, [(f"k{i}", "n", 1.0) for i in range(100)]).write.parquet(f"{folder}/t")
    _table(spark, [("k1", "n", 2.0), ("new", "n", 2.0)]).write.parquet(f"{folder}/u")
    merged = merge.upsert(spark.read.parquet(f"{folder}/t"), spark.read.parquet(f"{folder}/u"),
                          "listing_id", "2021-01-01")
    text = plan(merged)
    assert "SortMergeJoin" not in text and "FullOuter" not in text
    assert "hashpartitioning" not in text


def test_patch_update_delete(spark):
    target = _table(spark, [("a", "A", 1.0), ("b", "B", 2.0)])
    changes = spark.createDataFrame([("a", "X", 9.0)], "listing_id string, name string, max_award double")
    patched = merge.patch(target, changes, "listing_id", ["max_award"])
    assert {r.listing_id: (r.name, r.max_award) for r in patched.collect()} == {
        "a": ("A", 9.0), "b": ("B", 2.0)}
    assert merge.patch(target, changes, "listing_id", []) is target
    assert merge.delete_where(target, {"name": "A"}).count() == 1
    with pytest.raises(ValueError):
        merge.delete_where(target, {})


def test_expired_and_kept_make_the_input(spark, data):
    rows = fixtures.listings_raw(spark, data, organization=False)
    kept = filters.drop_expired(rows, "1998-06-15").count()
    from listingflow.functions.deadlines import is_expired
    gone = rows.filter(is_expired(F.col("deadline"), "1998-06-15")).count()
    assert kept + gone == rows.count() and gone > 0


def test_contract_splits_all_rows(spark, data):
    rows = fixtures.listings(spark, data).withColumn("job_id", F.lit(None).cast("string"))
    good, bad = quality.split_by_contract(rows, {"x": F.length("name") > 12})
    assert good.count() + bad.count() == rows.count() and bad.count() > 0


def test_archive_prunes_folders(spark, data):
    path = scratch_dir(spark, "archive") + "/raw"
    rows = archive.archive_rows(fixtures.fetched_pages(spark, data))
    archive.write_archive(rows, path)
    back = archive.read_archive(spark, path)
    assert back.count() == rows.count()
    one = archive.read_archive(spark, path, "scraper-1", "2024-01-05", "2024-02-10")
    filters_ = plan(one).split("PartitionFilters:")[1].split("PushedFilters")[0]
    assert "scraper-1" in filters_ and "year" in filters_
    folders = {(r.scraper, r.month) for r in one.select("scraper", "month").collect()}
    assert folders == {("scraper-1", "01"), ("scraper-1", "02")}
    some = back.limit(3).select("key")
    assert archive.read_by_keys(back, some).count() == 3
    kept = stored(some, "keys")
    assert "dynamicpruning" in plan(archive.read_by_keys(back, kept))
    assert archive.delete_keys(back, kept).count() == back.count() - 3


def test_deletes_write_touched_folders_only(spark, data):
    """Folders without a deleted key keep their files, and what cannot be rewritten stays and is reported."""
    rows = archive.archive_rows(fixtures.fetched_pages(spark, data))
    table = archive.archive_table(spark, scratch_dir(spark, "archive") + "/raw")
    odd = rows.limit(1).withColumns({"scraper": F.lit("a:b c%/d"), "key": F.lit("a:b c%/d/2024/02/03/x"), "year": F.lit("2024"),
                                     "month": F.lit("02"), "day": F.lit("03")})
    table.add(rows)
    table.add(odd)
    before = table.version()
    doomed = stored(rows.orderBy("key").limit(3).select("key").union(odd.select("key")), "keys")
    assert "dynamicpruning" in plan(archive.read_by_keys(table.located(), doomed))
    assert archive.delete(table, doomed, group=2) == {}
    after = table.version()
    same = {p for p in before.folders if after.folders.get(p) == before.folders[p]}
    touched = {"/".join(f"{c}={r[c]}" for c in archive.PARTITIONS)
               for r in rows.join(doomed, "key", "left_semi").select(*archive.PARTITIONS).collect()}
    assert set(before.folders) - same - touched == {p for p in before.folders if "a%3Ab c%25%2Fd" in p} and len(same) > 10
    assert table.read().count() == rows.count() - 3
    broken = next(iter(sorted(same)))

    def change(part):
        if broken in str(part.inputFiles()):
            raise OSError("cannot write")
        return part.limit(0)

    failures = table.rewrite(sorted(same)[:4], change)
    assert set(failures) == {broken} and set(table.version().folders) == (set(after.folders) - set(sorted(same)[:4])) | {broken}


def test_cleanup_of_a_stored_table(spark):
    schema = spark.createDataFrame([], "seq bigint, deadline string, part string").schema
    table = VersionedTable(spark, scratch_dir(spark, "cleanup") + "/t", schema, ["part"])
    rows = [(i, "2024-01-01" if i % 3 else "Rolling", f"p{i % 4}") for i in range(12)] + [(99, None, "open")]
    table.put(spark.createDataFrame(rows, schema))
    folders = table.version().folders
    report = {r.part: (r.scanned, r.expired, r.deleted, r.error) for r in cleanup_table(table, "2024-06-01", group=1).collect()}
    assert report == {**{f"part=p{k}": (3, 2, 2, None) for k in range(4)}, "part=open": (1, 0, 0, None)}
    assert sorted(r.seq for r in table.read().collect()) == [0, 3, 6, 9, 99]
    assert table.version().folders["part=open"] == folders["part=open"]
    assert [tuple(r) for r in rollups.cleanup_summary(cleanup_table(table, "2024-06-01")).collect()] == [(5, 0, 0, 0)]


def test_registry_isolates_failures(spark, data):
    registry = tables.Registry()
    registry.register("good", lambda s, d: s.range(3).select(F.col("id").alias("src_seq")), ["g"])
    registry.register("bad", lambda s, d: s.table("missing"))
    rows, failures = registry.read_all(spark, data, ["G", "good", "bad", "who"])
    assert list(rows) == ["good"] and set(failures) == {"bad", "who"}
    assert rows["good"].columns[0] == "listing_id" and rows["good"].count() == 3


MARKUP = """<div id=m class="a b"><p>one<p>two<ul><li>x<li class='k'>y &amp; z</ul>
<script>if (1 <b) t = "<p>no</p>" + '</b';</script><table><tr><td>1<td>2<tr><td>3</table><br/>
<a href="/q?x=1&amp;y=2">go</a><!-- <p>no</p> --></div>"""


@pytest.mark.parametrize("selector, texts", [
    ("#m p", ["one", "two"]), ("li.k", ["y & z"]), ("tr td", ["1", "2", "3"]),
    ("tr:last-child td", ["3"]), (".a.b a[href*='x=1']", ["go"]), ("li, td", ["x", "y & z", "1", "2", "3"]),
    ('li[class="K" i]', ["y & z"]), ("ul p", []), ("div a[href$=zzz]", [])])
def test_markup_selectors(selector, texts):
    page = markup.Page(MARKUP)
    assert [page.text(n).strip() for n in page.select(selector)] == texts


def test_markup_attributes_and_siblings():
    page = markup.Page(MARKUP)
    assert page.attribute(page.select("a")[0], "href") == "/q?x=1&y=2"
    first, second = page.select("tr")
    assert page.following(first) == second and page.following(second) is None
    assert markup.Page(None).select("p") == [] and markup.Page("<p").select("p") == []
    with pytest.raises(ValueError):
        page.select("a ~ b")


def _event(key, day, seq):
    return (key, datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day), seq)


def _add_files(spark, folder, schema, *files):
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_stream_upsert_over_batches_and_restart(spark):
    """Two files in two runs; a re-run of the same files changes nothing, and untouched buckets keep their files."""
    work = scratch_dir(spark, "stream")
    schema = spark.createDataFrame([], "listing_id string, created_at timestamp_ntz, src_seq bigint").schema

    def run():
        rows = stream.read_new(spark, f"{work}/in", schema)
        stream.upsert_sink(rows, f"{work}/out", f"{work}/cp", "listing_id", buckets=8).awaitTermination()
        return sorted(tuple(r) for r in stream.current(spark, f"{work}/out", schema).select(
            "listing_id", "src_seq", F.day("created_at"), F.day("updated_at")).collect())

    table = stream.upsert_table(spark, f"{work}/out", schema)
    _add_files(spark, f"{work}/in", schema, [_event("a", 0, 1), _event("a", 1, 2), _event("b", 0, 3)])
    assert run() == [("a", 2, 1, 2), ("b", 3, 1, 1)]
    first = table.version()
    assert first.counts == {"insert": 2, "update": 0, "unchanged": 0, "stale": 0, "rows": 3}
    _add_files(spark, f"{work}/in", schema, [_event("b", 5, 4), _event("c", 5, 5)])
    want = [("a", 2, 1, 2), ("b", 4, 1, 6), ("c", 5, 6, 6)]
    assert run() == want
    second = table.version()
    assert run() == want and table.version() == second and second.counts["unchanged"] == second.counts["insert"] == 1
    kept = [p for p, f in first.folders.items() if second.folders[p] == f]
    assert kept and all(second.folders[p][0].startswith("data/table_version=1/") for p in second.folders if p not in kept)
    # Rows older than what is held, by another source: only the first time changes.
    stream.upsert_rows(table, spark.createDataFrame([_event("b", 2, 1), _event("c", 0, 2)], schema), "listing_id", 0, "late")
    assert table.version().counts["stale"] == 2 and run() == [("a", 2, 1, 2), ("b", 4, 1, 6), ("c", 5, 1, 6)]


def test_upsert_in_any_batches_is_the_merge_of_all(spark):
    """Batches in any order give what one does, and one does what the upsert of a table does."""
    rng = random.Random(4)
    schema = spark.createDataFrame([], "listing_id string, name string, created_at timestamp_ntz, src_seq bigint").schema
    rows = [(rng.choice("abcdefgh"), rng.choice("xy"), datetime.datetime(2024, 1, 1 + rng.randrange(28)), i) for i in range(60)]

    def fold(*batches):
        table = stream.upsert_table(spark, scratch_dir(spark, "fold") + "/t", schema)
        for i, batch in enumerate(batches):
            stream.upsert_rows(table, spark.createDataFrame(batch, schema), "listing_id", i, buckets=4)
        return sorted(map(tuple, table.read().drop("bucket").collect())), table.version().counts

    whole, counts = fold(rows)
    shuffled = rng.sample(rows, len(rows))
    assert fold(*[shuffled[i::7] for i in range(7)])[0] == whole and counts["insert"] == len({r[0] for r in rows})
    # The same actions as the batch upsert's, for one later row per key.
    held, later = rows[:20], {r[0]: r for r in rows[20:]}
    merged, counts = fold(held, list(later.values()))
    target = spark.createDataFrame([r[:4] + (r[2],) for r in fold(held)[0]], "listing_id string, name string, "
                                   "created_at timestamp_ntz, src_seq bigint, updated_at timestamp_ntz")
    updates = spark.createDataFrame([r + (r[2],) for r in later.values()], target.schema)
    stats = {r.action: r.n for r in merge.merge_stats(merge.upsert(target, updates, "listing_id", "2024-02-01")).collect()}
    assert {k: counts[k] for k in ("insert", "update", "unchanged")} == {k: stats.get(k, 0) for k in ("insert", "update", "unchanged")}


def test_a_change_that_dies_before_its_manifest_changes_nothing(spark, monkeypatch):
    schema = spark.createDataFrame([], "listing_id string, created_at timestamp_ntz, src_seq bigint").schema
    table = stream.upsert_table(spark, scratch_dir(spark, "dies") + "/t", schema)
    stream.upsert_rows(table, spark.createDataFrame([_event("a", 0, 1), _event("b", 0, 1)], schema), "listing_id", 0)
    before = (table.version(), sorted(map(tuple, table.read().collect())))
    batch = spark.createDataFrame([_event("a", 3, 2), _event("z", 0, 3)], schema)
    with monkeypatch.context() as patch:
        patch.setattr(VersionedTable, "_switch", lambda self, now: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            stream.upsert_rows(table, batch, "listing_id", 1)
    assert (table.version(), sorted(map(tuple, table.read().collect()))) == before
    for _ in range(2):
        stream.upsert_rows(table, batch, "listing_id", 1)
    assert table.version().number == 1 and {r.listing_id: r.src_seq for r in table.read().collect()} == {"a": 2, "b": 1, "z": 3}


def test_stream_dedupe_window(spark):
    """The window counts from the kept sighting, in whatever order files come."""
    work = scratch_dir(spark, "window")
    schema = spark.createDataFrame([], "k string, t timestamp").schema
    start = datetime.datetime(2024, 1, 1)
    days = {"a": (84, 0, 50, 30), "b": (90, 0, 200, 10, 40, 231), "c": range(0, 200, 25), None: (0, 31, 62)}
    sightings = [(k, start + datetime.timedelta(days=d)) for k, seen in days.items() for d in seen]
    _add_files(spark, f"{work}/in", schema, *[random.Random(1).sample(sightings, len(sightings))[i::5] for i in range(5)])
    rows = stream.read_new(spark, f"{work}/in", schema, files_per_batch=1)
    stream.sighting_sink(rows, f"{work}/out", f"{work}/cp", ["k"], "t", buckets=4).awaitTermination()
    kept = {}
    for r in stream.first_sightings(spark, f"{work}/out", schema, ["k"]).collect():
        kept.setdefault(r.k, []).append((r.seen_at - start).days)
    want = {}
    for k, seen in days.items():
        for d in sorted(seen):
            if k not in want or d > want[k][-1] + 30:
                want.setdefault(k, []).append(d)
    assert {k: sorted(v) for k, v in kept.items()} == want and want["a"] == [0, 50, 84] and want["c"] == [0, 50, 100, 150]


def test_ended_jobs_leave_the_state_and_may_come_back(spark):
    path = scratch_dir(spark, "jobs") + "/state"
    schema = spark.createDataFrame([], "job_id bigint, event_ts timestamp, event_id bigint, status string").schema

    def event(job, day, status):
        return (job, datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day), day * 100 + job, status)

    def add(*events):
        folder = scratch_dir(spark, "events")
        _add_files(spark, f"{folder}/in", schema, list(events))
        rows = stream.read_new(spark, f"{folder}/in", schema)
        stream.state_sink(rows, path, f"{folder}/cp", 4, source=folder).awaitTermination()

    live, ended = stream.state_tables(spark, path)
    add(*[event(j, j % 40, "completed") for j in range(80)], *[event(j, 1, "running") for j in range(80, 90)])
    assert live.read().count() == 90
    stream.expire_jobs(spark, path, "2024-02-15", "30 days")
    assert live.read().count() == 10 + 2 * 25 and ended.read().count() == 30
    stream.expire_jobs(spark, path, "2024-02-15", "30 days")
    state = {r.job_id: r for r in stream.job_state(spark, path).collect()}
    assert len(state) == 90 and state[3].expired and not state[85].expired
    add(event(3, 2, "running"), event(4, 50, "failed"))
    state = {r.job_id: r for r in stream.job_state(spark, path).collect()}
    assert len(state) == 90 and state[3].status == "completed" and (state[4].status, state[4].expired) == ("failed", False)


@pytest.mark.parametrize("name", ["stream_ingest", "stream_dedupe", "stream_upsert", "hourly_job_metrics",
                                  "stream_job_state", "job_state_expiry"])
def test_streams_do_not_depend_on_batches(spark, data, name, monkeypatch):
    """A table as a folder of parts, one part per batch in shuffled order, gives what its one file gives."""
    folder = scratch_dir(spark, "parts")
    for table in ("orders", "events"):
        spark.read.parquet(f"{data}/{table}.parquet").repartition(4, F.rand(3)).write.parquet(f"{folder}/{table}.parquet")
    want = sorted(map(tuple, catalog.QUERIES[name](spark, data).collect()))
    read_new = stream.read_new
    monkeypatch.setattr(stream, "read_new", lambda *a, **b: read_new(*a, **b | {"files_per_batch": 1}))
    assert sorted(map(tuple, catalog.QUERIES[name](spark, folder).collect())) == want


def test_api_payload_keys_and_amount_aliases(spark):
    """A key without a list gives no item; min and max come from one alias."""
    texts = ['{"scholarships": null}', '{"scholarships": null, "results": [{"title": "no"}]}',
             '{"results": [{"title": "a", "amount": {"min": 100}, "award_amount": 500}]}',
             '[{"title": "b", "amount": 0, "award_amount": 70}, {"title": "c", "amount": {}, "award_amount": {"max": 9}}]',
             '{"title": "d", "amount": 5}']
    payloads = spark.createDataFrame([(t,) for t in texts], "json string")
    got = {r.name: (r.min_award, r.max_award) for r in feeds.read_api(payloads).collect()}
    assert got == {"a": (100, None), "b": (70, 70), "c": (None, 9), "d": (5, 5)}


def test_contract_rules_are_counted_in_the_pass_that_writes(spark):
    schema = "id string, user_id string, listing_id string, organization string, status string"
    rows = [("1", "u", "l1", "o", "draft"), (None, None, "l2", "o" * 256, "lost"), ("3", "u", None, None, None), ("4", "u", "l9", "o", "draft")]
    listings = spark.createDataFrame([("l1",), ("l2",), ("l1",), (None,)], "listing_id string")
    apps = quality.reference(spark.createDataFrame(rows, schema), "listing_id", listings, "listing_id", "unknown")
    rules = quality.application_rules() | {"listing_unknown": F.col("unknown")}
    path = scratch_dir(spark, "checked") + "/rows"
    counts = quality.store_checked(apps, rules, path)
    assert counts == {"rows": 4, "broken": 3, "id_missing": 1, "user_id_missing": 1, "listing_id_missing": 1, "status_unknown": 1,
                      "organization_too_long": 1, "listing_unknown": 1}
    good, bad = quality.read_checked(apps, path)
    assert [r.id for r in good.collect()] == ["1"] and good.columns == apps.columns
    assert {r.id: sorted(r.broken) for r in bad.collect()} == {
        None: ["id_missing", "organization_too_long", "status_unknown", "user_id_missing"], "3": ["listing_id_missing"], "4": ["listing_unknown"]}
    empty = scratch_dir(spark, "checked") + "/rows"
    assert quality.store_checked(apps.limit(0), rules, empty)["rows"] == 0


def test_longest_domain_decides_the_scope(spark):
    pages_ = spark.createDataFrame([
        (1, "s", "https://a.b.org/x", 0), (2, "s", "https://B.org/", 3), (3, "s", "https://c.b.org:80/", 4), (4, "s", "https://x.c.b.org/", None),
        (5, "s", "https://own.net/p", 1), (6, "s", "https://notown.net/", 1), (7, "t", "https://a.b.org/x", 0), (8, "s", None, 0),
        (9, "s", "https://bad.own.net/", 0), (10, None, "https://b.org/", 0)], "id int, site string, url string, depth int")
    sites = spark.createDataFrame([("s", "https://own.net/start"), ("t", None)], "site string, url string")
    domains = spark.createDataFrame([("s", "b.org", True), ("s", "c.b.org", False), ("s", "x.c.b.org", True), ("s", "x.c.b.org", True),
                                     ("s", "bad.own.net", False), ("s", "bad.own.net", True)], "site string, domain string, allowed boolean")
    kept = filters.scope_by_site(pages_, sites, domains, depth="depth")
    assert sorted(r.id for r in kept.collect()) == [1, 2, 4, 5] and kept.columns == pages_.columns
    assert filters.scope_by_site(pages_, sites.limit(0), domains.limit(0)).count() == 0


def test_dictionary_of_many_phrases(spark):
    """100,000 phrases are broadcast, so texts are not shuffled; a larger one is joined by phrase."""
    words = spark.range(100_000).select(F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("category"), F.concat_ws(
        " ", *[F.concat(F.lit(f"{c}"), (F.col("id") * k % 99_991).cast("string")) for c, k in (("W", 1), ("v", 7), ("u", 3))]).alias("keyword"))
    extra = spark.createDataFrame([("x", "Grant"), ("x", "grant"), ("y", "GRANT"), ("z", "  "), ("z", "--")], "category string, keyword string")
    texts = spark.createDataFrame([(i, f"Some w{i}, V{i * 7 % 99_991} u{i * 3 % 99_991}; grants grant! w5") for i in range(40)]
                                  + [(100, None), (101, "")], "id int, text string")
    found = search.tag_dictionary(texts, F.col("text"), "id", words.union(extra))
    got = {(r.id, r.category, r.keyword) for r in found.collect()}
    assert len(got) == 40 * 4 + 9 and {(3, "odd", "W3 v21 u9"), (3, "x", "Grant"), (3, "x", "grant"), (3, "y", "GRANT")} <= got
    final = plan(found)
    assert "BroadcastHashJoin" in final or "AdaptiveSparkPlan" in final
    assert search.tag_dictionary(texts, F.col("text"), "id", words.limit(0)).count() == 0


def test_feed_files_and_feed_texts_agree(spark):
    feed = ("<rss><channel><a><b><item><title>One &amp; two</title><description><![CDATA[by <b>the</b> </item> end]]></description>"
            "<link>https://x.org/1</link></item></b></a>\n<item kind='x'><title>Three</title><link>l</link></item></channel></rss>")
    bad = "<rss><channel><item><title>ok</title></item><item><title>x</titel></item></channel></rss>"
    path = scratch_dir(spark, "feeds") + "/files"
    spark.createDataFrame([(feed,), (bad,)], "xml string").write.option("maxRecordsPerFile", 1).text(path)
    by_file = {(r.name, r.url, r.description) for r in feeds.read_feed_files(spark, path).collect()}
    by_text = {(r.name, r.url, r.description) for r in feeds.read_feed(spark.createDataFrame([(feed,)], "xml string")).collect()}
    assert by_text < by_file and by_file - by_text == {("ok", None, None)} and ("One & two", "https://x.org/1", "by <b>the</b> </item> end") in by_text
    assert feeds.broken_feed_items(spark, path).count() == 1


def test_json_lines_are_all_kept_in_any_batches(spark):
    schema = spark.createDataFrame([], "a bigint, b string").schema
    lines = ['{"a": 1, "b": "x"}', '{"a": 2', "", '{"a": "no", "b": "y"}', '{"b": "z"}', "[1]", "{}"]
    results = []
    for files in (1, 4):
        work = scratch_dir(spark, "json")
        spark.createDataFrame([(x,) for x in lines], "line string").repartition(files).write.text(f"{work}/in")
        for _ in range(2):
            stream.ingest_json(spark, f"{work}/in", schema, f"{work}/out", f"{work}/cp", files_per_batch=1).awaitTermination()
        sound, broken = stream.read_json_ingest(spark, f"{work}/out", schema)
        results.append((sorted(map(str, sound.collect())), sorted(r.line for r in broken.collect())))
    assert results[0] == results[1] and '{"a": 2' in results[0][1] and '{"a": "no", "b": "y"}' in results[0][1] and len(results[0][0]) >= 3


def test_details_of_pages_go_into_the_batch(spark, data):
    listing = spark.createDataFrame([("a", "One", "old", 0.0), ("b", "Two", "kept", 5.0), (None, "Three", "x", 1.0)],
                                    "url string, name string, eligibility string, max_award double")
    details = spark.createDataFrame([(2, "a", "later", 9.0), (1, "a", "Applicants must be  brave. " + "y" * 2000, 7.0), (3, "b", "", 0.0),
                                     (4, None, "none", 1.0)], "page_id int, url string, eligibility string, max_award double")
    got = {r.name: (r.eligibility, r.max_award) for r in curate_plans.with_details(listing, details).collect()}
    assert got["Two"] == ("kept", 5.0) and got["Three"] == ("x", 1.0) and got["One"][1] == 7.0
    assert got["One"][0].startswith("brave. yy") and len(got["One"][0]) == 1000
    whole = curate_plans.with_details(listing, details, max_chars=None)
    assert max(len(r.eligibility) for r in whole.collect()) == 2007
    from listingflow.catalog import jobs
    target = jobs._target(spark, data).limit(5)
    registry = tables.Registry()
    registry.register("one", lambda s, d: listing.filter("name = 'One'").withColumns({"src_seq": F.lit(1), "organization": F.lit("o"), "deadline": F.lit("")}))
    merged, counts = curate_plans.ingest(spark, registry, data, target, "1998-06-15", "job", details)
    assert [r.eligibility[:6] for r in merged.filter("action = 'insert'").collect()] == ["brave."]
    assert [tuple(r) for r in counts.collect()] == [("one", "completed", 1, 0)]


def test_an_index_kept_up_to_date_is_that_of_a_rebuild(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(12)]
    index = PostingIndex(spark, scratch_dir(spark, "index") + "/i", "id", "bigint", ["text"], 2)
    held = {}
    schema = "id bigint, text string"
    for batch in range(7):
        rows = {rng.randrange(30): " ".join(rng.choices(vocabulary, k=rng.randrange(1, 9))) for _ in range(rng.choice((1, 6, 12)))}
        gone = rng.sample(sorted(held), min(len(held), 3)) if batch % 2 else []
        for _ in range(1 + (batch == 3)):  # a batch that runs again changes nothing
            index.apply(spark.createDataFrame(list(rows.items()), schema), spark.createDataFrame([(i,) for i in gone], "id bigint"), batch)
        held = {k: v for k, v in held.items() if k not in gone} | rows
    assert index.rows() == len(held) and len(index.segments()) < 7
    table = spark.createDataFrame(list(held.items()), schema)
    for query in (["w1", "W5"], ["w3", "w3", "none"], ["none"]):
        fresh = search.search(search.build_postings(table, "id", ["text"]), "id", query, 10, len(held))
        assert [tuple(r) for r in index.search(query, 10).collect()] == [tuple(r) for r in fresh.collect()]
    index.apply(None, table.select("id"), 7)
    assert index.rows() == 0 and index.search(["w1"], 5).collect() == []


def test_empty_batches_change_nothing(spark):
    schema = spark.createDataFrame([], "listing_id string, created_at timestamp_ntz, src_seq bigint").schema
    none = spark.createDataFrame([], schema)
    table = stream.upsert_table(spark, scratch_dir(spark, "none") + "/t", schema)
    stream.upsert_rows(table, none, "listing_id", 0)
    assert table.read().count() == 0
    stream.upsert_rows(table, spark.createDataFrame([_event("a", 0, 1), (None, None, None)], schema), "listing_id", 1)
    stream.upsert_rows(table, none, "listing_id", 2)
    assert sorted(r.listing_id or "" for r in table.read().collect()) == ["", "a"] and table.version().batches == {"stream": 2}
    index = PostingIndex(spark, scratch_dir(spark, "none") + "/i", "id", "bigint", ["text"])
    index.apply(spark.createDataFrame([], "id bigint, text string"), None, 0)
    assert index.rows() == 0 and index.search(["a"], 3).collect() == []


def test_a_scope_removes_what_was_written_in_it(spark):
    with scratch_scope(spark) as folder:
        inner = stored(spark.range(5), "numbers")
        assert all(folder in f for f in inner.inputFiles()) and inner.count() == 5
    outer = stored(spark.range(3), "numbers")
    assert outer.count() == 3 and folder not in outer.inputFiles()[0]
    with pytest.raises(Exception):
        spark.read.parquet(folder + "/*").count()
