"""The hourly batch as incremental jobs.

Every job runs over what is new with ``availableNow`` and stops. Rows, counters and raw files go to sinks with
one folder per micro-batch, replaced if a batch runs again. What depends on earlier rows of a key is kept in a table by hash
buckets of the key (``sources.versioned``): a batch rewrites the buckets it touches and the manifest that names
them carries the number of the batch, so a batch that runs again changes nothing and one that dies
halfway leaves the table as it was. A key's row is a fold of all its rows that does not ask for their order, so results do
not depend on how the input was split into batches or in which order it came, nothing is dropped as late,
and a read takes the table as it is.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from listingflow.operators.merge import ACTION, fold_in
from listingflow.session import stored
from listingflow.sources.versioned import BUCKET as _BUCKET
from listingflow.sources.versioned import BUCKETS, VersionedTable, apply_batch, bucketed, named


def read_new(spark: SparkSession, folder: str, schema: T.StructType, pattern: str | None = None,
             files_per_batch: int = 1000) -> DataFrame:
    """New parquet files of a folder, all or those whose names fit ``pattern``; ``folder`` may also be a table stored as one file.

    A stream's path must be a folder unless it is a pattern, so the path is given as one that fits only itself.
    """
    path = folder.rstrip("/")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if pattern is not None:
        stream = stream.option("pathGlobFilter", pattern)
    return stream.parquet(f"{path[:-1]}[{path[-1]}]")


def write_batches(df: DataFrame, path: str, checkpoint: str, mode: str = "append",
                  prepare=None) -> StreamingQuery:
    """Each micro-batch to ``path/batch_id=n``."""
    def save(batch: DataFrame, batch_id: int) -> None:
        out = prepare(batch) if prepare else batch
        out.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (df.writeStream.foreachBatch(save).outputMode(mode)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def ingest(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append new raw rows; the file sink's log makes each file count once."""
    return (df.writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(availableNow=True).start())


_LINE = "broken_line"


def ingest_json(spark: SparkSession, folder: str, schema: T.StructType, path: str, checkpoint: str,
                files_per_batch: int = 1000) -> StreamingQuery:
    """New JSON lines of a folder to ``path``; lines that are no JSON, or not of ``schema``, are set aside whole.

    Each micro-batch is one write: sound rows and broken lines in folders of their own, below a folder of
    the batch that is replaced if it runs again. ``read_json_ingest`` reads both.
    """
    full = T.StructType([*schema.fields, T.StructField(_LINE, T.StringType())])
    rows = (spark.readStream.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _LINE)
            .option("maxFilesPerTrigger", files_per_batch).json(folder))

    def save(batch: DataFrame, batch_id: int) -> None:
        flagged = batch.withColumn("sound", F.col(_LINE).isNull())
        flagged.write.mode("overwrite").partitionBy("sound").parquet(f"{path}/batch_id={batch_id}")

    return _sink(rows, checkpoint, save)


def read_json_ingest(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(sound rows, broken lines as ``line``) of all batches."""
    full = T.StructType([*schema.fields, T.StructField(_LINE, T.StringType()), T.StructField("sound", T.BooleanType()),
                         T.StructField("batch_id", T.LongType())])
    rows = spark.read.schema(full).parquet(path)
    return rows.filter("sound").select(*schema.names), rows.filter("not sound").select(F.col(_LINE).alias("line"))


# --- tables by hash bucket ---------------------------------------------------------------------------------

def _sink(df: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return (df.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


# --- dedupe by a window -----------------------------------------------------------------------------------

def sighting_table(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str]) -> VersionedTable:
    """Keys with the times they were seen and whether the dedupe keeps the sighting."""
    return bucketed(spark, path, T.StructType([*(schema[k] for k in keys), T.StructField("seen_at", T.TimestampType()),
                                               T.StructField("kept", T.BooleanType())]))


def sighting_sink(df: DataFrame, path: str, checkpoint: str, keys: list[str], event_time: str,
                  window: str = "30 days", buckets: int = BUCKETS, source: str = "stream") -> StreamingQuery:
    """Each batch's sightings into the table of sightings, where the dedupe is made anew for the keys of the touched buckets.

    A sighting is kept unless one was kept at most ``window`` before it, so the window counts from the kept sighting and a
    key that is seen all the time comes back once per window. Sightings count once by key and time; a
    key's times are what a task holds at once.
    """
    schema = df.schema

    def fold(held: DataFrame, rows: DataFrame) -> DataFrame:
        times = F.array_sort(F.collect_set("seen_at"))
        seen = held.drop("kept").unionByName(rows).groupBy(*keys, _BUCKET).agg(times.alias("times"))
        kept = F.aggregate("times", F.array().cast("array<timestamp>"), lambda done, at: F.when(
            (F.size(done) == 0) | (at > F.element_at(done, -1) + F.expr(f"interval {window}")), F.concat(done, F.array(at))).otherwise(done))
        return seen.withColumn("chosen", kept).select(*keys, _BUCKET, "chosen", F.explode("times").alias("seen_at")) \
            .withColumn("kept", F.array_contains("chosen", F.col("seen_at"))).drop("chosen")

    def apply(batch: DataFrame, batch_id: int) -> None:
        seen = batch.select(*keys, F.col(event_time).cast("timestamp").alias("seen_at")).distinct()
        apply_batch(sighting_table(batch.sparkSession, path, schema, keys), seen, keys, fold, batch_id, source,
                    buckets=buckets)

    return _sink(df, checkpoint, apply)


def first_sightings(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    """The sightings that the dedupe keeps."""
    return sighting_table(spark, path, schema, keys).read().filter("kept").select(*keys, "seen_at")


# --- upsert -----------------------------------------------------------------------------------------------

def upsert_table(spark: SparkSession, path: str, schema: T.StructType) -> VersionedTable:
    """The upserted table: the stream's columns and updated_at."""
    columns = [f for f in schema.fields if f.name != "updated_at"]
    return bucketed(spark, path, T.StructType([*columns, T.StructField("updated_at", schema["created_at"].dataType)]))


def upsert_rows(table: VersionedTable, rows: DataFrame, key: str, batch_id: int, source: str = "stream",
                buckets: int = BUCKETS) -> None:
    """A batch of rows into the table; see ``merge.fold_in`` for what becomes of a key. Counts of actions go to the manifest."""
    counts = {a: F.count_if(F.col(ACTION) == a) for a in ("insert", "update", "unchanged", "stale")} | {"rows": F.sum("rows")}
    stamped = rows.withColumn("updated_at", F.col("created_at"))
    apply_batch(table, stamped, [key], lambda held, new: fold_in(held, new, [key, _BUCKET], ["src_seq"], ["src_seq"]),
                batch_id, source, counts, buckets)


def upsert_sink(df: DataFrame, path: str, checkpoint: str, key: str, buckets: int = BUCKETS,
                source: str = "stream") -> StreamingQuery:
    """Each batch upserted into the table at ``path``. Streams into one table need a ``source`` each: it numbers batches."""
    schema = df.schema
    return _sink(df, checkpoint, lambda batch, batch_id: upsert_rows(
        upsert_table(batch.sparkSession, path, schema), batch, key, batch_id, source, buckets))


def current(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The upserted table."""
    return upsert_table(spark, path, schema).read().drop(_BUCKET)


# --- counters by hour ---------------------------------------------------------------------------------------

def _read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    with_batch = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    return spark.read.schema(with_batch).parquet(path)


def hourly_sink(events: DataFrame, path: str, checkpoint: str, counters: list[str]) -> StreamingQuery:
    """Each batch's job counters per tumbling hour; a late event is counted in the batch it comes with."""
    def sums(batch: DataFrame) -> DataFrame:
        return batch.groupBy(F.window("event_ts", "1 hour").start.alias("hour")).agg(
            F.count("*").alias("events"), *[F.sum(c).cast("long").alias(c) for c in counters])

    return write_batches(events, path, checkpoint, prepare=sums)


def hourly_metrics(spark: SparkSession, path: str, counters: list[str]) -> DataFrame:
    """Job counters per hour over all batches."""
    schema = T.StructType([T.StructField("hour", T.TimestampType()),
                           *(T.StructField(c, T.LongType()) for c in ("events", *counters))])
    return _read_log(spark, path, schema).groupBy("hour").agg(
        *[F.sum(c).alias(c) for c in ("events", *counters)])


# --- job state ----------------------------------------------------------------------------------------------

_ENDED = ("completed", "failed")


def state_tables(spark: SparkSession, path: str, kind: str = "bigint") -> tuple[VersionedTable, VersionedTable]:
    """The live jobs, and those that ended and have left the state, by month."""
    columns = f"job_id {kind}, event_ts timestamp, event_id bigint, status string"
    ended = T.StructType.fromDDL(f"{columns}, month string")
    return (bucketed(spark, f"{path}/live", T.StructType.fromDDL(columns)), VersionedTable(spark, f"{path}/ended", ended, ["month"]))


def state_sink(events: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS, source: str = "stream") -> StreamingQuery:
    """Each batch's last status of the jobs it mentions into the state; by event time and id, whatever comes first."""
    kind = events.schema["job_id"].dataType.simpleString()
    order = ["event_ts", "event_id"]

    def apply(batch: DataFrame, batch_id: int) -> None:
        live, _ = state_tables(batch.sparkSession, path, kind)
        apply_batch(live, batch.select("job_id", *order, "status"), ["job_id"],
                    lambda held, rows: fold_in(held, rows, ["job_id", _BUCKET], order), batch_id, source, buckets=buckets)

    return _sink(events, checkpoint, apply)


def expire_jobs(spark: SparkSession, path: str, as_of: str, after: str = "30 days", kind: str = "bigint") -> None:
    """Moves jobs that ended more than ``after`` before ``as_of`` out of the state, to the folder of their month.

    The state that a batch may have to rewrite is then that of jobs which run or ended lately. Jobs are added to the
    ended ones before they leave the state; if this dies in between they are in both, which ``job_state`` takes as one.
    """
    live, ended = state_tables(spark, path, kind)
    due = F.col("status").isin(*_ENDED) & (F.col("event_ts") < F.lit(as_of).cast("timestamp") - F.expr(f"interval {after}"))
    leaving = stored(live.located().filter(due).withColumn("month", F.date_format("event_ts", "yyyy-MM")), "leaving")
    months = [r[0] for r in leaving.select("month").distinct().collect()]
    if not months:
        return
    touched = [f"month={m}" for m in months]
    columns = ["job_id", "event_ts", "event_id", "status", "month"]
    both = ended.read(touched).unionByName(leaving.select(*columns))
    last = F.max_by(F.struct(*columns), F.struct("event_ts", "event_id"))
    ended.put(both.groupBy("job_id", "month").agg(last.alias("row")).select("row.*").hint("rebalance", "month"), touched)
    parts = [named(r[0]) for r in leaving.select("table_part").distinct().collect()]
    live.put(live.read(parts).filter(~due).hint("rebalance", _BUCKET), parts)


def job_state(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """Last status of each job by event time and id, and ``expired``, whether the job has left the state.

    An event that comes for a job that left makes it live again; the later of its rows counts.
    """
    live, ended = state_tables(spark, path, kind)
    columns = ["job_id", "event_ts", "event_id", "status"]
    here = live.read().select(*columns)
    if ended.version() is None:
        return here.select("job_id", "status", "event_ts", F.lit(False).alias("expired"))
    gone = ended.read().select(*columns)
    again = gone.join(here.select("job_id"), "job_id", "left_semi").withColumn("expired", F.lit(True)) \
        .unionByName(here.withColumn("expired", F.lit(False)))
    row = F.struct("event_ts", "event_id", "status", "expired")
    last = again.groupBy("job_id").agg(F.max_by(row, F.struct("event_ts", "event_id", "expired")).alias("row")).select("job_id", "row.*")
    return gone.join(here.select("job_id"), "job_id", "left_anti").withColumn("expired", F.lit(True)).unionByName(last) \
        .select("job_id", "status", "event_ts", "expired")
