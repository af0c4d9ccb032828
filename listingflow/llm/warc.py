"""WARC archives and their capture index.

Records are written by Spark's text writer, whose line separator is the blank lines that end a
record, so archives can be in any store Spark reaches. Readers take records by their length. The index of
what was read is a set of runs, each sorted by URL key and time by the task that read it; runs are cut
at the same key ranges, and each range is merged from all runs by a loser tree. The
ranges one after another are the history of all captures.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listingflow.llm.common import stored
from listingflow.llm.url_filter import host_of
from listingflow.session import scratch_dir

#: Payloads shorter than this are always written in full.
LEAST_REVISIT = 100
#: Seconds since 1970 of page 0 where pages carry no time of capture.
FIRST_CAPTURE = 1_704_067_200
#: A file's records by their size in bytes: so many of at most so many bytes each, so a file has about 64 MB at most, or one
#: larger record. Readers hold a file at a time.
TIERS = ((1 << 16, 1000), (1 << 20, 62), (1 << 24, 4), (1 << 62, 1))
_END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: Column) -> Column:
    """The host's labels from the last to the first, then what follows the host; for sorting."""
    labels = F.array_join(F.reverse(F.split(host_of(url), r"\.")), ",")
    rest = F.regexp_extract(F.substr(url, F.instr(url, "://") + 3), r"(?s)^[^/?#]*(.*)$", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(labels, F.lit(")"), rest)).otherwise(F.coalesce(url, F.lit("")))


def records(pages: DataFrame) -> tuple[DataFrame, list[int]]:
    """``record``, the text of each page's WARC record without the blank lines that end it, with its ``tier``; and the
    tiers that there are."""
    payload = F.coalesce("html", F.lit(""))
    read = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"),
                        F.octet_length(payload).alias("n"))
    # No more than what a record has besides its payload; a URL may triple as its spaces are escaped, and is there once.
    size = F.col("n") + 3 * F.coalesce(F.octet_length("url"), F.lit(0)) + 1000
    tier = F.lit(len(TIERS) - 1)
    for i in reversed(range(len(TIERS) - 1)):
        tier = F.when(size <= TIERS[i][0], i).otherwise(tier)
    read = read.withColumn("tier", tier)
    tiers = sorted(r["tier"] for r in read.select("tier").distinct().collect())
    # Written, so that its size is known: where it is small the payloads are joined without a shuffle.
    first = stored(read.where(F.col("n") >= LEAST_REVISIT).groupBy("digest")
                   .agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
                   .where("copies > 1").select("digest", "first"), "originals")
    again = F.col("first").isNotNull() & F.coalesce(F.col("page_id") > F.col("first"), F.lit(True))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    uri = F.regexp_replace(F.col("url"), r"[\x00-\x20\x7f]", "%20")
    time = F.date_format(F.timestamp_seconds(F.lit(FIRST_CAPTURE) + F.coalesce("page_id", F.lit(0))),
                         "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("n").cast("string"), F.lit(_END))
    block = F.concat(http, F.when(again, "").otherwise(F.col("payload")))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))),
        F.concat(F.lit("WARC-Date: "), time),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), name(F.col("first")))),
        F.when(again, F.lit(f"WARC-Profile: {_PROFILE}")),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return read.join(first, "digest", "left") \
        .select("tier", F.concat(F.concat_ws("\r\n", *lines), F.lit(_END), block).alias("record")), tiers


def write_archives(pages: DataFrame, path: str) -> None:
    """A WARC record per row of page_id, url and html, in files below ``path``.

    The payload is the html in UTF-8, empty for null. Of records with equal payloads of
    at least 100 bytes the one of the smallest page_id is a response and the others revisit it; all rows of that id are
    responses, and a row without an id revisits if any row has one. Repeated rows
    are written each. White space and control characters in a URL become %20; a null URL
    has no target line. Other columns are ignored. Records of a size tier share files, so that long pages
    make no file larger than a reader holds; a tier costs a pass over the pages, and most tables have one.
    """
    written, tiers = records(pages)
    for i in tiers or [0]:
        written.where(F.col("tier") == i).select("record").write.mode("errorifexists").option("lineSep", _END) \
            .option("maxRecordsPerFile", TIERS[i][1]).text(f"{path}/tier={i}")


def _parse(data: memoryview) -> Iterator[tuple]:
    """(offset, length, headers, payload) of each record of a file."""
    whole = bytes(data)
    at = 0
    while at < len(whole):
        head = whole.index(b"\r\n\r\n", at)
        first, *lines = whole[at:head].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        start = head + 4
        stop = start + int(headers["content-length"])
        body = whole.index(b"\r\n\r\n", start, stop) + 4
        yield at, stop + 4 - at, headers, memoryview(whole)[body:stop]
        at = stop + 4


_SCHEMA = ("file string, offset long, length long, record_type string, page_id {kind}, refers_to {kind}, "
           "url string, captured_at string, declared_digest string, payload_bytes long, payload_digest string")


def read_archives(spark: SparkSession, path: str, kind: str = "long", payloads: bool = False) -> DataFrame:
    """A row per record: where it is, its headers, and length and digest of the payload that it holds.

    With ``payloads`` the bytes too. A payload that does not match its response's digest is an error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    number = lambda uri: int(uri[len("<urn:page:"):-1]) if uri and len(uri) > len("<urn:page:>") else None

    def run(batches) -> Iterator[pa.RecordBatch]:
        types = {"offset": pa.int64(), "length": pa.int64(), "page_id": pa.int64(), "refers_to": pa.int64(),
                 "payload_bytes": pa.int64()}
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows: list[tuple] = []
                held = 0
                for offset, length, headers, payload in _parse(content.as_buffer()):
                    digest = hashlib.sha256(payload).hexdigest()
                    declared = headers["warc-payload-digest"].partition(":")[2]
                    if headers["warc-type"] == "response" and digest != declared:
                        raise ValueError(f"payload differs from its digest at byte {offset} of {path}")
                    rows.append((path.as_py(), offset, length, headers["warc-type"], number(headers["warc-record-id"]),
                                 number(headers.get("warc-refers-to")), headers.get("warc-target-uri"),
                                 headers["warc-date"], declared, len(payload), digest,
                                 *([bytes(payload)] if payloads else [])))
                    held += length if payloads else 300
                    if held > 8_000_000:
                        yield _batch(rows, names, types)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, names, types)

    schema = _SCHEMA.format(kind="long") + (", payload binary" if payloads else "")
    names = [part.split()[0] for part in schema.split(", ")]
    return files.mapInArrow(run, schema).withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})


def _batch(rows: list[tuple], names: list[str], types: dict) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, types.get(n, pa.binary() if n == "payload" else pa.string())) for n, c in zip(names, columns, strict=True)],
        names=names)


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, the winner goes up.

    Replacing the winner replays one path, so a row costs the logarithm of the number of runs.
    """

    def __init__(self, runs: Sequence[Iterator[tuple]]) -> None:
        self._runs = runs
        self._heads = [next(run, None) for run in runs]
        self._losers = [-1] * len(runs)
        self._winner = -1
        for i in range(len(runs)):
            self._replay(i)

    def _before(self, a: int, b: int) -> bool:
        """Whether run ``a`` wins: an ended run loses, equal keys go by run."""
        x, y = self._heads[a], self._heads[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    def _replay(self, run: int) -> None:
        k, node = len(self._runs), (run + len(self._runs)) // 2
        while node:
            other = self._losers[node]
            if other < 0:  # first visit: wait here for the opponent
                self._losers[node] = run
                return
            if not self._before(run, other):
                self._losers[node], run = run, other
            node //= 2
        self._winner = run if k else -1

    def __iter__(self) -> Iterator[tuple]:
        while self._winner >= 0 and (head := self._heads[self._winner]) is not None:
            yield head
            self._heads[self._winner] = next(self._runs[self._winner], None)
            self._replay(self._winner)


def merge_index(captures: DataFrame, by: Sequence[str] = ("url_key", "captured_at", "page_id")) -> DataFrame:
    """``captures`` in the order of ``by``, with ``merge_part`` and ``merge_place``, which sort alike.

    Every task sorts its captures into a run and writes it; then each key range is merged from the
    slices of all runs. A URL captured very often spreads over ranges by time and id. Nulls come first. A
    merging task holds the rows of its range, whose number follows the shuffle partitions.
    """
    runs = stored(captures.sortWithinPartitions(*by).withColumn("run", F.spark_partition_id())
                  .withColumn("place", F.monotonically_increasing_id()), "runs")
    names = [c for c in runs.columns if c not in ("run", "place")]
    schema = captures.select(*names).schema.add("merge_part", "integer").add("merge_place", "long")

    def run_merge(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        table = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if table is None:
            return
        # Slices arrive in any order; each run's rows are as its task sorted them.
        table = table.take(pa.compute.sort_indices(table, [("run", "ascending"), ("place", "ascending")]))
        keys = list(zip(*[[(v is not None, v) if v is not None else (False, 0) for v in table.column(c).to_pylist()]
                          for c in by], strict=True))
        owner = table.column("run").to_numpy()
        cuts = [0, *(i for i in range(1, len(owner)) if owner[i] != owner[i - 1]), len(owner)]
        slices = [((keys[i], i) for i in range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]
        order = pa.array([i for _, i in LoserTree(slices)])
        merged = table.take(order).select(names)
        part = TaskContext.get().partitionId()
        merged = merged.append_column("merge_part", pa.array([part] * len(order), pa.int32())) \
            .append_column("merge_place", pa.array(range(len(order)), pa.int64()))
        yield from merged.to_batches(max_chunksize=10_000)

    return runs.repartitionByRange(*by).mapInArrow(run_merge, schema)


def archive(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` as WARC, reads the archives back and merges their index.

    Per page: page_id, payload_bytes and payload_digest of the full payload, record_type,
    refers_to (the response's page_id, null for responses), url, url_key, captured_at,
    merge_part and merge_place. See ``write_archives`` for nulls and repeats.
    """
    spark = pages.sparkSession
    path = scratch_dir(spark, "warc") + "/archive"
    write_archives(pages, path)
    kind = pages.schema["page_id"].dataType.simpleString()
    read = stored(read_archives(spark, path, kind), "captures")
    full = read.where("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("of")) \
        .agg(F.max("payload_bytes").alias("bytes"), F.max_by("payload_digest", "payload_bytes").alias("digest"))
    revisits = read.where("record_type = 'revisit'").join(full, F.col("refers_to") == F.col("of"), "left") \
        .withColumns({"payload_bytes": F.col("bytes"), "payload_digest": F.col("digest")}).select(*read.columns)
    captures = read.where("record_type = 'response'").unionByName(revisits).withColumn("url_key", url_key(F.col("url")))
    return merge_index(captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to",
                                       "url", "url_key", "captured_at", "file", "offset", "length"))
