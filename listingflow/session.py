"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession


def get_session(app: str = "listingflow", cpus: int | str = "*") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the one given."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


#: Folders of the scopes that are open, the innermost last.
_SCOPES: list[str] = []


@contextmanager
def scratch_scope(spark: SparkSession, name: str = "run") -> Iterator[str]:
    """A folder for all written intermediates of a job, which is removed at the end.

    What the job returns must be read before, or be written elsewhere. Scopes may lie in each other, in one thread.
    """
    path = scratch_dir(spark, name)
    _SCOPES.append(path)
    try:
        yield path
    finally:
        _SCOPES.remove(path)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder for written intermediates, of the scope that is open or below ``spark.checkpoint.dir``.

    All executors must see it, so without that setting only a local session
    may fall back to the machine's own temporary folder.
    """
    if _SCOPES:
        return f"{_SCOPES[-1]}/{name}-{uuid.uuid4().hex}"
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/listingflow/{name}-{uuid.uuid4().hex}"
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return tempfile.mkdtemp(prefix=f"listingflow-{name}-")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the scratch folder and read back.

    For a result that a plan uses several times: it is computed once, its size is
    known to the joins that follow, and a lost executor costs no recomputation.
    """
    path = scratch_dir(df.sparkSession, name) + "/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def observed(seen: Observation) -> dict[str, int]:
    """What was observed of a frame that was written; 0 and null as 0.

    Where adaptive execution finds that there is no row it drops the observation with the plan, and Spark then
    fails to hand out what was never taken: nothing was observed.
    """
    try:
        return {name: value or 0 for name, value in seen.get.items()}
    except Py4JJavaError:
        return {}
