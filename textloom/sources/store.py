"""Tables derived from a corpus, written once and read by every later query."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of keys, terms or matches, and bytes of their files, that are sent to all executors at most.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32_000_000

_known: dict[tuple, tuple[str, DataFrame]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where the session names none, that is one beside the warehouse, which they share too;
    a temporary one of this machine only where the driver runs all tasks itself."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        local = spark.sparkContext.master.split("[")[0] == "local"
        at = tempfile.mkdtemp(prefix="textloom-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/textloom-{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table: executors that are lost later cost nothing but their running tasks."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_at_end(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, label: str = "keys") -> DataFrame:
    """``df``, written once, as the side of a join to be sent to all executors if its size allows that: what it meets isn't
    shuffled."""
    own = written(df, label)
    size = own._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(own) if int(size) <= BROADCAST_BYTES and own.count() <= BROADCAST_ROWS else own


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Have a table deleted when the application ends, in whatever file system it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def derived(spark: SparkSession, key: tuple, build: Callable[[], DataFrame], of: str = "") -> DataFrame:
    """The table of ``key``, built at its first use in this application, and again when ``of``, its source's state, is another."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _known or _known[key][0] != of:
        _known[key] = of, written(build(), "-".join(str(k).rpartition("/")[2] for k in key[2:]) or "table")
    return _known[key][1]


def state(spark: SparkSession, *paths: str) -> str:
    """Number, bytes and last change of the files at ``paths``."""
    out = []
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True)
        n = size = last = 0
        while files.hasNext():
            f = files.next()
            n, size, last = n + 1, size + f.getLen(), max(last, f.getModificationTime())
        out.append(f"{n},{size},{last}")
    return ";".join(out)
