"""Results as JSON and CSV, and a cache of results."""

from __future__ import annotations

import hashlib
import json
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import shared_dir


def as_json(df: DataFrame, metadata: dict | None = None) -> DataFrame:
    """``json``: each row as an object, under ``result`` beside ``queryMetadata`` if there is any."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    if metadata is not None:
        meta = json.dumps(metadata, sort_keys=True)
        return df.select(F.concat(F.lit('{"queryMetadata":' + meta + ',"result":'), F.to_json(row), F.lit("}")).alias("json"))
    return df.select(F.to_json(row).alias("json"))


def _flat(df: DataFrame, whole_score: bool) -> list[Column]:
    for name, kind in df.dtypes:
        if kind.startswith(("array", "map", "struct")):
            raise ValueError(f"column {name} isn't flat")
    return [F.col(c).cast("long").alias(c) if whole_score and c == "score" else F.col(f"`{c}`") for c in df.columns]


def as_csv(df: DataFrame, whole_score: bool = True) -> DataFrame:
    """``line``: rows as CSV; a frequency score is a whole number. Nested columns (snippets, explanations) can't be written."""
    return df.select(F.to_csv(F.struct(*_flat(df, whole_score))).alias("line"))


def write_csv(df: DataFrame, path: str, whole_score: bool = True) -> None:
    df.select(*_flat(df, whole_score)).write.option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def call_id(method: str, corpus: str, version: str, parameters: dict, kind: str = "json") -> str:
    """SHA-256 of all that a result depends on."""
    return hashlib.sha256(json.dumps([method, corpus, version, parameters, kind], sort_keys=True, default=str).encode()).hexdigest()


@dataclass
class Status:
    started: float = field(default_factory=time.time)
    finished: float | None = None
    error: str | None = None

    @property
    def elapsed(self) -> float:
        return (self.finished or time.time()) - self.started


class TooLong(RuntimeError):
    pass


class TooLarge(RuntimeError):
    pass


class ResultCache:
    """Results by call id in the shared folder; calls with one id at one time wait for the first."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or f"{shared_dir(spark)}/results"
        self._locks: dict[str, threading.Lock] = {}
        self._guard = threading.Lock()
        self.status: dict[str, Status] = {}

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def get(self, key: str, compute: Callable[[], DataFrame], force: bool = False) -> DataFrame:
        with self._guard:
            lock = self._locks.setdefault(key, threading.Lock())
        with lock:
            path = f"{self.folder}/{key}"
            if force or not self._exists(path):
                status = self.status[key] = Status()
                try:
                    compute().write.mode("overwrite").parquet(path)
                except Exception as x:
                    status.error = str(x)
                    raise
                finally:
                    status.finished = time.time()
            return self.spark.read.parquet(path)


def limited_size(df: DataFrame, most_bytes: int = 100 << 20) -> DataFrame:
    """``df`` if its rows as JSON hold no more than so many bytes, which is counted where the rows are."""
    size = as_json(df).agg(F.coalesce(F.sum(F.octet_length("json")), F.lit(0))).first()[0]
    if size > most_bytes:
        raise TooLarge(f"{size} bytes of at most {most_bytes}")
    return df


def within(spark: SparkSession, seconds: float, action: Callable[[], object]) -> object:
    """The action's result; its jobs are cancelled after so many seconds (-1: never)."""
    if seconds < 0:
        return action()
    group = f"textloom-{time.time_ns()}"
    spark.sparkContext.setJobGroup(group, "timed", interruptOnCancel=True)
    late = threading.Event()

    def cancel() -> None:
        late.set()
        spark.sparkContext.cancelJobGroup(group)

    timer = threading.Timer(seconds, cancel)
    timer.start()
    try:
        return action()
    except Exception as x:
        if late.is_set():
            raise TooLong(f"more than {seconds} s") from x
        raise
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def estimate(df: DataFrame) -> dict:
    """What Spark expects of a plan, without running it."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return {"bytes": int(str(stats.sizeInBytes())), "plan": df._jdf.queryExecution().simpleString()}
