"""Helpers shared by the training-data operators: shared-folder tables, batch text arrays, hashing."""

from __future__ import annotations

import ctypes
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.store import written

#: Texts are handled in slices of about so many characters, so that the arrays of a slice stay near the cache.
SLICE_CHARS = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the folder that all executors share and read it back: lineage ends there, so a lost executor costs
    nothing but its running tasks. Tables are deleted when the application ends."""
    return written(df, label)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores put before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


# ---------------------------------------------------------------- text as arrays


def _is_space(c: int) -> bool:
    return c in (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000) or 0x2000 <= c <= 0x200A


LETTER, NUMBER, OTHER, SPACE = 1, 2, 0, 3


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point, as regular expressions have them: letter, number, white space, other."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        out[c] = LETTER if k == "L" else NUMBER if k == "N" else OTHER
    for c in range(0x3001):
        if _is_space(c):
            out[c] = SPACE
    return out


@lru_cache(1)
def word_table() -> np.ndarray:
    """Lower-case code point of every letter, digit or mark; 0 for whatever ends a word."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] in "LNM":
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points, each text followed by a line feed, and the texts' starts (one more than texts)."""
    joined = "\n".join(texts) + "\n"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return cp, starts


def slices(texts: list[str | None], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about ``most`` characters each; a longer text is a range of its own."""
    at, chars = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if chars and chars + n > most:
            yield at, i
            at, chars = i, 0
        chars += n
    if at < len(texts):
        yield at, len(texts)


def text_slices(column: pa.Array, most: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """The texts of a column (null as empty), about ``most`` bytes at a time, each time with the place of the first."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, [t or "" for t in column.slice(a, b - a).to_pylist()]
        a = b


# ---------------------------------------------------------------- memory of workers


@lru_cache(1)
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim  # of glibc alone
    except (AttributeError, OSError, TypeError):
        return None


def hand_back() -> None:
    """Give memory that is free in this process back to the system. Spark keeps idle workers, several for each core once a
    task had more than one, and what allocators of a worker hold counts for its executor."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def frugal(worker: Callable) -> Callable:
    """``worker``, a function from Arrow batches to Arrow batches, that hands back free memory after each batch it took and at its end."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            del batch
            hand_back()

    @wraps(worker)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from worker(each(batches))
        finally:
            hand_back()

    return run


# ---------------------------------------------------------------- hashes


BASE = 0x9E3779B97F4A7C15 | 1
_inverse = pow(BASE, -1, 1 << 64)


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_Powers.up) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("up", BASE), ("down", _inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            setattr(_Powers, name, np.multiply.accumulate(steps))
    return _Powers.up[:n], _Powers.down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each ``values[start:end]``, from one running sum."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (letters, digits and marks, lower case) of the texts, and where each text's words begin."""
    cp, starts = code_points(texts)
    low = word_table()[cp]
    inside = low != 0
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate(([0], edge))
    begin, end = edge[::2], edge[1::2]  # the closing line feed ends the last word
    return span_hashes(low, begin, end), np.searchsorted(begin, starts)


# ---------------------------------------------------------------- keeping and dropping rows

#: A table of decisions is sent to every executor up to this many rows (of 16 or 24 bytes); beyond it, it is joined in a shuffle.
BROADCAST_ROWS = 500_000


def checked(df: DataFrame) -> DataFrame:
    """A settled table of a few numbers a row, for a join: broadcast up to BROADCAST_ROWS, beyond that hashed in a shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("shuffle_hash")


def with_key(docs: DataFrame) -> DataFrame:
    """``doc_id, key`` of each row: ``key`` tells apart rows that share an id but not a text."""
    return docs.select("doc_id", F.xxhash64("text").alias("key"))


def _by(docs: DataFrame, decided: DataFrame, how: str) -> DataFrame:
    names = {n: free_name(docs, "by_" + n) for n in decided.columns}
    decided = decided.select(*[F.col(n).alias(as_) for n, as_ in names.items()])
    decided = checked(decided)
    same = docs["doc_id"] == decided[names["doc_id"]]
    if "key" in names:
        same &= F.xxhash64(docs["text"]) == decided[names["key"]]
    return docs.join(decided, same, how)


def keep_by(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``decided`` (a settled ``doc_id``, or ``doc_id, key``) names. Rows with a null doc_id are never named."""
    return _by(docs, decided, "left_semi")


def drop_by(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``decided`` doesn't name."""
    return _by(docs, decided, "left_anti")


def one_of_repeated(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """Of rows that repeat both a doc_id and a text that ``decided`` names, the first by their other columns; all other rows."""
    if decided.isEmpty():
        return docs
    rank = free_name(docs, "rank")
    window = Window.partitionBy("doc_id", "text").orderBy(*[F.col(f"`{c}`").cast("string") for c in docs.columns])
    once = keep_by(docs, decided).withColumn(rank, F.row_number().over(window)).filter(F.col(rank) == 1).drop(rank)
    return drop_by(docs, decided).unionByName(once)
