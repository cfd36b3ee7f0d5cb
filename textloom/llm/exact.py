"""Exact duplicates by content-defined chunk recipes.

A text's bytes are cut where a rolling hash of the last WINDOW bytes hits a mask, so equal passages give equal chunks
wherever they stand. A document's recipe is its ordered list of chunk hashes; only a 128-bit summary of it and the length
move through the first shuffle. Documents whose summaries meet are chunked again, their chunks are deduplicated by hash
and bytes, and a chunk's verified identifier is its hash with its rank among the different byte strings that have this
hash (rank 0 but for a collision). Documents are copies if their ordered lists of verified identifiers are equal, which
is to say: if their texts are. A long document's bytes move at most once, and only if another has its recipe.

Defined results: a null text is nobody's copy; empty texts are copies of each other; a row with a null doc_id can't be
named and takes no part (it stays); rows repeated with their doc_id are copies of which one stays, and are named once;
an empty table gives an empty result; other columns take no part in the comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_by, frugal, keep_by, one_of_repeated, settle, span_hashes, text_slices

WINDOW = 16
#: A chunk has about MASK + 1 bytes on average, at least MIN_CHUNK and at most MAX_CHUNK.
MASK, MIN_CHUNK, MAX_CHUNK = 0x3FF, 256, 8192

_GEAR = np.random.default_rng(0x5EED).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all chunks of the texts ``data[starts[k]:starts[k + 1]]``, and how many chunks each has.

    Where a text is cut depends on its own bytes alone."""
    n = len(data)
    rolling = np.zeros(n, np.uint32)
    gear = _GEAR[data]
    for k in range(min(WINDOW, n)):  # the last WINDOW bytes, the newest weighing least
        rolling[k:] += gear[: n - k] << np.uint32(k) if k else gear
    marks = np.flatnonzero((rolling & np.uint32(MASK << 6)) == 0) + 1
    ends: list[int] = []
    counts = np.zeros(len(starts) - 1, np.int64)
    lows = np.searchsorted(marks, starts[:-1] + WINDOW)  # a window must lie inside its text
    highs = np.searchsorted(marks, starts[1:])
    for k, (begin, end) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
        before, at = len(ends), begin
        for mark in marks[lows[k] : highs[k]].tolist():
            while mark - at > MAX_CHUNK:
                at += MAX_CHUNK
                ends.append(at)
            if mark - at >= MIN_CHUNK and mark < end:
                ends.append(mark)
                at = mark
        while end - at > MAX_CHUNK:
            at += MAX_CHUNK
            ends.append(at)
        if end > at:
            ends.append(end)
        counts[k] = len(ends) - before
    return np.asarray(ends, np.int64), counts


def _chunked(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes, and their chunks' begins, ends and number per text."""
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    joined = b"".join(encoded)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) for x in encoded], out=starts[1:])
    data = np.frombuffer(joined, np.uint8)
    ends, counts = cuts(data, starts)
    begins = np.empty_like(ends)
    begins[1:] = ends[:-1]
    if len(ends):
        begins[0] = 0
    return joined, begins, ends, counts


@frugal
def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = np.zeros((3, len(batch)), np.int64)
        for a, texts in text_slices(batch.column("text")):
            b = a + len(texts)
            joined, begins, ends, counts = _chunked(texts)
            hashes = span_hashes(np.frombuffer(joined, np.uint8), begins, ends)
            at = np.zeros(b - a + 1, np.int64)
            np.cumsum(counts, out=at[1:])
            out[0, a:b] = span_hashes(hashes, at[:-1], at[1:]).view(np.int64)
            out[1, a:b] = span_hashes(hashes >> np.uint64(17) ^ hashes * np.uint64(0x9E3779B97F4A7C15), at[:-1], at[1:]).view(np.int64)
            out[2, a:b] = counts
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *map(pa.array, out)], ["doc_id", "key", "r1", "r2", "n_chunks"])


@frugal
def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, texts in text_slices(batch.column("text")):
            joined, begins, ends, counts = _chunked(texts)
            hashes = span_hashes(np.frombuffer(joined, np.uint8), begins, ends).view(np.int64)
            of = pa.array(np.repeat(np.arange(a, a + len(texts)), counts))
            at = np.concatenate([np.arange(n) for n in counts.tolist()] or [np.zeros(0, np.int64)])
            offsets = pa.array(np.append(begins, len(joined)), pa.int64()).buffers()[1]
            pieces = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, offsets, pa.py_buffer(joined)]).cast(pa.binary())
            ids = [batch.column(c).take(of) for c in ("doc_id", "key")]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(at), pa.array(hashes), pieces], ["doc_id", "key", "seq", "hash", "chunk"])


def recipes(docs: DataFrame) -> DataFrame:
    """``doc_id, key, r1, r2, n_chunks``: the summary of each document's chunk list. Rows without text or id have none."""
    rows = docs.filter("text is not null and doc_id is not null").select("doc_id", F.xxhash64("text").alias("key"), "text")
    return rows.mapInArrow(_recipes, "doc_id long, key long, r1 long, r2 long, n_chunks long")


def verified_identifiers(chunks: DataFrame) -> DataFrame:
    """A settled ``doc_id, key, seq, hash, chunk`` with a verified identifier for the bytes: ``doc_id, key, seq, hash, rank``.

    One shuffle holds each different chunk once. Bytes are compared wherever hashes are equal; only if some hash stands
    for two byte strings are its chunks ranked and joined."""
    different = chunks.select("hash", "chunk").distinct()
    collided = settle(different.groupBy("hash").count().filter("count > 1").select("hash"), "collided")
    plain = chunks.select("doc_id", "key", "seq", "hash", F.lit(0).alias("rank"))
    if collided.isEmpty():
        return plain
    odd = chunks.join(collided, "hash", "left_semi")
    ranks = odd.select("hash", "chunk").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("hash").orderBy("chunk")))
    return plain.join(collided, "hash", "left_anti").unionByName(odd.join(ranks, ["hash", "chunk"]).select("doc_id", "key", "seq", "hash", "rank"))


def _groups(docs: DataFrame) -> DataFrame:
    """``doc_id, key, first_id, copies, times`` of each document that has copies; ``times`` a row stands in the table."""
    docs = docs.select("doc_id", "text")
    summary = settle(recipes(docs), "recipes")
    recipe = ["r1", "r2", "n_chunks"]
    shared = summary.groupBy(recipe).count().filter("count > 1").select(recipe)
    wanted = settle(summary.join(shared, recipe, "left_semi").groupBy("doc_id", "key").agg(F.count("*").alias("times")), "wanted")
    found = keep_by(docs.filter("text is not null"), wanted).select("doc_id", F.xxhash64("text").alias("key"), "text")
    chunks = settle(found.mapInArrow(_chunks, "doc_id long, key long, seq long, hash long, chunk binary"), "chunks")
    listed = verified_identifiers(chunks).groupBy("doc_id", "key").agg(F.sort_array(F.collect_set(F.struct("seq", "hash", "rank"))).alias("list"))
    # an empty text has no chunks: its list is empty
    lists = wanted.join(listed, ["doc_id", "key"], "left").withColumn("list", F.coalesce("list", F.expr("cast(array() as array<struct<seq:long,hash:long,rank:int>>)")))
    lists = settle(lists.withColumn("sum", F.xxhash64("list")), "lists")
    groups = lists.groupBy("sum", "list").agg(F.min("doc_id").alias("first_id"), F.sum("times").alias("copies")).filter("copies > 1")
    return lists.join(groups, ["sum", "list"]).select("doc_id", "key", "times", "first_id", "copies")


def exact_copies(docs: DataFrame) -> DataFrame:
    """``doc_id, first_id, copies, is_copy`` of each document that has copies: the least doc_id of its group, the rows in
    the group, and whether another document stands for it."""
    return _groups(docs).select("doc_id", "first_id", "copies", (F.col("doc_id") != F.col("first_id")).alias("is_copy"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, that with the least doc_id, and every row without a copy."""
    groups = settle(_groups(docs), "copies")
    kept = drop_by(docs, groups.filter("doc_id != first_id").select("doc_id", "key"))
    return one_of_repeated(kept, groups.filter("doc_id = first_id and times > 1").select("doc_id", "key"))
