"""Packing by power-of-two decomposition.

A document of n tokens is split, in order, into pieces whose lengths are powers of two: as many of 2^LARGEST as fit, then
one for each bit of the rest, the larger first. Pieces of one length form a bucket, so every training sequence has a length
of its bucket and tokens of one document alone, nothing is padded and nothing is dropped. Splitting needs no shuffle; a
bucket is gathered by the sink (``write_buckets``) or by whatever reads the ``bucket`` column.

Defined results: a null or empty text gives no sequence; a text of any length is tokenised whole; repeated rows give the
same sequences each; a null doc_id stays null; an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, text_slices
from .tokens import VOCABULARY, tokenizer

#: The longest sequence has 2^LARGEST tokens.
LARGEST = 13
SEQUENCES = "doc_id long, piece int, start long, bucket int, length int, ids binary"
_GROUP_CHARS = 1 << 21


def pieces(n_tokens: np.ndarray, largest: int = LARGEST) -> tuple[np.ndarray, np.ndarray]:
    """The exponents of all pieces, document after document, and how many each document has."""
    exponents = np.arange(largest, -1, -1)
    counts = (n_tokens[:, None] >> exponents) & 1
    counts[:, 0] = n_tokens >> largest
    return np.repeat(np.tile(exponents, len(n_tokens)), counts.ravel()), counts.sum(1)


def text_groups(texts: list[str | None], chars: int = _GROUP_CHARS) -> Iterator[tuple[int, int]]:
    at = held = 0
    for k, t in enumerate(texts):
        held += len(t) if t else 0
        if held >= chars:
            yield at, k + 1
            at, held = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _packed(vocabulary: str, largest: int):
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocabulary).encode
        for batch in batches:
            for a, texts in text_slices(batch.column("text"), _GROUP_CHARS):
                ids, starts = encode(texts)
                exponents, counts = pieces(np.diff(starts), largest)
                if not len(exponents):
                    continue
                lengths = np.left_shift(1, exponents)
                ends = np.cumsum(lengths)
                of = np.repeat(np.arange(a, a + len(texts)), counts)
                first = np.cumsum(counts) - counts
                offsets = pa.array(np.append(0, ends) * ids.itemsize, pa.int64()).buffers()[1]
                rows = pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(of)),
                        pa.array((np.arange(len(of)) - np.repeat(first, counts)).astype(np.int32)),
                        pa.array(ends - lengths - starts[of - a]),
                        pa.array(exponents.astype(np.int32)),
                        pa.array(lengths.astype(np.int32)),
                        pa.Array.from_buffers(pa.large_binary(), len(of), [None, offsets, pa.py_buffer(np.ascontiguousarray(ids))]).cast(pa.binary()),
                    ],
                    ["doc_id", "piece", "start", "bucket", "length", "ids"],
                )
                yield rows.take(pa.array(np.argsort(exponents, kind="stable")))  # a batch holds its buckets one after another

    return frugal(packed)


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, largest: int = LARGEST) -> DataFrame:
    """A row for each sequence: its document, its place there, its bucket (the exponent) and its token ids (little-endian,
    two bytes each, four where the vocabulary has more than 65,536 ids)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_packed(vocabulary, largest), SEQUENCES)


def write_buckets(sequences: DataFrame, path: str) -> None:
    """A folder for each bucket, so that a reader of one length opens no other."""
    sequences.write.partitionBy("bucket").parquet(path)


def unpack(sequences: DataFrame) -> DataFrame:
    """``doc_id, ids``: each document's ids put together again."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("start", "ids"))), lambda x: x["ids"])
    return sequences.groupBy("doc_id").agg(F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"))
