"""Token ids as bit or byte planes, compressed by zstandard, with a chunk index.

A task's token ids form one stream (a shard), cut into blocks of BLOCK_IDS ids. In a block the k-th bits (or bytes) of all
ids stand together as plane k; each plane is compressed by itself, so high planes, which hardly change, shrink to little. A
row is a block: the compressed planes one after another, where each ends (the chunk index), where the block begins in its
shard's bytes and ids, and which documents' ids it holds. A block can be read without any other.

Defined results: a null or empty text is an entry without ids; a document longer than a block continues in the next ones;
repeated rows are entries of their own (``row`` tells them apart); a null doc_id stays null; an empty table gives no block;
other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packing import text_groups
from .tokens import VOCABULARY, tokenizer

BLOCK_IDS = 1 << 16
LEVEL = 3
ENTRY = "struct<doc_id:long,row:long,begin:int,end:int,doc_offset:long>"
BLOCKS = f"shard int, block int, first_id long, n_ids int, id_bytes int, kind string, byte_offset long, plane_ends array<int>, planes binary, entries array<{ENTRY}>"


def split_planes(ids: np.ndarray, kind: str) -> np.ndarray:
    """A row for each plane: ``kind`` "byte" or "bit"."""
    octets = ids.view(np.uint8).reshape(len(ids), ids.itemsize)
    if kind == "byte":
        return np.ascontiguousarray(octets.T)
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")


def join_planes(planes: list[bytes], n: int, id_bytes: int, kind: str) -> np.ndarray:
    """The ids of ``split_planes``."""
    rows = np.frombuffer(b"".join(planes), np.uint8).reshape(len(planes), -1)
    if kind == "bit":
        bits = np.unpackbits(rows, axis=1, count=n, bitorder="little")
        octets = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    else:
        octets = np.ascontiguousarray(rows.T)
    return octets.reshape(-1).view(np.uint16 if id_bytes == 2 else np.uint32)


def decode_block(planes: bytes, plane_ends: list[int], n_ids: int, id_bytes: int, kind: str) -> np.ndarray:
    reader = zstandard.ZstdDecompressor()
    begins = [0, *plane_ends[:-1]]
    return join_planes([reader.decompress(planes[a:b]) for a, b in zip(begins, plane_ends)], n_ids, id_bytes, kind)


def _encoded(vocabulary: str, kind: str, block_ids: int, level: int):
    fields = pa.struct([("doc_id", pa.int64()), ("row", pa.int64()), ("begin", pa.int32()), ("end", pa.int32()), ("doc_offset", pa.int64())])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, press = tokenizer(vocabulary).encode, zstandard.ZstdCompressor(level=level)
        shard = TaskContext.get().partitionId() if TaskContext.get() else 0
        waiting: list[np.ndarray] = []
        entries: list[tuple] = []  # id, row, begin and end in the ids that wait, offset in the document
        held = row = block = offset = 0

        def block_of(ids: np.ndarray, own: list[tuple]) -> pa.RecordBatch:
            nonlocal block, offset
            chunks = [press.compress(p.tobytes()) for p in split_planes(ids, kind)]
            ends, data = np.cumsum([len(x) for x in chunks]).astype(np.int32), b"".join(chunks)
            columns = list(zip(*own)) if own else [[]] * 5
            entry = pa.StructArray.from_arrays([pa.array(list(c), t.type) for c, t in zip(columns, fields)], fields=list(fields))
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([block * block_ids], pa.int64()), pa.array([len(ids)], pa.int32()), pa.array([ids.itemsize], pa.int32()),
                    pa.array([kind]), pa.array([offset], pa.int64()), pa.array([ends.tolist()], pa.list_(pa.int32())), pa.array([data], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(entry)], pa.int32()), entry),
                ],
                ["shard", "block", "first_id", "n_ids", "id_bytes", "kind", "byte_offset", "plane_ends", "planes", "entries"],
            )
            block, offset = block + 1, offset + len(data)
            return out

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal waiting, entries, held
            ids = np.concatenate(waiting) if waiting else np.zeros(0, np.uint16)
            at, k = 0, 0
            while len(ids) - at >= block_ids or (last and (at < len(ids) or k < len(entries))):
                to = min(len(ids), at + block_ids)
                own = []
                while k < len(entries) and (entries[k][2] < to or last and to == len(ids)):
                    doc, n, begin, end, skip = entries[k]
                    own.append((doc, n, max(begin, at) - at, min(end, to) - at, skip + max(begin, at) - begin))
                    if end > to:
                        break
                    k += 1
                yield block_of(ids[at:to], own)
                at = to
            waiting, held = [ids[at:]], len(ids) - at
            entries = [(doc, n, max(begin, at) - at, end - at, skip + max(begin, at) - begin) for doc, n, begin, end, skip in entries[k:]]

        for batch in batches:
            texts, names = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for a, b in text_groups(texts):
                ids, starts = encode([t or "" for t in texts[a:b]])
                entries += zip(names[a:b], range(row, row + b - a), (starts[:-1] + held).tolist(), (starts[1:] + held).tolist(), [0] * (b - a))
                row += b - a
                waiting.append(ids)
                held += len(ids)
                if held >= block_ids:
                    yield from cut(False)
        yield from cut(True)

    return encoded


def encode_planes(docs: DataFrame, kind: str = "byte", vocabulary: str = VOCABULARY, block_ids: int = BLOCK_IDS, level: int = LEVEL) -> DataFrame:
    """The documents' token ids as compressed blocks (see BLOCKS)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encoded(vocabulary, kind, block_ids, level), BLOCKS)


def chunk_index(blocks: DataFrame) -> DataFrame:
    """A row for each plane of each block: where its bytes lie in the shard when its blocks are put one after another."""
    ends = F.posexplode("plane_ends").alias("plane", "end")
    rows = blocks.select("shard", "block", "first_id", "n_ids", "byte_offset", "plane_ends", ends)
    begin = F.when(F.col("plane") == 0, 0).otherwise(F.expr("plane_ends[plane - 1]"))
    return rows.select("shard", "block", "plane", "first_id", "n_ids", (F.col("byte_offset") + begin).alias("begin"), (F.col("byte_offset") + F.col("end")).alias("end"))


def decode_planes(blocks: DataFrame) -> DataFrame:
    """``doc_id, shard, row, ids``: every document's ids, little-endian bytes, put together from its blocks."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = decode_block(r["planes"], r["plane_ends"], r["n_ids"], r["id_bytes"], r["kind"]) if r["n_ids"] else np.zeros(0, np.uint16)
                own = r["entries"]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([e["doc_id"] for e in own], pa.int64()), pa.array([r["shard"]] * len(own), pa.int32()), pa.array([e["row"] for e in own], pa.int64()),
                        pa.array([e["doc_offset"] for e in own], pa.int64()), pa.array([ids[e["begin"] : e["end"]].tobytes() for e in own], pa.binary()),
                    ],
                    ["doc_id", "shard", "row", "doc_offset", "ids"],
                )

    parts = blocks.mapInArrow(decoded, "doc_id long, shard int, row long, doc_offset long, ids binary")
    return parts.groupBy("doc_id", "shard", "row").agg(joined(F.collect_list(F.struct("doc_offset", "ids"))).alias("ids"))


def joined(parts: Column) -> Column:
    """The ``ids`` of ``struct<place, ids>`` in order of place."""
    return F.aggregate(F.transform(F.array_sort(parts), lambda x: x["ids"]), F.lit(b""), lambda a, x: F.concat(a, x))
