"""Source weights, sequences, planes: totals and expectations, exact round trips."""

import math
import random
import subprocess
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

from textloom.llm import mixing, packing, planes, tokens
from textloom.llm.tokens import tokenizer


@pytest.fixture(scope="module")
def encoder() -> tiktoken.Encoding:
    return tokenizer().encoder


# ---------------------------------------------------------------- mixing


def test_pivotal_keeps_sums_and_expectations():
    p = np.random.default_rng(1).random(41)
    draws = np.array([mixing.pivotal(p, np.random.default_rng(k)) for k in range(4000)])
    assert np.allclose(draws.sum(1), p.sum())
    assert (((draws > 0) & (draws < 1)).sum(1) <= 1).all()
    assert np.abs(draws.mean(0) - p).max() < 0.04
    assert (mixing.pivotal(np.array([0.5, 0.5]), np.random.default_rng(0)).sum()) == 1
    assert mixing.pivotal(np.zeros(0), np.random.default_rng(0)).size == 0


def sources():
    return [(k, "word " * (5 + k % 7), "big" if k % 10 else "small") for k in range(3000)]


@pytest.mark.parametrize("bucket_rows", [4096, 8])
def test_totals_are_the_expectation_rounded(frame, bucket_rows):
    docs = frame(sources())
    rates = {r.source: r for r in mixing.source_rates(docs, bucket_rows=bucket_rows).collect()}
    drawn = mixing.drawn_copies(docs, bucket_rows=bucket_rows).collect()
    assert len(drawn) == 3000
    for source, r in rates.items():
        own = [x.copies for x in drawn if x.source == source]
        assert math.floor(r.rate * r.n_docs - 1e-6) <= sum(own) <= math.ceil(r.rate * r.n_docs + 1e-6)
        assert set(own) <= {math.floor(r.rate), math.floor(r.rate) + 1}
    chars = Counter()
    for (_, t, s), n in zip(sources(), (x.copies for x in sorted(drawn, key=lambda x: x.doc_id))):
        chars[s] += len(t) * n
    assert chars["big"] / chars["small"] == pytest.approx(math.sqrt(rates["big"].chars / rates["small"].chars), rel=0.05)


def test_draws_depend_on_seed_alone(frame):
    docs = frame(sources())
    a = sorted(map(tuple, mixing.drawn_copies(docs, bucket_rows=64).collect()))
    assert a == sorted(map(tuple, mixing.drawn_copies(docs.repartition(7), bucket_rows=64).collect()))
    assert a != sorted(map(tuple, mixing.drawn_copies(docs, bucket_rows=64, seed=18).collect()))


def test_given_weights(frame):
    docs = frame([(1, "aaaa", "x"), (2, "bbbb", "x"), (3, "cccc", "y"), (4, "dddd", None), (5, "eeee", "z")])
    got = {r.doc_id: r.copies for r in mixing.drawn_copies(docs, {"x": 0.4, "y": 0.4, None: 0.2}).collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 1, 5: 0}
    assert {r.doc_id: r.copies for r in mixing.drawn_copies(docs, {}).collect()} == dict.fromkeys(range(1, 6), 0)


def test_mixing_odd_rows(frame, odd):
    docs = frame([(i, t, s) for (i, t), s in zip(odd, ["a", "b", None] * 5)] + [(50, None, "empty"), (51, "", "empty")])
    mixed = mixing.mix_sources(docs)
    assert mixed.columns == docs.columns
    times = Counter((r.doc_id, r.text) for r in mixed.collect())
    assert times[None, None] == times[None, "one two"] == times[50, None] == times[51, ""] == 1
    drawn = {(r.doc_id, r.key): r.copies for r in mixing.drawn_copies(docs).collect()}
    assert len(drawn) == len({(i, t) for i, t in odd if i is not None}) + 2
    assert times[7, "one two"] % 2 == 0  # both rows share the outcome
    assert mixing.mix_sources(frame([])).count() == 0


# ---------------------------------------------------------------- packing


def test_sequences_against_the_encoder(spark, data, encoder):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    sequences = packing.pack(docs, largest=9).collect()
    by = {}
    for s in sequences:
        assert s.length == 1 << s.bucket == len(s.ids) // 2
        by.setdefault(s.doc_id, []).append(s)
    for i, t in texts.items():
        ids, own = encoder.encode_ordinary(t), sorted(by.get(i, []), key=lambda s: s.start)
        assert [x for s in own for x in np.frombuffer(s.ids, np.uint16)] == ids
        assert [s.piece for s in own] == list(range(len(own)))
        n, want = len(ids), [9] * (len(ids) >> 9)
        want += [k for k in range(8, -1, -1) if n >> k & 1]
        assert [s.bucket for s in own] == want
    whole = {r.doc_id: bytes(r.ids) for r in packing.unpack(packing.pack(docs)).collect()}
    assert whole == {i: np.array(e, np.uint16).tobytes() for i, t in texts.items() if (e := encoder.encode_ordinary(t))}


def test_packing_odd_rows(frame, odd, encoder):
    found = packing.pack(frame(odd)).collect()
    assert {s.doc_id for s in found} == {3, 4, 5, 6, 7, None, 8, 10}
    assert sum(s.length for s in found if s.doc_id == 5) == len(encoder.encode_ordinary(odd[4][1])) and max(s.bucket for s in found) == packing.LARGEST
    assert len([s for s in found if s.doc_id == 7]) == 2 * len([s for s in found if s.doc_id == 6])
    assert packing.pack(frame([])).count() == 0


def test_buckets_on_disk(frame, spark, tmp_path):
    packing.write_buckets(packing.pack(frame([(1, "a b c d e f g"), (2, "a b")])), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {r.length for r in back.filter("bucket = 1").collect()} == {2}


_HELD = """
import ctypes, gc, io, random, re
import pyarrow as pa
from textloom.llm import exact, near, packing

def held():
    gc.collect()
    return int(re.search(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

def batches(n):
    rng = random.Random(n)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(30_000)]
    for _ in range(n):
        texts = [" ".join(rng.choices(words, k=100)) for _ in range(8_000)]
        rows = pa.RecordBatch.from_arrays([pa.array(range(8_000)), pa.array(range(8_000)), pa.array(texts)], ["doc_id", "key", "text"])
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, rows.schema) as stream:
            stream.write_batch(rows)
        yield out.getvalue().to_pybytes()

def task(given):
    for data in given:  # a copy in Arrow's memory, as from a socket
        yield from pa.ipc.open_stream(pa.PythonFile(io.BytesIO(data), "r"))

given = list(batches(2))
for worker in (packing._packed(packing.VOCABULARY, 13), exact._recipes, exact._chunks, near._sketched):
    for _ in worker(x.slice(0, 50) for x in task(given)):  # tables and modules are loaded once
        pass
    pa.default_memory_pool().release_unused()
    ctypes.CDLL(None).malloc_trim(0)
    before = held()
    for rows in worker(task(given)):
        del rows
    print(held() - before)
"""


def test_idle_workers_hold_little():
    """What a task of a worker used, two batches of 6 MB of text here, goes back to the system: idle workers count for their executor."""
    out = subprocess.run([sys.executable, "-c", _HELD], capture_output=True, text=True, check=True)
    packed, *others = map(float, out.stdout.split())
    assert packed < 37 and max(others) < 14, out.stdout  # packing keeps the pieces it knows


def test_texts_are_strings_a_group_at_a_time(monkeypatch, encoder):
    monkeypatch.setattr(packing, "_GROUP_CHARS", 100)
    texts = [f"text number {i} é" if i % 7 else None for i in range(60)] + ["long " * 50, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    found = list(packing._packed(packing.VOCABULARY, 13)(iter([batch])))
    assert len(found) > 10
    ids = {}
    for s in sorted((r for b in found for r in b.to_pylist()), key=lambda r: (r["doc_id"], r["piece"])):
        ids.setdefault(s["doc_id"], []).extend(np.frombuffer(s["ids"], np.uint16).tolist())
    assert ids == {i: e for i, t in enumerate(texts) if (e := encoder.encode_ordinary(t or ""))}


def test_ids_after_the_cache_was_cleared(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 2)
    own = tokens.Tokenizer()
    rng = random.Random(4)
    for n in (4000, 9000):  # the second text has more ids than the first had when the cache is cleared
        text = " ".join("".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(n))
        assert own.encode([text])[0].tolist() == own.encoder.encode_ordinary(text)


# ---------------------------------------------------------------- planes


@pytest.mark.parametrize("kind", ["bit", "byte"])
@pytest.mark.parametrize("dtype", [np.uint16, np.uint32])
@pytest.mark.parametrize("n", [1, 7, 8, 1000])
def test_planes_of_a_block(kind, dtype, n):
    ids = np.random.default_rng(n).integers(0, 50_000, n).astype(dtype)
    rows = planes.split_planes(ids, kind)
    assert len(rows) == ids.itemsize * (8 if kind == "bit" else 1)
    assert (planes.join_planes([r.tobytes() for r in rows], n, ids.itemsize, kind) == ids).all()


@pytest.mark.parametrize("kind", ["bit", "byte"])
@pytest.mark.parametrize("block", [64, planes.BLOCK_IDS])
def test_planes_round_trip(frame, odd, encoder, kind, block):
    rows = [r for r in odd if r[0] != 5] + [(60, "some longer text " * 100)]
    blocks = planes.encode_planes(frame(rows).repartition(2), kind, block_ids=block)
    got = Counter((r.doc_id, bytes(r.ids)) for r in planes.decode_planes(blocks).collect())
    assert got == Counter((i, np.array(encoder.encode_ordinary(t or ""), np.uint16).tobytes()) for i, t in rows)
    assert all(r.n_ids <= block for r in blocks.collect())
    assert planes.encode_planes(frame([]), kind).count() == 0


def test_chunk_index_finds_planes(spark, data):
    blocks = planes.encode_planes(spark.read.parquet(f"{data}/documents.parquet"), block_ids=4096)
    rows, index = blocks.collect(), planes.chunk_index(blocks).collect()
    shards = {}
    for r in sorted(rows, key=lambda r: (r.shard, r.block)):
        shards[r.shard] = shards.get(r.shard, b"") + bytes(r.planes)
    for i in index:
        r = next(x for x in rows if (x.shard, x.block) == (i.shard, i.block))
        begin = 0 if i.plane == 0 else r.plane_ends[i.plane - 1]
        assert shards[i.shard][i.begin : i.end] == bytes(r.planes)[begin : r.plane_ends[i.plane]]


def test_long_text_spans_blocks(frame, encoder):
    text = "alpha beta gamma " * 30_000
    blocks = planes.encode_planes(frame([(1, text), (2, "x")]).coalesce(1), block_ids=1 << 12)
    got = {r.doc_id: bytes(r.ids) for r in planes.decode_planes(blocks).collect()}
    assert got[1] == np.array(encoder.encode_ordinary(text), np.uint16).tobytes() and blocks.count() > 10
