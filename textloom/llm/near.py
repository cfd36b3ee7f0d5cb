"""Near duplicates by a chosen-path set similarity join over MinHash coordinates.

A document is the set of its word SHINGLE-grams (case and punctuation aside); two are near duplicates if the Jaccard
similarity of their sets is THRESHOLD or more. COORDINATES minwise tokens stand for a set. Independent trees branch
recursively: a root chooses one coordinate, a node within BRANCHES of them, and the documents that agree in one go to the same
child. With three branches a pair at a threshold of a half stays together in some child with a probability that doesn't fall
with depth (``survival``), so the number of roots follows from RECALL, whatever the depth; dissimilar pairs part. A node of
SMALL documents or fewer is compared exhaustively, and one that a chosen coordinate doesn't split too, since such a pair may
agree in nothing else; one of up to MOST_ROWS is branched inside its task. A larger one is branched by a further shuffle, and if
that leaves more than half of it in a child, that is cut into blocks, each pair of blocks a node of MOST_ROWS at most, so all its
documents meet and no node has to fit anywhere. Two blocks of documents that are known to be linked don't meet.

Comparisons estimate similarity with a margin (MARGIN), and every link is then verified on the whole sets, in rounds: first
stars, of the documents of each large node that look alike to one of PIVOTS of them; then, of the pairs that look clearly alike,
spanning forests, and of the others FEW between any two groups that verified links connect so far; last, where there were more,
all whose ends are still apart. Families of documents that are half alike thus take about as many links as documents. No number
of partners is capped. Documents with equal sets are one from the start. Links become groups by alternating large and small
stars, each round written to the shared folder.

``links`` of a document are counted within its group, where all sets meet in blocks: every other document whose set is at
THRESHOLD or more, whether the join had found the pair or not. Copies count each.

What may be missed: a pair that shares no root and branch (1 - RECALL at the threshold, less above it), and one whose estimate
is MARGIN below the threshold while it is at it (2.4 standard deviations of 64 coordinates: 1 of 100 pairs at the threshold
exactly, next to none 0.05 above it). Groups lose by it only what no other path connects.

Defined results: a text without words, a null text and a null doc_id take no part (their rows stay); a text of fewer words
than SHINGLE is one shingle; texts are read whole; rows that repeat a doc_id are one document, of which equal rows stay
once; ties go to the least doc_id; an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked, drop_by, frugal, keep_by, mix, one_of_repeated, settle, span_hashes, text_slices, with_key, words

THRESHOLD = 0.5
SHINGLE = 3
COORDINATES = 64
#: Of pairs at the threshold that trees shall bring together.
RECALL = 0.99
BRANCHES = 3
MARGIN = 0.15
#: Estimates this far above the threshold are clear: more than three standard deviations.
CLEAR = 0.2
SMALL = 160
TINY = 12
MOST_ROWS = 100_000
DEEPEST = 24
#: Documents of a large node whose stars are verified first; unclear pairs of two groups in a node that are verified next.
PIVOTS, FEW = 4, 4
#: Pairs of a node that are judged in one part, about.
PAIRS_TOGETHER = 20_000
#: 32-bit hashes of the sets in one of the blocks in which links are counted, about; documents compared at one time there.
BLOCK_GRAMS, TILE = 1 << 22, 512


def survival(threshold: float = THRESHOLD, branches: int = BRANCHES) -> float:
    """The probability that a pair stays together however deep a tree is: one less the chance that its line dies out."""
    q = 0.0
    for _ in range(10_000):
        q = (1 - threshold + threshold * q) ** branches
    return 1 - q


#: A root agrees with probability THRESHOLD; so many of them reach RECALL.
ROOTS = math.ceil(math.log(1 - RECALL) / math.log(1 - THRESHOLD * survival()))

_rng = np.random.default_rng(0xC405E)
_XOR = _rng.integers(0, 1 << 32, COORDINATES, dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 31, COORDINATES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
#: The coordinates that the roots choose.
_ROOT = np.concatenate([_rng.permutation(COORDINATES) for _ in range(1 + ROOTS // COORDINATES)])[:ROOTS]
_ROOT_SALT = _rng.integers(0, 1 << 63, ROOTS, dtype=np.uint64)

SKETCH = "doc_id long, sig binary, nodes array<long>, grams binary, f1 long, f2 long"


# ---------------------------------------------------------------- sets and coordinates


def shingle_sets(texts: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The texts' different shingles as 32-bit hashes, sorted within each text, and where each text's begin."""
    hashes, starts = words(texts)
    n = np.diff(starts)
    of = np.repeat(np.arange(len(texts)), n)
    short = n < size
    gram = hashes.copy()
    last = len(hashes)
    for k in range(1, size):
        gram[: last - k] = gram[: last - k] * np.uint64(0x9FB21C651E98DF25) + hashes[k:]
    at = np.arange(last) - starts[:-1][of]
    whole = at + size <= n[of]
    if short.any():  # all words of a short text, as one
        whole |= short[of] & (at == 0)
        some = np.flatnonzero(short & (n > 0))
        gram[starts[:-1][some]] = span_hashes(hashes, starts[:-1][some], starts[:-1][some] + n[some])
    keys = np.unique((of[whole].astype(np.uint64) << np.uint64(32)) | (mix(gram[whole]) >> np.uint64(32)))
    begins = np.searchsorted(keys, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(32))
    return keys.astype(np.uint32), begins


def minima(grams: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The minwise token of each coordinate, for sets that aren't empty."""
    out = np.empty((len(begins) - 1, COORDINATES), np.uint32)
    for k in range(COORDINATES):
        out[:, k] = np.minimum.reduceat((grams ^ _XOR[k]) * _MUL[k], begins[:-1])
    return out


@frugal
def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, texts in text_slices(batch.column("text")):
            grams, begins = shingle_sets(texts)
            some = np.flatnonzero(np.diff(begins))
            if not len(some):
                continue
            bounds = np.append(begins[some], len(grams))
            low = minima(grams, bounds)
            sig = ((low * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
            nodes = mix(low[:, _ROOT].astype(np.uint64) + _ROOT_SALT).view(np.int64)
            offsets = pa.array(bounds * 4, pa.int64()).buffers()[1]
            f1 = span_hashes(grams, bounds[:-1], bounds[1:])
            f2 = span_hashes(grams ^ np.uint32(0xA5A5A5A5) * grams, bounds[:-1], bounds[1:])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(some + a)),
                    pa.FixedSizeBinaryArray.from_buffers(pa.binary(COORDINATES), len(some), [None, pa.py_buffer(np.ascontiguousarray(sig))]).cast(pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * nodes.shape[1]), pa.array(nodes.ravel())),
                    pa.Array.from_buffers(pa.large_binary(), len(some), [None, offsets, pa.py_buffer(grams)]).cast(pa.binary()),
                    pa.array(f1.view(np.int64)),
                    pa.array(f2.view(np.int64)),
                ],
                ["doc_id", "sig", "nodes", "grams", "f1", "f2"],
            )


# ---------------------------------------------------------------- the tree


class Forest:
    """Union-find over the rows of a node."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[x] = y
        return x != y


STARS, MOST, REST = range(3)
Pair = tuple[int, int]


def _linking(forest: Forest, i: np.ndarray, j: np.ndarray, alike: np.ndarray, clear: float, step: int) -> tuple[list[Pair], np.ndarray]:
    """The pairs that verification has to see: of clear ones a spanning forest, the most alike first; of the others those that
    clear pairs don't connect, FEW between two groups unless ``step`` is REST. And a row of each pair that is left."""
    sure = np.flatnonzero(alike >= clear)
    sure = sure[np.lexsort((j[sure], i[sure], -alike[sure]))]
    out = [(x, y) for x, y in zip(i[sure].tolist(), j[sure].tolist()) if forest.join(x, y)]
    rest = alike < clear
    i, j, alike = i[rest], j[rest], alike[rest]
    if not len(i):
        return out, i
    rows, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    roots = np.array([forest.root(x) for x in rows.tolist()])[at]
    x, y = roots[: len(i)], roots[len(i) :]
    apart = np.flatnonzero(x != y)
    if step != REST and len(apart):
        low, high = np.minimum(x, y)[apart], np.maximum(x, y)[apart]
        order = np.lexsort((j[apart], i[apart], -alike[apart], high, low))
        low, high = low[order], high[order]
        first = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])))
        rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        few, left = apart[order[rank < FEW]], apart[order[rank >= FEW]]
        return out + list(zip(i[few].tolist(), j[few].tolist())), i[left]
    return out + list(zip(i[apart].tolist(), j[apart].tolist())), i[:0]


def _places(docs: np.ndarray) -> np.ndarray:
    """A few documents, the same ones in any node that has them."""
    return np.argsort(mix(docs.view(np.uint64)), kind="stable")[:PIVOTS]


def _stars(pivots: np.ndarray, pivot_docs: np.ndarray, sig: np.ndarray, docs: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Documents that look alike to a pivot, with it."""
    found = [(d, docs[(sig == p).sum(1) >= least]) for p, d in zip(pivots, pivot_docs)]
    return np.concatenate([np.full(len(x), d) for d, x in found]), np.concatenate([x for _, x in found])


def compare_node(sig: np.ndarray, seed: int, threshold: float = THRESHOLD, group: np.ndarray | None = None, step: int = REST) -> tuple[list[Pair], bool]:
    """Links among the rows of one node, to be verified, and whether some are left for the last round. Rows of one ``group``
    are linked already."""
    least, clear = (threshold - MARGIN) * COORDINATES, min(threshold + CLEAR, 0.97) * COORDINATES
    forest, out = Forest(len(sig)), []
    if group is not None:
        _, first, of = np.unique(group, return_index=True, return_inverse=True)
        forest.up = first[of].tolist()
    found_i, found_j, found_alike = [], [], []
    stack = [(np.arange(len(sig)), 0, seed)]
    while stack:
        rows, depth, seed = stack.pop()
        own = sig[rows]
        n = len(rows)
        if n > SMALL:
            for pivot in range(3):  # those clearly alike the pivot are linked to it
                at = (pivot * 0x9E3779B1 + seed) % n
                near = np.flatnonzero((own == own[at]).sum(1) >= clear)
                if len(near) < 0.05 * n:
                    break
                p = int(rows[at])
                out += [(p, x) for x in rows[near].tolist() if x != p and forest.join(p, x)]
        group = np.array([forest.root(x) for x in rows.tolist()])
        if (group == group[0]).all():
            continue
        if n <= SMALL or depth >= DEEPEST:
            step_rows = max(1, (1 << 22) // (n * COORDINATES))
            for a in range(0, n, step_rows):
                alike = (own[a : a + step_rows, None, :] == own[None, :, :]).sum(2, dtype=np.uint8)
                alike[group[a : a + step_rows, None] == group[None, :]] = 0
                x, y = np.nonzero(alike >= least)
                keep = x + a < y
                found_i.append(rows[x[keep] + a])
                found_j.append(rows[y[keep]])
                found_alike.append(alike[x[keep], y[keep]].astype(np.int64))
            continue
        rng = np.random.default_rng([seed & 0x7FFFFFFF, depth])
        children, whole = [], False
        for c in rng.choice(COORDINATES, BRANCHES, replace=False).tolist():
            order = np.argsort(own[:, c], kind="stable")
            parts = np.split(order, np.flatnonzero(np.diff(own[order, c])) + 1)
            whole |= len(parts) == 1
            children += [(rows[part], depth + 1, (seed * 1000003 + c * 257 + int(own[part[0], c])) & 0x7FFFFFFF) for part in parts if len(part) > 1]
        stack += [(rows, DEEPEST, seed)] if whole else children  # a coordinate in which all agree: nothing may be parted
    more = False
    if found_i:
        links, left = _linking(forest, *map(np.concatenate, (found_i, found_j, found_alike)), clear, step)
        out += links
        more = len(left) > 0
    return out, more


PAIRS = "a long, b long, node long, doc_id long, sig binary, of long, parent long, root long"


def _pairs(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Pairs and, as ``root``, the node they are from."""
    none = pa.nulls(len(a), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), none, none, pa.nulls(len(a), pa.binary()), none, none, pa.array(at)], ["a", "b", "node", "doc_id", "sig", "of", "parent", "root"])


def _passed(place: int, node: np.ndarray, docs: np.ndarray, sig: np.ndarray, of: np.ndarray, parent: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
    """Rows of a node too large for a task, as they are; ``a`` is their place in it, from ``place`` on."""
    n = len(docs)
    sigs = pa.FixedSizeBinaryArray.from_buffers(pa.binary(COORDINATES), n, [None, pa.py_buffer(np.ascontiguousarray(sig))]).cast(pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(np.arange(place, place + n)), pa.nulls(n, pa.int64()), pa.array(node), pa.array(docs), sigs, pa.array(of), pa.array(parent), pa.array(root)], ["a", "b", "node", "doc_id", "sig", "of", "parent", "root"])


def _children(rows: DataFrame) -> DataFrame:
    """The next nodes of rows (node, n, ...): a coordinate for each branch, drawn for the node."""
    start = F.pmod(F.xxhash64("node"), F.lit(COORDINATES)).cast("int")
    branches = F.array(*[F.xxhash64("node", F.lit(k), F.substring(F.col("sig"), F.pmod(start + k * (COORDINATES // BRANCHES), F.lit(COORDINATES)) + 1, F.lit(1))) for k in range(BRANCHES)])
    return rows.select(F.explode(branches).alias("node"), "doc_id", "sig", "of", F.col("n").alias("parent"), "root")


def _block_pairs(rows: DataFrame, most_rows: int) -> DataFrame:
    """Nodes of ``most_rows`` or fewer in which any two rows of a passed node meet that aren't linked: the pairs of its blocks.
    Rows come by group, so most blocks of a large group have no other rows."""
    rows = rows.withColumn("own", F.floor(F.col("a") / (most_rows // 2)))
    blocks = settle(rows.groupBy("node", "own").agg(F.min("of").alias("low"), F.max("of").alias("high")), "blocks")
    x, y = (blocks.select("node", *[F.col(c).alias(side + c) for c in ("own", "low", "high")]) for side in ("x", "y"))
    linked = (F.col("xlow") == F.col("xhigh")) & (F.col("ylow") == F.col("yhigh")) & (F.col("xlow") == F.col("ylow"))
    pairs = x.join(y, "node").filter((F.col("xown") < F.col("yown")) & ~linked)
    sides = pairs.select(F.col("node"), F.explode(F.array("xown", "yown")).alias("own"), F.xxhash64("node", "xown", "yown").alias("pair"))
    return rows.join(sides, ["node", "own"]).select(F.col("pair").alias("node"), "doc_id", "sig", "of", F.lit(0).cast("long").alias("parent"), "root")


def _compared(threshold: float, most_rows: int, step: int):
    least, clear = (threshold - MARGIN) * COORDINATES, min(threshold + CLEAR, 0.97) * COORDINATES

    def whole_nodes(node: np.ndarray, docs: np.ndarray, sig: np.ndarray, of: np.ndarray, parent: np.ndarray, root: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        size = np.diff(np.append(first, len(node)))
        if step == STARS:
            for at, n in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist()):
                own = slice(at, at + n)
                p = _places(docs[own]) + at
                a, b = _stars(sig[p], docs[p], sig[own], docs[own], threshold * COORDINATES)
                yield _pairs(a, b, np.full(len(a), node[at]))
            return
        out: list[Pair] = []
        again: list[np.ndarray] = []
        # tiny nodes all at once: each row with the next, the one after it ...
        in_tiny = np.repeat((size > 1) & (size <= TINY), size)
        left = np.repeat(first + size, size) - np.arange(len(node)) - 1
        i, j, alike = [], [], []
        for k in range(1, TINY):
            x = np.flatnonzero(in_tiny & (left >= k))
            if not len(x):
                break
            x = x[of[x] != of[x + k]]
            same = (sig[x] == sig[x + k]).sum(1)
            x, same = x[same >= least], same[same >= least]
            i.append(x)
            j.append(x + k)
            alike.append(same)
        if i:
            forest = Forest(len(node))
            kept = np.flatnonzero(in_tiny)
            _, begin, at = np.unique(np.stack([node[kept], of[kept]]), axis=1, return_index=True, return_inverse=True)
            for x, y in zip(kept.tolist(), kept[begin[at.ravel()]].tolist()):
                forest.up[x] = y
            links, left = _linking(forest, *map(np.concatenate, (i, j, alike)), clear, step)
            out += links
            again.append(root[left])
        for at, n in zip(first[size > TINY].tolist(), size[size > TINY].tolist()):
            own = slice(at, at + n)
            links, more = compare_node(sig[own], int(node[at]) & 0x7FFFFFFF, threshold, of[own], step)
            out += [(at + x, at + y) for x, y in links]
            again += [root[at : at + 1]] if more else []
        if out:
            x, y = np.array(out).T
            yield _pairs(docs[x], docs[y], node[x])
        if again and len(again := np.unique(np.concatenate(again))):
            yield _pairs(np.full(len(again), MORE), np.full(len(again), MORE), again)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        held_rows, open_node, place = 0, None, 0
        pivots = pivot_docs = None

        def passed(place: int, *columns: np.ndarray) -> pa.RecordBatch:
            if step != STARS:
                return _passed(place, *columns)
            a, b = _stars(pivots, pivot_docs, columns[2], columns[1], threshold * COORDINATES)
            return _pairs(a, b, np.full(len(a), open_node))

        for batch in batches:
            if not batch.num_rows:
                continue
            node, docs, *others = (batch.column(c).to_numpy() for c in ("node", "doc_id", "of", "parent", "root"))
            columns = (node, docs, np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(-1, COORDINATES), *others)
            if place:  # the open node is being passed on
                more = int(np.searchsorted(node != open_node, True)) if node[-1] != open_node else len(node)
                if more:
                    yield passed(place, *(c[:more] for c in columns))
                    place += more
                columns = tuple(c[more:] for c in columns)
                node = columns[0]
                if not len(node):
                    continue
                place = 0
            held.append(columns)
            held_rows += len(node)
            tail = len(node) - int(np.searchsorted(node == node[-1], True)) if node[0] != node[-1] else len(node)
            if tail < len(node) or held[0][0][0] != node[0]:  # all but the last node are whole
                columns = tuple(map(np.concatenate, zip(*held)))
                cut = len(columns[0]) - tail
                yield from whole_nodes(*(c[:cut] for c in columns))
                held, held_rows = [tuple(c[cut:] for c in columns)], tail
            if held_rows > most_rows:
                columns = tuple(map(np.concatenate, zip(*held)))
                open_node, place = int(columns[0][0]), len(columns[0])
                p = _places(columns[1])
                pivots, pivot_docs = columns[2][p], columns[1][p]
                yield passed(0, *columns)
                held, held_rows = [], 0
        if held:
            yield from whole_nodes(*map(np.concatenate, zip(*held)))

    return compare


#: Both ends of the pair that says that pairs of a node are left.
MORE = -(1 << 62)
_ENTRY = ["node", "doc_id", "sig", "of", "parent", "root"]


def candidate_links(entries: DataFrame, threshold: float = THRESHOLD, most_rows: int = MOST_ROWS, step: int = REST) -> tuple[DataFrame, DataFrame]:
    """``a, b, at`` (a < b): links to be verified, and a node they are from, of entries (node, doc_id, sig, of: what it is linked
    to, parent: rows of the node before); and the nodes in which some are left."""
    entries = entries.withColumn("root", F.col("node"))
    if most_rows < 2:
        raise ValueError("two rows have to meet in a node: most_rows is 2 at least")
    links = []
    while True:
        found = entries.select(*_ENTRY).repartition("node").sortWithinPartitions("node", "of", "doc_id").mapInArrow(frugal(_compared(threshold, most_rows, step)), PAIRS)
        found = settle(found, "links")
        links.append(found.filter("node is null").select("a", "b", "root"))
        passed = found.filter("node is not null").select("a", *_ENTRY)
        if passed.isEmpty():
            every = reduce(DataFrame.unionByName, links)
            return every.filter("a <> b").groupBy("a", "b").agg(F.min("root").alias("at")), every.filter(F.col("a") == MORE).select(F.col("root").alias("node")).distinct()
        sizes = passed.groupBy("node").agg(F.count("*").alias("n"))
        rows = passed.join(sizes, "node")
        parted = F.col("n") * 2 <= F.col("parent")
        entries = _children(rows.filter(parted)).unionByName(_block_pairs(rows.filter(~parted), most_rows))


# ---------------------------------------------------------------- verification and groups


def jaccards(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """Jaccard similarities of two lists of sorted sets of 32-bit hashes."""
    out = np.zeros(len(x))
    at, held = 0, 0
    for k in range(len(x) + 1):
        if k == len(x) or held > 1 << 21:
            if k > at:
                n = np.array([len(b) // 4 for b in x[at:k]]), np.array([len(b) // 4 for b in y[at:k]])
                both = np.concatenate([np.frombuffer(b, np.uint32) for pair in zip(x[at:k], y[at:k]) for b in pair]).astype(np.uint64)
                both |= np.repeat(np.arange(k - at, dtype=np.uint64), n[0] + n[1]) << np.uint64(32)
                both.sort(kind="stable")
                shared = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(32)).astype(np.int64), minlength=k - at)
                out[at:k] = shared / (n[0] + n[1] - shared)
            at, held = k, 0
        if k < len(x):
            held += len(x[k]) + len(y[k])
    return out


def _judged(threshold: float):
    """Pairs at the threshold, of rows by key: sets (kind 0: a, grams), then pairs (kind 1: a, b)."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, bytes] = {}
        pairs: list[tuple[int, int, bytes, bytes]] = []
        key, size = None, 0

        def judged() -> pa.RecordBatch:
            a, b, x, y = zip(*pairs)
            near = np.flatnonzero(jaccards(list(x), list(y)) >= threshold)
            return pa.RecordBatch.from_arrays([pa.array(np.array(c)[near], pa.int64()) for c in (a, b)], ["a", "b"])

        for batch in batches:
            for k, kind, a, b, grams in zip(*(batch.column(c).to_pylist() for c in ("key", "kind", "a", "b", "grams"))):
                if k != key:
                    key, sets = k, {}
                if kind == 0:
                    sets[a] = grams
                    continue
                pairs.append((a, b, sets[a], sets[b]))
                size += len(sets[a]) + len(sets[b])
                if size > 1 << 23:
                    yield judged()
                    pairs, size = [], 0
        if pairs:
            yield judged()

    return judge


def components(links: DataFrame) -> DataFrame:
    """``doc_id, first_id`` of every document in ``links`` (a, b): the least id that links lead to."""

    def seen(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    links = settle(links.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).select("a", "b").distinct(), "stars")
    before = seen(links)
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        links = settle(small.unionByName(low.select("a", F.col("low").alias("b"))).filter("a > b").distinct(), "stars")
        after = seen(links)
        if after == before:
            break
        before = after
    firsts = links.select(F.col("b").alias("doc_id"), F.col("b").alias("first_id")).distinct()
    return links.select(F.col("a").alias("doc_id"), F.col("b").alias("first_id")).unionByName(firsts)


def _verified(links: DataFrame, own: DataFrame, threshold: float) -> DataFrame:
    """The links at ``threshold`` or more. Pairs of one node are judged together, so that a set is moved once for all of them;
    those of a node with many pairs in parts."""
    links = settle(links, "candidates")
    named = settle(links.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "named")
    sets = settle(keep_by(own.select("doc_id", "grams"), named), "sets")
    parts = links.groupBy("at").agg(F.ceil(F.count("*") / PAIRS_TOGETHER).alias("parts")).filter("parts > 1")  # few: each has many pairs
    keyed = links.join(parts, "at", "left").select(F.xxhash64("at", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1)))).alias("key"), "a", "b")
    keyed = settle(keyed, "keyed")
    needs = keyed.select("key", F.explode(F.array("a", "b")).alias("doc_id")).distinct().join(sets, "doc_id")
    rows = needs.select("key", F.lit(0).alias("kind"), F.col("doc_id").alias("a"), F.lit(None).cast("long").alias("b"), "grams")
    rows = rows.unionByName(keyed.select("key", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("binary").alias("grams")))
    return settle(rows.repartition("key").sortWithinPartitions("key", "kind").mapInArrow(frugal(_judged(threshold)), "a long, b long"), "verified")


def _sketches(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sketches of all documents; of each set's documents but the first, that one; sketches of the sets' first documents."""
    some = docs.filter("doc_id is not null and text is not null").select("doc_id", "text")
    sketches = settle(some.mapInArrow(_sketched, SKETCH), "sketches")
    equal = sketches.groupBy("f1", "f2").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").select("f1", "f2", "first_id")
    equal = settle(sketches.select("doc_id", "f1", "f2").join(checked(settle(equal, "firsts")), ["f1", "f2"]).select("doc_id", "first_id").filter("doc_id <> first_id").distinct(), "equal")
    return sketches, equal, sketches if equal.isEmpty() else drop_by(sketches, equal.select("doc_id"))


def _grouped(own: DataFrame, equal: DataFrame, threshold: float, most_rows: int) -> DataFrame:
    """``doc_id, first_id`` of each document in a group."""
    rows = own.select("doc_id", "sig", "nodes")
    nodes = rows.select(F.explode("nodes").alias("node"))
    large = settle(nodes.groupBy("node").count().filter(F.col("count") > SMALL).select("node"), "large")
    verified, groups = [equal.select(F.col("first_id").alias("a"), F.col("doc_id").alias("b"))], None
    for step in ((MOST, REST) if large.isEmpty() else (STARS, MOST, REST)):
        known = rows if groups is None else rows.join(checked(groups), "doc_id", "left")
        of = F.col("doc_id") if groups is None else F.coalesce("first_id", "doc_id")
        entries = known.select(F.explode("nodes").alias("node"), "doc_id", "sig", of.alias("of"), F.lit(1 << 62).alias("parent"))
        nodes = large if step == STARS else left if step == REST else None
        links, left = candidate_links(entries if nodes is None else entries.join(checked(nodes), "node", "left_semi"), threshold, most_rows, step)
        left = settle(left, "left")
        verified.append(_verified(links, own, threshold))
        groups = settle(components(reduce(DataFrame.unionByName, verified)), "groups")
        if step == MOST and left.isEmpty():
            break
    return groups


def near_groups(docs: DataFrame, threshold: float = THRESHOLD, most_rows: int = MOST_ROWS) -> DataFrame:
    """``doc_id, first_id, group_size`` of each document that has near duplicates: the least doc_id and size of its group."""
    _, equal, own = _sketches(docs)
    return _with_sizes(_grouped(own, equal, threshold, most_rows))


def _with_sizes(groups: DataFrame) -> DataFrame:
    sizes = groups.groupBy("first_id").agg(F.count("*").alias("group_size"))
    return groups.join(sizes, "first_id").select("doc_id", "first_id", "group_size")


def near_links(docs: DataFrame, threshold: float = THRESHOLD, most_rows: int = MOST_ROWS) -> DataFrame:
    """``near_groups`` with ``links``, the number of other documents that are near duplicates of this one."""
    sketches, equal, own = _sketches(docs)
    groups = _grouped(own, equal, threshold, most_rows)
    # a set stands for all its documents
    held = settle(sketches.groupBy("f1", "f2").agg(F.min("doc_id").alias("doc_id"), F.count_distinct("doc_id").alias("copies")), "copies")
    known = settle(groups.join(held.select("doc_id", "copies"), "doc_id"), "members")  # of each set of a group
    sets = keep_by(own.select("doc_id", "grams"), known.select("doc_id")).join(checked(known), "doc_id")
    links = link_counts(settle(sets, "sets"), threshold).join(held, "doc_id").select("f1", "f2", (F.col("n") + F.col("copies") - 1).alias("links"))
    named = sketches.select("doc_id", "f1", "f2").join(checked(settle(links, "counts")), ["f1", "f2"]).groupBy("doc_id").agg(F.max("links").alias("links"))
    return _with_sizes(groups).join(named, "doc_id")


def link_counts(sets: DataFrame, threshold: float = THRESHOLD, block_grams: int | None = None) -> DataFrame:
    """``doc_id, n`` of settled sets (doc_id, first_id, grams, copies): the documents of the other sets of its group that are at
    ``threshold`` or more. A group of many sets is cut into blocks by a hash; any two blocks meet in a task."""
    size = block_grams or BLOCK_GRAMS
    blocks = sets.groupBy("first_id").agg(F.ceil(F.sum(F.octet_length("grams")) / (4 * size)).cast("long").alias("blocks"))
    rows = sets.join(blocks, "first_id").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    rows = rows.select("first_id", low.alias("low"), high.alias("high"), F.col("own").cast("long").alias("own"), "doc_id", "copies", "grams")
    key = F.xxhash64("first_id", "low", "high")
    counted = rows.repartition(key).sortWithinPartitions("first_id", "low", "high").mapInArrow(frugal(_counted_links(threshold)), "doc_id long, n long")
    return counted.groupBy("doc_id").agg(F.sum("n").alias("n"))


def _overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)


def _counts(own: np.ndarray | None, copies: np.ndarray, grams: list[np.ndarray], threshold: float) -> np.ndarray:
    """Of each set the copies of sets that are near: of those in the other block of ``own``, or of all others where it is None."""
    n, out = len(grams), np.zeros(len(grams), np.int64)
    sizes = np.array([len(g) for g in grams])
    tiles = [np.arange(a, min(a + TILE, n)) for a in range(0, n, TILE)]
    names, at = np.unique(np.concatenate(grams), return_inverse=True)
    starts = np.append(0, np.cumsum(sizes))

    def dense(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        place = np.full(len(names), -1)
        place[columns] = np.arange(len(columns))
        table = np.zeros((len(rows), len(columns)), bool)
        for k, r in enumerate(rows):
            c = place[at[starts[r] : starts[r + 1]]]
            table[k, c[c >= 0]] = True
        return table

    for i, x in enumerate(tiles):
        for y in tiles[i:]:
            shared = np.zeros((len(x), len(y)), np.int64)
            mine, theirs = (np.unique(np.concatenate([at[starts[r] : starts[r + 1]] for r in rows])) for rows in (x, y))
            both = np.intersect1d(mine, theirs, assume_unique=True)
            for a in range(0, len(both), 1 << 14):
                columns = both[a : a + (1 << 14)]
                shared += _overlaps(dense(x, columns), dense(y, columns))
            near = shared >= threshold * (sizes[x][:, None] + sizes[y][None, :] - shared)
            if own is not None:
                near &= own[x][:, None] != own[y][None, :]
            if x is y:
                near &= ~np.eye(len(x), dtype=bool)
                out[x] += near @ copies[y]
            else:
                out[x] += near @ copies[y]
                out[y] += copies[x] @ near
    return out


def _counted_links(threshold: float):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def ready() -> pa.RecordBatch:
            own, docs, copies, grams = zip(*held)
            if len(held) == 2 and key[1] == key[2]:  # most groups are two documents
                shared = len(np.intersect1d(grams[0], grams[1], assume_unique=True))
                near = shared >= threshold * (len(grams[0]) + len(grams[1]) - shared)
                n = np.array([copies[1], copies[0]]) * near
            else:
                n = _counts(None if key[1] == key[2] else np.array(own), np.array(copies), list(grams), threshold)
            return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n"])

        for batch in batches:
            for first, low, high, own, doc, copies, grams in zip(*(batch.column(c).to_pylist() for c in ("first_id", "low", "high", "own", "doc_id", "copies", "grams"))):
                if (first, low, high) != key:
                    if held:
                        yield ready()
                    key, held = (first, low, high), []
                held.append((own, doc, copies, np.frombuffer(grams, np.uint32)))
        if held:
            yield ready()

    return count


def drop_near(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Of each group of near duplicates the document with the least doc_id; every document outside groups."""
    groups = settle(near_groups(docs, threshold).select("doc_id", "first_id"), "groups")
    kept = drop_by(docs, groups.filter("doc_id <> first_id").select("doc_id"))
    rows = with_key(docs.filter("doc_id is not null and text is not null")).groupBy("doc_id", "key").count().filter("count > 1").select("doc_id", "key")
    return one_of_repeated(kept, settle(rows, "repeated"))
