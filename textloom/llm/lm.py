"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

Words map to UNITS = CLASSES x MEMBERS units: the most frequent words own one each, all others share the rest by hash.
Units are sorted by frequency into CLASSES classes, and P(word | context) = P(class | context) P(member | class, context)
P(word | unit). The first two are maximum-entropy models: the logits are sums of hashed rows of weights for the features of the
context. For the class these are the word before, the one before that (a skip), and both; for the member, within its class,
the word before and the skip. The third is 1 where a word owns its unit, otherwise n / (n of the unit + 1), n being counts in
the corpus; the one over is for all words that it lacks, which are one unknown word with n = 1.

Training is full of the corpus: words are counted over all documents; a first estimate is made from the counts of all
(feature row, class) and (feature row, member) pairs; then ROUNDS updates follow, each with the gradient (counted minus
expected) over its share of the documents, so that every document takes part. Tasks add gradients up in arrays, blocks of
rows are summed by a shuffle, and the driver holds nothing but the model, whose size is a parameter (WIDTH_C, WIDTH_M rows
of 64 numbers, 12 MB), steps and sends it out again.

The counts of all words are a table that grows with the corpus and stays with the executors: the LISTED most frequent words'
are sent to all, about; the words of documents that aren't among these meet their counts in blocks, as arrays, and a block holds
the counts of its own words alone. Equally frequent words are one after another by hash where units are given out.

Scoring walks the units in numpy batches, a few thousand sparse contexts at a time. ``log_prob`` is the natural logarithm
of the probability of all words, ``bits_per_word`` its mean to the base two.

Defined results: a text without words (null, empty) has 0 words, log_prob 0 and null bits; texts are read whole; repeated
rows are trained on and scored each; a null doc_id stays null; an empty table gives an empty result; other columns take no
part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, settle, slices, words

CLASSES, MEMBERS = 64, 64
UNITS = CLASSES * MEMBERS
#: Words that own a unit; the other units are shared.
OWN = 3072
#: Words whose counts are sent to all executors, at most (16 bytes each); words of documents that a block has, about.
LISTED, BLOCK_WORDS = 1 << 19, 1 << 22
#: Stands before a text's first word.
START = UNITS
WIDTH_C, WIDTH_M = 1 << 14, 1 << 15
ROUNDS = 2
#: Counts that the estimate without context weighs.
PRIOR = 30.0
STEP = 0.5
#: Strength of the pull of weights to zero, in counts: what keeps rare features from being learnt by heart.
RIDGE = 6.0
#: Places whose gradients are added up together, and whose logits are computed together.
CHUNK, PIECE = 1 << 13, 1 << 11
#: Rows of one block of gradients.
BLOCK = 64


class Vocabulary(NamedTuple):
    hashes: np.ndarray  # of the words that own a unit
    units: np.ndarray  # theirs
    shared: np.ndarray  # units of the other words, by hash
    counts: np.ndarray  # of each unit
    listed: np.ndarray = np.zeros(0, np.uint64)  # hashes of other frequent words, in order
    listed_counts: np.ndarray = np.zeros(0, np.int64)


class Model(NamedTuple):
    vocabulary: Vocabulary
    class_bias: np.ndarray
    member_bias: np.ndarray
    class_rows: np.ndarray
    member_rows: np.ndarray


# ---------------------------------------------------------------- units


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        hashes, at = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
        return hashes, np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)

    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in slices(texts):
            hashes, n = np.unique(words([t or "" for t in texts[a:b]])[0], return_counts=True)
            held.append((hashes, n))
            rows += len(hashes)
            if rows > 1 << 22:
                held = [merged()]
                rows = len(held[0][0])
                if rows > 1 << 21:  # many words: handed on to the shuffle, which adds up
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], ["hash", "n"])
                    held, rows = [], 0
    if held:
        hashes, n = merged()
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n)], ["hash", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """``hash, n`` of every word of all documents, settled."""
    return settle(docs.select("text").mapInArrow(_counted, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")), "words")


def _least_listed(counts: DataFrame, most: int) -> int:
    """A count that ``most`` words have at most, or one more than any has: from how many words there are in steps of 1/8 octave."""
    step = F.floor(F.log2("n") * 8).cast("int")
    steps = sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("n"), F.max("n").alias("top")).collect(), reverse=True)
    held, least = 0, steps[0].top + 1 if steps else 1
    for x in steps:
        held += x.words
        if held > most:
            break
        least = x.n
    return least


def vocabulary(docs: DataFrame, own: int = OWN) -> Vocabulary:
    return vocabulary_of(word_counts(docs), own)


def vocabulary_of(counts: DataFrame, own: int = OWN, listed: int = LISTED) -> Vocabulary:
    """Units from the counts of all words."""
    top = counts.orderBy(F.desc("n"), "hash").limit(own).toArrow()
    rest = counts.join(F.broadcast(counts.orderBy(F.desc("n"), "hash").limit(own).select("hash")), "hash", "left_anti")
    others = rest.filter(F.col("n") >= _least_listed(counts, listed)).toArrow()
    n_shared = UNITS - own
    shared = rest.groupBy(F.shiftrightunsigned("hash", 20).bitwiseAND(F.lit((1 << 30) - 1)).alias("slot")).agg(F.sum("n").alias("n"))
    shared = shared.groupBy((F.col("slot") % n_shared).alias("slot")).agg(F.sum("n").alias("n")).toArrow()
    raw = np.zeros(UNITS)
    hashes = top.column("hash").to_numpy().view(np.uint64)
    raw[: len(hashes)] = top.column("n").to_numpy()
    raw[own + shared.column("slot").to_numpy()] = shared.column("n").to_numpy()
    place = np.empty(UNITS, np.int64)
    place[np.lexsort((np.arange(UNITS), -raw))] = np.arange(UNITS)
    sorted_counts = np.empty(UNITS)
    sorted_counts[place] = raw
    names = others.column("hash").to_numpy().view(np.uint64)
    order = np.argsort(names)
    return Vocabulary(hashes, place[: len(hashes)].astype(np.uint16), place[own:].astype(np.uint16), sorted_counts, names[order], others.column("n").to_numpy()[order])


class Lookup:
    """Units of word hashes, by one look into a table in which no two known words meet."""

    def __init__(self, v: Vocabulary):
        self.v = v
        rng = np.random.default_rng(5)
        while True:
            self.factor = np.uint64(int(rng.integers(1, 1 << 62)) * 2 + 1)
            slots = (v.hashes * self.factor) >> np.uint64(41)
            if len(np.unique(slots)) == len(slots):
                break
        self.at = np.full(1 << 23, len(v.hashes), np.uint16)
        self.at[slots] = np.arange(len(slots))
        self.known = np.append(v.hashes, np.uint64(0))
        self.units = np.append(v.units, np.uint16(0))

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """Units of words that share theirs."""
        return self.v.shared[((hashes >> np.uint64(20)) & np.uint64((1 << 30) - 1)) % np.uint64(len(self.v.shared))]

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        return self.found(hashes)[0]

    def shares(self, hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Logarithms of P(word | unit) of words with count ``n`` (0: unknown) that share their units."""
        return np.log(np.maximum(n, 1) / (self.v.counts[self.slots(hashes)] + 1))

    def found(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units, and the places of words that don't own theirs."""
        at = self.at[(hashes * self.factor) >> np.uint64(41)]
        out = self.units[at]
        other = np.flatnonzero((self.known[at] != hashes) | (at == len(self.v.hashes)))
        out[other] = self.slots(hashes[other])
        return out, other


def units(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """``doc_id, share, n_words, units, row, log_listed, rest``: each document's units as two-byte numbers; ``share`` is a number
    drawn from the text, ``row`` one of the row's own once the table is settled, ``log_listed`` the logarithm of P(word | unit)
    over its words with listed counts, ``rest`` the hashes of those that neither own a unit nor are listed."""
    sent = docs.sparkSession.sparkContext.broadcast(v)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        look = Lookup(v)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts):
                hashes, starts = words([t or "" for t in texts[a:b]])
                own, other = look.found(hashes)
                text = np.searchsorted(starts, other, "right") - 1
                other = hashes[other]
                at = np.searchsorted(v.listed, other)
                known = np.append(v.listed, np.uint64(0))[at] == other
                known &= at < len(v.listed)
                logs = np.bincount(text[known], look.shares(other[known], v.listed_counts[at[known]]), b - a)
                rest = np.append(0, np.cumsum(np.bincount(text[~known], minlength=b - a)))
                columns = [pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.array(x, pa.int64()).buffers()[1], pa.py_buffer(np.ascontiguousarray(y))]).cast(pa.binary()) for x, y in ((starts.astype(np.int64) * 2, own), (rest * 8, other[~known]))]
                logs = logs.astype(np.float64)  # of no words they are whole numbers
                given = [batch.column(c).slice(a, b - a) for c in ("doc_id", "share", "row")]
                yield pa.RecordBatch.from_arrays([*given[:2], pa.array(np.diff(starts).astype(np.int64)), columns[0], given[2], pa.array(logs), columns[1]], ["doc_id", "share", "n_words", "units", "row", "log_listed", "rest"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.pmod(F.xxhash64("text"), F.lit(1 << 20)).cast("int").alias("share"), F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(mapped, "doc_id long, share int, n_words long, units binary, row long, log_listed double, rest binary")


def _block_of(hashes: np.ndarray, blocks: int) -> np.ndarray:
    return (hashes >> np.uint64(33)).astype(np.int64) % blocks


_BLOCKS = "block long, kind long, ids binary, sizes binary, hashes binary"


def _words_by_block(blocks: int):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("rest").to_pylist()
            hashes = np.frombuffer(b"".join(column), np.uint64)
            text = np.repeat(np.arange(len(column)), [len(x) // 8 for x in column])
            rows = batch.column("row").to_numpy()
            block = _block_of(hashes, blocks)
            order = np.argsort(block, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(block[order]))) if len(order) else []
            out = []
            for k, own in zip(block[order[first]].tolist(), np.split(order, first[1:])):
                texts, n = np.unique(text[own], return_counts=True)
                out.append((k, 1, rows[texts].tobytes(), n.tobytes(), hashes[own].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["block", "kind", "ids", "sizes", "hashes"])

    return split


def _counts_by_block(blocks: int):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, n = batch.column("hash").to_numpy().view(np.uint64), batch.column("n").to_numpy()
            block = _block_of(hashes, blocks)
            order = np.argsort(block, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(block[order]))) if len(order) else []
            if len(first):
                out = [(k, 0, b"", n[own].tobytes(), hashes[own].tobytes()) for k, own in zip(block[order[first]].tolist(), np.split(order, first[1:]))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["block", "kind", "ids", "sizes", "hashes"])

    return split


def _looked_up(sent):
    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(sent.value)
        block, held, names, counts = None, [], np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for k, kind, ids, sizes, hashes in zip(*(batch.column(c).to_pylist() for c in ("block", "kind", "ids", "sizes", "hashes"))):
                if k != block:
                    block, held, names, counts = k, [], np.zeros(0, np.uint64), np.zeros(0, np.int64)
                hashes, sizes = np.frombuffer(hashes, np.uint64), np.frombuffer(sizes, np.int64)
                if kind == 0:
                    held.append((hashes, sizes))
                    continue
                if held:
                    names, counts = map(np.concatenate, zip(*held))
                    order = np.argsort(names)
                    names, counts, held = names[order], counts[order], []
                at = np.searchsorted(names, hashes)
                known = np.append(names, np.uint64(0))[at] == hashes
                n = np.where(known & (at < len(names)), np.append(counts, 0)[at], 0)
                logs = np.bincount(np.repeat(np.arange(len(sizes)), sizes), look.shares(hashes, n), len(sizes))
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, np.int64)), pa.array(logs)], ["row", "log"])

    return look_up


def rest_logs(own_units: DataFrame, v: Vocabulary, counts: DataFrame) -> DataFrame:
    """``row, log_rest``: of each row of a settled table of units with such words, the logarithm of P(word | unit) over the words
    whose counts aren't listed."""
    spark = own_units.sparkSession
    sent = spark.sparkContext.broadcast(v)
    n = own_units.agg(F.coalesce(F.sum(F.octet_length("rest")), F.lit(0))).first()[0] // 8
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // BLOCK_WORDS))
    known = F.broadcast(spark.createDataFrame(pa.table({"hash": pa.array(v.hashes.view(np.int64))})))
    least = int(v.listed_counts.min()) if len(v.listed) else None
    others = (counts if least is None else counts.filter(F.col("n") < least)).join(known, "hash", "left_anti")
    met = own_units.select("row", "rest").mapInArrow(_words_by_block(blocks), _BLOCKS).unionByName(others.mapInArrow(_counts_by_block(blocks), _BLOCKS))
    logs = met.repartition(blocks, "block").sortWithinPartitions("block", "kind").mapInArrow(_looked_up(sent), "row long, log double")
    return logs.groupBy("row").agg(F.sum("log").alias("log_rest"))


# ---------------------------------------------------------------- features

_SALT = mix(np.arange(1, 3 * (UNITS + 1) + 1, dtype=np.uint64)).reshape(3, -1).astype(np.uint32)
_PER_CLASS = WIDTH_M // CLASSES


class Contexts(NamedTuple):
    target_class: np.ndarray
    target_member: np.ndarray
    class_rows: tuple[np.ndarray, ...]
    member_rows: tuple[np.ndarray, ...]


N_CLASS_ROWS, N_MEMBER_ROWS = 3, 2


def contexts(own: np.ndarray, starts: np.ndarray) -> Contexts:
    """Targets and feature rows at every place of the texts that begin at ``starts``."""
    before = np.empty(len(own) + 1, np.int64)
    before[1:] = own
    before[starts] = START
    one = before[:-1]
    skip = np.empty(len(own), np.int64)
    skip[1:] = one[:-1]
    firsts = starts[starts < len(own)]
    skip[firsts] = START
    a, b = _SALT[0][one], _SALT[1][skip]
    both = (_SALT[2][one] * np.uint32(0x85EBCA6B)) ^ (b * np.uint32(0xC2B2AE35) + np.uint32(1))
    both ^= both >> np.uint32(15)
    # the two word features have halves of their own of half the table, the pair the other half
    quarter = WIDTH_C // 4
    class_rows = ((a % np.uint32(quarter)).astype(np.uint16), (quarter + b % np.uint32(quarter)).astype(np.uint16), (2 * quarter + (both * np.uint32(0x27D4EB2F) >> np.uint32(8)) % np.uint32(2 * quarter)).astype(np.uint16))
    target = own >> np.uint16(6)
    base = target.astype(np.uint32) * np.uint32(_PER_CLASS)
    half = np.uint32(_PER_CLASS // 2)
    member_rows = ((base + (a >> np.uint32(7)) % half).astype(np.uint16), (base + half + (b >> np.uint32(7)) % half).astype(np.uint16))
    return Contexts(target, own & np.uint16(63), class_rows, member_rows)


def _parts(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Units, the texts' starts and the batch, for batches that hold words."""
    for batch in batches:
        column = batch.column("units")
        data = b"".join(column.to_pylist())
        own = np.frombuffer(data, np.uint16)
        starts = np.zeros(batch.num_rows + 1, np.int64)
        np.cumsum(batch.column("n_words").to_numpy(), out=starts[1:])
        yield own, starts, batch


def _softmax(logits: np.ndarray) -> np.ndarray:
    """Turns logits into exponentials in place and returns their sums. Logits are kept within what a float can hold."""
    np.clip(logits, -40, 40, out=logits)
    np.exp(logits, out=logits)
    return logits @ np.ones(logits.shape[1], np.float32)


def _logits(bias: np.ndarray, table: np.ndarray, rows: tuple[np.ndarray, ...], out: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``table`` that features name, and the bias, in ``out``."""
    np.take(table, rows[0], 0, out=out, mode="clip")
    for r in rows[1:]:
        out += np.take(table, r, 0, out=spare, mode="clip")
    out += bias
    return out


#: Rows named up to so often in a chunk are added one occurrence of each after another; the others each by a product.
_SELDOM = 12


def _add_rows(into: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Adds each row of ``values`` to the row of ``into`` that ``rows`` names."""
    order = np.argsort(rows, kind="stable")
    sorted_rows = rows[order]
    first = np.flatnonzero(np.append(True, sorted_rows[1:] != sorted_rows[:-1]))
    size = np.diff(np.append(first, len(rows)))
    seldom, size_seldom = first[size <= _SELDOM], size[size <= _SELDOM]
    for k in range(int(size_seldom.max(initial=0))):  # no row occurs twice in one step
        at = seldom[size_seldom > k] + k
        into[sorted_rows[at]] += values[order[at]]
    ones = np.ones(len(rows), np.float32)
    often = size > _SELDOM
    for r, a, n in zip(sorted_rows[first[often]].tolist(), first[often].tolist(), size[often].tolist()):
        into[r] += ones[:n] @ values[order[a : a + n]]


def _blocks(tables: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows that aren't all zero."""
    for name, table in tables.items():
        cut = table.reshape(-1, BLOCK * table.shape[1])
        some = np.flatnonzero(cut.any(1))
        if len(some):
            data = [np.ascontiguousarray(cut[k], np.float32).tobytes() for k in some]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array(some.astype(np.int32)), pa.array(data, pa.binary())], ["part", "block", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[str, int], np.ndarray] = {}
    for batch in batches:
        for part, block, data in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "sums"))):
            values = np.frombuffer(data, np.float32)
            if (part, block) in sums:
                sums[part, block] += values
            else:
                sums[part, block] = values.astype(np.float64)
    if sums:
        keys = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.int32()), pa.array([sums[k].tobytes() for k in keys], pa.binary())], ["part", "block", "sums"])


_SUMS = "part string, block int, sums binary"


def _gathered(df: DataFrame) -> dict[str, np.ndarray]:
    """Sums over all tasks of the blocks in ``df``."""
    out = {"class": np.zeros((WIDTH_C, CLASSES)), "member": np.zeros((WIDTH_M, MEMBERS))}
    rows = df.repartition("part", "block").mapInArrow(_added, _SUMS).toArrow()
    for part, block, data in zip(*(rows.column(c).to_pylist() for c in ("part", "block", "sums"))):
        out[part][block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(data).reshape(BLOCK, -1)
    return out


# ---------------------------------------------------------------- training


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    class_counts, member_counts = np.zeros(WIDTH_C * CLASSES, np.float32), np.zeros(WIDTH_M * MEMBERS, np.float32)
    for own, starts, _ in _parts(batches):
        c = contexts(own, starts)
        for r in c.class_rows:
            np.add.at(class_counts, r.astype(np.int64) * CLASSES + c.target_class, np.float32(1))
        for r in c.member_rows:
            np.add.at(member_counts, r.astype(np.int64) * MEMBERS + c.target_member, np.float32(1))
    yield from _blocks({"class": class_counts.reshape(WIDTH_C, CLASSES), "member": member_counts.reshape(WIDTH_M, MEMBERS)})


def probabilities(m: Model, c: Contexts, at: slice) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Places, and there exponentials and their sums for the classes and for the members of the targets' classes, a few
    thousand places at a time: what they need stays in the cache."""
    n = min(PIECE, at.stop - at.start)
    classes, members, spare = (np.empty((n, k), np.float32) for k in (CLASSES, MEMBERS, max(CLASSES, MEMBERS)))
    for a in range(at.start, at.stop, PIECE):
        own = slice(a, min(a + PIECE, at.stop))
        k = own.stop - own.start
        x = _logits(m.class_bias, m.class_rows, tuple(r[own] for r in c.class_rows), classes[:k], spare[:k])
        y = _logits(np.take(m.member_bias, c.target_class[own], 0), m.member_rows, tuple(r[own] for r in c.member_rows), members[:k], spare[:k])
        yield own, x, _softmax(x), y, _softmax(y)


def _gradient(sent):
    def gradient(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = sent.value
        class_sums, member_sums = np.zeros(m.class_rows.shape, np.float32), np.zeros(m.member_rows.shape, np.float32)
        big = np.empty((2, CHUNK, CLASSES), np.float32)
        for own, starts, _ in _parts(batches):
            c = contexts(own, starts)
            for a in range(0, len(own), CHUNK):
                at = slice(a, min(a + CHUNK, len(own)))
                for here, classes, class_total, members, member_total in probabilities(m, c, at):
                    every = np.arange(len(class_total))
                    for values, total, target, into in ((classes, class_total, c.target_class, big[0]), (members, member_total, c.target_member, big[1])):
                        part = np.multiply(values, (-1 / total)[:, None], out=into[here.start - a : here.stop - a])
                        part[every, target[here]] += 1
                n = at.stop - a
                for r in c.class_rows:
                    _add_rows(class_sums, r[at], big[0, :n])
                for r in c.member_rows:
                    _add_rows(member_sums, r[at], big[1, :n])
        yield from _blocks({"class": class_sums, "member": member_sums})

    return gradient


def start_model(v: Vocabulary, counts: dict[str, np.ndarray]) -> Model:
    """The estimate from counts: each feature's part of the log ratio between counted and expected without context."""
    by_class = v.counts.reshape(CLASSES, MEMBERS) + 0.5
    p_class, p_member = by_class.sum(1) / by_class.sum(), by_class / by_class.sum(1, keepdims=True)
    n = counts["class"].sum(1, keepdims=True)
    class_rows = np.log((counts["class"] + PRIOR * p_class) / ((n + PRIOR) * p_class)) / N_CLASS_ROWS
    expected = np.repeat(p_member, _PER_CLASS, 0)
    n = counts["member"].sum(1, keepdims=True)
    member_rows = np.log((counts["member"] + PRIOR * expected) / ((n + PRIOR) * expected)) / N_MEMBER_ROWS
    return Model(v, *(x.astype(np.float32) for x in (np.log(p_class), np.log(p_member), class_rows, member_rows)))


def stepped(m: Model, counts: dict[str, np.ndarray], gradient: dict[str, np.ndarray], share: float) -> Model:
    """The model after an update: the gradient over its share of the counts, each weight at its own scale."""
    by_class, p_member = np.exp(m.class_bias), np.repeat(np.exp(m.member_bias), _PER_CLASS, 0)
    steps = []
    for part, base, weights in (("class", by_class, m.class_rows), ("member", p_member, m.member_rows)):
        scale = share * (counts[part] + PRIOR * base + RIDGE)
        steps.append(np.clip(STEP * (gradient[part] - share * RIDGE * weights) / scale, -1, 1).astype(np.float32))
    return m._replace(class_rows=m.class_rows + steps[0], member_rows=m.member_rows + steps[1])


def train_on(own_units: DataFrame, v: Vocabulary, rounds: int = ROUNDS) -> Model:
    """A model of a settled table of units."""
    context = own_units.sparkSession.sparkContext
    counts = _gathered(own_units.select("n_words", "units").mapInArrow(_pair_counts, _SUMS))
    m = start_model(v, counts)
    for k in range(rounds):
        part = own_units.filter(F.coalesce(F.col("share"), F.lit(0)) % rounds == k).select("n_words", "units")
        sent = context.broadcast(m._replace(vocabulary=None))
        m = stepped(m, counts, _gathered(part.mapInArrow(_gradient(sent), _SUMS)), 1 / rounds)
        sent.unpersist()
    return m


# ---------------------------------------------------------------- scores


def scores(own_units: DataFrame, m: Model, counts: DataFrame) -> DataFrame:
    """``doc_id, n_words, log_prob, bits_per_word`` of a settled table of units; ``counts`` are those the vocabulary is from."""
    sent = own_units.sparkSession.sparkContext.broadcast(m._replace(vocabulary=None))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, starts, batch in _parts(batches):
            c = contexts(own, starts)
            logs = np.zeros(len(own) + 1)
            for here, classes, class_total, members, member_total in probabilities(sent.value, c, slice(0, len(own))):
                every = np.arange(len(class_total))
                logs[here] = np.log(classes[every, c.target_class[here]] / class_total) + np.log(members[every, c.target_member[here]] / member_total)
            sums = np.zeros(len(own) + 1)
            np.cumsum(logs[:-1], out=sums[1:])
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("doc_id", "n_words", "row")), pa.array(sums[starts[1:]] - sums[starts[:-1]] + batch.column("log_listed").to_numpy())], ["doc_id", "n_words", "row", "log"])

    rows = own_units.select("doc_id", "n_words", "units", "row", "log_listed").mapInArrow(scored, "doc_id long, n_words long, row long, log double")
    rows = rows.join(rest_logs(own_units, m.vocabulary, counts), "row", "left")
    total = F.col("log") + F.coalesce("log_rest", F.lit(0.0))
    return rows.select("doc_id", "n_words", total.alias("log_prob"), F.when(F.col("n_words") > 0, -total / F.col("n_words") / math.log(2)).alias("bits_per_word"))


def score_documents(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Scores of all documents by a model trained on all of them."""
    counts = word_counts(docs)
    v = vocabulary_of(counts)
    own = settle(units(docs, v), "units")
    return scores(own, train_on(own, v, rounds), counts)
