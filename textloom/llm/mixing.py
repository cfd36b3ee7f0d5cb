"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a rate, the copies that each of its documents should have on average, so that the source's share of the
characters is its target weight. A document first gets the whole part of the rate. The fractions are rounded together: two
fractions at a time, mass moves at random from one to the other until one of them is 0 or 1, and both keep their
expectations. Buckets of a source do so on their own and hand on at most one undecided fraction each; these meet in a
reduction tree of FAN_IN buckets a node, level by level, and the root draws the last one. A source's copies thus sum to its
expectation rounded up or down, whatever the number of documents or buckets.

Defined results: a null source is a source of its own; a null or empty text has no characters, and a source without any
keeps its rows once; a row with a null doc_id can't be drawn and stays once; rows that repeat doc_id and text are drawn
once and share the outcome; a source missing from given ``weights`` has weight 0; an empty table gives an empty result;
other columns take no part. Draws depend on the seed, the ids and the texts alone, not on partitions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, free_name, settle

#: Without given weights a source's weight is its characters to this power.
TEMPERATURE = 0.5
#: Copies of all documents together have this share of the input's characters.
EPOCHS = 1.0
SEED = 17
BUCKET_ROWS = 4096
FAN_BITS = 4
FAN_IN = 1 << FAN_BITS

_NEAR = 1e-9


def pivotal(p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """``p`` with all fractions but one at most turned into 0 or 1, each keeping its expectation and all their sum."""
    p = p.astype(np.float64).copy()
    active = np.flatnonzero((p > _NEAR) & (p < 1 - _NEAR))
    while len(active) > 1:
        a, b = active[0 : len(active) // 2 * 2 : 2], active[1::2]
        total, u = p[a] + p[b], rng.random(len(a))
        under = total < 1
        keep, lose = np.where(under, total, 1.0), np.where(under, 0.0, total - 1)
        # under 1 the winner takes all; from 1 on the winner is filled up and the rest stays behind
        chance = np.where(under, p[a] / np.maximum(total, _NEAR), (1 - p[b]) / np.maximum(2 - total, _NEAR))
        first = u < chance
        p[a], p[b] = np.where(first, keep, lose), np.where(first, lose, keep)
        active = active[(p[active] > _NEAR) & (p[active] < 1 - _NEAR)]
    return np.where(p <= _NEAR, 0.0, np.where(p >= 1 - _NEAR, 1.0, p))


_ROUNDED = "doc_id long, key long, source_id long, bits int, bucket long, whole long, p double"


def _rounder(seed: int, level: int):
    def rounded(group: pa.Table) -> pa.Table:
        ids, keys = group.column("doc_id").to_numpy(), group.column("key").to_numpy()
        order = np.lexsort((ids, keys))
        same = np.append(False, (ids[order][1:] == ids[order][:-1]) & (keys[order][1:] == keys[order][:-1]))
        group = group.take(pa.array(order[~same]))
        at = [group.column(c)[0].as_py() for c in ("source_id", "bucket")]
        rng = np.random.default_rng([seed, level, *(x & 0xFFFFFFFFFFFFFFFF for x in at)])
        return group.set_column(group.schema.get_field_index("p"), "p", pa.array(pivotal(group.column("p").to_numpy(), rng)))

    return rounded


def _given(weights: dict[str | None, float]) -> Column:
    """A source's weight in ``weights``, whose key None is the null source; 0 for a source that has none."""
    out = F.lit(float(weights.get(None, 0.0)))
    named = {k: float(v) for k, v in weights.items() if k is not None}
    if named:
        out = F.when(F.col("source").isNull(), out).otherwise(F.coalesce(F.create_map(*[F.lit(x) for kv in named.items() for x in kv])[F.col("source")], F.lit(0.0)))
    else:
        out = F.when(F.col("source").isNull(), out).otherwise(0.0)
    return out


def _source_id() -> Column:
    return F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull())


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = TEMPERATURE, epochs: float = EPOCHS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``source, source_id, n_docs, chars, rate, bits``: a row for each source; its documents fall into 2^bits buckets."""
    per = docs.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("chars"))
    per = settle(per, "sources")  # its total is taken from it and not from another scan
    weight = F.pow(F.col("chars").cast("double"), F.lit(temperature)) if weights is None else _given(weights)
    per = per.withColumn("weight", F.when(F.col("chars") > 0, weight).otherwise(0.0))
    total = per.agg(F.sum("weight").alias("all_weights"), F.sum("chars").alias("all_chars"))
    rate = F.when(F.col("chars") > 0, F.try_divide("weight", "all_weights") * F.col("all_chars") * epochs / F.col("chars")).otherwise(1.0)
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n_docs") / bucket_rows))).cast("int")
    return per.crossJoin(total).select("source", _source_id().alias("source_id"), "n_docs", "chars", F.coalesce(rate, F.lit(0.0)).alias("rate"), bits.alias("bits"))


def drawn_copies(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = TEMPERATURE, epochs: float = EPOCHS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``doc_id, key, source, copies`` of each document (a settled table; ``key`` is a hash of the text)."""
    rates = settle(source_rates(docs, weights, temperature, epochs, bucket_rows), "rates")
    deepest = rates.agg(F.max("bits")).first()[0] or 0
    small = rates.select("source_id", "bits", "rate")
    small = F.broadcast(small) if small.count() <= BROADCAST_ROWS else small
    rows = docs.filter("doc_id is not null").select("doc_id", F.xxhash64("text").alias("key"), _source_id().alias("source_id")).join(small, "source_id")
    whole = F.floor(F.col("rate") + _NEAR)
    rows = rows.select("doc_id", "key", "source_id", "bits", F.xxhash64(F.lit(seed), "doc_id", "key").bitwiseAND(F.expr("shiftleft(1L, bits) - 1")).alias("bucket"), whole.alias("whole"), F.greatest(F.lit(0.0), F.col("rate") - whole).alias("p"))
    done = []
    for level in range(-(-deepest // FAN_BITS) + 1):
        rows = settle(rows.groupBy("source_id", "bucket").applyInArrow(_rounder(seed, level), _ROUNDED), "rounded")
        undecided = (F.col("p") > 0) & (F.col("p") < 1)
        if level == -(-deepest // FAN_BITS):  # the roots
            draw = F.when(undecided, (F.abs(F.xxhash64(F.lit(seed + 1), "source_id") % 1_000_003) / 1_000_003.0 < F.col("p")).cast("double")).otherwise(F.col("p"))
            done.append(rows.withColumn("p", draw))
        else:
            done.append(rows.filter(~undecided))
            rows = rows.filter(undecided).withColumn("bucket", F.shiftright("bucket", FAN_BITS))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    names = rates.select("source_id", "source")
    names = F.broadcast(names) if rates.count() <= BROADCAST_ROWS else names
    out = out.join(names, "source_id").select("doc_id", "key", "source", (F.col("whole") + F.col("p").cast("long")).alias("copies"))
    return settle(out, "copies")


def mix_sources(docs: DataFrame, **how) -> DataFrame:
    """The documents, each as often as drawn, with their columns."""
    drawn = drawn_copies(docs, **how)
    names = {n: free_name(docs, "mix_" + n) for n in ("doc_id", "key", "copies", "times")}
    drawn = drawn.select(*[F.col(n).alias(names[n]) for n in ("doc_id", "key", "copies")]).hint("shuffle_hash")
    same = (docs["doc_id"] == F.col(names["doc_id"])) & (F.xxhash64(docs["text"]) == F.col(names["key"]))
    times = F.coalesce(F.col(names["copies"]), F.lit(1))
    rows = docs.join(drawn, same, "left").filter(times > 0)
    return rows.withColumn(names["times"], F.explode(F.sequence(F.lit(1), times.cast("int")))).select(*[f"`{c}`" for c in docs.columns])
