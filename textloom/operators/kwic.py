"""Keyword in context: matches with their places, contexts and sorted neighbours; passages and snippets."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import unit_spans
from ..plans import query as q
from ..plans.compile import Compiler, term_condition
from ..sources.corpus import Corpus
from ..sources.store import small, written
from .search import compiled


@dataclass(frozen=True)
class SortKey:
    """A neighbour ``distance`` words away (0 is the match) by which rows are sorted."""

    distance: int
    direction: str = "A"
    insensitive: bool = True


def sort_key(text: str) -> SortKey:
    """``-1AI``: distance, A or D, I or S."""
    m = re.fullmatch(r"(-?\d+)([AD])?([IS])?", text)
    if not m:
        raise ValueError(f"no sort key: {text}")
    return SortKey(int(m.group(1)), m.group(2) or "A", (m.group(3) or "I") == "I")


def matches(corpus: Corpus, query: str, level: str | None = None, full_spans: bool = True) -> DataFrame:
    """``keys, pos, last_pos, start, end, terms`` of every match of the query's terms and exact phrases in matching rows. With
    ``full_spans`` a phrase is one match from its first word to its last, otherwise each word of it is one."""
    level = level or corpus.default_level
    keys = corpus.keys(level)
    c = compiled(corpus, query, level)
    nodes = [x.node for x in c.leaves if x.scores and not (x.field and x.field != corpus.content)]
    if not nodes:
        raise q.QueryError("nothing in the query can be marked")
    hits = small(c.hits.select(*keys), "hits")
    one = lambda rows: rows.select(*keys, "pos", F.col("pos").alias("last_pos"), "start", "end", F.col("term").alias("terms"))
    parts = [_spans(corpus, x, level, full_spans, hits) for x in nodes if isinstance(x, q.Phrase)]
    if terms := [x.text for x in nodes if isinstance(x, q.Term)]:
        parts.append(one(corpus.placed(level, hits, terms)))
    if wide := [Compiler(corpus, level).expansion(x) for x in nodes if not isinstance(x, (q.Term, q.Phrase))]:
        parts.append(one(corpus.placed(level, hits).join(small(reduce(DataFrame.unionByName, wide).distinct(), "words"), "term", "left_semi")))
    return reduce(DataFrame.unionByName, parts).distinct()


def _spans(corpus: Corpus, node: q.Phrase, level: str, full_spans: bool, hits: DataFrame) -> DataFrame:
    keys, n = corpus.keys(level), len(node.slots)
    found = Compiler(corpus, level).phrase(node).join(hits, keys, "left_semi").select(*keys, F.explode("at").alias("first"))
    words = found.select(*keys, "first", F.explode(F.sequence(F.lit(0), F.lit(n - 1 + node.slop))).alias("k")).withColumn("pos", F.col("first") + F.col("k"))
    options = [o for s in node.slots for o in s]
    named = [o.text for o in options] if all(isinstance(o, q.Term) for o in options) else None
    words = words.join(corpus.placed(level, hits, named), [*keys, "pos"])
    if node.slop:  # only words that a slot names
        words = words.filter(reduce(lambda a, b: a | b, [term_condition(o, F.col("term")) for s in node.slots for o in s]))
    if not full_spans:
        return words.select(*keys, "pos", F.col("pos").alias("last_pos"), "start", "end", F.col("term").alias("terms"))
    terms = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda w: w["term"]), " ")
    return words.groupBy(*keys, "first").agg(F.max("pos").alias("last_pos"), F.min("start").alias("start"), F.max("end").alias("end"), terms.alias("terms")).withColumnRenamed("first", "pos").select(*keys, "pos", "last_pos", "start", "end", "terms")


def _ranked(corpus: Corpus, found: DataFrame, level: str) -> DataFrame:
    """``keys, pos, term, n`` of all words of the rows that ``found`` is in, by their number among those with a term."""
    keys = corpus.keys(level)
    words = corpus.placed(level, small(found.select(*keys).distinct()))
    return words.select(*keys, "pos", "term", F.row_number().over(Window.partitionBy(*keys).orderBy("pos")).alias("n"))


def neighbour(corpus: Corpus, found: DataFrame, level: str, distance: int, name: str, ranked: DataFrame | None = None) -> DataFrame:
    """``found`` with the term that stands ``distance`` words before (negative) or after the match; empty where there is none.
    Words without a term are no neighbours. ``ranked`` are the words, if they are at hand."""
    keys = corpus.keys(level)
    if distance == 0:
        return found.withColumn(name, F.col("terms"))
    ranked = _ranked(corpus, found, level) if ranked is None else ranked
    edge = "last_pos" if distance > 0 else "pos"
    at = ranked.select(*keys, F.col("pos").alias(edge), (F.col("n") + distance).alias("n"))
    words = at.join(ranked.select(*keys, "n", F.col("term").alias(name)), [*keys, "n"]).drop("n")
    return found.join(words, [*keys, edge], "left").withColumn(name, F.coalesce(name, F.lit("")))


def kwic(corpus: Corpus, query: str, level: str | None = None, sort: list[str] | None = None, fields: list[str] | None = None, limit: int = 20, offset: int = 0, full_spans: bool = True) -> DataFrame:
    """``keys, start, end, terms, match, snippet, sort_0 ..., fields``: matches in order of their neighbours, each with the text
    of its row (a sentence, where the level is that)."""
    level = level or corpus.default_level
    keys = corpus.keys(level)
    rows = written(matches(corpus, query, level, full_spans), "matches")
    order: list[Column] = []
    sort_keys = [sort_key(s) for s in sort or []]
    ranked = written(_ranked(corpus, rows, level), "words") if any(k.distance for k in sort_keys) else None
    for k, key in enumerate(sort_keys):
        rows = neighbour(corpus, rows, level, key.distance, f"sort_{k}", ranked)
        c = F.lower(f"sort_{k}") if key.insensitive else F.col(f"sort_{k}")
        order.append(c.asc() if key.direction == "A" else c.desc())
    top = rows.orderBy(*order, *keys, "start") if offset or limit != -1 else rows
    top = top.offset(offset) if offset else top
    top = top if limit == -1 else top.limit(limit)
    more = [f for f in fields or [] if f not in keys]
    text = corpus.rows(level) if more else corpus.level(level).text_rows(corpus.content)
    text = text.select(*keys, F.col(corpus.content).alias("snippet"), *more)
    out = text.join(small(top, "page"), keys)
    out = out.withColumn("match", F.substring("snippet", F.col("start") + 1, F.col("end") - F.col("start")))
    return out.orderBy(*order, *keys, "start").select(*keys, "start", "end", "terms", "match", "snippet", *[f"sort_{k}" for k in range(len(order))], *[f for f in fields or [] if f not in keys])


def texts(corpus: Corpus, found: DataFrame, level: str | None = None) -> DataFrame:
    """``keys, text`` and the columns of ``found``, which has rows of the level."""
    keys = corpus.keys(level)
    return corpus.level(level).text_rows(corpus.content).select(*keys, F.col(corpus.content).alias("text")).join(small(found, "found"), keys)


def passages(corpus: Corpus, query: str, unit: str = "SENTENCE", level: str = "DOCUMENT", join_matches: bool = True, most: int = -1) -> DataFrame:
    """``keys, passage, start, end, n_matches, score, snippet``: the units that hold matches, with ``<b>`` around these. Matches
    in one unit share a passage, or get one each without ``join_matches``; ``most`` keeps the best of a document, in order of
    the text. A passage's score is the sum of 1 + ln(frequency) over its terms."""
    keys = corpus.keys(level)
    found = matches(corpus, query, level)
    lists = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end", "terms"))).alias("found"))
    rows = texts(corpus, lists, level)
    marked = F.arrow_udf(_passages(unit, join_matches, most), "array<struct<start:int,end:int,n_matches:int,score:double,snippet:string>>")("text", "found")
    return rows.select(*keys, F.posexplode(marked).alias("passage", "p")).select(*keys, "passage", "p.*")


def _passages(unit: str, join_matches: bool, most: int):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("n_matches", pa.int32()), ("score", pa.float64()), ("snippet", pa.string())]))

    def build(text: str, found: list[dict]) -> list[dict]:
        spans = unit_spans(text, unit)
        begins = [a for a, _ in spans]
        held: list[list] = []
        for m in found:
            centre = (m["start"] + m["end"]) // 2
            a, b = spans[max(0, bisect_right(begins, centre) - 1)]
            if join_matches and held and held[-1][0] <= m["start"] < held[-1][1]:
                held[-1][2].append(m)
                held[-1][1] = max(held[-1][1], m["end"])
            else:
                held.append([min(a, m["start"]), max(b, m["end"]), [m]])
        out = []
        for a, b, own in held:
            parts, at = [], a
            for m in own:
                if m["start"] < at:
                    continue
                parts += [text[at : m["start"]], "<b>", text[m["start"] : m["end"]], "</b>"]
                at = m["end"]
            score = sum(1 + math.log(n) for n in Counter(m["terms"] for m in own).values())
            out.append({"start": a, "end": b, "n_matches": len(own), "score": score, "snippet": "".join(parts) + text[at:b]})
        if most != -1 and len(out) > most:
            best = sorted(range(len(out)), key=lambda k: (-out[k]["score"], k))[:most]
            out = [out[k] for k in sorted(best)]
        return out

    def passages_of(texts: pa.Array, found: pa.Array) -> pa.Array:
        return pa.array([build(t, f) for t, f in zip(texts.to_pylist(), found.to_pylist())], kind)

    return passages_of


def marked(text: Column, start: Column, end: Column) -> Column:
    """A text with one place in bold."""
    return F.concat(F.substring(text, F.lit(1), start), F.lit("<b>"), F.substring(text, start + 1, end - start), F.lit("</b>"), F.substring(text, end + 1, F.length(text)))


def offset_data(points: DataFrame, data: DataFrame, keys: list[str], mode: str = "EXACT", convert=None) -> DataFrame:
    """``points`` (keys, offset) with the ``data`` (keys, offset, data) at, at or before (PREV), or at or after (NEXT) them.

    Both sides go through one shuffle and a running last (or first) value, so a document with many points and many entries
    makes no product of them."""
    if mode == "EXACT":
        out = points.join(data.groupBy(*keys, "offset").agg(F.min("data").alias("data")), [*keys, "offset"], "left")
    else:
        united = points.select(*keys, "offset", F.lit(None).cast("string").alias("d"), F.lit(1).alias("point")).unionByName(data.select(*keys, "offset", F.col("data").alias("d"), F.lit(0).alias("point")))
        if mode == "PREV":  # of entries at one offset the greatest, to agree on one
            frame = Window.partitionBy(*keys).orderBy("offset", "point", F.asc_nulls_first("d")).rowsBetween(Window.unboundedPreceding, 0)
            value = F.last("d", ignorenulls=True).over(frame)
        else:
            frame = Window.partitionBy(*keys).orderBy("offset", F.desc("point"), F.asc_nulls_first("d")).rowsBetween(0, Window.unboundedFollowing)
            value = F.first("d", ignorenulls=True).over(frame)
        out = united.withColumn("data", value).filter("point = 1").select(*keys, "offset", "data")
    return out.withColumn("data", convert(F.col("data"))) if convert else out


def offset_list(data: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, entries``: all entries of a document in order."""
    return data.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("offset", "data"))).alias("entries"))
