"""Query trees to plans.

Every leaf of a query (a term, a phrase, a range, a sub-query ...) gives rows ``keys, leaf, freq``. The leaves' rows are
united and aggregated once by the keys, and the Boolean structure becomes one expression over the leaves' frequencies: any
combination of clauses costs one shuffle, and the terms of all clauses one scan of the term table, with their list pushed
down to it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.fuzzy import within_edits
from ..sources.corpus import Corpus
from ..sources.store import small
from . import query as q

INT, LONG, FLOAT, DOUBLE, LATLON = "INTPOINT", "LONGPOINT", "FLOATPOINT", "DOUBLEPOINT", "LATLONPOINT"
_CASTS = {INT: "int", LONG: "long", FLOAT: "float", DOUBLE: "double"}
_DATE = r"^\d{4}-\d{2}(-\d{2}.*)?$"


@dataclass
class Leaf:
    node: q.Node
    field: str | None
    number: int
    scores: bool = True
    text: bool = False


@dataclass
class Compiled:
    """``hits``: keys and ``f0, f1, ...`` (a leaf's frequency or null), for rows that match."""

    hits: DataFrame
    leaves: list[Leaf] = field(default_factory=list)
    constraint_only: bool = False


class Compiler:
    def __init__(self, corpus: Corpus, level: str, lexicon: DataFrame | None = None, coarse_and_at_fine_rows: bool = False):
        self.corpus, self.level, self.lexicon = corpus, corpus.level(level), lexicon
        #: Whether <COARSE§a b§FINE> needs a and b in one fine row.
        self.literal = coarse_and_at_fine_rows
        self.keys = self.level.keys

    # ------------------------------------------------------------ structure

    def compile(self, node: q.Node) -> Compiled:
        leaves: list[Leaf] = []
        matches = self._match(node, leaves, True)
        only_filters = bool(leaves) and not any(x.scores for x in leaves)
        rows = [self._leaf_rows(leaves)] if leaves else []
        if self._needs_all(node) or not leaves:
            rows.append(self.corpus.rows(self.level.id).select(*self.keys, F.lit(None).cast("int").alias("leaf"), F.lit(None).cast("long").alias("freq")))
        united = reduce(DataFrame.unionByName, rows)
        sums = [F.sum(F.when(F.col("leaf") == x.number, F.col("freq"))).alias(f"f{x.number}") for x in leaves]
        hits = united.groupBy(*self.keys).agg(*sums) if sums else united.select(*self.keys)
        return Compiled(hits.filter(matches) if leaves else hits, leaves, only_filters)

    def _needs_all(self, node: q.Node) -> bool:
        """Whether a row without any leaf can match."""
        if isinstance(node, q.MatchAll):
            return True
        if isinstance(node, q.Boost):
            return self._needs_all(node.node)
        if isinstance(node, q.Bool):
            must = [c for c in node.clauses if c.occur in ("MUST", "FILTER")]
            should = [c for c in node.clauses if c.occur == "SHOULD"]
            if must:
                return all(self._needs_all(c.node) for c in must)
            return not should or any(self._needs_all(c.node) for c in should)
        return False

    def _match(self, node: q.Node, leaves: list[Leaf], scores: bool) -> Column:
        if isinstance(node, q.Boost):
            return self._match(node.node, leaves, scores and node.by != 0)
        if isinstance(node, q.Bool):
            parts = {o: [self._match(c.node, leaves, scores and o in ("MUST", "SHOULD")) for c in node.clauses if c.occur == o] for o in ("MUST", "FILTER", "SHOULD", "NOT")}
            out = [*parts["MUST"], *parts["FILTER"], *(~x for x in parts["NOT"])]
            if parts["SHOULD"] and not parts["MUST"] and not parts["FILTER"]:
                out.append(reduce(lambda a, b: a | b, parts["SHOULD"]))
            return reduce(lambda a, b: a & b, out)
        if isinstance(node, q.MatchAll):
            return F.lit(True)
        if isinstance(node, q.Sub) and node.level == node.target == self.level.id:
            return self._match(node.query, leaves, scores)
        own = getattr(node, "field", None)
        # an exact phrase over a keyword field is its whole value
        if isinstance(node, q.Phrase) and own and self._indexed(own) != "TEXT":
            node = q.Term(own, " ".join(t.text for (t, *_) in node.slots if isinstance(t, q.Term)))
        x = Leaf(node, own, len(leaves), scores, not isinstance(node, (q.Sub, q.Phrase)) and self._indexed(own) == "TEXT")
        leaves.append(x)
        return F.col(f"f{x.number}").isNotNull()

    def _indexed(self, name: str | None) -> str:
        return "TEXT" if name is None or name == self.corpus.content else self.corpus.field(self.level.id, name).indexed_as

    # ------------------------------------------------------------ leaves

    def _leaf_rows(self, leaves: list[Leaf]) -> DataFrame:
        plain = [x for x in leaves if x.text and isinstance(x.node, q.Term)]
        other = [x for x in leaves if x.text and not isinstance(x.node, q.Term)]
        out = []
        if plain:
            by_term: dict[str, list[int]] = {}
            for x in plain:
                by_term.setdefault(x.node.text, []).append(x.number)
            numbers = F.create_map(*[c for t, n in by_term.items() for c in (F.lit(t), F.array(*map(F.lit, n)))])
            rows = self.corpus.doc_terms(self.level.id).filter(F.col("term").isin(list(by_term)))
            out.append(rows.select(*self.keys, F.explode(numbers[F.col("term")]).alias("leaf"), F.col("tf").alias("freq")))
        if other:  # expanded over the dictionary, then joined
            words = reduce(DataFrame.unionByName, [self.expansion(x.node).select("term", F.lit(x.number).alias("leaf")) for x in other])
            rows = self.corpus.doc_terms(self.level.id).join(small(words, "words"), "term")
            out.append(rows.groupBy(*self.keys, "leaf").agg(F.sum("tf").alias("freq")))
        for x in leaves:
            if isinstance(x.node, q.Phrase):
                rows = self.phrase(x.node).select(*self.keys, "freq")
            elif isinstance(x.node, q.Sub):
                rows = self.sub(x.node)
            elif not x.text:
                rows = self.corpus.rows(self.level.id).filter(self.predicate(x.node)).select(*self.keys, F.lit(1).cast("long").alias("freq"))
            else:
                continue
            out.append(rows.select(*self.keys, F.lit(x.number).alias("leaf"), "freq"))
        return reduce(DataFrame.unionByName, out)

    def expansion(self, node: q.Node, level: str | None = None) -> DataFrame:
        """``term``: the dictionary's terms that a leaf stands for."""
        words = self.corpus.term_stats(level or self.level.id).select("term")
        if isinstance(node, q.Inflected):
            return self.forms(node).join(words, "term", "left_semi") if node.prefix == node.suffix == "" else words.join(self.forms(node).withColumnRenamed("term", "form"), F.col("term").startswith(F.concat(F.lit(node.prefix), "form")) if node.suffix in ("*",) else F.col("term") == F.concat(F.lit(node.prefix), "form", F.lit(node.suffix))).select("term").distinct()
        return words.filter(term_condition(node, F.col("term")))

    def forms(self, node: q.Inflected) -> DataFrame:
        if self.lexicon is None:
            raise q.QueryError("inflections need a lexicon (lemma, lang, form)")
        own = self.lexicon.filter(F.col("lang") == node.language)
        lemmas = own.filter((F.col("form") == node.word) | (F.col("lemma") == node.word)).select("lemma").distinct()
        return own.join(lemmas, "lemma", "left_semi").select(F.col("form").alias("term")).distinct()

    # metadata

    def predicate(self, node: q.Node) -> Column:
        """A leaf on a field that isn't text, as a filter of the level's rows."""
        name = node.field
        kind, col = self._indexed(name), F.col(name)
        dtype = dict(self.corpus.rows(self.level.id).dtypes)[name]
        if isinstance(node, q.Wildcard) and node.pattern == "*":
            return col.isNotNull()
        if kind == LATLON:
            return geo.query(col["lat"], col["lon"], node.text)
        if kind == "STRING":
            test = lambda c: term_condition(node, c)
            return F.exists(col, test) if dtype.startswith("array") else test(col)
        value = lambda x: self.value(x, kind, dtype)
        if isinstance(node, q.Term):
            return F.array_contains(col, value(node.text)) if dtype.startswith("array") else col == value(node.text)
        if isinstance(node, q.Range):
            def inside(c: Column) -> Column:
                parts = [F.lit(True)]
                if node.low is not None:
                    parts.append(c >= value(node.low) if node.with_low else c > value(node.low))
                if node.high is not None:
                    parts.append(c <= value(node.high) if node.with_high else c < value(node.high))
                return reduce(lambda a, b: a & b, parts) & c.isNotNull()

            return F.exists(col, inside) if dtype.startswith("array") else inside(col)
        raise q.QueryError(f"{type(node).__name__} isn't for field {name} ({kind})")

    @staticmethod
    def value(text: str, kind: str, dtype: str = "") -> Column:
        """A number, or where the field is a time or the text is a date, that time (as milliseconds in a number field)."""
        import re

        if kind == LONG and re.match(_DATE, text):
            at = F.to_timestamp(F.lit(text if len(text) > 7 else text + "-01"))
            return at.cast(dtype) if dtype.startswith("timestamp") else F.unix_millis(at)
        if dtype.startswith("timestamp"):
            return F.timestamp_millis(F.lit(int(text)))
        return F.lit(int(text) if kind in (INT, LONG) else float(text)).cast(_CASTS[kind])

    # phrases

    def phrase(self, node: q.Phrase, with_places: bool = False) -> DataFrame:
        """``keys, freq, at``: matches in each row, and the positions of their first words (of all of them in any order)."""
        named: dict[str, list[int]] = {}
        wide: list[DataFrame] = []
        for k, options in enumerate(node.slots):
            for o in options:
                if isinstance(o, q.Term):
                    named.setdefault(o.text, []).append(k)
                else:
                    wide.append(self.expansion(o).select("term", F.lit(k).alias("slot")))
        tokens, rows = self.corpus.tokens(self.level.id), []
        if named:
            slots = F.create_map(*[c for t, n in named.items() for c in (F.lit(t), F.array(*map(F.lit, sorted(set(n)))))])
            rows.append(tokens.filter(F.col("term").isin(list(named))).select(*self.keys, "pos", F.explode(slots[F.col("term")]).alias("slot")))
        if wide:
            rows.append(tokens.join(small(reduce(DataFrame.unionByName, wide).distinct(), "words"), "term").select(*self.keys, "pos", "slot"))
        n = len(node.slots)
        lists = [F.array_sort(F.collect_set(F.when(F.col("slot") == k, F.col("pos")))).alias(f"p{k}") for k in range(n)]
        placed = reduce(DataFrame.unionByName, rows).groupBy(*self.keys).agg(*lists)
        placed = placed.filter(reduce(lambda a, b: a & b, [F.size(f"p{k}") > 0 for k in range(n)]))
        if node.slop == 0 and node.ordered:  # by set intersection of shifted positions
            at = reduce(F.array_intersect, [F.transform(f"p{k}", _shift(-k)) for k in range(n)])
        elif n == 2:
            # every distance is one intersection, so cost grows with the slop and not with the product of the lists
            ahead = [F.array_intersect("p0", F.transform("p1", _shift(-d))) for d in range(1, node.slop + 2)]
            behind = [] if node.ordered else [F.array_intersect("p0", F.transform("p1", _shift(d))) for d in range(1, node.slop + 2)]
            at = F.array_distinct(F.flatten(F.array(*ahead, *behind)))
        else:
            at = F.arrow_udf(_near(node.slop, node.ordered), "array<int>")(*[F.col(f"p{k}") for k in range(n)])
        found = placed.select(*self.keys, F.array_sort(at).alias("at")).filter(F.size("at") > 0)
        return found.select(*self.keys, F.size("at").cast("long").alias("freq"), "at")

    # sub-queries

    def sub(self, node: q.Sub) -> DataFrame:
        """``keys, freq`` of the rows here that a query at another level, or on a field's values, names."""
        corpus, own = self.corpus, self.level.id
        inner_level = node.level if node.level in corpus.levels else own
        if inner_level not in corpus.levels:
            raise q.QueryError(f"no level {node.level}")
        run_at = inner_level
        if self.literal and corpus.order[inner_level] < corpus.order[own] and node.target in corpus.levels:
            run_at = own
        inner = Compiler(corpus, run_at, self.lexicon, self.literal).compile(node.query).hits
        rows = corpus.rows(own)
        if node.target in corpus.levels:  # by the key of the coarser of the two
            coarse = min((inner_level, node.target, own), key=lambda x: corpus.order[x])
            by = corpus.keys(coarse)
            source = inner if set(by) <= set(inner.columns) else corpus.rows(run_at).join(inner.select(*corpus.keys(run_at)), corpus.keys(run_at), "left_semi")
            found = rows.join(small(source.select(*by).distinct()), by, "left_semi")
        else:  # by a field that any match has
            matching = corpus.rows(inner_level).join(inner.select(*corpus.keys(inner_level)), corpus.keys(inner_level), "left_semi")
            found = field_semi_join(rows, matching, node.target, self.keys)
        return found.select(*self.keys, F.lit(1).cast("long").alias("freq"))


def key_values(rows: DataFrame, name: str, keep: list[str]) -> DataFrame:
    """``keep, value``: a field's values, each one of several in a row of its own."""
    kind = dict(rows.dtypes)[name]
    col = F.col(name)
    if kind.startswith("map<"):
        col = F.explode(F.map_keys(col))
    elif kind.startswith("array<"):
        col = F.explode(col)
    elif kind.startswith("struct<"):
        col = F.to_json(col)
    return rows.select(*keep, col.alias("value"))


_COERCIONS = {("string", "bigint"), ("string", "int"), ("string", "double"), ("string", "float"), ("int", "bigint"), ("int", "double"), ("int", "float"), ("bigint", "double"), ("float", "double"), ("bigint", "float")}


def coerced(kind: str, other: str) -> str:
    """The type in which keys of two types meet."""
    if kind == other:
        return kind
    for a, b in ((kind, other), (other, kind)):
        if (a, b) in _COERCIONS:
            return b
    raise q.QueryError(f"keys of types {kind} and {other} can't be compared")


def field_semi_join(rows: DataFrame, matching: DataFrame, name: str, keys: list[str], other: str | None = None) -> DataFrame:
    """Rows that share any value of ``name`` with ``matching`` (there in the field ``other``)."""
    mine, theirs = key_values(rows, name, keys), key_values(matching, other or name, [])
    kind = coerced(dict(mine.dtypes)["value"], dict(theirs.dtypes)["value"])
    values = theirs.select(F.col("value").cast(kind)).filter("value is not null").distinct()
    hits = mine.withColumn("value", F.col("value").cast(kind)).join(values, "value", "left_semi").select(*keys).distinct()
    return rows.join(hits, keys, "left_semi")


def term_condition(node: q.Node, c: Column) -> Column:
    if isinstance(node, q.Term):
        return c == node.text
    if isinstance(node, q.Wildcard):
        return c.rlike("(?s)" + q.wildcard_regex(node.pattern))
    if isinstance(node, q.Regex):
        return c.rlike(q.checked_regex(node.pattern))
    if isinstance(node, q.Fuzzy):
        return within_edits(c, node.text, node.edits, node.prefix, node.transpositions)
    if isinstance(node, q.Range):
        parts = [F.lit(True)]
        if node.low is not None:
            parts.append(c >= node.low if node.with_low else c > node.low)
        if node.high is not None:
            parts.append(c <= node.high if node.with_high else c < node.high)
        return reduce(lambda a, b: a & b, parts)
    raise q.QueryError(f"{type(node).__name__} isn't for terms")


def _shift(by: int) -> Callable[[Column], Column]:
    return lambda p: p + by


def _near(slop: int, ordered: bool) -> Callable[..., pa.Array]:
    """First positions from which the slots' words follow within the slop; with ``ordered`` in order, the nearest each time."""

    def near(*lists: pa.Array) -> pa.Array:
        out = []
        for row in zip(*(x.to_pylist() for x in lists)):
            found = []
            slots = [np.asarray(x) for x in row]
            if ordered:
                for start in row[0]:
                    at = start
                    for s in slots[1:]:
                        k = int(np.searchsorted(s, at, "right"))
                        if k == len(s):
                            break
                        at = int(s[k])
                    else:
                        if at - start - (len(slots) - 1) <= slop:
                            found.append(start)
            else:  # every window that begins with some slot's word and holds all
                words = sorted({int(p) for s in slots for p in s})
                for start in words:
                    end = start + slop + len(slots) - 1
                    inside = [s[np.searchsorted(s, start) : np.searchsorted(s, end, "right")].tolist() for s in slots]
                    if all(inside) and any(start in x for x in inside) and _distinct(inside):
                        found.append(start)
            out.append(found)
        return pa.array(out, pa.list_(pa.int32()))

    return near


def _distinct(options: list[list[int]]) -> bool:
    """Whether each slot can take a position of its own."""
    taken: dict[int, int] = {}

    def place(k: int, seen: set[int]) -> bool:
        for p in options[k]:
            if p not in seen:
                seen.add(p)
                if p not in taken or place(taken[p], seen):
                    taken[p] = k
                    return True
        return False

    return all(place(k, set()) for k in range(len(options)))
