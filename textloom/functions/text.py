"""Text analysis as column expressions: terms, their places, and text units."""

from __future__ import annotations

import bisect
import re
import string
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SENTENCE = r"[^.!?]+[.!?]*"

# Tokens are found in Arrow batches, a text at a time: no token is shuffled to learn its place, nor a term to be counted.

#: A token runs to the next white space; one that ends in a hyphen at a line end goes on in the next line.
_SPACE = " \t\n\f\r"
_TOKEN = re.compile(rf"(?:[^{_SPACE}]*-[{_SPACE}]+(?=[^{_SPACE}]))*[^{_SPACE}]+")
_PLAIN = re.compile(rf"[^{_SPACE}]+")
_BREAK = re.compile(rf"-[{_SPACE}]+")
#: Rows of a batch that is sent on, pairs of a document and a term that are sorted at a time, texts that are strings at a time,
#: tokens whose terms a worker keeps.
_ROWS, _PAIRS, _SLICE, _KNOWN = 200_000, 1_000_000, 64, 300_000


class Terms(dict):
    """Tokens' terms: joined over their line end, without punctuation at their ends, in lower case."""

    def __missing__(self, token: str) -> str:
        if len(self) >= _KNOWN:
            self.clear()
        joined = _BREAK.sub("", token) if "-" in token else token
        # each letter by itself: no sigma of word ends, no dot of its own
        self[token] = term = joined.strip(string.punctuation).replace("Σ", "σ").replace("İ", "i").lower()
        return term


def term_of(token: Column) -> Column:
    """A token's term, as an expression: for streams, which can't wait for batches of texts."""
    joined = F.regexp_replace(token, rf"-[{_SPACE}]+", "")
    return F.lower(F.translate(F.btrim(joined, F.lit(string.punctuation)), "Σİ", "σi"))


def token_array(text: Column) -> Column:
    joined = F.regexp_replace(F.regexp_replace(text, rf"^[{_SPACE}]+|[{_SPACE}]+$", ""), rf"-[{_SPACE}]+", "")
    return F.split(joined, rf"[{_SPACE}]+")


def split_tokens(text: str) -> list[str]:
    """A text's tokens, joined over line ends."""
    if "-" in text:
        text = _BREAK.sub("", text.strip(_SPACE))
    for c in _SPACE[1:]:
        if c in text:
            text = text.replace(c, " ")
    return [t for t in text.split(" ") if t]


def _texts(column: pa.Array) -> Iterator[str]:
    for at in range(0, len(column), _SLICE):
        for t in column.slice(at, _SLICE).to_pylist():
            yield t or ""


def _mapped(units: DataFrame, keys: list[str], text: str, found: Callable[[Iterator], Iterator], kinds: list[tuple[str, str]]) -> DataFrame:
    """``keys`` and columns of ``kinds``: ``found`` makes of (batch of keys, texts) the numbers of rows and the columns."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = ((b.select(range(len(keys))), _texts(b.column(len(keys)))) for b in batches)
        for own, at, *columns in found(pairs):
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in own), *columns], [*keys, *(k for k, _ in kinds)])

    fields = [units.schema[k] for k in keys] + [T.StructField(k, T.IntegerType() if kind == "int" else T.LongType() if kind == "long" else T.StringType()) for k, kind in kinds]
    return units.select(*keys, text).mapInArrow(mapped, T.StructType(fields))


def _ints(numbers: array) -> pa.Array:
    return pa.array(np.frombuffer(numbers, np.int32))


def tokens(units: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys, pos, term``: positions count every token from 0, those without a term too, which give no row."""

    def found(pairs):
        known = Terms()
        for own, texts in pairs:
            at, pos, terms = array("i"), array("i"), []
            for i, t in enumerate(texts):
                for p, token in enumerate(split_tokens(t)):
                    if term := known[token]:
                        at.append(i)
                        pos.append(p)
                        terms.append(term)
                if len(at) > _ROWS:
                    yield own, _ints(at), _ints(pos), pa.array(terms, pa.string())
                    at, pos, terms = array("i"), array("i"), []
            yield own, _ints(at), _ints(pos), pa.array(terms, pa.string())

    return _mapped(units, keys, text, found, [("pos", "int"), ("term", "string")])


def tokens_with_places(units: DataFrame, keys: list[str], text: str = "text", only: Iterable[str] | None = None) -> DataFrame:
    """``keys, pos, term, start, end``: as ``tokens``, with the characters of the text that a token covers; of the terms ``only``
    alone, if given."""
    wanted = None if only is None else frozenset(only)

    def found(pairs):
        known = Terms()
        for own, texts in pairs:
            at, pos, start, end, terms = array("i"), array("i"), array("i"), array("i"), []
            for i, t in enumerate(texts):
                for p, m in enumerate((_TOKEN if _BREAK.search(t) else _PLAIN).finditer(t)):
                    if (term := known[m[0]]) and (wanted is None or term in wanted):
                        at.append(i)
                        pos.append(p)
                        start.append(m.start())
                        end.append(m.end())
                        terms.append(term)
                if len(at) > _ROWS:
                    yield own, _ints(at), _ints(pos), pa.array(terms, pa.string()), _ints(start), _ints(end)
                    at, pos, start, end, terms = array("i"), array("i"), array("i"), array("i"), []
            yield own, _ints(at), _ints(pos), pa.array(terms, pa.string()), _ints(start), _ints(end)

    return _mapped(units, keys, text, found, [("pos", "int"), ("term", "string"), ("start", "int"), ("end", "int")])


def term_counts(units: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys, term, tf`` of each text, in runs of rows sorted by term."""

    def found(pairs):
        known, names, tables, before = Terms(), {}, [], 0
        at, ids, tf = array("i"), array("i"), array("i")

        def run():
            order = sorted(names)
            rank = np.empty(len(order), np.int32)
            rank[[names[x] for x in order]] = np.arange(len(order), dtype=np.int32)
            rows = rank[np.frombuffer(ids, np.int32)]
            by = np.argsort(rows, kind="stable")
            own = pa.Table.from_batches(tables).combine_chunks().to_batches()[0]
            return own, pa.array(np.frombuffer(at, np.int32)[by]), pa.array(order, pa.string()).take(pa.array(rows[by])), pa.array(np.frombuffer(tf, np.int32)[by].astype(np.int64))

        for own, texts in pairs:
            tables.append(own)
            for i, t in enumerate(texts):
                counts: dict[str, int] = {}
                for token in split_tokens(t):
                    term = known[token]
                    counts[term] = counts.get(term, 0) + 1
                counts.pop("", None)
                at.extend([before + i] * len(counts))
                for term in counts:
                    ids.append(names.setdefault(term, len(names)))
                tf.extend(counts.values())
                if len(at) > _PAIRS:
                    yield run()
                    at, ids, tf, names = array("i"), array("i"), array("i"), {}
            before += own.num_rows
            if not at:
                tables, before = [], 0
            elif before > _PAIRS:
                yield run()
                at, ids, tf, names, tables, before = array("i"), array("i"), array("i"), {}, [], 0
        if at:
            yield run()

    return _mapped(units, keys, text, found, [("term", "string"), ("tf", "long")])


def analyzed_places(units: DataFrame, keys: list[str], text: str, analyzer) -> DataFrame:
    """``tokens_with_places`` of an analyzer's terms."""

    def placed(texts: pa.Array, terms: pa.Array) -> pa.Array:
        out = []
        for t, own in zip(texts.to_pylist(), terms.to_pylist()):
            # a character whose lower case has another length would move what follows
            low, at, found = "".join(c.lower() if len(c.lower()) == 1 else c for c in t or ""), 0, []
            for pos, term in enumerate(own or []):
                if term and (start := low.find(term.lower(), at)) >= 0:
                    at = start + len(term)
                    found.append({"pos": pos, "term": term, "start": start, "end": at})
            out.append(found)
        return pa.array(out, pa.list_(pa.struct([("pos", pa.int32()), ("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))

    found = F.arrow_udf(placed, "array<struct<pos:int,term:string,start:int,end:int>>")(F.col(text), analyzer(F.col(text)))
    return units.select(*keys, F.explode(found).alias("p")).select(*keys, "p.*")


# ---------------------------------------------------------------- letters

#: Letters of which ``upper`` makes several, or one that only a newer Unicode knows, with the one capital that SQL gives them.
_CAPITALS = {c: "ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in map(chr, range(0x10000)) if len(c.upper()) > 1}
_CAPITALS |= {c: c for c in map(chr, (0x19B, 0x264, 0x1C8A, 0xA7CD, 0xA7DB, *range(0x10D70, 0x10D86)))}


def capitals(text: Column) -> Column:
    """Each letter by the one capital it has, ß by ẞ; a letter without one stays."""
    own = F.create_map(*[F.lit(x) for pair in _CAPITALS.items() for x in pair])
    letters = F.transform(F.split(text, ""), lambda c: F.coalesce(own[c], F.upper(c)))
    return F.when(text.rlike(f"[{''.join(_CAPITALS)}]"), F.array_join(letters, "")).otherwise(F.upper(text))


def trimmed(text: Column) -> Column:
    """Without space separators at either end, those that don't break too; tabs and line ends stay."""
    return F.regexp_replace(text, r"\A\p{Zs}+|\p{Zs}+\z", "")


# ---------------------------------------------------------------- text units


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def paragraphs(text: Column) -> Column:
    return F.split(text, "\n\n+")


def sentences(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))


def characters(text: Column) -> Column:
    return F.split(text, "(?s)(?<=.)(?=.)")


UNITS = {"LINE": lines, "PARAGRAPH": paragraphs, "SENTENCE": sentences, "CHARACTER": characters, "DOCUMENT": lambda t: F.array(t)}


def segments(units: DataFrame, keys: list[str], unit: str, text: str = "text") -> DataFrame:
    """``keys, seg, text``: the units of each text, counted from 0."""
    return units.select(*keys, F.posexplode(UNITS[unit](F.col(text))).alias("seg", "text"))


def expand(segs: DataFrame, keys: list[str], left: int, right: int, joiner: str) -> DataFrame:
    """Each unit with ``left`` units before it and ``right`` after, clamped at the text's ends, as ``context``."""
    from pyspark.sql import Window

    frame = Window.partitionBy(*keys).orderBy("seg").rowsBetween(-left, right)
    return segs.withColumn("context", F.array_join(F.collect_list("text").over(frame), joiner))


# Breaks of words and tokens need Unicode rules that Spark has no function for.

_WORD = r"\w+(?:['’.]\w+)*"


def unit_spans(text: str, unit: str) -> list[tuple[int, int]]:
    """Begin and end of each unit. CHARACTER, WORD (words alone), TOKEN (words, white space and single marks), SENTENCE, LINE,
    PARAGRAPH, DOCUMENT."""
    if unit == "CHARACTER":
        return [(i, i + 1) for i in range(len(text))]
    if unit == "DOCUMENT":
        return [(0, len(text))]
    return list(_unit_spans(text, unit))


def _unit_spans(text: str, unit: str) -> Iterator[tuple[int, int]]:
    pattern = {"WORD": _WORD, "TOKEN": rf"{_WORD}|(?s:.)", "SENTENCE": r"[^.!?]+[.!?]*\s*", "LINE": r"[^\n]*\n?", "PARAGRAPH": r"(?s).+?(?:\n\n+|$)"}[unit]
    return (m.span() for m in re.finditer(pattern, text) if m.end() > m.start())


def expanded_span(text: str, unit: str, at: int, left: int = 0, right: int = 0) -> tuple[int, int]:
    """The unit that holds character ``at`` (or, between words, the one before it), with its neighbours. Where these run out
    it reaches to the text's end, beyond the last word too."""
    spans = unit_spans(text, unit)
    if not spans:
        return 0, 0
    k = max((i for i, (a, _) in enumerate(spans) if a <= at), default=0)
    return spans[k - left][0] if k >= left else 0, spans[k + right][1] if k + right < len(spans) else len(text)


class Units:
    """A place among the bounds of a text's units that moves from unit to unit; every move returns the new place, or DONE.

    Moves that expand go ``left`` or ``right`` units further. WORD moves over whatever isn't a word and stops at the starts
    (backwards) or ends (forwards) of words."""

    DONE = -1

    def __init__(self, text: str, unit: str, left: int = 0, right: int = 0):
        spans = unit_spans(text, "TOKEN" if unit == "WORD" else unit)
        self.bounds = sorted({0, len(text), *(x for span in spans for x in span)})
        self.worded = [any(c.isalnum() for c in text[a:b]) for a, b in zip(self.bounds, self.bounds[1:])]
        self.words, self.left, self.right, self.at = unit == "WORD", left, right, 0

    def _step(self, by: int) -> bool:
        """One unit on; for words, on to the far bound of the next word. At the text's end it stays there."""
        k = self.at
        while 0 <= k + by < len(self.bounds):
            k += by
            if not self.words or self.worded[min(k, k - by)]:
                self.at = k
                return True
        self.at = len(self.bounds) - 1 if by > 0 else 0
        return False

    def _place(self, moved: bool) -> int:
        return self.bounds[self.at] if moved else self.DONE

    def next(self) -> int:
        return self._place(all([self._step(1) for _ in range(self.right + 1)]))

    def previous(self) -> int:
        return self._place(all([self._step(-1) for _ in range(self.left + 1)]))

    def following(self, offset: int) -> int:
        """The first bound after ``offset``, then ``right`` units on; the text's end where they run out."""
        self.at = bisect.bisect_right(self.bounds, offset)
        if self.at == len(self.bounds):
            self.at -= 1
            return self.DONE
        return self._place(all([self._step(1) for _ in range(self.right)]) or True)

    def preceding(self, offset: int) -> int:
        """The last bound before ``offset``, then ``left`` units back; the text's start where they run out."""
        self.at = bisect.bisect_left(self.bounds, offset) - 1
        if self.at < 0:
            self.at = 0
            return self.DONE
        return self._place(all([self._step(-1) for _ in range(self.left)]) or True)

    def _word_start(self, k: int) -> int:
        while k < len(self.worded) and not self.worded[k]:
            k += 1
        self.at = k
        return self._place(k < len(self.worded))

    def following_word_start(self, offset: int) -> int:
        """The start of the first word that begins after ``offset``."""
        return self._word_start(bisect.bisect_right(self.bounds, offset))

    def next_word_start(self) -> int:
        """The start of the next word."""
        return self._word_start(self.at + 1)


def unit_rows(docs: DataFrame, unit: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, seg, start, end`` of every unit of every text, sent on so many at a time that a worker never holds those of a batch."""

    def found(pairs):
        for own, texts in pairs:
            at, seg, start, end = (array("i") for _ in range(4))
            for i, t in enumerate(texts):
                for k, (a, b) in enumerate(_unit_spans(t, unit) if unit in ("WORD", "TOKEN") else unit_spans(t, unit)):
                    at.append(i)
                    seg.append(k)
                    start.append(a)
                    end.append(b)
                    if len(at) == _ROWS:
                        yield own, *map(_ints, (at, seg, start, end))
                        at, seg, start, end = (array("i") for _ in range(4))
            yield own, *map(_ints, (at, seg, start, end))

    return _mapped(docs.withColumn(key, F.col(key).cast("long")), [key], text, found, [("seg", "int"), ("start", "int"), ("end", "int")])
