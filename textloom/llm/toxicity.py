"""Toxicity: a weighted lexicon found by an Aho-Corasick automaton in folded text, normalised by length.

Folding leaves ``a``-``z``, digits and single spaces: letters lose case and marks (composed or combining), look-alikes of
other scripts, mathematical letters and digits that stand for letters become those letters, ``i``, ``l``, ``1`` and ``|`` are
one letter, invisible characters go, whatever else is a space, and three or more equal letters in a row are one.

The lexicon has words and phrases made by hand (LEXICON, by language; those of ``""`` hold for all documents), which are also
found with doubled letters single and with their letters spaced out, and what ``learned`` adds: whole words and beginnings of
words, by language, weighted by the log ratio of their rates in toxic and clean labelled documents. Beginnings are chosen in
the tree of all beginnings, so that a family of words is one entry, as long as all its words share, and entries never nest.

``score`` is 1000 x the sum of the weights of all occurrences / max(characters, FLOOR_CHARS). Of the terms that begin at one
word that of the greatest weight counts; terms that overlap but begin at different words count each. A term doesn't count
where an exception phrase covers all its words, alone: two exception phrases that cover it only together don't.

Defined results: a null or empty text has score 0 and is never toxic; a null language is a language of its own; texts are
read whole, whatever their length; repeated rows get the same score each; a document labelled more than once is toxic if one
label says so, labels without doc_id or value take no part; without labels, or with labels of one kind only, nothing is
learnt; an empty table gives an empty result; other columns are neither read nor changed.
"""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Mapping
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, text_slices

_ENGLISH = {
    **dict.fromkeys(
        "idiot idiots moron morons imbecile stupid dumbass loser losers scum scumbag clown clowns trash garbage pathetic worthless "
        "disgusting degenerate lowlife pig filth filthy vermin dimwit halfwit nitwit cretin creep coward bastard bastards jerk "
        "asshole arsehole shithead dickhead prick wanker twat douchebag bitch bitches slut whore retard retarded braindead "
        "subhuman parasite".split(),
        1.0,
    ),
    **dict.fromkeys("motherfucker cunt faggot tranny nigger kike spic chink paki".split(), 2.0),
    **dict.fromkeys("dumb ugly crap fool fools hate damn sucks".split(), 0.5),
    **dict.fromkeys(("kill yourself", "kill you", "go die", "drop dead", "hope you die", "deserve to die", "beat you up", "waste of space", "piece of shit", "son of a bitch"), 1.5),
}
_GERMAN = {
    **dict.fromkeys("idioten dummkopf vollidiot trottel arschloch wichser hurensohn schlampe fotze abschaum missgeburt drecksau schwachkopf hackfresse spasti penner".split(), 1.0),
    **dict.fromkeys("dreckig blödmann depp scheisse scheiße".split(), 0.5),
    **dict.fromkeys(("bring dich um", "bringe dich um", "mach dich fertig", "halt die fresse", "halts maul", "geh sterben", "verpiss dich", "stück scheisse", "stück scheiße"), 1.5),
}
_FRENCH = {
    **dict.fromkeys("connard connasse salope putain enculé abruti crétin débile ordure imbécile bâtard pouffiasse raclure".split(), 1.0),
    **dict.fromkeys("merde dégueulasse".split(), 0.5),
    **dict.fromkeys(("ferme ta gueule", "ta gueule", "va mourir", "vais te tuer", "fils de pute", "va te faire foutre", "sale merde"), 1.5),
}
_SPANISH = {
    **dict.fromkeys("idiota imbécil gilipollas cabrón puta maricón subnormal escoria malparido zorra pendejo hijoputa".split(), 1.0),
    **dict.fromkeys("mierda estúpido estúpida asqueroso".split(), 0.5),
    **dict.fromkeys(("hijo de puta", "voy a matarte", "te voy a matar", "vete a la mierda", "cierra la boca", "ojalá te mueras", "pedazo de mierda"), 1.5),
}
#: (language, term) -> weight; grade 1 insults, grade 2 slurs, grade 1.5 threats and phrases, grade 0.5 words that are often
#: harmless.
LEXICON: dict[tuple[str, str], float] = {(lang, term): weight for lang, own in (("", _ENGLISH), ("de", _GERMAN), ("fr", _FRENCH), ("es", _SPANISH)) for term, weight in own.items()}
#: Phrases in which a term is harmless.
EXCEPTIONS: tuple[str, ...] = (
    "trash can", "trash bin", "trash bag", "trash day", "take out the trash", "garbage can", "garbage bin", "garbage truck", "garbage collection",
    "garbage collector", "garbage collected", "clown fish", "circus clown", "guinea pig", "pig iron", "jerk chicken", "parasite host",
    "hate crime", "hate speech", "sore loser", "damn good", "clown car", "fool proof",
)
#: Scores from here on are toxic: 0.4 is one grade-1 insult in 2500 characters.
THRESHOLD = 0.4
FLOOR_CHARS = 600

#: Labelled rows that ``learned`` fits at most, about; of more it draws these by a hash of doc_id.
LABELLED_ROWS = 20_000
#: A learnt term's log ratio of rates, in nats, that weighs as much as grade 1.
NATS = 12.0
#: Nats of likelihood that an entry must gain beyond all others, and toxic documents that it must occur in.
GAIN, LEAST_DOCS = 10.0, 3
SHORTEST, LONGEST = 3, 12

_LOOKALIKES = {
    "a": "аα@４ɑ", "b": "вьЬ８β", "c": "сϲ¢", "d": "ԁ", "e": "еєε€", "f": "ƒ", "g": "ɡ", "h": "һн", "i": "іιїӏ1l|¡１ⅼ", "j": "ј", "k": "кκ",
    "m": "м", "n": "ոпη", "o": "оοօ0０σø", "p": "рρ", "q": "ԛ", "r": "гᴦ", "s": "ѕ$５", "t": "тτ", "u": "υս", "v": "ѵν", "w": "ԝωш", "x": "хχ",
    "y": "уүγ", "z": "ᴢ",
}
_DIGITS = {"3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}


#: Letters that no decomposition leads to.
_LETTERS = {"ß": "s", "ẞ": "s", "æ": "a", "Æ": "a", "đ": "d", "Đ": "d", "ł": "l", "Ł": "l", "ħ": "h", "Ħ": "h", "ı": "i", "œ": "o", "Œ": "o"}
_GONE = (0xAD, 0x34F, 0x61C, 0x180E, 0xFEFF, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0xFE00, 0xFE10))
#: Where letters, digits and marks are that mean Latin ones; all else is a space.
_BLOCKS = (0, 0x3400), (0xA600, 0xAC00), (0xFB00, 0x10000), (0x1D400, 0x1D800), (0x1F100, 0x1F200)
_SPACE = 0x20


@lru_cache(1)
def _table() -> np.ndarray:
    """What each code point becomes: a letter, a digit, a space, or nothing (0)."""
    out = np.full(0x110000, _SPACE, np.uint8)
    alike = {x: to for to, from_ in _LOOKALIKES.items() for c in from_ for x in (c, c.upper(), c.lower()) if len(x) == 1} | _DIGITS | _LETTERS
    for k in (k for a, b in _BLOCKS for k in range(a, b)):
        c = chr(k)
        if unicodedata.combining(c) or unicodedata.category(c) == "Mn":
            out[k] = 0
            continue
        if c not in alike and k > 0x7F:
            c = unicodedata.normalize("NFKD", c)[0]
        c = alike.get(c, c).lower()
        if "a" <= c <= "z" or "0" <= c <= "9":
            out[k] = ord(alike.get(c, c))
    out[out == ord("l")] = ord("i")
    out[list(_GONE)] = 0
    out[0xE0100:0xE01F0] = 0
    return out


def _fold(texts: list[str]) -> tuple[str, np.ndarray]:
    """All texts folded, each between spaces of its own, and the places of these spaces (one more than texts)."""
    joined = "\n" + "\n".join(texts) + "\n"
    own = _table()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    edge = np.zeros(len(own), bool)
    edge[np.cumsum([0, *(len(t) + 1 for t in texts)])] = True
    some = np.flatnonzero(own)
    own, edge = own[some], edge[some]
    space = own == _SPACE
    keep = edge | ~space
    keep[1:] |= ~space[:-1]
    own, edge = own[keep], edge[keep]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    run = np.diff(np.append(first, len(own)))
    long = (run > 2) & (own[first] > 0x60)
    keep = np.ones(len(own), bool)
    if long.any():
        keep[:] = ~np.repeat(long, run)
        keep[first] = True
    own, edge = own[keep], edge[keep]
    return own.tobytes().decode("ascii"), np.flatnonzero(edge)


def fold(text: str) -> str:
    """The folded text, without spaces at its ends."""
    return _fold([text])[0].strip()


def _variants(term: str) -> set[str]:
    """A folded term, with doubled letters single, and with its letters spaced out if it is a word of four or more."""
    single = "".join(c for k, c in enumerate(term) if not k or c != term[k - 1])
    return {term, single} | {" ".join(x) for x in (term, single) if len(x) > 3 and " " not in x}


class Matcher:
    """All terms, beginnings and exception phrases in one automaton. Beginnings are of folded words with the space that ends these."""

    def __init__(self, lexicon: Mapping, exceptions: tuple[str, ...] = (), beginnings: Mapping | None = None):
        known: dict[str, list] = {}
        terms = [(lang, f"{x} ", w) for (lang, term), w in lexicon.items() for x in _variants(fold(term)) if x]
        for lang, x, weight in terms + [(lang, p, w) for (lang, p), w in (beginnings or {}).items()]:
            by = known.setdefault(f" {x}", [{}, False])[0]
            by[lang] = max(float(weight), by.get(lang, 0.0))
        for phrase in exceptions:
            known.setdefault(f" {fold(phrase)} ", [{}, False])[1] = True
        self.automaton = ahocorasick.Automaton()
        for key, (by, harmless) in known.items():
            self.automaton.add_word(key, (len(key), by, harmless))
        self.empty = not known
        if known:
            self.automaton.make_automaton()

    def found(self, folded: str, edges: np.ndarray, langs: list[str]) -> dict[int, list[float]]:
        """Weights of the terms that count, by text."""
        if self.empty:
            return {}
        ends = edges.tolist()
        spans: dict[int, dict[int, tuple[float, int]]] = defaultdict(dict)
        safe: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for last, (size, by, harmless) in self.automaton.iter(folded):
            begin = last - size + 2
            text = bisect_right(ends, begin) - 1
            if harmless:
                safe[text].append((begin, last))
            weight = max(by.get("", 0.0), by.get(langs[text], 0.0))
            if weight:
                spans[text][begin] = max(spans[text].get(begin, (0.0, 0)), (weight, folded.find(" ", last)))
        out = {}
        for text, own in spans.items():
            covers = safe.get(text, ())
            if left := [w for begin, (w, end) in own.items() if not any(a <= begin and end <= b for a, b in covers)]:
                out[text] = left
        return out


@lru_cache(8)
def _matcher(lexicon: tuple, exceptions: tuple[str, ...], beginnings: tuple) -> Matcher:
    return Matcher(dict(lexicon), exceptions, dict(beginnings))


def toxicity(text: Column, lang: Column | None = None, lexicon: Mapping | None = None, exceptions: tuple[str, ...] | None = None, beginnings: Mapping | None = None, floor: int = FLOOR_CHARS) -> Column:
    """``struct<score, hits>`` of a text column. ``beginnings`` are what ``learned`` returns."""
    key = tuple((LEXICON if lexicon is None else lexicon).items()), tuple(EXCEPTIONS if exceptions is None else exceptions), tuple((beginnings or {}).items())

    @F.arrow_udf("struct<score:double,hits:int>")
    def scored(column: pa.Array, langs: pa.Array) -> pa.Array:
        matcher = _matcher(*key)
        score, hits = np.zeros(len(column)), np.zeros(len(column), np.int32)
        languages = langs.to_pylist()
        for a, group in text_slices(column):
            for k, weights in matcher.found(*_fold(group), languages[a : a + len(group)]).items():
                score[a + k], hits[a + k] = 1000.0 * math.fsum(weights) / max(len(group[k]), floor), len(weights)
        return pa.StructArray.from_arrays([pa.array(score), pa.array(hits)], ["score", "hits"])

    return scored(text, F.lit("") if lang is None else lang)


# ---------------------------------------------------------------- what labels teach


def _folded(column: pa.Array) -> pa.Array:
    out: list[pa.Array] = [pa.array([], pa.string())]
    for _, group in text_slices(column):
        folded, at = _fold(group)
        out.append(pa.array([folded[x + 1 : y].strip() for x, y in zip(at[:-1].tolist(), at[1:].tolist())], pa.string()))
    return pa.concat_arrays(out)


def _language(docs: DataFrame) -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")


def word_counts(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """``lang, word, t, c``: in how many toxic and clean labelled documents a folded word occurs. Documents of a language and
    label with the same longest word count once: near copies would count their words many times."""
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    marks = settle(marks, "marks")
    n = marks.count()
    if n > rows:
        marks = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < (1 << 30) * rows // n)
    known = docs.select("doc_id", _language(docs).alias("lang"), "text").join(F.broadcast(marks), "doc_id")
    known = known.select("doc_id", "lang", "toxic", F.arrow_udf(_folded, "string")("text").alias("folded")).filter("folded <> ''")
    longest = F.array_min(F.transform(F.split("folded", " "), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))["w"]
    parts = min(docs.sparkSession.sparkContext.defaultParallelism, 64)  # the sample's size is bounded: else it would be one task's
    own = known.withColumn("family", longest).repartition(parts, "lang", "toxic", "family").groupBy("lang", "toxic", "family").agg(F.min(F.struct("doc_id", "folded")).alias("x"))
    words = own.select("lang", "toxic", F.explode(F.array_distinct(F.split("x.folded", " "))).alias("word"))
    return words.repartition(parts, "lang", "word").groupBy("lang", "word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))


def learned(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> dict[tuple[str, str], float]:
    """(language, beginning of folded words) -> weight; one that ends in a space is a whole word. The counts are made by the cluster; the driver sees the beginnings that
    gain likelihood, whose number LABELLED_ROWS bounds."""
    counts = settle(word_counts(docs, labels, rows), "toxic-words")
    totals = counts.groupBy("lang").agg(F.sum("t").alias("nt"), F.sum("c").alias("nc")).filter("nt > 0 and nc > 0")
    sizes = F.sequence(F.lit(SHORTEST), F.least(F.lit(LONGEST), F.length("word") + 1))
    begun = counts.filter(F.length("word") >= SHORTEST - 1).select("lang", F.explode(F.transform(sizes, lambda k: F.substring(F.concat("word", F.lit(" ")), F.lit(1), k))).alias("p"), "t", "c")
    sums = begun.groupBy("lang", "p").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).filter(F.col("t") >= LEAST_DOCS).join(F.broadcast(totals), "lang")
    rates = sums.select("lang", "p", "t", "nt", (F.col("t") / F.col("nt")).alias("rt"), ((F.col("c") + 1) / F.col("nc")).alias("rc")).filter("rt > rc")
    log = F.log(F.col("rt") / F.col("rc"))
    gains = rates.select("lang", "p", log.alias("log"), F.round(F.col("t") * log - F.col("nt") * (F.col("rt") - F.col("rc")) - GAIN, 6).alias("gain")).filter("gain > 0")
    found = gains.toArrow().to_pydict()
    of = {(lang, p): (g, w) for lang, p, g, w in zip(found["lang"], found["p"], found["gain"], found["log"])}
    return {key: of[key][1] / NATS for key in _chosen({k: g for k, (g, _) in of.items()})}


def _chosen(gains: dict[tuple[str, str], float]) -> list[tuple[str, str]]:
    """The beginnings, none of another, whose gains have the greatest sum; of equal ones the longest."""
    below: dict[tuple[str, str], float] = defaultdict(float)
    own = set()
    by_size = defaultdict(set)
    for lang, p in gains:
        by_size[len(p)].add((lang, p))
    for size in range(LONGEST, SHORTEST - 1, -1):
        for lang, p in sorted(by_size[size]):
            gain, rest = gains.get((lang, p), 0.0), below[lang, p]
            if gain > rest + 1e-6:
                own.add((lang, p))
            below[lang, p[:-1]] += max(gain, rest)
            by_size[size - 1].add((lang, p[:-1]))
    return [(lang, p) for lang, p in sorted(own) if not any((lang, p[:k]) in own for k in range(SHORTEST, len(p)))]


# ---------------------------------------------------------------- documents


def _rated(docs: DataFrame, labels: DataFrame | None, rows: int, lexicon: Mapping | None, exceptions: tuple[str, ...] | None) -> Column:
    return toxicity(F.col("text"), _language(docs), lexicon, exceptions, None if labels is None else learned(docs, labels, rows))


def toxic_documents(docs: DataFrame, labels: DataFrame | None = None, threshold: float = THRESHOLD, rows: int = LABELLED_ROWS, lexicon: Mapping | None = None, exceptions: tuple[str, ...] | None = None) -> DataFrame:
    """``doc_id, score, hits`` of each document that is toxic; score to six decimals. ``labels`` (doc_id, toxic) add to the lexicon."""
    scored = docs.select("doc_id", _rated(docs, labels, rows, lexicon, exceptions).alias("t"))
    return scored.filter(F.col("t.score") >= threshold).select("doc_id", F.round("t.score", 6).alias("score"), F.col("t.hits").cast("long").alias("hits"))


def drop_toxic(docs: DataFrame, labels: DataFrame | None = None, threshold: float = THRESHOLD, rows: int = LABELLED_ROWS, lexicon: Mapping | None = None, exceptions: tuple[str, ...] | None = None) -> DataFrame:
    """The documents that are not toxic, with their columns."""
    return docs.filter(_rated(docs, labels, rows, lexicon, exceptions)["score"] < threshold)
