"""Terms and n-grams that resemble a pattern, with their statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import query as q
from ..plans.compile import Compiler
from ..sources.corpus import Corpus
from ..sources.store import small

SORTS = {"TERM": "term", "TDF": "total_doc_freq", "TTF": "total_term_freq"}


def similar_terms(corpus: Corpus, patterns: str, level: str | None = None, sort: str = "TDF", direction: str = "D", limit: int = 20, offset: int = 0, lexicon: DataFrame | None = None) -> DataFrame:
    """``term, total_doc_freq, total_term_freq`` of what each pattern stands for; several patterns are an n-gram of neighbours.
    A pattern is a word, a wildcard, ``fuzzy~n:prefix:transpositions`` or ``/regex/``."""
    out = all_similar_terms(corpus, patterns, level, lexicon)
    order = F.asc(SORTS[sort]) if direction == "A" else F.desc(SORTS[sort])
    out = out.orderBy(order, "term")
    out = out.offset(offset) if offset else out
    return out if limit == -1 else out.limit(limit)


def all_similar_terms(corpus: Corpus, patterns: str, level: str | None = None, lexicon: DataFrame | None = None) -> DataFrame:
    level = level or corpus.default_level
    nodes = [q.Regex(None, p[1:-1]) if len(p) > 1 and p[0] == p[-1] == "/" else q.leaf(None, p) for p in patterns.split()]
    nodes = [q.Wildcard(None, "*") if isinstance(n, q.MatchAll) else n for n in nodes]
    compiler = Compiler(corpus, level, lexicon)
    words = [compiler.expansion(n) for n in nodes]
    if len(words) == 1:
        return corpus.term_stats(level).join(small(words[0], "words"), "term", "left_semi").select("term", F.col("doc_freq").alias("total_doc_freq"), "total_term_freq")
    keys = corpus.keys(level)
    tokens = corpus.tokens(level)
    slots = reduce(DataFrame.unionByName, [w.select("term", F.lit(k).alias("slot")) for k, w in enumerate(words)])
    # every slot's tokens are moved to the place of the n-gram's first word: one aggregation instead of a join for each slot
    placed = tokens.join(small(slots, "words"), "term").select(*keys, (F.col("pos") - F.col("slot")).alias("at"), "slot", "term")
    grams = placed.groupBy(*keys, "at").agg(F.array_sort(F.collect_list(F.struct("slot", "term"))).alias("words")).filter(F.size("words") == len(words))
    grams = grams.select(*keys, F.array_join(F.transform("words", lambda w: w["term"]), " ").alias("term"))
    return grams.groupBy(*keys, "term").count().groupBy("term").agg(F.count("*").alias("total_doc_freq"), F.sum("count").alias("total_term_freq"))


def general(found: DataFrame) -> DataFrame:
    """``terms, total_doc_freq, total_term_freq`` over all that was found."""
    return found.agg(F.count("*").alias("terms"), F.coalesce(F.sum("total_doc_freq"), F.lit(0)).alias("total_doc_freq"), F.coalesce(F.sum("total_term_freq"), F.lit(0)).alias("total_term_freq"))
