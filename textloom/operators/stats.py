"""Statistics of a query, as a whole and by groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.corpus import Corpus
from .search import scored, sort_order


def _hits(corpus: Corpus, query: str, level: str | None, max_docs: int = -1, **how) -> DataFrame:
    """Matching rows with all fields; with ``max_docs`` the first so many by key."""
    level = level or corpus.default_level
    keys = corpus.keys(level)
    hits = scored(corpus, query, level, **how)
    if max_docs != -1:
        hits = hits.orderBy(*keys).limit(max_docs)
    return corpus.rows(level).join(hits, keys).withColumn("score", F.floor("score").cast("long"))


def _sums(fields: list[str]) -> list[Column]:
    return [F.sum(F.coalesce(F.col(f).cast("long"), F.lit(0))).alias(f"sum_{f}") for f in fields]


def _aggregates(sum_fields: list[str], term_freqs: bool) -> list[Column]:
    out = [F.count("*").alias("doc_freq"), F.coalesce(F.sum("score"), F.lit(0)).alias("total_term_freq"), *_sums(sum_fields)]
    return out + ([F.sort_array(F.collect_list("score")).alias("term_freqs")] if term_freqs else [])


def query_stats(corpus: Corpus, query: str, level: str | None = None, sum_fields: list[str] | None = None, term_freqs: bool = False, **how) -> DataFrame:
    """One row: documents, occurrences, sums of fields, and on demand all documents' frequencies in order."""
    return _hits(corpus, query, level, **how).agg(*_aggregates(sum_fields or [], term_freqs))


def prefix(name: str, length: int) -> Column:
    """A field's first characters as a group; -1 is the whole value; a missing one is empty."""
    return F.col(name) if length == -1 else F.substring(F.coalesce(F.col(name).cast("string"), F.lit("")), 1, length)


Grouper = Callable[[DataFrame], dict[str, Column]]


def grouped_stats(corpus: Corpus, query: str, fields: list[str] | None = None, lengths: list[int] | None = None, level: str | None = None, transform: Callable[[list[Column]], list[Column]] | None = None, grouper: Grouper | None = None, sum_fields: list[str] | None = None, term_freqs: bool = False, sort: list[tuple[str, str, bool]] | None = None, max_docs: int = -1, limit: int = -1, **how) -> DataFrame:
    """``query_stats`` for each group: by a grouper's columns, by transformed fields, by prefixes or by fields; null is a group.
    In the order of ``sort``, then of documents."""
    hits = _hits(corpus, query, level, max_docs, **how)
    fields = fields or []
    if grouper:
        groups = grouper(hits)
    elif transform:
        groups = dict(zip(fields, transform([F.col(f) for f in fields])))
    else:
        groups = {f: prefix(f, n) for f, n in zip(fields, lengths or [-1] * len(fields))}
    aggs = _aggregates(sum_fields or [], term_freqs)
    keyed = hits.select(*[c.alias(f"group_{k}") for k, c in groups.items()], "score", *{f: None for f in sum_fields or []})
    out = keyed.groupBy(*[f"group_{k}" for k in groups]).agg(*aggs)
    for k in groups:
        out = out.withColumnRenamed(f"group_{k}", k)
    order = [*sort_order(sort or [], dict(out.dtypes)), F.desc("doc_freq"), *groups]
    out = out.orderBy(*order)
    return out if limit == -1 else out.limit(limit)


def with_total(corpus: Corpus, query: str, fields: list[str], level: str | None = None, sum_fields: list[str] | None = None, term_freqs: bool = False, max_docs: int = -1, limit: int = -1, **how) -> DataFrame:
    """The groups of ``grouped_stats`` and, with null keys and ``is_total``, the statistics of all hits, whatever ``limit`` leaves."""
    groups = grouped_stats(corpus, query, fields, None, level, sum_fields=sum_fields, term_freqs=term_freqs, max_docs=max_docs, limit=limit, **how)
    total = _hits(corpus, query, level, max_docs, **how).agg(*_aggregates(sum_fields or [], term_freqs))
    kinds = dict(groups.dtypes)
    nulls = [F.lit(None).cast(kinds[k]).alias(k) for k in fields]
    return groups.withColumn("is_total", F.lit(False)).unionByName(total.select(*nulls, *[c for c in groups.columns if c not in fields], F.lit(True).alias("is_total")))


def match_stats(corpus: Corpus, word: str, level: str, by_term: bool = False, transform: Callable[[Column], Column] | None = None, length: int = -1) -> DataFrame:
    """Groups by the text of the matching passage (a row of a fine level that holds the word; nothing is marked in it), or by that
    and the matched term; documents count passages here."""
    keys = corpus.keys(level)
    hits = scored(corpus, word, level)
    rows = corpus.rows(level).join(hits, keys)
    match = transform(F.col(corpus.content)) if transform else F.col(corpus.content) if length == -1 else F.substring(F.col(corpus.content), 1, length)
    groups = [match.alias("match")] + ([F.lit(word).alias("term")] if by_term else [])
    return rows.select(*groups, "score").groupBy("match", *(["term"] if by_term else [])).agg(F.count("*").alias("doc_freq"), F.sum("score").cast("long").alias("total_term_freq"))
