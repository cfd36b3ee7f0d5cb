"""Search: scores, bands, sorts and pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import query as q
from ..plans.compile import Compiled, Compiler
from ..sources.corpus import Corpus

K1, B = 1.2, 0.75


def compiled(corpus: Corpus, query: str, level: str | None = None, **how) -> Compiled:
    return Compiler(corpus, level or corpus.default_level, **how).compile(q.parse(query))


def scored(corpus: Corpus, query: str, level: str | None = None, scoring: str = "TF", min_score: float = 0, max_score: float = -1, explain: bool = False, **how) -> DataFrame:
    """``keys, score`` of every match within the band (and ``explanation``, an array of each leaf's part).

    TF: the sum of the scoring leaves' frequencies, one for a leaf that isn't text. BM25: the usual sum over them. NONE: the
    number of leaves that match. A query that only constrains, or that is empty, scores a row by its number of tokens."""
    level = level or corpus.default_level
    c = compiled(corpus, query, level, **how)
    keys = corpus.keys(level)
    scoring_leaves = [x for x in c.leaves if x.scores]
    if not scoring_leaves:
        hits = c.hits.select(*keys).join(corpus.lengths(level), keys).withColumn("score", F.col("n_tokens").cast("double"))
        parts = F.expr("cast(array() as array<struct<leaf:string,freq:bigint,part:double>>)")
    else:
        hits, pieces = c.hits, {}
        if scoring == "BM25":
            dfs = _leaf_counts(corpus, level, c)
            size = corpus.lengths(level).agg(F.count_if(F.col("n_tokens") > 0).alias("n_docs"), (F.sum("n_tokens") / F.count_if(F.col("n_tokens") > 0)).alias("mean_length"))
            hits = hits.join(corpus.lengths(level), keys).crossJoin(F.broadcast(dfs.crossJoin(size)))  # one row
        for x in scoring_leaves:
            f = F.col(f"f{x.number}")
            if scoring == "TF":
                part = f.cast("double")
            elif scoring == "NONE":
                part = F.when(f.isNotNull(), 1.0)
            elif scoring == "BM25":
                idf = F.log(1 + (F.col("n_docs") - F.col(f"d{x.number}") + 0.5) / (F.col(f"d{x.number}") + 0.5))
                part = idf * f / (f + K1 * (1 - B + B * F.col("n_tokens") / F.col("mean_length")))
            else:
                raise ValueError(f"scoring {scoring}")
            pieces[x.number] = part
        hits = hits.withColumn("score", reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in pieces.values()]))
        parts = F.filter(F.array(*[F.struct(F.lit(describe(x.node)).alias("leaf"), F.col(f"f{x.number}").alias("freq"), pieces[x.number].alias("part")) for x in scoring_leaves]), lambda s: s["part"].isNotNull())
    hits = hits.withColumn("explanation", parts) if explain else hits
    band = F.col("score") >= min_score
    if max_score != -1:
        band &= F.col("score") <= max_score
    return hits.filter(band).select(*keys, "score", *(["explanation"] if explain else []))


def _leaf_counts(corpus: Corpus, level: str, c: Compiled) -> DataFrame:
    """One row: the rows in which each scoring leaf is found, whatever the other clauses say."""
    counts = []
    compiler = Compiler(corpus, level)
    for x in c.leaves:
        if x.scores:
            alone = compiler.compile(x.node)
            counts.append(alone.hits.agg(F.count("*").alias(f"d{x.number}")))
    return reduce(lambda a, b: a.crossJoin(b), counts)


def describe(node: q.Node) -> str:
    """A leaf as text."""
    if isinstance(node, q.Phrase):
        return '"' + " ".join(describe(o[0]) if len(o) == 1 else "(" + " ".join(map(describe, o)) + ")" for o in node.slots) + '"' + (f"~{node.slop}" if node.slop else "")
    text = getattr(node, "text", None) or getattr(node, "pattern", None) or getattr(node, "word", None)
    if isinstance(node, q.Range):
        text = f"{'[' if node.with_low else '{'}{node.low or '*'} TO {node.high or '*'}{']' if node.with_high else '}'}"
    if isinstance(node, q.Sub):
        text = f"<{node.level}§…§{node.target}>"
    name = getattr(node, "field", None)
    return f"{name}:{text}" if name else str(text)


def sort_order(sorts: list[tuple[str, str, bool]], dtypes: dict[str, str]) -> list[Column]:
    """(column, A or D, case-insensitive) as sort columns: null comes last going up and first going down."""
    out = []
    for name, direction, insensitive in sorts:
        c = F.lower(name) if insensitive and dtypes[name] == "string" else F.col(name)
        out.append(c.asc_nulls_last() if direction == "A" else c.desc_nulls_first())
    return out


def page(df: DataFrame, order: list[Column], limit: int = 20, offset: int = 0) -> DataFrame:
    """A page in an order; limit -1 is all."""
    df = df.orderBy(*order)
    df = df.offset(offset) if offset else df
    return df if limit == -1 else df.limit(limit)


def search(corpus: Corpus, query: str, level: str | None = None, fields: list[str] | None = None, sort: list[tuple[str, str, bool]] | None = None, limit: int = 20, offset: int = 0, **how) -> DataFrame:
    """``keys, score, fields``: by score (ties by key) or by ``sort``, whose names are fields or ``score``. Fields are fetched
    for the rows of the page alone unless they sort it."""
    level = level or corpus.default_level
    keys, fields = corpus.keys(level), fields or []
    for f in fields:
        corpus.field(level, f)
    hits = scored(corpus, query, level, **how)
    rows = corpus.rows(level)
    if sort:
        own = [s[0] for s in sort if s[0] not in ("score", *keys)]
        hits = hits.join(rows.select(*keys, *own), keys) if own else hits
        order = [*sort_order(sort, dict(hits.dtypes)), *keys]
    else:
        order = [F.desc("score"), *keys]
    top = page(hits, order, limit, offset)
    late = [f for f in fields if f not in top.columns]
    if late:
        small = F.broadcast(top) if limit != -1 and limit + offset <= 10_000 else top
        top = rows.select(*keys, *late).join(small, keys).orderBy(*order)
    return top.select(*keys, "score", *[f for f in fields if f not in keys], *[c for c in top.columns if c == "explanation"])


def totals(hits: DataFrame) -> DataFrame:
    """``total, total_score`` of all matches within the band."""
    return hits.agg(F.count("*").alias("total"), F.coalesce(F.sum("score"), F.lit(0.0)).alias("total_score"))


def hit_count(corpus: Corpus, query: str, level: str | None = None, literal: bool = False) -> DataFrame:
    """``hits``: matching rows; with ``literal`` a single term counts its occurrences."""
    level = level or corpus.default_level
    node = q.parse(query)
    if literal and isinstance(node, q.Term) and node.field in (None, corpus.content):
        return corpus.term_stats(level).filter(F.col("term") == node.text).agg(F.coalesce(F.sum("total_term_freq"), F.lit(0)).alias("hits"))
    return compiled(corpus, query, level).hits.agg(F.count("*").alias("hits"))
