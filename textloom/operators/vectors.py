"""Collocation vectors: what terms matching documents hold, scaled; their differences, and vectors of higher order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distance as dist
from ..functions.scaling import aggregate, local
from ..plans import query as q
from ..sources.corpus import Corpus
from ..sources.store import small, written
from .search import compiled
from .squares import squared_lengths
from .stats import prefix


#: First vectors of so many terms at most are sent to all executors.
_BROADCAST_TERMS = 10_000


@dataclass(frozen=True)
class Local:
    """What terms of a document count, and how."""

    scaling: str = "ABSOLUTE"
    min_freq_in_doc: int = 1
    max_freq_in_doc: int | None = None
    min_doc_freq: int = 1
    max_doc_freq: int | None = None
    min_total_term_freq: int = 1
    max_total_term_freq: int | None = None
    min_term_length: int = 1
    max_term_length: int | None = None
    term_filter: Callable[[Column, Column], Column] | None = None
    term_transformer: Callable[[Column], Column] | None = None

    def condition(self) -> tuple[Column | None, bool]:
        """The filter, without the parts that let all pass, and whether it needs the dictionary."""
        parts: list[Column] = []
        stats = False
        for name, low, high in (("tf", self.min_freq_in_doc, self.max_freq_in_doc), ("doc_freq", self.min_doc_freq, self.max_doc_freq), ("total_term_freq", self.min_total_term_freq, self.max_total_term_freq), ("length(term)", self.min_term_length, self.max_term_length)):
            c = F.expr(name)
            if low > 1:
                parts.append(c >= low)
            if high is not None:
                parts.append(c <= high)
            stats |= name in ("doc_freq", "total_term_freq") and (low > 1 or high is not None)
        if self.term_filter:
            parts.append(self.term_filter(F.col("term"), F.col("tf")))
        out = None
        for p in parts:
            out = p if out is None else out & p
        return out, stats


@dataclass(frozen=True)
class Aggregate:
    """How sums over documents are scaled and which stay."""

    scaling: str = "ABSOLUTE"
    smoothing: float = 0.0
    min_sum_freq: int = 1
    max_sum_freq: int | None = None


def sampled(hits: DataFrame, max_docs: int, seed: int = 7) -> DataFrame:
    """Each hit with probability max_docs / hits; -1 keeps all. What a document draws is the head of SHA-256 of its key and the seed."""
    if max_docs == -1:
        return hits
    n = hits.agg(F.count("*").alias("n_hits"))
    head = F.substring(F.sha2(F.concat_ws("\x1f", F.lit(str(seed)), *[F.col(c).cast("string") for c in hits.columns]), 256), 1, 13)
    u = F.conv(head, 16, 10).cast("long") / float(1 << 52)
    return hits.crossJoin(F.broadcast(n)).filter(u < F.lit(float(max_docs)) / F.col("n_hits")).drop("n_hits")


def budget(max_docs: int, parts: int) -> int:
    """What each of several vectors may sample of a budget of documents; -1 is no limit, and none at all is an error."""
    if max_docs == -1:
        return -1
    if (out := max_docs // max(parts, 1)) < 1:
        raise ValueError(f"{max_docs} documents are no sample for {parts} vectors")
    return out


def sampled_by(rows: DataFrame, by: str, most: int, seed: int = 7) -> DataFrame:
    """Each row with probability most / rows of its ``by``; -1 keeps all."""
    if most == -1:
        return rows
    u = F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in rows.columns]), F.lit(1_000_003)) / 1_000_003.0
    sizes = rows.groupBy(by).agg(F.count("*").alias("n_rows"))
    return rows.join(sizes, by).filter(u < F.lit(float(most)) / F.col("n_rows")).select(*rows.columns)


def document_vectors(corpus: Corpus, docs: DataFrame, level: str | None = None, local_how: Local = Local(), how: Aggregate = Aggregate()) -> DataFrame:
    """``keys, term, freq, weight``: the vector of each of the documents whose keys ``docs`` has."""
    level = level or corpus.default_level
    keys = corpus.keys(level)
    rows = context_rows(corpus, docs, level, local_how).select(*keys, "term", F.col("f").alias("freq"))
    return _scale(corpus, level, rows, docs.agg(F.lit(1).alias("query_docs")), how)


def context_rows(corpus: Corpus, hits: DataFrame, level: str, how: Local, query_terms: list[str] | None = None) -> DataFrame:
    """``keys, term, tf, f``: accepted terms of the hits' documents with their locally scaled frequency."""
    keys = corpus.keys(level)
    rows = corpus.doc_terms(level).join(small(hits.select(*keys), "hits"), keys, "left_semi")
    query_tf = None
    if how.scaling == "MIN" and query_terms:
        own = corpus.doc_terms(level).filter(F.col("term").isin(query_terms)).groupBy(*keys).agg(F.sum("tf").alias("query_tf"))
        rows, query_tf = rows.join(own, keys, "left"), F.coalesce("query_tf", F.lit(0))
    if how.term_transformer:
        rows = rows.withColumn("term", how.term_transformer(F.col("term")))
    condition, stats = how.condition()
    if stats:
        rows = rows.join(corpus.term_stats(level), "term")
    if condition is not None:
        rows = rows.filter(condition)
    return rows.withColumn("f", local(how.scaling, F.col("tf"), query_tf))


def _query_terms(corpus: Corpus, query: str) -> list[str]:
    return [x.node.text for x in compiled(corpus, query).leaves if isinstance(x.node, q.Term) and x.scores and x.node.field in (None, corpus.content)]


def _scale(corpus: Corpus, level: str, sums: DataFrame, query_docs: DataFrame, how: Aggregate) -> DataFrame:
    """``sums`` (..., term, freq) with ``weight``. ``query_docs`` is one row, or a row for each group."""
    sums = sums.filter(F.col("freq") >= how.min_sum_freq) if how.min_sum_freq > 1 else sums
    if how.max_sum_freq is not None:
        sums = sums.filter(F.col("freq") <= how.max_sum_freq)
    if how.scaling == "ABSOLUTE":
        return sums.withColumn("weight", F.col("freq").cast("double"))
    out = sums.join(corpus.term_stats(level), "term")
    if how.scaling in ("PMI", "PPMI"):
        size = corpus.rows(level).agg(F.count("*").alias("n_docs"))
        out = out.crossJoin(F.broadcast(query_docs)).crossJoin(F.broadcast(size))
        n, docs = F.col("n_docs"), F.col("query_docs")
    else:
        n = docs = F.lit(1)
    weight = aggregate(how.scaling, F.col("freq"), F.col("doc_freq"), F.col("total_term_freq"), docs, n, how.smoothing)
    return out.withColumn("weight", weight).select(*sums.columns, "weight")


def term_vector(corpus: Corpus, query: str, level: str | None = None, local_how: Local = Local(), how: Aggregate = Aggregate(), max_docs: int = -1, literal_hit_count: bool = False) -> DataFrame:
    """``term, freq, weight``: the collocation vector of a query."""
    level = level or corpus.default_level
    hits = compiled(corpus, query, level).hits.select(*corpus.keys(level))
    some = sampled(hits, max_docs)
    terms = _query_terms(corpus, query) if local_how.scaling == "MIN" else None
    sums = context_rows(corpus, some, level, local_how, terms).groupBy("term").agg(F.sum("f").alias("freq"))
    if literal_hit_count:
        from .search import hit_count

        docs = hit_count(corpus, query, level, literal=True).withColumnRenamed("hits", "query_docs")
    else:
        docs = hits.agg(F.count("*").alias("query_docs"))
    return _scale(corpus, level, sums, docs, how)


def vector_metadata(corpus: Corpus, query: str, level: str | None = None, local_how: Local = Local(), max_docs: int = -1) -> DataFrame:
    """One row: total_docs, processed_docs, sample_percentage, contributing_docs, processed_terms, accepted_terms, total_accepted_term_freq."""
    level = level or corpus.default_level
    keys = corpus.keys(level)
    hits = compiled(corpus, query, level).hits.select(*keys)
    some = sampled(hits, max_docs)
    accepted = context_rows(corpus, some, level, local_how)
    n = accepted.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("f").alias("f")).agg(F.count("*").alias("contributing_docs"), F.sum("n").alias("accepted_terms"), F.sum("f").alias("total_accepted_term_freq"))
    all_terms = corpus.doc_terms(level).join(small(some, "hits"), keys, "left_semi").agg(F.count("*").alias("processed_terms"))
    counts = hits.agg(F.count("*").alias("total_docs")).crossJoin(some.agg(F.count("*").alias("processed_docs")))
    return counts.withColumn("sample_percentage", F.col("processed_docs") / F.col("total_docs")).crossJoin(n).crossJoin(all_terms)


def grouped_vectors(corpus: Corpus, query: str, fields: list[str], lengths: list[int] | None = None, level: str | None = None, local_how: Local = Local(), how: Aggregate = Aggregate(), limit: int = -1, max_docs: int = -1) -> DataFrame:
    """``fields, term, freq, weight, group_doc_freq, group_term_freq``: a vector for each group, its ``limit`` heaviest terms;
    documents with an accepted term, and the sum of frequencies."""
    level = level or corpus.default_level
    keys = corpus.keys(level)
    hits = compiled(corpus, query, level).hits.select(*keys)
    groups = [prefix(f, n).alias(f) for f, n in zip(fields, lengths or [-1] * len(fields))]
    grouped = corpus.rows(level).join(small(sampled(hits, max_docs), "hits"), keys, "left_semi").select(*keys, *[g.alias(f"g{k}") for k, g in enumerate(groups)])
    grouped = small(grouped, "groups")
    names = [f"g{k}" for k in range(len(fields))]
    rows = context_rows(corpus, grouped, level, local_how).join(grouped, keys)
    sums = rows.groupBy(*names, "term").agg(F.sum("f").alias("freq"))
    weighted = _scale(corpus, level, sums, hits.agg(F.count("*").alias("query_docs")), how)
    docs = rows.groupBy(*names, *[k for k in keys]).agg(F.sum("f").alias("f")).groupBy(*names).agg(F.count("*").alias("group_doc_freq"), F.sum("f").alias("group_term_freq"))
    if limit != -1:
        order = Window.partitionBy(*names).orderBy(F.desc("weight"), "term")
        weighted = weighted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).drop("rank")
    same = None
    docs = docs.select(*[F.col(n).alias(f"d_{n}") for n in names], "group_doc_freq", "group_term_freq")
    for n in names:
        c = F.col(n).eqNullSafe(F.col(f"d_{n}"))
        same = c if same is None else same & c
    out = weighted.join(docs, same)
    return out.select(*[F.col(f"g{k}").alias(f) for k, f in enumerate(fields)], "term", "freq", "weight", "group_doc_freq", "group_term_freq")


def top_terms(vector: DataFrame, limit: int = 20) -> DataFrame:
    """The heaviest terms, ties by term."""
    out = vector.orderBy(F.desc("weight"), "term")
    return out if limit == -1 else out.limit(limit)


def context_terms(corpus: Corpus, query: str, level: str | None = None, local_how: Local = Local()) -> DataFrame:
    """``term``: the accepted terms of matching documents."""
    level = level or corpus.default_level
    hits = compiled(corpus, query, level).hits
    return context_rows(corpus, hits, level, local_how).select("term").distinct()


def nested_vectors(corpus: Corpus, terms: DataFrame, level: str | None = None, local_how: Local = Local(), limit_query: str | None = None, max_docs: int = -1) -> DataFrame:
    """``base, term, weight``: the vector of the documents that hold each of ``terms`` (and match the limiting query), all in
    one self-join on documents instead of a query for each term. ``max_docs`` is shared by the terms and one more vector, the
    first, as ``budget`` has it."""
    level = level or corpus.default_level
    keys = corpus.keys(level)
    rows = corpus.doc_terms(level)
    if limit_query:
        rows = rows.join(compiled(corpus, limit_query, level).hits.select(*keys), keys, "left_semi")
    base = rows.join(terms.select("term"), "term", "left_semi").select(*keys, F.col("term").alias("base"))
    if max_docs != -1:
        base = sampled_by(base, "base", budget(max_docs, terms.select("term").distinct().count() + 1))
    near = context_rows(corpus, base.select(*keys).distinct(), level, local_how)
    return base.join(near.select(*keys, "term", "f"), keys).groupBy("base", "term").agg(F.sum("f").cast("double").alias("weight"))


def vector_diff(left: DataFrame, right: DataFrame, keys: list[str], metric: str = "COSINE", normalization: str = "NONE", filtering: str = "EITHER") -> DataFrame:
    """Grouped vectors of two queries: ``keys, distance, df1, df2, tf1, tf2`` for the union of groups; the distance is null where
    a side lacks the group."""
    left, right = written(left, "left"), written(right, "right")
    each = []
    for side, v in (("1", left), ("2", right)):
        each.append(v.groupBy(*keys).agg(F.max("group_doc_freq").alias(f"df{side}"), F.max("group_term_freq").alias(f"tf{side}")).select(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")).alias(k) for k in keys], f"df{side}", f"tf{side}"))
    known = lambda v: v.select(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")).alias(k) for k in keys], "term", "weight")
    d = dist.distances(known(left), known(right), (metric,), filtering, normalization, tuple(keys)).withColumnRenamed(metric.lower(), "distance")
    out = each[0].join(each[1], keys, "full_outer").join(d, keys, "left")
    both = F.col("df1").isNotNull() & F.col("df2").isNotNull()
    out = out.withColumn("distance", F.when(both, F.col("distance")))
    return out.select(*[F.nullif(k, F.lit("\0")).alias(k) for k in keys], "distance", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("df1", "df2", "tf1", "tf2")])


def diff_lists(left: DataFrame, right: DataFrame, keys: list[str], n: int) -> DataFrame:
    """``keys, list, rank, term, difference``: of each group that both sides have the most different terms, the most
    distinctive ones of either side, and the most similar ones, by normalised weights over the union of terms."""
    kinds, own = dict(left.dtypes), [f"k{i}" for i in range(2 * len(keys))]
    # a null key is a group: it is a flag and an empty value while sides are joined
    flagged = [c.alias(n) for n, c in zip(own, [x for k in keys for x in (F.col(k).isNull(), F.coalesce(F.col(k).cast("string"), F.lit("")))])]
    l, r = (dist.normalize(v.select(*flagged, "term", "weight"), own) for v in (left, right))
    both = l.select(*own).distinct().join(r.select(*own).distinct(), own)
    rows = dist.joined(l, r, own, own).join(both, own, "left_semi").withColumn("difference", F.round(F.col("x") - F.col("y"), 9))
    rows = rows.select(*[F.when(~F.col(own[2 * i]), F.col(own[2 * i + 1])).cast(kinds[k]).alias(k) for i, k in enumerate(keys)], "term", "difference")
    out = None
    for name, order in (("different", F.desc(F.abs("difference"))), ("first", F.desc("difference")), ("second", F.asc("difference")), ("similar", F.asc(F.abs("difference")))):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order, "term"))
        part = rows.withColumn("rank", rank).filter(F.col("rank") <= n).select(*keys, F.lit(name).alias("list"), "rank", "term", "difference")
        out = part if out is None else out.unionByName(part)
    return out


def similar_collocations(corpus: Corpus, query: str, level: str | None = None, local_how: Local = Local(), how: Aggregate = Aggregate(), first_limit: int = 20, limit: int = 20, limit_query: str | None = None, second_terms: Callable[[DataFrame], DataFrame] | None = None, third_how: Local | None = None, max_docs: int = -1, third_docs: int = -1) -> DataFrame:
    """``metric, rank, term, distance``: terms whose own collocation vectors are nearest to the query's, for each metric.

    The query's heaviest collocates lead to the terms of the documents that hold any of them. Of those terms' vectors only what
    distances need is made: sums over documents, sums over the first's terms, and squared lengths, those by ``squares``. A term
    with an empty vector is at distance 1. ``third_how`` says what counts in those vectors (as in the others, if not given);
    ``max_docs`` draws so many documents, about, for the first vector; ``third_docs`` are shared equally by the third ones."""
    level = level or corpus.default_level
    keys = corpus.keys(level)
    third_how = third_how or local_how
    first = top_terms(term_vector(corpus, query, level, local_how, how, max_docs), first_limit)
    holders = corpus.doc_terms(level).join(F.broadcast(first.select("term")) if 0 <= first_limit <= _BROADCAST_TERMS else first.select("term"), "term", "left_semi").select(*keys).distinct()
    second = context_rows(corpus, holders, level, local_how).select("term").distinct()
    if second_terms:
        second = second_terms(second)
    ids = corpus.term_ids(level)
    second = written(second.join(ids, "term"), "second")
    rows = corpus.doc_terms(level)
    if limit_query:
        rows = rows.join(compiled(corpus, limit_query, level).hits.select(*keys), keys, "left_semi")
    base = rows.join(second, "term").select(*keys, "term_id")
    if third_docs != -1:
        base = sampled_by(base, "term_id", budget(third_docs, second.count()))
    base = base.groupBy(*keys).agg(F.collect_list("term_id").alias("bases"))
    near = context_rows(corpus, rows.select(*keys).distinct(), level, third_how).join(ids, "term")
    own = first.join(ids, "term").select("term_id", F.col("weight").alias("y"))
    own = written(own, "first")
    few = F.broadcast(own) if 0 <= first_limit <= _BROADCAST_TERMS else own
    f, y = F.col("f").cast("double"), F.col("y")
    vectors = near.join(few, "term_id", "left").groupBy(*keys).agg(
        F.collect_list(F.struct("term_id", f.alias("f"))).alias("v"), F.sum(f).alias("s"), F.sum(f * f).alias("ss"), F.sum(f * F.coalesce(y, F.lit(0.0))).alias("xy"),
        F.collect_list(F.when(y.isNotNull(), F.struct("term_id", f.alias("f")))).alias("met"))
    docs = written(base.join(vectors, keys), "documents")
    held = docs.select(F.explode("bases").alias("base"), "s", "ss", "xy", "met")
    sums = written(held.groupBy("base").agg(F.count("*").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("one"), F.sum("xy").alias("xy")), "sums")
    shared = docs.filter(F.size("met") > 0).select(F.explode("bases").alias("base"), F.explode("met").alias("m")).groupBy("base", "m.term_id").agg(F.sum("m.f").alias("x"))
    x = F.col("x")
    shared = shared.join(few, "term_id").groupBy("base").agg(F.sum(F.least(x, y)).alias("low"), F.sum(F.abs(x - y) - x - y).alias("off"))
    # a base of one document has that one's length; all others' are added up in blocks
    many = docs.select(*keys, F.explode("bases").alias("base")).join(sums.filter("n > 1").select("base"), "base").groupBy(*keys).agg(F.collect_list("base").alias("bases"))
    many = written(many.join(docs.select(*keys, F.col("v.term_id").alias("terms"), F.col("v.f").alias("freqs")), keys), "blocks")
    pairs = many.agg(F.coalesce(F.sum(F.size("bases").cast("long") * F.size("terms")), F.lit(0))).first()[0]
    sums = sums.join(squared_lengths(many, pairs), "base", "left").join(shared, "base", "left")
    sums = sums.select("base", "s", F.coalesce("ss", "one").alias("ss"), "xy", "low", "off")
    total = own.agg(F.sum("y").alias("t"), F.sum(y * y).alias("tt"))
    rows = second.join(sums, second["term_id"] == sums["base"], "left").fillna(0.0, ["s", "ss", "xy", "low", "off"]).crossJoin(F.broadcast(total))
    empty = F.col("s") == 0
    all_weight = F.col("s") + F.col("t")
    metrics = {
        "cosine": 1 - F.when(F.col("ss") * F.col("tt") > 0, F.col("xy") / (F.sqrt("ss") * F.sqrt("tt"))).otherwise(0.0),
        "dice": 1 - 2 * F.col("low") / all_weight,
        "jaccard": 1 - F.col("low") / (all_weight - F.col("low")),
        "euclidean": F.sqrt(F.greatest(F.lit(0.0), F.col("ss") + F.col("tt") - 2 * F.col("xy"))),
        "manhattan": F.sqrt(F.greatest(F.lit(0.0), all_weight + F.col("off"))),
    }
    tall = rows.select("term", F.explode(F.create_map(*[c for k, d in metrics.items() for c in (F.lit(k), F.round(F.when(empty, 1.0).otherwise(d), 9))])).alias("metric", "distance"))
    rank = F.row_number().over(Window.partitionBy("metric").orderBy("distance", "term"))
    return tall.withColumn("rank", rank).filter(F.col("rank") <= limit).select("metric", "rank", "term", "distance")


def search_distance(corpus: Corpus, query: str, vector: DataFrame, level: str | None = None, metric: str = "COSINE", local_how: Local = Local(), how: Aggregate = Aggregate(), normalization: str = "NONE") -> DataFrame:
    """``keys, distance`` of each matching document's own vector, scaled as ``term_vector`` would, to a given one, over the union
    of their terms."""
    level = level or corpus.default_level
    keys = corpus.keys(level)
    hits = compiled(corpus, query, level).hits.select(*keys)
    docs = context_rows(corpus, hits, level, local_how, _query_terms(corpus, query) if local_how.scaling == "MIN" else None).select(*keys, "term", F.col("f").alias("freq"))
    docs = _scale(corpus, level, docs, hits.agg(F.count("*").alias("query_docs")), how).select(*keys, "term", F.col("weight").alias("x"))
    prepare = {"NONE": lambda v, k: v, "NORMALIZE": dist.normalize, "CENTER": dist.center, "CENTERNORM": lambda v, k: dist.normalize(dist.center(v, k), k)}[normalization]
    if normalization != "NONE":
        docs = prepare(docs.withColumnRenamed("x", "weight"), keys).withColumnRenamed("weight", "x")
        vector = prepare(vector.withColumn("own", F.lit(0)), ["own"])
    sums = docs.groupBy(*keys).agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"), F.sum(F.abs("x")).alias("sa"))
    x, y = F.col("x"), F.col("y")
    own = vector.select("term", F.col("weight").alias("y"))
    meet = docs.join(own, "term").groupBy(*keys).agg(F.sum(x * y).alias("xy"), F.sum(F.least(x, y)).alias("low"), F.sum(F.abs(x - y) - F.abs(x) - F.abs(y)).alias("off"))
    total = own.agg(F.sum("y").alias("t"), F.sum(y * y).alias("tt"), F.sum(F.abs(y)).alias("at"))
    rows = sums.join(meet, keys, "left").fillna(0.0, ["xy", "low", "off"]).crossJoin(F.broadcast(total))
    d = {
        "COSINE": 1 - F.when(F.col("ss") * F.col("tt") > 0, F.col("xy") / (F.sqrt("ss") * F.sqrt("tt"))).otherwise(0.0),
        "DICE": 1 - 2 * F.col("low") / (F.col("s") + F.col("t")),
        "JACCARD": 1 - F.col("low") / (F.col("s") + F.col("t") - F.col("low")),
        "EUCLIDEAN": F.sqrt(F.greatest(F.lit(0.0), F.col("ss") + F.col("tt") - 2 * F.col("xy"))),
        "MANHATTAN": F.sqrt(F.greatest(F.lit(0.0), F.col("sa") + F.col("at") + F.col("off"))),
    }[metric]
    return rows.select(*keys, d.alias("distance"))
