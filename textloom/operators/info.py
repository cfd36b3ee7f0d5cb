"""What a corpus holds: statistics of fields and terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.corpus import Corpus


def term_info(corpus: Corpus, level: str | None = None) -> DataFrame:
    """``total_docs, total_terms, sum_doc_freq, sum_total_term_freq`` of the content field."""
    level = level or corpus.default_level
    docs = corpus.lengths(level).agg(F.count_if(F.col("n_tokens") > 0).alias("total_docs"))
    return docs.crossJoin(corpus.term_stats(level).agg(F.count("*").alias("total_terms"), F.sum("doc_freq").alias("sum_doc_freq"), F.sum("total_term_freq").alias("sum_total_term_freq")))


def term_listing(corpus: Corpus, level: str | None = None, most: int = 0, sort: str = "TERM", direction: str = "ASC") -> DataFrame:
    """The dictionary in an order, if it has no more than ``most`` terms; otherwise no row."""
    stats = corpus.term_stats(level)
    column = {"TERM": "term", "DOCFREQ": "doc_freq", "TERMFREQ": "total_term_freq"}[sort]
    size = stats.agg((F.count("*") <= most).alias("few"))
    order = F.asc(column) if direction == "ASC" else F.desc(column)
    return stats.crossJoin(F.broadcast(size)).filter("few").drop("few").orderBy(order, "term")


def point_info(rows: DataFrame, fields: list[str]) -> DataFrame:
    """``field, total_docs, total_values, min, max`` of numeric fields (arrays count each value)."""
    kinds = dict(rows.dtypes)
    out = []
    for f in fields:
        c = F.col(f)
        if kinds[f].startswith("array"):
            low, high, n = F.min(F.array_min(c)), F.max(F.array_max(c)), F.sum(F.size(c))
        else:
            low, high, n = F.min(c), F.max(c), F.count(c)
        out.append(F.struct(F.lit(f).alias("field"), F.count(c).alias("total_docs"), n.cast("long").alias("total_values"), low.cast("double").alias("min"), high.cast("double").alias("max")))
    return rows.agg(F.array(*out).alias("x")).select(F.inline("x"))


def quantiles(rows: DataFrame, field: str, points: list[float], exact: bool = False, missing_as_zero: bool = True) -> DataFrame:
    """``p, value`` of a numeric field; a missing value counts as 0."""
    c = F.coalesce(F.col(field).cast("double"), F.lit(0.0)) if missing_as_zero else F.col(field).cast("double")
    ps = F.array(*[F.lit(float(p)) for p in points])
    values = F.percentile(c, ps) if exact else F.percentile_approx(c, ps, 10000)
    return rows.agg(values.alias("v")).select(F.explode(F.arrays_zip(ps.alias("p"), F.col("v").alias("value"))).alias("x")).select("x.p", "x.value")


def quantile_label(p: float, by: str) -> str:
    """A quantile with as many decimals as the step has."""
    return f"{p:.{max(0, len(by) - 2)}f}"


def histogram(rows: DataFrame, field: str, bins: int, missing_as_zero: bool = True) -> DataFrame:
    """``bin, low, high, n, proportion``: equal widths from the least to the greatest value, which is in the last bin."""
    c = F.coalesce(F.col(field).cast("double"), F.lit(0.0)) if missing_as_zero else F.col(field).cast("double")
    values = rows.select(c.alias("v")).filter("v is not null")
    span = values.agg(F.min("v").alias("least"), F.max("v").alias("most"), F.count("*").alias("total"))
    width = (F.col("most") - F.col("least")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("least")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    counted = values.crossJoin(F.broadcast(span)).groupBy(at.alias("bin"), "least", "most", "total").agg(F.count("*").alias("n"))
    full = span.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "least", "most", "total").join(counted.select("bin", "n"), "bin", "left").fillna(0, ["n"])
    return full.select("bin", (F.col("least") + F.col("bin") * width).alias("low"), (F.col("least") + (F.col("bin") + 1) * width).alias("high"), "n", (F.col("n") / F.col("total")).alias("proportion"))


def level_info(corpus: Corpus) -> DataFrame:
    """``level, level_order, n_docs``."""
    parts = None
    for x in corpus.levels.values():
        part = corpus.rows(x.id).agg(F.count("*").alias("n_docs")).select(F.lit(x.id).alias("level"), F.lit(corpus.order[x.id]).alias("level_order"), "n_docs")
        parts = part if parts is None else parts.unionByName(part)
    return parts


def cumulative(stats: DataFrame, column: str) -> DataFrame:
    """``value, n, below``: of a digest built over the dictionary, how many terms have each value, and fewer."""
    counts = stats.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.withColumn("below", F.coalesce(F.sum("n").over(Window.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
