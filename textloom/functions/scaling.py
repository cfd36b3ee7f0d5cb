"""Scaling of term frequencies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local(scaling: str, tf: Column, query_tf: Column | None = None) -> Column:
    """Within a document: ABSOLUTE, FLAT (one), MIN (at most the frequency of the query's own terms there)."""
    if scaling == "ABSOLUTE" or (scaling == "MIN" and query_tf is None):
        return tf
    if scaling == "FLAT":
        return F.lit(1).cast("long")
    if scaling == "MIN":
        return F.least(tf, query_tf)
    raise ValueError(f"local scaling {scaling}")


def aggregate(scaling: str, f: Column, df: Column, ttf: Column, query_docs: Column, n_docs: Column, smoothing: float = 0.0) -> Column:
    """Over documents: ABSOLUTE, DF, TTF, PMI, PPMI; ``smoothing`` is added to the divisors."""
    f = f.cast("double")
    if scaling == "ABSOLUTE":
        return f
    if scaling == "DF":
        return f / (df + smoothing)
    if scaling == "TTF":
        return f / (ttf + smoothing)
    pmi = F.log(f * (n_docs / (query_docs + smoothing)) / (df + smoothing))
    if scaling == "PMI":
        return pmi
    if scaling == "PPMI":
        return F.greatest(pmi, F.lit(0.0))
    raise ValueError(f"scaling {scaling}")
