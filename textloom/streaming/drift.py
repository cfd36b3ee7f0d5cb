"""An extension: term frequencies of arriving documents by time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import term_of, token_array


def term_drift(stream: DataFrame, text: str = "text", time: str = "ts", window: str = "1 day", late: str = "1 day") -> DataFrame:
    """``window_start, term, tf`` of a batch or stream of texts; in a stream, windows close once the watermark passes them."""
    rows = stream.withWatermark(time, late) if stream.isStreaming else stream
    terms = rows.select(time, F.explode(token_array(F.col(text))).alias("token")).select(time, term_of(F.col("token")).alias("term")).filter("term <> ''")
    counts = terms.groupBy(F.window(time, window), "term").agg(F.count("*").alias("tf"))
    return counts.select(F.col("window.start").alias("window_start"), "term", "tf")
