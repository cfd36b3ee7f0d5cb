"""Distances of sparse vectors, held as rows ``keys, term, weight``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JOINS = {"BOTH": "inner", "EITHER": "full_outer", "LEFT": "left_outer", "RIGHT": "right_outer"}
METRICS = ("COSINE", "DICE", "JACCARD", "EUCLIDEAN", "MANHATTAN")


def normalize(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Each vector divided by its length; the null vector as it is."""
    norms = vectors.groupBy(*keys).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return vectors.join(norms, keys).withColumn("weight", F.when(F.col("norm") > 0, F.col("weight") / F.col("norm")).otherwise(F.col("weight"))).drop("norm")


def center(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Each vector less the mean of the weights it has."""
    means = vectors.groupBy(*keys).agg(F.avg("weight").alias("mean"))
    return vectors.join(means, keys).withColumn("weight", F.col("weight") - F.col("mean")).drop("mean")


def normalized(vectors: DataFrame, keys: list[str], mode: str = "NONE") -> DataFrame:
    if mode == "NONE":
        return vectors
    out = normalize(vectors, keys)
    return center(out, keys) if mode == "CENTERNORM" else out


def measures(x: Column, y: Column, metric: str, has_x: Column | None = None, has_y: Column | None = None) -> Column:
    """A metric over joined weights (0 where a vector lacks the term), as an aggregate."""
    if metric == "COSINE":
        norms = F.sqrt(F.sum(x * x)) * F.sqrt(F.sum(y * y))
        return 1 - F.when(norms > 0, F.sum(x * y) / norms).otherwise(0.0)
    if metric == "JACCARD":
        total = F.sum(F.greatest(x, y))
        return 1 - F.when(total != 0, F.sum(F.least(x, y)) / total).otherwise(0.0)
    if metric == "DICE":
        total = F.sum(x + y)
        return 1 - F.when(total != 0, 2 * F.sum(F.least(x, y)) / total).otherwise(0.0)
    if metric == "EUCLIDEAN":
        return F.sqrt(F.sum((x - y) * (x - y)))
    if metric == "MANHATTAN":  # with a square root, as users of it know it; the order is the same
        return F.sqrt(F.sum(F.abs(x - y)))
    raise ValueError(f"metric {metric}")


def joined(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], filtering: str = "EITHER") -> DataFrame:
    """Two tables of one vector each, or of vectors that share ``keys``, joined on terms: ``x`` and ``y``."""
    shared = [k for k in left_keys if k in right_keys]
    out = left.withColumnRenamed("weight", "x").join(right.withColumnRenamed("weight", "y"), [*shared, "term"], JOINS[filtering])
    return out.fillna(0.0, ["x", "y"])


def distances(left: DataFrame, right: DataFrame, metrics: tuple[str, ...] = METRICS, filtering: str = "EITHER", normalization: str = "NONE", keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys`` and a column for each metric: two vectors, or pairs of vectors with equal keys. Dice and Jaccard are always
    over the union of the terms."""
    k = list(keys)
    left, right = normalized(left, k, normalization), normalized(right, k, normalization)
    over = joined(left, right, k, k, filtering)
    x, y = F.col("x"), F.col("y")
    own = [m for m in metrics if m not in ("DICE", "JACCARD")]
    union = [m for m in metrics if m in ("DICE", "JACCARD")]
    if filtering == "EITHER" or not union:
        return over.groupBy(*k).agg(*[measures(x, y, m).alias(m.lower()) for m in metrics])
    both = joined(left, right, k, k, "EITHER").groupBy(*k).agg(*[measures(x, y, m).alias(m.lower()) for m in union])
    if not own:
        return both
    some = over.groupBy(*k).agg(*[measures(x, y, m).alias(m.lower()) for m in own])
    return some.join(both, k, "full_outer") if k else some.crossJoin(both)


def pairwise(vectors: DataFrame, key: str, metric: str = "COSINE") -> DataFrame:
    """``left, right, distance`` of all pairs of a limited number of vectors, left before right, over the union of terms.

    Vectors meet by their terms; what one has alone comes from sums per vector, so no cross product of vocabularies is made.
    Weights must not be negative for DICE and JACCARD."""
    v = vectors.select(F.col(key).alias("k"), "term", "weight")
    each = v.groupBy("k").agg(F.sum("weight").alias("s"), F.sum(F.col("weight") * F.col("weight")).alias("ss"))
    a, b = v.select(F.col("k").alias("left"), "term", F.col("weight").alias("x")), v.select(F.col("k").alias("right"), "term", F.col("weight").alias("y"))
    meet = a.join(b, "term").filter(F.col("left") < F.col("right"))
    x, y = F.col("x"), F.col("y")
    meet = meet.groupBy("left", "right").agg(F.sum(x * y).alias("xy"), F.sum(F.least(x, y)).alias("low"), F.sum(F.abs(x - y) - x - y).alias("off"))
    l, r = each.select(F.col("k").alias("left"), F.col("s").alias("sl"), F.col("ss").alias("ssl")), each.select(F.col("k").alias("right"), F.col("s").alias("sr"), F.col("ss").alias("ssr"))
    pairs = l.join(r, F.col("left") < F.col("right")).join(meet, ["left", "right"], "left").fillna(0.0, ["xy", "low", "off"])
    total = F.col("sl") + F.col("sr")
    d = {
        "COSINE": 1 - F.when(F.col("ssl") * F.col("ssr") > 0, F.col("xy") / (F.sqrt("ssl") * F.sqrt("ssr"))).otherwise(0.0),
        "DICE": 1 - F.when(total != 0, 2 * F.col("low") / total).otherwise(0.0),
        "JACCARD": 1 - F.when(total != F.col("low"), F.col("low") / (total - F.col("low"))).otherwise(0.0),
        "EUCLIDEAN": F.sqrt(F.greatest(F.lit(0.0), F.col("ssl") + F.col("ssr") - 2 * F.col("xy"))),
        "MANHATTAN": F.sqrt(F.greatest(F.lit(0.0), total + F.col("off"))),
    }[metric]
    return pairs.select("left", "right", d.alias("distance"))
