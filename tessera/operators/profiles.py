"""Population statistics: depth profiles, correlations, tails, shares, histograms, errors."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.missing import both, pearson


def depth_profile(df: DataFrame, keys: Sequence[str], depth: str, value: str, p: float, least: int = 1) -> DataFrame:
    """A percentile of the values at each depth that has ``least`` values or more."""
    g = df.groupBy(*keys, depth).agg(F.percentile(value, p).alias("value"), F.count(value).alias("n"))
    return g.filter(F.col("n") >= least)


def profile_correlation(a: DataFrame, b: DataFrame, keys: Sequence[str], depth: str, va: str, vb: str, least: int = 3) -> DataFrame:
    """Correlation of two profiles over their common depths."""
    j = a.select(*keys, depth, va).join(b.select(*keys, depth, vb), [*keys, depth])
    return j.groupBy(*keys).agg(pearson(va, vb, least).alias("r"))


def tails(df: DataFrame, keys: Sequence[str], value: str | Column, low: float = 0.05, high: float = 0.95) -> DataFrame:
    v = F.col(value) if isinstance(value, str) else value
    g = df.withColumn("_v", v).groupBy(*keys).agg(F.percentile("_v", F.array(F.lit(low), F.lit(high))).alias("_q"))
    return g.select(*keys, F.get("_q", F.lit(0)).alias("low"), F.get("_q", F.lit(1)).alias("high"))


def log_ratio(a: str, b: str) -> Column:
    """log2(b / a) where both are positive."""
    return F.when((F.col(a) > 0) & (F.col(b) > 0), F.log2(F.col(b) / F.col(a)))


def difference(a: str, b: str) -> Column:
    return F.when(both(F.col(a), F.col(b)), F.col(b) - F.col(a))


def removed_percent(df: DataFrame, keys: Sequence[str], raw: str, corrected: str) -> DataFrame:
    """Share of the valid raw values that the correction made missing."""
    gone = F.sum((F.col(raw).isNotNull() & F.col(corrected).isNull()).cast("int"))
    return df.groupBy(*keys).agg((100.0 * F.try_divide(gone, F.count(raw))).alias("removed"))


def share_below(df: DataFrame, value: str, limit: float) -> Column:
    return 100.0 * F.avg((F.col(value) < limit).cast("int"))


def histogram(df: DataFrame, value: str, edges: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """bin, n, percent over fixed edges; bins are half open, the last one closed. Values outside count in no bin."""
    e = [float(x) for x in edges]
    bin_ = F.when(F.col(value) == e[-1], len(e) - 2)
    # width_bucket would need equal bins; a binary chain of comparisons keeps the expression shallow for uneven ones.
    bin_ = bin_.when(F.col(value).between(e[0], e[-1]), F.aggregate(F.array(*[F.lit(x) for x in e]), F.lit(-1), lambda n, x: n + (F.col(value) >= x).cast("int")))
    g = df.withColumn("bin", bin_).filter("bin IS NOT NULL").groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys)
    return g.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(w))


#: Bins that automatic edges have at most.
MOST_BINS = 80


def automatic_edges(df: DataFrame, *values: str, most: int = MOST_BINS) -> list[float]:
    """Edges of equal bins that the values of all these columns share, over a range that holds zero; zero is always an edge.

    The width is NumPy's "auto" (its release 2.3): Freedman and Diaconis' rule, not below half the square-root rule's, and Sturges' where
    that is narrower. Over ``most`` bins, so many cover the range. One pass gives five numbers, from which the edges follow.
    """
    v = df.select(F.explode(F.array(*[F.col(c).cast("double") for c in values])).alias("v"))
    odd = F.col("v").isNull() | F.isnan("v") | (F.abs("v") == float("inf"))
    quartiles = F.percentile("v", F.array(F.lit(0.25), F.lit(0.75)))
    n, bad, low, high, q = v.agg(F.count(F.lit(1)), F.count_if(odd), F.min("v"), F.max("v"), quartiles).first()
    if n == 0 or bad:
        raise ValueError("the values of a histogram must be finite, and there must be some")
    first, last, span = min(0.0, low), max(0.0, high), high - low
    if first == last:
        return [-EPSILON, 0.0, EPSILON]
    width = min(max(2 * (q[1] - q[0]) * n ** (-1 / 3), span / n**0.5 / 2), span / (math.log2(n) + 1))
    bins = min(most, math.ceil((last - first) / width)) if width > 0 else 1
    step = (last - first) / bins
    edges = [first + i * step for i in range(bins)] + [last]
    return edges if 0.0 in edges else sorted([*edges, 0.0])


#: The distance from 1 to the next double.
EPSILON = 2.0**-52


def rmse(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Root mean square error of the complete pairs of each key, and of all (key missing)."""
    r = F.when(both(F.col(a), F.col(b)), F.col(a) - F.col(b))
    d = df.select(key, r.alias("_r"))
    return d.rollup(key).agg(F.sqrt(F.try_divide(F.sum(F.col("_r") * F.col("_r")), F.count("_r"))).alias("rmse"), F.count("_r").alias("n"), F.grouping(key).cast("int").alias("pooled"))


def median_centre(df: DataFrame, keys: Sequence[str], value: str, scale: float, out: str) -> DataFrame:
    """Values about their key's median, scaled."""
    return df.withColumn(out, (F.col(value) - F.percentile(value, 0.5).over(Window.partitionBy(*keys))) * scale)


def pool(tables: dict[str, DataFrame], value: str) -> DataFrame:
    """Values of several data sets as one table with their names."""
    out = None
    for name, df in tables.items():
        d = df.select(F.lit(name).alias("dataset"), F.col(value))
        out = d if out is None else out.unionByName(d)
    return out
