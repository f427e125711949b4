"""Depth traces: arg-max slices, boundaries, reference depth, and the search that widens its range."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sequence import ordered
from .smooth import gaussian_nearest


def argmax(df: DataFrame, keys: Sequence[str], index: str, value: str) -> DataFrame:
    """The row with the largest value of each key; of equal ones that with the smallest index."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(value), F.asc(index))
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def null_boundary(df: DataFrame, z: str, low: int, high: int) -> DataFrame:
    """Depths at either end of the evaluated range are not known."""
    return df.withColumn(z, F.when((F.col(z) != low) & (F.col(z) != high), F.col(z)))


def reference_depth(df: DataFrame, z: str, keys: Sequence[str] = ()) -> DataFrame:
    """The median of the known depths, cut to an integer; keys none of whose depths is known fail the query."""
    m = df.groupBy(*keys).agg(F.percentile(z, 0.5).cast("int").alias("reference"))
    return m.withColumn("reference", F.coalesce("reference", F.raise_error(F.lit("no depth is known in the reference interval")).cast("int")))


def search(correlate: Callable[[list[int]], DataFrame], n_slices: int, best: int, step: int, sigma: float, keep: Callable[[DataFrame, str], DataFrame], max_rounds: int = 100) -> tuple[DataFrame, int]:
    """(segment, frame, z; rounds): the range of slices grows while a frame's best slice lies at its edge.

    correlate(slices) gives segment, frame, z, corr; keep(df, name) cuts lineage, so that a round reads written slices only.
    Each segment's first frame does not widen the range, unless there are no others.
    """
    low, high = max(0, best - step), min(n_slices - 1, best + step)
    done = keep(correlate(list(range(low, high + 1))), "slices")
    for rounds in range(1, max_rounds + 1):
        smooth = gaussian_nearest(done, ["segment", "frame"], "z", "corr", sigma, "smoothed") if sigma > 0 else done.withColumn("smoothed", F.col("corr"))
        z = argmax(smooth, ["segment", "frame"], "z", "smoothed").select("segment", "frame", "z")
        z = z.withColumn("first", F.col("frame") == F.min("frame").over(Window.partitionBy("segment")))
        edge = z.agg(F.min("first").alias("only"), *[F.max(((F.col("z") == v) & ~F.col("first")).cast("int")).alias(n) for n, v in (("lo", low), ("hi", high))], *[F.max((F.col("z") == v).cast("int")).alias(f"{n}_all") for n, v in (("lo", low), ("hi", high))]).first()
        at_low, at_high = (edge.lo_all, edge.hi_all) if edge.only else (edge.lo, edge.hi)
        new = [*range(max(0, low - step), low)] * bool(at_low) + [*range(high + 1, min(n_slices, high + 1 + step))] * bool(at_high)
        if not new:
            break
        done = keep(done.unionByName(correlate(new)), "slices")
        low, high = min([low, *new]), max([high, *new])
    return null_boundary(z.drop("first"), "z", low, high), rounds


def nearest_depth(df: DataFrame, keys: Sequence[str], order: str, z: str) -> DataFrame:
    """Unknown depths by the last known one before."""
    return df.withColumn(z, F.last(z, True).over(ordered(keys, order)))
