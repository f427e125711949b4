"""Planes: the best reference, the best plane of a frame and its neighbours, bad frames, shift ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .align import small
from .depth import argmax


def best_planes(corr: DataFrame) -> DataFrame:
    """frame, ref, plane, corr: each reference's best plane for each frame."""
    return argmax(corr, ["frame", "ref"], "plane", "corr")


def best_reference(corr: DataFrame, n_planes: int) -> DataFrame:
    """ref, coverage, mean: the reference whose frames' shifts stay within the planes most often.

    Equal coverage goes by the mean of the best correlations, then by the smallest reference.
    """
    best = best_planes(corr)
    shift = best.withColumn("s", F.col("plane") - F.col("ref"))
    w = Window.partitionBy("frame")
    shift = shift.withColumn("mn", F.min("s").over(w)).withColumn("mx", F.max("s").over(w))
    inside = lambda c: ((F.col("ref") + F.col(c)).between(0, n_planes - 1)).cast("int")
    g = shift.groupBy("ref").agg(F.sum(inside("mn") + inside("mx")).alias("coverage"), F.avg("corr").alias("mean"))
    return g.orderBy(F.desc("coverage"), F.desc("mean"), "ref").limit(1)


def neighbours(best: DataFrame, frames: DataFrame, weights: Sequence[float], n_planes: int) -> DataFrame:
    """frame, plane, centre, bad, weight: each frame's best plane and those beside it, with their weights.

    Planes out of range, and bad frames beside the centre, weigh nothing; if a weight is zero the others are scaled to one.
    """
    half = len(weights) // 2
    taps = F.explode(F.array(*[F.struct(F.lit(i - half).alias("o"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)]))
    d = best.select("frame", F.col("plane").alias("centre"), taps.alias("t")).select("frame", "centre", (F.col("centre") + F.col("t.o")).alias("plane"), F.col("t.w").alias("w"))
    d = d.join(frames.select("frame", "plane", "bad"), ["frame", "plane"], "left").withColumn("bad", F.coalesce("bad", F.lit(False)))
    dropped = ~F.col("plane").between(0, n_planes - 1) | (F.col("bad") & (F.col("plane") != F.col("centre")))
    d = d.withColumn("w", F.when(dropped, 0.0).otherwise(F.col("w")))
    by = Window.partitionBy("frame")
    d = d.withColumn("_z", F.max((F.col("w") == 0).cast("int")).over(by)).withColumn("_s", F.sum("w").over(by))
    return d.withColumn("weight", F.when(F.col("_z") == 1, F.try_divide(F.col("w"), F.col("_s"))).otherwise(F.col("w"))).drop("_z", "_s", "w")


def weighted_frame(near: DataFrame, pixels: DataFrame, keys: Sequence[str], plane: str = "plane", index: str = "i", value: str = "v", weight: str = "weight") -> DataFrame:
    """Pixel by pixel the weighted sum over a frame's planes, in single precision at the end."""
    d = near.join(pixels, [*keys, plane])
    return d.groupBy(*keys, index).agg(F.sum(F.col(weight) * F.col(value)).cast("float").alias(value))


def weighted_images(near: DataFrame, images: DataFrame, keys: Sequence[str], plane: str = "plane", px: str = "px", weight: str = "weight", normalise: bool = False) -> DataFrame:
    """keys, px: the weighted sum of whole images over a frame's planes, in single precision at the end; planes that are missing add nothing.

    ``normalise`` divides by the sum of the weights that count, whatever it is. As many images meet as there are weights.
    """
    d = near.join(images.select(*keys, plane, px), [*keys, plane]).filter(F.col(weight) != 0)
    g = d.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(plane, F.col(weight).cast("double").alias("w"), F.col(px).alias("x")))).alias("_all"), F.sum(weight).alias("_w"))
    scale = F.col("_w") if normalise else F.lit(1.0)
    start = F.transform(F.get("_all", F.lit(0))["x"], lambda v: F.lit(0.0))
    total = F.aggregate("_all", start, lambda s, e: F.zip_with(s, e["x"], lambda a, b: a + b.cast("double") * e["w"]), lambda s: F.transform(s, lambda v: (v / scale).cast("float")))
    return g.select(*keys, total.alias(px))


def low_by_plane(df: DataFrame, keys: Sequence[str], corr: str, deviations: float = 4.0, out: str = "low") -> DataFrame:
    """Frames whose correlation is at or below their plane's mean less so many deviations."""
    s = df.groupBy(*keys).agg((F.avg(corr) - deviations * F.stddev_pop(corr)).alias("_limit"))
    return df.join(small(s), list(keys)).withColumn(out, F.col(corr) <= F.col("_limit")).drop("_limit")


def low_correlation(df: DataFrame, corr: str, deviations: float = 4.0, out: str = "low") -> DataFrame:
    """Frames whose best correlation is at or below the mean less so many deviations (all, if the deviation is zero)."""
    s = df.agg(F.avg(corr).alias("_m"), F.stddev_pop(corr).alias("_s"))
    return df.crossJoin(F.broadcast(s)).withColumn(out, F.col(corr) <= F.col("_m") - deviations * F.col("_s")).drop("_m", "_s")


def shift_ranges(df: DataFrame, keys: Sequence[str], x: str, y: str, lx: int, ly: int) -> DataFrame:
    """The columns and rows that stay inside after all shifts."""
    zero = F.lit(0)
    g = df.groupBy(*keys).agg(*[f(c).alias(n) for f, c, n in ((F.max, x, "_xh"), (F.min, x, "_xl"), (F.max, y, "_yh"), (F.min, y, "_yl"))])
    return g.select(*keys, F.greatest(zero, "_xh").alias("x0"), (lx + F.least(zero, "_xl")).alias("x1"), F.greatest(zero, "_yh").alias("y0"), (ly + F.least(zero, "_yl")).alias("y1"))


def accumulate_shifts(df: DataFrame, keys: Sequence[str], order: str, shift: str, out: str) -> DataFrame:
    """Running sums of pairwise shifts about their median."""
    w = Window.partitionBy(*keys)
    d = df.withColumn(out, F.sum(shift).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    return d.withColumn(out, F.col(out) - F.percentile(out, 0.5).over(w))


def usable_planes(df: DataFrame, n: str, flyback: str, out: str = "plane") -> DataFrame:
    """One row for each plane that is not a flyback plane."""
    planes = F.array_except(F.sequence(F.lit(0), F.col(n) - 1), F.col(flyback))
    return df.withColumn(out, F.explode(planes))


def shift_extremes(corr: DataFrame) -> DataFrame:
    """frame, low, high: the least and the largest distance of a reference's best plane from the reference."""
    s = F.col("plane") - F.col("ref")
    return best_planes(corr).groupBy("frame").agg(F.min(s).alias("low"), F.max(s).alias("high"))


def similarity_weights(corr: DataFrame, best: int) -> DataFrame:
    """offset, weight: how much the best reference's neighbours resemble it, scaled to one; a missing neighbour weighs nothing."""
    near = corr.filter(F.col("plane").between(best - 1, best + 1)).select((F.col("plane") - best).alias("offset"), "corr")
    rows = corr.sparkSession.range(-1, 2).select(F.col("id").alias("offset"))
    d = rows.join(small(near), "offset", "left").withColumn("corr", F.coalesce("corr", F.lit(0.0)))
    # Three rows: one window without keys is no burden.
    return d.select("offset", F.try_divide("corr", F.sum("corr").over(Window.partitionBy())).alias("weight"))


def combine_neighbours(best: DataFrame, results: DataFrame, reach: int = 1) -> DataFrame:
    """frame, plane, bad, xoff, yoff of each frame's best plane and those beside it; bad or missing ones are not shifted."""
    d = best.select("frame", F.explode(F.sequence(F.col("plane") - reach, F.col("plane") + reach)).alias("plane"))
    d = d.join(results.select("frame", "plane", "bad", "xoff", "yoff"), ["frame", "plane"], "left").withColumn("bad", F.coalesce("bad", F.lit(False)))
    shift = lambda c: F.when(~F.col("bad"), F.coalesce(c, F.lit(0))).otherwise(0).alias(c)
    return d.select("frame", "plane", "bad", shift("xoff"), shift("yoff"))


def ordered_planes(folders: DataFrame, path: str, keys: Sequence[str] = ()) -> DataFrame:
    """Folders named plane<n>, in the order of their numbers (10 after 9), with number and position; others are left out."""
    d = folders.withColumn("plane", F.expr("try_cast(regexp_extract(`" + path + "`, 'plane([0-9]+)/?$', 1) AS int)")).filter("plane IS NOT NULL")
    return d.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy("plane")) - 1)


def with_correlation_limit(df: DataFrame, corr: str, deviations: float = 4.0) -> DataFrame:
    """The correlation below which frames are bad, beside each frame and whether it is."""
    s = df.agg((F.avg(corr) - deviations * F.stddev_pop(corr)).alias("limit"))
    return df.crossJoin(F.broadcast(s)).withColumn("low", F.col(corr) <= F.col("limit"))
