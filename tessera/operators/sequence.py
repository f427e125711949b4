"""Ordered sequences: edges, islands, numbering, equal lengths, peaks, interpolation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.shared import written


def ordered(keys: Sequence[str], *order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def number(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "frame") -> DataFrame:
    """Numbers from 0 in each group."""
    return df.withColumn(out, (F.row_number().over(ordered(keys, *order)) - 1).cast("long"))


def rising_edges(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, threshold: float) -> DataFrame:
    """Rows whose value is over the threshold while the one before was not (the first has a low one before it)."""
    high = F.coalesce(F.col(value) > threshold, F.lit(False))
    before = F.coalesce(F.lag(high).over(ordered(keys, *order)), F.lit(False))
    return df.withColumn("_edge", high & ~before).filter("_edge").drop("_edge")


def islands(df: DataFrame, keys: Sequence[str], order: str, valid: Column, out: str = "run") -> DataFrame:
    """Valid rows with the number of their run of consecutive valid rows."""
    w = ordered(keys, order)
    d = df.withColumn("_v", valid)
    starts = F.col("_v") & ~F.coalesce(F.lag("_v").over(w), F.lit(False))
    return d.withColumn("_s", starts.cast("long")).withColumn(out, F.sum("_s").over(w)).filter("_v").drop("_v", "_s")


def spans(df: DataFrame, keys: Sequence[str], order: str, valid: Column) -> DataFrame:
    """First and last position of each run."""
    return islands(df, keys, order, valid).groupBy(*keys, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"))


def equalise(df: DataFrame, plane: str, segment: str, order: Sequence[str]) -> DataFrame:
    """The first n frames of each segment in each plane, n the least number over all planes; renumbered over the segments.

    A plane that lacks a segment has none of its frames, so the other planes lose theirs.
    """
    n = df.groupBy(plane, segment).agg(F.count(F.lit(1)).alias("_n"))
    # One row for each plane and segment: few, whatever the number of frames.
    n = n.withColumn("_planes", F.size(F.collect_set(plane).over(Window.partitionBy(F.lit(0)))))
    n = n.groupBy(segment).agg(F.when(F.count(F.lit(1)) == F.max("_planes"), F.min("_n")).otherwise(0).alias("_n"))
    d = df.withColumn("_at", F.row_number().over(ordered([plane, segment], *order))).join(n, segment)
    return number(d.filter("_at <= _n").drop("_at", "_n"), [plane], [segment, *order], "frame")


def boundaries(df: DataFrame, segment: str, length: str) -> DataFrame:
    """Start and stop of each segment in the concatenated series."""
    w = Window.orderBy(segment).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("stop", F.sum(length).over(w)).withColumn("start", F.col("stop") - F.col(length))


def trim(df: DataFrame, segment: str, length: str, total: int) -> DataFrame:
    """Segment lengths cut to a total."""
    d = boundaries(df, segment, length)
    return d.withColumn(length, F.greatest(F.lit(0), F.least(F.col(length), F.lit(total) - F.col("start"))))


def local_peaks(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Strict local maxima."""
    w = ordered(keys, order)
    d = df.withColumn("_b", F.lag(value).over(w)).withColumn("_a", F.lead(value).over(w))
    return d.filter((F.col(value) > F.col("_b")) & (F.col(value) > F.col("_a"))).drop("_a", "_b")


def number_all(df: DataFrame, order: str, out: str) -> DataFrame:
    """The rows of a whole table numbered from 0 in order, no task holding them all: by ranges, each numbered from where those before it end.

    Equal values of ``order`` fall into one range, so they should be few.
    """
    d = written(df.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "ranges")
    n = d.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # One row for each range.
    start = n.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_start"))
    d = d.join(F.broadcast(start), "_range").withColumn(out, F.row_number().over(ordered(["_range"], order)) - 1 + F.col("_start"))
    return d.drop("_range", "_start")


def autocorrelation(df: DataFrame, order: str, value: str, lags: int, block: int = 1 << 14) -> DataFrame:
    """lag, ac: sums of products of the centred series with itself, shifted by 0 .. lags - 1.

    The series is cut into blocks, each with the ``lags`` values after it; the blocks' sums are added up.
    """
    block = max(block, lags)
    mean = df.agg(F.avg(value).alias("_mean"))
    d = number_all(df.select(order, F.col(value).cast("double").alias("_x")), order, "_i").crossJoin(F.broadcast(mean))  # one row
    own = F.expr(f"_i div {block}")
    blocks = F.when((F.col("_i") % block < lags) & (own > 0), F.array(own - 1, own)).otherwise(F.array(own))
    d = d.select("_i", (F.col("_x") - F.col("_mean")).alias("_x"), F.explode(blocks).alias("_b"))

    def run(pdf):
        pdf = pdf.sort_values("_i")
        x, mine = pdf["_x"].to_numpy(dtype=float), int((pdf["_i"] // block == pdf["_b"]).sum())
        # A missing value makes the sums missing that it is part of.
        sums = [float(np.dot(x[: min(mine, len(x) - k)], x[k : k + mine])) if k < len(x) else 0.0 for k in range(lags)]
        return type(pdf)({"lag": range(lags), "ac": sums})

    parts = d.groupBy("_b").applyInPandas(run, "lag int, ac double")
    return parts.groupBy("lag").agg(F.when(~F.isnan(F.sum("ac")), F.sum("ac")).alias("ac"))


def plane_count(ac: DataFrame) -> DataFrame:
    """The smallest lag of 2 or more at which the autocorrelation peaks; a peak of equal values lies at their middle, rounded down."""
    # As many rows as there are lags.
    w = Window.orderBy("lag")
    d = ac.filter("lag >= 1").withColumn("_new", F.coalesce((F.col("ac") != F.lag("ac").over(w)).cast("int"), F.lit(1)))
    flat = d.withColumn("_run", F.sum("_new").over(w)).groupBy("_run").agg(F.min("lag").alias("_first"), F.max("lag").alias("_last"), F.min("ac").alias("ac"))
    w = Window.orderBy("_run")
    d = flat.withColumn("_b", F.lag("ac").over(w)).withColumn("_a", F.lead("ac").over(w))
    return d.filter("ac > _b AND ac > _a").agg(F.min(F.expr("(_first + _last) div 2")).cast("long").alias("planes"))


def interpolate(df: DataFrame, keys: Sequence[str], at: str, value: str, clamp: bool = True) -> DataFrame:
    """Missing values by the line between their neighbours; before the first and after the last by them, or NULL."""
    # What follows is what comes before in the reversed order: Spark works a frame up to the last row out anew for each row.
    back, ahead = (Window.partitionBy(*keys).orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc(at), F.desc(at)))
    has = F.when(F.col(value).isNotNull(), F.col(at))
    d = df.withColumns({"_x0": F.last(has, True).over(back), "_y0": F.last(value, True).over(back), "_x1": F.last(has, True).over(ahead), "_y1": F.last(value, True).over(ahead)})
    line = F.col("_y0") + (F.col("_y1") - F.col("_y0")) * F.try_divide(F.col(at) - F.col("_x0"), F.col("_x1") - F.col("_x0"))
    filled = F.coalesce(F.col(value), line)
    if clamp:
        filled = F.coalesce(filled, F.col("_y0"), F.col("_y1"))
    return d.withColumn(value, filled).drop("_x0", "_y0", "_x1", "_y1")


def even_sample(df: DataFrame, order: str, k: int) -> DataFrame:
    """k rows evenly spread over n: those at floor((i + 0.5) n / k)."""
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    picks = n.select(F.explode(F.transform(F.sequence(F.lit(0), F.least(F.lit(k), F.greatest(F.col("_n"), F.lit(1))).cast("int") - 1), lambda i: F.floor((i + 0.5) * F.col("_n") / F.least(F.lit(k), F.col("_n"))))).alias("_at"))
    return number_all(df, order, "_at").join(F.broadcast(picks), "_at").drop("_at")  # k rows


def boundary_times(df: DataFrame, keys: Sequence[str], segment: str, order: str, t: str) -> DataFrame:
    """keys, segment, at: halfway between the last frame of a segment and the first of the next."""
    w = ordered(keys, segment, order)
    d = df.select(*keys, segment, ((F.col(t) + F.lag(t).over(w)) / 2).alias("at"), (F.col(segment) != F.lag(segment).over(w)).alias("_new"))
    return d.filter("_new").drop("_new")
