"""Behavioural events: running onsets and averages of a signal around them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_onsets(df: DataFrame, keys: Sequence[str], t: str, velocity: str, threshold: float, before_s: float, after_s: float) -> DataFrame:
    """Times at which running starts after ``before_s`` of rest and before ``after_s`` of running, all inside one segment."""
    w = Window.partitionBy(*keys)
    run = F.coalesce(F.col(velocity) > threshold, F.lit(False))
    rest = F.coalesce(F.col(velocity) <= threshold, F.lit(False))
    d = df.withColumn("_run", run).withColumn("_rest", rest)
    d = d.withColumns({"_was": F.lag("_run").over(w.orderBy(t)), "_t0": F.min(t).over(w), "_t1": F.max(t).over(w), "_at": F.dense_rank().over(w.orderBy(t))})
    # A stretch is unbroken if the nearest row that breaks it lies outside: no frame is as long as the stretch. Rows of one time have one place.
    earlier = w.orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    onward = w.orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({"_last": F.max(t).over(earlier), "_moved": F.max(F.when(~F.col("_rest"), F.col(t))).over(earlier), "_stopped": F.min(F.when(~F.col("_run"), F.col(t))).over(onward)})
    start, stop = F.col(t) - before_s, F.col(t) + after_s
    rested = (F.col("_last") >= start) & F.coalesce(F.col("_moved") < start, F.lit(True))
    ran = F.coalesce(F.col("_stopped") >= stop, F.lit(True))
    ok = F.col("_run") & ~F.col("_was") & (F.col(t) - F.col("_t0") >= before_s) & (F.col("_t1") - F.col(t) >= after_s)
    return d.filter(ok & rested & ran).select(*keys, F.col(t).alias("onset"))


def around_events(events: DataFrame, at: str, signal: DataFrame, t: str, value: str, keys: Sequence[str], grid: Sequence[float]) -> DataFrame:
    """keys, onset, rel, value: the signal by linear interpolation on a grid of times relative to each event.

    Grid points and samples of a key are one ordered series, so neighbours come from one sort; points beyond the samples are missing.
    """
    pts = events.select(*keys, F.col(at).alias("onset"), F.explode(F.array(*[F.lit(float(g)) for g in grid])).alias("rel"))
    pts = pts.select(*keys, (F.col("onset") + F.col("rel")).alias("_t"), "onset", "rel", F.lit(None).cast("double").alias("_v"))
    s = signal.filter(F.col(value).isNotNull()).select(*keys, F.col(t).alias("_t"), F.lit(None).cast("double").alias("onset"), F.lit(None).cast("double").alias("rel"), F.col(value).cast("double").alias("_v"))
    # Both frames begin at an end of the series; the samples of a point's own time come before it in either order.
    back, ahead = (Window.partitionBy(*keys).orderBy(*o).rowsBetween(Window.unboundedPreceding, 0) for o in ((F.asc("_t"), "_point", F.asc("_v")), (F.desc("_t"), "_point", F.desc("_v"))))
    x = F.when(F.col("_v").isNotNull(), F.col("_t"))
    u = pts.unionByName(s).withColumn("_point", F.col("rel").isNotNull())
    u = u.withColumns({"_x0": F.last(x, True).over(back), "_x1": F.last(x, True).over(ahead), "_y0": F.last("_v", True).over(back), "_y1": F.last("_v", True).over(ahead)})
    line = F.when(F.col("_x1") > F.col("_x0"), F.col("_y0") + (F.col("_y1") - F.col("_y0")) * (F.col("_t") - F.col("_x0")) / (F.col("_x1") - F.col("_x0"))).otherwise(F.col("_y0"))
    return u.filter("rel IS NOT NULL").select(*keys, "onset", "rel", F.when(F.col("_x0").isNotNull() & F.col("_x1").isNotNull(), line).alias("value"))


def mean_sem(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, standard error (missing for one value) and count."""
    n = F.count(value)
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.when(n > 1, F.try_divide(F.stddev_samp(value), F.sqrt(n))).alias("sem"), n.alias("n"))


def subtract_before(df: DataFrame, keys: Sequence[str], rel: str, value: str, seconds: float) -> DataFrame:
    """Each event's values about their mean in the last seconds before it."""
    base = F.avg(F.when((F.col(rel) >= -seconds) & (F.col(rel) < 0), F.col(value))).over(Window.partitionBy(*keys))
    return df.withColumn(value, F.col(value) - base)
