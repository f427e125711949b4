"""Composite analyses: trace differences, effective depths, cycles of the scanner, masks, planning of missing parts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import hanning
from ..functions.missing import both, pearson
from ..sources.shared import written
from .align import median_interval
from .sequence import number_all, ordered


def trace_differences(df: DataFrame, keys: Sequence[str], raw: str, corrected: str, least: int = 3) -> DataFrame:
    """For each cell the tails of ratio and difference of its two traces, their correlation, and what was removed: one pass."""
    a, b = F.col(raw), F.col(corrected)
    tails = F.array(F.lit(0.05), F.lit(0.95))
    ratio = F.when((a > 0) & (b > 0), F.log2(b / a))
    gone = F.sum((a.isNotNull() & b.isNull()).cast("int"))
    g = df.groupBy(*keys).agg(
        F.percentile(ratio, tails).alias("_r"), F.percentile(F.when(both(a, b), b - a), tails).alias("_d"), pearson(raw, corrected, least).alias("correlation"), (100.0 * F.try_divide(gone, F.count(raw))).alias("removed")
    )
    at = lambda c, i: F.get(c, F.lit(i))
    return g.select(*keys, at("_r", 0).alias("ratio_low"), at("_r", 1).alias("ratio_high"), at("_d", 0).alias("difference_low"), at("_d", 1).alias("difference_high"), "correlation", "removed")


def effective_depth(df: DataFrame, best: DataFrame, keys: Sequence[str], plane: str = "plane", best_plane: str = "best_plane") -> DataFrame:
    """Each value with the distance of its plane from the frame's best one."""
    return df.join(best, list(keys)).withColumn("depth", F.col(plane) - F.col(best_plane))


def relative_profile(profile: DataFrame, keys: Sequence[str], depth: str = "depth", value: str = "value") -> DataFrame:
    """A profile over its value at depth 0, which must be positive (else missing)."""
    zero = F.max(F.when(F.col(depth) == 0, F.col(value))).over(Window.partitionBy(*keys))
    return profile.withColumn("relative", F.when(zero > 0, F.col(value) / zero))


def cycle_residuals(df: DataFrame, keys: Sequence[str], order: str, value: str, n: int) -> DataFrame:
    """keys, cycle, offset: the median of each whole cycle of n samples after the mean cycle was taken away."""
    d = df.withColumn("_i", F.row_number().over(ordered(keys, order)) - 1)
    d = d.withColumn("cycle", F.floor(F.col("_i") / n)).withColumn("_p", F.col("_i") % n)
    d = d.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys, "cycle"))).filter(F.col("_n") == n)
    d = d.withColumn("_res", F.col(value) - F.avg(value).over(Window.partitionBy(*keys, "_p")))
    return d.groupBy(*keys, "cycle").agg(F.percentile("_res", 0.5).alias("offset"))


def shared_offset(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """The median over keys of each key's median difference."""
    per = df.groupBy(key).agg(F.percentile(F.when(both(F.col(a), F.col(b)), F.col(a) - F.col(b)), 0.5).alias("_m"))
    return per.agg(F.percentile("_m", 0.5).alias("offset"))


def rasterise(roi: DataFrame, keys: Sequence[str], y: str = "ypix", x: str = "xpix", overlap: str = "overlap") -> DataFrame:
    """keys, y, x of a mask's pixels that no other mask shares."""
    z = F.explode(F.arrays_zip(F.col(y).alias("y"), F.col(x).alias("x"), F.col(overlap).alias("o")))
    return roi.select(*keys, z.alias("_p")).filter(~F.col("_p.o")).select(*keys, F.col("_p.y").alias("y"), F.col("_p.x").alias("x"))


def unravel(df: DataFrame, index: str, width: int) -> DataFrame:
    """Row and column of a flat index."""
    return df.withColumn("y", F.floor(F.col(index) / width).cast("long")).withColumn("x", F.col(index) % width)


def clip_normalise(px: DataFrame, keys: Sequence[str], value: str, low: float, high: float) -> DataFrame:
    """Pixels clipped to two percentiles of their image and scaled to [0, 1]; a constant image gives missing values."""
    w = Window.partitionBy(*keys)
    d = px.withColumn("_q", F.percentile(value, F.array(F.lit(low), F.lit(high))).over(w))
    lo, hi = F.get("_q", F.lit(0)), F.get("_q", F.lit(1))
    return d.withColumn(value, F.try_divide(F.greatest(lo, F.least(hi, F.col(value))) - lo, hi - lo)).drop("_q")


def out_of_bounds(roi: DataFrame, keys: Sequence[str], height: int, width: int, y: str = "ypix", x: str = "xpix") -> DataFrame:
    """Masks with pixels outside the image, or with unequal coordinates."""
    bad = (F.array_min(y) < 0) | (F.array_min(x) < 0) | (F.array_max(y) >= height) | (F.array_max(x) >= width) | (F.size(y) != F.size(x))
    return roi.filter(F.coalesce(bad, F.lit(True))).select(*keys)


def shift_checksum(df: DataFrame, keys: Sequence[str], order: str, x: str, y: str) -> DataFrame:
    """The largest shift of each key and a digest of all its shifts in order.

    Each key's shifts are digested in blocks of 4096 first, so that no array grows with the recording but by its digests.
    """
    d = df.withColumn("_i", F.row_number().over(ordered(keys, order)) - 1)
    line = F.struct("_i", F.concat_ws(",", F.col(x).cast("string"), F.col(y).cast("string")).alias("s"))
    b = d.groupBy(*keys, F.floor(F.col("_i") / 4096).alias("_b")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda v: v["s"]), ";"), 256).alias("h"), F.max(F.greatest(F.abs(x), F.abs(y))).alias("m"))
    return b.groupBy(*keys).agg(F.max("m").alias("largest"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_b", "h"))), lambda v: v["h"]), ";"), 256).alias("checksum"))


def missing_parts(expected: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What a rebuild would make: expected parts that are not there."""
    return expected.join(present.select(*keys), list(keys), "left_anti")


def scanner_paths(samples: DataFrame, frames: DataFrame, samples_per_frame: int, smooth_width: int, t: str = "t_s", value: str = "volts", block: int = 1 << 18) -> DataFrame:
    """frame columns, offset, v: the smoothed samples from the first at or after each frame's time ``_c`` on.

    Samples are numbered and cut into blocks that overlap by what a frame and the kernel reach; beyond the ends of the recording there are zeros
    for the kernel, and a frame whose samples it does not have fails the query.
    """
    weights = np.array(hanning(smooth_width))
    half = len(weights) // 2
    reach = len(weights) + samples_per_frame + 1
    block = max(block, reach)
    names = frames.columns
    s = written(number_all(samples.select(F.col(t).cast("double").alias("_t"), F.col(value).cast("double").alias("_v")), "_t", "_i"), "piezo")
    # One row for each block: where it starts. A frame is looked for in the last block that starts before it.
    starts = s.filter(F.col("_i") % block == 0).agg(F.array_sort(F.collect_list("_t")).alias("_starts"))
    at = F.greatest(F.lit(0), F.size(F.filter("_starts", lambda x: x < F.col("_c"))) - 1)
    f = frames.crossJoin(F.broadcast(starts)).select(*names, at.cast("long").alias("_b"))
    i = F.col("_i")
    reached = F.sequence(F.greatest(F.lit(0), F.floor((i - reach) / block)), F.floor((i + half) / block))
    parts = s.withColumn("_b", F.explode(reached))
    schema = "".join(f"`{c}` {frames.schema[c].dataType.simpleString()}, " for c in names) + "offset long, v double"

    def run(x, f):
        x = x.sort_values("_i")
        smooth = np.convolve(np.pad(x["_v"].to_numpy(), (half, len(weights) - 1 - half)), weights[::-1], mode="valid") if len(x) else np.zeros(0)
        first = np.searchsorted(x["_t"].to_numpy(), f["_c"].to_numpy(), side="left")
        if (first + samples_per_frame > len(smooth)).any():
            raise ValueError("samples do not cover a complete frame")
        out = f[names].loc[f.index.repeat(samples_per_frame)].reset_index(drop=True)
        out["offset"] = np.tile(np.arange(samples_per_frame), len(f))
        out["v"] = smooth[(first[:, None] + np.arange(samples_per_frame)[None, :]).ravel()] if len(f) else np.zeros(0)
        return out

    return parts.groupBy("_b").cogroup(f.groupBy("_b")).applyInPandas(run, schema).withColumn("v", F.when(~F.isnan("v"), F.col("v")))


def numbered_clock(clock: DataFrame, t: str = "t_s") -> DataFrame:
    """_c, frame: the times of a frame clock with their numbers, written once."""
    return written(number_all(clock.select(F.col(t).alias("_c")), "_c", "frame"), "clock")


def counted_frames(clock: DataFrame, n: int, planes: int) -> DataFrame:
    """_c, plane, cycle of the frames that a mean cycle is made of: not the first cycle nor the last frame."""
    c = clock.filter((F.col("frame") >= planes) & (F.col("frame") < n - 1))
    return c.select("_c", (F.col("frame") % planes).alias("plane"), F.expr(f"frame div {planes}").alias("cycle"))


def mean_cycle(paths: DataFrame, volts_per_micron: float) -> DataFrame:
    """plane, offset, depth_um: the mean path of each plane, from the lowest point of all."""
    m = paths.groupBy("plane", "offset").agg((F.avg("v") / volts_per_micron).alias("depth_um"))
    return m.withColumn("depth_um", F.col("depth_um") - F.min("depth_um").over(Window.partitionBy()))  # planes x offsets


def piezo_cycle(samples: DataFrame, clock: DataFrame, planes: int, samples_per_frame: int, smooth_width: int, volts_per_micron: float, t: str = "t_s", value: str = "volts", block: int = 1 << 18) -> DataFrame:
    """plane, offset, depth_um: the scanner's mean path during each plane's frames, from its lowest point; strided to some 1000 cycles of long recordings."""
    c = numbered_clock(clock, t)
    n = c.count()
    stride = max(1, round(n / planes / 1000))
    frames = counted_frames(c, n, planes).filter((F.col("cycle") - 1) % stride == 0)
    return mean_cycle(scanner_paths(samples, frames, samples_per_frame, smooth_width, t, value, block), volts_per_micron)


def depth_errors(samples: DataFrame, clock: DataFrame, estimates: DataFrame, planes: int, samples_per_frame: int, smooth_width: int, volts_per_micron: float, spacing: float, end: float = 180.0, t: str = "t_s", value: str = "volts", block: int = 1 << 18) -> DataFrame:
    """plane, rmse, n, shared_offset: estimated depths against where the scanner was, in micrometres, by plane and (plane missing) over all.

    estimates: plane, cycle (from 0), z in slices, ``spacing`` micrometres apart. The mean cycle is that of all frames but the first cycle's and the last
    one, however long the recording; samples that do not cover one of them fail the query. A cycle's drift is the median of what its frames' samples differ from
    the mean cycle, about the median of all cycles; it lies at the middle of the cycle and runs on lines in between, and is not known before
    the first or after the last. Up to ``end`` seconds, one offset that all planes share (the median of their median differences) is taken off the estimates.
    A plane without a complete pair fails the query. The first cycle has no drift of its own.
    """
    c = numbered_clock(clock, t)
    n = c.count()
    paths = written(scanner_paths(samples, counted_frames(c, n, planes), samples_per_frame, smooth_width, t, value, block), "paths")
    template = written(mean_cycle(paths, volts_per_micron), "template")
    last = (n - planes - 1) // planes  # cycles 1 .. last have all their frames and one after them
    cycle = F.expr(f"frame div {planes}")
    # Planes x offsets rows.
    apart = paths.filter(F.col("cycle") <= last).join(F.broadcast(template), ["plane", "offset"]).withColumn("_r", F.col("v") / volts_per_micron - F.col("depth_um"))
    drift = apart.groupBy("cycle").agg(F.percentile("_r", 0.5).alias("drift"))
    starts = c.filter(F.col("frame") % planes == 0).select(cycle.alias("cycle"), F.col("_c").alias("at"))
    following = starts.select((F.col("cycle") - 1).alias("cycle"), F.col("at").alias("_next"))
    middle = drift.join(starts, "cycle").join(following, "cycle").select("cycle", ((F.col("at") + F.col("_next")) / 2).alias("x"), "drift")
    middle = written(middle, "drift")
    centre = middle.agg(F.percentile("drift", 0.5).alias("_m"))
    # A cycle starts between the middles of the one before and its own.
    knots = middle.crossJoin(F.broadcast(centre)).select("cycle", "x", (F.col("drift") - F.col("_m")).alias("y"))
    series = knots.select("x", "y", F.lit(None).cast("long").alias("cycle")).unionByName(starts.select(F.col("at").alias("x"), F.lit(None).cast("double").alias("y"), "cycle"))
    moved = between(series, "x", "y", block).filter("cycle IS NOT NULL").select("cycle", F.col("x").alias("at"), F.col("y").alias("drift"))
    nominal = template.groupBy("plane").agg(F.percentile("depth_um", 0.5).alias("nominal"))
    e = estimates.join(F.broadcast(nominal), "plane").join(moved, "cycle").filter(F.col("at").between(0, end))
    e = written(e.select("plane", "z", ((F.col("nominal") + F.col("drift")) / spacing).alias("expected")), "depth-pairs")
    per = e.groupBy("plane").agg(F.percentile(F.col("z") - F.col("expected"), 0.5).alias("_m"))
    fault = F.raise_error(F.concat(F.lit("no complete pair of depths in plane "), F.col("plane").cast("string"))).cast("double")
    shared = per.withColumn("_m", F.coalesce("_m", fault)).agg(F.percentile("_m", 0.5).alias("shared_offset"))
    d = e.crossJoin(F.broadcast(shared)).withColumn("_e", (F.col("z") - F.col("expected") - F.col("shared_offset")) * spacing)
    return d.rollup("plane").agg(F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"), F.count("_e").alias("n"), F.first("shared_offset").alias("shared_offset"))


def between(df: DataFrame, x: str, y: str, block: int) -> DataFrame:
    """df with missing y on the lines between the known ones; missing before the first and after the last.

    The rows are numbered in order and cut into blocks; what a block does not know of its neighbours are the last known row before it and the
    first after it, found among one row for each block.
    """
    d = number_all(df, x, "_i").withColumn("_b", F.expr(f"_i div {block}"))
    known = F.when(F.col(y).isNotNull(), F.struct(F.col(x).alias("x"), F.col(y).alias("y")))
    # Spark works a frame that ends at the last row out anew for each row: what follows is what comes before in the reversed order.
    upto = lambda order: Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({"_p": F.last(known, True).over(upto(F.asc("_i"))), "_q": F.last(known, True).over(upto(F.desc("_i")))})
    d = written(d, "between")
    beyond = lambda order: Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    edges = d.groupBy("_b").agg(F.max(F.struct("_i", "_p"))["_p"].alias("_p"), F.min(F.struct("_i", "_q"))["_q"].alias("_q"))
    edges = edges.select("_b", F.last("_p", True).over(beyond(F.asc("_b"))).alias("_before"), F.last("_q", True).over(beyond(F.desc("_b"))).alias("_after"))
    d = d.join(F.broadcast(edges), "_b").withColumns({"_p": F.coalesce("_p", "_before"), "_q": F.coalesce("_q", "_after")})
    line = F.col("_p.y") + (F.col("_q.y") - F.col("_p.y")) * F.try_divide(F.col(x) - F.col("_p.x"), F.col("_q.x") - F.col("_p.x"))
    return d.withColumn(y, F.coalesce(y, line)).drop("_i", "_b", "_p", "_q", "_before", "_after")


def frame_rate(clock: DataFrame, keys: Sequence[str], t: str = "t_s") -> DataFrame:
    """One over the median step of each clock."""
    return median_interval(clock, keys, t).withColumn("rate", F.try_divide(F.lit(1.0), F.col("dt")))
