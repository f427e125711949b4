"""Traces of regions of interest: masking, background regression, axial correction, dF/F."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.missing import floor_one
from ..sources.shared import written
from .sequence import ordered
from .smooth import baselines, gaussian_reflect


def mask_bad(df: DataFrame, value: str, bad: Column) -> DataFrame:
    """Values of bad frames are missing; the rows stay."""
    return df.withColumn(value, F.when(~F.coalesce(bad, F.lit(False)), F.col(value)))


def subtract_dark(df: DataFrame, dark: float, *values: str) -> DataFrame:
    return df.withColumns({v: F.col(v) - dark for v in values})


def bin_regression(df: DataFrame, keys: Sequence[str], f: str, n: str, bins: int = 20, low: float = 0.1, high: float = 0.9, f_percentile: float = 0.05) -> DataFrame:
    """keys, intercept, slope: the line through a low percentile of f in equal bins of n, at the bins' left edges.

    The slope is clipped to [0, 2] afterwards and the intercept kept; fewer than two bins give missing values. The trace is read once and
    dealt out by its keys once: limits, bins and lines are worked out where a key's rows are.
    """
    q = F.percentile(n, F.array(F.lit(low), F.lit(high))).over(Window.partitionBy(*keys))
    d = df.select(*keys, F.col(f).alias("_f"), F.col(n).alias("_n"), q.alias("_q"))
    d = d.select(*keys, "_f", "_n", F.get("_q", F.lit(0)).alias("_lo"), ((F.get("_q", F.lit(1)) - F.get("_q", F.lit(0))) / bins).alias("_bs"))
    b = F.floor(F.try_divide(F.col("_n") - F.col("_lo"), F.col("_bs")))
    d = d.withColumn("_b", F.when((F.col("_bs") > 0) & b.between(0, bins - 1), b))
    y = d.groupBy(*keys, "_b", "_lo", "_bs").agg(F.percentile("_f", f_percentile).alias("_y"))
    y = y.withColumn("_y", F.when(F.col("_b").isNotNull(), F.col("_y")))
    x = F.when(F.col("_y").isNotNull(), F.col("_lo") + F.col("_b") * F.col("_bs"))
    fit = y.withColumn("_x", x).groupBy(*keys).agg(F.regr_intercept("_y", "_x").alias("intercept"), F.regr_slope("_y", "_x").alias("slope"), F.count("_y").alias("_n"))
    slope = F.greatest(F.lit(0.0), F.least(F.lit(2.0), F.col("slope")))
    return fit.select(*keys, F.when(F.col("_n") > 1, F.col("intercept")).alias("intercept"), F.when((F.col("_n") > 1) & F.col("slope").isNotNull(), slope).alias("slope"))


def subtract_background(df: DataFrame, fit: DataFrame, keys: Sequence[str], f: str = "f", n: str = "fneu", f0: str = "f0", n0: str = "n0", out: str = "fc") -> DataFrame:
    """f without the part that the line predicts from n, both about their baselines."""
    d = df.join(fit, list(keys), "left")
    return d.withColumn(out, F.col(f) - (F.col("slope") * (F.col(n) - F.col(n0)) + F.col("intercept")))


def dff(df: DataFrame, fc: str = "fc", f0: str = "f0", out: str = "dff") -> DataFrame:
    """(F - F0) / max(1, F0)."""
    return df.withColumn(out, (F.col(fc) - F.col(f0)) / floor_one(F.col(f0)))


def profile_factors(profile: DataFrame, keys: Sequence[str], z: str, value: str, reference: int, least: float | None = 0.5) -> DataFrame:
    """Profile over its value at the reference depth; missing below ``least``."""
    ref = F.max(F.when(F.col(z) == reference, F.col(value))).over(Window.partitionBy(*keys))
    d = profile.withColumn("factor", F.try_divide(F.col(value), ref))
    return d.withColumn("factor", F.when(F.col("factor") >= least, F.col("factor"))) if least is not None else d


def correct_zmotion(df: DataFrame, factors: DataFrame, keys: Sequence[str], segment: str, order: str, z: str, values: Sequence[str], sigma: float = 2.0) -> DataFrame:
    """Values over the factor at each frame's depth, smoothed within the runs of frames whose depth is known.

    A cell's factors travel as one map (as many entries as slices), so traces are dealt out by the cell and stay there: runs and smoothing
    are windows of that one partitioning, and no frame is joined to itself.
    """
    known = factors.filter(F.col(z).isNotNull()).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col(z), "factor"))).alias("_factors"))
    d = df.join(known, list(keys), "left").withColumn("factor", F.try_element_at("_factors", F.col(z))).drop("_factors")
    w = ordered([*keys, segment], order)
    there = F.col(z).isNotNull()
    d = d.withColumn("_there", there).withColumn("_turn", (F.col("_there") != F.coalesce(F.lag("_there").over(w), F.lit(False))).cast("long"))
    d = d.withColumn("_run", F.sum("_turn").over(w))
    d = gaussian_reflect(d, [*keys, segment, "_run"], order, "factor", sigma, "smoothed").withColumn("smoothed", F.when(F.col("_there"), F.col("smoothed")))
    return d.drop("_there", "_turn", "_run").withColumns({v: F.try_divide(F.col(v), F.col("smoothed")) for v in values})


def _peaks(x: np.ndarray, distance: int, width: float, reach: int) -> list[int]:
    """Local maxima (middles of plateaus) that are ``distance`` apart, the higher first, and as wide at half their prominence."""
    n, found = len(x), []
    i = 1
    while i < n - 1:
        if x[i - 1] < x[i]:
            j = i
            while j + 1 < n and x[j + 1] == x[i]:
                j += 1
            if j + 1 < n and x[j + 1] < x[i]:
                found.append((i + j) // 2)
            i = j + 1
        else:
            i += 1
    keep = dict.fromkeys(found, True)
    for p in sorted(found, key=lambda p: (x[p], p), reverse=True):
        if keep[p]:
            keep |= {q: False for q in found if q != p and abs(q - p) < distance}
    out = []
    for p in (p for p in found if keep[p]):
        sides = []
        for step in (-1, 1):
            i, low = p, x[p]
            while 0 <= i + step < n and abs(i + step - p) <= reach and x[i + step] <= x[p]:
                i += step
                low = min(low, x[i])
            sides.append((low, i))
        height = x[p] - (x[p] - max(sides[0][0], sides[1][0])) * 0.5
        cross = []
        for step, (_, end) in zip((-1, 1), sides):
            i = p
            while i != end and x[i] > height:
                i += step
            at = float(i)
            if x[i] < height:
                at -= step * (height - x[i]) / (x[i - step] - x[i])
            cross.append(at)
        if cross[1] - cross[0] >= width:
            out.append(p)
    return out


def fault_limits(x: np.ndarray, reference: int) -> tuple[int, int]:
    """The slices (first, last) of a profile that belong to the cell at the reference; others belong to a neighbour."""
    peaks = _peaks(x, distance=7, width=2, reach=15)
    last = len(x) - 1
    if not peaks:
        return 0, last
    # The lowest slice before, between and after the peaks: a cell lies between two of these that follow each other.
    ends = [0, *peaks, last]
    troughs = [a + int(np.argmin(x[a : b + 1])) for a, b in zip(ends, ends[1:])]
    k = sum(p <= reference for p in peaks)
    if troughs[k] < reference:
        return troughs[k], troughs[k + 1] if k < len(peaks) else last
    return (troughs[k - 1] if k else 0) + 1, troughs[k]


def mask_faults(profile: DataFrame, keys: Sequence[str], z: str, value: str, reference: int) -> DataFrame:
    """Profile values outside the reference cell's peak are missing. A group is one cell's profile: as many rows as slices."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in profile.schema.fields)

    def run(pdf):
        pdf = pdf.sort_values(z).reset_index(drop=True)
        first, last = fault_limits(pdf[value].to_numpy(dtype=float), reference)
        pdf.loc[(pdf.index < first) | (pdf.index > last), value] = np.nan
        return pdf

    d = profile.groupBy(*keys).applyInPandas(run, schema)
    return d.withColumn(value, F.when(~F.isnan(value), F.col(value)))


def correct_traces(df: DataFrame, profile: DataFrame, keys: Sequence[str], segment: str, order: str, z: str, depth: str, reference: int, rate: float, percentile: float, window_s: float, faults: bool = True) -> DataFrame:
    """dF/F of f and fneu after the axial correction: the whole way from the depth of each frame to the corrected trace.

    profile: keys, depth, value. With ``faults`` the slices of neighbouring cells and factors under 0.5 correct nothing.
    Adds f0, n0, fc and dff; a frame without a depth or without a factor has no value.
    """
    factors = profile_factors(profile, keys, depth, "value", reference, least=None)
    if faults:
        factors = mask_faults(factors, keys, depth, "factor", reference)
        factors = factors.withColumn("factor", F.when(F.col("factor") >= 0.5, F.col("factor")))
    factors = factors.withColumnRenamed(depth, z) if depth != z else factors
    d = correct_zmotion(df, factors, keys, segment, order, z, ["f", "fneu"])
    d = baselines(d, [*keys, segment], order, {"f0": "f", "n0": "fneu"}, rate, percentile, window_s)
    d = about_baselines(d)
    return dff(subtract_background(d, bin_regression(d, keys, "cf", "cn"), keys)).drop("cf", "cn", "slope", "intercept")


def about_baselines(df: DataFrame) -> DataFrame:
    """Rows with cf and cn, f and fneu about their baselines, written once: the line is fitted to them and then taken off them."""
    return written(df.withColumns({"cf": F.col("f") - F.col("f0"), "cn": F.col("fneu") - F.col("n0")}), "baselines")
