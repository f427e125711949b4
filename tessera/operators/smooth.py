"""Smoothing along an ordered series: rolling percentiles and kernels with their edge rules.

Kernels of a few tens of weights are window expressions (one sort for each series) or a join with the
weights; the long ones, whose width follows the frame rate, run as convolutions on grouped series.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import gaussian, hanning
from .sequence import number, ordered


def rolling_percentile(df: DataFrame, keys: Sequence[str], order: str, value: str, width: int, p: float, out: str) -> DataFrame:
    """Exact centred rolling percentile, cut at the ends; missing values are skipped."""
    w = ordered(keys, order).rowsBetween(-(width // 2), (width - 1) // 2)
    return df.withColumn(out, F.percentile(value, p).over(w))


def _neighbour(value: Column, j: int, w, edge: str) -> Column:
    """The value j rows on; beyond an end the end's value, zero, or missing."""
    got = (F.lag if j < 0 else F.lead)(value, abs(j)).over(w)
    there = (F.lag if j < 0 else F.lead)(F.lit(True), abs(j)).over(w)
    if edge == "nearest":
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return F.when(there, got).otherwise((F.first if j < 0 else F.last)(value).over(whole))
    return F.when(there, got).otherwise(F.lit(0.0) if edge == "zero" else F.lit(None))


def convolve(df: DataFrame, keys: Sequence[str], order: str, value: str, weights: Sequence[float], out: str, edge: str = "nearest", skip_missing: bool = False) -> DataFrame:
    """Weighted sum of the neighbours. A missing neighbour makes the sum missing, or is left out and the weights renormalised."""
    w, half = ordered(keys, order), len(weights) // 2
    x = F.col(value)
    parts = [(k, x if j == 0 else _neighbour(x, j, w, edge)) for k, j in zip(weights, range(-half, len(weights) - half))]
    names = [f"_k{i}" for i in range(len(parts))]
    d = df.select("*", *[v.alias(n) for (_, v), n in zip(parts, names)])
    if skip_missing:
        num = sum((F.coalesce(F.col(n), F.lit(0.0)) * k for (k, _), n in zip(parts, names)), F.lit(0.0))
        den = sum((F.when(F.col(n).isNotNull(), F.lit(k)).otherwise(0.0) for (k, _), n in zip(parts, names)), F.lit(0.0))
        total = F.when(den > 0, num / den)
    else:
        total = sum((F.col(n) * k for (k, _), n in zip(parts, names)), F.lit(0.0))
    return d.withColumn(out, total).drop(*names)


def gaussian_nearest(df: DataFrame, keys: Sequence[str], order: str, value: str, sigma: float, out: str) -> DataFrame:
    return convolve(df, keys, order, value, gaussian(sigma), out)


def gaussian_skipping(df: DataFrame, keys: Sequence[str], order: str, value: str, sigma: float, out: str) -> DataFrame:
    """Gaussian of the values that are there, by their weights."""
    return convolve(df, keys, order, value, gaussian(sigma), out, edge="missing", skip_missing=True)


def hanning_low_pass(df: DataFrame, keys: Sequence[str], order: str, value: str, width: int, out: str) -> DataFrame:
    """Hanning average with zeros beyond the ends."""
    return convolve(df, keys, order, value, hanning(width), out, edge="zero")


def gaussian_reflect(df: DataFrame, keys: Sequence[str], order: str, value: str, sigma: float, out: str) -> DataFrame:
    """Gaussian with the series mirrored at its ends (the end value comes twice), however short it is.

    Mirrored places never lie further off than the kernel reaches, so each row's window of neighbours holds all it needs.
    """
    weights = gaussian(sigma)
    r = len(weights) // 2
    w = ordered(keys, order)
    near = F.collect_list(F.struct(F.col(value).cast("double").alias("v"))).over(w.rowsBetween(-r, r))  # structs, for missing values stay
    d = df.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(*keys)).cast("int"), "_near": near})

    def tap(j: int, k: float) -> Column:
        m = F.pmod(F.col("_i") + j, 2 * F.col("_n"))
        at = F.when(m < F.col("_n"), m).otherwise(2 * F.col("_n") - 1 - m)
        return F.get("_near", at - F.greatest(F.lit(0), F.col("_i") - r))["v"] * k

    total = sum((tap(j, k) for j, k in zip(range(-r, r + 1), weights)), F.lit(0.0))
    return d.withColumn(out, total).drop("_i", "_n", "_near")


def hanning_skipping(df: DataFrame, keys: Sequence[str], order: str, value: str, width: int, out: str) -> DataFrame:
    """Hanning average of the values that are there. Even widths grow by one; a width under 3 changes nothing."""
    if width < 3:
        return df.withColumn(out, F.col(value))
    return convolve(df, keys, order, value, hanning(width + 1 - width % 2), out, edge="missing", skip_missing=True)


def _centred_percentile(x: np.ndarray, width: int, p: float) -> np.ndarray:
    import pandas as pd

    return pd.Series(x).rolling(width, center=True, min_periods=1).quantile(p).to_numpy()


def baselines(df: DataFrame, keys: Sequence[str], order: str, values: Mapping[str, str], rate: float, percentile: float, window_s: float, block: int = 1 << 16) -> DataFrame:
    """Baselines of several columns (out -> value): a rolling percentile over half the window, then a Gaussian whose deviation is the window.

    The window has rate * window_s frames, rounded half to even; the percentile half of that. A series is worked out in
    blocks of rows that overlap by the reach of both filters, so a task holds some blocks and never a whole series.
    """
    w = round(rate * window_s)
    h = round(w / 2)
    if h <= 0:
        raise ValueError("the window has no frames")
    weights = np.array(gaussian(w))
    r = len(weights) // 2
    halo = r + h
    block = max(block, 2 * halo)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + "".join(f", `{out}` double" for out in values)
    columns = [*df.columns, *values]

    def run(pdf):
        pdf = pdf.sort_values("_i")
        for out, value in values.items():
            q = _centred_percentile(pdf[value].to_numpy(dtype=float), h, percentile / 100)
            # Rows beyond the group exist only inside the overlap, where nothing is kept, or not at all: the ends' values serve for both.
            pdf[out] = np.convolve(np.concatenate((np.full(r, q[0]), q, np.full(r, q[-1]))), weights, mode="valid")
        return pdf.loc[pdf["_i"] // block == pdf["_b"], columns]

    i = F.col("_i")
    reached = F.sequence(F.greatest(F.lit(0), F.floor((i - halo) / block)).cast("long"), F.floor((i + halo) / block).cast("long"))
    parts = number(df, keys, [order], "_i").withColumn("_b", F.explode(reached))
    done = parts.groupBy(*keys, "_b").applyInPandas(run, schema)
    return done.withColumns({out: F.when(~F.isnan(out), F.col(out)) for out in values})


def baseline(df: DataFrame, keys: Sequence[str], order: str, value: str, rate: float, percentile: float, window_s: float, out: str = "f0") -> DataFrame:
    """F0 of one column; see ``baselines``. keys name a series' segment."""
    return baselines(df, keys, order, {out: value}, rate, percentile, window_s)
