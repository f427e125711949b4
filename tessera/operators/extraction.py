"""Traces of masks from movies, and what is made of them in one piece: control traces, profiles over planes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.phase import Shape, images
from ..sources.shared import written
from . import trace
from .composite import effective_depth, relative_profile
from .profiles import depth_profile
from .registration import shifted
from .smooth import baselines

#: Pixels of all masks together that may be broadcast.
MASK_PIXELS = 1 << 22


def extract(frames: DataFrame, masks: DataFrame, shape: Shape, px: str = "px") -> DataFrame:
    """Frame columns, roi, f, fneu: for each frame and mask the weighted sum over the cell and the mean over its neuropil.

    masks: roi, neuropil (whether a pixel is of the neuropil), i, w. They are broadcast, which MASK_PIXELS bounds; frames are read where they
    are. A cell without neuropil pixels has no fneu.
    """
    n = masks.count()
    if n > MASK_PIXELS:
        raise ValueError(f"{n} pixels of masks: extract fewer cells at a time")
    cells: dict[int, tuple[list, list, list]] = {}
    for r in masks.select("roi", "neuropil", "i", "w").orderBy("roi", "neuropil", "i").collect():
        at, w, around = cells.setdefault(r.roi, ([], [], []))
        if r.neuropil:
            around.append(r.i)
        else:
            at.append(r.i)
            w.append(r.w)
    shared = frames.sparkSession.sparkContext.broadcast({k: (np.array(a, dtype=int), np.array(b, dtype=float), np.array(c, dtype=int)) for k, (a, b, c) in cells.items()})
    keep = [c for c in frames.columns if c != px]
    schema = "".join(f"`{c}` {frames.schema[c].dataType.simpleString()}, " for c in keep) + "roi long, f double, fneu double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = images(b.column(px), shape).reshape(b.num_rows, -1)
            head = [b.column(c) for c in keep]
            for roi, (at, w, around) in shared.value.items():
                f = pa.array(x[:, at] @ w)
                fneu = pa.array(x[:, around].mean(axis=1)) if len(around) else pa.nulls(len(x), pa.float64())
                yield pa.RecordBatch.from_arrays([*head, pa.array(np.full(len(x), roi, dtype="int64")), f, fneu], names=[*keep, "roi", "f", "fneu"])

    return frames.mapInArrow(run, schema)


def control_traces(frames: DataFrame, shifts: DataFrame, masks: DataFrame, accepted: DataFrame, keys: Sequence[str], segment: str, frame: str, bad: str, shape: Shape, dark: float, rate: float, percentile: float, window_s: float, px: str = "px") -> DataFrame:
    """keys, roi, segment, frame, f, fneu, f0, n0, fc, dff: a movie's traces under the masks of another, for the accepted cells.

    The movie is read through its final shifts (one for each frame, else an error); bad frames are missing, the dark level is taken off,
    and background and dF/F follow as for any trace, without axial correction.
    """
    wanted = masks.join(accepted.select("roi").distinct(), "roi", "left_semi")
    view = shifted(frames.select(*keys, segment, frame, bad, px), shifts, [*keys, segment, frame], shape, px)
    d = extract(view, wanted, shape, px)
    for c in ("f", "fneu"):
        d = trace.mask_bad(d, c, F.col(bad))
    cell = [*keys, "roi"]
    d = trace.subtract_dark(d.drop(bad), dark, "f", "fneu")
    d = trace.about_baselines(baselines(d, [*cell, segment], frame, {"f0": "f", "n0": "fneu"}, rate, percentile, window_s))
    d = trace.dff(trace.subtract_background(d, trace.bin_regression(d, cell, "cf", "cn"), cell))
    return d.select(*cell, segment, frame, "f", "fneu", "f0", "n0", "fc", "dff")


def plane_profiles(frames: DataFrame, masks: DataFrame, best: DataFrame, keys: Sequence[str], cycle: str, plane: str, shape: Shape, least: int = 1, px: str = "px") -> DataFrame:
    """keys, roi, depth, value, n, relative: the median of each cell over all planes by their distance from the cycle's best plane.

    All planes are extracted under the same masks (best: keys, cycle, best_plane). ``relative`` is the profile over its value at the best
    plane, missing where that is not positive.
    """
    d = extract(frames.select(*keys, cycle, plane, px), masks, shape, px)
    d = effective_depth(d, best, [*keys, cycle], plane)
    cell = [*keys, "roi"]
    return relative_profile(depth_profile(d, cell, "depth", "f", 0.5, least), cell)


def complete_profile(profile: DataFrame, keys: Sequence[str], depth: str, depths: DataFrame) -> DataFrame:
    """A profile with a row for every depth of every cell; depths that it lacks have missing values and a count of 0."""
    grid = profile.select(*keys).distinct().crossJoin(F.broadcast(depths.select(depth).distinct()))  # as many depths as slices
    d = grid.join(profile, [*keys, depth], "left")
    return d.withColumn("n", F.coalesce("n", F.lit(0))) if "n" in profile.columns else d


def bidirectional_offset(frames: DataFrame, keys: Sequence[str], shape: Shape, px: str = "px", most: int = 10) -> DataFrame:
    """keys, offset: by how many pixels odd rows lie right of even ones, from the mean phase correlation of neighbouring rows.

    Each task adds up the correlations of its frames; up to ``most`` pixels are looked at, ties go to the least.
    """
    h, w = shape
    reach = min(most, (w - 1) // 2)
    lags = np.arange(-reach, reach + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .registration import _by_key

        for b in batches:
            x = images(b.column(px), shape).astype(float)
            odd, even = np.fft.fft(x[:, 1::2], axis=2), np.fft.fft(x[:, : h - h % 2 : 2], axis=2)
            unit = lambda z: z / (np.abs(z) + 1e-5)
            c = np.fft.ifft(unit(odd) * np.conj(unit(even)), axis=2).real.mean(axis=1)[:, lags % w]
            for key, rows in _by_key(b, keys):
                yield pa.RecordBatch.from_arrays([*(pa.array([k], type=b.schema.field(n).type) for n, k in zip(keys, key)), pa.array([c[rows].sum(axis=0).tolist()])], names=[*keys, "_c"])

    head = "".join(f"`{k}` {frames.schema[k].dataType.simpleString()}, " for k in keys)
    sums = frames.mapInArrow(run, head + "_c array<double>").select(*keys, F.posexplode("_c").alias("_k", "_v"))
    sums = sums.groupBy(*keys, "_k").agg(F.sum("_v").alias("_v")).withColumn("offset", F.col("_k") - reach)
    first = Window.partitionBy(*keys).orderBy(F.desc("_v"), F.abs("offset"), "offset")
    return sums.withColumn("_r", F.row_number().over(first)).filter("_r = 1").select(*keys, F.col("offset").cast("int"))


def rows_shifted_back(frames: DataFrame, offsets: DataFrame, keys: Sequence[str], shape: Shape, px: str = "px") -> DataFrame:
    """Frames with odd rows moved back by their key's offset; pixels beyond the edge keep what is there. Nothing leaves the JVM."""
    h, w = shape
    k = F.col("_offset")

    def row(r):
        own = F.slice(px, r * w + 1, F.lit(w))
        left = F.concat(F.slice(own, k + 1, w - k), F.slice(own, w - k + 1, k))
        right = F.concat(F.slice(own, F.lit(1), -k), F.slice(own, F.lit(1), w + k))
        return F.when((r % 2 == 0) | (k == 0), own).when(k > 0, left).otherwise(right)

    d = frames.join(F.broadcast(offsets.select(*keys, F.col("offset").alias("_offset"))), list(keys), "left") if keys else frames.crossJoin(F.broadcast(offsets.select(F.col("offset").alias("_offset"))))
    d = d.withColumn("_offset", F.coalesce("_offset", F.lit(0)))
    moved = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(h - 1)), row))
    return d.withColumn(px, F.when(k == 0, F.col(px)).otherwise(moved)).drop("_offset")


def plane_reference(frames: DataFrame, keys: Sequence[str], frame: str, bad: str, shape: Shape, count: int, px: str = "px", n_best: int = 20) -> tuple[DataFrame, DataFrame]:
    """(references, offsets): each plane's reference from the ``count`` usable frames about its middle, rows set right first."""
    from .registration import iterated_reference
    from .tables import central_frames

    # Read again in every round: ``count`` frames a key, and one number.
    middle = written(central_frames(frames.select(*keys, frame, bad, px), keys, frame, bad, count), "central-frames")
    offsets = written(bidirectional_offset(middle, keys, shape, px), "row-offsets")
    return iterated_reference(rows_shifted_back(middle, offsets, keys, shape, px), keys, frame, shape, px, n_best), offsets
