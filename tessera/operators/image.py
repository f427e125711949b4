"""Images as rows of pixels (or arrays): sums over masks, correlation, similar frames, reslicing, registration."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import phase
from ..functions.missing import pearson
from ..functions.phase import Shape


def pixels(df: DataFrame, px: str, index: str = "i", value: str = "v") -> DataFrame:
    """One row for each pixel of an array column."""
    return df.select(*[c for c in df.columns if c != px], F.posexplode(px).alias(index, value))


def dark_level(df: DataFrame, keys: Sequence[str], px: str, p: float) -> DataFrame:
    """A percentile of all pixels of a key's frames."""
    return pixels(df, px).groupBy(*keys).agg(F.percentile(F.col("v").cast("double"), p).alias("dark"))


def first_frames(df: DataFrame, keys: Sequence[str], frame: str, n: int) -> DataFrame:
    """The first n frames of each key, by number."""
    w = Window.partitionBy(*keys).orderBy(frame)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def dataset_dark_level(datasets: DataFrame, frames: DataFrame, dataset: str, plane: str, frame: str, px: str, p: float = 0.01, n: int = 200) -> DataFrame:
    """The least dark level of a data set's planes, each from its first n frames; missing where there is no plane."""
    per_plane = dark_level(first_frames(frames, [dataset, plane], frame, n), [dataset, plane], px, p)
    return datasets.join(per_plane.groupBy(dataset).agg(F.min("dark").alias("dark")), dataset, "left")


def mask_sum(px: DataFrame, mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weighted sum of a frame's pixels over each mask (mask: roi, i, w)."""
    return px.join(mask, "i").groupBy(*keys, "roi").agg(F.sum(F.col("w") * F.col("v")).alias("f"))


def image_correlation(a: DataFrame, b: DataFrame, keys: Sequence[str], index: str = "i", value: str = "v") -> DataFrame:
    """Correlation of two images pixel by pixel."""
    j = a.select(*keys, index, F.col(value).cast("double").alias("_a")).join(b.select(index, F.col(value).cast("double").alias("_b")), index)
    return j.groupBy(*keys).agg(pearson("_a", "_b").alias("r"))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of one length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def let(x: Column, f) -> Column:
    """f of x, which is worked out once and not again for each element of an array."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def unit(px: str) -> Column:
    """An array about its mean, scaled to length one, so that inner products are correlations."""
    x = F.transform(px, lambda v: v.cast("double"))
    mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(px)
    centred = let(mean, lambda m: F.transform(x, lambda v: v - m))
    length = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, w: s + w * w))
    return let(centred, lambda c: let(length(c), lambda n: F.transform(c, lambda v: F.try_divide(v, n))))


def most_similar(df: DataFrame, keys: Sequence[str], id_: str, px: str, seed: DataFrame, n: int) -> DataFrame:
    """The n frames of each key that correlate most with the key's seed frame (seed: keys, px)."""
    s = seed.select(*keys, unit(px).alias("_s"))
    d = df.join(s, list(keys)).select(*keys, id_, dot(unit(px), F.col("_s")).alias("corr"))
    w = Window.partitionBy(*keys).orderBy(F.desc("corr"), id_)
    return d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def reslice_offsets(piezo: Sequence[float], rows: int, spacing: float) -> list[float]:
    """Offset in slices of each image row from the middle one, by linear interpolation of the piezo's path."""
    p = (np.asarray(piezo, dtype=float) - min(piezo)) / spacing
    off = np.interp(np.linspace(0, len(p) - 1, rows), np.arange(len(p)), p)
    return (off - off[rows // 2]).tolist()


def reslice(grid: DataFrame, offsets: DataFrame, depth: int, z: str = "z", y: str = "y", px: str = "v") -> DataFrame:
    """Rows of a stack (z, y, ...) taken from the slice that a slanted scan saw: nearest, clipped, half-way down."""
    src = F.ceil(F.greatest(F.lit(0.0), F.least(F.lit(depth - 1.0), F.col(z) + F.col("off"))) - 0.5)
    want = grid.select(z, y).distinct().join(offsets, y).select(z, y, src.cast("int").alias("_z"))
    have = grid.withColumnRenamed(z, "_z")
    return want.join(have, ["_z", y]).drop("_z")


def register(frames: DataFrame, references: DataFrame, shape: Shape, px: str = "px", limit: int | None = None) -> DataFrame:
    """frame columns, ref, dy, dx, peak: every frame against every reference image.

    The references are one image for each slice or plane, as a stack; their spectra are worked out once and meet the frames by a
    broadcast that is bounded by REFERENCE_PIXELS. A batch of frames is transformed at once.
    """
    n = references.count()
    if n * shape[0] * shape[1] > REFERENCE_PIXELS:
        raise ValueError("too many reference pixels to broadcast: register against a part of the stack at a time")
    stack = {r["ref"]: np.array(r[px], dtype=float).reshape(shape) for r in references.collect()}
    refs = pa.array(list(stack), type=pa.int32())
    shared = frames.sparkSession.sparkContext.broadcast(phase.conjugate_spectra(np.stack(list(stack.values()))) if stack else np.zeros((0, *shape)))
    keep = [c for c in frames.columns if c != px]
    schema = "".join(f"`{c}` {frames.schema[c].dataType.simpleString()}, " for c in keep) + "ref int, dy int, dx int, peak double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = phase.phase_shifts(phase.images(b.column(px), shape), shared.value, limit)
            rows = b.take(pa.array(np.repeat(np.arange(b.num_rows), len(refs))))
            every = refs.take(pa.array(np.tile(np.arange(len(refs)), b.num_rows)))
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), every, *(pa.array(v.ravel()) for v in found)], names=[*keep, "ref", "dy", "dx", "peak"])

    return frames.mapInArrow(run, schema)


#: Pixels of all reference images together that may be broadcast.
REFERENCE_PIXELS = 1 << 24
