"""Registration of images: references found by iteration, rolls and warps, stacks aligned slice to slice and to a movie.

An image is an array column of height x width numbers, row by row. Frames stay distributed: each pass is narrow and meets the
references, one image for each key, through a broadcast whose size is checked (REFERENCE_PIXELS). What leaves a pass is small:
shifts and correlations by frame, or one sum of images for each task and key.

A frame that is moved by (dy, dx) against its reference is rolled back by (-dy, -dx), round the edges. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import phase
from ..functions.kernels import savitzky_golay
from ..functions.phase import Shape, images
from ..sources.shared import written
from .image import REFERENCE_PIXELS, let, most_similar, unit

#: Rounds of the iterated reference; round i takes max(2, n (1 + i) / 16) of n frames.
ROUNDS, SHARE = 8, 16
#: Frames whose shifts may be broadcast to their images.
SMALL = 1 << 18
#: Pixels of a key whose frames one group compares with each other, the groups of such a key, pixels of a block of a larger key, and correlations held at once.
WHOLE_PIXELS, PARTS, BLOCK_PIXELS, CHUNK = 1 << 22, 4, 1 << 20, 1 << 21

def _array(x: np.ndarray) -> pa.Array:
    x = x.reshape(len(x), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype="int32") * x.shape[1]), pa.array(x.ravel()))


def _ddl(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL else df


# Moving images


def roll(px: str, dy: Column, dx: Column, shape: Shape) -> Column:
    """The image moved back by (dy, dx) round its edges, as slices of the array: nothing leaves the JVM."""
    h, w = shape
    k, j = F.pmod(dy, F.lit(h)).cast("int"), F.pmod(dx, F.lit(w)).cast("int")
    rows = F.concat(F.slice(px, k * w + 1, F.lit(h * w)), F.slice(px, F.lit(1), k * w))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(h - 1)), lambda r: F.concat(F.slice(rows, r * w + j + 1, w - j), F.slice(rows, r * w + 1, j))))


def shifted(frames: DataFrame, shifts: DataFrame, keys: Sequence[str], shape: Shape, px: str = "px", dy: str = "dy", dx: str = "dx") -> DataFrame:
    """A view of the frames, each moved back by its own shift (shifts: keys, dy, dx); a frame without a shift is an error."""
    s = shifts.select(*keys, F.col(dy).alias("_dy"), F.col(dx).alias("_dx"))
    d = frames.join(s, list(keys), "left")
    known = lambda c: F.coalesce(F.col(c), F.raise_error(F.lit("a frame has no shift")).cast("long"))
    plain = (F.col("_dy") == 0) & (F.col("_dx") == 0)
    moved = F.when(plain, F.col(px)).otherwise(roll(px, known("_dy"), known("_dx"), shape))
    return d.select(*[moved.alias(px) if c == px else F.col(c) for c in frames.columns])


def _mapped(df: DataFrame, px: str, shape: Shape, f: Callable[[np.ndarray, pa.RecordBatch], np.ndarray]) -> DataFrame:
    """df with its images replaced by f of each batch of images."""
    names = df.columns
    schema = ", ".join(f"`{c}` " + ("array<double>" if c == px else df.schema[c].dataType.simpleString()) for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = _array(f(images(b.column(px), shape), b).astype(float))
            yield pa.RecordBatch.from_arrays([out if c == px else b.column(c) for c in names], names=names)

    return df.mapInArrow(run, schema)


def warp(frames: DataFrame, shape: Shape, centres: tuple[Sequence[int], Sequence[int]], px: str = "px", dy: str = "dys", dx: str = "dxs", whole: bool = True) -> DataFrame:
    """Frames read at each pixel plus the shift between its blocks' centres (dys, dxs: arrays, one shift for each block, row by row).

    Grids of one row or one column are like any other. ``whole`` cuts the result to integers.
    """
    rows, columns = [list(map(int, c)) for c in centres]

    def run(x: np.ndarray, b: pa.RecordBatch) -> np.ndarray:
        ys, xs = (images(b.column(c), (len(rows), len(columns))) for c in (dy, dx))
        out = np.stack([phase.warped(f, *phase.displacement(rows, columns, p, q, shape)) for f, p, q in zip(x, ys, xs)])
        return np.trunc(out) if whole else out

    return _mapped(frames, px, shape, run)


def block_centres(length: int, size: int) -> list[int]:
    """Centres of blocks of ``size`` that overlap by half, evenly spread over ``length``; one block if it does not fit twice."""
    size = min(size, length)
    n = 1 if size == length else int(np.ceil(1.5 * length / size))
    starts = np.linspace(0, length - size, n).astype(int)
    return [int(s) + size // 2 for s in starts]


# Shifts against references


def reference_images(references: DataFrame, keys: Sequence[str], shape: Shape, px: str = "px", n: int | None = None) -> dict[tuple, np.ndarray]:
    """The image of each key, for a broadcast that is bounded by REFERENCE_PIXELS. They are counted first, unless ``n`` says how many there are."""
    n = references.count() if n is None else n
    if n * shape[0] * shape[1] > REFERENCE_PIXELS:
        raise ValueError("too many reference pixels to broadcast: register fewer planes at a time")
    out = {tuple(r[k] for k in keys): np.array(r[px], dtype=float).reshape(shape) for r in references.select(*keys, px).collect()}
    if len(out) != n:
        raise ValueError("a key has more than one reference, or none")
    return out


def _by_key(b: pa.RecordBatch, keys: Sequence[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """Each key of a batch and the rows that have it."""
    at: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(*(b.column(k).to_pylist() for k in keys)) if keys else ((),) * b.num_rows):
        at.setdefault(key, []).append(i)
    for key, rows in at.items():
        yield key, np.array(rows)


def shifts_to(frames: DataFrame, references: DataFrame | dict[tuple, np.ndarray], keys: Sequence[str], id_: str, shape: Shape, px: str = "px", limit: int | None = None, start: tuple[str, str] | None = None) -> DataFrame:
    """keys, id, dy, dx, corr: each frame's shift against its key's reference. Frames of a key without a reference are left out.

    ``start`` names two columns by which a frame counts as already rolled back; dy and dx are what is left.
    """
    if isinstance(references, DataFrame):
        references = reference_images(references, keys, shape, px)
    shared = frames.sparkSession.sparkContext.broadcast({k: phase.conjugate_spectra(v[None]) for k, v in references.items()})
    names = [*keys, id_]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = images(b.column(px), shape)
            if start:
                x = phase.rolled_back(x, *(b.column(c).to_numpy() for c in start))
            for key, rows in _by_key(b, keys):
                if key in shared.value:
                    found = phase.phase_shifts(x[rows], shared.value[key], limit)
                    part = b.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *(pa.array(v[:, 0]) for v in found)], names=[*names, "dy", "dx", "corr"])

    return frames.mapInArrow(run, f"{_ddl(frames, names)}, dy int, dx int, corr double")


def mean_image(frames: DataFrame, keys: Sequence[str], shape: Shape, px: str = "px", start: tuple[str, str] | None = None, centred: bool = False) -> DataFrame:
    """keys, px: the mean of each key's frames, pixel by pixel. Each task hands on one sum for each key.

    With ``start``, frames are rolled back by these two columns; ``centred`` ones are taken about their own mean.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for b in batches:
            x = images(b.column(px), shape).astype(float)
            if start:
                x = phase.rolled_back(x, *(b.column(c).to_numpy() for c in start))
            if centred:
                x = x - x.mean(axis=(1, 2), keepdims=True)
            for key, rows in _by_key(b, keys):
                old = held.setdefault(key, [0, 0.0])
                held[key] = [old[0] + len(rows), old[1] + x[rows].sum(axis=0)]
        if held:
            columns = [pa.array(c, type=b.schema.field(k).type) for k, c in zip(keys, zip(*held))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([n for n, _ in held.values()]), _array(np.stack([s for _, s in held.values()]))], names=[*keys, "_n", "_sum"])

    sums = frames.mapInArrow(run, (_ddl(frames, keys) + ", " if keys else "") + "_n bigint, _sum array<double>")
    by_pixel = sums.select(*keys, "_n", F.posexplode("_sum").alias("_i", "_v")).groupBy(*keys, "_i").agg((F.sum("_v") / F.sum("_n")).alias("_v"))
    # As many rows as a reference image has pixels.
    return by_pixel.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_v"))), lambda p: p["_v"]).alias(px))


# References


def correlation_seeds(df: DataFrame, keys: Sequence[str], id_: str, px: str, n_best: int = 20, block: int | None = None) -> DataFrame:
    """keys, id, score: the frame of each key whose ``n_best`` - 1 best correlations with other frames are highest on average.

    A key of up to WHOLE_PIXELS is compared in at most PARTS groups, each with its share of the frames against all, and hands on one number a
    frame. Larger keys are compared in pairs of blocks of some ``block`` frames (512, or BLOCK_PIXELS), one pair to a group, and each frame hands on its
    best correlations of a block: no task holds all frames of such a key. A constant frame correlates with nothing and is never taken.
    With ``block``, all keys are compared in pairs of such blocks.
    """
    most = max(2, n_best) - 1
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max(F.size(px)).cast("long").alias("_size"))
    d = df.select(*keys, id_, F.col(px).alias("_x"))
    d = d.join(F.broadcast(n), list(keys))  # one row for each key
    whole = F.lit(block is None) & (F.col("_n") * F.col("_size") <= WHOLE_PIXELS)
    frames = F.lit(block) if block else F.greatest(F.lit(512), F.expr(f"{BLOCK_PIXELS} div greatest(_size, 1)"))
    blocks = F.when(whole, F.least(F.lit(PARTS), F.ceil(F.col("_n") / 1024))).otherwise(F.ceil(F.col("_n") / frames)).cast("int")
    d = d.withColumn("_b", F.pmod(F.xxhash64(id_), blocks).cast("int"))
    pair = lambda b: F.struct(F.when(whole, b).otherwise(F.least("_b", b)).alias("bi"), F.when(whole, -1).otherwise(F.greatest("_b", b)).alias("bj"))
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), pair)
    d = d.select(*keys, id_, "_x", "_b", F.explode(pairs).alias("_p")).select(*keys, id_, "_x", "_b", F.col("_p.bi").alias("_bi"), F.col("_p.bj").alias("_bj"))

    def best(pdf):
        x = np.stack(pdf["_x"].to_numpy()).astype(float)
        x = x - x.mean(axis=1, keepdims=True)
        norm = np.linalg.norm(x, axis=1)
        x, some = x / np.where(norm > 0, norm, 1)[:, None], norm > 0
        own = pdf["_b"].to_numpy()
        bi, bj = pdf["_bi"].iloc[0], pdf["_bj"].iloc[0]
        out = [None] * len(pdf)
        if bj < 0:
            mine, others = np.flatnonzero(own == bi), np.flatnonzero(some)
            k, step = min(most, len(others) - 1), max(1, CHUNK // max(1, len(others)))
            for rows in (mine[lo : lo + step] for lo in range(0, len(mine), step)):
                c = x[rows] @ x[others].T
                c[rows[:, None] == others[None, :]] = -np.inf
                top = -np.sort(np.partition(-c, k - 1, axis=1)[:, :k], axis=1) if k > 0 else c[:, :0]
                for i, t in zip(rows, np.cumsum(top, axis=1)):
                    out[i] = [float(t[-1]) / k] if some[i] and k > 0 else []
            result = pdf.loc[own == bi, [*keys, id_]].copy()
            result["_some"], result["_top"] = some[mine], [out[i] for i in mine]
            return result
        sides = [(own == bi, own == bj)] if bi == bj else [(own == bi, own == bj), (own == bj, own == bi)]
        for a, b in sides:
            rows, others = np.flatnonzero(a), np.flatnonzero(b & some)
            c = x[rows] @ x[others].T
            c[rows[:, None] == others[None, :]] = -np.inf
            k = min(most, c.shape[1])
            top = -np.sort(-c, axis=1)[:, :k]
            for i, t in zip(rows, top):
                out[i] = t[np.isfinite(t)].tolist() if some[i] else []
        result = pdf[[*keys, id_]].copy()
        result["_some"], result["_top"] = some, out
        return result

    tops = d.groupBy(*keys, "_bi", "_bj").applyInPandas(best, f"{_ddl(df, [*keys, id_])}, _some boolean, _top array<double>")
    merged = tops.filter("_some").groupBy(*keys, id_).agg(F.slice(F.sort_array(F.flatten(F.collect_list("_top")), asc=False), 1, most).alias("_top"))
    mean = F.try_divide(F.aggregate("_top", F.lit(0.0), lambda s, v: s + v), F.size("_top"))
    first = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("score"), id_)
    return merged.select(*keys, id_, mean.alias("score")).withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")


def initial_reference(df: DataFrame, keys: Sequence[str], id_: str, px: str, shape: Shape, n_best: int = 20) -> DataFrame:
    """keys, px: mean of the centred frames nearest to the seed frame, the seed among them, cut to integers."""
    if not keys:
        return initial_reference(df.withColumn("_one", F.lit(1)), ["_one"], id_, px, shape, n_best).drop("_one")
    seeds = F.broadcast(correlation_seeds(df, keys, id_, px, n_best))  # one frame for each key
    seed = df.join(seeds.select(*keys, id_), [*keys, id_], "left_semi").select(*keys, px)
    usable = df.filter(F.array_max(px) > F.array_min(px))
    chosen = written(most_similar(usable, keys, id_, px, seed, n_best).select(*keys, id_), "initial-reference")
    mean = mean_image(df.join(_small(chosen, chosen.count()), [*keys, id_], "left_semi"), keys, shape, px, centred=True)
    return mean.withColumn(px, F.transform(px, lambda v: v.cast("int")))


def iterated_reference(df: DataFrame, keys: Sequence[str], id_: str, shape: Shape, px: str = "px", n_best: int = 20, limit: int | None = None, rounds: int = ROUNDS) -> DataFrame:
    """keys, px: each key's reference after rounds of registering all frames to it and averaging those that fit best.

    A round reads the frames twice: for their shifts against the broadcast references, and for the mean of the max(2, n (1 + round) / 16)
    that correlate best. The mean is moved by their mean shift of the round and cut to integers. What is carried from round to round is
    the sum of each frame's shifts, written to the shared folder, and one image a key.
    """
    spark = df.sparkSession
    frames = df.select(*keys, id_, px)
    references = reference_images(written(initial_reference(frames, keys, id_, px, shape, n_best), "initial-reference"), keys, shape, px)
    total = frames.count()
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    moved = None
    for round_ in range(rounds):
        state = frames.withColumns({"_sy": F.lit(0), "_sx": F.lit(0)}) if moved is None else frames.join(_small(moved.select(*keys, id_, "_sy", "_sx"), total), [*keys, id_])
        found = shifts_to(state, references, keys, id_, shape, px, limit, ("_sy", "_sx"))
        if moved is None:
            found = found.withColumns({"_sy": F.col("dy"), "_sx": F.col("dx")})
        else:
            found = found.join(_small(moved.select(*keys, id_, "_sy", "_sx"), total), [*keys, id_]).withColumns({"_sy": F.col("_sy") + F.col("dy"), "_sx": F.col("_sx") + F.col("dx")})
        best = Window.partitionBy(*keys).orderBy(F.desc("corr"), id_)
        take = F.greatest(F.lit(2), F.floor(n * (1 + round_) / SHARE))
        moved = written(found.withColumn("_in", F.row_number().over(best) <= take), f"reference-{round_}")
        chosen = moved.filter("_in")
        mean = mean_image(frames.join(_small(chosen.select(*keys, id_, "_sy", "_sx"), total), [*keys, id_]), keys, shape, px, ("_sy", "_sx"))
        means = reference_images(mean, keys, shape, px, len(references))
        centre = {tuple(r[k] for k in keys): (round(r.dy), round(r.dx)) for r in chosen.groupBy(*keys).agg(F.avg("dy").alias("dy"), F.avg("dx").alias("dx")).collect()}
        references = {k: np.trunc(np.roll(v, centre[k], axis=(0, 1))) for k, v in means.items()}
    rows = [(*k, v.astype(int).ravel().tolist()) for k, v in references.items()]
    return spark.createDataFrame(rows, (_ddl(df, keys) + ", " if keys else "") + f"`{px}` array<int>")


# Stacks


def register_repetitions(df: DataFrame, stack: Sequence[str], z: str, id_: str, shape: Shape, share: float = 0.5, repetitions: int | None = None, px: str = "px", other: str | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(means, shifts) of the repeated images of each slice: stack, z, px (and ``other``), and stack, z, id, dy, dx, corr.

    A slice's reference is iterated over its repetitions, starting from ``share`` of them; then all are registered to it and averaged. A
    second channel's images in column ``other`` take the same shifts. A slice with one image is an error.
    """
    keys = [*stack, z]
    if repetitions is None:
        few, repetitions = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n"), F.max("n")).first()
        if few is not None and few < 2:
            raise ValueError(f"a slice has {few} image; at least 2 are needed")
    frames = df.select(*keys, id_, px, *([other] if other else []))
    reference = iterated_reference(frames, keys, id_, shape, px, max(1, round((repetitions or 2) * share)), limit)
    shifts = written(shifts_to(frames, reference, keys, id_, shape, px, limit), "repetition-shifts")
    moved = frames.join(_small(shifts.select(*keys, id_, "dy", "dx"), shifts.count()), [*keys, id_])
    means = mean_image(moved, keys, shape, px, ("dy", "dx"))
    if other:
        means = means.join(mean_image(moved, keys, shape, other, ("dy", "dx")), keys)
    return means, shifts


def neighbour_shifts(stack: DataFrame, keys: Sequence[str], z: str, shape: Shape, px: str = "px", limit: int | None = None) -> DataFrame:
    """keys, z, dy, dx: the shift of each slice against the one before it, 0 for the first. Pairs are compared where they are joined."""
    before = stack.select(*keys, (F.col(z) + 1).alias(z), F.col(px).alias("_before"))
    pairs = stack.select(*keys, z, px).join(before, [*keys, z])
    names = [*keys, z]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = images(b.column(px), shape), phase.conjugate_spectra(images(b.column("_before"), shape))
            found = [phase.phase_shifts(x[i : i + 1], y[i : i + 1], limit) for i in range(len(x))]
            dy, dx = (np.array([f[k][0, 0] for f in found], dtype="int32") for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(dy), pa.array(dx)], names=[*names, "dy", "dx"])

    found = pairs.mapInArrow(run, f"{_ddl(stack, names)}, dy int, dx int")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return stack.select(*names).join(found, names, "left").select(*names, zero("dy"), zero("dx"))


def accumulated(shifts: DataFrame, keys: Sequence[str], z: str) -> DataFrame:
    """keys, z, dy, dx: running sums of the shifts between neighbours about their median, in whole pixels towards zero."""
    w = Window.partitionBy(*keys)
    run = w.orderBy(z).rowsBetween(Window.unboundedPreceding, 0)
    d = shifts.withColumns({c: F.sum(c).over(run) for c in ("dy", "dx")})
    return d.select(*keys, z, *[(F.col(c) - F.percentile(c, 0.5).over(w)).cast("int").alias(c) for c in ("dy", "dx")])


def register_across(stack: DataFrame, keys: Sequence[str], z: str, shape: Shape, px: str = "px", limit: int | None = None, others: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(stack, shifts): slices aligned to one another by the running sums of their shifts; columns in ``others`` are rolled alike."""
    shifts = written(accumulated(neighbour_shifts(stack, keys, z, shape, px, limit), keys, z), "slice-shifts")
    out = stack
    for c in (px, *others):
        out = shifted(out, shifts, [*keys, z], shape, c)
    return out, shifts


def warp_to_neighbours(stack: DataFrame, keys: Sequence[str], z: str, shape: Shape, block: Shape, limit: int, px: str = "px") -> DataFrame:
    """The stack with each slice warped block by block to the mean of its neighbours; dys, dxs hold the blocks' shifts.

    The first and the last slice come at the end: they are warped to their one neighbour as it then is.
    """
    rows, columns = block_centres(shape[0], block[0]), block_centres(shape[1], block[1])
    near = lambda k: stack.select(*keys, (F.col(z) + k).alias(z), F.col(px).alias("_a" if k > 0 else "_b"))
    d = stack.join(near(1), [*keys, z], "left").join(near(-1), [*keys, z], "left")
    inner = d.filter("_a IS NOT NULL AND _b IS NOT NULL").withColumn("_ref", F.zip_with("_a", "_b", lambda a, b: (a.cast("double") + b) / 2)).drop("_a", "_b")
    inner = written(warp(block_shifts(inner, shape, (rows, columns), block, limit, px, "_ref"), shape, (rows, columns), px, whole=False).drop("_ref"), "warped-slices")
    done = lambda k: inner.select(*keys, (F.col(z) + k).alias(z), F.col(px).alias("_a" if k > 0 else "_b"))
    ends = d.filter("_a IS NULL OR _b IS NULL").drop("_a", "_b").join(done(1), [*keys, z], "left").join(done(-1), [*keys, z], "left").withColumn("_ref", F.coalesce("_a", "_b", F.transform(px, lambda v: v.cast("double")))).drop("_a", "_b")
    ends = warp(block_shifts(ends, shape, (rows, columns), block, limit, px, "_ref"), shape, (rows, columns), px, whole=False).drop("_ref")
    return inner.unionByName(ends)


def block_shifts(frames: DataFrame, shape: Shape, centres: tuple[Sequence[int], Sequence[int]], block: Shape, limit: int, px: str = "px", reference: str = "_ref") -> DataFrame:
    """frames with dys, dxs: the shift of each block against the same block of the reference column, by phase correlation under a taper."""
    size = [min(b, m) for b, m in zip(block, shape)]
    taper = np.outer(*(np.hanning(m + 2)[1:-1] for m in size))
    names = frames.columns
    schema = f"{_ddl(frames, names)}, dys array<float>, dxs array<float>"

    def cut(x: np.ndarray) -> np.ndarray:
        parts = np.stack([x[:, y - size[0] // 2 : y - size[0] // 2 + size[0], c - size[1] // 2 : c - size[1] // 2 + size[1]] for y in centres[0] for c in centres[1]], axis=1).astype(float)
        return (parts - parts.mean(axis=(2, 3), keepdims=True)) * taper

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, r = cut(images(b.column(px), shape)), cut(images(b.column(reference), shape))
            found = [[phase.phase_shifts(f[k : k + 1], phase.conjugate_spectra(g[k : k + 1]), limit) for k in range(len(f))] for f, g in zip(x, r)]
            dys, dxs = (np.array([[s[k][0, 0] for s in row] for row in found], dtype="float32") for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, _array(dys), _array(dxs)], names=[*names, "dys", "dxs"])

    return frames.mapInArrow(run, schema)


def clipped(df: DataFrame, px: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Images cut to their own percentiles, which are cut to integers."""
    sorted_ = F.array_sort(F.transform(px, lambda v: v.cast("double")))

    def at(s: Column, p: float) -> Column:
        k = (F.size(s) - 1) * F.lit(p)
        below = F.floor(k).cast("int")
        a, b = F.get(s, below), F.get(s, F.least(below + 1, F.size(s) - 1))
        v = a + (b - a) * (k - below)
        return F.floor(F.abs(v)) * F.signum(v)

    ends = let(sorted_, lambda s: F.struct(at(s, low).alias("lo"), at(s, high).alias("hi")))
    return df.withColumn(px, let(ends, lambda e: F.transform(px, lambda v: F.least(F.greatest(v.cast("double"), e["lo"]), e["hi"]))))


def aligned_references(references: DataFrame, keys: Sequence[str], z: str, shape: Shape, px: str = "px", limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(references, shifts): the planes' reference images, clipped to their 1st and 99th percentiles and aligned to one another."""
    return register_across(written(clipped(references, px), "clipped"), keys, z, shape, px, limit)


def register_to_image(stack: DataFrame, target: DataFrame, keys: Sequence[str], z: str, shape: Shape, px: str = "px", limit: int | None = None, others: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(stack, best): all slices of a stack moved by the shift of the one that correlates best with the target (keys, px).

    best: keys, z, dy, dx, corr. One row for each stack.
    """
    found = shifts_to(stack, target, keys, z, shape, px, limit)
    first = Window.partitionBy(*keys).orderBy(F.desc("corr"), z)
    best = written(found.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r"), "best-slice")
    whole = best.select(*keys, "dy", "dx")
    out = stack
    for c in (px, *others):
        out = shifted(out, F.broadcast(whole), keys, shape, c) if keys else shifted(out.withColumn("_one", F.lit(1)), F.broadcast(whole.withColumn("_one", F.lit(1))), ["_one"], shape, c).drop("_one")
    return out, best


def register_stack(df: DataFrame, target: DataFrame, keys: Sequence[str], z: str, id_: str, shape: Shape, share: float = 0.5, windows: tuple[int, int, int] | None = None, px: str = "px", other: str | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(stack, best) from a stack's repeated images: repetitions averaged, slices aligned, smoothed if ``windows`` (z, y, x) are given, moved to the target."""
    means, _ = register_repetitions(df, keys, z, id_, shape, share, px=px, other=other, limit=limit)
    others = [other] if other else []
    stack, _ = register_across(written(means, "slice-means"), keys, z, shape, px, limit, others)
    if windows:
        for c in (px, *others):
            stack = smoothed_volume(stack, keys, z, shape, windows, c)
    return register_to_image(written(stack, "aligned-stack"), target, keys, z, shape, px, limit, others)


def smoothed_volume(stack: DataFrame, keys: Sequence[str], z: str, shape: Shape, windows: tuple[int, int, int], px: str = "px") -> DataFrame:
    """Savitzky-Golay smoothing along x, y (order 2) and z (order 3); edges are repeated.

    windows are the odd lengths for z, y and x; those of y and x are 3 at least. Along x and y an image is smoothed by itself. Along z each
    slice is sent to the slices within half a window, and pixels are summed there with the filter's weights: no task holds a volume.
    """
    lengths = (windows[0], max(windows[1], 3), max(windows[2], 3))
    for m, order in zip(lengths, (3, 2, 2)):
        if m % 2 == 0 or m <= order:
            raise ValueError(f"a window of {m} must be odd and longer than the order {order}")
    wz, wy, wx = (np.array(savitzky_golay(m, order)) for m, order in zip(lengths, (3, 2, 2)))

    def along(x: np.ndarray, w: np.ndarray, axis: int) -> np.ndarray:
        half = len(w) // 2
        pads = [(half, half) if a == axis else (0, 0) for a in range(3)]
        p = np.pad(x, pads, mode="edge")
        return sum(v * np.take(p, np.arange(k, k + x.shape[axis]), axis) for k, v in enumerate(w))

    flat = _mapped(stack, px, shape, lambda x, b: along(along(x.astype(float), wx, 2), wy, 1))
    flat = written(flat, "smoothed-slices")
    half = len(wz) // 2
    # By position in the stack: slices need not be numbered without gaps.
    place = Window.partitionBy(*keys).orderBy(z)
    at = flat.select(*keys, z, (F.row_number().over(place) - 1).alias("_k"), F.count(F.lit(1)).over(Window.partitionBy(*keys)).cast("int").alias("_m"))
    taps = F.transform(F.sequence(F.lit(-half), F.lit(half)), lambda o: F.struct(F.greatest(F.lit(0), F.least(F.col("_m") - 1, F.col("_k") + o)).alias("from"), F.get(F.array(*[F.lit(float(v)) for v in wz]), o + half).alias("w")))
    wants = at.select(*keys, z, F.explode(taps).alias("t")).groupBy(*keys, z, F.col("t.from").alias("_k")).agg(F.sum("t.w").alias("_w"))
    source = flat.join(at.select(*keys, z, "_k"), [*keys, z]).select(*keys, "_k", F.col(px).alias("_px"))
    parts = wants.join(source, [*keys, "_k"]).select(*keys, z, F.posexplode(F.transform("_px", lambda v: v * F.col("_w"))).alias("_i", "_v"))
    pixels = parts.groupBy(*keys, z, "_i").agg(F.sum("_v").alias("_v"))
    image = pixels.groupBy(*keys, z).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_v"))), lambda p: p["_v"]).alias(px))
    rest = [c for c in stack.columns if c != px and c not in keys and c != z]
    out = image.join(stack.select(*keys, z, *rest), [*keys, z]) if rest else image
    return out.select(*stack.columns)


# Checks of alignment


def alignment(pairs: DataFrame, shape: Shape, a: str = "px", b: str = "reference", upsample: int = 10, most: float = 1.0, least_corr: float = 0.0) -> DataFrame:
    """pairs without their images, with dy, dx (to 1 / upsample pixel), distance, corr and aligned: by how much image a is moved against b.

    Aligned are images at most ``most`` pixels apart whose plain correlation is ``least_corr`` or more.
    """
    keep = [c for c in pairs.columns if c not in (a, b)]
    from .image import dot

    d = pairs.withColumn("corr", dot(unit(a), unit(b)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [phase.subpixel_shift(x, y, upsample) for x, y in zip(images(batch.column(a), shape), images(batch.column(b), shape))]
            dy, dx = (pa.array([f[k] for f in found], type=pa.float64()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*keep, "corr"]), dy, dx], names=[*keep, "corr", "dy", "dx"])

    d = d.mapInArrow(run, (_ddl(pairs, keep) + ", " if keep else "") + "corr double, dy double, dx double")
    d = d.withColumn("distance", F.hypot("dy", "dx"))
    return d.withColumn("aligned", (F.col("distance") <= most) & (F.coalesce("corr", F.lit(-1.0)) >= least_corr))


def with_next_sample(samples: DataFrame, keys: Sequence[str], plane: str, at: str, value: str) -> DataFrame:
    """keys, plane, at, value: each plane's samples and after them the first sample of the next plane; the last plane's next is the first."""
    first = samples.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, plane).orderBy(at))).filter("_r = 1").select(*keys, plane, value)
    # One row for each plane.
    ring = Window.partitionBy(*keys).orderBy(plane)
    ends = samples.groupBy(*keys, plane).agg((F.max(at) + 1).alias(at))
    start = F.first(value).over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    last = F.row_number().over(ring) == F.count(F.lit(1)).over(Window.partitionBy(*keys))
    following = first.select(*keys, plane, F.when(last, start).otherwise(F.lead(value).over(ring)).alias(value))
    return samples.select(*keys, plane, at, value).unionByName(ends.join(following, [*keys, plane]).select(*keys, plane, at, value))
