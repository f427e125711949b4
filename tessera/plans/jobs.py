"""Whole jobs for one data set: planes registered into one movie, traces corrected; each writes typed tables beside what made them.

A job reads a folder of Parquet tables and writes tables partitioned by ``ds``, so that a run replaces its own data set and no other:

    frames    plane, frame, bad, px                      register: in
    shifts    ds, plane, frame, dy, dx, corr, bad        register: out, against the best reference
    references ds, plane, px                             register: out, aligned to one another
    movie     ds, frame, plane, px                       register: out, plane is the frame's best one
    traces    plane, roi, segment, frame, z, f, fneu     correct: in
    profiles  plane, roi, z, value                       correct: in, for the axial correction; without them there is none
    clock     t_s                                        correct: in, where the frame rate comes from
    calcium   ds, plane, roi, segment, frame, f, fneu, f0, n0, fc, dff
    planes    ds, plane, settings (JSON), rate_hz, depth and the like: one row a plane, from where a result came
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.phase import Shape
from ..operators import align, depth, extraction, image, planes, registration, smooth, trace
from ..sources.shared import written
from .manifest import canonical
from .run import exists, save


def positions(frames: DataFrame, ignore: Sequence[int] = ()) -> dict[int, int]:
    """Physical number -> position of the planes that are not ignored: as many as a microscope has."""
    kept = sorted(r.plane for r in frames.select("plane").distinct().collect() if r.plane not in set(ignore))
    if not kept:
        raise ValueError("every plane is ignored")
    return {p: k for k, p in enumerate(kept)}


def register_planes(frames: DataFrame, shape: Shape, count: int, weights: Sequence[float] = (0.2, 0.6, 0.2), deviations: float = 4.0, n_best: int = 20, limit: int | None = None, ignore: Sequence[int] = ()) -> dict[str, DataFrame | int]:
    """One movie from all planes of a recording: for each frame the plane that looks most like the best reference, with its neighbours.

    Each plane gets a reference from ``count`` central frames; the references are aligned to one another. Every frame is registered to every reference,
    which tells the best reference (whose shifts stay within the planes most often) and each frame's best plane. Frames that fit their
    best reference worse than the plane's mean by so many deviations are bad. The planes about the best one, moved by their shifts, are summed with
    the weights; bad neighbours and those out of range weigh nothing.
    """
    at = positions(frames, ignore)
    number = F.create_map(*[F.lit(x) for pair in at.items() for x in pair])
    d = frames.filter(F.col("plane").isin(list(at))).select(number[F.col("plane")].cast("int").alias("plane"), "frame", F.coalesce("bad", F.lit(False)).alias("bad"), "px")
    references, offsets = extraction.plane_reference(d, ["plane"], "frame", "bad", shape, count, n_best=n_best)
    d = written(extraction.rows_shifted_back(d, offsets, ["plane"], shape), "frames")
    aligned, _ = registration.aligned_references(references, [], "plane", shape, limit=limit)
    aligned = written(aligned, "aligned-references")
    found = written(image.register(d.drop("bad"), aligned.withColumnRenamed("plane", "ref"), shape, limit=limit).withColumnRenamed("peak", "corr"), "plane-shifts")
    best = planes.best_reference(found, len(at)).first().ref
    own = planes.low_by_plane(found.filter(F.col("ref") == best).drop("ref"), ["plane"], "corr", deviations)
    own = own.join(d.select("plane", "frame", "bad"), ["plane", "frame"]).withColumn("bad", F.col("bad") | F.col("low")).drop("low")
    own = written(own, "plane-shifts")
    across = depth.argmax(own, ["frame"], "plane", "corr").select("frame", "plane")
    near = planes.neighbours(across, own, weights, len(at))
    moved = registration.shifted(d.select("plane", "frame", "px"), own.select("plane", "frame", "dy", "dx"), ["plane", "frame"], shape)
    movie = planes.weighted_images(near, moved, ["frame"]).join(across, "frame")
    back = F.create_map(*[F.lit(x) for p, k in at.items() for x in (k, p)])
    physical = lambda t: t.withColumn("plane", back[F.col("plane")])
    return {"shifts": physical(own), "references": physical(aligned), "movie": physical(movie), "best": {k: p for p, k in at.items()}[best], "planes": list(at)}


def provenance(spark: SparkSession, rows: Sequence[Mapping], settings: Mapping) -> DataFrame:
    """One row for each plane (a microscope's planes, never data), with the settings as canonical JSON."""
    text = canonical(dict(settings))
    return spark.createDataFrame([(r["ds"], int(r["plane"]), json.dumps({k: v for k, v in r.items() if k not in ("ds", "plane")}, sort_keys=True), text) for r in rows], "ds string, plane int, found string, settings string")


def register_job(spark: SparkSession, d: Mapping, target: str) -> None:
    """d: ds, tables, shape, count and, if wanted, weights, deviations, n_best, limit, ignore_planes."""
    frames = spark.read.parquet(f"{d['tables']}/frames")
    out = register_planes(frames, tuple(d["shape"]), d["count"], d.get("weights", (0.2, 0.6, 0.2)), d.get("deviations", 4.0), d.get("n_best", 20), d.get("limit"), d.get("ignore_planes", ()))
    for name in ("shifts", "references", "movie"):
        save(out[name].withColumn("ds", F.lit(d["ds"])), f"{target}/{name}")
    rows = [{"ds": d["ds"], "plane": p, "reference_plane": out["best"], "ignored": sorted(d.get("ignore_planes", ()))} for p in out["planes"]]
    save(provenance(spark, rows, d), f"{target}/planes")


def frame_rate(spark: SparkSession, d: Mapping) -> float:
    """Frames a second: from the clock if there is one, else as the data set says, else as the recording's settings do."""
    if exists(spark, f"{d['tables']}/clock"):
        step = align.median_interval(spark.read.parquet(f"{d['tables']}/clock"), [], "t_s").first().dt
        if step is None or step <= 0:
            raise ValueError("the frame clock has no steps")
        return 1 / step
    rate = d.get("frame_rate") or d.get("fs")
    if not rate:
        raise ValueError("neither a clock nor a frame rate is given")
    return float(rate)


def correct_job(spark: SparkSession, d: Mapping, target: str) -> None:
    """d: ds, tables, planes (of a cycle), f0_percentile, f0_window and, if wanted, frame_rate, fs, ignore_planes, depth (0), faults (true).

    With profiles, traces are corrected for the depth of each frame about the plane's median depth; without, by their background alone.
    """
    t = spark.read.parquet(f"{d['tables']}/traces")
    at = positions(t, d.get("ignore_planes", ()))
    rate = frame_rate(spark, d) / d["planes"]
    t = t.filter(F.col("plane").isin(list(at)))
    cell = ["plane", "roi"]
    found: dict[int, int | None] = dict.fromkeys(at)
    if exists(spark, f"{d['tables']}/profiles"):
        profiles = spark.read.parquet(f"{d['tables']}/profiles")
        found = {r.plane: r.reference for r in depth.reference_depth(t.select("plane", "frame", "z").distinct(), "z", ["plane"]).collect()}
        parts = [trace.correct_traces(t.filter(F.col("plane") == p), profiles.filter(F.col("plane") == p).drop("plane"), ["roi"], "segment", "frame", "z", "z", z, rate, d["f0_percentile"], d["f0_window"], d.get("faults", True)) for p, z in found.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
    else:
        out = trace.about_baselines(smooth.baselines(t, [*cell, "segment"], "frame", {"f0": "f", "n0": "fneu"}, rate, d["f0_percentile"], d["f0_window"]))
        out = trace.dff(trace.subtract_background(out, trace.bin_regression(out, cell, "cf", "cn"), cell))
    columns = ["plane", "roi", "segment", "frame", "f", "fneu", "f0", "n0", "fc", "dff"]
    save(out.select(F.lit(d["ds"]).alias("ds"), *columns), f"{target}/calcium")
    rows = [{"ds": d["ds"], "plane": p, "rate_hz": rate, "depth": d.get("depth", 0), "reference_depth": z, "corrected": z is not None} for p, z in found.items()]
    save(provenance(spark, rows, d), f"{target}/planes")
