"""Traces from movies: extraction, rows of two scan directions, references from central frames, depth against ground truth."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import composite, extraction
from tessera.plans import catalogue, imaging

from .test_faults import brute_cycle, failing
from .test_registration import SHAPE, loop_reference, movie, scene


def test_cells_and_neuropil(spark):
    x = [scene(i) for i in range(4)]
    d = movie(spark, [(0, i, f) for i, f in enumerate(x)])
    masks = spark.createDataFrame([(0, False, 3, 0.5), (0, False, 40, 2.0), (0, True, 1, 9.0), (0, True, 2, 9.0), (7, False, 5, 1.0)], "roi long, neuropil boolean, i long, w double")
    got = {(r.frame, r.roi): (r.f, r.fneu) for r in extraction.extract(d, masks, SHAPE).collect()}
    assert len(got) == 8
    for i, f in enumerate(x):
        p = f.ravel()
        assert got[i, 0] == (p[3] * 0.5 + p[40] * 2, (p[1] + p[2]) / 2) and got[i, 7] == (p[5], None)
    assert extraction.extract(d, masks.filter("roi > 9"), SHAPE).count() == 0


def test_control_traces_need_every_shift(spark):
    x = [scene(i) for i in range(6)]
    d = movie(spark, [(0, i, f) for i, f in enumerate(x)]).withColumns({"segment": F.lit(0), "bad": F.col("frame") == 2})
    masks = spark.createDataFrame([(0, False, 3, 1.0), (0, True, 9, 1.0)], "roi long, neuropil boolean, i long, w double")
    shifts = d.select("plane", "segment", "frame", F.lit(0).alias("dy"), F.lit(0).alias("dx"))
    run = lambda s: extraction.control_traces(d, s, masks, masks.select("roi"), ["plane"], "segment", "frame", "bad", SHAPE, 10.0, 1.0, 8, 4)
    got = {r.frame: r for r in run(shifts).collect()}
    assert got[2].f is None and got[3].f == x[3].ravel()[3] - 10
    with pytest.raises(Exception, match="no shift"):
        run(shifts.filter("frame < 4"))


@pytest.mark.parametrize("offset", [0, 3, -2])
def test_rows_of_two_directions_are_set_right(spark, offset):
    shape = (12, 32)
    x = [scene(i, shape) for i in range(5)]
    for f in x:
        f[1::2] = np.roll(f[1::2] * 0 + f[::2], offset, axis=1)
    d = movie(spark, [(p, i, f) for p in (0, 1) for i, f in enumerate(x)]).repartition(3)
    offsets = extraction.bidirectional_offset(d, ["plane"], shape)
    assert {(r.plane, r.offset) for r in offsets.collect()} == {(0, offset), (1, offset)}
    assert extraction.bidirectional_offset(d, [], shape).first().offset == offset
    for r in extraction.rows_shifted_back(d, offsets, ["plane"], shape).collect():
        want = x[r.frame].copy()
        if offset > 0:
            want[1::2, :-offset] = x[r.frame][1::2, offset:]
        if offset < 0:
            want[1::2, -offset:] = x[r.frame][1::2, :offset]
        assert (np.array(r.px).reshape(shape) == want).all()


def test_plane_reference_query(spark, sf):
    """The frames about the middle, their rows set right, and eight rounds, by NumPy."""
    frames = {}
    for r in imaging.movie(spark, sf).orderBy("frame").collect():
        frames.setdefault(r.plane, []).append((r.bad, np.array(r.px, dtype=float).reshape(8, 8)))
    got, offsets = {}, {}
    for r in sorted(catalogue.queries()["plane_reference"](spark, sf).collect(), key=lambda r: r.i):
        got.setdefault(r.plane, []).append(r.v)
        offsets[r.plane] = r.offset
    for plane, fs in frames.items():
        usable = [x for bad, x in fs if not bad]
        middle = [x.copy() for x in usable[round(len(usable) / 2) - 8 : round(len(usable) / 2) + 8]]
        total = np.zeros(8)
        for x in middle:
            a, b = np.fft.fft(x[1::2], axis=1), np.fft.fft(x[::2], axis=1)
            total += np.fft.ifft(a / (np.abs(a) + 1e-5) * np.conj(b / (np.abs(b) + 1e-5)), axis=1).real.mean(axis=0)
        k = min(range(-3, 4), key=lambda k: (-total[k % 8], abs(k), k))
        assert offsets[plane] == k
        for x in middle:
            rows = x[1::2].copy()
            if k > 0:
                x[1::2, :-k] = rows[:, k:]
            if k < 0:
                x[1::2, -k:] = rows[:, :k]
        assert np.abs(np.array(got[plane]).reshape(8, 8) - loop_reference(middle, 5)).max() <= 1


def test_profiles_over_planes_and_depths(spark):
    x = [[scene(10 * c + p) for p in range(3)] for c in range(4)]
    d = movie(spark, [(c, p, x[c][p]) for c in range(4) for p in range(3)], "cycle int, plane int")
    masks = spark.createDataFrame([(0, False, 3, 1.0)], "roi long, neuropil boolean, i long, w double")
    best = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (3, 1)], "cycle int, best_plane int")
    rows = extraction.plane_profiles(d, masks, best, [], "cycle", "plane", SHAPE).collect()
    want = {}
    for c, b in ((0, 1), (1, 0), (2, 1), (3, 1)):
        for p in range(3):
            want.setdefault(p - b, []).append(x[c][p].ravel()[3])
    assert {r.depth: (r.value, r.n) for r in rows} == {k: (np.median(v), len(v)) for k, v in want.items()}
    assert all(r.relative == pytest.approx(r.value / np.median(want[0])) for r in rows)
    full = extraction.complete_profile(spark.createDataFrame([(0, 1, 5.0, 2)], "roi int, z int, value double, n int"), ["roi"], "z", spark.range(3).selectExpr("int(id) AS z"))
    assert sorted((r.z, r.value, r.n) for r in full.collect()) == [(0, None, 0), (1, 5.0, 2), (2, None, 0)]


def test_scanner_cycle_of_the_events(spark, sf):
    e = [((r.ts - __import__("datetime").datetime(1970, 1, 1)).total_seconds(), r.value, r.event_type) for r in spark.read.parquet(f"{sf}/events.parquet").collect()]
    want = brute_cycle([(t, v) for t, v, _ in e], [t for t, _, k in e if k == "signup"], 4, 3, 5, 0.5)
    got = {(r.plane, r.offset): r.depth_um for r in catalogue.queries()["piezo_cycle"](spark, sf).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)


def ground_truth(seed=5, planes=3, cycles=120, spf=10):
    """A scanner that sweeps planes with a slow drift, and estimates of depth that follow it with noise."""
    r = np.random.default_rng(seed)
    dt, frame = 0.001, 0.012
    t = np.arange(int((cycles * planes + 3) * frame / dt)) * dt
    clock = 0.001 + np.arange(cycles * planes) * frame
    drift = 2 * np.sin(t / 0.9)
    phase = (t - clock[0]) % (planes * frame)
    um = 30 * phase / (planes * frame) + drift
    z = [[20 + 30 * p / planes / 2 + np.sin(c * planes * frame / 0.9) + r.normal(0, 0.05) for c in range(cycles)] for p in range(planes)]
    z[1][7] = None
    return t, um * 0.25, clock, z


def loop_truth(t, volts, clock, z, planes, width, scale, spacing, end, spf):
    w = np.hanning(width) / np.hanning(width).sum()
    half = width // 2
    p = np.pad(volts, (half, width - 1 - half))
    v = np.array([(p[i : i + width] * w).sum() for i in range(len(volts))])
    cycle = brute_cycle(list(zip(t, volts)), list(clock), planes, spf, width, scale)
    template = np.array([[cycle[q, o] for o in range(spf)] for q in range(planes)]) * scale
    times, offsets = [], []
    for start in range(planes, len(clock) - planes, planes):
        first = [int(np.searchsorted(t, clock[start + q])) for q in range(planes)]
        if max(first) + spf > len(v):
            continue
        paths = [v[k : k + spf] - template[q] for q, k in enumerate(first)]
        times.append((clock[start] + clock[start + planes]) / 2)
        offsets.append(np.median(np.concatenate(paths)) / scale)
    offsets = np.array(offsets) - np.median(offsets)
    at = clock[::planes]
    shown = (at >= 0) & (at <= end)
    moved = np.interp(at, times, offsets, left=np.nan, right=np.nan)
    z = np.array([[np.nan if x is None else x for x in row] for row in z], dtype=float)
    nominal = np.median(template / scale, axis=1)
    per = np.nanmedian((z - (nominal[:, None] + moved[None, :]) / spacing)[:, shown], axis=1)
    shared = np.median(per)
    error = (z - shared - (nominal[:, None] + moved[None, :]) / spacing)[:, shown] * spacing
    n = np.isfinite(error).sum(axis=1)
    return shared, np.sqrt(np.nansum(error**2, axis=1) / n), n, np.sqrt(np.nansum(error**2) / n.sum())


def test_depth_against_the_scanner(spark):
    t, volts, clock, z = ground_truth()
    want = loop_truth(t, volts, clock, z, 3, 9, 0.25, 2.0, 3.0, 10)
    samples = spark.createDataFrame([(float(a), float(b)) for a, b in zip(t, volts)], "t_s double, volts double").repartition(4)
    frames = spark.createDataFrame([(float(x),) for x in clock], "t_s double").repartition(3)
    estimates = spark.createDataFrame([(p, c, None if v is None else float(v)) for p, row in enumerate(z) for c, v in enumerate(row)], "plane int, cycle int, z double")
    for block in (1 << 18, 200):
        rows = composite.depth_errors(samples, frames, estimates, 3, 10, 9, 0.25, 2.0, end=3.0, block=block).collect()
        got = {r.plane: r for r in rows}
        assert set(got) == {0, 1, 2, None}
        for p in range(3):
            assert got[p].rmse == pytest.approx(want[1][p], abs=1e-9) and got[p].n == want[2][p] and got[p].shared_offset == pytest.approx(want[0], abs=1e-9)
        assert got[None].rmse == pytest.approx(want[3], abs=1e-9) and got[None].n == want[2].sum()
    failing(composite.depth_errors(samples, frames, estimates.withColumn("z", F.when(F.col("plane") != 1, F.col("z"))), 3, 10, 9, 0.25, 2.0, end=3.0), "plane 1")


def test_depth_against_every_cycle_of_a_long_recording(spark):
    """The mean cycle is that of all cycles, also where every second one would make some 1000; by NumPy."""
    planes, spf, cycles = 2, 2, 1601
    r = np.random.default_rng(8)
    v = np.array([[0, 2], [3, 7]]) + r.normal(size=(cycles, planes, spf))
    v[::2, 1] += 6  # planes lie apart in every second cycle
    t = 0.5 + np.arange(v.size)
    clock = t[::spf]
    z = 3 + np.arange(planes)[:, None] + r.normal(size=(planes, cycles))
    template = np.array([v[1:, 0].mean(axis=0), v[1:-1, 1].mean(axis=0)])
    template -= template.min()
    drift = np.median((v - template)[1:-1].reshape(cycles - 2, -1), axis=1)
    moved = np.interp(clock[::planes], (clock[planes:-planes:planes] + clock[2 * planes :: planes]) / 2, drift - np.median(drift), left=np.nan, right=np.nan)
    error = z - np.median(template, axis=1)[:, None] - moved
    shared = np.median(np.nanmedian(error, axis=1))
    samples = spark.createDataFrame([(float(a), float(b)) for a, b in zip(t, v.ravel())], "t_s double, volts double").repartition(4)
    frames = spark.createDataFrame([(float(x),) for x in clock], "t_s double").repartition(3)
    estimates = spark.createDataFrame([(p, c, float(z[p, c])) for p in range(planes) for c in range(cycles)], "plane int, cycle int, z double")
    run = lambda s: composite.depth_errors(s, frames, estimates, planes, spf, 1, 1.0, 1.0, end=1e9, block=500).collect()
    got = {x.plane: x for x in run(samples)}
    for p, e in ((0, error[0] - shared), (1, error[1] - shared), (None, error - shared)):
        assert got[p].rmse == pytest.approx(np.sqrt(np.nanmean(e**2)), abs=1e-9) and got[p].n == np.isfinite(e).sum() and got[p].shared_offset == pytest.approx(shared, abs=1e-9)
    with pytest.raises(Exception, match="do not cover"):  # the frames of the last cycle, which a stride leaves out
        run(samples.filter(F.col("t_s") < float(t[-planes * spf])))


def events(spark, sf):
    out = []
    for r in spark.read.parquet(f"{sf}/events.parquet").orderBy("ts").collect():
        out.append(((r.ts - __import__("datetime").datetime(1970, 1, 1)).total_seconds(), r.value, r.event_type, __import__("json").loads(r.props)["k"] % 20))
    return out


def test_depth_ground_truth_of_the_events(spark, sf):
    e = events(spark, sf)
    signups = [(t, z or None) for t, _, k, z in e if k == "signup"]
    z = [[v for _, v in signups[p::4]] for p in range(4)]
    z = [row + [None] * (max(map(len, z)) - len(row)) for row in z]
    want = loop_truth(np.array([x[0] for x in e]), np.array([x[1] for x in e]), np.array([t for t, _ in signups]), z, 4, 5, 0.5, 2.0, 1e12, 3)
    got = {r.plane: r for r in catalogue.queries()["depth_ground_truth"](spark, sf).collect()}
    for p in range(4):
        assert got[p].rmse == pytest.approx(want[1][p], abs=2e-6) and got[p].n == want[2][p] and got[p].shared_offset == pytest.approx(want[0], abs=2e-6)
    assert got[None].rmse == pytest.approx(want[3], abs=2e-6)


def test_depth_search_of_the_traces(spark, sf):
    """The range grows by steps until no frame but a segment's first has its best slice at an edge."""
    sums = {}
    for r in catalogue.traces(spark, sf).collect():
        sums.setdefault((r.roi, r.ts.day), {}).setdefault(r.z, []).append(r.value)
    corr = {k: {z: sum(v) / len(v) for z, v in zs.items()} for k, zs in sums.items()}
    low, high, rounds = 8, 12, 0
    while True:
        rounds += 1
        best = {k: max(((z, v) for z, v in zs.items() if low <= z <= high), key=lambda x: (x[1], -x[0]))[0] for k, zs in corr.items() if any(low <= z <= high for z in zs)}
        later = [z for (roi, day), z in best.items() if day != min(d for r, d in best if r == roi)]
        a, b = (low in later) and low > 0, (high in later) and high < 19
        if not a and not b:
            break
        low, high = max(0, low - 2) if a else low, min(19, high + 2) if b else high
    rows = catalogue.queries()["depth_search"](spark, sf).collect()
    edge = lambda z: None if z in (low, high) else z
    assert {(r.segment, r.frame): r.z for r in rows} == {k: edge(z) for k, z in best.items()} and {r.rounds for r in rows} == {rounds}
