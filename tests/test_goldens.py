"""Golden values of the operators, on small tables made here."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import kernels
from tessera.functions.missing import nan_to_null
from tessera.operators import align, depth, events, image, planes, profiles, sequence, smooth, trace
from tessera.sources import tables


def series(spark, columns, **values):
    """Long rows (roi, segment, frame, value...) from arrays of frames x rois."""
    first = next(iter(values.values()))
    rows = []
    for r in range(first.shape[1]):
        for t in range(first.shape[0]):
            rows.append((r, 0, t, *[None if math.isnan(v[t, r]) else float(v[t, r]) for v in values.values()]))
    return spark.createDataFrame(rows, "roi int, segment int, frame int, " + ", ".join(f"{c} double" for c in columns))


def matrix(df, value):
    p = df.toPandas().pivot(index="frame", columns="roi", values=value)
    return p.sort_index().to_numpy(dtype=float)


def test_interleaved_recording(spark, tmp_path):
    np.arange(7, dtype="<f8").tofile(tmp_path / "rec.bin")
    d = tables.read_interleaved(spark, str(tmp_path / "rec.bin"), ["frame", "piezo"], 2.0).orderBy("sample", "channel").toPandas()
    assert d.volts.tolist() == [0, 1, 2, 3, 4, 5] and sorted(set(d.t_s)) == [0, 0.5, 1]
    with pytest.raises(ValueError):
        tables.read_interleaved(spark, str(tmp_path), [], 2.0)


def test_array_source(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.array([[1.0, np.nan], [3, 4]]))
    rows = tables.read_array(spark, str(tmp_path / "a.npy")).orderBy("row", "col").collect()
    assert [r.value for r in rows] == [1, None, 3, 4]


def test_dataset_and_rule_tables(spark, tmp_path):
    (tmp_path / "d.csv").write_text('Name,Date,Process,Experiments,Planes,Frame_rate\nA,2024-01-02,TRUE,"[\'1\', \'2\']",4,30.0\nB,x,false,"[]",,\n')
    d = {r.name: r for r in tables.read_datasets(spark, str(tmp_path / "d.csv")).collect()}
    assert d["A"].process and d["A"].experiments == ["1", "2"] and d["A"].planes == 4 and d["A"].date == "2024-01-02"
    assert not d["B"].process and d["B"].planes is None
    (tmp_path / "r.csv").write_text('Planes,Range,Flyback\n2,"[10, 30]",[0]\n')
    r = tables.read_flyback_rules(spark, str(tmp_path / "r.csv"))
    one = spark.createDataFrame([(2, 20.0), (2, 100.0)], "planes int, rate double")
    got = align.range_rules(one, "rate", r, on=["planes"]).collect()
    assert [(x.rate, x.flyback_planes) for x in got] == [(20.0, [0])]


def test_frame_clock(spark):
    d = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([0, 0.8, 0.9, 0.1, 0, 0.7, 0.7, 0])], "ds string, i int, v double")
    assert sorted(r.i / 10 for r in sequence.rising_edges(d, ["ds"], ["i"], "v", 0.5).collect()) == [0.1, 0.5]


def test_baseline_of_constants_and_segments(spark):
    d = series(spark, ["f"], f=np.tile([7.0, 12.0], (12, 1)))
    got = matrix(smooth.baseline(d, ["roi", "segment"], "frame", "f", 4, 8, 2), "f0")
    assert np.allclose(got, np.tile([7.0, 12.0], (12, 1)), atol=1e-12)
    d = spark.createDataFrame([(0, t // 8, t, 5.0 if t < 8 else 50.0) for t in range(16)], "roi int, segment int, frame int, f double")
    got = smooth.baseline(d, ["roi", "segment"], "frame", "f", 2, 8, 2).orderBy("frame").toPandas().f0
    assert np.allclose(got, [5.0] * 8 + [50.0] * 8)
    with pytest.raises(ValueError):
        smooth.baseline(d, ["roi"], "frame", "f", 0.1, 8, 1)


def test_dff(spark):
    d = series(spark, ["fc", "f0"], fc=np.array([[2, 4, np.nan], [3, 7, 5]]), f0=np.array([[0.5, 2, 3], [1, 5, np.nan]]))
    got = matrix(trace.dff(d), "dff")
    assert np.allclose(got, [[1.5, 1, np.nan], [2, 0.4, np.nan]], equal_nan=True)


def test_background_regression(spark):
    t = np.arange(400)
    rng = np.random.default_rng(7)
    n = np.stack([50 + 8 * np.sin(t / 17), 35 + 5 * np.cos(t / 23)], axis=1)
    activity = np.stack([rng.exponential(0.15, 400), rng.exponential(0.2, 400)], axis=1)
    f = 200 + n * [0.55, 0.8] + activity
    d = series(spark, ["f", "fneu"], f=f, fneu=n)
    d = smooth.baseline(d, ["roi", "segment"], "frame", "f", 10, 5, 3, "f0")
    d = smooth.baseline(d, ["roi", "segment"], "frame", "fneu", 10, 5, 3, "n0")
    d = d.withColumn("cf", F.col("f") - F.col("f0")).withColumn("cn", F.col("fneu") - F.col("n0"))
    fit = trace.bin_regression(d, ["roi"], "cf", "cn", bins=8, low=0.05, high=0.95, f_percentile=0.10)
    got = {r.roi: (r.intercept, r.slope) for r in fit.collect()}
    assert np.allclose([got[0], got[1]], [(0.06828745, 0.54890913), (0.04059306, 0.79123810)], atol=5e-9)
    c = matrix(trace.subtract_background(d, fit, ["roi"]), "fc")
    assert np.allclose(c[:3], [[228.29983694, 230.76343896], [228.35942522, 230.79221434], [228.30194145, 230.46963530]], atol=5e-8)


def test_constant_background_gives_nothing(spark):
    d = series(spark, ["cf", "cn"], cf=np.random.default_rng(0).random((10, 2)), cn=np.zeros((10, 2)))
    assert all(r.slope is None and r.intercept is None for r in trace.bin_regression(d, ["roi"], "cf", "cn").collect())


def _zmotion(spark, f, n, profile, z, reference=1):
    d = series(spark, ["f", "fneu"], f=f, fneu=n)
    zt = spark.createDataFrame([(i, None if v is None else v) for i, v in enumerate(z)], "frame int, z int")
    p = spark.createDataFrame([(r, k, float(profile[k][r])) for r in range(len(profile[0])) for k in range(len(profile))], "roi int, z int, p double")
    factors = trace.profile_factors(p, ["roi"], "z", "p", reference)
    return trace.correct_zmotion(d.join(zt, "frame"), factors, ["roi"], "segment", "frame", "z", ["f", "fneu"])


def test_zmotion(spark):
    f = np.stack([np.arange(10, 16), np.arange(20, 26)], axis=1).astype(float)
    n = np.stack([np.arange(1, 4, 0.5), np.arange(2, 5, 0.5)], axis=1)
    got = matrix(_zmotion(spark, f, n, [[0.5, 0.8], [1, 1], [2, 1.2]], [0, 1, 2, 1, 0, 2]), "f")
    assert np.allclose(got[[0, 5]], [[10.06549579, 20.88726568], [11.43288061, 24.24041501]], atol=5e-9)


def test_zmotion_gap(spark):
    f, n = np.arange(10, 15.0)[:, None], np.arange(2, 7.0)[:, None]
    got = matrix(_zmotion(spark, f, n, [[0.5], [1], [2]], [0, 1, None, 2, 1]), "f")
    assert math.isnan(got[2, 0]) and not np.isnan(np.delete(got, 2)).any()


def test_faults_by_hand():
    x = np.array([0, 1, 2, 5, 9, 5, 2, 1, 0.5, 1, 2, 5, 8, 5, 2, 1, 0])
    assert trace._peaks(x, 7, 2, 15) == [4, 12] and trace._peaks(x, 9, 2, 15) == [4]
    assert trace.fault_limits(x, 5) == (1, 8)
    assert trace.fault_limits(x, 11) == (8, 16)
    assert trace.fault_limits(np.ones(5), 2) == (0, 4)


def test_best_reference(spark):
    rows = []
    for t in range(4):
        for r in range(3):
            for p in range(3):
                rows.append((t, r, p, [0.6, 0.9, 0.7][r] if r == p else 0.1))
    got = planes.best_reference(spark.createDataFrame(rows, "frame int, ref int, plane int, corr double"), 3).first()
    assert got.ref == 1


def test_equalise(spark):
    rows, z = [], 0
    for plane, lengths in enumerate(([3, 2], [2, 3])):
        z = 10 * plane
        for s, n in enumerate(lengths):
            for _ in range(n):
                rows.append((plane, s, z))
                z += 1
    got = sequence.equalise(spark.createDataFrame(rows, "plane int, segment int, z int"), "plane", "segment", ["z"]).toPandas()
    assert sorted(got[got.plane == 0].z) == [0, 1, 3, 4] and sorted(got[got.plane == 1].z) == [10, 11, 12, 13]
    assert sorted(got[got.plane == 0].frame) == [0, 1, 2, 3]


@pytest.mark.parametrize("centre, pixels, weights, want", [(1, {0: 10, 1: 20, 2: 40}, [0.2, 0.3, 0.5], 28.0), (0, {0: 10, 1: 20}, [0.0, 0.25, 0.75], 17.5)])
def test_neighbour_average(spark, centre, pixels, weights, want):
    n = len(pixels)
    best = spark.createDataFrame([(0, centre)], "frame int, plane int")
    frames = spark.createDataFrame([(0, p, False) for p in pixels], "frame int, plane int, bad boolean")
    px = spark.createDataFrame([(0, p, 0, float(v)) for p, v in pixels.items()], "frame int, plane int, i int, v double")
    got = planes.weighted_frame(planes.neighbours(best, frames, weights, n), px, ["frame"]).first()
    assert got.v == pytest.approx(want)


def test_boundary_search(spark):
    corr = np.array([[3, 1, 1, 3], [2, 3, 2, 2], [1, 2, 3, 1]], dtype=float)
    of = lambda zs: spark.createDataFrame([(0, t, z, float(corr[z, t])) for z in zs for t in range(4)], "segment int, frame int, z int, corr double")
    z, rounds = depth.search(of, 3, 1, 1, 0.01, lambda df, _: df.cache())
    assert [r.z for r in z.orderBy("frame").collect()] == [None, 1, None, None] and rounds == 1


def test_range_expansion(spark):
    corr = np.zeros((5, 4))
    corr[1:4] = np.array([3, 2, 1])[:, None]
    of = lambda zs: spark.createDataFrame([(0, t, z, float(corr[z, t])) for z in zs for t in range(4)], "segment int, frame int, z int, corr double")
    z, rounds = depth.search(of, 5, 2, 1, 0.1, lambda df, _: df.cache())
    assert {r.z for r in z.collect()} == {1} and rounds == 2


def test_reference_depth(spark):
    d = spark.createDataFrame([(None,), (2,), (4,)], "z int")
    assert depth.reference_depth(d, "z").first().reference == 3


def test_reslice(spark):
    off = image.reslice_offsets([0.0, 2.0, 4.0], 3, 2.0)
    g = spark.createDataFrame([(z, y, z) for z in range(4) for y in range(3)], "z int, y int, v int")
    got = {(r.z, r.y): r.v for r in image.reslice(g, spark.createDataFrame(list(enumerate(off)), "y int, off double"), 4).collect()}
    assert [got[z, 1] for z in range(4)] == [0, 1, 2, 3] and got[1, 0] == 0 and got[1, 2] == 2


def test_plane_count(spark):
    d = spark.createDataFrame([(i, float(i % 4)) for i in range(200)], "i int, x double")
    assert sequence.plane_count(sequence.autocorrelation(d, "i", "x", 30)).first().planes == 4


def test_dark_level(spark):
    px = np.arange(30).reshape(5, 6)
    d = spark.createDataFrame([(0, [int(v) for v in row]) for row in px], "plane int, px array<int>")
    assert image.dark_level(d, ["plane"], "px", 0.1).first().dark == pytest.approx(2.9)


@pytest.mark.parametrize("n, k, want", [(5, 2, [1, 3]), (5, 5, [0, 1, 2, 3, 4]), (3, 10, [0, 1, 2])])
def test_even_sample(spark, n, k, want):
    assert sorted(r.id for r in sequence.even_sample(spark.range(n), "id", k).collect()) == want


def test_low_correlation_of_constants(spark):
    d = spark.createDataFrame([(i, 0.5) for i in range(4)], "frame int, corr double")
    assert all(r.low for r in planes.low_correlation(d, "corr").collect())


def test_interpolation(spark):
    d = spark.createDataFrame([(0, None), (1, 1.0), (2, None), (3, 3.0), (4, None)], "x int, y double").withColumn("k", F.lit(0))
    assert [r.y for r in sequence.interpolate(d, ["k"], "x", "y").orderBy("x").collect()] == [1, 1, 2, 3, 3]
    assert [r.y for r in sequence.interpolate(d, ["k"], "x", "y", clamp=False).orderBy("x").collect()] == [None, 1, 2, 3, None]


def test_kernels_match_numpy(spark):
    x = np.random.default_rng(3).random(50)
    d = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "k int, i int, v double")
    w = np.array(kernels.gaussian(1.5))
    r = len(w) // 2
    for mode, f in (("edge", smooth.gaussian_nearest), ("symmetric", smooth.gaussian_reflect)):
        got = [q.s for q in f(d, ["k"], "i", "v", 1.5, "s").orderBy("i").collect()]
        assert np.allclose(got, np.convolve(np.pad(x, r, mode=mode), w, mode="valid"), atol=1e-12)
    got = [q.s for q in smooth.hanning_low_pass(d, ["k"], "i", "v", 9, "s").orderBy("i").collect()]
    assert np.allclose(got, np.convolve(x, kernels.hanning(9), mode="same"), atol=1e-12)
    q = [s.s for s in smooth.rolling_percentile(d, ["k"], "i", "v", 8, 0.3, "s").orderBy("i").collect()]
    assert np.allclose(q, pd.Series(x).rolling(8, center=True, min_periods=1).quantile(0.3), atol=1e-12)
    assert sum(kernels.savitzky_golay(5, 2)) == pytest.approx(1) and kernels.savitzky_golay(5, 2)[2] == pytest.approx(17 / 35)


def test_correlation_of_constants_is_missing(spark):
    a = spark.createDataFrame([(0, z, 1.0) for z in range(4)], "roi int, z int, x double")
    b = spark.createDataFrame([(0, z, float(z)) for z in range(4)], "roi int, z int, y double")
    assert profiles.profile_correlation(a, b, ["roi"], "z", "x", "y").first().r is None


def test_nan_is_missing(spark):
    assert nan_to_null(spark.createDataFrame([(float("nan"),), (1.0,)], "x double")).filter("x IS NULL").count() == 1


def test_registration_of_known_shifts(spark):
    rng = np.random.default_rng(8)
    slices = rng.random((3, 16, 16))
    refs = spark.createDataFrame([(k, [float(v) for v in s.ravel()]) for k, s in enumerate(slices)], "ref int, px array<double>")
    movie = [slices[0], np.roll(slices[1], (2, -3), (0, 1)), slices[2], slices[1]]
    frames = spark.createDataFrame([(t, [float(v) for v in s.ravel()]) for t, s in enumerate(movie)], "frame int, px array<double>")
    best = depth.argmax(image.register(frames, refs, (16, 16)), ["frame"], "ref", "peak").orderBy("frame").collect()
    assert [r.ref for r in best] == [0, 1, 2, 1] and (best[1].dy, best[1].dx) == (2, -3)


def test_onset_rules(spark):
    v = [0, 0, 0, 5, 5, 5, 5, 0, 5, 0, 0, 0]
    d = spark.createDataFrame([(0, float(t), float(x)) for t, x in enumerate(v)], "seg int, t double, v double")
    assert [r.onset for r in events.running_onsets(d, ["seg"], "t", "v", 1.0, 2.0, 2.0).collect()] == [3.0]
