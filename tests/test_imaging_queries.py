"""The imaging queries that SQL cannot express, over the whole table, against plain NumPy."""

import numpy as np
import pytest

from tessera.plans import catalogue, imaging

from .test_registration import loop_reference, one_shift

SHAPE = imaging.SHAPE


@pytest.fixture(scope="module")
def planes(spark, sf):
    """plane -> the numbers and images of its frames, in order."""
    out = {}
    for r in imaging.whole_frames(spark, sf).orderBy("frame").collect():
        out.setdefault(r.plane, []).append((r.frame, np.array(r.px, dtype=float).reshape(SHAPE)))
    return out


def run(spark, sf, name):
    return catalogue.queries()[name](spark, sf).collect()


def images(rows, *keys):
    out = {}
    for r in sorted(rows, key=lambda r: r.i):
        out.setdefault(tuple(r[k] for k in keys), []).append(r.v)
    return {k: np.array(v).reshape(SHAPE) for k, v in out.items()}


def test_iterated_reference(spark, sf, planes):
    got = images(run(spark, sf, "iterated_reference"), "plane")
    assert set(got) == {(p,) for p in planes}
    for p, fs in planes.items():
        assert np.abs(got[p,] - loop_reference([x for _, x in fs], 20)).max() <= 1


def test_aligned_slices(spark, sf, planes):
    got = {(r.plane, r.z): (r.dy, r.dx, r.corner) for r in run(spark, sf, "aligned_slices")}
    assert len(got) == sum(map(len, planes.values()))
    for p, fs in planes.items():
        x = [f for _, f in fs]
        steps = np.cumsum([(0, 0), *[one_shift(b, a)[:2] for a, b in zip(x, x[1:])]], axis=0)
        want = np.trunc(steps - np.median(steps, axis=0)).astype(int)
        for z, f in enumerate(x):
            assert got[p, z] == (*want[z], np.roll(f, tuple(-want[z]), (0, 1))[0, 0])


def test_repetition_means(spark, sf, planes):
    got = images(run(spark, sf, "repetition_means"), "plane", "z")
    most = max(sum(k % 3 == z for k, _ in fs) for fs in planes.values() for z in range(3))
    for p, fs in planes.items():
        for z in range(3):
            x = [f for k, f in fs if k % 3 == z]
            reference = loop_reference(x, max(1, round(most * 0.5)))
            moved = [np.roll(f, tuple(-v for v in one_shift(f, reference)[:2]), (0, 1)) for f in x]
            assert got[p, z] == pytest.approx(np.mean(moved, axis=0), abs=1e-5)


def test_stack_to_movie(spark, sf, planes):
    got = {r.plane: r for r in run(spark, sf, "stack_to_movie")}
    for p, fs in planes.items():
        mean = np.mean([f for _, f in fs], axis=0)
        target = np.clip(mean, *np.trunc(np.percentile(mean, [1, 99])))
        found = [one_shift(f, target) for _, f in fs]
        z = max(range(len(found)), key=lambda k: (found[k][2], -k))
        assert (got[p].z, got[p].dy, got[p].dx) == (z, *found[z][:2]) and got[p].corr == pytest.approx(found[z][2], abs=1e-5)


def test_subpixel_alignment(spark, sf, planes):
    """Against the phase correlation's Fourier sum at every tenth of a pixel about the whole-pixel peak."""
    got = {(r.plane, r.z): r for r in run(spark, sf, "subpixel_alignment")}
    fy, fx = np.fft.fftfreq(SHAPE[0])[:, None], np.fft.fftfreq(SHAPE[1])[None, :]
    for p, fs in list(planes.items())[:3]:
        for z, ((_, a), (_, b)) in enumerate(zip(fs, fs[1:]), 1):
            cross = np.fft.fft2(b) * np.conj(np.fft.fft2(a))
            cross /= np.maximum(np.abs(cross), 1e-12)
            value = lambda dy, dx: abs((cross * np.exp(2j * np.pi * (fy * dy + fx * dx))).sum())  # noqa: E731, B023
            r = got[p, z]
            whole = np.unravel_index(np.abs(np.fft.ifft2(cross)).argmax(), SHAPE)
            whole = [v - 8 if v > 4 else v for v in whole]
            best = max(value(whole[0] + i / 10, whole[1] + j / 10) for i in range(-7, 8) for j in range(-7, 8))
            assert value(r.dy, r.dx) == pytest.approx(best, rel=1e-9) and abs(r.dy - whole[0]) < 0.71 and abs(r.dx - whole[1]) < 0.71
            assert r.corr == pytest.approx(np.corrcoef(a.ravel(), b.ravel())[0, 1], abs=1e-5) and r.distance == pytest.approx(np.hypot(r.dy, r.dx), abs=1e-5)
            assert r.aligned == (r.distance <= 1 and r.corr >= 0)


def test_automatic_edges_are_numpys(spark):
    from tessera.operators.profiles import automatic_edges

    r = np.random.default_rng(1)
    for x in (r.normal(0, 1, 500), r.normal(5, 1, 2000), -r.exponential(3, 50), np.array([1.0, 1.0, 1.0]), np.array([2.0]), r.standard_cauchy(4000), r.integers(-3, 9, 100).astype(float)):
        low, high = min(0.0, x.min()), max(0.0, x.max())
        want = np.histogram_bin_edges(x, bins="auto", range=(low, high))
        want = np.linspace(low, high, 81) if len(want) > 81 else want
        want = want if (want == 0).any() else np.sort(np.append(want, 0.0))
        half = len(x) // 2
        d = spark.createDataFrame([(float(v),) for v in x], "a double")
        assert automatic_edges(d, "a") == pytest.approx(want.tolist())
        if half:
            d = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x[:half], x[half : 2 * half])], "a double, b double")
            assert len(automatic_edges(d, "a", "b")) > 1
    zero = spark.createDataFrame([(0.0,)], "a double")
    assert automatic_edges(zero, "a") == [-np.finfo(float).eps, 0.0, np.finfo(float).eps]
    for bad in (None, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            automatic_edges(spark.createDataFrame([(1.0,), (bad,)], "a double"), "a")
    with pytest.raises(ValueError):
        automatic_edges(zero.filter("a > 1"), "a")
