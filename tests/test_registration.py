"""Registration against plain NumPy loops: iterated references, rolls, stacks, repetitions, fractions of a pixel, warps, volumes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import phase
from tessera.operators import registration as R
from tessera.plans import catalogue

SHAPE = (12, 16)


def scene(seed, shape=SHAPE, high=1000):
    """A smooth random image of whole numbers, so that shifts are seen and sums are exact."""
    r = np.random.default_rng(seed)
    x = r.normal(size=shape)
    for axis in (0, 1):
        x = x + np.roll(x, 1, axis) + np.roll(x, -1, axis)
    return np.round((x - x.min()) / (x.max() - x.min()) * high).astype(int)


def movie(spark, rows, columns="plane int, frame int"):
    return spark.createDataFrame([(*k, np.asarray(x).ravel().tolist()) for *k, x in rows], f"{columns}, px array<int>")


def one_shift(frame, reference):
    """By how much a frame is moved against a reference, the plain way."""
    cross = np.fft.fft2(frame) * np.conj(np.fft.fft2(reference))
    c = np.fft.ifft2(cross / np.maximum(np.abs(cross), 1e-12)).real
    at = np.unravel_index(np.argmax(c), c.shape)
    return [int(v - m) if v > m // 2 else int(v) for v, m in zip(at, c.shape)] + [c.max()]


def loop_initial(frames, n_best):
    x = np.array([f.ravel() - f.mean() for f in frames], dtype=float)
    c = x @ x.T / np.sqrt(np.outer((x * x).sum(axis=1), (x * x).sum(axis=1)))
    n = min(n_best, len(x))
    others = np.array([np.sort(np.delete(row, i))[::-1][: max(2, n) - 1].mean() for i, row in enumerate(c)])
    best = np.argsort(-c[others.argmax()], kind="stable")[:n]
    return np.trunc(x[best].mean(axis=0)).reshape(frames[0].shape)


def loop_reference(frames, n_best):
    """Eight rounds over a list of frames, each rolled in place."""
    frames, reference = [f.astype(float) for f in frames], loop_initial(frames, n_best)
    for i in range(8):
        found = [one_shift(f, reference) for f in frames]
        frames = [np.roll(f, (-dy, -dx), (0, 1)) for f, (dy, dx, _) in zip(frames, found)]
        best = sorted(range(len(frames)), key=lambda k: (-found[k][2], k))[: max(2, int(len(frames) * (1 + i) / 16))]
        mean = np.mean([frames[k] for k in best], axis=0)
        dy, dx = (round(float(np.mean([found[k][a] for k in best]))) for a in (0, 1))
        reference = np.trunc(np.roll(mean, (dy, dx), (0, 1)))
    return reference


def shaken(seed, n, shape=SHAPE, noise=60):
    r = np.random.default_rng(seed + 1000)
    base = scene(seed, shape)
    return [np.roll(base, tuple(r.integers(-3, 4, 2)), (0, 1)) + r.integers(-noise, noise + 1, shape) for _ in range(n)]


def test_shifts_match_the_plain_way():
    refs, frames = np.stack([scene(1), scene(2)]), np.stack(shaken(1, 7))
    dy, dx, peak = phase.phase_shifts(frames, phase.conjugate_spectra(refs))
    for i, f in enumerate(frames):
        for k, r in enumerate(refs):
            assert [dy[i, k], dx[i, k]] == one_shift(f, r)[:2] and peak[i, k] == pytest.approx(one_shift(f, r)[2])
    assert all((np.roll(f, (-a, -b), (0, 1)) == g).all() for f, a, b, g in zip(frames, dy[:, 0], dx[:, 0], phase.rolled_back(frames, dy[:, 0], dx[:, 0])))
    far = np.roll(scene(1), (5, 0), (0, 1))[None]
    assert phase.phase_shifts(far, phase.conjugate_spectra(refs[:1]))[0][0, 0] == 5
    assert abs(phase.phase_shifts(far, phase.conjugate_spectra(refs[:1]), limit=2)[0][0, 0]) <= 2


def test_iterated_reference_equals_a_loop(spark):
    planes = {p: shaken(p, 40 + p) for p in range(3)}
    d = movie(spark, [(p, i, f) for p, fs in planes.items() for i, f in enumerate(fs)]).repartition(5)
    got = {r.plane: np.array(r.px).reshape(SHAPE) for r in R.iterated_reference(d, ["plane"], "frame", SHAPE, n_best=7).collect()}
    for p, fs in planes.items():
        assert (got[p] == loop_reference(fs, 7)).all()
    # Without keys, one plane.
    one = R.iterated_reference(d.filter("plane = 1").drop("plane"), [], "frame", SHAPE, n_best=7).first()
    assert (np.array(one.px).reshape(SHAPE) == got[1]).all()


def test_no_group_holds_all_frames_of_the_first_reference(spark):
    frames = shaken(5, 60)
    d = movie(spark, [(0, i, f) for i, f in enumerate(frames)])
    want = loop_initial(frames, 9)
    for block in (7, 512):
        seed = R.correlation_seeds(d, ["plane"], "frame", "px", 9, block).first()
        assert seed.frame == R.correlation_seeds(d, ["plane"], "frame", "px", 9).first().frame
    got = np.array(R.initial_reference(d, ["plane"], "frame", "px", SHAPE, 9).first().px).reshape(SHAPE)
    assert np.abs(got - want).max() <= 1  # means of fractions, cut
    flat = d.unionByName(movie(spark, [(0, 99, np.full(SHAPE, 5))]))
    assert (np.array(R.initial_reference(flat, ["plane"], "frame", "px", SHAPE, 9).first().px).reshape(SHAPE) == got).all()


def test_movie_view_rolls_each_frame(spark):
    frames = [scene(i) for i in range(6)]
    moves = [(0, 0), (3, 0), (0, -5), (-2, 7), (12, 16), (25, -33)]
    d = movie(spark, [(0, i, f) for i, f in enumerate(frames)])
    s = spark.createDataFrame([(i, *m) for i, m in enumerate(moves)], "frame int, dy int, dx int")
    view = R.shifted(d, s, ["frame"], SHAPE)
    for r in view.collect():
        assert (np.array(r.px).reshape(SHAPE) == np.roll(frames[r.frame], tuple(-m for m in moves[r.frame]), (0, 1))).all()
    assert "ArrowEvalPython" not in view._jdf.queryExecution().toString() and "MapInArrow" not in view._jdf.queryExecution().toString()
    with pytest.raises(Exception, match="no shift"):
        R.shifted(d, s.filter("frame < 3"), ["frame"], SHAPE).collect()


def planted_stack(seed, moves, shape=(32, 32)):
    """Slices that change slowly and are moved by the running sums of the moves."""
    base, other = scene(seed, shape), scene(seed + 1, shape)
    at = np.cumsum(moves, axis=0)
    return [np.roll(base + (other * k) // 40, tuple(m), (0, 1)) for k, m in enumerate(at)], at


def test_slices_are_aligned_to_one_another(spark):
    shape, moves = (32, 32), [(0, 0), (1, -2), (0, 3), (-4, 0), (2, 2), (1, 1), (0, -1)]
    slices, at = planted_stack(3, moves, shape)
    d = movie(spark, [(p, z, f) for p in (0, 1) for z, f in enumerate(slices)], "stack int, z int").withColumn("second", F.transform("px", lambda v: v * 2))
    out, shifts = R.register_across(d, ["stack"], "z", shape, others=["second"])
    want = np.trunc(at - np.median(at, axis=0)).astype(int)
    for stack in (0, 1):
        got = {r.z: (r.dy, r.dx) for r in shifts.filter(f"stack = {stack}").collect()}
        assert [got[z] for z in range(len(slices))] == [tuple(w) for w in want]
    for r in out.collect():
        moved = np.roll(slices[r.z], tuple(-want[r.z]), (0, 1))
        assert (np.array(r.px).reshape(shape) == moved).all() and (np.array(r.second).reshape(shape) == 2 * moved).all()


def test_repetitions_of_two_channels(spark):
    r = np.random.default_rng(8)
    rows, planted = [], {}
    for z in range(3):
        base = scene(20 + z)
        for k in range(12):
            m = tuple(int(v) for v in r.integers(-3, 4, 2))
            planted[z, k] = m
            rows.append((0, z, k, np.roll(base, m, (0, 1)).ravel().tolist(), np.roll(base[::-1], m, (0, 1)).ravel().tolist()))
    d = spark.createDataFrame(rows, "stack int, z int, k int, px array<int>, green array<int>")
    means, shifts = R.register_repetitions(d, ["stack"], "z", "k", SHAPE, other="green")
    got = {(s.z, s.k): (s.dy, s.dx) for s in shifts.collect()}
    for z in range(3):
        offsets = {tuple((np.array(got[z, k]) - planted[z, k]) % SHAPE) for k in range(12)}
        assert len(offsets) == 1  # all are moved back alike
        m = means.filter(f"z = {z}").first()
        y, x = offsets.pop()
        base = scene(20 + z)
        assert (np.array(m.px).reshape(SHAPE) == np.roll(base, (-y, -x), (0, 1))).all() and (np.array(m.green).reshape(SHAPE) == np.roll(base[::-1], (-y, -x), (0, 1))).all()
    with pytest.raises(ValueError, match="at least 2"):
        R.register_repetitions(d.filter("z > 0 OR k = 0"), ["stack"], "z", "k", SHAPE)


def test_stack_takes_the_shift_of_its_best_slice(spark):
    slices = [scene(30 + z) for z in range(5)]
    target = np.roll(slices[3], (-2, 4), (0, 1))
    d = movie(spark, [(0, z, f) for z, f in enumerate(slices)], "stack int, z int")
    t = spark.createDataFrame([(0, target.ravel().tolist())], "stack int, px array<int>")
    for keys in (["stack"], []):
        out, best = R.register_to_image(d if keys else d.drop("stack"), t if keys else t.drop("stack"), keys, "z", SHAPE)
        assert (best.first().z, best.first().dy, best.first().dx) == (3, 2, -4)
        for r in out.collect():
            assert (np.array(r.px).reshape(SHAPE) == np.roll(slices[r.z], (-2, 4), (0, 1))).all()


def test_references_are_clipped_and_aligned(spark):
    x = scene(40, (32, 32))
    spiked = x.copy()
    spiked[0, 0] = 30_000
    d = movie(spark, [(0, 0, spiked), (0, 1, np.roll(spiked, (1, 2), (0, 1))), (0, 2, np.roll(spiked, (2, 4), (0, 1)))], "stack int, z int")
    one = np.array(R.clipped(d, "px").filter("z = 0").first().px).reshape(32, 32)
    assert (one == np.clip(spiked, int(np.percentile(spiked, 1)), int(np.percentile(spiked, 99)))).all()
    out, shifts = R.aligned_references(d, ["stack"], "z", (32, 32))
    assert {(r.z, r.dy, r.dx) for r in shifts.collect()} == {(0, -1, -2), (1, 0, 0), (2, 1, 2)}
    assert len({tuple(r.px) for r in out.collect()}) == 1


def test_whole_stack_from_raw_repetitions(spark):
    """Repetitions, slices and the movie's image, each moved by planted shifts, come back to one place."""
    r, shape = np.random.default_rng(3), (32, 32)
    slices, _ = planted_stack(50, [(0, 0), (1, 0), (0, 1), (-1, 1), (1, -1)], shape)
    rows = [(0, z, k, np.roll(s, tuple(r.integers(-2, 3, 2)), (0, 1)).ravel().tolist()) for z, s in enumerate(slices) for k in range(6)]
    d = spark.createDataFrame(rows, "stack int, z int, k int, px array<int>")
    target = np.roll(slices[2], (3, -3), (0, 1))
    out, best = R.register_stack(d, spark.createDataFrame([(0, target.ravel().tolist())], "stack int, px array<int>"), ["stack"], "z", "k", shape)
    assert best.first().z == 2
    got = {x.z: np.array(x.px).reshape(shape) for x in out.collect()}
    assert (got[2] == target).all()
    assert all(one_shift(got[z + 1], got[z])[:2] == [0, 0] for z in range(4))
    smooth, _ = R.register_stack(d, spark.createDataFrame([(0, target.ravel().tolist())], "stack int, px array<int>"), ["stack"], "z", "k", shape, windows=(5, 3, 3))
    assert smooth.count() == 5


def test_fractions_of_a_pixel():
    y, x = np.mgrid[0:48, 0:40]
    f = np.fft.fft2(scene(60, (48, 40)))
    ky, kx = np.fft.fftfreq(48)[:, None], np.fft.fftfreq(40)[None, :]
    for dy, dx in ((0, 0), (0.3, -0.7), (2.4, 1.1), (-3.6, 0.5), (-0.2, 5.9)):
        moved = np.fft.ifft2(f * np.exp(-2j * np.pi * (ky * dy + kx * dx))).real
        got = phase.subpixel_shift(moved, np.fft.ifft2(f).real)
        assert got == pytest.approx((dy, dx), abs=0.1001)
    assert phase.subpixel_shift(scene(1), scene(1), 1) == (0, 0)


def test_alignment_fails_over_a_pixel(spark):
    base = scene(61, (32, 32))
    rows = [(k, np.roll(base, m, (0, 1)).ravel().tolist(), base.ravel().tolist()) for k, m in enumerate([(0, 0), (1, 0), (1, 1), (0, -4)])]
    got = R.alignment(spark.createDataFrame(rows, "k int, px array<int>, reference array<int>"), (32, 32), least_corr=0.1).orderBy("k").collect()
    assert [(r.dy, r.dx) for r in got] == [(0, 0), (1, 0), (1, 1), (0, -4)]
    assert [r.aligned for r in got] == [True, got[1].corr >= 0.1, False, False] and got[0].corr == pytest.approx(1)


@pytest.mark.parametrize(("shape", "centres"), [((64, 256), ([32], [64, 128, 192])), ((256, 64), ([64, 128, 192], [32])), ((20, 30), ([5, 10, 15], [8, 22]))])
def test_warps_between_blocks(spark, shape, centres):
    f = [np.arange(k, k + shape[0] * shape[1]).reshape(shape) % 1000 for k in (0, 7)]
    n = len(centres[0]) * len(centres[1])
    rows = [(k, x.ravel().tolist(), [0.0] * n, [0.0] * n) for k, x in enumerate(f)]
    schema = "k int, px array<int>, dys array<float>, dxs array<float>"
    for r in R.warp(spark.createDataFrame(rows, schema), shape, centres).collect():
        assert np.abs(np.array(r.px).reshape(shape) - f[r.k]).max() <= 2
    # A shift that all blocks share moves the whole image; edges repeat.
    r = R.warp(spark.createDataFrame([(0, rows[0][1], [2.0] * n, [-1.0] * n)], schema), shape, centres).first()
    want = f[0][np.clip(np.arange(shape[0]) + 2, 0, shape[0] - 1)][:, np.clip(np.arange(shape[1]) - 1, 0, shape[1] - 1)]
    assert (np.array(r.px).reshape(shape) == want).all()
    # Between two centres the shift runs on a line.
    dy, dx = phase.displacement([0], [0, 10], np.zeros(2), np.array([0.0, 9.0]), (1, 11))
    assert dx[0].tolist() == pytest.approx([*range(10), 9]) and not dy.any()


def test_slices_are_warped_to_their_neighbours(spark):
    shape = (48, 48)
    base = scene(70, shape)
    bent = np.concatenate([np.roll(base, 2, 0)[:, :24], base[:, 24:]], axis=1)
    d = movie(spark, [(0, z, bent if z == 2 else base) for z in range(5)], "stack int, z int")
    out = {r.z: r for r in R.warp_to_neighbours(d, ["stack"], "z", shape, (48, 24), 4).collect()}
    assert sorted(out) == [0, 1, 2, 3, 4]
    error = lambda x: np.abs(np.array(x).reshape(shape)[6:-6, :18] - base[6:-6, :18]).mean()
    assert error(out[2].px) < 0.3 * np.abs(bent - base)[6:-6, :18].mean()
    assert not any(out[0].dys) and not any(out[4].dys)


def loop_volume(x, windows):
    """The filters on padded axes, from the normal equations of each window."""
    for axis, m, order in ((2, max(windows[2], 3), 2), (1, max(windows[1], 3), 2), (0, windows[0], 3)):
        half = m // 2
        a = np.vander(np.arange(-half, half + 1), order + 1, increasing=True).astype(float)
        w = np.linalg.solve(a.T @ a, a.T)[0]
        p = np.pad(x, [(half, half) if k == axis else (0, 0) for k in range(3)], mode="edge")
        x = np.apply_along_axis(lambda v: np.convolve(v, w[::-1], mode="valid"), axis, p)  # noqa: B023
    return x


def test_volumes_are_smoothed_along_three_axes(spark):
    x = np.random.default_rng(9).integers(0, 1000, (9, *SHAPE))
    d = movie(spark, [(s, 3 * z + 1, x[z] + s) for s in (0, 5) for z in range(9)], "stack int, z int").withColumn("note", F.lit("n"))
    for windows in ((5, 3, 7), (7, 1, 5), (11, 3, 3)):
        want = loop_volume(x.astype(float), windows)
        for r in R.smoothed_volume(d, ["stack"], "z", SHAPE, windows).collect():
            assert np.allclose(np.array(r.px).reshape(SHAPE), want[(r.z - 1) // 3] + r.stack) and r.note == "n"
    with pytest.raises(ValueError):
        R.smoothed_volume(d, ["stack"], "z", SHAPE, (4, 3, 3))


def test_next_sample_closes_the_ring(spark):
    d = spark.createDataFrame([("a", p, k, 10.0 * p + k) for p in range(3) for k in range(4)], "ds string, plane int, k int, v double")
    got = {}
    for r in R.with_next_sample(d, ["ds"], "plane", "k", "v").orderBy("k").collect():
        got.setdefault(r.plane, []).append(r.v)
    assert got == {0: [0, 1, 2, 3, 10], 1: [10, 11, 12, 13, 20], 2: [20, 21, 22, 23, 0]}


def test_images_of_a_wrong_size_are_told(spark):
    d = spark.createDataFrame([(0, 0, [1, 2, 3])], "plane int, frame int, px array<int>")
    with pytest.raises(Exception, match="12 x 16"):
        R.mean_image(d, ["plane"], SHAPE).collect()


def test_seeds_of_whole_keys_hand_on_one_number_a_frame(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 16)) + np.outer(rng.normal(size=60), rng.normal(size=16))
    x[5] = 3.0
    d = spark.createDataFrame([(i % 2, i, v.tolist()) for i, v in enumerate(x)], "plane long, frame long, px array<double>")
    monkeypatch.setattr(R, "CHUNK", 100)
    for n in (2, 9, 25, 80):
        want = {r.plane: (r.frame, round(r.score, 9)) for r in R.correlation_seeds(d, ["plane"], "frame", "px", n, 7).collect()}
        got = {r.plane: (r.frame, round(r.score, 9)) for r in R.correlation_seeds(d, ["plane"], "frame", "px", n).collect()}
        assert got == want and len(got) == 2
        for p in (0, 1):
            c = np.corrcoef(np.array([v for i, v in enumerate(x) if i % 2 == p and i != 5]))
            np.fill_diagonal(c, -2)
            assert np.isclose(got[p][1], np.max(-np.sort(-c, axis=1)[:, : min(n - 1, len(c) - 1)].mean(axis=1)), atol=1e-8)
    # A key's frames travel in a bounded number of copies, whatever their number.
    plan = R.correlation_seeds(d, ["plane"], "frame", "px", 25)._jdf.queryExecution().optimizedPlan().toString()
    assert f"least({R.PARTS}" in plan
