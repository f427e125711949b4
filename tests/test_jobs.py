"""Whole jobs: planes into one movie against NumPy, corrected traces with their provenance, runs that replace only their own data set."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import extraction, planes
from tessera.plans import catalogue, imaging, jobs, run

from .test_registration import loop_reference, one_shift, scene

SHAPE = (32, 32)


def drifting(seed=11, cycles=20, n=4):
    """Planes of one scene that changes with depth; the scene drifts by a plane and moves sideways."""
    r = np.random.default_rng(seed)
    slices = [scene(900 + k, SHAPE) for k in range(n)]
    frames, best = {}, []
    for c in range(cycles):
        drift = (0, 0, 1, 0, -1)[c % 5]
        for p in range(n):
            x = slices[min(n - 1, max(0, p + drift))]
            m = tuple(int(v) for v in r.integers(-2, 3, 2))
            frames[p, c] = np.roll(x, m, (0, 1)) + r.integers(-20, 21, SHAPE)
        best.append(drift)
    return frames


def table(spark, frames, planes=None, bad=()):
    rows = [((planes or {}).get(p, p), c, (p, c) in bad, x.ravel().tolist()) for (p, c), x in frames.items()]
    return spark.createDataFrame(rows, "plane int, frame int, bad boolean, px array<int>")


def rows_right(x, k):
    x, rows = x.copy(), x[1::2].copy()
    if k > 0:
        x[1::2, :-k] = rows[:, k:]
    if k < 0:
        x[1::2, -k:] = rows[:, :k]
    return x


def loop_movie(frames, n, count, n_best, weights=(0.2, 0.6, 0.2), deviations=4.0, bad=()):
    cycles = sorted({c for _, c in frames})
    references = []
    for p in range(n):
        usable = [frames[p, c] for c in cycles if (p, c) not in bad]
        references.append(loop_reference(usable[round(len(usable) / 2) - round(count / 2) : round(len(usable) / 2) + round(count / 2)], n_best))
    references = [np.clip(x, *np.trunc(np.percentile(x, [1, 99]))) for x in references]
    steps = np.cumsum([(0, 0), *[one_shift(b, a)[:2] for a, b in zip(references, references[1:])]], axis=0)
    references = [np.roll(x, tuple(-np.trunc(m).astype(int)), (0, 1)) for x, m in zip(references, steps - np.median(steps, axis=0))]
    found = {(p, c, k): one_shift(frames[p, c], references[k]) for p, c in frames for k in range(n)}
    best = {(c, k): max(range(n), key=lambda p: (found[p, c, k][2], -p)) for c in cycles for k in range(n)}  # noqa: B023
    score = {}
    for k in range(n):
        inside = 0
        for c in cycles:
            s = [best[c, j] - j for j in range(n)]
            inside += (0 <= k + min(s) < n) + (0 <= k + max(s) < n)
        score[k] = (inside, np.mean([found[best[c, k], c, k][2] for c in cycles]), -k)
    ref = max(score, key=score.get)
    low = set()
    for p in range(n):
        x = np.array([found[p, c, ref][2] for c in cycles])
        low |= {(p, c) for c, v in zip(cycles, x) if v <= x.mean() - deviations * x.std()}
    movie = {}
    for c in cycles:
        centre = max(range(n), key=lambda p: (found[p, c, ref][2], -p))  # noqa: B023
        w = {centre + o: v for o, v in zip((-1, 0, 1), weights)}
        zero = [p for p in w if not 0 <= p < n or p != centre and ((p, c) in low or (p, c) in bad)]
        w = {p: v for p, v in w.items() if p not in zero}
        total = sum(w.values()) if zero else 1.0
        movie[c] = (centre, sum(v / total * np.roll(frames[p, c], tuple(-m for m in found[p, c, ref][:2]), (0, 1)).astype(float) for p, v in w.items()))
    return ref, movie, low


def test_planes_are_registered_into_one_movie(spark):
    frames, bad = drifting(), {(1, 3), (2, 10)}
    ids = {0: 1, 1: 2, 2: 4, 3: 7}
    d = table(spark, frames, ids, bad).unionByName(table(spark, {(0, c): scene(5, SHAPE) for c in range(20)}, {0: 9}))
    ref, movie, low = loop_movie(frames, 4, 10, 4, bad=bad)
    out = jobs.register_planes(d, SHAPE, 10, n_best=4, ignore=[9])
    assert out["best"] == ids[ref] and out["planes"] == [1, 2, 4, 7]
    rows = out["movie"].collect()
    assert sorted(r.frame for r in rows) == sorted(movie)
    for r in rows:
        centre, px = movie[r.frame]
        assert r.plane == ids[centre] and np.allclose(np.array(r.px).reshape(SHAPE), px, rtol=1e-5, atol=1e-2)
    assert {(r.plane, r.frame) for r in out["shifts"].filter("bad").collect()} == {(ids[p], c) for p, c in low | bad}
    assert {r.plane for r in out["references"].collect()} == set(ids.values())
    with pytest.raises(ValueError, match="every plane"):
        jobs.positions(d, [1, 2, 4, 7, 9])


def test_weighted_images(spark):
    px = spark.createDataFrame([(0, p, [float(10**p), 1.0]) for p in range(3)], "frame int, plane int, px array<double>")
    near = spark.createDataFrame([(0, 0, 0.25), (0, 1, 0.5), (0, 2, 0.0), (0, 5, 0.3)], "frame int, plane int, weight double")
    assert planes.weighted_images(near, px, ["frame"]).first().px == [5.25, 0.75]
    assert planes.weighted_images(near, px, ["frame"], normalise=True).first().px == [7, 1]


def test_register_job_writes_typed_tables(spark, tmp_path):
    table(spark, drifting(cycles=12)).write.parquet(str(tmp_path / "in" / "frames"))
    d = {"ds": "a", "output": str(tmp_path / "out"), "tables": str(tmp_path / "in"), "shape": list(SHAPE), "count": 6, "n_best": 3, "ignore_planes": [3]}
    m = str(tmp_path / "m")
    assert run.run_all(spark, [d, d | {"ds": "b", "output": str(tmp_path / "out2"), "tables": "/nowhere"}], "register", jobs.register_job, m) == {"a": "complete", "b": "failed"}
    movie = spark.read.parquet(f"{d['output']}/movie")
    assert set(movie.columns) == {"ds", "frame", "plane", "px"} and movie.count() == 12 and movie.select("ds").distinct().first().ds == "a"
    assert set(spark.read.parquet(f"{d['output']}/shifts").columns) == {"ds", "plane", "frame", "dy", "dx", "corr", "bad"}
    rows = spark.read.parquet(f"{d['output']}/planes").collect()
    assert {r.plane for r in rows} == {0, 1, 2} and all(json.loads(r.found)["ignored"] == [3] and json.loads(r.settings)["count"] == 6 for r in rows)


def test_correct_job_chooses_its_rate_and_its_way(spark, sf, tmp_path):
    t = catalogue.traces(spark, sf).select(F.col("roi").cast("int") % 2, "roi", "segment", "frame", "z", "f", "fneu", "value").toDF("plane", "roi", "segment", "frame", "z", "f", "fneu", "value")
    t = t.filter("segment < 3").drop("value")
    src = tmp_path / "in"
    t.write.parquet(str(src / "traces"))
    d = {"ds": "a", "tables": str(src), "planes": 2, "f0_percentile": 8, "f0_window": 10, "fs": 4.0}
    out = str(tmp_path / "out")
    jobs.correct_job(spark, d, out)
    plain = {(r.roi, r.segment, r.frame): r.dff for r in spark.read.parquet(f"{out}/calcium").collect()}
    assert len(plain) == t.count()
    found = [json.loads(r.found) for r in spark.read.parquet(f"{out}/planes").collect()]
    assert len(found) == 2 and all(r["rate_hz"] == 2 and not r["corrected"] and r["depth"] == 0 for r in found)
    # The data set's rate goes before the settings', the clock's before both.
    assert jobs.frame_rate(spark, d | {"frame_rate": 8.0}) == 8
    spark.createDataFrame([(i / 4,) for i in range(50)], "t_s double").write.parquet(str(src / "clock"))
    assert jobs.frame_rate(spark, d | {"frame_rate": 8.0}) == 4
    # With profiles, frames are corrected about the plane's median depth; another data set's rows stay.
    t.groupBy("plane", "roi", "z").agg(F.avg(F.coalesce("f", F.lit(40.0))).alias("value")).write.parquet(str(src / "profiles"))
    jobs.correct_job(spark, d | {"ds": "b", "ignore_planes": [1], "depth": 120, "faults": False}, out)
    both = spark.read.parquet(f"{out}/calcium")
    assert {(r.ds, r.plane) for r in both.select("ds", "plane").distinct().collect()} == {("a", 0), ("a", 1), ("b", 0)}
    b = [json.loads(r.found) for r in spark.read.parquet(f"{out}/planes").filter("ds = 'b'").collect()]
    assert len(b) == 1 and b[0]["corrected"] and b[0]["depth"] == 120 and 5 <= b[0]["reference_depth"] <= 14
    changed = [r for r in both.filter("ds = 'b' AND dff IS NOT NULL").collect() if abs(r.dff - (plain[r.roi, r.segment, r.frame] or 0)) > 1e-6]
    assert changed
    with pytest.raises(ValueError, match="neither"):
        jobs.frame_rate(spark, {"tables": "/nowhere"})


def test_registered_movie_of_the_images(spark, sf):
    every, bad = {}, set()
    for r in imaging.movie(spark, sf).collect():
        every[r.plane, r.frame] = np.array(r.px, dtype=float).reshape(8, 8)
        bad |= {(r.plane, r.frame)} if r.bad else set()
    shortest = min(sum(p == q for q, _ in every) for p in range(10))
    frames = {k: x for k, x in every.items() if k[1] < shortest}
    bad &= set(frames)
    for p in range(10):  # rows are set right by the offset of the frames about the middle
        usable = [frames[p, c] for c in range(shortest) if (p, c) not in bad]
        total = np.zeros(8)
        for x in usable[round(len(usable) / 2) - 8 : round(len(usable) / 2) + 8]:
            a, b = np.fft.fft(x[1::2], axis=1), np.fft.fft(x[::2], axis=1)
            total += np.fft.ifft(a / (np.abs(a) + 1e-5) * np.conj(b / (np.abs(b) + 1e-5)), axis=1).real.mean(axis=0)
        k = min(range(-3, 4), key=lambda k: (-total[k % 8], abs(k), k))  # noqa: B023
        frames |= {(p, c): rows_right(frames[p, c], k) for c in range(shortest)}
    _, want, _ = loop_movie(frames, 10, 16, 5, bad=bad)
    got, centre = {}, {}
    for r in sorted(catalogue.queries()["z_registered_movie"](spark, sf).collect(), key=lambda r: r.i):
        got.setdefault(r.frame, []).append(r.v)
        centre[r.frame] = r.plane
    assert set(got) == set(want)
    same = [c for c in want if centre[c] == want[c][0] and np.allclose(np.array(got[c]).reshape(8, 8), want[c][1], rtol=1e-4, atol=0.05)]
    assert len(same) == len(want)


def test_weights_of_references(spark, sf):
    sums = {}
    for r in imaging.whole_frames(spark, sf).collect():
        sums.setdefault(r.plane, []).append(np.array(r.px, dtype=float).reshape(8, 8))
    means = {p: np.mean(x, axis=0) for p, x in sums.items()}
    peaks = np.array([one_shift(means[p], means[4])[2] for p in (3, 4, 5)])
    got = {r.offset: r.weight for r in catalogue.queries()["reference_weights"](spark, sf).collect()}
    assert [got[o] for o in (-1, 0, 1)] == pytest.approx((peaks / peaks.sum()).tolist(), abs=1e-5)


def test_command_runs_jobs(spark, tmp_path):
    table(spark, drifting(cycles=8, n=2)).write.parquet(str(tmp_path / "in" / "frames"))
    one = {"ds": "a", "job": "register", "output": str(tmp_path / "out"), "tables": str(tmp_path / "in"), "shape": list(SHAPE), "count": 4, "n_best": 2}
    config, m = tmp_path / "c.json", str(tmp_path / "m")
    config.write_text(json.dumps([one]))
    assert run.main([str(config), "--manifests", m], spark) == run.DONE and spark.read.parquet(f"{one['output']}/movie").count() == 8
    for bad in (one | {"job": "none"}, {k: v for k, v in one.items() if k != "shape"}):
        config.write_text(json.dumps([bad]))
        assert run.main([str(config), "--manifests", m, "--check"]) == run.USAGE


def test_unreadable_manifests_stand(spark, tmp_path):
    m = tmp_path / "m"
    m.mkdir()
    (m / "_SUCCESS").write_text("")
    (m / "part-0.parquet").write_text("not a table")
    ran = []
    sets = [{"ds": "a", "output": "/out/a"}]
    assert run.run_all(spark, sets, "w", lambda *_: ran.append(1), str(m)) == {"a": "refused"} and not ran


def test_all_frames_are_not_read_in_every_round_of_a_reference(spark, sf):
    d = imaging.movie(spark, sf).select("plane", "frame", "bad", "px")
    reads, n = spark.sparkContext.accumulator(0), d.count()

    def counted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    extraction.plane_reference(d.mapInArrow(counted, d.schema), ["plane"], "frame", "bad", (8, 8), 16, n_best=5)[0].collect()
    assert n <= reads.value <= 3 * n
