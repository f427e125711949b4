"""Faults that were found once: equal rows, missing segments, single frames, correlations of longer images."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import align, depth, image, planes, registration, sequence, smooth, tables, trace


def test_equal_rows_each_get_the_first_rule(spark):
    df = spark.createDataFrame([(5.0, "a"), (5.0, "a"), (50.0, "b")], "rate double, name string")
    rules = spark.createDataFrame([(2, 0.0, 10.0), (1, 4.0, 6.0)], "rule int, rate_lo double, rate_hi double")
    rows = align.range_rules(df, "rate", rules, first="rule").collect()
    assert sorted([(r.rate, r.rule or 0) for r in rows]) == [(5.0, 1), (5.0, 1), (50.0, 0)]


def test_a_plane_without_a_segment_has_none_of_its_frames(spark):
    rows = [(p, s, t) for p in (0, 1) for s in (0, 1) for t in range(3 + p) if (p, s) != (1, 1)]
    out = sequence.equalise(spark.createDataFrame(rows, "plane int, seg int, t int"), "plane", "seg", ["t"]).collect()
    assert sorted((r.plane, r.seg, r.t) for r in out) == [(p, 0, t) for p in (0, 1) for t in range(3)]


def test_one_best_frame_is_that_frame(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(0, 100, 30)
    frames = [(0, i, (base + rng.normal(0, 1 + 20 * (i != 2), 30)).tolist()) for i in range(5)]
    df = spark.createDataFrame(frames, "plane int, frame int, px array<double>")
    (one,) = registration.initial_reference(df, ["plane"], "frame", "px", (5, 6), n_best=1).collect()
    centred = [np.trunc(np.array(x) - np.mean(x)).astype(int).tolist() for _, _, x in frames]
    assert list(one.px) in centred


def test_most_similar_frames_are_those_of_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (8, 400))
    df = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "plane int, frame int, px array<double>")
    got = image.most_similar(df, ["plane"], "frame", "px", df.filter("frame = 3").select("plane", "px"), 4).orderBy("rank").collect()
    want = np.corrcoef(x)[3]
    order = np.argsort(-want)[:4]
    assert [r.frame for r in got] == order.tolist() and np.allclose([r.corr for r in got], want[order])


def test_blocks_of_a_baseline_change_nothing(spark):
    rng = np.random.default_rng(3)
    rows = [(0, i, float(v) if i % 7 else None, float(i)) for i, v in enumerate(rng.normal(50, 9, 700))]
    d = spark.createDataFrame(rows, "roi int, frame int, f double, n double")
    one = smooth.baselines(d, ["roi"], "frame", {"a": "f", "b": "n"}, 1, 8, 10).orderBy("frame").toPandas()
    cut = smooth.baselines(d, ["roi"], "frame", {"a": "f", "b": "n"}, 1, 8, 10, block=1).orderBy("frame").toPandas()
    assert len(cut) == 700 and np.allclose(one[["a", "b"]], cut[["a", "b"]]) and one.a.notna().all()


def test_selected_ids_must_be_there_once(spark):
    d = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "id int, v string")
    ids = lambda *i: spark.createDataFrame([(x,) for x in i], "id int")
    assert [r.v for r in tables.subset(d, "id", ids(1)).collect()] == ["a"]
    for bad in (2, 3):
        with pytest.raises(Exception, match=f"not exactly one row with id {bad}"):
            tables.subset(d, "id", ids(1, bad)).collect()
    with pytest.raises(Exception, match="no plane 2"):
        tables.index_of(d, "id", spark.createDataFrame([(1, 0.0)], "id int, um double")).collect()


def test_reviewed_rows_that_contradict_each_other(spark):
    d = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "1"), ("b", "2"), ("c", " "), (" ", "1"), ("d", None)], "name string, rate string")
    assert {(r.name, r.conflict) for r in tables.reviewed(d, ["name"], ["rate"]).collect()} == {("a", False), ("b", True)}


def test_planes_go_by_number_and_paths_move(spark):
    d = spark.createDataFrame([(f"/x/plane{i}",) for i in (10, 9, 0)] + [("/x/combined",)], "path string")
    assert [(r.plane, r.position) for r in planes.ordered_planes(d, "path").orderBy("position").collect()] == [(0, 0), (9, 1), (10, 2)]
    p = spark.createDataFrame([("D:/a/raw/m/1.tif",), ("D:/a/m/1.tif",), ("D:/raw",)], "p string")
    assert [r.q for r in p.select(tables.relocated(F.col("p"), "/mnt/raw").alias("q")).collect()] == ["/mnt/raw/m/1.tif", None, "/mnt/raw"]


def test_a_cell_ends_at_the_troughs_around_it():
    x = np.array([1, 2, 4, 6, 4, 2, 1, 2, 4, 8, 8.5, 8, 4, 2, 0.5, 2, 4, 6, 4, 2, 1.0])
    assert trace.fault_limits(x, 9) == (6, 14) and trace.fault_limits(x, 3) == (1, 6) and trace.fault_limits(x, 17) == (15, 20)
    assert trace.fault_limits(np.ones(5), 2) == (0, 4)


def test_faulty_slices_correct_nothing(spark):
    peak = [1, 2, 4, 6, 4, 2, 1, 2, 4, 8, 8.5, 8, 4, 2, 0.5, 2, 4, 6, 4, 2, 1.0]
    profile = spark.createDataFrame([(0, z, float(v)) for z, v in enumerate(peak)], "roi int, z int, value double")
    rng = np.random.default_rng(4)
    rows = [(0, 0, i, 100 + float(rng.normal()), 50 + float(rng.normal()), 3 if i >= 300 else 10) for i in range(400)]
    d = spark.createDataFrame(rows, "roi int, segment int, frame int, f double, fneu double, z int")
    args = (d, profile, ["roi"], "segment", "frame", "z", "z", 10, 1.0, 8, 20)
    whole = trace.correct_traces(*args, faults=False).orderBy("frame").toPandas()
    masked = trace.correct_traces(*args).orderBy("frame").toPandas()
    # Slice 3 belongs to another cell. The factor's filter spreads the gap by eight frames, that of F0 by eighty more.
    assert whole.dff.notna().all() and masked.f[:292].notna().all() and masked.f[292:].isna().all() and masked.fc[:200].notna().all()
    assert np.allclose(whole.f[:292], d.orderBy("frame").toPandas().f[:292]) and np.allclose(whole.f[310:], d.orderBy("frame").toPandas().f[310:] / (6 / 8.5))


def failing(df, message):
    with pytest.raises(Exception, match=message):
        df.collect()


def test_central_frames_are_counted_and_rounded_to_even(spark):
    rows = [(n, i, i % 4 == 3) for n in (20, 21, 23) for i in range(n)]
    df = spark.createDataFrame(rows, "plane int, frame int, bad boolean")
    for count in (2, 4, 5, 7):
        got = {}
        for r in tables.central_frames(df, ["plane"], "frame", "bad", count).collect():
            got.setdefault(r.plane, []).append(r.frame)
        for n in (20, 21, 23):
            usable = [i for i in range(n) if i % 4 != 3]
            want = [usable[k] for k in range(round(len(usable) / 2) - round(count / 2), round(len(usable) / 2) + round(count / 2))]
            assert sorted(got[n]) == want
    failing(tables.central_frames(df, ["plane"], "frame", "bad", 30), "30 frames")


def test_a_conflicting_key_shows_a_row_that_is_there(spark):
    df = spark.createDataFrame([("k", "b", 1), ("k", "a", 9), ("k", " ", 0), ("l", "c", 3)], "key string, x string, y int")
    assert sorted(map(tuple, tables.reviewed(df, ["key"], ["x", "y"]).collect())) == [("k", "a", 9, True), ("l", "c", 3, False)]


def test_unmatched_keys_fail(spark):
    a, b = spark.createDataFrame([(1, "a"), (2, "b")], "k int, a string"), spark.createDataFrame([(1, "x"), (3, "z")], "k int, b string")
    failing(tables.paired(a, b, ["k"]), "only one table has the key")
    assert [tuple(r) for r in tables.paired(a, b, ["k"], unmatched="drop").collect()] == [(1, "a", "x")]
    assert [tuple(r) for r in tables.paired(a.filter("k = 1"), b.filter("k = 1"), ["k"]).collect()] == [(1, "a", "x")]


def test_times_that_samples_do_not_cover_fail(spark):
    samples = spark.createDataFrame([(float(i), i, i * 1.5) for i in range(6)], "t double, i int, v double")
    clock = lambda *ts: spark.createDataFrame([(float(t),) for t in ts], "c double")
    cut = lambda c, **more: align.snippets(c, "c", samples, "t", "i", "v", 3, **more)
    assert sorted((r.c, r.offset, r.v) for r in cut(clock(0.5, 3)).collect()) == [(0.5, 0, 1.5), (0.5, 1, 3), (0.5, 2, 4.5), (3, 0, 4.5), (3, 1, 6), (3, 2, 7.5)]
    failing(cut(clock(1, 4)), "do not cover the time 4")
    failing(cut(clock(9)), "do not cover the time 9")
    assert {r.c for r in cut(clock(1, 4, 9), uncovered="drop").collect()} == {1}


def test_calibration_and_reference_depth_fail_where_nothing_is_known(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "zoom double")
    assert [r.f for r in align.calibrate(df, "zoom", [(1, 10), (3, 30)], "f").collect()] == [10, None, 30]
    failing(align.calibrate(df, "zoom", [(1, 10), (2, 20)], "f"), "outside the calibration")
    assert [r.f for r in align.calibrate(df, "zoom", [(1, 10), (2, 20)], "f", outside="null").collect()] == [10, None, None]
    z = spark.createDataFrame([("a", 3), ("a", 4), ("b", None)], "roi string, z int")
    assert depth.reference_depth(z.filter("roi = 'a'"), "z", ["roi"]).first().reference == 3
    failing(depth.reference_depth(z, "z", ["roi"]), "no depth is known")


@pytest.mark.parametrize(("ac", "planes"), [([9, 1, 5, 2], 2), ([9, 1, 5, 5, 2], 2), ([9, 1, 5, 5, 5, 2], 3), ([9, 1, 5, 5], None), ([9, 8, 7, 7, 6, 8, 8, 3], 5), ([9, 5, 4], None), ([9, 3, 3, 5, 4], 3)])
def test_flat_peaks_lie_at_their_middle(spark, ac, planes):
    assert sequence.plane_count(spark.createDataFrame([(i, float(v)) for i, v in enumerate(ac)], "lag int, ac double")).first().planes == planes


def test_first_rules_are_found_without_a_shuffle(spark):
    df = spark.range(100).selectExpr("id", "id % 2 AS planes", "double(id) AS rate")
    rules = spark.createDataFrame([(0, 2, 0.0, 40.0), (0, 1, 30.0, 99.0), (1, 5, 0.0, 9.0)], "planes bigint, rule int, rate_lo double, rate_hi double")
    d = align.range_rules(df, "rate", rules, on=["planes"], first="rule")
    assert {(r.id, r.rule) for r in d.collect()} == {(i, (1 if i >= 30 else 2) if i % 2 == 0 else 5 if i <= 9 else None) for i in range(100)}
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Window" not in plan


def test_whole_tables_are_numbered_by_ranges(spark):
    df = spark.range(1000).selectExpr("id * 7 % 1000 AS x").repartition(7)
    d = sequence.number_all(df, "x", "at")
    assert all(r.x == r["at"] for r in d.collect()) and d.count() == 1000
    assert [r.x for r in sequence.even_sample(df, "x", 4).orderBy("x").collect()] == [125, 375, 625, 875]
    assert sequence.even_sample(df.filter("x < 3"), "x", 9).count() == 3


def test_autocorrelation_in_blocks(spark):
    x = np.random.default_rng(3).normal(size=230)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double").repartition(5)
    c = x - x.mean()
    for lags, block in ((5, 16), (40, 16), (300, 1 << 14)):
        got = {r.lag: r.ac for r in sequence.autocorrelation(df, "i", "x", lags, block).collect()}
        assert [got[k] for k in range(lags)] == pytest.approx([float(c[: len(c) - k] @ c[k:]) if k < len(c) else 0 for k in range(lags)])


def brute_cycle(samples, clock, planes, spf, width, scale):
    samples, clock = sorted(samples), sorted(clock)
    w = np.hanning(width) if width > 2 else np.ones(width)
    w, half = w / w.sum(), width // 2
    t, v = (np.array([s[k] for s in samples], dtype=float) for k in (0, 1))
    p = np.pad(v, (half, width - 1 - half))
    v = np.array([(p[i : i + width] * w).sum() for i in range(len(v))]) / scale
    n = len(clock)
    stride, out = max(1, round(n / planes / 1000)), {}
    for plane in range(planes):
        use = [f for f in range(planes + plane, n - 1, planes)][::stride]
        paths = [v[(k := int(np.argmax(t >= clock[f]))) : k + spf] for f in use]
        for o in range(spf):
            out[plane, o] = np.mean([x[o] for x in paths])
    low = min(out.values())
    return {k: x - low for k, x in out.items()}


def test_scanner_cycle_equals_a_loop(spark):
    from tessera.operators import composite

    r = np.random.default_rng(4)
    samples = [(i * 0.01, float(np.sin(i / 7) + r.normal(0, 0.1))) for i in range(4000)]
    for clock, planes, block in (([0.3 + 0.11 * k for k in range(300)], 3, 1 << 18), ([0.005 + 0.012 * k for k in range(3200)], 1, 64), ([0.3 + 0.11 * k for k in range(300)], 4, 100)):
        c = spark.createDataFrame([(x,) for x in clock], "t_s double").repartition(3)
        s = spark.createDataFrame(samples, "t_s double, volts double").repartition(4)
        got = {(x.plane, x.offset): x.depth_um for x in composite.piezo_cycle(s, c, planes, 6, 5, 0.25, block=block).collect()}
        want = brute_cycle(samples, clock, planes, 6, 5, 0.25)
        assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    late = spark.createDataFrame([(39.0 + 0.2 * k,) for k in range(20)], "t_s double")
    failing(composite.piezo_cycle(s, late, 2, 6, 5, 0.25), "do not cover")


def test_last_state_of_equal_times(spark):
    from datetime import datetime

    from tessera.plans import manifest

    t = datetime(2024, 1, 1)
    m = spark.createDataFrame([("a", "w", "running", t), ("a", "w", "complete", t), ("a", "w", "failed", t), ("b", "w", "failed", t), ("b", "w", "running", t)], "ds string, workflow string, state string, updated_at timestamp")
    assert sorted((r.ds, r.state) for r in manifest.last_of(m).collect()) == [("a", "complete"), ("b", "failed")]
    assert manifest.with_digest(spark.createDataFrame([(manifest.canonical({"b": 1, "a": [2]}),)], "config string")).first().config_sha256 == manifest.digest({"a": [2], "b": 1})
