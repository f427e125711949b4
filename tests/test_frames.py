"""Windows whose cost follows the rows: a frame that ends at the last row, or slides over a stretch of time, is worked out anew for each row."""

import re

import numpy as np

from tessera.operators import align, composite, events, sequence


def linear(df):
    """Whether every frame of a query's windows begins at the first row, or is a single row beside the one at hand."""
    frames = re.findall(r"specifiedwindowframe\((?:Row|Range)Frame, ([^,()]+)(?:\(\))?, ([^,()]+)", df._jdf.queryExecution().optimizedPlan().toString())
    assert frames
    return all(a == b or a.startswith("unboundedpreceding") for a, b in frames)


def test_lines_between_known_values_of_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.cumsum(rng.integers(1, 5, 300)).astype(float)
    y = np.where(rng.random(300) < 0.1, rng.normal(size=300), np.nan)
    d = spark.createDataFrame([(a, None if np.isnan(b) else float(b)) for a, b in zip(x.tolist(), y.tolist())], "x double, y double")
    known = np.flatnonzero(~np.isnan(y))
    want = np.interp(x, x[known], y[known])
    want[: known[0]] = want[known[-1] + 1 :] = np.nan
    for block in (7, 1 << 18):
        got = {r.x: r.y for r in composite.between(d, "x", "y", block).collect()}
        np.testing.assert_allclose([np.nan if got[a] is None else got[a] for a in x.tolist()], want)
    monkeypatch.setattr(composite, "written", lambda df, name: df)
    assert linear(composite.between(d, "x", "y", 7))


def test_interpolation_and_next_sample(spark):
    d = spark.range(20).selectExpr("id % 2 AS k", "id AS x", "IF(id % 5 = 0, NULL, id * 1.0D) AS y")
    filled = sequence.interpolate(d, ["k"], "x", "y")
    assert linear(filled)
    assert [r.y for r in filled.filter("k = 1").orderBy("x").collect()] == [1, 3, 5, 7, 9, 11, 13, 15, 17, 19]
    at = align.next_sample(spark.createDataFrame([(0.5,), (3.0,), (19.5,)], "c double"), "c", d, "x", ["x"])
    assert linear(at)
    assert [r.x for r in at.orderBy("c").collect()] == [1, 3, None]


def test_onsets_and_what_is_around_them(spark):
    rng = np.random.default_rng(5)
    # Times repeat and stretches end exactly at their limits.
    rows = [(int(k), float(t), float(v)) for k, t, v in zip(rng.integers(0, 2, 400), np.sort(rng.integers(0, 600, 400)), np.repeat(rng.random(80) > 0.5, 5))]
    d = spark.createDataFrame(rows, "k long, t double, v double").dropDuplicates(["k", "t"]).cache()
    found = events.running_onsets(d, ["k"], "t", "v", 0.5, 4.0, 4.0)
    assert linear(found)
    want = []
    for k in (0, 1):
        s = sorted((r.t, r.v > 0.5) for r in d.filter(f"k = {k}").collect())
        for i, (t, run) in enumerate(s):
            rest, ran = [r for x, r in s if t - 4 <= x < t], [r for x, r in s if t <= x < t + 4]
            if i and run and not s[i - 1][1] and t - s[0][0] >= 4 and s[-1][0] - t >= 4 and rest and not any(rest) and all(ran):
                want.append((k, t))
    assert want and sorted((r.k, r.onset) for r in found.collect()) == want
    signal = spark.createDataFrame([(0, 1.0, 10.0), (0, 3.0, 30.0), (0, 3.5, None), (0, 5.0, 20.0)], "k long, t double, x double")
    at = events.around_events(spark.createDataFrame([(0, 3.0)], "k long, onset double"), "onset", signal, "t", "x", ["k"], [-3, -1, 0, 1, 3])
    assert linear(at)
    assert [r.value for r in at.orderBy("rel").collect()] == [None, 20.0, 30.0, 25.0, None]
