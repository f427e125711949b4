"""Recordings read by byte ranges: the golden of a broken-off file, many tasks, labels, globs, channels picked in the reader, round trips."""

import numpy as np
import pytest

from tessera.sources.arrays import read_array
from tessera.sources.interleaved import read_labels, read_recordings, write_recordings


def test_partial_sample_is_dropped(spark, tmp_path):
    (tmp_path / "channels.csv").write_text("frame,piezo\n")
    np.arange(7, dtype="<f8").tofile(tmp_path / "recording.bin")
    d = read_recordings(spark, f"{tmp_path}/recording.bin*", labels="channels.csv", rate=2).orderBy("sample", "channel").collect()
    assert [(r.sample, r.channel, r.volts, r.t_s) for r in d] == [(0, "frame", 0, 0), (0, "piezo", 1, 0), (1, "frame", 2, 0.5), (1, "piezo", 3, 0.5), (2, "frame", 4, 1), (2, "piezo", 5, 1)]
    numbered = read_recordings(spark, f"{tmp_path}/recording.bin", labels="channels.csv", channels=3)
    assert {r.channel for r in numbered.collect()} == {"0", "1", "2"} and numbered.count() == 6


def test_large_recording_is_read_in_many_tasks(spark, tmp_path):
    n = 10_000_000
    x = np.arange(3 * n, dtype="<f8")
    x.tofile(tmp_path / "long.bin")  # 240 MB
    d = read_recordings(spark, str(tmp_path / "long.bin"), channels=3, rate=1000, rangebytes=16 << 20)
    assert d.rdd.getNumPartitions() == 15
    one = d.filter("channel = '1'")
    row = one.selectExpr("count(*) n", "sum(volts) s", "max(abs(volts - 3 * sample - 1)) off", "max(t_s) t").first()
    assert (row.n, row.s, row.off, row.t) == (n, x[1::3].sum(), 0, (n - 1) / 1000)


def test_channels_are_picked_in_the_reader(spark, tmp_path):
    (tmp_path / "labels.csv").write_text("a\nb\nc d\n")
    assert read_labels(str(tmp_path / "labels.csv")) == ["a", "b", "c d"]
    np.arange(12, dtype="<f8").tofile(tmp_path / "r.bin")
    d = read_recordings(spark, str(tmp_path / "r.bin"), labels="labels.csv")
    picked = d.filter("channel IN ('b', 'c d') AND sample > 1")
    assert sorted((r.sample, r.channel, r.volts) for r in picked.collect()) == [(2, "b", 7), (2, "c d", 8), (3, "b", 10), (3, "c d", 11)]
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "channel" not in "".join(line for line in plan.splitlines() if line.strip().startswith(("Filter", "*(1) Filter")))  # the reader took it
    assert d.filter("channel = 'z'").count() == 0


def test_globs_folders_and_the_first_match(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in "cab":
        np.full(4, ord(k), dtype="<f8").tofile(tmp_path / "in" / f"rec-{k}.bin")
    (tmp_path / "in" / "_note").write_text("not a recording")
    (tmp_path / "in" / "other.txt").write_text("x" * 64)
    values = lambda d: sorted({chr(int(r.volts)) for r in d.collect()})
    assert values(read_recordings(spark, f"{tmp_path}/in/rec-*", channels=2)) == ["a", "b", "c"]
    assert values(read_recordings(spark, f"{tmp_path}/*/rec-?.bin", channels=2)) == ["a", "b", "c"]
    assert values(read_recordings(spark, f"file://{tmp_path}/in/rec-*", channels=2)) == ["a", "b", "c"]
    assert values(read_recordings(spark, f"{tmp_path}/in/rec-*", channels=2, first=True)) == ["a"]
    assert read_recordings(spark, f"{tmp_path}/in", channels=2).select("path").distinct().count() == 4


def test_faults_are_told(spark, tmp_path):
    np.arange(2, dtype="<f8").tofile(tmp_path / "r.bin")
    for path, options, message in (
        ("r.bin", {"channels": 3}, "fewer than"),
        ("r.bin", {"channels": 0}, "at least 1"),
        ("r.bin", {"channels": 1, "rate": 0}, "greater than zero"),
        ("r.bin", {"labels": "none.csv"}, "no channel file"),
        ("r.bin", {}, "labels or a number"),
        ("nothing*", {"channels": 1}, "no recording"),
    ):
        with pytest.raises(Exception, match=message):
            read_recordings(spark, f"{tmp_path}/{path}", **options).collect()


def test_what_is_written_is_read(spark, tmp_path):
    d = spark.range(1000).selectExpr("id", "id * 0.5 AS half", "IF(id % 7 = 0, NULL, float(id)) AS gaps").repartition(4)
    write_recordings(d, str(tmp_path / "out"))
    back = read_recordings(spark, f"{tmp_path}/out/*.bin", labels="channels.csv").groupBy("path", "sample").pivot("channel", ["id", "half", "gaps"]).max("volts").collect()
    assert len(back) == 1000 and len({r.path for r in back}) == 4
    assert all(r.half == r.id / 2 and (np.isnan(r.gaps) if r.id % 7 == 0 else r.gaps == r.id) for r in back)
    with pytest.raises(Exception, match="numbers"):
        write_recordings(spark.createDataFrame([("x",)], "a string"), str(tmp_path / "no"))


def cells(d):
    return {(r.row, r.col): r.value for r in d.collect()}


def test_arrays_are_read_by_ranges(spark, tmp_path):
    x = np.arange(300_000, dtype="int32").reshape(3000, 100)
    for name, y in (("c", x), ("f", np.asfortranarray(x.astype(float))), ("flat", np.arange(50_000, dtype=">f4")), ("bool", np.array([[True, False]])), ("none", np.zeros((0, 3)))):
        np.save(tmp_path / f"{name}.npy", y)
    for name in "cf":
        d = read_array(spark, str(tmp_path / f"{name}.npy"), rank=2, rangebytes=100_000)
        assert d.rdd.getNumPartitions() > 10
        assert d.selectExpr("count(*) n", "max(abs(value - row * 100 - col)) off").first() == (300_000, 0)
    flat = read_array(spark, str(tmp_path / "flat.npy"), rangebytes=50_000)
    assert flat.rdd.getNumPartitions() == 4 and flat.selectExpr("count(*)", "max(abs(value - col))", "max(row)").first() == (50_000, 0, 0)
    assert cells(read_array(spark, str(tmp_path / "bool.npy"))) == {(0, 0): 1, (0, 1): 0} and read_array(spark, str(tmp_path / "none.npy")).count() == 0


def test_arrays_that_are_not_fit_fail(spark, tmp_path):
    np.save(tmp_path / "three.npy", np.zeros((2, 2, 2)))
    np.save(tmp_path / "nan.npy", np.array([[1.0, np.nan]]))
    np.save(tmp_path / "objects.npy", np.array([{"a": 1}]), allow_pickle=True)
    (tmp_path / "text.npy").write_text("no array")
    (tmp_path / "cut.npy").write_bytes((tmp_path / "three.npy").read_bytes()[:-8].replace(b"(2, 2, 2)", b"(2, 4)   "))
    assert cells(read_array(spark, str(tmp_path / "nan.npy"))) == {(0, 0): 1, (0, 1): None}
    for name, options, message in (("three", {}, "3 dimensions"), ("nan", {"rank": 1}, "2 dimensions"), ("nan", {"finite": True}, "not finite"), ("objects", {}, "not numbers"), ("text", {}, "no array"), ("cut", {}, "cut off"), ("missing", {}, "no array matches")):
        with pytest.raises(Exception, match=message):
            read_array(spark, str(tmp_path / f"{name}.npy"), **options).collect()


def test_channels_side_by_side_are_not_shuffled(spark, tmp_path):
    from tessera.sources.interleaved import read_recordings, write_recordings

    d = spark.range(1000).selectExpr("id AS a", "IF(id % 7 = 0, NULL, id / 3.0D) AS `b c`", "-id AS d").repartition(3)
    write_recordings(d, str(tmp_path / "r"))
    long = read_recordings(spark, f"{tmp_path}/r/*.bin", labels="channels.csv", rangebytes=1000)
    wide = read_recordings(spark, f"{tmp_path}/r/*.bin", labels="channels.csv", rangebytes=1000, wide=True)
    assert wide.columns == ["path", "sample", "t_s", "a", "b c", "d"]
    assert "Exchange" not in wide._jdf.queryExecution().executedPlan().toString()
    got = {(r.path, r.sample, r.t_s, c): str(r[c]) for r in wide.collect() for c in ("a", "b c", "d")}
    assert got == {(r.path, r.sample, r.t_s, r.channel): str(r.volts) for r in long.collect()} and len(got) == 3000
    assert sorted(r.a for r in wide.filter("a >= 990").collect()) == list(range(990, 1000))
