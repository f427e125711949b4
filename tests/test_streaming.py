import time

import numpy as np

from tessera.operators.sequence import rising_edges
from tessera.streaming import ingest

SCHEMA = "channel string, t_s double, volts double"


def test_edges_of_a_stream_match_the_batch(spark, tmp_path):
    volts = [0, 0.8, 0.9, 0.1, 0, 0.7, 0.7, 0, 1, 1]
    rows = [(c, i / 10, float(v)) for c in ("a", "b") for i, v in enumerate(volts)]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows[:3] + rows[10:14], rows[3:10] + rows[14:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.2)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    q = ingest.rising_edges(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.channel, r.t_s) for r in spark.read.parquet(out).collect()}
    batch = rising_edges(spark.createDataFrame(rows, SCHEMA), ["channel"], ["t_s"], "volts", 0.5)
    assert got == {(r.channel, r.t_s) for r in batch.collect()}


def test_bouts_and_rollups(spark):
    d = spark.createDataFrame([("a", f"2024-01-01 00:00:{s:02d}", float(v)) for s, v in enumerate([0, 5, 5, 0, 0, 0, 5, 0])], "ds string, ts string, v double")
    d = d.selectExpr("ds", "CAST(ts AS TIMESTAMP) ts", "v AS velocity", "v AS value")
    assert sorted(r.n for r in ingest.running_bouts(d, 1.0).collect()) == [1, 2]
    assert [(r.n, r.mean) for r in ingest.rollup(d).collect()] == [(8, 1.875)]


def chunk_stream(spark, tmp_path, name, batches):
    """The samples of a stream whose micro-batches are these lists of (recording, chunk, content)."""
    schema = "recording string, chunk bigint, content binary"
    src, out = str(tmp_path / f"{name}-in"), str(tmp_path / f"{name}-out")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.2)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = ingest.samples_of_chunks(stream, ["frame", "piezo", "x"], 10.0).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return sorted((r.recording, r.sample, r.channel, r.volts, r.t_s) for r in spark.read.parquet(out).collect())


def test_recordings_cut_at_any_byte_come_out_whole(spark, tmp_path):
    from tessera.sources.interleaved import read_recordings

    raw = {"a": np.arange(31, dtype="<f8").tobytes() + b"xyz", "b": np.arange(100, 124, dtype="<f8").tobytes()}
    for k, v in raw.items():
        (tmp_path / f"{k}.bin").write_bytes(v)
    batch = read_recordings(spark, str(tmp_path / "*.bin"), channels=3, rate=10)
    names = {"0": "frame", "1": "piezo", "2": "x"}
    want = sorted((r.path.split("/")[-1][0], r.sample, names[r.channel], r.volts, r.t_s) for r in batch.collect())
    cut = lambda k, *at: [(k, i, raw[k][a:b]) for i, (a, b) in enumerate(zip((0, *at), (*at, len(raw[k]))))]
    a, b = cut("a", 1, 7, 8, 25, 25, 100, 171), cut("b", 24, 48, 49)
    assert chunk_stream(spark, tmp_path, "in order", [a[:3] + b[:1], a[3:5] + b[1:], a[5:]]) == want
    # Out of order, and some twice.
    assert chunk_stream(spark, tmp_path, "mixed", [a[4:6] + b[2:], a[:1] + a[5:] + b[:1], a[1:5] + b]) == want
