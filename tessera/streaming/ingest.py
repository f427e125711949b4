"""Streaming ingest: frame clocks from a stream of samples, bouts of running, rollups of traces."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rising_edges(samples: DataFrame, threshold: float = 0.5) -> DataFrame:
    """channel, t_s of each rise over the threshold (samples: channel, t_s, volts, arriving in order of time in a channel).

    The state of a channel is whether its last sample was high.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(batches).sort_values("t_s")
        high = (pdf["volts"] > threshold).to_numpy()
        was = bool(state.get[0]) if state.exists else False
        before = [was, *high[:-1]]
        state.update((bool(high[-1]),))
        yield pd.DataFrame({"channel": key[0], "t_s": pdf["t_s"].to_numpy()[high & ~pd.Series(before, dtype=bool).to_numpy()]})

    return samples.groupBy("channel").applyInPandasWithState(run, "channel string, t_s double", "high boolean", "append", GroupStateTimeout.NoTimeout)


def running_bouts(samples: DataFrame, threshold: float, gap: str = "2 seconds", watermark: str = "1 minute") -> DataFrame:
    """ds, start, stop, n: sessions of running samples (samples: ds, ts, velocity)."""
    run = samples.withWatermark("ts", watermark).filter(F.col("velocity") > threshold)
    b = run.groupBy("ds", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return b.select("ds", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def rollup(samples: DataFrame, width: str = "1 minute", watermark: str = "1 minute") -> DataFrame:
    """ds, start, mean, n over tumbling windows; samples later than the watermark are left out."""
    g = samples.withWatermark("ts", watermark).groupBy("ds", F.window("ts", width).alias("w")).agg(F.avg("value").alias("mean"), F.count("value").alias("n"))
    return g.select("ds", F.col("w.start").alias("start"), "mean", "n")


def samples_of_chunks(chunks: DataFrame, channels: list[str], rate: float) -> DataFrame:
    """recording, sample, t_s, channel, volts from a recording's bytes as they arrive (chunks: recording, chunk, content; numbered from 0).

    A chunk may end inside a sample: its last bytes are kept as state and go before the next chunk's. Chunks that arrive early wait for
    those before them, repeated ones are dropped. What is left of a sample when a recording ends never comes out, as in a batch.
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    if rate <= 0 or not channels:
        raise ValueError("a recording has a positive rate and channels")
    n, names = len(channels), np.array(channels, dtype=object)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        following, samples, tail, numbers, held = state.get if state.exists else (0, 0, b"", [], [])
        waiting = dict(zip(numbers, held))
        for pdf in batches:
            waiting |= {int(c): bytes(b) for c, b in zip(pdf["chunk"], pdf["content"]) if c >= following}
        parts = [bytes(tail)]
        while following in waiting:
            parts.append(bytes(waiting.pop(following)))
            following += 1
        raw = b"".join(parts)
        m = len(raw) // (8 * n)
        state.update((following, samples + m, raw[8 * n * m :], sorted(waiting), [waiting[k] for k in sorted(waiting)]))
        if m:
            at = np.repeat(np.arange(samples, samples + m), n)
            yield pd.DataFrame({"recording": key[0], "sample": at, "t_s": at / rate, "channel": np.tile(names, m), "volts": np.frombuffer(raw, dtype="<f8", count=n * m)})

    out = "recording string, sample bigint, t_s double, channel string, volts double"
    kept = "following bigint, samples bigint, tail binary, numbers array<bigint>, held array<binary>"
    return chunks.groupBy("recording").applyInPandasWithState(run, out, kept, "append", GroupStateTimeout.NoTimeout)
