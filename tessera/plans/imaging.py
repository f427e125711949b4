"""Queries over whole images, recordings and streams: registration, stacks, warps, volumes. The driver's embeddings are images of 8 x 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import composite, depth, extraction, image, planes, profiles, registration, sequence, tables
from ..sources.interleaved import read_recordings, write_recordings
from ..sources.shared import shared_path, written
from ..streaming import ingest
from .bindings import TRACE_SQL, frames, read, seconds
from .bindings import trace as traces
from .catalogue import _base_sql, query

SHAPE = (8, 8)


def whole_frames(spark: SparkSession, sf: str) -> DataFrame:
    """frame, plane, px in whole thousandths."""
    return frames(spark, sf).withColumn("px", F.transform("px", lambda v: F.round(v.cast("double") * 1000).cast("int")))


def stack(spark: SparkSession, sf: str) -> DataFrame:
    """plane, z, px: the frames of a plane as the slices of a stack."""
    return sequence.number(whole_frames(spark, sf), ["plane"], ["frame"], "z").select("plane", "z", "px")


def pixels(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode("px").alias("i", "v"))


@query("""SELECT vec_id AS frame, i, round(embedding[((i // 8 + dy + 8) % 8 * 8 + (i % 8 + dx + 8) % 8 + 1)::INT]::DOUBLE, 6) AS v
    FROM (SELECT *, vec_id % 7 - 3 AS dy, label::BIGINT % 5 - 2 AS dx FROM embeddings), range(64) r(i)""")
def shifted_movie(spark, sf):
    f = frames(spark, sf)
    return pixels(registration.shifted(f, f.select("frame", (F.col("frame") % 7 - 3).alias("dy"), (F.col("plane") % 5 - 2).alias("dx")), ["frame"], SHAPE), "frame")


@query()
def iterated_reference(spark, sf):
    return pixels(registration.iterated_reference(whole_frames(spark, sf), ["plane"], "frame", SHAPE), "plane")


@query()
def aligned_slices(spark, sf):
    """The shifts that align each stack's slices to one another, and each slice's first pixel after them."""
    out, shifts = registration.register_across(stack(spark, sf), ["plane"], "z", SHAPE)
    return shifts.join(out.select("plane", "z", F.get("px", F.lit(0)).alias("corner")), ["plane", "z"])


@query()
def repetition_means(spark, sf):
    """Each plane's frames as repetitions of three slices, registered within their slice and averaged."""
    means, _ = registration.register_repetitions(whole_frames(spark, sf).withColumn("z", F.col("frame") % 3), ["plane"], "z", "frame", SHAPE)
    return pixels(means, "plane", "z")


@query()
def stack_to_movie(spark, sf):
    """The slice of each stack that fits the plane's clipped mean image best, and its shift."""
    s = stack(spark, sf)
    target = registration.clipped(registration.mean_image(s, ["plane"], SHAPE), "px")
    return registration.register_to_image(s, target, ["plane"], "z", SHAPE)[1]


@query("""WITH v AS (SELECT vec_id AS frame, unnest(range(64)) AS i, round(unnest(embedding)::DOUBLE * 1000) AS v FROM embeddings),
    q AS (SELECT frame, trunc(quantile_cont(v, 0.01)) AS lo, trunc(quantile_cont(v, 0.99)) AS hi FROM v GROUP BY frame)
    SELECT frame, i, least(greatest(v, lo), hi) AS v FROM v JOIN q USING (frame)""")
def clipped_references(spark, sf):
    return pixels(registration.clipped(whole_frames(spark, sf), "px"), "frame")


@query()
def subpixel_alignment(spark, sf):
    """Each frame against the one before it in its plane, to a tenth of a pixel."""
    s = stack(spark, sf)
    pairs = s.join(s.select("plane", (F.col("z") + 1).alias("z"), F.col("px").alias("reference")), ["plane", "z"])
    return registration.alignment(pairs, SHAPE)


@query("""WITH f AS (SELECT vec_id AS frame, embedding AS e, (vec_id % 3 - 1)::DOUBLE AS a, (vec_id % 5) * 0.5 - 1 AS b FROM embeddings),
    g AS (SELECT f.*, i, i // 8 AS y, i % 8 AS x, least(1, greatest(0, (i % 8 - 2) / 3.0)) AS t FROM f, range(64) r(i)),
    d AS (SELECT frame, i, e, least(7, greatest(0, y + a + (b - a) * t)) AS y, least(7, greatest(0, x + b + (-a - b) * t)) AS x FROM g),
    c AS (SELECT *, floor(y)::INT AS y0, floor(x)::INT AS x0, least(7, floor(y)::INT + 1) AS y1, least(7, floor(x)::INT + 1) AS x1, y - floor(y) AS p, x - floor(x) AS q FROM d)
    SELECT frame, i, round((e[y0 * 8 + x0 + 1]::DOUBLE * (1 - q) + e[y0 * 8 + x1 + 1]::DOUBLE * q) * (1 - p) + (e[y1 * 8 + x0 + 1]::DOUBLE * (1 - q) + e[y1 * 8 + x1 + 1]::DOUBLE * q) * p, 6) AS v FROM c""")
def block_warp(spark, sf):
    """Two blocks side by side, each with a shift of its own."""
    a, b = (F.col("frame") % 3 - 1).cast("float"), ((F.col("frame") % 5) * 0.5 - 1).cast("float")
    d = frames(spark, sf).withColumns({"dys": F.array(a, b), "dxs": F.array(b, -a)})
    return pixels(registration.warp(d, SHAPE, ([4], [2, 6]), whole=False), "frame")


WINDOWS = (5, 3, 5)


def _taps(m: int) -> str:
    """Offsets and weights of a quadratic or cubic Savitzky-Golay filter in closed form."""
    return f"(SELECT o, ((3 * {m * m} - 7 - 20 * o * o) / 4.0) / ({m} * ({m * m} - 4) / 3.0) AS w FROM range({-(m // 2)}, {m // 2 + 1}) r(o))"


@query(f"""WITH p AS (SELECT label::BIGINT AS plane, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS z, count(*) OVER (PARTITION BY label) AS m, embedding FROM embeddings),
    v AS (SELECT plane, z, m, unnest(range(64)) AS i, round(unnest(embedding)::DOUBLE * 1000) AS v FROM p),
    sx AS (SELECT t.plane, t.z, t.m, t.i, sum(w * s.v) AS v FROM v t CROSS JOIN {_taps(WINDOWS[2])} JOIN v s ON s.plane = t.plane AND s.z = t.z AND s.i = t.i // 8 * 8 + greatest(0, least(7, t.i % 8 + o)) GROUP BY ALL),
    sy AS (SELECT t.plane, t.z, t.m, t.i, sum(w * s.v) AS v FROM sx t CROSS JOIN {_taps(WINDOWS[1])} JOIN sx s ON s.plane = t.plane AND s.z = t.z AND s.i = greatest(0, least(7, t.i // 8 + o)) * 8 + t.i % 8 GROUP BY ALL)
    SELECT t.plane, t.z, t.i, round(sum(w * s.v), 6) AS v FROM sy t CROSS JOIN {_taps(WINDOWS[0])} JOIN sy s ON s.plane = t.plane AND s.i = t.i AND s.z = greatest(0, least(t.m - 1, t.z + o)) GROUP BY ALL""")
def smoothed_volume(spark, sf):
    return pixels(registration.smoothed_volume(stack(spark, sf), ["plane"], "z", SHAPE, WINDOWS), "plane", "z")


@query(f"""WITH {TRACE_SQL}, f AS (SELECT segment, roi, value FROM tr WHERE frame = 0),
    r AS (SELECT segment, roi, CASE WHEN row_number() OVER w = count(*) OVER (PARTITION BY segment) THEN first_value(value) OVER w ELSE lead(value) OVER w END AS value FROM f WINDOW w AS (PARTITION BY segment ORDER BY roi)),
    m AS (SELECT segment, roi, max(frame) + 1 AS frame FROM tr GROUP BY ALL)
    SELECT segment, roi, frame, round(value, 6) AS value FROM tr UNION ALL SELECT segment, roi, frame, round(value, 6) FROM r JOIN m USING (segment, roi)""")
def next_plane_sample(spark, sf):
    return registration.with_next_sample(traces(spark, sf), ["segment"], "roi", "frame", "value")


# Histograms over edges from the data


@query(f"""WITH v AS (SELECT c_acctbal AS x FROM customer UNION ALL SELECT c_acctbal - 2500 FROM customer),
    s AS (SELECT count(*) AS n, least(0, min(x)) AS lo, greatest(0, max(x)) AS hi, max(x) - min(x) AS span, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM v),
    w AS (SELECT *, least(greatest(2 * iqr * pow(n, -1.0 / 3), span / sqrt(n) / 2), span / (log2(n) + 1)) AS width FROM s),
    b AS (SELECT *, least({profiles.MOST_BINS}, ceil((hi - lo) / width))::BIGINT AS m FROM w),
    e AS (SELECT list_sort(list_distinct(list_concat(list_transform(range(m), lambda i: lo + i * ((hi - lo) / m)), [hi, 0.0]))) AS e FROM b),
    h AS (SELECT least(len(list_filter(e, lambda y: y <= x)), len(e) - 1) - 1 AS bin, count(*) AS n FROM v, e GROUP BY 1)
    SELECT bin, round(e[bin + 1], 6) AS start, n, round(100.0 * n / sum(n) OVER (), 6) AS percent FROM h, e""")
def histogram_auto(spark, sf):
    d = read(spark, sf, "customer").select("c_acctbal", (F.col("c_acctbal") - 2500).alias("lower"))
    edges = profiles.automatic_edges(d, "c_acctbal", "lower")
    both = d.select(F.explode(F.array("c_acctbal", "lower")).alias("x"))
    return profiles.histogram(both, "x", edges).withColumn("start", F.get(F.array(*[F.lit(x) for x in edges]), F.col("bin")))


# Recordings


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(l_quantity, 6) AS l_quantity, round(l_extendedprice, 6) AS l_extendedprice FROM lineitem")
def recorded_round_trip(spark, sf):
    """The table as interleaved recordings, one of each partition, read back by byte ranges with their channels side by side."""
    names = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"]
    path = shared_path(spark, "recordings")
    write_recordings(read(spark, sf, "lineitem").select(names), path)
    wide = read_recordings(spark, f"{path}/*.bin", labels="channels.csv", rangebytes=1 << 20, wide=True)
    return wide.select(*[F.col(c).cast("long").alias(c) for c in names[:2]], *names[2:])


ROWS, CUTS = 1000, (1001, 2003)


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """recording, chunk, content: the values of each kind of event in order of id, as bytes cut inside samples."""
    d = sequence.number(read(spark, sf, "events").select("event_type", "event_id", "value"), ["event_type"], ["event_id"], "at").withColumn("part", F.expr(f"at div {ROWS}"))

    def cut(pdf):
        raw = pdf.sort_values("at")["value"].to_numpy(dtype="<f8").tobytes()
        ends = [0, *CUTS, len(raw)]
        k = int(pdf["part"].iloc[0]) * (len(CUTS) + 1)
        return type(pdf)({"recording": pdf["event_type"].iloc[0], "chunk": range(k, k + len(CUTS) + 1), "content": [raw[min(a, len(raw)) : min(b, len(raw))] for a, b in zip(ends, ends[1:])]})

    return d.groupBy("event_type", "part").applyInPandas(cut, "recording string, chunk bigint, content binary")


@query("""SELECT event_type AS recording, sample, round(sample / 1000.0, 6) AS t_s, 'value' AS channel, round(value, 6) AS volts
    FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS sample FROM events)""")
def streamed_samples(spark, sf):
    """A stream of chunks that end inside samples, brought back to samples by the state of each recording."""
    source, out, marks = (shared_path(spark, f"stream-{n}") for n in ("chunks", "samples", "checkpoint"))
    chunks(spark, sf).write.parquet(source)
    stream = spark.readStream.schema("recording string, chunk bigint, content binary").option("maxFilesPerTrigger", 4).parquet(source)
    q = ingest.samples_of_chunks(stream, ["value"], 1000.0).writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)


# Traces from movies

DARK = -500.0


def movie(spark: SparkSession, sf: str) -> DataFrame:
    """plane, segment, frame (numbered in its plane), bad, px, and the frame's own shift."""
    d = sequence.number(whole_frames(spark, sf).withColumnRenamed("frame", "id"), ["plane"], ["id"], "frame")
    return d.withColumns({"segment": F.lit(0).cast("long"), "bad": F.col("id") % 11 == 0, "dy": F.col("id") % 7 - 3, "dx": F.col("plane") % 5 - 2})


def masks(spark: SparkSession) -> DataFrame:
    """Four cells of five pixels whose weights fall, each with sixteen pixels of neuropil."""
    cells = spark.range(20).selectExpr("id div 5 AS roi", "false AS neuropil", "id div 5 * 7 + id % 5 AS i", "1.0D / (id % 5 + 1) AS w")
    return cells.unionByName(spark.range(64).selectExpr("id % 4 AS roi", "true AS neuropil", "id AS i", "1.0D AS w"))


_MOVIE_SQL = """mv AS (SELECT label::BIGINT AS plane, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, vec_id % 11 = 0 AS bad, vec_id % 7 - 3 AS dy, label::BIGINT % 5 - 2 AS dx, embedding FROM embeddings),
    px AS MATERIALIZED (SELECT plane, frame, bad, unnest(range(64)) AS i, unnest(list_transform(range(64), lambda i: round(embedding[((i // 8 + dy + 8) % 8 * 8 + (i % 8 + dx + 8) % 8 + 1)::INT]::DOUBLE * 1000))) AS v FROM mv),
    ce AS (SELECT r AS roi, r * 7 + j AS i, 1.0::DOUBLE / (j + 1) AS w FROM range(4) a(r), range(5) b(j))"""


@query(f"""WITH {_MOVIE_SQL},
    sf AS (SELECT plane, frame, bad, roi, sum(w * v) AS f FROM px JOIN ce USING (i) WHERE roi <> 2 GROUP BY ALL), sn AS (SELECT plane, frame, i % 4 AS roi, avg(v) AS n FROM px GROUP BY ALL),
    tr AS (SELECT sf.plane * 10 + sf.roi AS roi, 0::BIGINT AS segment, sf.frame, CASE WHEN NOT bad THEN f + 500 END AS f, CASE WHEN NOT bad THEN n + 500 END AS fneu FROM sf JOIN sn ON sn.plane = sf.plane AND sn.frame = sf.frame AND sn.roi = sf.roi),
    {_base_sql("tr")} SELECT roi, frame, round(f, 6) AS f, round(f0, 6) AS f0, round(f - (slope * (fneu - n0) + intercept), 6) AS fc, round((f - (slope * (fneu - n0) + intercept) - f0) / greatest(1, f0), 6) AS dff FROM c LEFT JOIN r USING (roi)""")
def control_traces(spark, sf):
    """The frames read through their shifts, extracted under three of four masks, to dF/F."""
    d = movie(spark, sf)
    shifts = d.select("plane", "segment", "frame", "dy", "dx")
    accepted = spark.createDataFrame([(0,), (1,), (3,)], "roi long")
    t = extraction.control_traces(d.drop("dy", "dx", "id"), shifts, masks(spark), accepted, ["plane"], "segment", "frame", "bad", SHAPE, DARK, rate=2.0, percentile=8, window_s=10)
    return t.select((F.col("plane") * 10 + F.col("roi")).alias("roi"), "frame", "f", "f0", "fc", "dff")


@query("""WITH v AS (SELECT label::BIGINT AS plane, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS cycle, embedding AS e FROM embeddings),
    m AS (SELECT cycle, plane, list_sum(list_transform(e, lambda x: round(x::DOUBLE * 1000))) AS s FROM v),
    b AS (SELECT cycle, plane AS best_plane FROM (SELECT *, row_number() OVER (PARTITION BY cycle ORDER BY s DESC, plane) AS r FROM m) WHERE r = 1),
    f AS (SELECT plane, cycle, r AS roi, sum(round(e[(r * 7 + j + 1)::INT]::DOUBLE * 1000) / (j + 1)) AS f FROM v, range(4) a(r), range(5) b(j) GROUP BY ALL),
    p AS (SELECT roi, plane - best_plane AS depth, quantile_cont(f, 0.5) AS value, count(*) AS n FROM f JOIN b USING (cycle) GROUP BY ALL HAVING count(*) >= 2),
    z AS (SELECT roi, value AS base FROM p WHERE depth = 0)
    SELECT roi, depth, round(value, 6) AS value, n, round(CASE WHEN base > 0 THEN value / base END, 6) AS relative FROM p LEFT JOIN z USING (roi)""")
def plane_profiles(spark, sf):
    """Profiles over planes about each cycle's brightest plane, from the pixels of all planes."""
    d = movie(spark, sf).withColumnRenamed("frame", "cycle")
    bright = d.select("cycle", "plane", F.aggregate("px", F.lit(0).cast("long"), lambda s, v: s + v).alias("s"))
    best = depth.argmax(bright, ["cycle"], "plane", "s").select("cycle", F.col("plane").alias("best_plane"))
    return extraction.plane_profiles(d, masks(spark), best, [], "cycle", "plane", SHAPE, least=2)


@query(f"""WITH {TRACE_SQL}, p AS (SELECT roi, z, quantile_cont(f, 0.5) AS value, count(f) AS n FROM tr GROUP BY ALL HAVING count(f) >= 40), k AS (SELECT DISTINCT roi FROM p), d AS (SELECT DISTINCT z FROM tr)
    SELECT k.roi, d.z, round(value, 6) AS value, coalesce(n, 0) AS n FROM k CROSS JOIN d LEFT JOIN p ON p.roi = k.roi AND p.z = d.z""")
def profile_over_all_depths(spark, sf):
    t = traces(spark, sf)
    return extraction.complete_profile(profiles.depth_profile(t, ["roi"], "z", "f", 0.5, 40), ["roi"], "z", t.select("z"))


@query()
def plane_reference(spark, sf):
    """Each plane's reference from sixteen usable frames about its middle, and its rows' offset."""
    references, offsets = extraction.plane_reference(movie(spark, sf), ["plane"], "frame", "bad", SHAPE, 16, n_best=5)
    return pixels(references, "plane").join(offsets, "plane")


@query()
def depth_ground_truth(spark, sf):
    """Depths told by every fourth signup, against a scanner whose path is the events' values."""
    e = read(spark, sf, "events").select("event_id", "event_type", seconds("ts").alias("t_s"), F.col("value").alias("volts"), (F.get_json_object("props", "$.k").cast("long") % 20).alias("z"))
    clock = e.filter("event_type = 'signup'")
    at = sequence.number_all(clock.select("t_s", "z"), "t_s", "frame")
    estimates = at.select((F.col("frame") % 4).alias("plane"), F.expr("frame div 4").alias("cycle"), F.when(F.col("z") != 0, F.col("z").cast("double")).alias("z"))
    return composite.depth_errors(e, clock, estimates, 4, 3, 5, 0.5, 2.0, end=1e12)


@query()
def depth_search(spark, sf):
    """Each cell's best slice by day, from slices 8 to 12 on and as many more as best slices at an edge ask for."""
    t = traces(spark, sf).select(F.col("roi").alias("segment"), F.day("ts").alias("frame"), "z", "value")
    corr = written(t.groupBy("segment", "frame", "z").agg(F.avg("value").alias("corr")), "slices")
    found, rounds = depth.search(lambda slices: corr.filter(F.col("z").isin(slices)), 20, 10, 2, 0.0, written)
    return found.withColumn("rounds", F.lit(rounds))


@query()
def z_registered_movie(spark, sf):
    """The planes' frames as cycles of a scanner, registered into one movie."""
    from .jobs import register_planes

    d = written(tables.trim_to_shortest(movie(spark, sf), ["plane"], "frame").select("plane", "frame", "bad", "px"), "movie")
    return pixels(register_planes(d, SHAPE, 16, n_best=5)["movie"], "frame", "plane")


@query()
def reference_weights(spark, sf):
    """How much the neighbours of plane 4 resemble it: the peaks of their mean images' phase correlation, scaled to one."""
    means = written(registration.mean_image(whole_frames(spark, sf), ["plane"], SHAPE), "means")
    best = means.filter("plane = 4").select(F.lit(4).alias("ref"), "px")
    corr = image.register(means, best, SHAPE).select("plane", F.col("peak").alias("corr"))
    return planes.similarity_weights(corr, 4)
