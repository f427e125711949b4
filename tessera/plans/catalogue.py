"""The named queries and their DuckDB forms: each operator bound to the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.kernels import savitzky_golay
from ..operators import align, composite, depth, events, image, planes, profiles, registration, sequence, smooth, tables, trace
from . import manifest
from .bindings import PLANES, REFERENCE_SQL, TRACE_SQL, frames, planes_of_reference, read, reference_correlations, seconds, tidy
from .bindings import trace as traces

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
KEYS = ["roi", "segment"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = lambda spark, sf_dir: tidy(f(spark, sf_dir))
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def values(spark: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def r6(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c.split('.')[-1]}" for c in columns)


# Selections


@query("SELECT o_orderkey, o_custkey, round(o_totalprice, 6) AS o_totalprice FROM orders WHERE o_orderstatus = 'O'")
def select_process_rows(spark, sf):
    return read(spark, sf, "orders").filter("o_orderstatus = 'O'").select("o_orderkey", "o_custkey", "o_totalprice")


@query(f"WITH {TRACE_SQL} SELECT roi, segment, frame, bad, {r6('f')} FROM tr")
def bad_frame_mask(spark, sf):
    d = traces(spark, sf)
    return trace.mask_bad(d.withColumn("f", F.col("value")), "f", F.col("bad")).select(*KEYS, "frame", "bad", "f")


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def accepted_roi_semi(spark, sf):
    good = read(spark, sf, "labels").filter("quality = 1").select("doc_id")
    return read(spark, sf, "documents").join(good, "doc_id", "left_semi").select("doc_id", "lang", "n_chars")


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def ignored_plane_anti(spark, sf):
    bad = read(spark, sf, "labels").filter("quality = 0").select("doc_id")
    return read(spark, sf, "documents").join(bad, "doc_id", "left_anti").select("doc_id", "lang", "n_chars")


@query("SELECT n_name FROM (VALUES ('FRANCE'), ('JAPAN'), ('ATLANTIS')) v(n_name) EXCEPT SELECT n_name FROM nation")
def curated_set_missing(spark, sf):
    return values(spark, "n_name string", ("FRANCE",), ("JAPAN",), ("ATLANTIS",)).join(read(spark, sf, "nation").select("n_name"), "n_name", "left_anti")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, unnest(list_filter(range(n_nationkey % 5 + 2), lambda p: p <> 0 AND p <> 3))::BIGINT AS plane FROM nation")
def plane_setdiff_explode(spark, sf):
    d = read(spark, sf, "nation").select("n_nationkey", (F.col("n_nationkey") % 5 + 2).alias("n"), F.array(F.lit(0), F.lit(3)).alias("flyback"))
    return planes.usable_planes(d, "n", "flyback").select("n_nationkey", "plane")


# Joins and alignments

_RULES = ((1, 0.0, 50_000.0, "low"), (2, 40_000.0, 120_000.0, "middle"), (3, 120_000.0, 1e9, "high"))
_RULES_SQL = "(VALUES (1, 0.0, 50000.0, 'low'), (2, 40000.0, 120000.0, 'middle'), (3, 120000.0, 1e9, 'high')) r(rule, rate_lo, rate_hi, name)"


def _rules(spark):
    return values(spark, "rule int, rate_lo double, rate_hi double, name string", *_RULES)


@query(f"SELECT o_orderkey, rule::BIGINT AS rule, name FROM orders JOIN {_RULES_SQL} ON o_totalprice BETWEEN rate_lo AND rate_hi")
def flyback_rule_range_join(spark, sf):
    return align.range_rules(read(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", _rules(spark)).select("o_orderkey", "rule", "name")


@query(f"""SELECT o_orderkey, rule, name FROM (SELECT o_orderkey, rule::BIGINT AS rule, name, row_number() OVER (PARTITION BY o_orderkey ORDER BY rule) AS r
    FROM orders LEFT JOIN {_RULES_SQL} ON o_totalprice BETWEEN rate_lo AND rate_hi) WHERE r = 1""")
def first_matching_rule(spark, sf):
    return align.range_rules(read(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", _rules(spark), first="rule").select("o_orderkey", "rule", "name")


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(CASE WHEN l_quantity = 1 THEN 730 WHEN l_quantity > 1 AND l_quantity <= 4 THEN 730 + (l_quantity - 1) * (180.0 - 730) / 3
    WHEN l_quantity > 4 AND l_quantity <= 16 THEN 180 + (l_quantity - 4) * (50.0 - 180) / 12 END, 6) AS fov FROM lineitem""")
def zoom_calibration_interp(spark, sf):
    d = align.calibrate(read(spark, sf, "lineitem"), "l_quantity", [(1, 730), (4, 180), (16, 50)], "fov", outside="null")
    return d.select("l_orderkey", "l_linenumber", "fov")


@query(f"""WITH {TRACE_SQL}, e AS (SELECT *, coalesce(f > 50, false) AS hi FROM tr), g AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY roi, segment ORDER BY frame), false) AS was FROM e)
    SELECT roi, segment, frame, {r6("t_s")} FROM g WHERE hi AND NOT was""")
def frame_clock_edges(spark, sf):
    return sequence.rising_edges(traces(spark, sf), KEYS, ["frame"], "f", 50.0).select(*KEYS, "frame", "t_s")


_CLOCK_SQL = "clk AS (SELECT user_id AS u, epoch_us(ts) / 1e6 AS c FROM events WHERE event_type = 'signup'), smp AS (SELECT user_id AS u, epoch_us(ts) / 1e6 AS t, event_id, value FROM events WHERE event_type <> 'signup')"


def _clock(spark, sf):
    e = read(spark, sf, "events").withColumn("t", seconds("ts"))
    clock = e.filter("event_type = 'signup'").select(F.col("user_id").alias("u"), F.col("t").alias("c"))
    return clock, e.filter("event_type <> 'signup'").select(F.col("user_id").alias("u"), "t", "event_id", "value")


@query(f"WITH {_CLOCK_SQL} SELECT u, bin, count(*) AS n, round(avg(value), 6) AS value FROM (SELECT s.u, s.event_id, any_value(value) AS value, count(c) AS bin FROM smp s LEFT JOIN clk ON clk.u = s.u AND c <= t GROUP BY s.u, s.event_id) GROUP BY u, bin")
def digitize_frames(spark, sf):
    clock, samples = _clock(spark, sf)
    return align.digitize(samples, "t", clock, "c", "bin", ["u"]).groupBy("u", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("value"))


@query(f"""WITH {_CLOCK_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY t, event_id) - 1 AS i FROM smp), a AS (SELECT clk.u, c, min(i) AS i FROM clk JOIN s ON s.u = clk.u AND t >= c GROUP BY clk.u, c),
    w AS (SELECT a.u, a.c, s.i - a.i AS o, s.value, count(*) OVER (PARTITION BY a.u, a.c) AS n FROM a JOIN s ON s.u = a.u AND s.i BETWEEN a.i AND a.i + 3)
    SELECT u, o, count(*) AS n, round(avg(value), 6) AS value FROM w WHERE n = 4 GROUP BY u, o""")
def frame_snippets_forward_asof(spark, sf):
    clock, samples = _clock(spark, sf)
    s = sequence.number(samples, ["u"], ["t", "event_id"], "i")
    d = align.snippets(clock, "c", s, "t", "i", "value", 4, ["u"], uncovered="drop")
    return d.groupBy("u", F.col("offset").alias("o")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("value"))


@query("SELECT user_id, round(quantile_cont(d, 0.5), 6) AS dt FROM (SELECT user_id, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts) AS d FROM events) GROUP BY user_id")
def frame_rate_median_interval(spark, sf):
    return align.median_interval(read(spark, sf, "events").withColumn("t", seconds("ts")), ["user_id"], "t")


@query(f"""WITH {TRACE_SQL}, s AS (SELECT segment, min(t_s) AS start FROM tr GROUP BY segment), g AS (SELECT segment, start, coalesce(lead(start) OVER (ORDER BY segment), 1e12) AS stop FROM s)
    SELECT event_id, g.segment AS found FROM tr JOIN g ON t_s >= g.start AND t_s < g.stop""")
def segment_interval_join(spark, sf):
    d = traces(spark, sf)
    s = d.groupBy(F.col("segment").alias("found")).agg(F.min("t_s").alias("start"))
    s = s.withColumn("stop", F.coalesce(F.lead("start").over(Window.orderBy("found")), F.lit(1e12)))
    return align.in_segment(d, "t_s", s).select("event_id", "found")


@query("""WITH d AS (SELECT date_trunc('hour', ts) AS h, count(*)::DOUBLE AS x FROM events GROUP BY 1), c AS (SELECT row_number() OVER (ORDER BY h) AS i, x - avg(x) OVER () AS x FROM d)
    SELECT b.i - a.i AS lag, round(sum(a.x * b.x), 6) AS ac FROM c a JOIN c b ON b.i BETWEEN a.i AND a.i + 23 GROUP BY 1""")
def plane_cycle_autocorr(spark, sf):
    d = read(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.count(F.lit(1)).cast("double").alias("x"))
    return sequence.autocorrelation(d, "h", "x", 24)


@query("""WITH d AS (SELECT date_trunc('hour', ts) AS h, count(*)::DOUBLE AS x FROM events GROUP BY 1), c AS (SELECT row_number() OVER (ORDER BY h) AS i, x - avg(x) OVER () AS x FROM d),
    a AS (SELECT b.i - a.i AS lag, sum(a.x * b.x) AS ac FROM c a JOIN c b ON b.i BETWEEN a.i AND a.i + 23 GROUP BY 1),
    p AS (SELECT lag AS k, ac, lag(ac) OVER (ORDER BY lag) AS b, lead(ac) OVER (ORDER BY lag) AS n FROM a WHERE lag >= 1) SELECT min(k) AS planes FROM p WHERE ac > b AND ac > n""")
def plane_count(spark, sf):
    return sequence.plane_count(plane_cycle_autocorr(spark, sf))


# Baselines and smoothing


@query(f"WITH {TRACE_SQL} SELECT roi, segment, frame, round(quantile_cont(f, 0.08) OVER (PARTITION BY roi, segment ORDER BY frame ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING), 6) AS f0 FROM tr")
def f0_rolling_percentile(spark, sf):
    return smooth.rolling_percentile(traces(spark, sf), KEYS, "frame", "f", 21, 0.08, "f0").select(*KEYS, "frame", "f0")


def _gauss(sigma: float) -> str:
    """A normalised Gaussian out to four deviations, as DuckDB works it out."""
    r = int(4 * sigma + 0.5)
    return f"(SELECT j, e / sum(e) OVER () AS w FROM (SELECT j, exp(-0.5 * (j / {sigma}::DOUBLE) ** 2) AS e FROM range({-r}, {r + 1}) t(j))) k"


def _hann(n: int) -> str:
    return f"(SELECT i - {n // 2} AS j, e / sum(e) OVER () AS w FROM (SELECT i, 0.5 - 0.5 * cos(2 * pi() * i / {n - 1}) AS e FROM range({n}) t(i))) k"


# The quadratic fit over seven points at its centre, in parts of 21.
_SAVGOL = "(VALUES (-3, -2 / 21::DOUBLE), (-2, 3 / 21::DOUBLE), (-1, 6 / 21::DOUBLE), (0, 7 / 21::DOUBLE), (1, 6 / 21::DOUBLE), (2, 3 / 21::DOUBLE), (3, -2 / 21::DOUBLE)) k(j, w)"


@query(f"""WITH {TRACE_SQL}, n AS (SELECT roi, segment, max(frame) AS m FROM tr GROUP BY ALL)
    SELECT a.roi, a.segment, a.frame, round(sum(w * b.value), 6) AS smooth FROM tr a JOIN n USING (roi, segment) CROSS JOIN {_gauss(2.0)}
    JOIN tr b ON b.roi = a.roi AND b.segment = a.segment AND b.frame = greatest(0, least(m, a.frame + j)) GROUP BY ALL""")
def f0_gaussian_nearest(spark, sf):
    return smooth.gaussian_nearest(traces(spark, sf), KEYS, "frame", "value", 2.0, "smooth").select(*KEYS, "frame", "smooth")


_RUNS_SQL = """v AS (SELECT *, NOT bad AS ok, CASE WHEN NOT bad AND coalesce(lag(bad) OVER (PARTITION BY roi, segment ORDER BY frame), true) THEN 1 ELSE 0 END AS st FROM tr),
    i AS (SELECT *, sum(st) OVER (PARTITION BY roi, segment ORDER BY frame) AS run FROM v), q AS (SELECT *, row_number() OVER (PARTITION BY roi, segment, run ORDER BY frame) - 1 AS p, count(*) OVER (PARTITION BY roi, segment, run) AS n FROM i WHERE ok)"""


@query(f"""WITH {TRACE_SQL}, {_RUNS_SQL}, e AS (SELECT q.roi, q.segment, q.run, q.frame, w, (((q.p + j) % (2 * n)) + 2 * n) % (2 * n) AS m, n FROM q CROSS JOIN {_gauss(2.0)})
    SELECT e.roi, e.segment, e.run::BIGINT AS run, e.frame, round(sum(w * q.value), 6) AS smooth FROM e JOIN q ON q.roi = e.roi AND q.segment = e.segment AND q.run = e.run AND q.p = (CASE WHEN m < e.n THEN m ELSE 2 * e.n - 1 - m END) GROUP BY ALL""")
def gaussian_reflect_runs(spark, sf):
    d = sequence.islands(traces(spark, sf), KEYS, "frame", ~F.col("bad"))
    return smooth.gaussian_reflect(d, [*KEYS, "run"], "frame", "value", 2.0, "smooth").select(*KEYS, "run", "frame", "smooth")


@query(f"WITH {TRACE_SQL}, {_RUNS_SQL} SELECT roi, segment, run::BIGINT AS run, min(frame) AS first, max(frame) AS last FROM q GROUP BY ALL")
def bad_frame_spans(spark, sf):
    return sequence.spans(traces(spark, sf), KEYS, "frame", ~F.col("bad"))


@query(f"""WITH {TRACE_SQL} SELECT a.roi, a.segment, a.frame, round(sum(w * b.f) / nullif(sum(CASE WHEN b.f IS NOT NULL THEN w END), 0), 6) AS smooth FROM tr a CROSS JOIN {_gauss(1.5)}
    LEFT JOIN tr b ON b.roi = a.roi AND b.segment = a.segment AND b.frame = a.frame + j GROUP BY ALL""")
def nan_normalised_gaussian(spark, sf):
    return smooth.gaussian_skipping(traces(spark, sf), KEYS, "frame", "f", 1.5, "smooth").select(*KEYS, "frame", "smooth")


@query(f"""WITH {TRACE_SQL} SELECT a.roi, a.segment, a.frame, round(sum(w * coalesce(b.value, 0)), 6) AS smooth FROM tr a CROSS JOIN {_hann(9)}
    LEFT JOIN tr b ON b.roi = a.roi AND b.segment = a.segment AND b.frame = a.frame + j GROUP BY ALL""")
def hanning_lowpass(spark, sf):
    return smooth.hanning_low_pass(traces(spark, sf), KEYS, "frame", "value", 9, "smooth").select(*KEYS, "frame", "smooth")


def _base_sql(source: str = "tr") -> str:
    """Baselines of f and fneu over a window of 20 frames, the line between both about them, all from ``source``."""
    return f"""q AS (SELECT *, quantile_cont(f, 0.08) OVER w AS qf, quantile_cont(fneu, 0.08) OVER w AS qn FROM {source} WINDOW w AS (PARTITION BY roi, segment ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)),
    qm AS (SELECT roi, segment, max(frame) AS m FROM {source} GROUP BY ALL),
    g0 AS (SELECT a.roi, a.segment, a.frame, CASE WHEN count(b.qf) = count(*) THEN sum(w * b.qf) END AS f0, CASE WHEN count(b.qn) = count(*) THEN sum(w * b.qn) END AS n0 FROM q a JOIN qm USING (roi, segment) CROSS JOIN {_gauss(20)}
        JOIN q b ON b.roi = a.roi AND b.segment = a.segment AND b.frame = greatest(0, least(m, a.frame + j)) GROUP BY ALL),
    c AS (SELECT *, f - f0 AS cf, fneu - n0 AS cn FROM {source} JOIN g0 USING (roi, segment, frame)),
    l AS (SELECT roi, quantile_cont(cn, 0.1) AS lo, (quantile_cont(cn, 0.9) - quantile_cont(cn, 0.1)) / 20 AS bs FROM c GROUP BY roi),
    y AS (SELECT roi, lo, bs, floor((cn - lo) / nullif(bs, 0)) AS k, quantile_cont(cf, 0.05) AS y FROM c JOIN l USING (roi) WHERE bs > 0 AND floor((cn - lo) / nullif(bs, 0)) BETWEEN 0 AND 19 GROUP BY ALL HAVING quantile_cont(cf, 0.05) IS NOT NULL),
    r AS (SELECT roi, CASE WHEN count(*) > 1 THEN regr_intercept(y, lo + k * bs) END AS intercept, CASE WHEN count(*) > 1 THEN greatest(0, least(2, regr_slope(y, lo + k * bs))) END AS slope FROM y GROUP BY roi)"""


_BASE_SQL = f"WITH {TRACE_SQL}, {_base_sql()}"


def _baselines(spark, sf):
    d = smooth.baselines(traces(spark, sf), KEYS, "frame", {"f0": "f", "n0": "fneu"}, rate=2.0, percentile=8, window_s=10)
    return trace.about_baselines(d)


@query(f"{_BASE_SQL} SELECT roi, {r6('intercept', 'slope')} FROM (SELECT DISTINCT roi FROM tr) LEFT JOIN r USING (roi)")
def neuropil_bin_regression(spark, sf):
    return trace.bin_regression(_baselines(spark, sf), ["roi"], "cf", "cn")


def _corrected(spark, sf):
    d = _baselines(spark, sf)
    return trace.subtract_background(d, trace.bin_regression(d, ["roi"], "cf", "cn"), ["roi"])


@query(f"{_BASE_SQL} SELECT roi, segment, frame, round(f - (slope * (fneu - n0) + intercept), 6) AS fc FROM c LEFT JOIN r USING (roi)")
def neuropil_corrected(spark, sf):
    return _corrected(spark, sf).select(*KEYS, "frame", "fc")


@query(f"{_BASE_SQL} SELECT roi, segment, frame, round((f - (slope * (fneu - n0) + intercept) - f0) / greatest(1, f0), 6) AS dff FROM c LEFT JOIN r USING (roi)")
def dff(spark, sf):
    return trace.dff(_corrected(spark, sf)).select(*KEYS, "frame", "dff")


@query(f"{_BASE_SQL} SELECT roi, segment, frame, round(f0, 6) AS f0 FROM c")
def f0_long_window(spark, sf):
    d = trace.mask_bad(traces(spark, sf), "f", F.col("bad")).select(*KEYS, "frame", "f")
    return smooth.baseline(d, KEYS, "frame", "f", rate=2.0, percentile=8, window_s=10).select(*KEYS, "frame", "f0")


# Depth

_PROFILE_SQL = """pr AS (SELECT roi, z, avg(value) AS p FROM tr GROUP BY ALL), fa AS (SELECT roi, z, p / nullif(max(CASE WHEN z = 10 THEN p END) OVER (PARTITION BY roi), 0) AS g FROM pr),
    fc AS (SELECT roi, z, CASE WHEN g >= 0.5 THEN g END AS factor FROM fa)"""


def _factors(spark, sf):
    p = traces(spark, sf).groupBy("roi", "z").agg(F.avg("value").alias("p"))
    return trace.profile_factors(p, ["roi"], "z", "p", 10)


@query(f"WITH {TRACE_SQL}, {_PROFILE_SQL} SELECT roi, segment, frame, {r6('factor')} FROM tr LEFT JOIN fc USING (roi, z)")
def zmotion_factor_lookup(spark, sf):
    d = traces(spark, sf)
    return d.join(_factors(spark, sf).select("roi", "z", "factor"), ["roi", "z"], "left").select(*KEYS, "frame", "factor")


@query(f"""WITH {TRACE_SQL}, {_PROFILE_SQL}, d AS (SELECT tr.*, factor FROM (SELECT * REPLACE (CASE WHEN NOT bad THEN z END AS z) FROM tr) tr LEFT JOIN fc USING (roi, z)),
    v AS (SELECT *, z IS NOT NULL AS ok, CASE WHEN z IS NOT NULL AND lag(z) OVER (PARTITION BY roi, segment ORDER BY frame) IS NULL THEN 1 ELSE 0 END AS st FROM d),
    i AS (SELECT *, sum(st) OVER (PARTITION BY roi, segment ORDER BY frame) AS run FROM v), q AS (SELECT *, row_number() OVER (PARTITION BY roi, segment, run ORDER BY frame) - 1 AS p, count(*) OVER (PARTITION BY roi, segment, run) AS n FROM i WHERE ok),
    e AS (SELECT q.roi, q.segment, q.run, q.frame, w, (((q.p + j) % (2 * n)) + 2 * n) % (2 * n) AS m, n FROM q CROSS JOIN {_gauss(2.0)}),
    s AS (SELECT e.roi, e.segment, e.frame, CASE WHEN count(q.factor) = count(*) THEN sum(w * q.factor) END AS g FROM e JOIN q ON q.roi = e.roi AND q.segment = e.segment AND q.run = e.run AND q.p = (CASE WHEN m < e.n THEN m ELSE 2 * e.n - 1 - m END) GROUP BY ALL)
    SELECT d.roi, d.segment, d.frame, round(d.value / nullif(g, 0), 6) AS value, round(d.fneu / nullif(g, 0), 6) AS fneu FROM d LEFT JOIN s ON s.roi = d.roi AND s.segment = d.segment AND s.frame = d.frame""")
def zmotion_corrected(spark, sf):
    d = traces(spark, sf).withColumn("z", F.when(~F.col("bad"), F.col("z")))
    return trace.correct_zmotion(d, _factors(spark, sf), ["roi"], "segment", "frame", "z", ["value", "fneu"]).select(*KEYS, "frame", "value", "fneu")


@query()
def fault_mask_profiles(spark, sf):
    p = traces(spark, sf).groupBy("roi", "z").agg(F.avg("value").alias("p"))
    return trace.mask_faults(p, ["roi"], "z", "p", 10)


@query("WITH d AS (SELECT date_trunc('day', ts) AS d, count(*) AS n FROM events GROUP BY 1), p AS (SELECT extract(day FROM d)::BIGINT AS day, n, lag(n) OVER (ORDER BY d) AS b, lead(n) OVER (ORDER BY d) AS a FROM d) SELECT day, n FROM p WHERE n > b AND n > a")
def local_peaks(spark, sf):
    d = read(spark, sf, "events").groupBy(F.day("ts").cast("long").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return sequence.local_peaks(d, [], "day", "n").select("day", "n")


_ZTRACE_SQL = f"""WITH {TRACE_SQL}, c AS (SELECT roi, (frame // 20) AS bucket, z, avg(value) AS corr FROM tr GROUP BY ALL),
    a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY roi, bucket ORDER BY corr DESC, z) AS r FROM c) WHERE r = 1)"""


def _ztrace(spark, sf):
    c = traces(spark, sf).groupBy("roi", F.floor(F.col("frame") / 20).alias("bucket"), "z").agg(F.avg("value").alias("corr"))
    return depth.argmax(c, ["roi", "bucket"], "z", "corr")


@query(f"{_ZTRACE_SQL} SELECT roi, bucket, z, {r6('corr')} FROM a")
def ztrace_argmax(spark, sf):
    return _ztrace(spark, sf).select("roi", "bucket", "z", "corr")


@query(f"{_ZTRACE_SQL} SELECT roi, bucket, CASE WHEN z NOT IN (0, 19) THEN z END AS z FROM a")
def ztrace_boundary_null(spark, sf):
    return depth.null_boundary(_ztrace(spark, sf), "z", 0, 19).select("roi", "bucket", "z")


@query(f"WITH {TRACE_SQL} SELECT roi, trunc(quantile_cont(z, 0.5))::BIGINT AS reference FROM tr WHERE NOT bad GROUP BY roi")
def reference_depth_median(spark, sf):
    return depth.reference_depth(traces(spark, sf).filter("NOT bad"), "z", ["roi"])


# Planes


@query(f"""WITH {REFERENCE_SQL}, s AS (SELECT frame, ref, corr, plane - ref AS s FROM bp), m AS (SELECT *, min(s) OVER (PARTITION BY frame) AS mn, max(s) OVER (PARTITION BY frame) AS mx FROM s)
    SELECT ref, sum((ref + mn BETWEEN 0 AND {PLANES - 1})::INT + (ref + mx BETWEEN 0 AND {PLANES - 1})::INT)::BIGINT AS coverage, round(avg(corr), 6) AS mean FROM m GROUP BY ref ORDER BY coverage DESC, avg(corr) DESC, ref LIMIT 1""")
def best_reference(spark, sf):
    return planes.best_reference(reference_correlations(spark, sf), PLANES)


@query("""WITH e AS (SELECT user_id % 2 AS plane, floor((extract(day FROM ts) - 1) / 10)::BIGINT AS segment, event_id, ts FROM events), n AS (SELECT segment, min(n) AS n FROM (SELECT plane, segment, count(*) AS n FROM e GROUP BY ALL) GROUP BY segment),
    k AS (SELECT *, row_number() OVER (PARTITION BY plane, segment ORDER BY ts, event_id) AS i FROM e) SELECT plane, segment, event_id, row_number() OVER (PARTITION BY plane ORDER BY segment, ts, event_id) - 1 AS frame FROM k JOIN n USING (segment) WHERE i <= n""")
def equalize_frames(spark, sf):
    e = read(spark, sf, "events").select((F.col("user_id") % 2).alias("plane"), F.floor((F.day("ts") - 1) / 10).alias("segment"), "event_id", "ts")
    return sequence.equalise(e, "plane", "segment", ["ts", "event_id"]).select("plane", "segment", "event_id", "frame")


_NEIGHBOUR_SQL = f"""WITH {REFERENCE_SQL}, b AS (SELECT frame, plane AS centre FROM bp WHERE ref = 0), fr AS (SELECT frame, plane, min(corr) < 5 AS bad FROM rc GROUP BY ALL),
    t AS (SELECT b.frame, centre, centre + o AS plane, w, coalesce(bad, false) AS bad FROM b CROSS JOIN (VALUES (-1, 0.2::DOUBLE), (0, 0.5::DOUBLE), (1, 0.3::DOUBLE)) v(o, w) LEFT JOIN fr ON fr.frame = b.frame AND fr.plane = centre + o),
    z AS (SELECT *, CASE WHEN plane NOT BETWEEN 0 AND {PLANES - 1} OR (bad AND plane <> centre) THEN 0 ELSE w END AS x FROM t),
    nb AS (SELECT frame, centre, plane, bad, CASE WHEN max((x = 0)::INT) OVER (PARTITION BY frame) = 1 THEN x / nullif(sum(x) OVER (PARTITION BY frame), 0) ELSE x END AS weight FROM z)"""


def _neighbours(spark, sf):
    quality = reference_correlations(spark, sf).groupBy("frame", "plane").agg((F.min("corr") < 5).alias("bad"))
    return planes.neighbours(planes_of_reference(spark, sf), quality, [0.2, 0.5, 0.3], PLANES)


@query(f"{_NEIGHBOUR_SQL} SELECT frame, plane, centre, bad, {r6('weight')} FROM nb")
def neighbor_explode_weights(spark, sf):
    return _neighbours(spark, sf).select("frame", "plane", "centre", "bad", "weight")


@query(f"""{_NEIGHBOUR_SQL}, px AS (SELECT label::BIGINT % {PLANES} AS plane, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), mp AS (SELECT plane, i, avg(v) AS v FROM px GROUP BY ALL)
    SELECT frame, i, round(sum(weight * v)::FLOAT::DOUBLE, 6) AS v FROM nb JOIN mp USING (plane) GROUP BY ALL""")
def weighted_neighbor_frame(spark, sf):
    px = image.pixels(frames(spark, sf).withColumn("plane", F.col("plane") % PLANES), "px").groupBy("plane", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return planes.weighted_frame(_neighbours(spark, sf), px.withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(30)))), ["frame"])


@query(f"WITH {REFERENCE_SQL}, b AS (SELECT frame, corr FROM bp WHERE ref = 0) SELECT frame, {r6('corr')}, corr <= avg(corr) OVER () - 1.5 * stddev_pop(corr) OVER () AS low FROM b")
def low_corr_badframes(spark, sf):
    return planes.low_correlation(planes_of_reference(spark, sf).select("frame", "corr"), "corr", 1.5)


@query("SELECT l_suppkey, greatest(0, max(l_linenumber - 4))::BIGINT AS x0, (512 + least(0, min(l_linenumber - 4)))::BIGINT AS x1, greatest(0, max(l_quantity::INT - 25))::BIGINT AS y0, (512 + least(0, min(l_quantity::INT - 25)))::BIGINT AS y1 FROM lineitem GROUP BY l_suppkey")
def shift_ranges(spark, sf):
    d = read(spark, sf, "lineitem").select("l_suppkey", (F.col("l_linenumber") - 4).alias("x"), (F.col("l_quantity").cast("int") - 25).alias("y"))
    return planes.shift_ranges(d, ["l_suppkey"], "x", "y", 512, 512)


@query("""WITH c AS (SELECT l_suppkey, l_orderkey, l_linenumber, sum(l_linenumber - 4) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING) AS s FROM lineitem)
    SELECT l_suppkey, l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(s - quantile_cont(s, 0.5) OVER (PARTITION BY l_suppkey), 6) AS pos FROM c""")
def accumulated_shifts(spark, sf):
    d = read(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", (F.col("l_linenumber") - 4).alias("s"), F.struct("l_orderkey", "l_linenumber").alias("at"))
    return planes.accumulate_shifts(d, ["l_suppkey"], "at", "s", "pos").select("l_suppkey", "l_orderkey", "l_linenumber", "pos")


# Images


@query("SELECT label::BIGINT AS plane, round(quantile_cont(v::DOUBLE, 0.01), 6) AS dark FROM (SELECT label, unnest(embedding) AS v FROM embeddings) GROUP BY label")
def dark_level(spark, sf):
    return image.dark_level(frames(spark, sf), ["plane"], "px", 0.01)


@query("""WITH d AS (SELECT s_suppkey, s_suppkey % 5 AS sample, (s_suppkey % 5) * 2.5 AS depth FROM supplier WHERE s_suppkey <= 5) SELECT p_partkey, round_even((5 - 1) * (p_size / 50.0), 0)::BIGINT AS sample, round(depth, 6) AS depth FROM part JOIN d ON d.sample = round_even((5 - 1) * (p_size / 50.0), 0)::BIGINT""")
def roi_depth_lookup(spark, sf):
    d = read(spark, sf, "supplier").filter("s_suppkey <= 5").select((F.col("s_suppkey") % 5).alias("sample"), ((F.col("s_suppkey") % 5) * 2.5).alias("depth"))
    return read(spark, sf, "part").select("p_partkey", F.rint(4 * (F.col("p_size") / 50.0)).cast("long").alias("sample")).join(d, "sample").select("p_partkey", "sample", "depth")


@query("SELECT p_partkey, round(p_size / 100.0 * 200, 6) AS y_um, round(p_retailprice / 400.0 * 200, 6) AS x_um FROM part")
def px_to_microns(spark, sf):
    return read(spark, sf, "part").select("p_partkey", (F.col("p_size") / 100.0 * 200).alias("y_um"), (F.col("p_retailprice") / 400.0 * 200).alias("x_um"))


@query("""WITH px AS (SELECT vec_id AS frame, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), m AS (SELECT r AS roi, r * 7 + j AS i, 1.0 / (j + 1) AS w FROM range(4) a(r), range(5) b(j))
    SELECT frame, roi, round(sum(w * v), 6) AS f FROM px JOIN m USING (i) GROUP BY ALL""")
def roi_mask_weighted_sum(spark, sf):
    mask = values(spark, "roi long, i int, w double", *[(r, r * 7 + j, 1.0 / (j + 1)) for r in range(4) for j in range(5)])
    px = image.pixels(frames(spark, sf).select("frame", "px"), "px").withColumn("v", F.col("v").cast("double"))
    return image.mask_sum(px, mask, ["frame"])


@query("""WITH px AS (SELECT vec_id AS frame, label::BIGINT AS plane, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), m AS (SELECT i, avg(v) AS b FROM px WHERE plane = 0 GROUP BY i)
    SELECT frame, round(covar_pop(v, b) / nullif(stddev_pop(v) * stddev_pop(b), 0), 6) AS r FROM px JOIN m USING (i) GROUP BY frame""")
def image_pearson(spark, sf):
    px = image.pixels(frames(spark, sf), "px").withColumn("v", F.col("v").cast("double"))
    return image.image_correlation(px.select("frame", "i", "v"), px.filter("plane = 0").groupBy("i").agg(F.avg("v").alias("v")), ["frame"])


@query("""WITH px AS (SELECT vec_id AS frame, label::BIGINT AS plane, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), s AS (SELECT plane, min(frame) AS f FROM px GROUP BY plane),
    q AS (SELECT px.plane, i, v AS b FROM px JOIN s ON s.plane = px.plane AND frame = f), c AS (SELECT px.plane, frame, covar_pop(v, b) / nullif(stddev_pop(v) * stddev_pop(b), 0) AS corr FROM px JOIN q USING (plane, i) GROUP BY ALL)
    SELECT plane, frame, round(corr, 6) AS corr, rank FROM (SELECT *, row_number() OVER (PARTITION BY plane ORDER BY round(corr, 9) DESC, frame) AS rank FROM c) WHERE rank <= 5""")
def topn_similar_frames(spark, sf):
    f = frames(spark, sf)
    first = f.groupBy("plane").agg(F.min("frame").alias("frame"))
    return image.most_similar(f, ["plane"], "frame", "px", f.join(first, ["plane", "frame"]), 5)


# A scanner's path within a frame.
_PATH = (0.0, 1.0, 2.5, 4.0, 6.0)


@query(f"""WITH p AS (SELECT {list(_PATH)}::DOUBLE[] AS p), r AS (SELECT y, p, y * {len(_PATH) - 1} / 7.0 AS x FROM range(8) t(y), p),
    i AS (SELECT y, (p[floor(x)::INT + 1] + coalesce(p[floor(x)::INT + 2] - p[floor(x)::INT + 1], 0) * (x - floor(x)) - list_min(p)) / 0.75 AS o FROM r), o AS (SELECT y, o - (SELECT o FROM i WHERE y = 4) AS off FROM i),
    g AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS z, embedding AS e, count(*) OVER () AS n FROM embeddings),
    w AS (SELECT z, y, ceil(greatest(0, least(n - 1, z + off)) - 0.5)::BIGINT AS s FROM g, o)
    SELECT w.z, w.y, round(list_sum(list_transform(e[(w.y * 8 + 1)::INT : (w.y * 8 + 8)::INT], lambda q: q::DOUBLE)), 6) AS v FROM w JOIN g ON g.z = s""")
def reslice_join(spark, sf):
    """All images as one stack, each row taken from the slice that a slanted scan saw; v is the row's sum."""
    d = sequence.number_all(frames(spark, sf).select("frame", "px"), "frame", "z")
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.struct(y.alias("y"), F.aggregate(F.slice("px", y * 8 + 1, F.lit(8)), F.lit(0.0), lambda s, v: s + v.cast("double")).alias("v")))
    g = d.select("z", F.explode(rows).alias("r")).select("z", "r.y", "r.v")
    return image.reslice(g, values(spark, "y int, off double", *enumerate(image.reslice_offsets(_PATH, 8, 0.75))), d.count())


@query()
def initial_reference(spark, sf):
    f = frames(spark, sf).withColumn("px", F.transform("px", lambda v: v * 1000))
    return registration.initial_reference(f, ["plane"], "frame", "px", (8, 8)).select("plane", F.posexplode("px").alias("i", "v"))


@query()
def frame_registration(spark, sf):
    f = frames(spark, sf)
    refs = f.filter("frame < 4").select(F.col("frame").cast("int").alias("ref"), "px")
    return image.register(f, refs, (8, 8))


# Population statistics


@query(f"WITH {TRACE_SQL} SELECT roi, z, round(quantile_cont(f, 0.5), 6) AS value, count(f) AS n FROM tr GROUP BY ALL HAVING count(f) >= 30")
def depth_percentile_profile(spark, sf):
    return profiles.depth_profile(traces(spark, sf), ["roi"], "z", "f", 0.5, 30)


@query(f"""WITH {TRACE_SQL}, a AS (SELECT roi, z, quantile_cont(f, 0.5) AS x FROM tr GROUP BY ALL), b AS (SELECT roi, z, avg(fneu) AS y FROM tr GROUP BY ALL)
    SELECT roi, round(CASE WHEN count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) >= 3 THEN covar_pop(x, y) / nullif(stddev_pop(x) FILTER (y IS NOT NULL) * stddev_pop(y) FILTER (x IS NOT NULL), 0) END, 6) AS r FROM a JOIN b USING (roi, z) GROUP BY roi""")
def profile_correlation(spark, sf):
    d = traces(spark, sf)
    a, b = d.groupBy("roi", "z").agg(F.percentile("f", 0.5).alias("x")), d.groupBy("roi", "z").agg(F.avg("fneu").alias("y"))
    return profiles.profile_correlation(a, b, ["roi"], "z", "x", "y")


def _pairs(spark, sf):
    return read(spark, sf, "lineitem").select("l_suppkey", F.col("l_extendedprice").alias("a"), (F.col("l_extendedprice") * (1 - F.col("l_discount")) + F.col("l_tax") * 100).alias("b"))


_PAIRS_SQL = "p AS (SELECT l_suppkey, l_extendedprice AS a, l_extendedprice * (1 - l_discount) + l_tax * 100 AS b FROM lineitem)"


@query(f"WITH {_PAIRS_SQL} SELECT l_suppkey, round(quantile_cont(log2(b / a), 0.05), 6) AS low, round(quantile_cont(log2(b / a), 0.95), 6) AS high FROM p WHERE a > 0 AND b > 0 GROUP BY 1")
def log_ratio_tails(spark, sf):
    return profiles.tails(_pairs(spark, sf), ["l_suppkey"], profiles.log_ratio("a", "b"))


@query(f"WITH {_PAIRS_SQL} SELECT l_suppkey, round(quantile_cont(b - a, 0.05), 6) AS low, round(quantile_cont(b - a, 0.95), 6) AS high FROM p GROUP BY 1")
def difference_tails(spark, sf):
    return profiles.tails(_pairs(spark, sf), ["l_suppkey"], profiles.difference("a", "b"))


@query(f"WITH {TRACE_SQL} SELECT roi, round(100.0 * count(*) FILTER (value IS NOT NULL AND f IS NULL) / nullif(count(value), 0), 6) AS removed FROM tr GROUP BY roi")
def removed_percent(spark, sf):
    return profiles.removed_percent(traces(spark, sf), ["roi"], "value", "f")


@query("""WITH p AS (SELECT 'customer' AS dataset, c_acctbal AS v FROM customer UNION ALL SELECT 'supplier', s_acctbal FROM supplier)
    SELECT count(DISTINCT dataset) AS datasets, count(*) AS n, round(quantile_cont(v, 0.5), 6) AS median, round(100.0 * avg((v < 1000)::INT), 6) AS below FROM p WHERE v > 0""")
def pool_and_share(spark, sf):
    p = profiles.pool({"customer": read(spark, sf, "customer").withColumnRenamed("c_acctbal", "v"), "supplier": read(spark, sf, "supplier").withColumnRenamed("s_acctbal", "v")}, "v")
    return p.filter("v > 0").agg(F.count_distinct("dataset").alias("datasets"), F.count(F.lit(1)).alias("n"), F.percentile("v", 0.5).alias("median"), profiles.share_below(p, "v", 1000).alias("below"))


def _histogram_sql(value: str, table: str, edges: list[float]) -> str:
    case = " ".join(f"WHEN {value} >= {a!r} AND {value} {'<=' if i == len(edges) - 2 else '<'} {b!r} THEN {i}" for i, (a, b) in enumerate(zip(edges, edges[1:])))
    return f"SELECT bin, n, round(100.0 * n / sum(n) OVER (), 6) AS percent FROM (SELECT (CASE {case} END)::BIGINT AS bin, count(*) AS n FROM {table} GROUP BY 1) WHERE bin IS NOT NULL"


_FIXED = [float(x) for x in range(0, 500_001, 25_000)]
_LOG = [10 ** (x / 10) for x in range(20, 61)]


@query(_histogram_sql("o_totalprice", "orders", _FIXED))
def histogram_fixed(spark, sf):
    return profiles.histogram(read(spark, sf, "orders"), "o_totalprice", _FIXED)


@query(_histogram_sql("o_totalprice", "orders", _LOG))
def histogram_log(spark, sf):
    return profiles.histogram(read(spark, sf, "orders"), "o_totalprice", _LOG)


@query("""WITH r AS (SELECT l_returnflag AS k, l_extendedprice - l_quantity * 1500 AS d FROM lineitem) SELECT k, round(sqrt(sum(d * d) / count(d)), 6) AS rmse, count(d) AS n, grouping(k)::BIGINT AS pooled FROM r GROUP BY GROUPING SETS ((k), ())""")
def rmse_grouping_sets(spark, sf):
    d = read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_extendedprice").alias("a"), (F.col("l_quantity") * 1500).alias("b"))
    return profiles.rmse(d, "k", "a", "b")


@query(f"WITH {TRACE_SQL} SELECT roi, event_id, round((value - quantile_cont(value, 0.5) OVER (PARTITION BY roi)) * 2.5, 6) AS um FROM tr")
def median_center_scale(spark, sf):
    return profiles.median_centre(traces(spark, sf), ["roi"], "value", 2.5, "um").select("roi", "event_id", "um")


@query("SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i, count(*) OVER () AS n FROM part) WHERE i IN (SELECT floor((k + 0.5) * (SELECT count(*) FROM part) / 37)::BIGINT FROM range(37) t(k))")
def even_sample_k(spark, sf):
    return sequence.even_sample(read(spark, sf, "part").select("p_partkey"), "p_partkey", 37)


# Events

_ONSET_SQL = f"""WITH {TRACE_SQL}, d AS (SELECT roi, segment, t_s, coalesce(value > 10, false) AS run, min(t_s) OVER w AS t0, max(t_s) OVER w AS t1 FROM tr WINDOW w AS (PARTITION BY roi, segment)),
    e AS (SELECT *, lag(run) OVER (PARTITION BY roi, segment ORDER BY t_s) AS was FROM d),
    o AS (SELECT roi, segment, t_s AS onset FROM e WHERE run AND NOT was AND t_s - t0 >= 2000 AND t1 - t_s >= 2000
        AND coalesce((SELECT bool_and(NOT x.run) FROM d x WHERE x.roi = e.roi AND x.segment = e.segment AND x.t_s >= e.t_s - 2000 AND x.t_s < e.t_s), false)
        AND (SELECT bool_and(x.run) FROM d x WHERE x.roi = e.roi AND x.segment = e.segment AND x.t_s >= e.t_s AND x.t_s < e.t_s + 2000))"""


def _onsets(spark, sf):
    return events.running_onsets(traces(spark, sf), KEYS, "t_s", "value", 10.0, 2000.0, 2000.0)


@query(f"{_ONSET_SQL} SELECT roi, segment, {r6('onset')} FROM o")
def running_onsets(spark, sf):
    return _onsets(spark, sf)


_GRID = [float(x) for x in range(-4000, 8001, 1000)]


@query(f"""{_ONSET_SQL}, g AS (SELECT roi, segment, onset, rel, onset + rel AS t FROM o CROSS JOIN (SELECT unnest({_GRID})::DOUBLE AS rel)), s AS (SELECT roi, segment, t_s, fneu AS v FROM tr),
    n AS (SELECT g.*, b.t_s AS x0, b.v AS y0 FROM g ASOF LEFT JOIN s b ON b.roi = g.roi AND b.segment = g.segment AND b.t_s <= g.t), m AS (SELECT n.*, a.t_s AS x1, a.v AS y1 FROM n ASOF LEFT JOIN s a ON a.roi = n.roi AND a.segment = n.segment AND a.t_s >= n.t),
    i AS (SELECT roi, segment, onset, rel, CASE WHEN x0 IS NOT NULL AND x1 IS NOT NULL THEN CASE WHEN x1 > x0 THEN y0 + (y1 - y0) * (t - x0) / (x1 - x0) ELSE y0 END END AS v FROM m),
    c AS (SELECT *, v - avg(CASE WHEN rel >= -2000 AND rel < 0 THEN v END) OVER (PARTITION BY roi, segment, onset) AS x FROM i)
    SELECT rel, round(avg(x), 6) AS mean, round(CASE WHEN count(x) > 1 THEN stddev_samp(x) / sqrt(count(x)) END, 6) AS sem, count(x) AS n FROM c GROUP BY rel""")
def peri_event_mean_sem(spark, sf):
    a = events.around_events(_onsets(spark, sf), "onset", traces(spark, sf), "t_s", "fneu", KEYS, _GRID)
    return events.mean_sem(events.subtract_before(a, [*KEYS, "onset"], "rel", "value", 2000.0), ["rel"], "value")


# Runs

_MANIFEST_SQL = "m AS (SELECT c_custkey AS ds, CASE c_custkey % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'failed' ELSE 'running' END AS state, '{\"custkey\":' || c_custkey || ',\"segment\":\"' || c_mktsegment || '\"}' AS config FROM customer)"


def _manifests(spark, sf):
    c = read(spark, sf, "customer")
    state = F.when(F.col("c_custkey") % 3 == 0, "complete").when(F.col("c_custkey") % 3 == 1, "failed").otherwise("running")
    config = F.concat(F.lit('{"custkey":'), F.col("c_custkey").cast("string"), F.lit(',"segment":"'), F.col("c_mktsegment"), F.lit('"}'))
    return c.select(F.col("c_custkey").alias("ds"), state.alias("state"), config.alias("config"))


@query(f"WITH {_MANIFEST_SQL} SELECT ds, state, sha256(config) AS config_sha256 FROM m")
def manifest_digest(spark, sf):
    return manifest.with_digest(_manifests(spark, sf)).select("ds", "state", "config_sha256")


@query("""SELECT CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'failed' ELSE 'running' END AS state, count(*) AS n
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, CASE event_type WHEN 'purchase' THEN 3 WHEN 'error' THEN 2 ELSE 1 END DESC) AS r FROM events) WHERE r = 1 GROUP BY 1""")
def run_summary(spark, sf):
    """Events as states of a user's run: how many runs ended up in which."""
    state = F.when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "failed").otherwise("running")
    m = read(spark, sf, "events").select(F.col("user_id").alias("ds"), F.lit("signals").alias("workflow"), state.alias("state"), F.col("ts").alias("updated_at"))
    return manifest.summary_of(m)




# Composite analyses


@query(f"""{_BASE_SQL}, x AS (SELECT roi, value AS a, f - (slope * (fneu - n0) + intercept) AS b FROM c LEFT JOIN r USING (roi))
    SELECT roi, round(quantile_cont(log2(b / a), 0.05) FILTER (a > 0 AND b > 0), 6) AS ratio_low, round(quantile_cont(log2(b / a), 0.95) FILTER (a > 0 AND b > 0), 6) AS ratio_high, round(quantile_cont(b - a, 0.05), 6) AS difference_low,
    round(quantile_cont(b - a, 0.95), 6) AS difference_high, round(CASE WHEN count(b) >= 3 THEN covar_pop(a, b) / nullif(stddev_pop(a) FILTER (b IS NOT NULL) * stddev_pop(b) FILTER (a IS NOT NULL), 0) END, 6) AS correlation,
    round(100.0 * count(*) FILTER (a IS NOT NULL AND b IS NULL) / nullif(count(a), 0), 6) AS removed FROM (SELECT roi, a, b FROM x) GROUP BY roi""".replace("log2(b / a)", "CASE WHEN a > 0 AND b > 0 THEN log2(b / a) END"))
def trace_difference_metrics(spark, sf):
    return composite.trace_differences(_corrected(spark, sf), ["roi"], "value", "fc")


@query(f"""WITH {TRACE_SQL}, {REFERENCE_SQL}, e AS (SELECT (extract(day FROM ts) - 1)::BIGINT AS frame, user_id % {PLANES} AS plane, roi, value FROM tr), b AS (SELECT frame, plane AS best_plane FROM bp WHERE ref = 0),
    p AS (SELECT roi, plane - best_plane AS depth, quantile_cont(value, 0.5) AS v, count(value) AS n FROM e JOIN b USING (frame) GROUP BY ALL)
    SELECT roi, depth, n, round(v, 6) AS value, round(CASE WHEN z > 0 THEN v / z END, 6) AS relative FROM (SELECT *, max(CASE WHEN depth = 0 THEN v END) OVER (PARTITION BY roi) AS z FROM p)""")
def effective_depth_profile(spark, sf):
    d = traces(spark, sf).select((F.day("ts") - 1).cast("long").alias("frame"), (F.col("user_id") % PLANES).alias("plane"), "roi", "value")
    best = planes_of_reference(spark, sf).select("frame", F.col("plane").alias("best_plane"))
    p = profiles.depth_profile(composite.effective_depth(d, best, ["frame"]), ["roi"], "depth", "value", 0.5)
    return composite.relative_profile(p, ["roi"])


@query(f"""WITH {TRACE_SQL}, i AS (SELECT roi, value, frame, segment, row_number() OVER (PARTITION BY roi, segment ORDER BY frame) - 1 AS i FROM tr), c AS (SELECT *, i // 16 AS cycle, i % 16 AS p FROM i),
    w AS (SELECT *, count(*) OVER (PARTITION BY roi, segment, cycle) AS n FROM c), r AS (SELECT roi, segment, cycle, value - avg(value) OVER (PARTITION BY roi, segment, p) AS x FROM w WHERE n = 16)
    SELECT roi, segment, cycle, round(quantile_cont(x, 0.5), 6) AS "offset" FROM r GROUP BY ALL""")
def cycle_residual_median(spark, sf):
    return composite.cycle_residuals(traces(spark, sf), KEYS, "frame", "value", 16)


@query(f"WITH {TRACE_SQL}, m AS (SELECT roi, quantile_cont(f - fneu, 0.5) AS m FROM tr GROUP BY roi) SELECT round(quantile_cont(m, 0.5), 6) AS \"offset\" FROM m")
def shared_offset(spark, sf):
    return composite.shared_offset(traces(spark, sf), "roi", "f", "fneu")


_ROI_SQL = "ro AS (SELECT p_partkey AS roi, list_transform(range(p_size % 7 + 1), lambda i: (p_size + i) % 48) AS ypix, list_transform(range(p_size % 7 + 1), lambda i: (p_partkey + i) % 64) AS xpix, list_transform(range(p_size % 7 + 1), lambda i: (p_partkey + i) % 3 = 0) AS overlap FROM part)"


def _masks(spark, sf):
    n = F.sequence(F.lit(0), F.col("p_size") % 7)
    return read(spark, sf, "part").select(
        F.col("p_partkey").alias("roi"), F.transform(n, lambda i: (F.col("p_size") + i) % 48).alias("ypix"), F.transform(n, lambda i: (F.col("p_partkey") + i) % 64).alias("xpix"), F.transform(n, lambda i: (F.col("p_partkey") + i) % 3 == 0).alias("overlap")
    )


@query(f"WITH {_ROI_SQL}, u AS (SELECT roi, unnest(ypix)::BIGINT AS y, unnest(xpix)::BIGINT AS x, unnest(overlap) AS o FROM ro) SELECT roi, y, x FROM u WHERE NOT o")
def mask_rasterise(spark, sf):
    return composite.rasterise(_masks(spark, sf), ["roi"])


@query(f"WITH {_ROI_SQL} SELECT roi FROM ro WHERE list_max(ypix) >= 40 OR list_max(xpix) >= 60")
def roi_bounds_violations(spark, sf):
    return composite.out_of_bounds(_masks(spark, sf), ["roi"], 40, 60)


@query("SELECT p_partkey, p_partkey // 37 AS y, p_partkey % 37 AS x FROM part")
def unravel_index(spark, sf):
    return composite.unravel(read(spark, sf, "part").select("p_partkey"), "p_partkey", 37)


@query("""WITH px AS (SELECT vec_id AS frame, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), q AS (SELECT frame, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM px GROUP BY frame)
    SELECT frame, i, round((greatest(lo, least(hi, v)) - lo) / nullif(hi - lo, 0), 6) AS v FROM px JOIN q USING (frame)""")
def image_clip_normalise(spark, sf):
    px = image.pixels(frames(spark, sf).select("frame", "px"), "px").withColumn("v", F.col("v").cast("double"))
    return composite.clip_normalise(px, ["frame"], "v", 0.01, 0.99)


@query("SELECT user_id, k.kind FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (VALUES ('click'), ('error'), ('signup')) k(kind) WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND e.event_type = k.kind AND e.value > 60)")
def missing_bins_plan(spark, sf):
    e = read(spark, sf, "events")
    expected = e.select("user_id").distinct().withColumn("kind", F.explode(F.array(F.lit("click"), F.lit("error"), F.lit("signup"))))
    return composite.missing_parts(expected, e.filter("value > 60").select("user_id", F.col("event_type").alias("kind")).distinct(), ["user_id", "kind"])


@query("""WITH i AS (SELECT l_suppkey AS k, l_linenumber - 4 AS x, l_quantity::BIGINT - 25 AS y, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_quantity, l_partkey) - 1 AS i FROM lineitem),
    b AS (SELECT k, i // 4096 AS b, sha256(string_agg(x || ',' || y, ';' ORDER BY i)) AS h, max(greatest(abs(x), abs(y))) AS m FROM i GROUP BY ALL) SELECT k, max(m)::BIGINT AS largest, sha256(string_agg(h, ';' ORDER BY b)) AS checksum FROM b GROUP BY k""")
def shift_checksum(spark, sf):
    d = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), (F.col("l_linenumber") - 4).alias("x"), (F.col("l_quantity").cast("int") - 25).alias("y"), F.struct("l_orderkey", "l_linenumber", "l_quantity", "l_partkey").alias("at"))
    return composite.shift_checksum(d, ["k"], "at", "x", "y")


@query("SELECT segment, n, stop, stop - n AS start FROM (SELECT segment, n, (sum(n) OVER (ORDER BY segment))::BIGINT AS stop FROM (SELECT floor((extract(day FROM ts) - 1) / 10)::BIGINT AS segment, count(*) AS n FROM events GROUP BY 1))")
def segment_boundaries(spark, sf):
    n = traces(spark, sf).groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
    return sequence.boundaries(n, "segment", "n").select("segment", "n", "stop", "start")


@query("SELECT segment, greatest(0, least(n, 500 - (stop - n)))::BIGINT AS n FROM (SELECT segment, n, sum(n) OVER (ORDER BY segment) AS stop FROM (SELECT floor((extract(day FROM ts) - 1) / 10)::BIGINT AS segment, count(*) AS n FROM events GROUP BY 1))")
def trimmed_segments(spark, sf):
    n = traces(spark, sf).groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
    return sequence.trim(n, "segment", "n", 500).select("segment", "n")


@query(f"""WITH {TRACE_SQL}, w AS (SELECT roi, segment, frame, f, last_value(CASE WHEN f IS NOT NULL THEN frame END IGNORE NULLS) OVER b AS x0, last_value(f IGNORE NULLS) OVER b AS y0, first_value(CASE WHEN f IS NOT NULL THEN frame END IGNORE NULLS) OVER a AS x1, first_value(f IGNORE NULLS) OVER a AS y1 FROM tr
    WINDOW b AS (PARTITION BY roi, segment ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY roi, segment ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT roi, segment, frame, round(coalesce(f, y0 + (y1 - y0) * ((frame - x0) / nullif(x1 - x0, 0)), y0, y1), 6) AS f FROM w""")
def interpolated_trace(spark, sf):
    return sequence.interpolate(traces(spark, sf), KEYS, "frame", "f").select(*KEYS, "frame", "f")


@query(f"""WITH {TRACE_SQL}, n AS (SELECT roi, segment, max(frame) AS m FROM tr GROUP BY ALL)
    SELECT a.roi, a.segment, a.frame, round(sum(w * b.value), 6) AS smooth FROM tr a JOIN n USING (roi, segment) CROSS JOIN {_SAVGOL}
    JOIN tr b ON b.roi = a.roi AND b.segment = a.segment AND b.frame = greatest(0, least(m, a.frame + j)) GROUP BY ALL""")
def savitzky_golay_smooth(spark, sf):
    return smooth.convolve(traces(spark, sf), KEYS, "frame", "value", savitzky_golay(7, 2), "smooth").select(*KEYS, "frame", "smooth")


@query()
def piezo_cycle(spark, sf):
    e = read(spark, sf, "events").withColumn("t_s", seconds("ts"))
    return composite.piezo_cycle(e.select("t_s", F.col("value").alias("volts")), e.filter("event_type = 'signup'").select("t_s"), 4, 3, 5, 0.5)


# Table plumbing


@query(f"WITH {TRACE_SQL} SELECT roi, segment, frame, coalesce(f IS NULL, false) OR coalesce(fneu > 90, false) OR coalesce(z = 0, false) AS bad FROM tr")
def bad_frame_union(spark, sf):
    d = traces(spark, sf)
    return d.select(*KEYS, "frame", tables.bad_frames(F.col("f").isNull(), F.col("fneu") > 90, F.col("z") == 0).alias("bad"))


@query("SELECT event_id, round(value, 6) AS value FROM events WHERE epoch_us(ts) / 1e6 BETWEEN 1704412800 AND 1705017600")
def time_window(spark, sf):
    return tables.in_time(read(spark, sf, "events").withColumn("t_s", seconds("ts")), "t_s", 1704412800, 1705017600).select("event_id", "value")


@query(f"""WITH {TRACE_SQL}, r AS (SELECT roi, event_id, row_number() OVER (PARTITION BY roi ORDER BY event_id) AS r, count(*) OVER (PARTITION BY roi) AS n FROM tr WHERE NOT bad)
    SELECT roi, event_id FROM r WHERE r > round_even(n / 2.0, 0) - 8 AND r <= round_even(n / 2.0, 0) + 8""")
def central_usable_frames(spark, sf):
    return tables.central_frames(traces(spark, sf), ["roi"], "event_id", "bad", 15).select("roi", "event_id")


@query(f"""WITH {TRACE_SQL}, m AS (SELECT min(n) AS n FROM (SELECT max(frame) + 1 AS n FROM tr GROUP BY roi, segment))
    SELECT roi, segment, frame, {r6('value')} FROM tr WHERE frame < (SELECT n FROM m)""")
def trimmed_to_shortest(spark, sf):
    return tables.trim_to_shortest(traces(spark, sf), KEYS, "frame").select(*KEYS, "frame", "value")


@query("SELECT o.o_orderkey AS k, round(o.o_totalprice, 6) AS price, round(l.s, 6) AS lines FROM orders o JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY ALL) l ON l.l_orderkey = o.o_orderkey")
def paired_by_saved_id(spark, sf):
    a = read(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"))
    return tables.paired(a, read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_extendedprice").alias("lines")), ["k"], unmatched="drop")


@query("""SELECT coalesce(o.o_orderkey, l.l_orderkey) AS k, round(o.o_totalprice, 6) AS saved, round(l.s, 6) AS computed FROM orders o
    FULL JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY ALL) l ON l.l_orderkey = o.o_orderkey
    WHERE o.o_orderkey IS NULL OR l.l_orderkey IS NULL OR (o.o_totalprice IS NULL) <> (l.s IS NULL) OR abs(o.o_totalprice - l.s) > 1000""")
def saved_against_recomputed(spark, sf):
    a = read(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    return tables.differences(a, read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_extendedprice").alias("v")), ["k"], "v", 1000)


@query("SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr FROM events GROUP BY ALL")
def median_and_iqr(spark, sf):
    return tables.median_iqr(read(spark, sf, "events"), ["event_type"], "value")


@query(f"WITH {TRACE_SQL} SELECT segment, frame, round(quantile_cont(value, 0.5), 6) AS value FROM tr GROUP BY ALL")
def median_across_series(spark, sf):
    return tables.median_across(traces(spark, sf), ["segment", "frame"], "value")


@query(f"""WITH {TRACE_SQL}, b AS (SELECT roi, value AS v FROM tr UNION ALL SELECT roi, fneu FROM tr)
    SELECT roi, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.99) - quantile_cont(v, 0.01), 6) AS span FROM b GROUP BY ALL""")
def robust_range(spark, sf):
    d = traces(spark, sf)
    return tables.robust_range(d.select("roi", F.col("value").alias("v")), d.select("roi", F.col("fneu").alias("v")), ["roi"], "v")


@query(f"""WITH {TRACE_SQL}, b AS (SELECT roi, value AS v FROM tr UNION ALL SELECT roi, fneu FROM tr)
    SELECT roi, round((max(v) + min(v)) / 2, 6) AS centre, round(max(v) - min(v), 6) AS extent FROM b GROUP BY ALL""")
def pair_centre(spark, sf):
    d = traces(spark, sf)
    return tables.pair_centre(d.select("roi", F.col("value").alias("v")), d.select("roi", F.col("fneu").alias("v")), ["roi"], "v")


@query("SELECT p_partkey, p_size, round(p_retailprice, 6) AS p_retailprice FROM part WHERE p_partkey IN (3, 17, 99)")
def roi_subset(spark, sf):
    ids = values(spark, "p_partkey long", (3,), (17,), (99,))
    return tables.subset(read(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), "p_partkey", ids)


@query(f"WITH {TRACE_SQL} SELECT roi, segment, frame, {r6('value')} FROM (SELECT *, row_number() OVER (PARTITION BY roi, segment ORDER BY frame) AS k FROM tr) WHERE k <= 50")
def first_frames_of_each(spark, sf):
    return image.first_frames(traces(spark, sf), KEYS, "frame", 50).select(*KEYS, "frame", "value")


@query(f"""WITH {TRACE_SQL} SELECT a.roi, a.segment, a.frame, round(sum(w * b.f) / nullif(sum(CASE WHEN b.f IS NOT NULL THEN w END), 0), 6) AS smooth FROM tr a CROSS JOIN {_hann(9)}
    LEFT JOIN tr b ON b.roi = a.roi AND b.segment = a.segment AND b.frame = a.frame + j GROUP BY ALL""")
def nan_normalised_hanning(spark, sf):
    return smooth.hanning_skipping(traces(spark, sf), KEYS, "frame", "f", 8, "smooth").select(*KEYS, "frame", "smooth")


@query(f"""WITH {TRACE_SQL}, e AS (SELECT roi, segment, min(t_s) AS a, max(t_s) AS b FROM tr GROUP BY ALL)
    SELECT roi, segment, round((a + was) / 2, 6) AS at FROM (SELECT *, lag(b) OVER (PARTITION BY roi ORDER BY segment) AS was FROM e) WHERE was IS NOT NULL""")
def boundary_times(spark, sf):
    return sequence.boundary_times(traces(spark, sf), ["roi"], "segment", "frame", "t_s")


@query("""WITH f AS (SELECT label::BIGINT % 3 AS ds, label::BIGINT AS plane, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings),
    p AS (SELECT ds, plane, quantile_cont(v::DOUBLE, 0.01) AS dark FROM (SELECT ds, plane, unnest(embedding) AS v FROM f WHERE k <= 200) GROUP BY ALL)
    SELECT d.ds, round(min(dark), 6) AS dark FROM (SELECT range AS ds FROM range(5)) d LEFT JOIN p USING (ds) GROUP BY d.ds""")
def dataset_dark_level(spark, sf):
    f = frames(spark, sf).withColumn("ds", F.col("plane") % 3)
    return image.dataset_dark_level(spark.range(5).select(F.col("id").alias("ds")), f, "ds", "plane", "frame", "px")


@query("SELECT n_regionkey AS ds, n_nationkey AS plane, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS position FROM nation")
def plane_folders_in_order(spark, sf):
    d = read(spark, sf, "nation").select(F.col("n_regionkey").alias("ds"), F.concat(F.lit("/data/"), F.col("n_name"), F.lit("/plane"), F.col("n_nationkey").cast("string")).alias("path"))
    other = d.withColumn("path", F.lit("/data/combined"))
    return planes.ordered_planes(d.unionByName(other), "path", ["ds"]).select("ds", "plane", "position")


@query("SELECT DISTINCT n_regionkey AS ds, unnest(range(n_nationkey, n_nationkey + n_nationkey % 4 * 2))::BIGINT AS slice FROM nation")
def evaluated_slices(spark, sf):
    d = read(spark, sf, "nation").select(F.col("n_regionkey").alias("ds"), F.col("n_nationkey").alias("a"), (F.col("n_nationkey") + F.col("n_nationkey") % 4 * 2 - 1).alias("b"))
    return tables.union_of_ranges(d, ["ds"], "a", "b", "slice")


@query(f"WITH {REFERENCE_SQL} SELECT frame, min(plane - ref) AS low, max(plane - ref) AS high FROM bp GROUP BY frame")
def shift_extremes(spark, sf):
    return planes.shift_extremes(reference_correlations(spark, sf))


@query(f"""WITH {REFERENCE_SQL}, s AS (SELECT plane, avg(corr) AS corr FROM rc WHERE ref = 0 GROUP BY plane), w AS (SELECT o AS "offset", coalesce(corr, 0) AS x FROM (VALUES (-1), (0), (1)) v(o) LEFT JOIN s ON s.plane = {PLANES - 1} + o)
    SELECT "offset"::BIGINT AS "offset", round(x / sum(x) OVER (), 6) AS weight FROM w""")
def reference_similarity_weights(spark, sf):
    s = reference_correlations(spark, sf).filter("ref = 0").groupBy("plane").agg(F.avg("corr").alias("corr"))
    return planes.similarity_weights(s, PLANES - 1)


@query(f"""WITH {REFERENCE_SQL}, r AS (SELECT frame, plane, min(corr) < 5 AS bad, floor(max(corr))::BIGINT AS xoff, floor(min(corr))::BIGINT AS yoff FROM rc GROUP BY ALL), n AS (SELECT frame, plane + o AS plane FROM bp CROSS JOIN (VALUES (-1), (0), (1)) v(o) WHERE ref = 0)
    SELECT n.frame, n.plane, coalesce(bad, false) AS bad, CASE WHEN NOT bad THEN xoff ELSE 0 END AS xoff, CASE WHEN NOT bad THEN yoff ELSE 0 END AS yoff FROM n LEFT JOIN r USING (frame, plane)""")
def combined_shifts(spark, sf):
    r = reference_correlations(spark, sf).groupBy("frame", "plane").agg((F.min("corr") < 5).alias("bad"), F.floor(F.max("corr")).alias("xoff"), F.floor(F.min("corr")).alias("yoff"))
    return planes.combine_neighbours(planes_of_reference(spark, sf), r)


@query(f"""WITH {REFERENCE_SQL}, b AS (SELECT frame, plane, corr FROM bp WHERE ref = 0), l AS (SELECT avg(corr) - 1.5 * stddev_pop(corr) AS x FROM b) SELECT frame, plane, {r6('corr')}, round(x, 6) AS "limit", corr <= x AS low FROM b, l""")
def zposition_panel(spark, sf):
    return planes.with_correlation_limit(planes_of_reference(spark, sf), "corr", 1.5).select("frame", "plane", "corr", "limit", "low")


# Where each plane lies, in microns from the reference.
_DEPTHS = ((0, -10.0), (1, -4.0), (2, 0.0), (3, 5.0), (4, 11.0))


@query(f"""WITH {REFERENCE_SQL}, d AS (SELECT * FROM (VALUES {", ".join(f"({p}, {u}::DOUBLE)" for p, u in _DEPTHS)}) v(plane, um)), e AS (SELECT ref, um - (frame - 15) AS e, frame - 15 AS x FROM bp JOIN d USING (plane))
    SELECT ref, round(sqrt(avg(e * e)), 6) AS rmse, count(e) AS n, round(sqrt(avg(e * e) FILTER (x BETWEEN -10 AND 11)), 6) AS rmse_inside, count(e) FILTER (x BETWEEN -10 AND 11) AS n_inside FROM e GROUP BY ref""")
def displacement_rmse(spark, sf):
    depths = values(spark, "plane long, um double", *_DEPTHS)
    d = tables.index_of(planes.best_planes(reference_correlations(spark, sf)), "plane", depths).withColumn("measured", F.col("frame") - 15)
    return tables.displacement_errors(d, ["ref"], "um", "measured", depths, "um")


def _side(spark, sf, plane: int, out: str):
    e = read(spark, sf, "events").filter((F.col("user_id") % PLANES == plane) & (F.col("event_type") != ("error" if plane else "view")))
    return e.groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.avg("value").alias(out))


@query(f"""WITH s AS (SELECT user_id % {PLANES} AS plane, date_trunc('hour', ts) AS h, event_type, value FROM events), a AS (SELECT h, avg(value) AS a FROM s WHERE plane = 0 AND event_type <> 'view' GROUP BY h), b AS (SELECT h, avg(value) AS b FROM s WHERE plane = 1 AND event_type <> 'error' GROUP BY h),
    x AS (SELECT extract(hour FROM h)::BIGINT AS k, a, b FROM a FULL JOIN b USING (h))
    SELECT k, round(quantile_cont(b - a, 0.05), 6) AS difference_low, round(quantile_cont(b - a, 0.95), 6) AS difference_high,
    round(CASE WHEN count(a + b) >= 3 THEN covar_pop(a, b) / nullif(stddev_pop(a) FILTER (b IS NOT NULL) * stddev_pop(b) FILTER (a IS NOT NULL), 0) END, 6) AS correlation,
    round(100.0 * count(*) FILTER (a IS NOT NULL AND b IS NULL) / nullif(count(a), 0), 6) AS removed FROM x GROUP BY k""")
def registered_against_reference(spark, sf):
    d = _side(spark, sf, 0, "a").join(_side(spark, sf, 1, "b"), "h", "full_outer").withColumn("k", F.hour("h"))
    return composite.trace_differences(d, ["k"], "a", "b").drop("ratio_low", "ratio_high")


@query(f"""WITH {TRACE_SQL}, c AS (SELECT *, row_number() OVER (PARTITION BY roi ORDER BY segment, frame) - 1 AS at FROM tr) SELECT roi, frame AS at, {r6('value')} FROM c WHERE segment = 1""")
def named_segment(spark, sf):
    d = sequence.number(traces(spark, sf), ["roi"], ["segment", "frame"], "at")
    s = d.groupBy("roi", F.concat(F.lit("part"), F.col("segment").cast("string")).alias("name")).agg(F.min("at").alias("start"), (F.max("at") + 1).alias("stop"))
    return tables.named_slice(d, s, ["roi"], "part1", "at").select("roi", "at", "value")


@query("""SELECT o_custkey, o_orderpriority, o_orderstatus, n > 1 AS conflict FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderstatus) AS r FROM orders WHERE o_orderstatus <> 'P')
    JOIN (SELECT o_custkey, count(DISTINCT (o_orderpriority, o_orderstatus)) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey) USING (o_custkey) WHERE r = 1""")
def reviewed_metadata(spark, sf):
    o = read(spark, sf, "orders").withColumn("o_orderstatus", F.when(F.col("o_orderstatus") == "P", F.lit("  ")).otherwise(F.col("o_orderstatus")))
    return tables.reviewed(o, ["o_custkey"], ["o_orderpriority", "o_orderstatus"])


@query("SELECT n_nationkey, CASE WHEN n_regionkey < 3 THEN '/mnt/raw/' || n_name || '/a.tif' END AS path FROM nation")
def relocated_paths(spark, sf):
    n = read(spark, sf, "nation")
    return n.select("n_nationkey", tables.relocated(F.concat(F.when(F.col("n_regionkey") < 3, "D:/old/raw/").otherwise("D:/old/else/"), F.col("n_name"), F.lit("/a.tif")), "/mnt/raw/").alias("path"))


# The whole way to a corrected trace


_CORRECTED_SQL = f"""WITH {TRACE_SQL}, pr AS (SELECT roi, z, avg(value) AS p FROM tr GROUP BY ALL), fa AS (SELECT roi, z, p / nullif(max(CASE WHEN z = 10 THEN p END) OVER (PARTITION BY roi), 0) AS factor FROM pr),
    d AS (SELECT tr.*, factor FROM (SELECT roi, segment, frame, f, fneu, CASE WHEN NOT bad THEN z END AS z FROM tr) tr LEFT JOIN fa USING (roi, z)),
    v AS (SELECT *, CASE WHEN z IS NOT NULL AND lag(z) OVER (PARTITION BY roi, segment ORDER BY frame) IS NULL THEN 1 ELSE 0 END AS st FROM d),
    i AS (SELECT *, sum(st) OVER (PARTITION BY roi, segment ORDER BY frame) AS run FROM v), rn AS (SELECT *, row_number() OVER (PARTITION BY roi, segment, run ORDER BY frame) - 1 AS p, count(*) OVER (PARTITION BY roi, segment, run) AS n FROM i WHERE z IS NOT NULL),
    e AS (SELECT rn.roi, rn.segment, rn.run, rn.frame, w, (((rn.p + j) % (2 * n)) + 2 * n) % (2 * n) AS m, n FROM rn CROSS JOIN {_gauss(2.0)}),
    s AS (SELECT e.roi, e.segment, e.frame, CASE WHEN count(rn.factor) = count(*) THEN sum(w * rn.factor) END AS g FROM e JOIN rn ON rn.roi = e.roi AND rn.segment = e.segment AND rn.run = e.run AND rn.p = (CASE WHEN m < e.n THEN m ELSE 2 * e.n - 1 - m END) GROUP BY ALL),
    zc AS (SELECT d.roi, d.segment, d.frame, d.f / nullif(g, 0) AS f, d.fneu / nullif(g, 0) AS fneu FROM d LEFT JOIN s ON s.roi = d.roi AND s.segment = d.segment AND s.frame = d.frame), {_base_sql("zc")}"""


def _depth_corrected(spark, sf, faults: bool):
    d = traces(spark, sf)
    p = d.groupBy("roi", "z").agg(F.avg("value").alias("value"))
    d = d.select(*KEYS, "frame", "f", "fneu", F.when(~F.col("bad"), F.col("z")).alias("z"))
    return trace.correct_traces(d, p, ["roi"], "segment", "frame", "z", "z", 10, rate=2.0, percentile=8, window_s=10, faults=faults)


@query(f"{_CORRECTED_SQL} SELECT roi, segment, frame, {r6('f0', 'n0')}, round(f - (slope * (fneu - n0) + intercept), 6) AS fc, round((f - (slope * (fneu - n0) + intercept) - f0) / greatest(1, f0), 6) AS dff FROM c LEFT JOIN r USING (roi)")
def corrected_dff(spark, sf):
    return _depth_corrected(spark, sf, False).select(*KEYS, "frame", "f0", "n0", "fc", "dff")


@query()
def corrected_dff_without_faults(spark, sf):
    return _depth_corrected(spark, sf, True).select(*KEYS, "frame", "f0", "n0", "fc", "dff")


# The queries over images and streams are registered as their module is read; it takes ``query`` from here.
from . import imaging  # noqa: E402, F401
