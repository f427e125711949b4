"""Importance resampling against brute force and DuckDB."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from tessera.llm import importance

from .fixtures import awkward, docs, prose, table_docs

RX = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
BENCH = [(1, prose(50, 60)), (2, None), (3, ""), (4, "Die Straße 12 Nº 😀 " + prose(51, 30))]


def grams(text, orders, buckets):
    w = RX.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, orders + 1) for i in range(len(w) - k + 1)]


def brute(rows, target, orders=1, buckets=10000, percent=10, least=20, seed=2024):
    cut = [(i, *grams(t, orders, buckets)) for i, t in rows]
    s, t = Counter(), Counter()
    for _, _, f in cut:
        s.update(f)
    for x in target:
        t.update(grams(x, orders, buckets)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in s}
    out = []
    for i, n, f in cut:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=repr)


def bench(spark):
    return spark.createDataFrame(BENCH, "item_id bigint, text string")


def run(df, target, **more):
    return sorted(map(tuple, importance.resample(df, target, **more).collect()), key=repr)


def test_query_matches_brute_force_and_sql(spark, sf):
    d, b = table_docs(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in d.collect()], [r.text for r in b.collect()])
    assert run(d, b) == want and any(r[4] for r in want)
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = c.sql(f"SELECT doc_id, n_features, weight, score, rank FROM ({importance.importance_sql()})").fetchall()
    assert sorted(got, key=repr) == [r[:5] for r in want]
    digest = importance.resample_digest(d, b)
    assert {t for _, t in digest.dtypes} == {"bigint"} and digest.count() == len(want)


def test_longer_runs_and_awkward_texts(spark):
    texts = [*awkward(), *[prose(s, 30) for s in range(200, 240)]]
    d = docs(spark, texts)
    for orders, buckets, percent in ((1, 10000, 30), (2, 500, 50), (3, 10000, 100)):
        want = brute(list(enumerate(texts)), [t for _, t in BENCH], orders, buckets, percent)
        assert run(d, bench(spark), orders=orders, buckets=buckets, percent=percent) == want


def test_null_and_repeated_rows_ties_and_clashing_names(spark):
    a, b = prose(1, 40), prose(2, 50)
    rows = [(None, a), (None, b), (5, a), (5, a), (5, a), (5, b), (6, None), (6, None), (7, ""), (None, None), (8, a.upper())]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    more = d.select("*", *[F.lit("x").alias(c) for c in ("word", "pos", "bucket", "n", "gain", "score", "rank", "_h1", "copies", "weight")])
    for orders in (1, 2):
        want = brute(rows, [t for _, t in BENCH], orders, percent=60)
        assert run(d, bench(spark), orders=orders, percent=60) == want
        assert run(more, bench(spark).withColumn("n", F.lit(1)), orders=orders, percent=60) == want


def test_empty_tables(spark):
    assert run(docs(spark, []), bench(spark)) == []
    texts = [prose(3, 40), None]
    assert run(docs(spark, texts), bench(spark).filter("false"), percent=100) == brute(list(enumerate(texts)), [], percent=100)


def test_draw_prefers_texts_like_the_target(spark):
    near = [prose(50, 200) for _ in range(30)]
    far = ["Quartz vexing jumps over lazy foxes number %d and nothing else is ever said here by anyone at all today or tomorrow" % i for i in range(270)]
    target = spark.createDataFrame([(1, prose(50, 5000))], "item_id bigint, text string")
    got = importance.resample(docs(spark, far + near), target).filter("rank IS NOT NULL").collect()
    assert len(got) == 30 and sum(r.doc_id >= 270 for r in got) >= 20  # 3 by chance
