"""Source divergence audit against brute force and DuckDB."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import divergence

from .fixtures import SCHEMA, awkward, prose, table_docs

RX = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least=30, top=50):
    """rows: (text, lang, source). Plain Python integers throughout."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = RX.findall((text or "").translate(LOWER))
        groups[lang].add(source)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[u] for u in kept) + 5 * len(kept)) for t in kept}  # noqa: E731, B023
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])
        q, p = share(whole), {s: share(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                for k, (item, v) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]):
                    out.append((lang, s, part, item, v, k + 1))
    return sorted(out)


def run(df, **more):
    return sorted(map(tuple, divergence.divergence(df, **more).collect()))


def plain(df):
    return [(r.text, r.lang, r.source) for r in df.collect()]


def test_query_matches_brute_force_and_sql(spark, sf):
    d = table_docs(spark, sf)
    want = brute(plain(d))
    assert run(d) == want
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(c.sql(divergence.divergence_sql()).fetchall()) == want


def many_sources(spark):
    """30 sources of two languages: terms that all use, that some use, that one uses."""
    r, rows = random.Random(4), []
    for i in range(600):
        s = r.randrange(30)
        words = [f"all{'abcdefgh'[r.randrange(8)]}" for _ in range(r.randrange(40))] + [f"few{chr(97 + s % 7)}{chr(97 + r.randrange(5))}" for _ in range(r.randrange(9))] + [f"own{chr(97 + s % 26)}{s // 26 * 'x'}" for _ in range(r.randrange(3))]
        r.shuffle(words)
        rows.append((i, " ".join(words), "en" if s % 3 else "de", f"s{s}", 0))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize(("light", "block", "held"), [(8, 256, 400_000), (2, 4, 5), (0, 7, 50), (100, 5, 50)])
def test_heavy_and_light_terms_add_up(spark, light, block, held):
    d = many_sources(spark)
    want = brute(plain(d), least=5, top=3)
    assert run(d, least_docs=5, top_terms=3, light=light, block=block, slice_terms=4, held=held) == want
    assert {x[2] for x in want} == {"pair", "term"}


def test_awkward_rows(spark):
    texts = [*awkward(), "Straße ÉCLAIR éclair x1y2 Ωmega", prose(8, 150_000)] * 2
    rows = [(None if i % 3 else i, t, (None, "", "en", "fr")[i % 4], (None, "a", "B", "ä", "")[i % 5], None) for i, t in enumerate(texts)]
    d = spark.createDataFrame([*rows, *rows[:4]], SCHEMA)
    more = d.select("*", *[F.lit("x").alias(c) for c in ("term", "n", "docs", "p", "q", "base", "place", "item", "value", "rank", "size")])
    for least in (1, 2, 30):
        want = brute(plain(d), least)
        assert run(d, least_docs=least) == want == run(more, least_docs=least)
    assert run(d.filter("false")) == []


def test_counts_beyond_64_bits_of_their_product(spark):
    n = spark.createDataFrame([(10**13, 3 * 10**13, 7)], "n long, total long, kept long")
    assert n.select(divergence.share("n", "total", "kept").alias("p")).first().p == 1 + 10**9 * (10**13 + 5) // (3 * 10**13 + 35)
