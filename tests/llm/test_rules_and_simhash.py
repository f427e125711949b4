import collections
import math

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tessera.llm import quality_rules as Q
from tessera.llm import simhash as S

from .fixtures import WORD, awkward, docs, prose, table_docs


def brute_counts(text):
    t = text or ""
    words = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            inside |= set(range(i, i + 8))
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(inside), failed


def same_counts(df, rows):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows}
    want = {r.doc_id: brute_counts(r.text) for r in df.collect()}
    assert got == want


def test_base_counts_match_brute_force(spark, sf):
    for df in (docs(spark, awkward()), table_docs(spark, sf)):
        rows = Q.quality_rules(df).collect()
        same_counts(df, rows)
        assert all(not r.kept for r in rows if r.base_failed)


def brute_kneser_ney(texts, order):
    """Interpolated modified Kneser-Ney over characters, as dictionaries."""
    c = {order: collections.Counter()}
    for t in texts:
        s = "￿" * (order - 1) + t
        for i in range(order - 1, len(s)):
            c[order][s[i - order + 1 : i + 1]] += 1
    for k in range(order - 1, 0, -1):
        c[k] = collections.Counter(g[1:] for g in c[k + 1])
    p = {"": 2.0**-16}
    for k in range(1, order + 1):
        n = collections.Counter(c[k].values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        d = {}
        for i in (1, 2, 3):
            v = i - (i + 1) * y * n[i + 1] / n[i] if n[1] and n[i] else 0.5
            d[i] = max(0.05, min(i * 0.95, v))
        total, mass = collections.Counter(), collections.Counter()
        for g, m in c[k].items():
            total[g[:-1]] += m
            mass[g[:-1]] += d[min(m, 3)]
        for g, m in c[k].items():
            p[g] = (m - d[min(m, 3)]) / total[g[:-1]] + mass[g[:-1]] / total[g[:-1]] * p[g[1:]]
        p |= {("gamma", k, g): mass[g] / total[g] for g in total}
    return p


def test_model_matches_brute_force(spark):
    texts = [prose(i, 60) for i in range(8)]
    model = Q.kneser_ney(Q.count_grams(docs(spark, texts)))
    got = {(r.k, r.g): r.p for r in model.collect() if r.p is not None}
    want = brute_kneser_ney(texts, Q.ORDER)
    for k in range(1, Q.ORDER + 1):
        for g in [x for x in want if isinstance(x, str) and len(x) == k]:
            key = 0
            for ch in g:
                key = key << 16 | ord(ch)
            assert math.isclose(got[k, key - (1 << 64) if key >= 1 << 63 else key], want[g], rel_tol=1e-9)


def test_distribution_sums_to_one(spark):
    texts = [prose(i, 60) for i in range(4)]
    h = Q.hashed(Q.kneser_ney(Q.count_grams(docs(spark, texts))))
    seen = sorted(set("".join(texts)))
    ctx = [ord(c) for c in texts[0][5:8]]
    keys = np.array([(ctx[0] << 48) | (ctx[1] << 32) | (ctx[2] << 16) | ord(c) for c in seen], dtype=np.uint64)
    assert 0.98 < np.exp(h.score("en", keys).astype(float)).sum() <= 1.01


def test_unseen_n_grams_back_off_in_a_full_table(spark):
    texts = [prose(i, 60) for i in range(4)]
    h = Q.hashed(Q.kneser_ney(Q.count_grams(docs(spark, texts))))
    want = brute_kneser_ney(texts, Q.ORDER)
    letters = sorted(set("".join(texts)))
    rng = np.random.default_rng(2)
    unseen = [g for g in ("".join(rng.choice(letters, 4)) for _ in range(3000)) if g not in want][:400]
    assert len(unseen) == 400 and h.whole

    def p(g):
        k = len(g)
        if not g or g in want:
            return want[g] if g else want["gamma", 1, ""] * 2.0**-16
        return want.get(("gamma", k, g[:-1]), 1.0) * p(g[1:])

    keys = np.array([sum(ord(c) << 16 * (3 - i) for i, c in enumerate(g)) for g in unseen], dtype=np.uint64)
    got = h.score("en", keys)
    assert all(math.isclose(x, math.log(p(g)), rel_tol=1e-4) for x, g in zip(got, unseen))


def test_what_is_not_broadcast_is_joined(spark, monkeypatch):
    rows = [(None, prose(1, 60), "en"), (1, prose(2, 60), "de"), (1, prose(2, 60), "de"), (2, "😀 " + prose(3, 60), None), (3, "", "en")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").select("*", *[F.lit(1).alias(c) for c in ("id", "key", "kept", "n", "g", "clean")])
    want = sorted(((r.doc_id, r.kept, None if r.perplexity is None else round(r.perplexity, 4)) for r in Q.quality_rules(df).collect()), key=repr)
    assert len(want) == 5 and sum(x[2] is None for x in want) == 1
    monkeypatch.setattr(Q.hashed, "__defaults__", (Q.ORDER, 40))
    assert not Q.hashed(Q.kneser_ney(Q.count_grams(df))).whole
    got = sorted(((r.doc_id, r.kept, None if r.perplexity is None else round(r.perplexity, 4)) for r in Q.quality_rules(df).collect()), key=repr)
    assert got == want


def test_bands_reject_other_text(spark, sf):
    rng = np.random.default_rng(1)
    odd = " ".join("".join(chr(int(x)) for x in rng.integers(0x3A0, 0x4F0, 6)) for _ in range(80))
    rows = Q.quality_rules(docs(spark, [prose(i, 200) for i in range(60)] + [odd])).collect()
    kept = {r.doc_id: r.kept for r in rows}
    assert not kept[60] and all(kept[i] for i in range(60))


def test_bands_part_the_labels(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = Q.quality_rules(d).filter("NOT base_failed").join(labels, "doc_id").collect()
    good, bad = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.1


def test_empty_table(spark):
    df = docs(spark, [])
    assert Q.quality_rules(df).count() == 0
    assert S.simhash_digest(df).count() == 0


def brute_fingerprint(text, size=3):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(t)
    sh = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(fp, radius=2):
    ids = sorted(fp)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in ids:
        for y in ids:
            if x < y and (fp[x] ^ fp[y]).bit_count() <= radius:
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_matches_brute_force(spark, sf):
    for df in (docs(spark, awkward() + [prose(1, 120) + " tail", prose(1, 120)]), table_docs(spark, sf)):
        fp = {r.doc_id: brute_fingerprint(r.text) for r in df.collect()}
        want = brute_components(fp)
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.simhash_digest(df).collect()}
        assert got == {i: (f"{fp[i]:016x}", want[i]) for i in fp}


def test_links_in_large_groups_match_brute_force(spark):
    rng = np.random.default_rng(5)
    fps = set()
    for centre in rng.integers(0, 2**64, 3, dtype=np.uint64):
        for _ in range(150):
            x = int(centre)
            for b in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(S._signed(x),) for x in fps], "fp bigint")
    for paired in (0, 32, 1000):
        roots = {r.node & (2**64 - 1): r.root & (2**64 - 1) for r in S.components(S.links(df, 2, paired)).collect()}
        want = brute_components(dict(zip(fps, fps)))
        groups = lambda of: {frozenset(x for x in fps if of(x) == r) for r in {of(x) for x in fps}}
        assert groups(lambda x: roots.get(x, x)) == groups(lambda x: want[x])


def test_lower_orders_that_are_not_broadcast_are_joined(spark, monkeypatch):
    # Documents with many capitals or symbols train no model, so most of their n-grams back off, some to no order at all.
    loud = [prose(9, 60).upper(), prose(8, 60) + " #$ % & | <> *" * 20, " ".join("\u4e00\u4e01 Q" for _ in range(40)), prose(7, 50) + " zqx jqz" * 5]
    df = spark.createDataFrame([(i, t, "en" if i % 2 else "de") for i, t in enumerate([prose(i, 60) for i in range(6)] + loud + [prose(20, 40).upper()])], "doc_id bigint, text string, lang string")
    whole = Q.kneser_ney(Q.count_grams(df))
    want = {r.id: r.log_ppl for r in Q.score(df, Q.hashed(whole), whole).collect()}
    for most in (0, 15, 400):
        part = Q.hashed(whole, most=most)
        assert not part.lower
        got = {r.id: r.log_ppl for r in Q.score(df, part, whole).collect()}
        assert {i for i, x in got.items() if x is None} == {i for i, x in want.items() if x is None} and any(x is not None for x in want.values())
        assert all(math.isclose(got[i], x, rel_tol=1e-5) for i, x in want.items() if x is not None), most


def test_the_model_is_joined_once(spark):
    """Whoever reads the model reads written tables: joins that each reader plans again cost the driver's memory."""
    model = Q.kneser_ney(Q.count_grams(docs(spark, [prose(i, 60) for i in range(5)])))
    plan = model._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 0
    assert {r.k for r in model.select("k").distinct().collect()} == {0, 1, 2, 3, 4}
