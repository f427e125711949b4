"""Source divergence audit: L1 distances between the term distributions of a language's sources, by a heavy-light split.

Term counts are summed inside the tasks first. A term that more than ``LIGHT`` sources of its language use is heavy: heavy terms
are dealt into slices, and NumPy compares two blocks of sources over a slice in a dense tile. The rest is sparse. A source
without a term holds the share of a count of zero (its base), so a pair's sum over all terms is, from four parts,
    |b - c| for each kept term  +  what the heavy terms of a tile differ from that  +  what each source's own light terms add against
    the other's base  +  a correction for each light term that both use,
where the correction |p - q| - |p - c| - |q - b| + |b - c| comes from the term's posting list of at most ``LIGHT`` sources.
The third part needs a source's light terms only as a histogram of their shares. All numbers are integers; the parts are added exactly.

Defined results: null text, language and source read as ''; sources without terms, or without kept ones, have counts of zero;
a language that keeps no term has distances of 0; repeated rows count as often as they stand there; no documents give no rows;
texts of any length are taken whole; ids and other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

TERM_RX = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: The same by byte: letters in lower case, bytes beyond ASCII as they are, blanks for all else.
TERM_BYTES = bytes(b if b >= 0x80 or chr(b).islower() else b + 32 if chr(b).isupper() else 0x20 for b in range(256))
#: Up to so many sources of a language use a light term; its posting list makes at most LIGHT * (LIGHT - 1) / 2 rows.
LIGHT = 8
#: Terms of a slice and sources of a block: a tile holds two arrays of SLICE x BLOCK integers.
SLICE, BLOCK = 256, 256
#: Distinct terms that a task holds before it hands them on.
HELD = 400_000
SCALE = 1_000_000_000
COUNTS = "lang string, source string, term string, n long, docs long"


def _counts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Sums of occurrences and of documents by language, source and term; each group also has a row with a null term.

    Texts stay UTF-8: one byte table lowers letters and blanks what is no part of a term.
    """
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    seen: set[tuple[str, str]] = set()
    names = ["lang", "source", "term", "n", "docs"]

    def rows(lang: str, source: str, terms: list, n: list, docs: list) -> pa.RecordBatch:
        group = [pa.array([x]).take(pa.array(np.zeros(len(terms), dtype="int64"))) for x in (lang, source)]
        return pa.RecordBatch.from_arrays([*group, pa.array(terms, type=pa.binary()).cast(pa.string()), pa.array(n, type=pa.int64()), pa.array(docs, type=pa.int64())], names=names)

    def out() -> Iterator[pa.RecordBatch]:
        for key, (n, docs) in held.items():
            terms = list(n)
            for k in range(0, len(terms), 50_000):
                part = terms[k : k + 50_000]
                yield rows(*key, part, [n[t] for t in part], [docs[t] for t in part])
        held.clear()

    size = 0
    for batch in batches:
        texts = batch.column(0).cast(pa.binary())
        for text, lang, source in zip(*(c.to_pylist() for c in (texts, batch.column(1), batch.column(2)))):
            key = (lang or "", source or "")
            if key not in seen:
                seen.add(key)
                yield rows(*key, [None], [0], [0])
            terms = (text or b"").translate(TERM_BYTES).split()
            if not terms:
                continue
            n, docs = held.setdefault(key, (Counter(), Counter()))
            before = len(n)
            n.update(terms)
            docs.update(set(terms))
            size += len(n) - before
            if size > most:
                yield from out()
                size = 0
    yield from out()


def term_counts(documents: DataFrame, held: int = HELD) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents; a row with a null term for each group of documents."""
    parts = documents.select("text", "lang", "source").mapInArrow(lambda it: _counts(it, held), COUNTS)
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, kept: str) -> F.Column:
    """1 + floor(10^9 (n + 5) / (total + 5 kept)) in whole numbers of any size."""
    return F.expr(f"1 + CAST(CAST({n} + 5 AS DECIMAL(20, 0)) * {SCALE} AS DECIMAL(38, 0)) div CAST({total} + 5 * {kept} AS DECIMAL(20, 0))")


def audit_tables(documents: DataFrame, least_docs: int, light: int = LIGHT, held: int = HELD) -> tuple[DataFrame, DataFrame]:
    """(groups, cells), both written to the shared folder.

    groups: lang, source, place (0, 1, ... by source), size (groups of the language), kept (terms), heavy (terms), base.
    cells: lang, place, term, n, p (share in the group), q (share in the language), base, users, heavy.
    """
    counts = written(term_counts(documents, held), "divergence-counts")
    term = Window.partitionBy("lang", "term")
    used = counts.filter("term IS NOT NULL").select("*", F.sum("docs").over(term).alias("all_docs"), F.sum("n").over(term).alias("all_n"), F.count("*").over(term).alias("users"))
    used = written(used.filter(F.col("all_docs") >= least_docs).drop("docs", "all_docs"), "divergence-kept")
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    by_term = used.groupBy("lang", "term").agg(F.first("users").alias("users"), F.first("all_n").alias("all_n"))
    langs = by_term.groupBy("lang").agg(F.count("*").alias("kept"), F.sum((F.col("users") > light).cast("long")).alias("heavy"), F.sum("all_n").alias("lang_total"))
    groups = counts.filter("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    # One row for each source of a language; the result has a row for each pair of them.
    groups = groups.select("lang", "source", *map(zero, ("total", "kept", "heavy", "lang_total")))
    groups = groups.select("*", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("place"), F.count("*").over(Window.partitionBy("lang")).cast("int").alias("size"))
    base = F.when(F.col("kept") > 0, share("0", "total", "kept")).otherwise(F.lit(0))
    groups = written(groups.withColumn("base", base.cast("long")), "divergence-groups")
    cells = used.join(groups, ["lang", "source"]).select(
        "lang", "place", "term", "n", share("n", "total", "kept").alias("p"), share("all_n", "lang_total", "kept").alias("q"), "base", "users", "heavy", (F.col("users") > light).alias("is_heavy")
    )
    return groups, written(cells, "divergence-cells")


PARTS = "lang string, i int, j int, value long"


def _blocks_of(df: DataFrame, block: int) -> DataFrame:
    """Each row once for every pair of blocks (bi <= bj) that its source's block is in."""
    own, last = F.expr(f"place div {block}").cast("int"), F.expr(f"(size - 1) div {block}").cast("int")
    pairs = F.transform(F.sequence(F.lit(0), last), lambda b: F.struct(F.least(own, b).alias("bi"), F.greatest(own, b).alias("bj")))
    return df.select("*", F.explode(pairs).alias("_b")).select(*df.columns, "_b.bi", "_b.bj")


def _pairs(lang: str, x: np.ndarray, y: np.ndarray, d: np.ndarray) -> pd.DataFrame:
    """Rows of a tile's result for i < j."""
    a, b = np.nonzero(x[:, None] < y[None, :])
    return pd.DataFrame({"lang": lang, "i": x[a].astype("int32"), "j": y[b].astype("int32"), "value": d[a, b]})


def _dense_tile(key: tuple, rows: pd.DataFrame, block: int) -> pd.DataFrame:
    """Sum of |p - q| - |b - c| over a slice's terms that the sources of two blocks use. Rows without a term carry the bases."""
    lang, _, bi, bj = key
    bases = rows[rows.term.isna()]
    cells = rows[rows.term.notna()]
    terms, t = np.unique(cells.term.to_numpy(dtype=object).astype(str), return_inverse=True)

    def side(number: int) -> tuple[np.ndarray, np.ndarray]:
        own = bases[bases.place // block == number].sort_values("place")
        places, m = own.place.to_numpy(), np.repeat(own.base.to_numpy()[:, None], len(terms), axis=1)
        mine = (cells.place // block == number).to_numpy()
        m[np.searchsorted(places, cells.place.to_numpy()[mine]), t[mine]] = cells.p.to_numpy()[mine]
        return places, m

    (x, p), (y, q) = side(bi), side(bj)
    if not len(terms):
        return _pairs(lang, x[:0], y, np.zeros((0, len(y)), dtype="int64"))
    d = np.stack([np.abs(q - row).sum(axis=1) for row in p])
    b, c = (bases.sort_values("place").base.to_numpy()[np.searchsorted(np.sort(bases.place.to_numpy()), z)] for z in (x, y))
    return _pairs(lang, x, y, d - len(terms) * np.abs(b[:, None] - c[None, :]))


def _sparse_tile(key: tuple, rows: pd.DataFrame, block: int) -> pd.DataFrame:
    """|b - c| for each kept term, and what each source's own light terms add against the other's base."""
    lang, bi, bj = key
    bases = rows[rows.p.isna()]
    shares = rows[rows.p.notna()]

    def side(number: int) -> tuple[np.ndarray, np.ndarray]:
        own = bases[bases.place // block == number].sort_values("place")
        return own.place.to_numpy(), own.base.to_numpy()

    (x, b), (y, c) = side(bi), side(bj)
    each = np.abs(b[:, None] - c[None, :])
    d = each * int(bases.kept.iloc[0])
    histograms = {g: (h.p.to_numpy(dtype="int64"), h.n.to_numpy(dtype="int64")) for g, h in shares.sort_values("p").groupby("place")}

    def own_terms(place: int, others: np.ndarray) -> np.ndarray:
        """Sum of |p - c| over a source's light terms, for each c, by running sums over their sorted shares."""
        p, n = histograms.get(place, (np.zeros(0, "int64"), np.zeros(0, "int64")))
        k = np.searchsorted(p, others)
        count, total = np.concatenate(([0], np.cumsum(n))), np.concatenate(([0], np.cumsum(n * p)))
        return others * (2 * count[k] - count[-1]) + total[-1] - 2 * total[k], count[-1]

    for k, place in enumerate(x):
        against, n = own_terms(place, c)
        d[k] += against - n * each[k]
    for k, place in enumerate(y):
        against, n = own_terms(place, b)
        d[:, k] += against - n * each[:, k]
    return _pairs(lang, x, y, d)


def pair_distances(groups: DataFrame, cells: DataFrame, light: int = LIGHT, block: int = BLOCK, slice_terms: int = SLICE) -> DataFrame:
    """lang, i, j, value: the distance of every two sources of a language, i < j by place."""
    sizes = groups.select("lang", "place", "size")
    heavy = cells.filter("is_heavy").join(sizes, ["lang", "place"])
    n_slices = F.expr(f"CAST((heavy + {slice_terms - 1}) div {slice_terms} AS INT)")
    dense = heavy.select("lang", F.pmod(F.xxhash64("term"), n_slices).cast("int").alias("slice"), "place", "size", "base", "term", "p")
    fill = groups.filter("heavy > 0").select("lang", F.explode(F.sequence(F.lit(0), n_slices - 1)).alias("slice"), "place", "size", "base", F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("p"))
    dense = _blocks_of(dense.unionByName(fill), block).groupBy("lang", "slice", "bi", "bj").applyInPandas(lambda key, rows: _dense_tile(key, rows, block), PARTS)

    rare = cells.filter("NOT is_heavy")
    histogram = rare.groupBy("lang", "place", "p").agg(F.count("*").alias("n")).join(sizes, ["lang", "place"])
    own = groups.select("lang", "place", F.lit(None).cast("long").alias("p"), F.lit(None).cast("long").alias("n"), "size", "base", "kept")
    sparse = own.unionByName(histogram.select("lang", "place", "p", "n", "size", F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("kept")))
    sparse = _blocks_of(sparse, block).groupBy("lang", "bi", "bj").applyInPandas(lambda key, rows: _sparse_tile(key, rows, block), PARTS)

    postings = rare.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("place", "p", "base"))).alias("u"))  # `light` at most
    after = F.transform("u", lambda x, i: F.transform(F.slice("u", i + 2, max(light, 1)), lambda y: F.struct(x.alias("x"), y.alias("y"))))
    both = postings.select("lang", F.explode(F.flatten(after)).alias("e"))
    gap = lambda a, b: F.abs(F.col(f"e.{a}") - F.col(f"e.{b}"))
    fix = gap("x.p", "y.p") - gap("x.p", "y.base") - gap("y.p", "x.base") + gap("x.base", "y.base")
    corrections = both.groupBy("lang", F.col("e.x.place").cast("int").alias("i"), F.col("e.y.place").cast("int").alias("j")).agg(F.sum(fix).alias("value"))
    return dense.unionByName(sparse).unionByName(corrections).groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))


def divergence(documents: DataFrame, least_docs: int = 30, top_terms: int = 50, light: int = LIGHT, block: int = BLOCK, slice_terms: int = SLICE, held: int = HELD) -> DataFrame:
    """lang, source, part, item, value, rank: each source's distances to the others of its language, and the terms it overuses most."""
    groups, cells = audit_tables(documents, least_docs, light, held)
    names = groups.select("lang", "place", "source")
    d = pair_distances(groups, cells, light, block, slice_terms)
    ways = F.explode(F.array(F.struct(F.col("i").alias("place"), F.col("j").alias("other")), F.struct(F.col("j").alias("place"), F.col("i").alias("other"))))
    pairs = d.select("lang", "value", ways.alias("w")).select("lang", "w.place", "w.other", "value")
    pairs = pairs.join(names.select("lang", F.col("place").alias("other"), F.col("source").alias("item")), ["lang", "other"]).select("lang", "place", F.lit("pair").alias("part"), "item", "value")
    order = Window.partitionBy("lang", "place").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    # The limit is applied inside the tasks before the rows of a source meet.
    terms = cells.filter("n > 0 AND p > q").select("lang", "place", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_terms)
    return pairs.unionByName(terms).join(names, ["lang", "place"]).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))


def divergence_sql() -> str:
    """The same rows in DuckDB: every source against every term its language keeps."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    p = lambda n, total: f"1 + ({SCALE}::HUGEINT * ({n} + 5)) // ({total} + 5 * kept)"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{upper}', '{upper.lower()}') AS t FROM documents),
    w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '{TERM_RX}')) AS term FROM d),
    terms AS (SELECT lang, term, count(*) AS all_n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 30),
    g AS (SELECT DISTINCT lang, source FROM d),
    cell AS (SELECT g.lang, g.source, terms.term, all_n, coalesce(n, 0) AS n FROM g JOIN terms USING (lang) LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL) c ON c.lang = g.lang AND c.source = g.source AND c.term = terms.term),
    langs AS (SELECT lang, count(*) AS kept, sum(all_n) AS lang_total FROM terms GROUP BY lang),
    totals AS (SELECT lang, source, sum(n) AS total FROM cell GROUP BY ALL),
    shares AS (SELECT cell.lang, cell.source, term, n, {p('n', 'total')} AS p, {p('all_n', 'lang_total')} AS q FROM cell JOIN totals ON totals.lang = cell.lang AND totals.source = cell.source JOIN langs ON langs.lang = cell.lang),
    apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source),
    over AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM shares WHERE n > 0 AND p > q),
    ranked AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM over))
    SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50"""
