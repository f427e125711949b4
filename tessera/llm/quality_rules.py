"""Quality rules: counts of words and repeats, and perplexity bands of an n-gram model.

The model is a modified Kneser-Ney model over characters, one for each language. Spark counts the
n-grams over all clean documents (tasks count their own share first, so the shuffle carries distinct n-grams,
not occurrences), and lower orders, discounts, back-off weights and probabilities are tables that joins
and groupings make from the counts. A document is clean, and so trains the model, if it passes the base rules, at most
one in SYMBOLS_IN of its word characters is a symbol, and at most one in CAPITALS_IN of its ASCII letters is a capital.

A model for scoring is stored in sorted hash arrays: for each language and order the n-grams' whole 64-bit keys, beside
them the log probabilities and the back-off weights; no two n-grams share a place. At most MOST n-grams an order are
broadcast, those with the highest counts (the threshold comes from a histogram). Where a model has more, n-grams of a document
that the arrays lack are joined to the table of the whole model by key, so what is scored does not depend on
the bound; only an n-gram that the whole model lacks backs off, by joins too where the arrays lack n-grams of a lower order.

A document is rejected if it fails the base rules, or if its perplexity lies outside the
band of its language: the median of log perplexity over all clean documents, plus and
minus multiples of the median absolute deviation (upper and lower bands have their own; both are wider for short
documents).

n-grams never cross documents; a document starts with ORDER - 1 marks, and n-grams that start with a mark
have continuation counts like others. A character has 16 bits, so that four of them are one 64-bit key: those beyond share the
6,400 places of the private use area, and U+FFFF, which is the mark, counts as U+FFFE.

Defined cases: a null text is the empty text, which has no words, fails the base rules and has no perplexity;
a document that fails the base rules has none either; a null language, or one that is no two or three small letters, counts as
``und``; a language without clean documents has no band, and its documents are kept by the base rules alone; repeated rows count
as often as they occur and get a row each; ties do not arise, since every statistic is a count or a quantile of a
histogram; columns besides the id, text and language are ignored, whatever their names; a very long text costs memory in
proportion to its length; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import Block, blocks, mix, repeated_windows
from .common import whole_text, written

ORDER = 4
#: n-grams of an order that are broadcast; n occurrences are in bin floor(COUNT_BINS * log2(n)).
MOST, COUNT_BINS = 1 << 20, 8
MARK = 0xFFFF
#: Log probability of a character in a language without a model: one of 2**16.
LOG_UNIFORM = -16 * math.log(2)
#: Distinct n-grams that a counting task holds before it hands them on.
HELD = 1 << 20
#: Documents that are scored together.
ROWS = 1024

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
#: Of a clean document at most one in so many word characters is a symbol, and one in so many ASCII letters a capital.
SYMBOLS_IN, CAPITALS_IN = 100, 5

#: Bands: multiples of the scaled deviation, which is at least LEAST_DEVIATION (of log perplexity).
UPPER, LOWER, LEAST_DEVIATION = 6.0, 6.0, 0.02
#: The mean over few characters varies more: a band is wider by sqrt(1 + SHORT / characters in words).
SHORT = 1000
#: Bins of log perplexity to one unit.
BINS = 1000


def language(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.rlike("^[a-z]{2,3}$"), low).otherwise("und")


def _by_language(batch: pa.RecordBatch, lang: int, text: int) -> Iterator[tuple[str, np.ndarray, pa.Array]]:
    """(language, row numbers, texts) of a batch."""
    codes = batch.column(lang).dictionary_encode()
    index = codes.indices.to_numpy(zero_copy_only=False)
    for k, name in enumerate(codes.dictionary.to_pylist()):
        rows = np.flatnonzero(index == k)
        yield name, rows, batch.column(text).take(pa.array(rows))


def grams(b: Block, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-gram that ends at each character, and the offsets of the rows in them."""
    points, offs = b.code_points()
    lens = np.diff(offs)
    pad = order - 1
    padded = np.full(len(points) + pad * b.n, MARK, dtype=np.uint64)
    at = np.arange(len(points)) + pad * (np.repeat(np.arange(b.n), lens) + 1)
    points = np.where(points > 0xFFFF, 0xE000 + points % 6400, points)
    padded[at] = np.where(points == MARK, MARK - 1, points)
    key = np.zeros(len(points), dtype=np.uint64)
    for j in range(pad, -1, -1):
        key = (key << np.uint64(16)) | padded[at - j]
    return key, offs


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for name, parts in held.items():
            keys, counts = _merged(parts)
            for lo in range(0, len(keys), 1 << 16):
                k = keys[lo : lo + (1 << 16)]
                yield pa.record_batch([pa.array([name] * len(k)), pa.array(k.view(np.int64)), pa.array(counts[lo : lo + (1 << 16)])], names=["lang", "g", "n"])
        held.clear()

    for batch in batches:
        for name, _, texts in _by_language(batch, 0, 1):
            for _, _, b in blocks(texts):
                keys, offs = grams(b)
                keys, counts = np.unique(keys[np.repeat(clean(b, rule_counts(b)), np.diff(offs))], return_counts=True)
                parts = held.setdefault(name, [])
                parts.append((keys, counts))
                size += len(keys)
        if size > HELD:
            for name, parts in held.items():
                held[name] = [_merged(parts)]
            size = sum(len(p[0][0]) for p in held.values())
            if size > HELD // 2:
                yield from out()
                size = 0
    yield from out()


def count_grams(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, g, n: the n-grams of the highest order with their counts over all clean documents."""
    d = docs.select(language(docs[lang_col]).alias("lang"), whole_text(docs, text_col).alias("t"))
    return d.mapInArrow(_count_batches, "lang string, g bigint, n bigint").groupBy("lang", "g").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, k, g, n, p, back: interpolated probabilities of the n-grams of each order k, and back-off weights.

    ``back`` belongs to the n-gram as a context of order k + 1 (null where it never is one). Rows with k = 0
    hold the share of a character that was never seen.
    """
    tables = {order: written(counts, "grams")}
    for k in range(order - 1, 0, -1):
        mask = (1 << (16 * k)) - 1
        tables[k] = written(tables[k + 1].groupBy("lang", F.col("g").bitwiseAND(F.lit(mask)).alias("g")).agg(F.count(F.lit(1)).alias("n")), f"grams-{k}")
    every = tables[1].withColumn("k", F.lit(1))
    for k in range(2, order + 1):
        every = every.unionByName(tables[k].withColumn("k", F.lit(k)))
    seen = [F.sum((F.col("n") == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    some = lambda i: F.when((F.col("n1") > 0) & (F.col(f"n{i}") > 0), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"))
    # Too few counts for an estimate: the discount of absolute discounting, 0.5.
    discounts = written(every.groupBy("k", "lang").agg(*seen).select("k", "lang", *[F.greatest(F.lit(0.05), F.least(F.lit(i * 0.95), F.coalesce(some(i), F.lit(0.5)))).alias(f"d{i}") for i in (1, 2, 3)]), "discounts")

    def discounted(k: int) -> DataFrame:
        d = discounts.filter(F.col("k") == k).drop("k")
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        return tables[k].join(F.broadcast(d), "lang").select("lang", "g", "n", F.shiftrightunsigned("g", 16).alias("ctx"), cut.alias("cut"))

    ctx = {k: discounted(k).groupBy("lang", "ctx").agg(F.sum("n").alias("total"), F.sum("cut").alias("mass")) for k in range(1, order + 1)}
    ctx = {k: written(t, f"contexts-{k}") for k, t in ctx.items()}
    # The lowest order falls back to the uniform share of a character of 2**16.
    low = F.lit(2.0**-16)
    out = ctx[1].select("lang", F.lit(0).alias("k"), F.lit(0).cast("long").alias("g"), F.lit(1).cast("long").alias("n"), (F.col("mass") / F.col("total") * low).alias("p"), F.lit(None).cast("double").alias("back"))
    for k in range(1, order + 1):
        t = discounted(k).join(ctx[k], ["lang", "ctx"])
        if k > 1:
            mask = (1 << (16 * (k - 1))) - 1
            t, low = t.withColumn("low", F.col("g").bitwiseAND(F.lit(mask))).join(lower, ["lang", "low"]), F.col("lp")
        t = t.select("lang", F.lit(k).alias("k"), "g", "n", ((F.col("n") - F.col("cut")) / F.col("total") + F.col("mass") / F.col("total") * low).alias("p"))
        if k < order:
            back = ctx[k + 1].select("lang", F.col("ctx").alias("g"), (F.col("mass") / F.col("total")).alias("back"))
            t = t.join(back, ["lang", "g"], "full_outer").select("lang", F.coalesce("k", F.lit(k)).alias("k"), "g", F.coalesce("n", F.lit(1)).alias("n"), "p", "back")
        else:
            t = t.withColumn("back", F.lit(None).cast("double"))
        t = written(t, f"probabilities-{k}")
        # A context that is the end of no n-gram has no probability, and no n-gram falls back to it.
        lower = t.select("lang", F.col("g").alias("low"), F.col("p").alias("lp"))
        out = out.unionByName(t)
    return out


@dataclass
class HashedModel:
    """By language and order: sorted keys, log probabilities and log back-off weights. ``whole``: no n-gram is left out; ``lower``: none below the highest order."""

    order: int
    whole: bool
    lower: bool
    arrays: dict[tuple[str, int], tuple[np.ndarray, np.ndarray, np.ndarray]]
    _places: dict[str, np.ndarray] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_places": {}}

    def _find(self, lang: str, k: int, keys: np.ndarray, back: bool = False) -> np.ndarray:
        have = self.arrays.get((lang, k))
        if have is None:
            return np.full(len(keys), np.nan, dtype=np.float32)
        at = np.minimum(np.searchsorted(have[0], keys), len(have[0]) - 1)
        return np.where(have[0][at] == keys, have[1 + back][at], np.float32(np.nan))

    def top(self, lang: str, keys: np.ndarray) -> np.ndarray:
        """Log probability of each n-gram of the highest order, nan where the arrays lack it.

        A key's hash tells its place in the sorted array; keys that another one has displaced there are searched for.
        """
        have = self.arrays.get((lang, self.order))
        if have is None:
            return np.full(len(keys), np.nan, dtype=np.float32)
        bits = np.uint64(64 - len(have[0]).bit_length() - 2)
        if lang not in self._places:
            self._places[lang] = np.zeros(1 << (64 - int(bits)), dtype=np.int32)
            self._places[lang][mix(have[0]) >> bits] = np.arange(len(have[0]), dtype=np.int32)
        at = self._places[lang][mix(keys) >> bits]
        out = np.where(have[0][at] == keys, have[1][at], np.float32(np.nan))
        lost = np.flatnonzero(np.isnan(out))
        out[lost] = self._find(lang, self.order, keys[lost])
        return out

    def backed_off(self, lang: str, keys: np.ndarray) -> np.ndarray:
        """Log probability of n-grams that the highest order lacks."""
        weight = np.zeros(len(keys), dtype=np.float32)
        value = np.full(len(keys), np.nan, dtype=np.float32)
        for k in range(self.order - 1, -1, -1):
            todo = np.isnan(value)
            mask = np.uint64((1 << (16 * k)) - 1)
            if k:
                weight[todo] += np.nan_to_num(self._find(lang, k, (keys[todo] >> np.uint64(16)) & mask, back=True), nan=0.0)
            value[todo] = weight[todo] + self._find(lang, k, keys[todo] & mask)
        return np.where(np.isnan(value), np.float32(LOG_UNIFORM), value)

    def score(self, lang: str, keys: np.ndarray) -> np.ndarray:
        """Log probability of each n-gram's last character after the others, of a whole model."""
        out = self.top(lang, keys)
        open_at = np.flatnonzero(np.isnan(out))
        out[open_at] = self.backed_off(lang, keys[open_at])
        return out


def _count_bin() -> Column:
    return F.floor(F.log2("n") * COUNT_BINS)


def hashed(model: DataFrame, order: int = ORDER, most: int = MOST) -> HashedModel:
    """The model in sorted hash arrays, with the ``most`` n-grams an order that have the highest counts."""
    counts = model.groupBy("k", _count_bin().alias("bin")).agg(F.count(F.lit(1)).alias("n")).orderBy("k", F.desc("bin")).collect()
    least, have = {}, {}
    for r in counts:
        have[r.k] = have.get(r.k, 0) + r.n
        if have[r.k] <= most:
            least[r.k] = r.bin
    keep = F.lit(False)
    for k in have:
        keep = keep | ((F.col("k") == k) & (_count_bin() >= least.get(k, 1 << 20)))
    t = model.filter(keep).select("lang", "k", "g", F.log("p").cast("float").alias("logp"), F.log("back").cast("float").alias("back")).toArrow()
    codes = t.column("lang").combine_chunks().dictionary_encode()
    codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
    lang, k, g = codes.indices.to_numpy(), t.column("k").to_numpy(), t.column("g").to_numpy().view(np.uint64)
    logp, back = (t.column(c).to_numpy().astype(np.float32) for c in ("logp", "back"))
    arrays = {}
    for i, name in enumerate(codes.dictionary.to_pylist()):
        for j in np.unique(k[lang == i]).tolist():
            at = np.flatnonzero((lang == i) & (k == j))
            at = at[np.argsort(g[at])]
            arrays[name, j] = g[at], logp[at], back[at]
    return HashedModel(order, all(n <= most for n in have.values()), all(n <= most for k, n in have.items() if k < order), arrays)


def backed_off(grams: DataFrame, model: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, g, back: log probabilities of n-grams (lang, g) that the highest order lacks, from the table of the whole model."""
    low = lambda c, k: c.bitwiseAND(F.lit((1 << (16 * k)) - 1))
    at = F.array(*[F.struct(F.lit(k).alias("k"), low(F.col("g"), k).alias("at"), low(F.shiftrightunsigned("g", 16), k).alias("ctx")) for k in range(order)])
    d = grams.select("lang", "g", F.explode(at).alias("x")).select("lang", "g", "x.*")
    m = model.filter(F.col("k") < order).select("lang", "k", "g", F.log("p").alias("logp"), F.log("back").alias("weight"))
    d = d.join(m.select("lang", "k", F.col("g").alias("at"), "logp"), ["lang", "k", "at"], "left")
    d = d.join(m.select("lang", "k", F.col("g").alias("ctx"), "weight"), ["lang", "k", "ctx"], "left")
    # The longest end of the n-gram that the model has, with the weights of the contexts from there up.
    orders = F.reverse(F.array_sort(F.collect_list(F.struct("k", "logp", F.when(F.col("k") > 0, F.coalesce("weight", F.lit(0.0))).otherwise(0.0).alias("weight")))))
    d = d.groupBy("lang", "g").agg(orders.alias("_o"))
    start = F.struct(F.lit(0.0).alias("w"), F.lit(None).cast("double").alias("v"))
    step = lambda s, o: F.when(s["v"].isNotNull(), s).otherwise(F.struct((s["w"] + o["weight"]).alias("w"), (s["w"] + o["weight"] + o["logp"]).alias("v")))
    return d.select("lang", "g", F.coalesce(F.aggregate("_o", start, step)["v"], F.lit(LOG_UNIFORM)).alias("back"))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def rule_counts(b: Block) -> dict[str, np.ndarray]:
    """The base counts of each row of a block."""
    code = b.code_starts()
    hashes = b.word_hashes()
    # Lines: cut at \n and at the ends of the rows; a line is equal to an earlier one of its row.
    feed = np.flatnonzero(b.data == 0x0A)
    n_lines = b.per_row(b.data == 0x0A) + 1
    line_row = np.repeat(np.arange(b.n), n_lines)
    first = np.concatenate(([0], np.cumsum(n_lines)))[:-1]
    begin = np.zeros(int(n_lines.sum()), dtype=np.int64)
    is_first = np.zeros(len(begin), dtype=bool)
    is_first[first] = True
    begin[first] = b.offs[:-1]
    begin[~is_first] = feed + 1
    end = np.empty_like(begin)
    is_last = np.roll(is_first, -1)
    end[is_last] = b.offs[1:]
    end[~is_last] = feed
    words = np.searchsorted(b.starts, end) - np.searchsorted(b.starts, begin)
    worded = words > 0
    key = mix(b.span_hashes(begin[worded], end[worded]) ^ mix(line_row[worded].astype(np.uint64) + np.uint64(7)))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), dtype=np.int64)
    again[order[1:]] = key[order][1:] == key[order][:-1]
    dup = np.bincount(line_row[worded], weights=again, minlength=b.n).astype(np.int64)
    return {
        "n_words": np.diff(b.word_offs).astype(np.int64),
        "word_chars": b.per_row(b.is_word & code),
        "n_symbols": b.per_row(SYMBOLS[b.data]),
        "n_dup_lines": dup,
        "n_repeat_words": b.per_row(repeated_windows(hashes, b.word_offs, WINDOW), b.word_offs),
    }


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > REPEAT_PERCENT * counts["n_words"])


def clean(b: Block, counts: dict[str, np.ndarray]) -> np.ndarray:
    """Which rows of a block train the model."""
    capital = (b.data >= 65) & (b.data <= 90)
    capitals, letters = b.per_row(capital), b.per_row(capital | (b.data >= 97) & (b.data <= 122))
    return ~base_failed(counts) & (SYMBOLS_IN * counts["n_symbols"] <= counts["word_chars"]) & (CAPITALS_IN * capitals <= letters)


def _score_batches(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    m: HashedModel = model.value
    rare_type = pa.list_(pa.struct([("g", pa.int64()), ("n", pa.int64()), ("back", pa.float64())]))
    for batch in (x.slice(lo, ROWS) for x in batches for lo in range(0, x.num_rows, ROWS)):
        n = batch.num_rows
        out = {c: np.zeros(n, dtype=np.int64) for c in (*COUNTS, "chars")}
        total, trains = np.full(n, np.nan), np.zeros(n, dtype=bool)
        rare: list[list[dict]] = [[]] * n
        for name, rows, texts in _by_language(batch, 1, 2):
            for lo, hi, b in blocks(texts):
                at = rows[lo:hi]
                counts = rule_counts(b)
                for c, v in counts.items():
                    out[c][at] = v
                trains[at] = clean(b, counts)
                keys, offs = grams(b, m.order)
                lens = np.diff(offs)
                out["chars"][at] = lens
                wanted = ~base_failed(counts) & (lens > 0)
                scores = m.score(name, keys) if m.whole else m.top(name, keys)
                sums = np.concatenate(([0.0], np.cumsum(np.nan_to_num(scores), dtype=np.float64)))
                total[at] = np.where(wanted, sums[offs[1:]] - sums[offs[:-1]], np.nan)
                if not m.whole:
                    for i in np.flatnonzero(wanted):
                        open_ = keys[offs[i] : offs[i + 1]][np.isnan(scores[offs[i] : offs[i + 1]])]
                        g, times = np.unique(open_, return_counts=True)
                        rare[at[i]] = [{"g": x, "n": y, "back": z} for x, y, z in zip(g.view(np.int64).tolist(), times.tolist(), m.backed_off(name, g).tolist() if m.lower else [None] * len(g))]
        row = [f"{k}".encode() for k in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
        keys = pa.array([xxhash.xxh3_128_digest(x) for x in row], type=pa.binary())
        yield pa.record_batch([batch.column(0), batch.column(1), keys, *[pa.array(v) for v in out.values()], pa.array(trains), pa.array(total, mask=np.isnan(total)), pa.array(rare, type=rare_type)], names=["id", "lang", "key", *out, "clean", "total", "rare"])


def score(docs: DataFrame, model: HashedModel, whole: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, lang, the base counts, base_failed, clean, log_ppl (of a character; null where the base rules fail), as a written table.

    ``whole`` is the table of the model, which is needed where ``model`` does not have all of it.
    """
    d = docs.select(docs[id_col].alias("id"), language(docs[lang_col]).alias("lang"), whole_text(docs, text_col).alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, lang string, key binary, {', '.join(f'{c} bigint' for c in (*COUNTS, 'chars'))}, clean boolean, total double, rare array<struct<g:bigint,n:bigint,back:double>>"
    s = written(d.mapInArrow(lambda it: _score_batches(it, shared), schema), "quality-scores")
    more = F.lit(0.0)
    if not model.whole:
        top = whole.filter(F.col("k") == model.order).select("lang", "g", F.log("p").alias("logp"))
        # Rows that are equal have one key, and one sum.
        rare = s.select("key", "lang", F.explode("rare").alias("x")).select("key", "lang", "x.*").distinct().join(top, ["lang", "g"], "left")
        if not model.lower:
            rare = written(rare, "quality-rare")
            unseen = rare.filter(F.col("logp").isNull()).select("lang", "g").distinct()
            rare = rare.drop("back").join(backed_off(unseen, whole, model.order), ["lang", "g"], "left")
        rare = rare.groupBy("key").agg(F.sum(F.col("n") * F.coalesce("logp", "back")).alias("more"))
        s, more = s.join(rare, "key", "left"), F.coalesce("more", F.lit(0.0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    out = s.select("id", "lang", *COUNTS, failed.alias("base_failed"), "clean", (-(F.col("total") + more) / F.col("chars")).alias("log_ppl"))
    return out if model.whole else written(out, "quality-sums")


def bands(scored: DataFrame, upper: float = UPPER, lower: float = LOWER) -> DataFrame:
    """lang, mid, low, high: the bands of log perplexity, from histograms whose bins do not grow with the corpus."""
    h = scored.filter(F.col("clean") & F.col("log_ppl").isNotNull())
    h = h.groupBy("lang", F.floor(F.col("log_ppl") * BINS).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    h = written(h, "quality-histogram")

    def median(df: DataFrame, value: str, name: str) -> DataFrame:
        w = Window.partitionBy("lang")
        df = df.withColumn("upto", F.sum("n").over(w.orderBy(value))).withColumn("all", F.sum("n").over(w))
        return df.filter(2 * F.col("upto") >= F.col("all")).groupBy("lang").agg(F.min(value).alias(name))

    mid = written(median(h, "bin", "mid"), "quality-medians")
    off = h.join(F.broadcast(mid), "lang").withColumn("off", F.abs(F.col("bin") - F.col("mid"))).groupBy("lang", "mid", "off").agg(F.sum("n").alias("n"))
    dev = median(off, "off", "dev").join(F.broadcast(mid), "lang")
    spread = F.greatest(1.4826 * F.col("dev") / BINS, F.lit(LEAST_DEVIATION))
    return dev.select("lang", (F.col("mid") / BINS).alias("mid"), (F.col("mid") / BINS - lower * spread).alias("low"), (F.col("mid") / BINS + upper * spread).alias("high"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, the base counts, base_failed, kept, lang and perplexity: the model is trained on, and the bands are set by, all clean documents of docs."""
    whole = kneser_ney(count_grams(docs, text_col, lang_col))
    s = score(docs, hashed(whole), whole, id_col, text_col, lang_col)
    b = bands(s)
    wide = F.sqrt(1 + SHORT / F.greatest(F.col("word_chars"), F.lit(1)))
    off = F.col("log_ppl") - F.col("mid")
    kept = ~F.col("base_failed") & F.coalesce(off.between((F.col("low") - F.col("mid")) * wide, (F.col("high") - F.col("mid")) * wide), F.lit(True))
    return s.join(F.broadcast(b), "lang", "left").select(F.col("id").alias(id_col), *COUNTS, "base_failed", kept.alias("kept"), "lang", F.exp("log_ppl").alias("perplexity"))
