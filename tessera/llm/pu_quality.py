"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled 1; all other documents are unlabelled, whatever they were labelled.
A small network minimises the non-negative unbiased risk: prior * R_positive(+) + max(0, R_unlabelled(-) -
prior * R_positive(-)), with sigmoid losses. The class prior is estimated from a first classifier of
positives against unlabelled, which learns from one half of the ids: over all documents of the other half,
histograms of its score are made for both, and the smallest ratio of the unlabelled share to the positive share above a score bounds the prior (best bin).

The features of every document come from its whole text. Means and deviations of the features and both
histograms cover all documents. The fit alone uses a bounded sample: at most MOST_POSITIVE trusted positives and
MOST_UNLABELLED unlabelled documents, those with the smallest hashes of their ids. Rows that are held out
(crc32 of the id modulo 4 is 2) take no part in learning. Labels, language, source and id are never inputs.

Defined cases: a null text is the empty text, whose features are zero and which gets a score like any other; several labels
of a document count as 1 if one of them is; without trusted positives every score is 0.5; repeated rows give a row
each; columns besides id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import Block, blocks, repeated_windows
from .common import whole_text, written

MOST_POSITIVE, MOST_UNLABELLED = 5_000, 10_000
THRESHOLD = 0.7
HIDDEN, STEPS, RATE, DECAY, FIRST_DECAY = 16, 600, 0.02, 1e-4, 1e-2
BINS = 400

_BYTES = np.arange(256)
_IS = {
    "upper": (_BYTES >= 65) & (_BYTES <= 90),
    "lower": (_BYTES >= 97) & (_BYTES <= 122),
    "digit": (_BYTES >= 48) & (_BYTES <= 57),
    "mark": np.isin(_BYTES, [ord(c) for c in "!?"]),
    "stop": np.isin(_BYTES, [ord(c) for c in ".,;:"]),
    "sign": np.isin(_BYTES, [ord(c) for c in "#*$%&|<>@^~=+_\\/{}[]()\"'`-"]),
    "wide": _BYTES >= 128,
    "feed": _BYTES == 10,
}
FEATURES = (*_IS, "words", "word_length", "distinct", "repeated", "top_word")


def features(b: Block) -> np.ndarray:
    """One row of features for each text of a block."""
    size = np.maximum(np.diff(b.offs), 1).astype(float)
    n = np.diff(b.word_offs).astype(float)
    some = np.maximum(n, 1)
    cols = [b.per_row(mask[b.data]) / size for mask in _IS.values()]
    h = b.word_hashes()
    row = np.repeat(np.arange(b.n), np.diff(b.word_offs))
    order = np.lexsort((h, row))
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    distinct = np.bincount(row[order], weights=new, minlength=b.n)
    at = np.flatnonzero(new)
    top = np.zeros(b.n)
    if len(at):
        np.maximum.at(top, row[order][at], np.diff(np.concatenate((at, [len(h)]))))
    repeated = b.per_row(repeated_windows(h, b.word_offs, 4), b.word_offs)
    cols += [np.log1p(n), b.per_row(b.is_word) / some, distinct / some * (n > 0), repeated / some, top / some]
    return np.stack(cols, axis=1)


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [features(b) for _, _, b in blocks(batch.column(1))]
        x = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))
        offs = pa.array(np.arange(len(x) + 1) * len(FEATURES), type=pa.int32())
        yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(offs, pa.array(x.ravel()))], names=["id", "x"])


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, x: the features of every whole text."""
    d = docs.select(F.col(id_col).alias("id"), whole_text(docs, text_col).alias("t"))
    return d.mapInArrow(_feature_batches, f"id {docs.schema[id_col].dataType.simpleString()}, x array<double>")


def is_held_out(c: Column) -> Column:
    return F.coalesce(F.crc32(c.cast("string")) % 4 == 2, F.lit(False))


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self.scaled(x) @ self.w1 + self.b1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.hidden(x) @ self.w2 + self.b2, -30, 30)))


def _fit(net: Network, positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, steps: int = STEPS, decay: float = DECAY) -> Network:
    """Adam on the non-negative risk; without a prior, on the logistic risk of positives against unlabelled."""
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    xp, xu = net.scaled(positive), net.scaled(unlabelled)
    for t in range(1, steps + 1):
        hp, hu = np.tanh(xp @ params[0] + params[1]), np.tanh(xu @ params[0] + params[1])
        sp, su = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3][0], -30, 30))) for h in (hp, hu))
        if prior is None:
            gp, gu = (sp - 1) / len(sp), su / len(su)
        else:
            # Sigmoid loss of output z for class +: 1 - s(z); for class -: s(z). Both have the slope s(1 - s).
            dp, du = sp * (1 - sp) / len(sp), su * (1 - su) / len(su)
            negative = su.mean() - prior * sp.mean()
            if negative >= 0:
                gp, gu = -2 * prior * dp, du
            else:  # the negative part has been fitted below zero: step back from it
                gp, gu = prior * dp, -du
        grads = [np.zeros_like(p) for p in params]
        for x, h, g in ((xp, hp, gp), (xu, hu, gu)):
            back = (g[:, None] * params[2]) * (1 - h * h)
            grads[0] += x.T @ back
            grads[1] += back.sum(axis=0)
            grads[2] += h.T @ g
            grads[3] += g.sum()
        for i, g in enumerate(grads):
            g = g + decay * params[i]
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            params[i] = params[i] - RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Network(net.mean, net.scale, params[0], params[1], params[2], float(params[3][0]))


def _score_batches(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    net: Network | None = shared.value
    for b in batches:
        x = b.column(b.num_columns - 1)
        flat = x.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
        s = net.score(flat) if net is not None else np.full(b.num_rows, 0.5)
        yield pa.record_batch([*b.columns[:-1], pa.array(s)], names=[*b.schema.names[:-1], "score"])


def _scored(t: DataFrame, net: Network | None, keep: list[str]) -> DataFrame:
    shared = t.sparkSession.sparkContext.broadcast(net)
    schema = ", ".join(f"`{c}` {t.schema[c].dataType.simpleString()}" for c in keep) + ", score double"
    return t.select(*keep, "x").mapInArrow(lambda it: _score_batches(it, shared), schema)


def best_bin_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The smallest upper bound of the share of positives among the unlabelled, over scores from the top down.

    Both are histograms of a score. Bins with few positives are noisy, so each ratio carries a
    deviation of its counts.
    """
    p, u = np.cumsum(positive[::-1]).astype(float), np.cumsum(unlabelled[::-1]).astype(float)
    if not p[-1] or not u[-1]:
        return 0.5
    ok = p > 0
    qp, qu = p[ok] / p[-1], u[ok] / u[-1]
    slack = np.sqrt(np.log(40) / (2 * p[-1])) + np.sqrt(np.log(40) / (2 * u[-1]))
    ratio = (qu + slack) / qp
    best = int(np.argmin(ratio))
    return float(np.clip(qu[best] / qp[best], 0.01, 0.99))


#: Shares of all hashes by which a sample is drawn.
SHARES = 1 << 30


def learn(table: DataFrame, trusted: DataFrame) -> tuple[Network | None, float]:
    """(network, class prior). table: id, x of all documents; trusted: ids of the trusted positives."""
    t = table.filter(~is_held_out(F.col("id"))).join(trusted.select(F.col("id").alias("_p")).distinct(), F.col("id") == F.col("_p"), "left")
    t = t.select("id", "x", F.col("_p").isNotNull().alias("positive"))
    moments = t.agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.get("x", F.lit(i))).alias(f"m{i}") for i in range(len(FEATURES))], *[F.stddev_pop(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(len(FEATURES))]).first()
    if not moments.n:
        return None, 0.5
    mean = np.array([moments[f"m{i}"] for i in range(len(FEATURES))])
    scale = np.maximum([moments[f"s{i}"] for i in range(len(FEATURES))], 1e-3)

    def sample(positive: bool, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Features, and which of the rows belong to the half that the first classifier learns from."""
        rows = t.filter(F.col("positive") == positive)
        n = rows.count()
        # A threshold on the id's hash first, so that no partition hands on more than its share of the sample.
        some = min(SHARES, math.ceil(SHARES * (2 * most + 100) / max(n, 1)))
        rows = rows.filter(F.pmod(F.xxhash64("id"), F.lit(SHARES)) < some).orderBy(F.pmod(F.xxhash64("id"), F.lit(SHARES)), F.xxhash64("id"), "id").limit(most).select("x", half.alias("half")).collect()
        return np.array([r.x for r in rows]).reshape(-1, len(FEATURES)), np.array([r.half for r in rows], dtype=bool)

    half = F.coalesce(F.pmod(F.xxhash64(F.lit("half"), "id"), F.lit(2)) == 0, F.lit(True))

    (p, half_p), (u, half_u) = sample(True, MOST_POSITIVE), sample(False, MOST_UNLABELLED)
    if not len(p) or not len(u):
        return None, 0.5
    rng = np.random.default_rng(6)
    new = lambda: Network(mean, scale, rng.normal(0, len(FEATURES) ** -0.5, (len(FEATURES), HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
    first = _fit(new(), p[half_p], u[half_u], None, STEPS // 4, FIRST_DECAY)
    bins = _scored(t.filter(~half), first, ["positive"]).groupBy("positive", F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()
    hist = np.zeros((2, BINS))
    for r in bins:
        hist[int(r.positive), r.bin] += r.n
    prior = best_bin_prior(hist[1], hist[0])
    return _fit(new(), p, u, prior), prior


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """id, held_out, score, predicted for every document."""
    table = written(feature_table(docs, id_col, text_col), "quality-features")
    trusted = labels.filter((F.col(label_col) == 1) & ~is_held_out(F.col(id_col))).select(F.col(id_col).alias("id"))
    net, _ = learn(table, trusted)
    s = _scored(table, net, ["id"])
    return s.select(F.col("id").alias(id_col), is_held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
