"""Benchmark decontamination by q-gram lemma filtering.

Benchmark texts are cut into overlapping pieces. A piece of m characters occurs in a document
with k edits or fewer only if the two share at least m - q + 1 - k*q q-grams, all in diagonals
(document position minus piece position) that span k or fewer. So shared q-grams are
counted in diagonal bands of width 2*BAND that overlap by half, bands that reach the bound are
retained, and each is verified by banded alignment: the edit distance of the whole piece to the best
part of the region.

Characters are UTF-8 bytes after A-Z became small and each white character became a space; a character
beyond ASCII so counts two to four. Documents are never cut: every text is read whole. The benchmark
meets the documents in blocks of BLOCK_CHARS bytes at most, one pass over the documents for each
block: that bounds what is broadcast, and no pair of a document and a piece is made unless they share q-grams.

Defined cases: a null or empty text, and one shorter than a q-gram, matches nothing; benchmark items that
are null or shorter than MIN_CHARS match nothing; a repeated item or document gives its own rows; of equally
good places the first one is reported; columns besides id and text are ignored; an empty documents or
benchmark table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import blocks
from .common import whole_text

Q = 8
PIECE, STRIDE = 80, 40
EDITS = 0.08
MIN_CHARS = 40
#: Half a band: more than the edits of any piece.
BAND = 8
BLOCK_CHARS = 1 << 20
#: Bands before the first byte, and bits of a band's number: texts of up to 2 GB.
SHIFT, BAND_BITS = 64, 29

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32


def fold(text: bytes) -> np.ndarray:
    return _FOLD[np.frombuffer(text, dtype=np.uint8)]


def qgrams(data: np.ndarray) -> np.ndarray:
    """The q-gram at each byte, as the 64 bits of its eight bytes."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.empty(n, dtype=np.uint64)
    for r in range(min(Q, n)):
        m = (len(data) - r) // Q
        out[r::Q] = np.frombuffer(data[r : r + m * Q].tobytes(), dtype="<u8")
    return out


def _slot(g: np.ndarray) -> np.ndarray:
    return ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)


class Pieces:
    """The pieces of a block of benchmark items, and where each of their q-grams is."""

    def __init__(self, items: list[tuple[object, str]]):
        self.numbers = not any(isinstance(i, str) for i, _ in items)
        self.item, self.at, self.text = [], [], []
        for item, text in items:
            t = fold((text or "").encode())
            if len(t) < MIN_CHARS:
                continue
            last = max(0, len(t) - PIECE)
            for at in [*range(0, last, STRIDE), last]:
                self.item.append(item)
                self.at.append(at)
                self.text.append(t[at : at + PIECE])
        self.length = np.array([len(t) for t in self.text], dtype=np.int64)
        self.edits = np.floor(self.length * EDITS).astype(np.int64)
        self.bound = np.maximum(1, self.length - Q + 1 - self.edits * Q)
        grams = [qgrams(t) for t in self.text]
        g = np.concatenate(grams) if grams else np.zeros(0, dtype=np.uint64)
        piece = np.repeat(np.arange(len(grams)), [len(x) for x in grams])
        pos = np.concatenate([np.arange(len(x)) for x in grams]) if grams else np.zeros(0, dtype=np.int64)
        order = np.argsort(g, kind="stable")
        self.piece, self.pos = piece[order], pos[order]
        self.gram, self.first = np.unique(g[order], return_index=True)
        self.count = np.diff(np.concatenate((self.first, [len(g)])))

    def may_hold(self) -> np.ndarray:
        """For each slot whether a q-gram falls on it."""
        out = np.zeros(1 << 22, dtype=bool)
        out[_slot(self.gram)] = True
        return out


def band_candidates(grams: np.ndarray, at: np.ndarray, row: np.ndarray, p: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, piece, band) whose shared q-grams reach the bound. ``at``: position in the row of each q-gram."""
    found = np.minimum(np.searchsorted(p.gram, grams), len(p.gram) - 1)
    hit = p.gram[found] == grams
    found, at, row = found[hit], at[hit], row[hit]
    n = p.count[found]
    which = np.repeat(np.arange(len(found)), n)
    entry = np.repeat(p.first[found] - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(len(which))
    piece = p.piece[entry]
    band = (at[which] - p.pos[entry]) // BAND + SHIFT
    # Each hit counts in the two bands that cover its diagonal.
    key = (row[which] * len(p.text) + piece) << BAND_BITS | band
    keys, counts = np.unique(np.concatenate((key, key - 1)), return_counts=True)
    piece = (keys >> BAND_BITS) % len(p.text)
    good = counts >= p.bound[piece]
    return (keys[good] >> BAND_BITS) // len(p.text), piece[good], (keys[good] & ((1 << BAND_BITS) - 1)) - SHIFT


def align(pieces: np.ndarray, regions: np.ndarray, sizes: np.ndarray, low: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edits, start, end) of the best part of each region for its whole piece, many at a time.

    Row i has a piece, a region of sizes[i] bytes (padded) and the diagonals low[i] .. low[i] + width - 1;
    cells outside the band or the region count as infinite. The pieces of a call have one length.
    Of equally good ends the first is taken.
    """
    n, far = len(pieces), 1 << 20
    d = low[:, None] + np.arange(width)[None, :]
    sizes = sizes[:, None]
    cost = np.where((d >= 0) & (d <= sizes), 0, far)
    start = d.copy()
    steps = np.arange(width)[None, :]
    rows = np.arange(n)[:, None]
    inf = np.full((n, 1), far)
    for i in range(1, pieces.shape[1] + 1):
        j = d + i  # end positions in the region of this row's cells
        ok = (j >= 0) & (j <= sizes)
        same = regions[rows, np.clip(j - 1, 0, regions.shape[1] - 1)] == pieces[:, i - 1 : i]
        sub = np.where((j >= 1) & ok, cost + ~same, far)
        up = np.concatenate((cost[:, 1:], inf), axis=1) + 1  # the piece's character has no partner
        take_up = up < sub
        best = np.where(ok, np.where(take_up, up, sub), far)
        s = np.where(take_up, np.concatenate((start[:, 1:], start[:, :1]), axis=1), start)
        # Characters of the region without a partner: a running minimum along the row.
        run = best - steps
        least = np.minimum.accumulate(run, axis=1)
        src = np.maximum.accumulate(np.where(run == least, steps, 0), axis=1)
        cost, start = np.where(ok, least + steps, far), s[rows, src]
    end = np.argmin(cost, axis=1)
    at = (np.arange(n), end)
    return cost[at], start[at], end + low + pieces.shape[1]


def _verified(cands: list[tuple[int, int, int, np.ndarray, int]], p: Pieces) -> dict[tuple[int, int], tuple[int, int, int, int]]:
    """(row, piece) -> (edits, start, end, length) of candidates (row, piece, diagonal of the band's start, cut of the text, where it begins)."""
    best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    by_length: dict[int, list] = {}
    for c in cands:
        by_length.setdefault(len(p.text[c[1]]), []).append(c)
    for m, own in by_length.items():
        edits = int(m * EDITS)
        width, size = 2 * BAND + 2 * edits, 2 * BAND + 2 * edits + m
        for lo in range(0, len(own), 512):
            part = own[lo : lo + 512]
            regions = np.zeros((len(part), size), dtype=np.uint8)
            begin = np.array([max(0, c[2] - edits) for c in part])
            sizes = np.zeros(len(part), dtype=np.int64)
            for i, (c, at) in enumerate(zip(part, begin.tolist())):
                r = c[3][at - c[4] : c[2] + 2 * BAND + edits + m - c[4]][:size]
                sizes[i] = len(r)
                regions[i, : len(r)] = r
            low = np.array([c[2] - edits for c in part]) - begin
            cost, start, end = align(np.stack([p.text[c[1]] for c in part]), regions, sizes, low, width)
            for c, at, e, s, t in zip(part, begin.tolist(), cost.tolist(), start.tolist(), end.tolist()):
                if e <= edits:
                    new = (e, at + s, at + t, m)
                    best[c[0], c[1]] = min(best.get((c[0], c[1]), new), new)
    return best


def _scan_batches(batches: Iterator[pa.RecordBatch], shared, names: list[str]) -> Iterator[pa.RecordBatch]:
    p: Pieces = shared.value
    may = p.may_hold()
    for batch in batches:
        cands: list[tuple[int, int, int, np.ndarray, int]] = []
        best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        for lo, _, b in blocks(batch.column(1)):
            data = _FOLD[b.data]
            g = qgrams(data)
            at = np.flatnonzero(may[_slot(g)])
            row = np.searchsorted(b.offs, at, side="right") - 1
            inside = at + Q <= b.offs[row + 1]
            at, row = at[inside], row[inside]
            if not len(at):
                continue
            for r, k, band in zip(*(x.tolist() for x in band_candidates(g[at], at - b.offs[row], row, p))):
                first = b.offs[r] + max(0, band * BAND - 2 * BAND)
                text = data[first : min(b.offs[r + 1], b.offs[r] + (band + 6) * BAND + PIECE)]
                cands.append((lo + r, k, band * BAND, text.copy(), int(first - b.offs[r])))
            if len(cands) > 4096:
                best |= _verified(cands, p)
                cands = []
        best |= _verified(cands, p)
        if not best:
            continue
        keys = sorted(best)
        ids = batch.column(0).take(pa.array([r for r, _ in keys]))
        cols = [pa.array([p.item[k] for _, k in keys], type=pa.int64() if p.numbers else pa.string()), pa.array([p.at[k] for _, k in keys], type=pa.int64())]
        cols += [pa.array([best[x][i] for x in keys], type=pa.int64()) for i in (1, 2, 0, 3)]
        yield pa.record_batch([ids, *cols], names=names)


def _item_kind(benchmark: DataFrame, item_col: str) -> str:
    """Whole numbers stay numbers; any other id is a string."""
    return "bigint" if isinstance(benchmark.schema[item_col].dataType, T.IntegralType) else "string"


def _item_blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of bounded size; one block is on the driver at a time."""
    held, size = [], 0
    for r in benchmark.select(F.col(item_col).cast(_item_kind(benchmark, item_col)).alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        n = len((r.t or "").encode())
        if held and size + n > BLOCK_CHARS:
            yield held
            held, size = [], 0
        held.append((r.i, r.t))
        size += n
    if held:
        yield held


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """id, item, piece_start, start, end (bytes of the text), edits, piece_chars: each piece that a document holds."""
    spark = docs.sparkSession
    names = [id_col, item_col, "piece_start", "start", "end", "edits", "piece_chars"]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, `{item_col}` {_item_kind(benchmark, item_col)}, " + ", ".join(f"`{n}` bigint" for n in names[2:])
    d = docs.select(docs[id_col], whole_text(docs, text_col).alias("t"))
    parts = []
    for items in _item_blocks(benchmark, item_col, item_text):
        pieces = Pieces(items)
        if pieces.text:
            shared = spark.sparkContext.broadcast(pieces)
            parts.append(d.mapInArrow(lambda it, shared=shared: _scan_batches(it, shared, names), schema))
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """id, item, n_pieces, first_start, last_end, least_edits: one row for each document and item."""
    f = find_contamination(docs, benchmark, id_col, text_col, item_col)
    return f.groupBy(id_col, item_col).agg(
        F.count(F.lit(1)).alias("n_pieces"), F.min("start").alias("first_start"), F.max("end").alias("last_end"), F.min("edits").alias("least_edits")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The documents that hold no piece of the benchmark. A null id can't be told apart and stays."""
    bad = find_contamination(docs, benchmark, id_col, text_col, item_col).select(id_col).distinct()
    return docs.join(bad, id_col, "left_anti").select(docs.columns)

