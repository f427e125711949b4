"""SentencePiece encoding and decoding as a relational lattice.

An escaped text is cut wherever no piece holds the two characters beside the cut, so the best path of a text is that
of its words (what lies between cuts). Words repeat, so the lattice is built once for each distinct word of the
corpus: its substrings of up to the longest piece's length are exploded, equi-joined to the piece table (whose size the
vocabulary bounds), grouped by word as edges, and the best path is folded from them by Spark's higher-order
``aggregate``. Of equal scores at one end the earliest start wins. A character that no single-character piece
covers is an unknown and becomes byte pieces. A long word (unbroken text) is folded window by window: what one
window needs of the one before is its last ``longest`` nodes.

The documents then take the pieces of their words. The most frequent words (at most FREQUENT, each of at most
FREQUENT_PIECES pieces: that bounds the broadcast, and a histogram of counts finds the threshold) are looked up where the text
is read; up to ROWS neighbouring documents ask together for their others by their 64-bit hashes, which meet the table of words by a join, and fill the
gaps of the documents. So a word that a third of all rows hold never meets in one task, and texts never move.
Whether the pieces of a document decode to its whole text is checked for each document.

Defined cases: a null or empty text has no words and no pieces; a text of white space is a run of pieces; every row gives a
row, repeated ones too; a U+2581 of a text comes back as a space, so such a text does not round-trip; columns besides
the id and the text are ignored, whatever their names; a very long text costs memory in proportion to its length; an
empty table gives an empty result. Two of 10**10 different words share a 64-bit hash with a probability of nine in ten: such a
text would fail its round-trip check.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import _R, _R_INVERSE, mix, powers
from .common import whole_text, written
from .pieces import DEFAULT_MODEL, SPACE, Vocabulary, escape, vocabulary

#: Words that are broadcast, and pieces of such a word; a word counts n is in bin floor(BINS * log2(n)).
FREQUENT, FREQUENT_PIECES, BINS = 1 << 18, 40, 8
#: Words that a task holds, repeats between blocks of documents included, before it counts them together; if half of them are left, they are handed on.
HELD = 1 << 20
#: Characters of documents that are looked up together (or one document); documents that ask for words together, and their characters (or one document).
TOGETHER, ROWS, ROWS_CHARS = 1 << 22, 64, 1 << 18
#: Tasks that build lattices for each task that reads documents; characters of a window and
#: windows of a group.
TASKS, WINDOW, GROUP = 4, 64, 64


def piece_table(spark: SparkSession, v: Vocabulary) -> DataFrame:
    """piece, id, score."""
    return spark.createDataFrame(list(v.pieces), "piece string, id int, score int")


_SPACED = re.compile(f"{SPACE}+[^{SPACE}]*").findall


def stretches(text: str) -> list[str]:
    """An escaped text in stretches that each begin with a space sign, without that sign."""
    if not text or "  " in text or text[0] == " " or text[-1] == " ":
        return [x[1:] for x in _SPACED(escape(text))]
    return text.split(" ")


def blocks(texts: pa.Array, chars: int, rows: int | None = None) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of neighbouring texts with some ``chars`` characters (or one text) and at most ``rows`` rows."""
    ends, lo = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + chars)))
        hi = min(hi, lo + rows) if rows else hi
        yield lo, texts.slice(lo, hi - lo)
        lo = hi


def stretched(texts: pa.Array) -> pa.ListArray:
    """``stretches`` of each text."""
    odd = pc.or_(pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")), pc.or_(pc.match_substring(texts, "  "), pc.equal(pc.binary_length(texts), 0)))
    plain = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
    if len(plain) == len(texts):
        return plain
    other = pa.array([stretches(t) for t in texts.filter(odd).to_pylist()], type=plain.type)
    mask = odd.to_numpy(zero_copy_only=False)
    place = np.where(mask, len(plain) + np.cumsum(mask), np.cumsum(~mask)) - 1
    return pa.concat_arrays([plain, other]).take(pa.array(place))


class Cutter:
    """Cuts blocks of texts into words: between two characters that no piece holds side by side."""

    def __init__(self, v: Vocabulary):
        pairs = {(ord(a), ord(b)) for p, _, _ in v.pieces for a, b in zip(p, p[1:])}
        chars = sorted({c for pair in pairs for c in pair})
        self.number = np.zeros(0x110000, dtype=np.uint16)
        self.number[chars] = np.arange(1, len(chars) + 1)
        self.beside = np.zeros((len(chars) + 1, len(chars) + 1), dtype=bool)
        for a, b in pairs:
            self.beside[self.number[a], self.number[b]] = True

    def words(self, stretches: pa.Array) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """The escaped stretches in one, the starts of the words in it (and its length), their hashes, and the offsets of the stretches in the words."""
        one = pa.ListArray.from_arrays(pa.array([0, len(stretches)], type=pa.int32()), stretches)
        joined = (SPACE + pc.binary_join(one, SPACE)[0].as_py()).replace(" ", SPACE) if len(stretches) else ""
        at = np.concatenate(([0], np.cumsum(pc.utf8_length(stretches).to_numpy(zero_copy_only=False) + 1, dtype=np.int64)))
        text = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        number = self.number[text]
        cut = np.ones(len(text) + 1, dtype=bool)
        cut[1:-1] = ~self.beside[number[:-1], number[1:]] if len(text) else True
        cut[at] = True
        starts = np.flatnonzero(cut) if len(text) else np.zeros(1, dtype=np.int64)
        sums = np.zeros(len(text) + 1, dtype=np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * powers(_R, len(text) + 1)[: len(text)], out=sums[1:])
        h = (sums[starts[1:]] - sums[starts[:-1]]) * powers(_R_INVERSE, len(text) + 1)[starts[:-1]]
        return joined, starts, mix(h ^ np.diff(starts).astype(np.uint64)), np.searchsorted(starts, at)


_cutters: dict[int, Cutter] = {}


def _cutter(v: Vocabulary) -> Cutter:
    """A worker's cutter of its last vocabulary."""
    if hash(v) not in _cutters:
        _cutters.clear()
        _cutters[hash(v)] = Cutter(v)
    return _cutters[hash(v)]


def _counted(parts: list[tuple[np.ndarray, np.ndarray, pa.Array]]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(hashes, counts, words), each word once."""
    keys, first, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
    counts = np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)
    return keys, counts, pa.concat_arrays([p[2] for p in parts]).take(pa.array(first))


def _word_batches(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    cutter = _cutter(shared.value)
    none = (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), pa.array([], type=pa.string()))
    held = [none]

    def out() -> Iterator[pa.RecordBatch]:
        _, n, words = held[0]
        for lo in range(0, len(n), 1 << 14):
            yield pa.record_batch([words.slice(lo, 1 << 14), pa.array(n[lo : lo + (1 << 14)])], names=["seg", "n"])

    for batch in batches:
        for _, texts in blocks(batch.column(0), TOGETHER):
            found = stretched(texts).flatten().value_counts()
            times = found.field("counts").to_numpy(zero_copy_only=False)
            text, starts, h, offs = cutter.words(found.field("values"))
            keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            counts = np.bincount(inverse, np.repeat(times, np.diff(offs)), len(keys)).astype(np.int64)
            words = [text[x:y] for x, y in zip(starts[first].tolist(), starts[first + 1].tolist())]
            held.append((keys, counts, pa.array(words, type=pa.string())))
            if sum(len(n) for _, n, _ in held) > HELD:
                held[:] = [_counted(held)]
                if len(held[0][1]) > HELD // 2:
                    yield from out()
                    held[:] = [none]
    held[:] = [_counted(held)]
    yield from out()


def distinct_words(docs: DataFrame, v: Vocabulary, text_col: str = "text", parts: int | None = None) -> DataFrame:
    """h, seg, n: the distinct words of all texts with their hashes and counts, dealt out by hash."""
    shared = docs.sparkSession.sparkContext.broadcast(v)
    own = docs.select(whole_text(docs, text_col).alias("t")).mapInArrow(lambda it: _word_batches(it, shared), "seg string, n bigint")
    h = F.xxhash64("seg")
    if parts:
        own = own.repartition(parts, h)
    return own.groupBy(h.alias("h"), "seg").agg(F.sum("n").alias("n"))


#: An edge as one number, so that the edges of a window sort by end and then by start: end, LONGEST - length, cost and id.
#: An unknown character has the id _UNKNOWN + its code point.
_ID_BITS, _COST_BITS, _LENGTH_BITS = 22, 14, 6
_LONGEST, _UNKNOWN = (1 << _LENGTH_BITS) - 1, 1 << 21
_END_SHIFT = _ID_BITS + _COST_BITS + _LENGTH_BITS


def _end(x: Column) -> Column:
    return F.shiftright(x, _END_SHIFT).cast("int")


def _length(x: Column) -> Column:
    return _LONGEST - F.shiftright(x, _ID_BITS + _COST_BITS).bitwiseAND(F.lit(_LONGEST)).cast("int")


def _cost(x: Column) -> Column:
    return F.shiftright(x, _ID_BITS).bitwiseAND(F.lit((1 << _COST_BITS) - 1))


def _id(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << _ID_BITS) - 1)).cast("int")


def lattice(words: DataFrame, pieces: DataFrame, v: Vocabulary) -> DataFrame:
    """h, n, windows: the edges of each word as numbers, by windows of WINDOW ends; ends count from the window's start."""
    if v.longest > _LONGEST or -v.unknown >= 1 << _COST_BITS or max(i for _, i, _ in v.pieces) >= _UNKNOWN:
        raise ValueError("the vocabulary does not fit the edges' numbers")
    pad = v.longest - 1

    def sliced(df: DataFrame, chars: Column, size: int, number: Column, *keep: str) -> DataFrame:
        """Slices of ``size`` characters of s with up to ``pad`` characters in front, which ``back`` counts."""
        df = df.select("*", F.explode(F.sequence(F.lit(0), F.floor((chars - 1) / size).cast("int"))).alias("i"))
        start = F.col("back") + F.col("i") * size
        back = F.least(F.lit(pad), start)
        text = F.when((F.col("i") == 0) & (chars <= size), F.col("s")).otherwise(F.substring("s", start - back + 1, back + size))
        return df.select(*keep, number.alias("w"), back.alias("back"), text.alias("s"))

    rows = words.select("h", "n", F.length("seg").alias("chars"), F.lit(0).alias("w"), F.lit(0).alias("back"), F.col("seg").alias("s"))
    rows = sliced(rows, F.col("chars"), WINDOW * GROUP, F.col("i"), "h", "n", "chars")
    rows = sliced(rows, F.length("s") - F.col("back"), WINDOW, F.col("w") * GROUP + F.col("i"), "h", "n", "chars")
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.length("s") - F.col("back"))).alias("e"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(v.longest), F.col("e") + F.col("back")))).alias("len"))
    rows = rows.select("h", "n", "chars", "w", "e", "len", F.substring(F.col("s"), F.col("back") + F.col("e") - F.col("len") + 1, F.col("len")).alias("piece"))
    edges = rows.join(F.broadcast(pieces), "piece", "left").filter(F.col("id").isNotNull() | (F.col("len") == 1))
    edge = (
        F.shiftleft(F.col("e").cast("long"), _END_SHIFT)
        .bitwiseOR(F.shiftleft((_LONGEST - F.col("len")).cast("long"), _ID_BITS + _COST_BITS))
        .bitwiseOR(F.shiftleft((-F.coalesce("score", F.lit(v.unknown))).cast("long"), _ID_BITS))
        .bitwiseOR(F.coalesce("id", F.ascii("piece") + _UNKNOWN).cast("long"))
    )
    edges = edges.groupBy("h", "n", "chars", "w").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    return edges.groupBy("h", "n", "chars").agg(F.sort_array(F.collect_list(F.struct("w", "edges"))).alias("windows"))


_NODE = "struct<s:bigint,x:bigint>"
_LINES = "array<array<bigint>>"


def _let(x: Column, f) -> Column:
    """f of x, which is worked out once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _grouped(x: Column, size: int) -> Column:
    """An array in slices of ``size``."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(x) / size).cast("int"), F.lit(1)) - 1), lambda g: F.slice(x, g * size + 1, F.lit(size)))


def viterbi(windows: Column, longest: int) -> Column:
    """The edges of the best paths to each end, in lines of GROUP windows.

    A fold copies its state at every step. So edges are folded within a window, windows within a group, and groups within a
    word, each with a state of its own size only; what they hand on is their last ``longest`` nodes.
    """
    node = lambda s, x: F.struct(s.cast("bigint").alias("s"), x.cast("bigint").alias("x"))

    def state(nodes: Column, e: Column, now: Column, tail: Column) -> Column:
        """The nodes from the ``tail`` ones of the window before up to end e, whose node ``now`` may still improve."""
        return F.struct(nodes.alias("nodes"), e.alias("e"), now.alias("now"), tail.alias("tail"))

    def step(st: Column, x: Column) -> Column:
        moved, begin = _end(x) != st["e"], _end(x) - _length(x)
        total = F.when(moved & (begin == st["e"]), st["now"]["s"]).otherwise(F.get(st["nodes"], begin + st["tail"] - 1)["s"]) + _cost(x)
        onward = state(F.concat(st["nodes"], F.array(st["now"])), _end(x), node(total, x), st["tail"])
        return F.when(moved, onward).when(total < st["now"]["s"], state(st["nodes"], st["e"], node(total, x), st["tail"])).otherwise(st)

    def closed(st: Column) -> Column:
        every = F.concat(st["nodes"], F.array(st["now"]))
        own = F.transform(F.slice(every, st["tail"] + 1, F.size(every)), lambda a: a["x"])
        last = F.slice(every, F.greatest(F.size(every) - longest, F.lit(0)) + 1, F.lit(longest))
        return F.struct(last.alias("last"), own.alias("own"))

    def window(last: Column, w: Column) -> Column:
        n = F.size(last)
        return F.aggregate(w["edges"], state(F.slice(last, F.lit(1), n - 1), F.lit(0), F.element_at(last, -1), n), step, closed)

    def over(items: Column, last: Column, one, finish) -> Column:
        start = F.struct(last.alias("last"), F.array().cast(_LINES).alias("done"))
        joined = lambda st, x: _let(one(st["last"], x), lambda r: F.struct(r["last"].alias("last"), F.concat(st["done"], F.array(r["own"])).alias("done")))
        return F.aggregate(items, start, joined, finish)

    group = lambda last, ws: over(ws, last, window, lambda st: F.struct(st["last"].alias("last"), F.flatten(st["done"]).alias("own")))
    first = F.array(node(F.lit(0), F.lit(0))).cast(f"array<{_NODE}>")
    return over(_grouped(windows, GROUP), first, group, lambda st: st["done"])


def _path(lines: Column) -> Column:
    """Edges of the best path from the front."""

    def state(at: Column, out: Column) -> Column:
        """``at`` is 0 or how far the path goes beyond the front of what is behind."""
        return F.struct(at.alias("at"), out.alias("out"))

    def window(at: Column, xs: Column) -> Column:
        def back(b: Column, _: Column) -> Column:
            x = F.get(xs, b["at"] - 1)
            return F.when(b["at"] <= 0, b).otherwise(state(b["at"] - _length(x), F.concat(b["out"], F.array(x))))

        return F.aggregate(xs, state(F.size(xs) + at, F.array().cast("array<bigint>")), back)

    def over(items: Column, at: Column, one) -> Column:
        joined = lambda st, x: _let(one(st["at"], x), lambda r: state(r["at"], F.concat(st["out"], F.array(r["out"]))))
        return F.aggregate(F.reverse(items), state(at, F.array().cast(_LINES)), joined, lambda st: state(st["at"], F.flatten(st["out"])))

    return F.reverse(over(lines, F.lit(0), lambda at, line: over(_grouped(line, WINDOW), at, window))["out"])


def _utf8(code: Column) -> Column:
    """The bytes of a code point."""
    low = lambda shift: F.shiftright(code, shift).bitwiseAND(F.lit(63)) + 128
    two, three = F.array(F.shiftright(code, 6) + 192, low(0)), F.array(F.shiftright(code, 12) + 224, low(6), low(0))
    four = F.array(F.shiftright(code, 18) + 240, low(12), low(6), low(0))
    return F.when(code < 0x80, F.array(code)).when(code < 0x800, two).when(code < 0x10000, three).otherwise(four)


def encode_words(words: DataFrame, v: Vocabulary) -> DataFrame:
    """h, n, ids: the pieces of each distinct word."""
    best = lattice(words, piece_table(words.sparkSession, v), v)
    best = best.select("h", "n", viterbi(F.col("windows"), v.longest).alias("done")).select("h", "n", F.transform(_path(F.col("done")), _id).alias("path"))
    if v.first_byte is None:
        return best.select("h", "n", F.transform("path", lambda i: F.when(i >= _UNKNOWN, F.lit(v.unknown_id)).otherwise(i)).alias("ids"))
    ids_of = lambda i: F.when(i < _UNKNOWN, F.array(i)).otherwise(F.transform(_utf8(i - _UNKNOWN), lambda x: x + v.first_byte))
    plain = ~F.exists("path", lambda i: i >= _UNKNOWN)
    return best.select("h", "n", F.when(plain, F.col("path")).otherwise(F.flatten(F.transform("path", ids_of))).alias("ids"))


def encoded_words(docs: DataFrame, v: Vocabulary, text_col: str = "text") -> DataFrame:
    """``encode_words`` of all distinct words, as a written table. The number of its tasks follows the input."""
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), TASKS * docs.rdd.getNumPartitions())
    # Two bytes a piece where ids allow it: they are dealt out twice.
    kind = "smallint" if max(len(piece_bytes(v)) - 1, v.unknown_id) < 1 << 15 else "int"
    words = encode_words(distinct_words(docs, v, text_col, parts), v)
    return written(words.withColumn("ids", F.col("ids").cast(f"array<{kind}>")), "word-pieces")


class Frequent:
    """The frequent words, numbered from 1 by falling counts, with their pieces."""

    def __init__(self, rows: pa.Table):
        h = rows.column("h").to_numpy().astype(np.int64)
        order = np.lexsort((h, -rows.column("n").to_numpy().astype(np.int64)))
        place = np.argsort(h[order])
        self.h, self.number = h[order][place], place + 1
        ids = rows.column("ids").combine_chunks().take(pa.array(order))
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        self.flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
        #: By number; 0 is a word that is not among them.
        self.lens = np.concatenate(([0], ids.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
        self.offs = np.cumsum(self.lens) - self.lens

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, or 0."""
        if not len(self.h):
            return np.zeros(len(h), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[at] == h, self.number[at], 0)


def _bin() -> Column:
    return F.floor(F.log2("n") * BINS)


def frequent_bin(table: DataFrame, most: int) -> int:
    """The least bin of counts from which on at most ``most`` words are left, from a histogram of some hundred bins."""
    have, least = 0, 1 << 20
    for r in table.groupBy(_bin().alias("bin")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("bin")).collect():
        have += r.k
        if have > most:
            break
        least = r.bin
    return least


def _frequent(table: DataFrame, most: int) -> tuple[Column, Frequent]:
    """Which words are broadcast, and these words."""
    broad = (_bin() >= frequent_bin(table, most)) & (F.size("ids") <= FREQUENT_PIECES)
    return broad, Frequent(table.filter(broad).select("h", "n", "ids").toArrow())


def _digest(text: bytes) -> bytes:
    return xxhash.xxh3_128_digest(text)


def _found(cutter: Cutter, f: Frequent, new: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of the stretches' words, their hashes, offsets of the stretches in the words)."""
    text, starts, h, offs = cutter.words(new)
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    words = [text[x:y] for x, y in zip(starts[first].tolist(), starts[first + 1].tolist())]
    own = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 42) for w in words], dtype=np.uint64).view(np.int64)
    return f.find(own)[inverse], own[inverse], offs


def _ranges(starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges in a row, and each one's place in its range."""
    step = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
    return np.repeat(starts, lens) + step, step


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers of words, compressed byte by byte: the high bytes are mostly zero."""
    return pa.Codec("zstd", compression_level=1).compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), asbytes=True)


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    raw = pa.Codec("zstd").decompress(packed, 4 * n, asbytes=True) if n else b""
    return np.frombuffer(raw, dtype=np.uint8).reshape(4, n).T.copy().view("<u4").ravel().astype(np.int64)


def _gapped_batches(batches: Iterator[pa.RecordBatch], shared_v, shared_f) -> Iterator[pa.RecordBatch]:
    """A row for up to ROWS documents: key, their ids, digests and counts of words; the numbers of their words in one (compressed), and the hashes of the words without a number in order.

    The key tells the documents by their ids and texts. Those that share a key only share the words that both ask for.
    """
    cutter = _cutter(shared_v.value)
    for batch in batches:
        for lo, texts in blocks(batch.column(1), TOGETHER):
            lists = stretched(texts)
            coded = lists.flatten().dictionary_encode()
            at = coded.indices.to_numpy(zero_copy_only=False)
            number, h, offs = _found(cutter, shared_f.value, coded.dictionary)
            lens = np.diff(offs)[at]
            place = _ranges(offs[at], lens)[0]
            number, h = number[place], h[place]
            by_text = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)))
            words = np.concatenate(([0], np.cumsum(lens)))[by_text]
            gaps = np.concatenate(([0], np.cumsum(number == 0)))[words]
            ids, digests = batch.column(0).slice(lo, len(texts)), [_digest(t.encode("utf-8", "surrogatepass")) for t in texts.to_pylist()]
            rows = np.array([first for first, _ in blocks(texts, ROWS_CHARS, ROWS)] + [len(texts)], dtype=np.int32)
            spans = list(zip(rows.tolist(), rows[1:].tolist()))
            keys = [xxhash.xxh3_64_intdigest(repr(ids.slice(x, y - x).to_pylist()).encode("utf-8", "surrogatepass") + b"".join(digests[x:y])) for x, y in spans]
            by_row = lambda values, at: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values)
            cols = {
                "key": pa.array(np.array(keys, dtype=np.uint64).view(np.int64)),
                "id": by_row(ids, rows),
                "digest": by_row(pa.array(digests, type=pa.binary()), rows),
                "n_segments": by_row(pa.array(np.diff(words)), rows),
                "words": pa.array([_packed(number[words[x] : words[y]]) for x, y in spans], type=pa.binary()),
                "gaps": by_row(pa.array(h[number == 0]), gaps[rows]),
            }
            yield pa.record_batch(list(cols.values()), names=list(cols))


def _asked_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, h: the words without a number of the documents of a row."""
    for batch in batches:
        gaps = batch.column("gaps")
        lens = gaps.value_lengths().to_numpy(zero_copy_only=False)
        row, h = np.repeat(np.arange(len(lens)), lens), gaps.flatten().to_numpy(zero_copy_only=False)
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        first = np.ones(len(h), dtype=bool)
        first[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
        yield pa.record_batch([batch.column("key").take(pa.array(row[first])), pa.array(h[first])], names=["key", "h"])


def _filled(number: np.ndarray, f: Frequent, gaps: np.ndarray, h: np.ndarray, lens: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of words in one and the words' offsets in them; those without a number have the hashes ``gaps``, and words of the hashes ``h`` have ``lens`` pieces each of ``flat``."""
    open_ = number == 0
    starts = np.cumsum(lens) - lens
    order = np.argsort(h, kind="stable")
    at = order[np.minimum(np.searchsorted(h, gaps, sorter=order), len(h) - 1)] if len(h) else np.zeros(0, dtype=np.int64)
    if len(at) != len(gaps) or len(gaps) != np.count_nonzero(open_) or (h[at] != gaps).any():
        raise ValueError("a word of a document is not among the encoded words")
    size = f.lens[number]
    size[open_] = lens[at]
    place = np.concatenate(([0], np.cumsum(size)))
    out = np.empty(int(place[-1]), dtype=np.int32)
    for where, pieces, first in ((~open_, f.flat, f.offs[number[~open_]]), (open_, flat, starts[at])):
        source, step = _ranges(first, size[where])
        out[np.repeat(place[:-1][where], size[where]) + step] = pieces[source]
    return out, place


def _decoded(ids: np.ndarray, offs: np.ndarray, names: pa.Array) -> list[str]:
    """The texts of documents whose pieces are ``ids`` between ``offs``."""
    found = names.take(pa.array(ids))
    ends = np.concatenate(([0], np.cumsum(pc.binary_length(found).to_numpy(zero_copy_only=False), dtype=np.int64)))[offs].tolist()
    data = memoryview(found.buffers()[2] or b"")
    return [_text(bytes(data[x:y])) for x, y in zip(ends, ends[1:])]


def _filled_batches(batches: Iterator[pa.RecordBatch], shared_f, names=None) -> Iterator[pa.RecordBatch]:
    """Documents with the pieces of all their words; with ``names`` (what the pieces stand for) also whether they decode to the whole text."""
    stand_for = pa.array(names.value, type=pa.large_binary()) if names is not None else None
    for batch in batches:
        for i in range(batch.num_rows):
            id_, digest, words, gaps = (batch.column(c)[i].values for c in ("id", "digest", "n_segments", "gaps"))
            found = batch.column("rare").slice(i, 1).flatten()
            h, rare = found.field("h").to_numpy(zero_copy_only=False), found.field("ids")
            ends = np.concatenate(([0], np.cumsum(words.to_numpy(zero_copy_only=False))))
            number = _unpacked(batch.column("words")[i].as_py(), int(ends[-1]))
            lens = rare.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            out, place = _filled(number, shared_f.value, gaps.to_numpy(zero_copy_only=False), h, lens, rare.flatten().to_numpy(zero_copy_only=False))
            offs = place[ends]
            cols = {"id": id_, "n_segments": words, "digest": digest, "ids": pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(out))}
            if names is not None:
                good = [_digest(t.encode()) == d for t, d in zip(_decoded(out, offs, stand_for), digest.to_pylist())]
                cols |= {"n_pieces": pa.array(np.diff(offs)), "round_trip": pa.array(good, type=pa.bool_())}
                del cols["digest"]
            yield pa.record_batch(list(cols.values()), names=list(cols))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_file: str = DEFAULT_MODEL, most: int = FREQUENT, check: bool = False) -> DataFrame:
    """id, n_segments, digest (of the text, 128 bits), ids: the pieces of every document in order, a row for each row.

    With ``check``, each document is decoded as well: n_pieces and round_trip (the decoded text is the whole text) stand for the digest.
    """
    v = vocabulary(model_file)
    sc = docs.sparkSession.sparkContext
    table = encoded_words(docs, v, text_col)
    broad, f = _frequent(table, most)
    shared_v, shared_f = sc.broadcast(v), sc.broadcast(f)
    kind = docs.schema[id_col].dataType.simpleString()
    d = docs.select(docs[id_col].alias("id"), whole_text(docs, text_col).alias("t"))
    schema = f"key bigint, id array<{kind}>, digest array<binary>, n_segments array<bigint>, words binary, gaps array<bigint>"
    gapped = d.mapInArrow(lambda it: _gapped_batches(it, shared_v, shared_f), schema)
    # Texts are looked up once: dealt out by key, the documents of a row both ask for their other words and take them in.
    gapped = gapped.repartition("key")
    asked = gapped.mapInArrow(_asked_batches, "key bigint, h bigint").withColumnRenamed("key", "of")
    rare = asked.join(table.filter(~broad).select("h", "ids"), "h").groupBy("of").agg(F.collect_set(F.struct("h", "ids")).alias("rare"))
    every = gapped.join(rare, gapped["key"] == rare["of"], "left").select("id", "n_segments", "digest", "words", "gaps", "rare")
    if check:
        names = sc.broadcast(piece_bytes(v))
        out = every.mapInArrow(lambda it: _filled_batches(it, shared_f, names), f"id {kind}, n_segments bigint, ids array<int>, n_pieces bigint, round_trip boolean")
    else:
        out = every.mapInArrow(lambda it: _filled_batches(it, shared_f), f"id {kind}, n_segments bigint, digest binary, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def piece_bytes(v: Vocabulary) -> list[bytes]:
    """What each piece stands for, by id."""
    out = [b"\xef\xbf\xbd"] * (1 + max([*(i for _, i, _ in v.pieces), v.unknown_id, (v.first_byte or 0) + 255]))
    for p, i, _ in v.pieces:
        out[i] = p.encode()
    if v.first_byte is not None:
        for x in range(256):
            out[v.first_byte + x] = bytes([x])
    return out


def decode_ids(ids: list[int], names: list[bytes]) -> str:
    """The text of pieces; byte pieces in a row are read as UTF-8."""
    return _text(b"".join([names[i] for i in ids]))


def _text(joined: bytes) -> str:
    return joined.decode("utf-8", "replace").replace(SPACE, " ")[1:]


def decode(encoded: DataFrame, model_file: str = DEFAULT_MODEL, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """The rows with the decoded text in place of ``ids``."""
    names = encoded.sparkSession.sparkContext.broadcast(piece_bytes(vocabulary(model_file)))
    keep = [c for c in encoded.columns if c not in (ids_col, text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [decode_ids(x or [], names.value) for x in b.column(ids_col).to_pylist()]
            yield pa.record_batch([*[b.column(c) for c in keep], pa.array(texts, type=pa.string())], names=[*keep, text_col])

    schema = ", ".join([*[f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in keep], f"`{text_col}` string"])
    return encoded.select(*keep, ids_col).mapInArrow(run, schema)


def encode_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_file: str = DEFAULT_MODEL, most: int = FREQUENT) -> DataFrame:
    """id, n_segments, n_pieces, ids_sum (a hash of the pieces in their order), round_trip, a row for each row, all of ``encode``'s pieces of whole documents and their decoded text."""
    e = encode(docs, id_col, text_col, model_file, most, check=True)
    return e.select(id_col, "n_segments", "n_pieces", F.xxhash64("ids").alias("ids_sum"), "round_trip")
