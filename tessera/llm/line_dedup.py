"""Line dedup by winnowing over line hashes.

Every line with a word has a 128-bit hash. A window is the shortest run of lines from a line on that has at least ``guarantee``
words; of each window the line with the smallest hash is selected (the last one of equals). A run of whole lines with
``guarantee`` words or more holds a window, so wherever it is repeated the same of its lines are selected: the guarantee of
winnowing, counted in words.

Positions that share a fingerprint are joined to the first of them, by (id, line). A match is extended both ways: a line
beside a selected one is repeated if the whole run from the selected line up to it is found earlier. A run is told by a
hash of its lines' hashes and reaches as far as one window; the next selected line takes over there, so a repeated run is
followed to both its ends however long it is, and each line's run meets whichever earlier document has that run, not only
the first one that has the selected line. Every later run goes; the first occurrence of a line content always stays,
because a line only goes for an equal line that is earlier.

No texts are shuffled to find the runs, hashes are. Positions are joined to first positions only, so a line that a third of all
documents hold gives as many rows as it has positions. The keys of over a thousandth of all rows are at most a thousand,
so their first positions are broadcast; the others are joined by key.

Defined cases: a null text is the empty text, which has one line without words; a text without line feed is one line; the
order of documents is that of the id, a null id first (it never loses lines), then of the text's hash; rows that are equal in id
and text are one document; rows that share only the id are documents of their own; texts of fewer than ``guarantee`` words have no
fingerprint and lose lines only beside none, so they stay; very long texts cost memory in proportion to their length;
columns besides the id and the text are kept by ``dedup_lines``, whatever their names; an empty table gives an empty
result. Lines are split at \\n alone, and a line's other white space counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import text_arrays
from .common import whole_text, written

#: Words of a window. Every line of so many words is a window, and so selected, by itself.
GUARANTEE = 5
#: A key that has over 1 / HEAVY of all rows is heavy: there are at most HEAVY of them.
HEAVY = 1000
#: Rows of fingerprints that a task hands on together.
ROWS = 1 << 13

_hash = xxhash.xxh3_128_digest


def selected(hashes: list[bytes], words: list[int], guarantee: int) -> list[int]:
    """The lines that some window selects, in order."""
    out: list[int] = []
    end, inside = 0, 0
    for i in range(len(hashes)):
        while end < len(hashes) and inside < guarantee:
            inside += words[end]
            end += 1
        if inside < guarantee:
            break
        if not (out and out[-1] >= i and all(hashes[k] > hashes[out[-1]] for k in range(out[-1] + 1, end))):
            out.append(min(range(i, end), key=lambda k: (hashes[k], -k)))
        inside -= words[i]
    return out


def runs(hashes: list[bytes], words: list[int], guarantee: int) -> Iterator[tuple[int, bytes]]:
    """(line, key): each selected line under its own key, and lines beside it under that of the run between."""
    for f in selected(hashes, words, guarantee):
        yield f, _hash(b"=" + hashes[f])
        for way, step in ((b">", 1), (b"<", -1)):
            key, between, k = way + hashes[f], 0, f + step
            while 0 <= k < len(hashes) and between < guarantee:
                key = way + _hash(key + hashes[k])
                if words[k] < guarantee:  # others are windows, and so selected, by themselves
                    yield k, _hash(key)
                between += words[k]
                k += step


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], guarantee: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sums, places, keys = [], [], [], []

        def out(batch=batch, ids=ids, sums=sums, places=places, keys=keys) -> pa.RecordBatch:
            b = pa.record_batch([batch.column(0).take(pa.array(ids, type=pa.int64())), pa.array(sums, type=pa.int64()), pa.array(places, type=pa.int32()), pa.array(keys, type=pa.binary())], names=["id", "sum", "pos", "key"])
            for x in (ids, sums, places, keys):
                x.clear()
            return b

        data, offs = text_arrays(batch.column(1))
        for i, (lo, hi) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
            raw = data[lo:hi].tobytes()
            own = xxhash.xxh64_intdigest(raw, 42)
            own -= (own >> 63) << 64
            lines = [(k, x, n) for k, x in enumerate(raw.split(b"\n")) if (n := len(x.split()))]
            for k, key in runs([_hash(x) for _, x, _ in lines], [n for _, _, n in lines], guarantee):
                ids.append(i)
                sums.append(own)
                places.append(lines[k][0])
                keys.append(key)
            if len(ids) > ROWS:
                yield out()
        yield out()


def fingerprints(docs: DataFrame, id_col: str, text_col: str, guarantee: int = GUARANTEE) -> DataFrame:
    """id, sum (XXH64 of the text), pos, key: the selected lines and the lines that runs tie to them."""
    d = docs.select(docs[id_col].alias("id"), whole_text(docs, text_col).alias("t"))
    return d.mapInArrow(lambda it: _fingerprint_batches(it, guarantee), f"id {docs.schema[id_col].dataType.simpleString()}, sum bigint, pos int, key binary")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", guarantee: int = GUARANTEE) -> DataFrame:
    """id, sum, pos, first: the lines of later repeated runs with the place (id, sum, pos) of the first such run's line."""
    fp = written(fingerprints(docs, id_col, text_col, guarantee), "line-fingerprints")
    at = F.struct("id", "sum", "pos")
    first = written(fp.groupBy("key").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "line-firsts")
    heavy = first.filter(F.col("n") * HEAVY > F.lit(fp.count()))
    light = first.join(heavy, "key", "left_anti")
    joined = fp.join(F.broadcast(heavy), "key").unionByName(fp.join(F.broadcast(heavy.select("key")), "key", "left_anti").join(light, "key"))
    return joined.filter(~at.eqNullSafe(F.col("first"))).select("id", "sum", "pos", "first")


def _stripped_batches(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, n_lines, n_removed = [], [], []
        for t, gone in zip(b.column(text_at), b.column("gone")):
            text, gone = t.as_py() or "", set(gone.as_py() or ())
            lines = text.split("\n") if gone else []
            texts.append("\n".join([x for k, x in enumerate(lines) if k not in gone]) if gone else text)
            n_lines.append(text.count("\n") + 1)
            n_removed.append(len(gone))
        cols = [b.column(c) for c in b.schema.names[:-1]]
        cols[text_at] = pa.array(texts, type=pa.string())
        yield pa.record_batch([*cols, pa.array(n_lines, type=pa.int64()), pa.array(n_removed, type=pa.int64())], names=[*b.schema.names[:-1], "lines", "removed"])


def stripped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", guarantee: int = GUARANTEE) -> tuple[DataFrame, list[str]]:
    """The documents without later repeated runs, with ``lines`` and ``removed``; their own columns have the names that come with it."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    sums = F.xxhash64(whole_text(docs, text_col)).alias("sum")
    gone = repeated_lines(docs, id_col, text_col, guarantee).groupBy("id", "sum").agg(F.collect_set("pos").alias("gone"))
    plain = docs.select(*[docs[c].alias(n) for c, n in zip(docs.columns, names)], sums)
    own = names[docs.columns.index(id_col)]
    d = plain.join(gone, (plain[own] == gone["id"]) & (plain["sum"] == gone["sum"]), "left").select(*names, "gone")
    fields = [T.StructField(n, f.dataType) for n, f in zip(names, docs.schema.fields)]
    schema = T.StructType([*fields, T.StructField("lines", T.LongType()), T.StructField("removed", T.LongType())])
    text_at = docs.columns.index(text_col)
    return d.mapInArrow(lambda it: _stripped_batches(it, text_at), schema), names


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", guarantee: int = GUARANTEE) -> DataFrame:
    """The documents without later repeated runs, in the columns they had."""
    out, names = stripped(docs, id_col, text_col, guarantee)
    return out.select(*[out[n].alias(c) for n, c in zip(names, docs.columns)])


def line_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, md5 of the text that stays."""
    out, names = stripped(docs.select("doc_id", "text"))
    return out.select(out[names[0]].alias("doc_id"), out["lines"].alias("n_lines"), out["removed"].alias("n_removed"), F.md5(names[1]).alias("kept_md5"))
