"""SimHash near-duplicates by pivot distance tables.

A fingerprint has 64 bits: bit b is 1 if over half of the shingles' XXH64 (seed 42) have
it. Distances of each distinct fingerprint to reference fingerprints (pivots) are
computed once. Pivots come in groups that each cover one part of the bits (the pivots
of a part are its single bits beside zero, so the distances of a group tell its part
whole), and of random ones over all bits. Two fingerprints within r bits agree on all
distances of at least one of r + 1 groups; groups that are equal give the pairs, pairs
whose distances to some random pivot differ by over r are discarded, and the survivors
are verified by their bits. That is exact: no two fingerprints within r bits are lost.

Equal fingerprints are one node. Where many distinct fingerprints share a group (near
copies by the thousand), pairs would grow with the square of their number. Such
fingerprints meet at hubs instead: each gives itself and its one-bit neighbours
outside the shared part, and all that meet at a hub are linked to the smallest of them,
since whoever is one bit from the hub is within two bits of the other. This is exact too
(for r = 2 and r = 1), with rows that are linear in the fingerprints.

Components come from alternating large and small stars over written tables; neither
links nor fingerprints go to the driver.

Defined cases: a null text is the empty text; a text without words has fingerprint zero and
is linked like any other; a text with fewer words than a shingle has one shingle, its whole
sequence; repeated rows with one id count as one node; a null id is a node of its own that
counts as the smallest; columns besides the id and the text are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import blocks
from .common import whole_text, written

RADIUS = 2
SHINGLE = 3
#: Random pivots; a distance is one byte of the packed table row.
PIVOTS = 16
#: Fingerprints that share a group: up to so many are paired, more meet at hubs.
PAIRED = 32

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_HALVES = np.array([[(b >> i) & 1 for i in range(8)] for b in range(256)], dtype=np.uint8)


def shingle_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """XXH64 of the shingles of one text's words, which are lower-cased and joined by a space."""
    n = len(starts)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    lens = ends - starts
    out_at = np.concatenate(([0], np.cumsum(lens + 1)))[:-1]
    total = int(out_at[-1] + lens[-1])
    joined = np.full(total, 0x20, dtype=np.uint8)
    src = np.repeat(starts - out_at, lens) + (at := np.repeat(out_at - np.concatenate(([0], np.cumsum(lens)))[:-1], lens) + np.arange(int(lens.sum())))
    joined[at] = data[src]
    raw = joined.tobytes()
    k = min(size, n)
    lo, hi = out_at[: n - k + 1].tolist(), (out_at[k - 1 :] + lens[k - 1 :]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(raw[a:b], 42) for a, b in zip(lo, hi)), dtype=np.uint64, count=n - k + 1)


def fingerprint_of(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[lo : lo + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = np.zeros(batch.num_rows, dtype=np.uint64)
        for lo, hi, b in blocks(batch.column(1)):
            data = _LOWER[b.data]
            for i in range(hi - lo):
                w = slice(b.word_offs[i], b.word_offs[i + 1])
                out[lo + i] = fingerprint_of(shingle_hashes(data, b.starts[w], b.ends[w], size))
        yield pa.record_batch([batch.column(0), pa.array(out.view(np.int64))], names=["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id, fp (the 64 bits as a long)."""
    d = docs.select(F.col(id_col).alias("id"), whole_text(docs, text_col).alias("t"))
    return d.mapInArrow(lambda it: _fingerprint_batches(it, shingle), f"id {docs.schema[id_col].dataType.simpleString()}, fp bigint")


def part_masks(radius: int) -> list[int]:
    """radius + 1 parts that share out the 64 bits."""
    cut = [round(64 * i / (radius + 1)) for i in range(radius + 2)]
    return [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(cut, cut[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def random_pivots(n: int) -> list[int]:
    return [_signed(int(x)) for x in np.random.default_rng(64).integers(0, 2**64, n, dtype=np.uint64)]


def pivot_table(fps: DataFrame, pivots: int = PIVOTS) -> DataFrame:
    """fp and ``dist``: its distances to the random pivots."""
    return fps.withColumn("dist", F.array(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("byte") for p in random_pivots(pivots)]))


def max_difference(a: Column, b: Column, pivots: int = PIVOTS) -> Column:
    """The largest difference of two rows of distances: never over the distance of the two."""
    return F.greatest(*[F.abs(F.get(a, F.lit(i)).cast("int") - F.get(b, F.lit(i)).cast("int")) for i in range(pivots)])


def links(fps: DataFrame, radius: int = RADIUS, paired: int = PAIRED) -> DataFrame:
    """a, b (a < b): links between distinct fingerprints that connect all within ``radius`` bits (1 or 2).

    Up to ``paired`` fingerprints in a group give every link; more give the links to a hub's smallest.
    """
    if radius not in (1, 2):
        raise ValueError("hubs tell distances of one and two bits")
    masks = part_masks(radius)
    # The distances to zero and to the single bits of a part say which of its bits are set: the part itself is their short form.
    groups = F.explode(F.array(*[F.struct(F.lit(i).alias("g"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)]))
    keyed = pivot_table(fps).select("fp", "dist", groups.alias("x")).select("fp", "dist", "x.g", "x.key")
    sizes = keyed.groupBy("g", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    keyed = written(keyed.join(sizes, ["g", "key"]), "simhash-groups")
    few = keyed.filter(F.col("n") <= paired)
    a, b = few.select("g", "key", F.col("fp").alias("a"), F.col("dist").alias("da")), few.select("g", "key", F.col("fp").alias("b"), F.col("dist").alias("db"))
    pairs = a.join(b, ["g", "key"]).filter((F.col("a") < F.col("b")) & (max_difference(F.col("da"), F.col("db")) <= radius))
    near = pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select("a", "b")
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(64)])
    many = keyed.filter(F.col("n") > paired).select("fp").distinct()
    hubs = many.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("hub"))
    first = hubs.groupBy("hub").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("hub", "a")
    if radius == 1:  # at distance one, one of the two is the hub
        first = first.join(many.select(F.col("fp").alias("hub")), "hub", "left_semi")
    met = hubs.join(first, "hub").filter(F.col("a") < F.col("fp")).select("a", F.col("fp").alias("b"))
    if radius == 1:
        met = met.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 1)
    return near.unionByName(met).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root: the smallest node that each node of an edge (a, b) reaches, by alternating stars.

    A large star ties a node's larger neighbours to the smallest of its neighbours and itself; a small
    star does so with the smaller ones. It ends when a round changes nothing: then every node is tied to its root.
    """
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "links")
    state = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        e = small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        e = written(e, "stars")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    tied = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return tied.unionByName(tied.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """id, fp, component_id: one row per document with the smallest id that it reaches."""
    f = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = f.groupBy("fp").agg(F.min(F.struct("id")).alias("least"))
    nodes = written(distinct, "distinct-fingerprints")
    roots = components(links(nodes.select("fp"), radius))
    of = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    smallest = of.groupBy("root").agg(F.min("least").alias("component"))
    of = of.join(smallest, "root").select("fp", F.col("component.id").alias("component_id"))
    return f.join(of, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def simhash_digest(docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
