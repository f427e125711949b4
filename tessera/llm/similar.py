"""Near copies by SimHash with a verified similarity: for stages on word shingles (five words, 0.8).

SimHash estimates a cosine, so the similarity is the cosine of two sets of shingles: the shingles that they
share, divided by the root of the product of their sizes. A fingerprint of 64 bits tells near copies at 0.8 apart from
other texts (some 13 bits against some 32), but no part of it need stay equal. So each document also gets fingerprints of
PARTS sets of shingles: of its SAMPLED shingles with the smallest hashes, which two similar texts mostly share, and which
their hashes deal out to the parts. Documents that agree on the fingerprint of a part are candidates: at a similarity
of 0.8 two texts agree on some part with a probability of over 0.999. Candidates whose distances to some reference
fingerprint (pivot) differ by over RADIUS, or that are over RADIUS bits apart, are discarded, and the survivors are
verified by the exact similarity of their whole shingle sets.

Equal shingle sets are one node. Up to PAIRED nodes that agree on a part are all paired. Where more do (copies by the
thousand, texts that share a passage), CENTRES rounds link a part's nodes to its most central one; then every node outside
the largest component of its part meets all nodes of that part, in blocks of bounded size that count common shingles by
a product of matrices. Pairs within one component add nothing, so the groups are those of all pairs of the part,
whatever its size; no part is cut, and no block holds more than BLOCK nodes or BLOCK_SHINGLES shingles a side (or one node).

Defined cases: a null text is the empty text; texts without words are copies of each other; a text with fewer words than a
shingle has one shingle, its whole sequence; rows that share an id are looked at each for itself, and the id is in the group of each;
a null id takes part, and a group of null ids alone has a null group id; a very long text costs memory in proportion to its
words; columns besides id and text are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import blocks, mix
from .common import whole_text, written
from .simhash import _LOWER, PAIRED, components, fingerprint_of, max_difference, pivot_table, shingle_hashes

SHINGLE, SIMILARITY = 5, 0.8
PARTS, SAMPLED = 24, 72
RADIUS = 24
#: Rounds that compare the nodes of a large part with a centre before the rest meets in blocks.
CENTRES = 2
#: Nodes and shingles of one side of a block; columns of its matrices at a time.
BLOCK, BLOCK_SHINGLES, COLUMNS = 1024, 1 << 20, 4096


def _shingle_sets(texts: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, hashes of the shingles in order, distinct hashes) of each text."""
    for lo, hi, b in blocks(texts):
        data = _LOWER[b.data]
        for i in range(hi - lo):
            w = slice(b.word_offs[i], b.word_offs[i + 1])
            h = shingle_hashes(data, b.starts[w], b.ends[w], size)
            yield lo + i, h, np.unique(h)


def _sums(h: np.ndarray) -> tuple[int, int]:
    """Two sums over distinct hashes: with their number they tell a set."""
    return h.sum(dtype=np.uint64), mix(h).sum(dtype=np.uint64)


def _signature_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        fp, count, total, both = (np.zeros(n, dtype=np.uint64) for _ in range(4))
        parts: list[list[int | None]] = [[]] * n
        for i, every, h in _shingle_sets(batch.column(1), size):
            fp[i], count[i] = fingerprint_of(every), len(h)
            total[i], both[i] = _sums(h)
            least = mix(h)
            if len(h) > SAMPLED:
                least = least[np.argpartition(least, SAMPLED)[:SAMPLED]]
            parts[i] = part_fingerprints(least)
        cols = [pa.array(x.view(np.int64)) for x in (fp, count, total, both)]
        yield pa.record_batch([batch.column(0), *cols, pa.array(parts, type=pa.list_(pa.int64()))], names=["id", "fp", "n", "s1", "s2", "parts"])


def part_fingerprints(sampled: np.ndarray) -> list[int | None]:
    """The fingerprint of each part of a sample of hashes: of its hashes' bits those that over half have. None where a part has no hash."""
    of = (mix(sampled) % np.uint64(PARTS)).astype(np.int64)
    deal = np.zeros((PARTS, len(sampled)), dtype=np.float32)
    deal[of, np.arange(len(sampled))] = 1
    bits = np.unpackbits(mix(sampled + of.astype(np.uint64)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
    size = deal.sum(axis=1)
    fp = np.packbits(2 * (deal @ bits) > size[:, None], axis=1, bitorder="little").view(np.int64).ravel()
    return [x if n else None for x, n in zip(fp.tolist(), size.tolist())]


def _node() -> Column:
    return F.xxhash64("n", "s1", "s2").alias("node")


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """id, node (tells the set of shingles), fp, n (distinct shingles), parts (fingerprints of the parts)."""
    d = docs.select(docs[id_col].alias("id"), whole_text(docs, text_col).alias("t"))
    kind = docs.schema[id_col].dataType.simpleString()
    s = d.mapInArrow(lambda it: _signature_batches(it, shingle), f"id {kind}, fp bigint, n bigint, s1 bigint, s2 bigint, parts array<bigint>")
    return s.select("id", _node(), "fp", "n", "parts")


def _set_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat, offs, sums = [np.zeros(0, dtype=np.uint64)], [0], []
        for _, _, h in _shingle_sets(batch.column(0), size):
            flat.append(h)
            offs.append(offs[-1] + len(h))
            sums.append((len(h), *_sums(h)))
        n, s1, s2 = (pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (zip(*sums) if sums else ((), (), ())))
        sets = pa.ListArray.from_arrays(pa.array(offs, type=pa.int32()), pa.array(np.concatenate(flat).view(np.int64)))
        yield pa.record_batch([n, s1, s2, sets], names=["n", "s1", "s2", "set"])


def shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """node, n, set for the nodes of ``wanted`` (node, id of one of its documents)."""
    ids = wanted.select("id").distinct()
    texts = docs.select(docs[id_col].alias("id"), whole_text(docs, text_col).alias("t")).alias("d").join(ids.alias("w"), F.col("d.id").eqNullSafe(F.col("w.id")), "left_semi").select("t")
    sets = texts.mapInArrow(lambda it: _set_batches(it, shingle), "n bigint, s1 bigint, s2 bigint, set array<bigint>").select(_node(), "n", "set")
    return sets.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def common_counts(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """How many values each of the distinct-valued arrays xs shares with each of ys, as a matrix."""
    flat = [np.concatenate([np.zeros(0, dtype=np.int64), *s]) for s in (xs, ys)]
    row = [np.repeat(np.arange(len(s)), [len(a) for a in s]) for s in (xs, ys)]
    shared = np.intersect1d(*flat)
    out = np.zeros((len(xs), len(ys)), dtype=np.float32)
    if not len(shared):
        return out
    places = []
    for f, r in zip(flat, row):
        at = np.minimum(np.searchsorted(shared, f), len(shared) - 1)
        ok = shared[at] == f
        at, r = at[ok], r[ok]
        order = np.argsort(at, kind="stable")
        places.append((at[order], r[order]))
    for lo in range(0, len(shared), COLUMNS):
        width = min(COLUMNS, len(shared) - lo)
        sides = []
        for (at, r), n in zip(places, out.shape):
            a, b = np.searchsorted(at, [lo, lo + width])
            m = np.zeros((n, width), dtype=np.float32)
            m[r[a:b], at[a:b] - lo] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def _block_links(t: pa.Table, similarity: float) -> pa.Table:
    """a, b: links that tie together what is similar between the two sides of a block and not in one component yet."""
    outer = t.column("outer").to_numpy(zero_copy_only=False).astype(bool)
    node, root, n = (t.column(c).to_numpy() for c in ("node", "root", "n"))
    sets = [np.asarray(s.values.to_numpy(zero_copy_only=False)) for s in t.column("set")]
    x, y = np.flatnonzero(outer), np.flatnonzero(~outer)
    a, b = [], []
    if len(x) and len(y):
        common = common_counts([sets[i] for i in x], [sets[i] for i in y]).astype(np.float64)
        close = common * common >= similarity**2 * np.outer(n[x], n[y]) - 1e-6
        label = root.copy()
        for k in np.flatnonzero(close.any(axis=1)):
            mine = y[close[k]]
            for other, at in zip(*np.unique(label[mine], return_index=True)):
                if other != label[x[k]]:
                    a.append(node[x[k]])
                    b.append(node[mine[at]])
                    label[label == other] = label[x[k]]
    return pa.table({"a": pa.array(a, type=pa.int64()), "b": pa.array(b, type=pa.int64())})


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, paired: int = PAIRED) -> DataFrame:
    """id, group_id: the smallest id that each row is tied to by links of ``similarity`` or more. A row for each row of docs."""
    sig = written(signatures(docs, id_col, text_col, shingle), "signatures")
    nodes = written(sig.groupBy("node").agg(F.min("id").alias("id"), F.min(F.struct("fp", "n", "parts")).alias("x")).select("node", "id", "x.*"), "distinct-sets")
    keyed = nodes.select("node", "fp", "n", F.posexplode("parts").alias("p", "key")).filter("key IS NOT NULL")
    sizes = keyed.groupBy("p", "key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    keyed = written(pivot_table(keyed.join(sizes, ["p", "key"])), "part-keys")
    wanted = nodes.join(keyed.select("node").distinct(), "node", "left_semi").select("node", "id")
    sets = written(shingle_sets(docs, wanted, id_col, text_col, shingle), "shingle-sets")

    def links(pairs: DataFrame, name: str) -> DataFrame:
        """a, b of the pairs whose exact similarity suffices."""
        side = lambda x: sets.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("set").alias(f"s{x}"))
        c = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")
        common = F.size(F.array_intersect("sa", "sb")).cast("double")
        return written(c.filter(common * common >= similarity**2 * F.col("na") * F.col("nb") - 1e-6).select("a", "b"), name)

    few = keyed.filter(F.col("size") <= paired)
    side = lambda x: few.select("p", "key", F.col("node").alias(x), F.col("dist").alias(f"d{x}"), F.col("fp").alias(f"f{x}"))
    near = (max_difference(F.col("da"), F.col("db")) <= RADIUS) & (F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= RADIUS)
    edges = links(side("a").join(side("b"), ["p", "key"]).filter("a < b").filter(near), "similar-pairs")

    # Parts that many share. The centre of a part: the node whose parts are the largest together.
    large = keyed.filter(F.col("size") > paired).select("p", "key", "node", "n", "size")
    large = written(large.join(large.groupBy("node").agg(F.sum("size").alias("share")), "node"), "large-parts")
    rest = large
    for i in range(CENTRES):
        centre = rest.groupBy("p", "key").agg(F.max(F.struct("share", "node")).alias("c")).select("p", "key", F.col("c.node").alias("a"))
        linked = links(rest.join(centre, ["p", "key"]).filter("a != node").select("a", F.col("node").alias("b")), "similar-to-centre")
        edges = edges.unionByName(linked)
        if i + 1 < CENTRES:
            tied = linked.select(F.col("a").alias("node")).unionByName(linked.select(F.col("b").alias("node"))).distinct()
            rest = written(rest.join(tied, "node", "left_anti"), "not-linked")
    roots = components(edges)

    # Who is outside the largest component of a part meets all of the part, block by block.
    large = written(large.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "part-components")
    sums = large.groupBy("p", "key", "root").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("s"))
    main = sums.groupBy("p", "key").agg(F.max(F.struct("k", "s", "root")).alias("m"), F.count(F.lit(1)).alias("roots"), F.sum("k").alias("k"), F.sum("s").alias("s")).filter("roots > 1")
    blocks_of = lambda k, s: F.greatest(F.ceil(k / BLOCK), F.ceil(s / BLOCK_SHINGLES), F.lit(1)).cast("int")
    main = main.select("p", "key", F.col("m.root").alias("main"), blocks_of(F.col("k") - F.col("m.k"), F.col("s") - F.col("m.s")).alias("xs"), blocks_of(F.col("k"), F.col("s")).alias("ys"))
    open_ = large.join(main, ["p", "key"])
    at = lambda parts: F.pmod(F.xxhash64("node"), parts).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    x = open_.filter("root != main").select("p", "key", "node", "root", F.lit(True).alias("outer"), at(F.col("xs")).alias("xb"), every("ys").alias("yb"))
    y = open_.select("p", "key", "node", "root", F.lit(False).alias("outer"), at(F.col("ys")).alias("yb"), every("xs").alias("xb"))
    met = x.unionByName(y).join(sets, "node").groupBy("p", "key", "xb", "yb").applyInArrow(lambda t: _block_links(t, similarity), "a bigint, b bigint")
    roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(written(met, "similar-blocks")))
    of = nodes.select("node", "id").join(roots, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    of = of.join(of.groupBy("root").agg(F.min("id").alias("group_id")), "root").select("node", "group_id")
    return sig.select("id", "node").join(of, "node").select(F.col("id").alias(id_col), "group_id")
