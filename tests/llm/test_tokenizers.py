import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import sentencepiece_lattice as L
from tessera.llm import token_counts as C
from tessera.llm.pieces import UNITS, vocabulary

from .fixtures import awkward, docs, table_docs


@pytest.fixture(scope="module")
def v():
    return vocabulary()


@pytest.fixture(scope="module")
def library(v):
    """The library's own unigram encoder with the same pieces and scores."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    from tessera.llm.pieces import DEFAULT_MODEL

    m = pb.ModelProto()
    m.ParseFromString(open(DEFAULT_MODEL, "rb").read())
    score = {i: s for _, i, s in v.pieces}
    for i, p in enumerate(m.pieces):
        p.score = score.get(i, 0) / UNITS
    m.trainer_spec.model_type = 1
    m.trainer_spec.vocab_size = len(m.pieces)
    return sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())


def texts_of(df):
    return {r.doc_id: r.text or "" for r in df.collect()}


def test_counts_match_the_library(spark, sf, library):
    short = [t for t in awkward() if t is None or "\x00" not in t and len(t) < 20000]
    for df in (docs(spark, short), table_docs(spark, sf)):
        want = {i: len(library.encode(t)) for i, t in texts_of(df).items()}
        assert {r.doc_id: r.n_tokens for r in C.token_counts(df).collect()} == want


def plain_viterbi(text, v):
    """The best pieces of a text, by exact sums and the rule for ties, in plain Python."""
    t = "▁" + text.replace(" ", "▁") if text else ""
    piece = {p: (i, s) for p, i, s in v.pieces}
    best = [(0, None, None)] + [None] * len(t)
    for e in range(1, len(t) + 1):
        for b in range(max(0, e - v.longest), e):
            known = piece.get(t[b:e]) or ((None, v.unknown) if e - b == 1 else None)
            if known and (best[e] is None or best[b][0] + known[1] > best[e][0]):
                best[e] = best[b][0] + known[1], b, known[0]
    out, e = [], len(t)
    while e:
        _, b, i = best[e]
        out.append([i] if i is not None else [v.first_byte + x for x in t[b:e].encode()])
        e = b
    return [i for x in reversed(out) for i in x]


def long_texts():
    """Unbroken texts of one word: letters, digits and letters, another script; and a long text of words."""
    r = random.Random(3)
    return ["".join(r.choice("etaoinshrdlu") for _ in range(3000)), "".join(r.choice("abcdefXYZ0123456789+/") for _ in range(5000)), "漢字仮名交" * 300, "😀" * 700, awkward()[13]]


@pytest.mark.parametrize("most", [0, 50, L.FREQUENT])
def test_encoded_documents_match_plain_viterbi_and_the_library(spark, v, library, most):
    texts = [*awkward(), *long_texts(), "a ▁ b"]
    df = docs(spark, texts)
    got = {r.doc_id: list(r.ids) for r in L.encode(df, most=most).collect()}
    for i, t in texts_of(df).items():
        assert got[i] == plain_viterbi(t, v), i
        if len(t) < 20000 and "\x00" not in t:
            assert got[i] == library.encode(t), i


def test_tables_encode_as_the_library_does_and_decode(spark, sf, library):
    df = table_docs(spark, sf)
    encoded = L.encode(df, most=500)
    got = {r.doc_id: list(r.ids) for r in encoded.collect()}
    want = texts_of(df)
    assert {i: library.encode(t) for i, t in want.items()} == got
    assert texts_of(L.decode(encoded)) == want
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in L.encode(df, check=True).collect())
    sums = []
    for most in (0, 500, L.FREQUENT):
        rows = L.encode_digest(df, most=most).collect()
        assert len(rows) == df.count() and all(r.round_trip and r.n_pieces == len(got[r.doc_id]) >= r.n_segments for r in rows)
        assert len({r.ids_sum for r in rows}) == len(set(want.values()))
        sums.append({(r.doc_id, r.n_segments, r.ids_sum) for r in rows})
    assert sums[0] == sums[1] == sums[2]


def test_round_trip_is_of_the_whole_text(spark):
    texts = [t for t in awkward() if t is None or len(t) < 20000]
    df = docs(spark, [*texts, "a ▁ b"])
    for out in (L.encode_digest(df), L.encode(df, check=True)):
        rows = {r.doc_id: r.round_trip for r in out.collect()}
        assert all(rows[i] for i in range(len(texts))) and not rows[len(texts)]


def test_a_word_of_many_characters(spark, v):
    r = random.Random(4)
    text = "".join(r.choice("etaoinshrdlu") for _ in range(200_000))
    (row,) = L.encode_digest(docs(spark, [text])).collect()
    assert row.round_trip and row.n_pieces == C.token_counts(docs(spark, [text])).first().n_tokens


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (2, None)], "doc_id int, text string")
    df = df.select("*", *[F.lit("x").alias(c) for c in ("id", "h", "n", "key", "ids", "pieces", "rare", "seg")])
    for most in (0, L.FREQUENT):
        rows = L.encode(df, most=most, check=True).collect()
        assert sorted([(r.doc_id or 0, len(r.ids), r.round_trip) for r in rows]) == sorted([(0, 1, True), (1, 2, True), (1, 2, True), (2, 0, True)])
        rows = L.encode_digest(df, most=most).collect()
        assert sorted([(r.doc_id or 0, r.n_pieces, r.round_trip) for r in rows]) == sorted([(0, 1, True), (1, 2, True), (1, 2, True), (2, 0, True)])
    assert {(r.doc_id, r.n_tokens) for r in C.token_counts(df.withColumn("s", F.lit(1))).collect()} == {(1, 2), (None, 1), (2, 0)}


def test_empty_table(spark):
    assert L.encode_digest(docs(spark, [])).count() == 0
    assert C.token_counts(docs(spark, [])).count() == 0


def test_the_digest_is_of_the_pieces_of_encode(spark):
    df = docs(spark, [t for t in awkward() if t is None or len(t) < 20000])
    pieces = {r.doc_id: (r.n_segments, r.n_pieces, r.h, r.round_trip) for r in L.encode(df, check=True).withColumn("h", F.xxhash64("ids")).collect()}
    assert {r.doc_id: (r.n_segments, r.n_pieces, r.ids_sum, r.round_trip) for r in L.encode_digest(df).collect()} == pieces


def test_texts_are_looked_up_once(spark):
    """The documents that ask for words and those that take them in are one exchange."""
    df = docs(spark, [f"some words w{i}x and q{i}z" for i in range(50)])
    for check in (True, False):
        e = L.encode(df, most=2, check=check)
        assert len(e.collect()) == 50
        plan = e._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "ReusedExchange" in plan


class Shared:
    def __init__(self, value):
        self.value = value


def test_documents_are_dealt_out_in_fewer_bytes_than_their_texts(v):
    """Rows for up to ROWS documents hold numbers of words, and a task hands on each of its words once."""
    r = random.Random(5)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(words[min(int(r.paretovariate(0.5)), 3000) - 1] for _ in range(300)) for _ in range(1000)]
    batch = pa.record_batch([pa.array(range(1000)), pa.array(texts)], names=["id", "t"])
    found = [w for b in L._word_batches(iter([batch.select(["t"])] * 30), Shared(v)) for w in b.column("seg").to_pylist()]
    assert len(found) == len(set(found))
    keys = np.array([xxhash.xxh64_intdigest(w.encode(), 42) for w in found], dtype=np.uint64).view(np.int64)
    table = pa.table({"h": pa.array(keys[10:]), "n": pa.array(range(len(found) - 10)), "ids": pa.array([[1, 2, 3]] * (len(found) - 10), type=pa.list_(pa.int32()))})
    out = list(L._gapped_batches(iter([batch]), Shared(v), Shared(L.Frequent(table))))
    assert sum(b.num_rows for b in out) == -(-1000 // L.ROWS)
    assert sum(b.nbytes for b in out) < 0.6 * sum(map(len, texts))


def test_stretches_of_many_texts_are_those_of_each(v):
    texts = [t or "" for t in [*awkward(), *long_texts(), "a ▁ b", " a", "a ", " ", "", "a  b c", "a b"]]
    assert L.stretched(pa.array(texts)).to_pylist() == [L.stretches(t) for t in texts]
    number = np.array([0, 1, 255, 256, 70_000, 1 << 18, 0])
    assert L._unpacked(L._packed(number), 7).tolist() == number.tolist() and L._unpacked(L._packed(number[:0]), 0).tolist() == []
