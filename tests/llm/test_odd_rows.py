"""Extra columns with clashing names, very long texts, null and repeated ids, for all ten operators."""

import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, licences, line_dedup, pii, pu_quality, quality_rules, sentencepiece_lattice, simhash, similar, token_counts, warc

from .fixtures import awkward, docs, prose

NAMES = ("id", "t", "n", "h", "k", "key", "row", "fp", "node", "score", "n_pieces", "digest", "licence", "rare", "sum", "x", "lines", "first", "kept", "spans", "url", "item_id", "a", "b", "c")
BENCH = [(1, prose(100, 40)), (2, None)]
RUNS = {
    "op1": lambda d, spark: quality_rules.quality_rules(d),
    "op2": lambda d, spark: warc.round_trip(d.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "html").drop("url").withColumn("url", F.lit("u"))),
    "op3": lambda d, spark: sentencepiece_lattice.encode_digest(d),
    "op4": lambda d, spark: pii.pii_digest(d),
    "op5": lambda d, spark: simhash.simhash_digest(d),
    "op6": lambda d, spark: pu_quality.classify(d, spark.createDataFrame([(1, 1), (2, 0), (4, 1)], "doc_id bigint, quality int")),
    "op7": lambda d, spark: decontaminate.contaminated(d, spark.createDataFrame(BENCH, "item_id bigint, text string")),
    "op8": lambda d, spark: licences.scan_licences(d),
    "op9": lambda d, spark: line_dedup.line_digest(d),
    "op10": lambda d, spark: token_counts.token_counts(d),
    "near copies": lambda d, spark: similar.similar_groups(d),
}


def table(spark):
    long = prose(8, 150_000) + "\n" + BENCH[0][1] + "\n4111 1111 1111 1111"
    return docs(spark, [*awkward(), long, "x" * 300_000, prose(9, 40) + " " + BENCH[0][1]])


@pytest.mark.parametrize("name", RUNS)
def test_clashing_columns_and_long_texts(spark, name):
    d = table(spark)
    more = d.select("*", *[F.lit(f"clash {c}").alias(c) for c in NAMES])
    rows = [sorted(map(tuple, RUNS[name](x, spark).collect()), key=repr) for x in (d, more)]
    if name == "op6":  # sums of floating point numbers in another order
        rows = [[(a, b, round(c, 6), e) for a, b, c, e in x] for x in rows]
    assert rows[0] == rows[1]
    assert len(rows[0]) == (2 if name == "op7" else d.count())


def test_archives_with_null_and_repeated_ids(spark):
    pages = [(None, "u", "same"), (None, "v", "alone"), (3, "a", "same"), (3, "b", "same"), (2, "c", "same"), (None, "w", "null"), (None, "x", "null")]
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()), key=repr)
    want = [(None, "revisit", 3), (None, "response", None), (3, "response", None), (3, "revisit", 3), (2, "revisit", 3), (None, "response", None), (None, "revisit", None)]
    assert got == sorted(want, key=repr)


def test_wrapped_licences_are_recognised(spark):
    import textwrap

    mit = licences.KNOWN["MIT"][3]
    texts = ["\n\n".join(textwrap.fill(p, w) for p in mit.split("\n\n")) for w in range(40, 121)]
    assert {r.licence for r in licences.scan_licences(docs(spark, texts)).collect()} == {"MIT"}


def test_benchmark_items_with_textual_ids(spark):
    bench = spark.createDataFrame([("item-a", BENCH[0][1]), (None, None)], "item_id string, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(spark, ["no", BENCH[0][1]]), bench).collect()] == [(1, "item-a")]
