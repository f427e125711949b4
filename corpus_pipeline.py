"""The corpus pipeline: quality rules, line dedup, near-duplicates, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs.
All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import WORD_RX, table, written
from tessera.llm.decontaminate import decontaminate
from tessera.llm.line_dedup import stripped
from tessera.llm.quality_rules import quality_rules
from tessera.llm.sentencepiece_lattice import encode as encode_pieces
from tessera.llm.similar import similar_groups


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie in the perplexity band of their language."""
    good = quality_rules(docs).filter("kept").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(good, docs["doc_id"].eqNullSafe(good["_id"]), "left_semi").select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of lines go; a document that has lost all its words goes too."""
    out, names = stripped(docs)
    text = names[docs.columns.index("text")]
    out = out.filter((F.col("removed") == 0) | F.col(text).rlike(WORD_RX))
    n_chars = lambda n: F.when(F.col("removed") == 0, F.col(n)).otherwise(F.length(text).cast("long"))
    return out.select(*[(n_chars(n) if c == "n_chars" else out[n]).alias(c) for n, c in zip(names, docs.columns)])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id."""
    stay = similar_groups(docs).filter("doc_id = group_id").select(F.col("doc_id").alias("_id")).distinct()
    kept = docs.join(stay, docs["doc_id"] == stay["_id"], "left_semi").select(docs.columns)
    return kept.unionByName(docs.filter("doc_id IS NULL"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of every document that is left, and whether they decode to its whole text."""
    return encode_pieces(docs, check=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: The language model, the fingerprints and the lattice have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
