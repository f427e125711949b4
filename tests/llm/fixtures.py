"""Small document tables with the awkward cases, and plain Python forms of the shared rules."""

import random
import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)


def docs(spark, texts, lang="en"):
    rows = [(i, t, lang, "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]
    words = ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(vocabulary)]
    return " ".join(r.choice(words) for _ in range(n))


def awkward():
    """Null, empty and white texts, one word, repeats, other scripts, a long text."""
    base = prose(1, 120)
    return [
        None, "", " \n\t ", "word", "A b C d", base, base, base.upper(), base + " extra tail words", "Über naïve café 漢字 😀 " + prose(2, 40),
        "same line of the text here\nsame line of the text here\n\nother", "x\n" * 50, " ".join(["a b c d e f g h"] * 30), prose(3, 30000), "\x00\x01  word two\x0bthree\x0cfour",
    ]


def table_docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
