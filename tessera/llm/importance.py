"""Importance resampling towards a target distribution: hashed n-grams, log ratios of their buckets, Gumbel top-k.

Words are exploded with their places; for n-grams of more than one word a window's lead() brings the words that follow.
A feature's bucket is joined to the table of gains, which has one row for each of at most ``MOST_BUCKETS`` buckets.

Defined results: a null or empty text has no words, weight 0, and cannot be drawn; a null id hashes like an empty one
and is last among ties; of equal rows each gets its own row and rank; empty documents give no rows, an empty target
counts as zero everywhere; a text of any length is taken whole; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, written

#: Digits, lower-case ASCII letters, and whatever is not ASCII.
FEATURE_RX = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The table of gains is broadcast: so many rows at most.
MOST_BUCKETS = 1 << 20


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(FEATURE_RX), F.lit(0))


def features(df: DataFrame, keys: list[str], text: str, orders: int, buckets: int) -> DataFrame:
    """keys, bucket, is_word, first, n: the runs of 1 to ``orders`` words of each text; a text without words has one row with n = 0.

    ``keys`` tell texts apart. Rows with equal keys must have equal texts: their places are counted, not multiplied.
    ``first`` counts copies: n of a text's first word, 1 for a text without words.
    """
    if not 1 <= buckets <= MOST_BUCKETS:
        raise ValueError(f"buckets must be 1 to {MOST_BUCKETS}")
    w = df.select(*keys, F.posexplode_outer(words(F.col(text))).alias("pos", "word")).withColumn("n", F.lit(1).cast("long"))
    bucket = lambda c: (F.crc32(c.cast("binary")) % buckets).cast("int")
    if orders == 1:
        grams = w.select(*keys, "pos", "n", bucket(F.col("word")).alias("bucket"), F.lit(True).alias("is_word"))
    else:
        w = w.repartition(*keys).groupBy(*keys, "pos", "word").agg(F.sum("n").alias("n"))
        place = Window.partitionBy(*keys).orderBy("pos")
        runs = [F.col("word")]
        for k in range(1, orders):
            runs.append(F.concat(runs[-1], F.lit(" "), F.lead("word", k).over(place)))  # null past the end
        w = w.select(*keys, "pos", "n", F.array(*[F.struct(bucket(r).alias("bucket"), F.lit(i == 0).alias("is_word")) for i, r in enumerate(runs)]).alias("runs"))
        w = w.select(*keys, "pos", "n", F.explode("runs").alias("r")).filter("r.bucket IS NOT NULL OR r.is_word")
        grams = w.select(*keys, "pos", "n", "r.bucket", "r.is_word")
    some = F.col("pos").isNotNull()
    return grams.select(
        *keys, "bucket", "is_word", F.when(F.coalesce(F.col("pos"), F.lit(0)) == 0, F.when(F.col("is_word"), F.col("n"))).alias("first"), F.when(some, F.col("n")).otherwise(F.lit(0)).alias("n")
    )


def bucket_counts(df: DataFrame, text: str, orders: int, buckets: int, name: str) -> DataFrame:
    """bucket, ``name``: how often each bucket is hit in all texts."""
    if orders == 1:
        f = features(df, [], text, 1, buckets)
    else:
        keyed = df.select(F.xxhash64(text).alias("_h1"), F.xxhash64(F.lit("second"), text).alias("_h2"), text)
        f = features(keyed, ["_h1", "_h2"], text, orders, buckets)
    return f.filter("n > 0").groupBy("bucket").agg(F.sum("n").alias(name))


def bucket_gains(documents: DataFrame, target: DataFrame, orders: int, buckets: int) -> DataFrame:
    """bucket, gain: thousandths of the log ratio of smoothed shares, target over documents, floored."""
    s = bucket_counts(documents, "text", orders, buckets, "s")
    t = bucket_counts(target, "text", orders, buckets, "t")
    both = s.join(t, "bucket", "left").select("bucket", "s", F.coalesce("t", F.lit(0)).alias("t"))
    totals = Window.partitionBy()  # over at most `buckets` rows
    all_t = t.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("all_t"))
    both = both.withColumn("all_s", F.sum("s").over(totals)).join(F.broadcast(all_t))  # one row
    d = lambda c, k: F.col(c).cast("double") + F.lit(float(k))
    ratio = d("t", 1) * d("all_s", buckets) / (d("s", 1) * d("all_t", buckets))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weights(documents: DataFrame, gains: DataFrame, orders: int, buckets: int) -> DataFrame:
    """doc_id, n_words, n_features, weight: one row for each document, the floored mean of its features' gains."""
    keys = ["doc_id", "_h1", "_h2"]
    d = documents.select("doc_id", "text", F.xxhash64("text").alias("_h1"), F.xxhash64(F.lit("second"), "text").alias("_h2"))
    f = features(d, keys, "text", orders, buckets).join(F.broadcast(gains), "bucket", "left")
    per = f.groupBy(*keys).agg(
        F.sum(F.when(F.col("is_word"), F.col("n")).otherwise(0)).alias("words"), F.sum("n").alias("features"), F.sum(F.coalesce(F.col("gain") * F.col("n"), F.lit(0))).alias("gain"), F.sum("first").alias("copies")
    )
    # Each sum holds every copy once, so the divisions by their number leave no rest.
    per = per.select("doc_id", "copies", F.expr("words div copies").alias("n_words"), F.expr("features div copies").alias("n_features"), F.expr("CASE WHEN features = 0 THEN 0L ELSE (gain - pmod(gain, features)) div features END").alias("weight"))
    return per.select("doc_id", "n_words", "n_features", "weight", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")


def gumbel(key: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variable drawn by a key's hash."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def drawn(scored: DataFrame, eligible: Column, percent: int, ties: list[Column]) -> DataFrame:
    """``scored`` with a rank for the highest ``percent`` of the eligible rows by score, null for all others.

    Scores are whole thousandths of logarithms: fewer than 2^18 of them can differ at any size. Rows above a score come from the
    running sum of a histogram by score; rows within it are numbered by score, so that no task orders all rows.
    """
    histogram = scored.filter(eligible).groupBy(F.col("score").alias("_score")).agg(F.count("*").alias("_n"))
    down = Window.orderBy(F.desc("_score"))
    above = histogram.select(
        "_score", (F.sum("_n").over(down) - F.col("_n")).alias("_above"), F.expr(f"sum(_n) OVER () * {int(percent)} div 100").alias("_draw")
    )
    placed = scored.withColumn("_eligible", F.coalesce(eligible, F.lit(False)))
    placed = placed.join(F.broadcast(above), placed["_eligible"] & (placed["score"] == above["_score"]), "left")
    place = F.col("_above") + F.row_number().over(Window.partitionBy("_eligible", "score").orderBy(*ties))
    return placed.withColumn("rank", F.when(F.col("_eligible"), place)).withColumn("rank", F.when(F.col("rank") <= F.col("_draw"), F.col("rank"))).drop("_eligible", "_score", "_above", "_draw")


def resample(documents: DataFrame, target: DataFrame, orders: int = 1, buckets: int = 10000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score, rank, n_words: every document; rank tells the draw's order and is null for the rest."""
    gains = bucket_gains(documents, target, orders, buckets)
    w = weights(documents, gains, orders, buckets)
    scored = written(w.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "importance")
    ties = [F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    return drawn(scored, F.col("n_words") >= least_words, percent, ties).select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def resample_digest(documents: DataFrame, target: DataFrame) -> DataFrame:
    return resample(documents, target).select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("n_features", "weight", "score", "rank")])


def importance_sql() -> str:
    """The same rows in DuckDB, with CRC-32 worked out over its table of bytes."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    word = lambda t: f"unnest(regexp_extract_all(translate(coalesce({t}, ''), '{upper}', '{upper.lower()}'), '{FEATURE_RX}'))"
    return f"""
    WITH crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i))),
    dw AS (SELECT doc_id, {word('text')} AS w FROM documents),
    bw AS (SELECT {word('text')} AS w FROM benchmark),
    vocabulary AS (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)),
    bytes AS (SELECT w, list_transform(range(strlen(w)), lambda i: ('0x' || substr(hex(w), (2 * i + 1)::INT, 2))::BIGINT) AS b FROM vocabulary),
    hashed AS (SELECT w, xor(list_reduce(list_prepend(4294967295, b), lambda a, x: xor(a >> 8, crc.t[(xor(a, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, crc),
    s AS (SELECT bucket, count(*) AS s FROM dw JOIN hashed USING (w) GROUP BY bucket),
    t AS (SELECT bucket, count(*) AS t FROM bw JOIN hashed USING (w) GROUP BY bucket),
    gains AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE / ((s + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
    per AS (SELECT doc_id, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight FROM dw JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY doc_id),
    scored AS (SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM documents LEFT JOIN per USING (doc_id)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, (SELECT count(*) FROM scored WHERE n_features >= 20) * 10 // 100 AS draw FROM scored)
    SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= draw THEN place END::BIGINT AS rank FROM placed"""
