"""The driver's tables as the engine's relations: traces, correlations between references and planes, images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.depth import argmax
from ..operators.sequence import number

# The kinds of events, as numbers of references.
KINDS = ("click", "error", "purchase", "signup", "view")
PLANES = 5


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(column: str):
    """Seconds since 1970 of a time without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(column).cast("timestamp_ntz")) / 1e6


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """roi, segment, frame, t_s, f (missing in bad frames), fneu, z, bad, and the event's columns."""
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    d = e.select(
        (F.col("user_id") % 10).alias("roi"), F.floor((F.day("ts") - 1) / 10).alias("segment"), "ts", seconds("ts").alias("t_s"), "event_id", "event_type", "user_id", "value",
        F.when(F.col("event_type") != "error", F.col("value")).alias("f"), k.cast("double").alias("fneu"), (k % 20).alias("z"), (F.col("event_type") == "error").alias("bad"),
    )
    return number(d, ["roi", "segment"], ["ts", "event_id"])


TRACE_SQL = """tr AS (SELECT user_id % 10 AS roi, floor((extract(day FROM ts) - 1) / 10)::BIGINT AS segment, ts, epoch_us(ts) / 1e6 AS t_s, event_id, event_type, user_id, value,
    CASE WHEN event_type <> 'error' THEN value END AS f, json_extract_string(props, '$.k')::DOUBLE AS fneu, json_extract_string(props, '$.k')::BIGINT % 20 AS z, event_type = 'error' AS bad,
    row_number() OVER (PARTITION BY user_id % 10, floor((extract(day FROM ts) - 1) / 10) ORDER BY ts, event_id) - 1 AS frame FROM events)"""


def reference_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame (a day), ref (a kind of event), plane, corr."""
    e = read(spark, sf_dir, "events")
    ref = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("event_type")) - 1
    return e.groupBy((F.day("ts") - 1).cast("long").alias("frame"), ref.alias("ref"), (F.col("user_id") % PLANES).alias("plane")).agg(F.avg("value").alias("corr"))


REFERENCE_SQL = f"""rc AS (SELECT (extract(day FROM ts) - 1)::BIGINT AS frame, (list_position({list(KINDS)}, event_type) - 1)::BIGINT AS ref, user_id % {PLANES} AS plane, avg(value) AS corr
    FROM events GROUP BY ALL),
    bp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame, ref ORDER BY corr DESC NULLS LAST, plane) AS r FROM rc) WHERE r = 1)"""


def planes_of_reference(spark: SparkSession, sf_dir: str, ref: int = 0) -> DataFrame:
    return argmax(reference_correlations(spark, sf_dir).filter(F.col("ref") == ref), ["frame"], "plane", "corr")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, plane (the label), px: embeddings as flat images."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.col("label").cast("long").alias("plane"), F.col("embedding").alias("px"))


def tidy(df: DataFrame) -> DataFrame:
    """Whole numbers as long, others rounded to six places: one form for every engine that checks."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6)
            c = F.when(c == 0, F.lit(0.0)).otherwise(c)
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(out)
