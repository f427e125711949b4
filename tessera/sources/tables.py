"""Tables and files: data-set lists, rules, calibration, interleaved recordings, arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import read_array  # noqa: F401
from .interleaved import read_recordings

DATASET = "name string, date string, process string, experiments string, planes int, channels int, frame_rate double, depth double, zstack_folder string, ignore_planes string"
RULE = "planes int, rate_range string, flyback_planes string"


def list_literal(column: str, kind: str):
    """A list written as text, with either kind of quotes, as an array."""
    return F.from_json(F.regexp_replace(F.col(column), "'", '"'), f"array<{kind}>")


def read_datasets(spark: SparkSession, path: str) -> DataFrame:
    """The data-set list; Process is true or false in any case, lists are written as text."""
    raw = spark.read.option("header", True).csv(path)
    have = {c.lower(): c for c in raw.columns}
    cols = []
    for field in DATASET.split(", "):
        name, kind = field.split()
        c = F.col(have[name]) if name in have else F.lit(None)
        if name == "process":
            cols.append((F.lower(F.trim(c)) == "true").alias(name))
        elif name == "experiments":
            cols.append(list_literal(have[name], "string").alias(name) if name in have else F.lit(None).cast("array<string>").alias(name))
        elif name == "ignore_planes":
            cols.append(list_literal(have[name], "int").alias(name) if name in have else F.lit(None).cast("array<int>").alias(name))
        else:
            cols.append(c.try_cast(kind).alias(name))
    return raw.select(cols)


def read_flyback_rules(spark: SparkSession, path: str) -> DataFrame:
    """planes, rate_lo, rate_hi, flyback_planes."""
    d = spark.read.schema(RULE).option("header", True).option("quote", '"').csv(path)
    r = list_literal("rate_range", "double")
    return d.select("planes", F.get(r, F.lit(0)).alias("rate_lo"), F.get(r, F.lit(1)).alias("rate_hi"), list_literal("flyback_planes", "int").alias("flyback_planes"))


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("zoom double, fov_size double").option("header", True).csv(path)


def read_interleaved(spark: SparkSession, path: str, channels: list[str], rate: float) -> DataFrame:
    """path, sample, t_s, channel, volts of recordings whose channels are known by name; see ``interleaved`` for the source itself."""
    if rate <= 0 or not channels:
        raise ValueError("a recording has a positive rate and channels")
    d = read_recordings(spark, path, channels=len(channels), rate=rate)
    return d.withColumn("channel", F.get(F.array(*[F.lit(c) for c in channels]), F.col("channel").cast("int")))


def zoom_of(header: str):
    """The zoom factor in a header text."""
    return F.regexp_extract(F.col(header), r'"scanZoomFactor":\s*(\d*\.?\d+)', 1).try_cast("double")
