"""Plumbing of traces between tables: windows of time, unions of bad frames, trimming, pairing, validation, summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .align import small


def bad_frames(*sources: Column) -> Column:
    """Whether any source calls a frame bad; a source that says nothing does not."""
    return reduce(lambda a, b: a | b, [F.coalesce(s, F.lit(False)) for s in sources])


def in_time(df: DataFrame, time: str, start: float, stop: float) -> DataFrame:
    """Rows from start to stop, both included."""
    return df.filter(F.col(time).between(start, stop))


def central_frames(df: DataFrame, keys: Sequence[str], order: str, bad: str, count: int) -> DataFrame:
    """The usable frames about the middle of each series: of n, those from round(n/2) - round(count/2) up to round(n/2) + round(count/2).

    Halves are rounded to even, so an odd count gives one frame more or less. A series with too few usable frames fails the query.
    """
    half = round(count / 2)
    w = Window.partitionBy(*keys)
    d = df.filter(~F.coalesce(F.col(bad), F.lit(False))).withColumns({"_r": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count(F.lit(1)).over(w)})
    middle = F.rint(F.col("_n") / 2)
    fault = F.concat(F.lit(f"{count} frames about the middle are wanted of "), F.col("_n").cast("string"))
    enough = F.when((middle - half >= 0) & (middle + half <= F.col("_n")), True).otherwise(F.raise_error(fault).cast("boolean"))
    return d.filter(enough & (F.col("_r") >= middle - half) & (F.col("_r") < middle + half)).drop("_r", "_n")


def trim_to_shortest(parts: DataFrame, part: Sequence[str], frame: str) -> DataFrame:
    """The frames that every part has: those before the end of the shortest."""
    shortest = parts.groupBy(*part).agg((F.max(frame) + 1).alias("_len")).agg(F.min("_len").alias("_len"))
    # One row, whatever the parts: a condition on a single value.
    return parts.join(F.broadcast(shortest), F.col(frame) < F.col("_len"), "inner").drop("_len")


def paired(a: DataFrame, b: DataFrame, keys: Sequence[str], unmatched: str = "raise") -> DataFrame:
    """Rows of both with one key, values side by side. A key that only one side has fails the query, or is left out (``unmatched="drop"``)."""
    if unmatched == "drop":
        return a.join(b, list(keys))
    d = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), list(keys), "full_outer")
    name = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    fault = F.raise_error(F.concat(F.lit("only one table has the key "), name)).cast("boolean")
    return d.filter(F.when(F.col("_a") & F.col("_b"), True).otherwise(fault)).drop("_a", "_b")


def differences(saved: DataFrame, computed: DataFrame, keys: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """Keys that one side lacks, or whose values are over ``tolerance`` apart: none if the two tables agree."""
    s, c = saved.select(*keys, F.col(value).alias("saved"), F.lit(True).alias("_s")), computed.select(*keys, F.col(value).alias("computed"), F.lit(True).alias("_c"))
    d = s.join(c, list(keys), "full_outer")
    one_null = F.col("saved").isNull() != F.col("computed").isNull()
    return d.filter(F.col("_s").isNull() | F.col("_c").isNull() | one_null | (F.abs(F.col("saved") - F.col("computed")) > tolerance)).drop("_s", "_c")


def median_iqr(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """n, median and the quartiles' distance of each key."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    d = df.groupBy(*keys).agg(F.count(value).alias("n"), q.alias("_q"))
    return d.select(*keys, "n", F.get("_q", F.lit(1)).alias("median"), (F.get("_q", F.lit(2)) - F.get("_q", F.lit(0))).alias("iqr"))


def median_across(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The median over all series at each place; missing values do not count."""
    return df.groupBy(*keys).agg(F.percentile(value, 0.5).alias(value))


def robust_range(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Median and span between two percentiles over both traces together."""
    both = a.select(*keys, value).unionByName(b.select(*keys, value))
    q = both.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(low), F.lit(0.5), F.lit(high))).alias("_q"))
    return q.select(*keys, F.get("_q", F.lit(1)).alias("median"), (F.get("_q", F.lit(2)) - F.get("_q", F.lit(0))).alias("span"))


def pair_centre(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Middle and extent of two traces' common range."""
    both = a.select(*keys, value).unionByName(b.select(*keys, value))
    return both.groupBy(*keys).agg(((F.max(value) + F.min(value)) / 2).alias("centre"), (F.max(value) - F.min(value)).alias("extent"))


def subset(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of some ids, each of which must be there exactly once; otherwise the query fails with the id."""
    found = ids.select(key).join(df.withColumn("_here", F.lit(True)), key, "left")
    found = found.withColumn("_n", F.count("_here").over(Window.partitionBy(key)))
    fault = F.concat(F.lit("not exactly one row with id "), F.col(key).cast("string"))
    return found.withColumn("_ok", F.when(F.col("_n") == 1, True).otherwise(F.raise_error(fault).cast("boolean"))).filter("_ok").drop("_here", "_n", "_ok")


def index_of(df: DataFrame, key: str, planes: DataFrame) -> DataFrame:
    """Rows with what ``planes`` says of their plane; a plane that it lacks fails the query."""
    d = df.join(small(planes).withColumn("_here", F.lit(True)), key, "left")
    fault = F.concat(F.lit("no plane "), F.coalesce(F.col(key).cast("string"), F.lit("given")))
    return d.withColumn("_here", F.when(F.col("_here"), True).otherwise(F.raise_error(fault).cast("boolean"))).filter("_here").drop("_here")


def displacement_errors(df: DataFrame, keys: Sequence[str], observed: str, expected: str, planes: DataFrame, displacement: str) -> DataFrame:
    """Root mean squares of observed less expected over all complete pairs, and over those within the planes' range."""
    limits = planes.agg(F.min(displacement).alias("_lo"), F.max(displacement).alias("_hi"))
    # One row: the range of the planes.
    d = df.crossJoin(F.broadcast(limits)).withColumn("_e", F.col(observed) - F.col(expected))
    inside = F.when(F.col(expected).between(F.col("_lo"), F.col("_hi")), F.col("_e"))
    rms = lambda e: F.sqrt(F.avg(e * e))
    return d.groupBy(*keys).agg(rms(F.col("_e")).alias("rmse"), F.count("_e").alias("n"), rms(inside).alias("rmse_inside"), F.count(inside).alias("n_inside"))


def union_of_ranges(df: DataFrame, keys: Sequence[str], first: str, last: str, out: str) -> DataFrame:
    """Each number once that any range of a key covers, both ends included; a range whose end lies before its start is empty."""
    return df.filter(F.col(first) <= F.col(last)).select(*keys, F.explode(F.sequence(first, last)).alias(out)).distinct()


def named_slice(df: DataFrame, segments: DataFrame, keys: Sequence[str], name: str, frame: str) -> DataFrame:
    """The frames of one named segment (segments: keys, name, start, stop) renumbered from 0; a second segment of that name fails the query."""
    one = segments.filter(F.col("name") == name).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("start").alias("_a"), F.max("stop").alias("_b"))
    one = one.withColumn("_n", F.when(F.col("_n") == 1, 1).otherwise(F.raise_error(F.lit(f"segment {name} occurs more than once")).cast("int"))).filter("_n = 1")
    d = df.join(one, list(keys)).filter((F.col(frame) >= F.col("_a")) & (F.col(frame) < F.col("_b")))
    return d.withColumn(frame, F.col(frame) - F.col("_a")).drop("_n", "_a", "_b")


def reviewed(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row for each key whose values are all given (the least one that is there), and whether its rows contradict each other."""
    blank = [F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "" for c in (*keys, *values)]
    d = df.filter(reduce(lambda a, b: a & b, blank))
    one = d.groupBy(*keys).agg(F.min(F.struct(*values)).alias("_one"), (F.count_distinct(F.struct(*values)) > 1).alias("conflict"))
    return one.select(*keys, "_one.*", "conflict")


def relocated(recorded: Column, base: str) -> Column:
    """A recorded path below its new base: what follows the base's last folder in the recorded path; missing if that folder is not in it."""
    last = base.rstrip("/").rsplit("/", 1)[-1]
    parts = F.split(recorded, "/")
    at = F.array_position(parts, last)
    rest = F.slice(parts, (at + 1).cast("int"), F.greatest(F.lit(0), F.size(parts) - at.cast("int")))
    return F.when(at > 0, F.concat_ws("/", F.array(F.lit(base.rstrip("/"))), rest))
