"""Alignment of clocks and tables: range joins, as-of joins, calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequence import ordered

#: Rows that a rule or calibration table may have to be broadcast.
SMALL_ROWS = 10_000


def small(df: DataFrame) -> DataFrame:
    """A table for broadcasting, if it has few rows; else as it is, for the optimiser to choose."""
    return F.broadcast(df) if len(df.take(SMALL_ROWS + 1)) <= SMALL_ROWS else df


def range_rules(df: DataFrame, value: str, rules: DataFrame, on: Sequence[str] = (), low: str = "rate_lo", high: str = "rate_hi", first: str | None = None) -> DataFrame:
    """Rows with each rule whose range (both ends included) holds their value; only the first by ``first`` if that is given, or none."""
    if first is not None:
        # The rules as one array in their order: rows find their first where they are.
        columns = [first, *[c for c in rules.columns if c not in (*on, first)]]
        listed = small(rules.groupBy(*on).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("_rules")))
        d = df.join(listed, list(on), "left") if on else df.crossJoin(listed)  # one row
        d = d.withColumn("_rule", F.get(F.filter("_rules", lambda r: F.col(value).between(r[low], r[high])), F.lit(0)))
        return d.select(*df.columns, *[F.col("_rule")[c].alias(c) for c in rules.columns if c not in on])
    cond: Column = F.col(value).between(F.col(low), F.col(high))
    for c in on:
        cond = cond & (df[c] == rules[c])
    out = df.join(small(rules), cond)
    for c in on:
        out = out.drop(rules[c])
    return out


def calibrate(df: DataFrame, value: str, points: list[tuple[float, float]], out: str, outside: str = "raise") -> DataFrame:
    """Piecewise linear between calibration points. A value outside their range fails the query, or gives NULL (``outside="null"``)."""
    pts = sorted(points)
    e = F.when(F.col(value) == pts[0][0], F.lit(float(pts[0][1])))
    for (x0, y0), (x1, y1) in zip(pts, pts[1:]):
        e = e.when((F.col(value) > x0) & (F.col(value) <= x1), F.lit(float(y0)) + (F.col(value) - x0) * ((y1 - y0) / (x1 - x0)))
    if outside == "raise":
        fault = F.concat(F.lit(f"{value} is outside the calibration: "), F.col(value).cast("string"))
        e = e.when(F.col(value).isNotNull(), F.raise_error(fault).cast("double"))
    return df.withColumn(out, e)


def digitize(samples: DataFrame, t: str, clock: DataFrame, clock_t: str, bin_: str = "bin", keys: Sequence[str] = ()) -> DataFrame:
    """Each sample with the number of clock times at or before it (of its keys).

    Samples and clock are one ordered series, so each side is sorted once and neither is broadcast.
    """
    s = samples.select(*keys, F.col(t).alias("_t"), F.lit(1).alias("_o"), F.struct(*samples.columns).alias("_row"))
    c = clock.select(*keys, F.col(clock_t).alias("_t"), F.lit(0).alias("_o"), F.lit(None).cast(s.schema["_row"].dataType).alias("_row"))
    w = Window.partitionBy(*keys).orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    u = c.unionByName(s).withColumn("_n", F.sum((F.col("_o") == 0).cast("long")).over(w))
    return u.filter("_o = 1").select("_row.*", F.col("_n").alias(bin_))


def next_sample(clock: DataFrame, clock_t: str, samples: DataFrame, t: str, pick: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Each clock row with the columns ``pick`` of the first sample at or after it (NULL if there is none)."""
    c = clock.select(*keys, F.col(clock_t).alias("_t"), F.lit(0).alias("_o"), F.struct(*clock.columns).alias("_row"), F.lit(None).cast(samples.select(F.struct(*pick).alias("x")).schema["x"].dataType).alias("_s"))
    s = samples.select(*keys, F.col(t).alias("_t"), F.lit(1).alias("_o"), F.lit(None).cast(c.schema["_row"].dataType).alias("_row"), F.struct(*pick).alias("_s"))
    # The last sample in the reversed order: Spark works a frame up to the last row out anew for each row.
    w = Window.partitionBy(*keys).orderBy(F.desc("_t"), F.desc("_o")).rowsBetween(Window.unboundedPreceding, 0)
    u = c.unionByName(s).withColumn("_s", F.last("_s", True).over(w))
    return u.filter("_o = 0").select("_row.*", *[F.col("_s")[p].alias(p) for p in pick])


def snippets(clock: DataFrame, clock_t: str, samples: DataFrame, t: str, index: str, value: str, n: int, keys: Sequence[str] = (), uncovered: str = "raise") -> DataFrame:
    """The n samples from the first at or after each clock time on, with their offsets.

    A clock time that the samples do not cover fails the query, or goes (``uncovered="drop"``).
    """
    at = next_sample(clock, clock_t, samples, t, [index], keys)
    if uncovered == "raise":
        ends = samples.groupBy(*keys).agg(F.max(index).alias("_end"))
        at = at.join(ends, list(keys), "left") if keys else at.crossJoin(F.broadcast(ends))  # one row
        fault = F.raise_error(F.concat(F.lit("samples do not cover the time "), F.col(clock_t).cast("string"))).cast("boolean")
        at = at.filter(F.when(F.col(index) + n - 1 <= F.col("_end"), True).otherwise(fault)).drop("_end")
    else:
        at = at.filter(F.col(index).isNotNull())
    wide = at.withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(index, F.col(index) + F.col("offset"))
    got = wide.join(samples.select(*keys, index, value), [*keys, index])
    full = got.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys, clock_t)))
    return full.filter(F.col("_n") == n).drop("_n")


def in_segment(df: DataFrame, t: str, segments: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Each row with the segment whose [start, stop) holds its time."""
    s = small(segments)
    cond = (F.col(t) >= F.col("start")) & (F.col(t) < F.col("stop"))
    for k in keys:
        cond = cond & (df[k] == segments[k])
    out = df.join(s, cond)
    for k in keys:
        out = out.drop(segments[k])
    return out


def median_interval(df: DataFrame, keys: Sequence[str], t: str, out: str = "dt") -> DataFrame:
    """The median step of a clock."""
    d = df.withColumn("_d", F.col(t) - F.lag(t).over(ordered(keys, t)))
    return d.groupBy(*keys).agg(F.percentile("_d", 0.5).alias(out))
