"""Missing values: NaN at the edges is NULL inside, and comparisons and divisions keep to NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN of every floating column as NULL."""
    cols = [F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema.fields]
    return df.select(cols)


def null_to_nan(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(float("nan"))) for c in columns})


def both(a: Column, b: Column) -> Column:
    """Whether both values are there."""
    return a.isNotNull() & b.isNotNull()


def floor_one(x: Column) -> Column:
    """The larger of 1 and x; 1 where x is missing."""
    return F.greatest(F.lit(1.0), x)


def pearson(x: str | Column, y: str | Column, least: int = 2) -> Column:
    """Correlation of the complete pairs as an aggregate; NULL for under ``least`` pairs or a constant side."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    px, py = F.when(both(x, y), x), F.when(both(x, y), y)
    r = F.try_divide(F.covar_pop(px, py), F.stddev_pop(px) * F.stddev_pop(py))
    return F.when(F.count(px) >= least, r)
