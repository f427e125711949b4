"""Validation of data-set tables and configurations before anything runs."""

from __future__ import annotations

import re
import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.align import small

_EXPRESSION = re.compile(r"[0-9.\s]+[-+*/][-+*/0-9.\s]+")


def boolean(value: object, name: str) -> bool:
    if isinstance(value, bool):
        return value
    if isinstance(value, str) and value.strip().lower() in ("true", "false"):
        return value.strip().lower() == "true"
    raise ValueError(f"{name} must be true or false")


def number(value: object, name: str, low: float | None = None, high: float | None = None, whole: bool = False) -> float | int:
    """A number in its bounds; texts, even of sums or quotients, and truth values are none."""
    if isinstance(value, str) and _EXPRESSION.fullmatch(value):
        raise ValueError(f"{name} must be a number, not an expression")
    if isinstance(value, (bool, str)) or not isinstance(value, (int, float)) or value != value or value in (float("inf"), float("-inf")):
        raise ValueError(f"{name} must be a number")
    if whole and value != int(value):
        raise ValueError(f"{name} must be whole")
    if low is not None and value < low or high is not None and value > high:
        raise ValueError(f"{name} must lie in [{low}, {high}]")
    return int(value) if whole else value


def template(text: str, allowed: set[str], required: set[str]) -> str:
    """A path template with no placeholders but the allowed ones and all of the required."""
    have = {f for _, f, _, _ in string.Formatter().parse(text) if f is not None}
    if have - allowed:
        raise ValueError(f"unknown placeholders: {sorted(have - allowed)}")
    if required - have:
        raise ValueError(f"missing placeholders: {sorted(required - have)}")
    return text


def require(config: dict, keys: tuple[str, ...], where: str = "configuration") -> dict:
    missing = [k for k in keys if k not in config]
    if missing:
        raise ValueError(f"{where} lacks {', '.join(missing)}")
    return config


def violations(datasets: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """name, date, problem: one row for each problem of a selected row; without rows all is well."""
    d = datasets.filter("process")
    checks = {
        "name is empty": F.coalesce(F.trim("name"), F.lit("")) == "",
        "date is empty": F.coalesce(F.trim("date"), F.lit("")) == "",
        "planes must be positive": ~F.coalesce(F.col("planes") > 0, F.lit(False)),
        "frame rate must be positive": ~F.coalesce(F.col("frame_rate") > 0, F.lit(False)),
        "no experiments": F.coalesce(F.size("experiments"), F.lit(0)) <= 0,
        "depth must not be negative": F.coalesce(F.col("depth") < 0, F.lit(False)),
    }
    bad = d.select("name", "date", F.explode(F.filter(F.array(*[F.when(c, F.lit(p)) for p, c in checks.items()]), lambda x: x.isNotNull())).alias("problem"))
    twice = d.groupBy("name", "date").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("name", "date", F.lit("listed twice").alias("problem"))
    bad = bad.unionByName(twice)
    if rules is not None:
        r = small(rules.withColumnRenamed("planes", "_p"))
        n = d.join(r, (F.col("planes") == F.col("_p")) & F.col("frame_rate").between(F.col("rate_lo"), F.col("rate_hi")), "left").groupBy("name", "date").agg(F.count("_p").alias("n"))
        bad = bad.unionByName(n.filter("n <> 1").select("name", "date", F.concat(F.col("n").cast("string"), F.lit(" flyback rules match; there must be one")).alias("problem")))
    return bad


def plan(datasets: DataFrame, rules: DataFrame, output_template: str) -> DataFrame:
    """The selected rows with their flyback planes and output paths; nothing is written."""
    d = datasets.filter("process")
    out = F.replace(F.replace(F.lit(output_template), F.lit("{name}"), F.col("name")), F.lit("{date}"), F.col("date"))
    r = small(rules.withColumnRenamed("planes", "_p"))
    d = d.join(r, (F.col("planes") == F.col("_p")) & F.col("frame_rate").between(F.col("rate_lo"), F.col("rate_hi")), "left")
    usable = F.array_except(F.sequence(F.lit(0), F.col("planes") - 1), F.coalesce("flyback_planes", F.array().cast("array<int>")))
    return d.select(*datasets.columns, "flyback_planes", usable.alias("usable_planes"), (F.col("frame_rate") / F.col("planes")).alias("plane_rate"), out.alias("output"))
