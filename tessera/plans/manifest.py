"""Run manifests: what ran over which configuration, and whether it may run again."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "ds string, workflow string, state string, updated_at timestamp, config_sha256 string, config string, output string, error string, schema_version int"
STATES = ("running", "complete", "failed")
#: The states in the order in which a run can have them.
ORDER = ("running", "failed", "complete")


def canonical(config: dict) -> str:
    """One text for equal configurations: sorted keys, no spaces."""
    return json.dumps(config, sort_keys=True, separators=(",", ":"), default=str)


def digest(config: dict) -> str:
    return hashlib.sha256(canonical(config).encode()).hexdigest()


def record(spark: SparkSession, path: str, ds: str, workflow: str, state: str, config: dict, output: str, error: str | None = None) -> None:
    """Appends a state to the manifest table; Spark's commit makes the row appear whole or not at all."""
    if state not in STATES:
        raise ValueError(f"a run is one of {STATES}")
    row = spark.createDataFrame([(ds, workflow, state, digest(config), canonical(config), output, error, 1)], "ds string, workflow string, state string, config_sha256 string, config string, output string, error string, schema_version int")
    row.withColumn("updated_at", F.current_timestamp()).select(*[c.split()[0] for c in MANIFEST.split(", ")]).write.mode("append").parquet(path)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The last state of each data set and workflow; of equal times, that which comes later in a run."""
    return last_of(spark.read.schema(MANIFEST).parquet(path))


def last_of(m: DataFrame) -> DataFrame:
    """The last row of each data set and workflow of a table of manifests."""
    step = F.array_position(F.array(*[F.lit(s) for s in ORDER]), F.col("state"))
    last = m.groupBy("ds", "workflow").agg(F.max(F.struct("updated_at", step.alias("_step"), F.struct(*m.columns).alias("m"))).alias("last"))
    return last.select("last.m.*")


def may_run(last: dict | None, config: dict, workflow: str, overwrite: bool = False) -> str | None:
    """Why a run must not start over an existing output, or None if it may.

    A complete run, and one of another configuration, stand unless they are to be overwritten; an output of another
    workflow always stands.
    """
    if last is None:
        return None
    if last.get("workflow") != workflow:
        return "the output belongs to another workflow"
    if overwrite:
        return None
    if last.get("state") == "complete":
        return "the run is complete"
    if last.get("config_sha256") != digest(config):
        return "the output comes from another configuration"
    return None


def with_digest(m: DataFrame, config: str = "config", out: str = "config_sha256") -> DataFrame:
    """Manifests with the digest of their canonical configuration: what ``digest`` gives for it."""
    return m.withColumn(out, F.sha2(config, 256))


def summary_of(m: DataFrame) -> DataFrame:
    """How many data sets and workflows are in each state."""
    return last_of(m).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def summary(spark: SparkSession, path: str) -> DataFrame:
    return summary_of(spark.read.schema(MANIFEST).parquet(path))


def run_id() -> str:
    return uuid.uuid4().hex
