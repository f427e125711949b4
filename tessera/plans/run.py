"""Runs a job for each data set: one that fails stops no other, results are kept by the fingerprint of what made them."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

from . import manifest

LOG = logging.getLogger(__name__)
#: What a command ends with: all went well, some data set failed, the request itself was wrong.
DONE, FAILED, USAGE = 0, 1, 2

Job = Callable[[SparkSession, Mapping, str], None]


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a written table is complete at a path of any file system that Spark knows."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def cached(spark: SparkSession, root: str, name: str, inputs: Mapping, build: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``build`` makes of ``inputs``, read if it was written before from the same inputs.

    ``inputs`` are the parameters and what identifies the sources (paths with times or digests); other inputs make another
    table. A table whose writing broke off has no mark of success and is made again.
    """
    path = f"{root}/{name}-{manifest.digest(dict(inputs))[:16]}"
    if not exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save(df: DataFrame, path: str, keys: Iterable[str] = ("ds",)) -> None:
    """Replaces the partitions (data sets) that df has; those of other data sets stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def save_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def run_all(spark: SparkSession, datasets: Iterable[Mapping], workflow: str, job: Job, manifests: str, overwrite: bool = False) -> dict[str, str]:
    """The state of each data set after its job: complete, failed or refused.

    A data set is a mapping with ``ds``, ``output`` and its configuration; a list of data sets is a table of the driver, never the data.
    Every state goes to the manifest table; an output that may not be replaced is refused before its job begins.
    """
    last = {}
    try:
        if exists(spark, manifests):
            last = {r.output: r.asDict() for r in manifest.latest(spark, manifests).orderBy("updated_at").collect()}
    except Exception:  # What ran before is not known: nothing may be replaced, and nothing can be recorded.
        LOG.exception("the manifests at %s cannot be read", manifests)
        return {str(d["ds"]): "refused" for d in datasets}
    out = {}
    for d in datasets:
        ds, target = str(d["ds"]), str(d["output"])
        why = manifest.may_run(last.get(target), dict(d), workflow, overwrite)
        if why:
            LOG.error("%s: %s", ds, why)
            out[ds] = "refused"
            continue
        manifest.record(spark, manifests, ds, workflow, "running", dict(d), target)
        try:
            job(spark, d, target)
        except Exception as e:  # One data set's fault is that data set's alone.
            LOG.exception("%s failed", ds)
            manifest.record(spark, manifests, ds, workflow, "failed", dict(d), target, f"{type(e).__name__}: {e}"[:1000])
            out[ds] = "failed"
        else:
            manifest.record(spark, manifests, ds, workflow, "complete", dict(d), target)
            out[ds] = "complete"
    return out


def exit_code(states: Mapping[str, str]) -> int:
    return DONE if all(s == "complete" for s in states.values()) else FAILED


def query_job(spark: SparkSession, d: Mapping, target: str) -> None:
    """Writes a catalogued query over a folder of tables."""
    from .catalogue import queries

    queries()[d["query"]](spark, d["tables"]).write.mode("overwrite").parquet(target)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """``run CONFIG --manifests PATH [--overwrite] [--check]``; CONFIG is a JSON list of data sets.

    Each has ds, tables and output, and a job: "query" (if none is named) with a query, "register" with shape and count, or "correct" with
    planes, f0_percentile and f0_window.
    """
    from .catalogue import queries
    from .jobs import correct_job, register_job
    from .validate import require

    jobs = {"query": (query_job, ("query",)), "register": (register_job, ("shape", "count")), "correct": (correct_job, ("planes", "f0_percentile", "f0_window"))}

    parser = argparse.ArgumentParser(prog="tessera", description="Runs queries for each data set of a configuration.")
    parser.add_argument("config")
    parser.add_argument("--manifests", required=True)
    parser.add_argument("--overwrite", action="store_true")
    parser.add_argument("--check", action="store_true", help="only say what is wrong with the configuration")
    a = parser.parse_args(argv)
    try:
        with open(a.config, encoding="utf-8") as f:
            datasets = json.load(f)
        for d in datasets:
            if d.get("job", "query") not in jobs:
                raise ValueError(f"there is no job {d['job']}")
            require(d, ("ds", "tables", "output", *jobs[d.get("job", "query")][1]))
            if "query" in d and d["query"] not in queries():
                raise ValueError(f"there is no query {d['query']}")
        names = [d["output"] for d in datasets]
        if len(names) != len(set(names)):
            raise ValueError("two data sets have one output")
    except (OSError, ValueError, TypeError) as e:
        print(f"{a.config}: {e}", file=sys.stderr)
        return USAGE
    if a.check:
        return DONE
    states = {}
    for name, (job, _) in jobs.items():
        own = [d for d in datasets if d.get("job", "query") == name]
        if own:
            states |= run_all(spark or SparkSession.builder.getOrCreate(), own, name, job, a.manifests, a.overwrite)
    for ds, state in states.items():
        print(f"{ds}\t{state}")
    return exit_code(states)


if __name__ == "__main__":
    sys.exit(main())
