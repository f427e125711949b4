import json

import pytest
from pyspark.sql import functions as F

from tessera.plans import manifest, run


def test_one_failure_stops_no_other(spark, tmp_path):
    done, m = [], str(tmp_path / "m")

    def job(spark, d, target):
        if d["ds"] == "b":
            raise ValueError("no frames")
        done.append(target)

    sets = [{"ds": x, "output": f"/out/{x}"} for x in "abc"]
    states = run.run_all(spark, sets, "w", job, m)
    assert states == {"a": "complete", "b": "failed", "c": "complete"} and done == ["/out/a", "/out/c"]
    assert run.exit_code(states) == run.FAILED and run.exit_code({"a": "complete"}) == run.DONE
    assert {r.ds: r.error for r in manifest.latest(spark, m).collect()} == {"a": None, "b": "ValueError: no frames", "c": None}
    # What is complete stands, what failed may run again, and overwriting runs all.
    assert run.run_all(spark, sets, "w", lambda *_: None, m) == {"a": "refused", "b": "complete", "c": "refused"}
    assert set(run.run_all(spark, sets, "w", lambda *_: None, m, overwrite=True).values()) == {"complete"}
    assert run.run_all(spark, sets, "other", lambda *_: None, m, overwrite=True)["a"] == "refused"


def test_cached_tables_go_by_their_inputs(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return spark.range(3)

    for inputs in ({"n": 1}, {"n": 1}, {"n": 2}):
        assert run.cached(spark, str(tmp_path), "t", inputs, build).count() == 3
    assert len(made) == 2


def test_save_replaces_only_its_data_sets(spark, tmp_path):
    path = str(tmp_path / "out")
    d = spark.range(4).withColumn("ds", F.when(F.col("id") < 2, "a").otherwise("b"))
    run.save(d, path)
    run.save(d.filter("ds = 'a'").withColumn("id", F.col("id") + 10), path)
    assert {(r.ds, r.id) for r in spark.read.parquet(path).collect()} == {("a", 10), ("a", 11), ("b", 2), ("b", 3)}


def test_command(spark, sf, tmp_path):
    config, m, out = tmp_path / "c.json", str(tmp_path / "m"), str(tmp_path / "out")
    one = {"ds": "d", "query": "median_and_iqr", "tables": sf, "output": out}
    config.write_text(json.dumps([one]))
    assert run.main([str(config), "--manifests", m, "--check"]) == run.DONE
    assert run.main([str(config), "--manifests", m], spark) == run.DONE and spark.read.parquet(out).count() > 0
    assert run.main([str(config), "--manifests", m], spark) == run.FAILED
    for bad in ([{"ds": "d"}], [one | {"query": "none"}], [one, one]):
        config.write_text(json.dumps(bad))
        assert run.main([str(config), "--manifests", m], spark) == run.USAGE
    assert run.main([str(tmp_path / "no.json"), "--manifests", m], spark) == run.USAGE
    with pytest.raises(SystemExit):
        run.main([])
