import pytest

from tessera.plans import manifest, validate


def test_manifest_states(spark, tmp_path):
    path = str(tmp_path / "m")
    config = {"b": 1, "a": [1, 2]}
    manifest.record(spark, path, "d1", "best-plane", "running", config, "out")
    manifest.record(spark, path, "d1", "best-plane", "complete", config, "out")
    manifest.record(spark, path, "d2", "best-plane", "failed", config, "out", "no file")
    last = {r.ds: r.asDict() for r in manifest.latest(spark, path).collect()}
    assert last["d1"]["state"] == "complete" and last["d2"]["error"] == "no file"
    assert {r.state: r.n for r in manifest.summary(spark, path).collect()} == {"complete": 1, "failed": 1}
    assert manifest.may_run(None, config, "best-plane") is None
    assert manifest.may_run(last["d1"], config, "best-plane") and manifest.may_run(last["d1"], config, "best-plane", overwrite=True) is None
    assert manifest.may_run(last["d2"], config, "best-plane") is None
    assert manifest.may_run(last["d2"], {"a": 2}, "best-plane") and manifest.may_run(last["d1"], config, "other", overwrite=True)
    assert manifest.digest({"a": [1, 2], "b": 1}) == manifest.digest(config)
    with pytest.raises(ValueError):
        manifest.record(spark, path, "d", "w", "odd", {}, "")


def test_values():
    assert validate.boolean(" TRUE ", "x") and not validate.boolean(False, "x")
    assert validate.number(5, "x", 0, 10, whole=True) == 5
    for bad in (True, "5 / 400", "5", float("nan"), None, 11):
        with pytest.raises(ValueError):
            validate.number(bad, "x", 0, 10)
    assert validate.template("{a}/{b}", {"a", "b"}, {"a"})
    for bad in ("{c}", "{b}"):
        with pytest.raises(ValueError):
            validate.template(bad, {"a", "b"}, {"a"})
    with pytest.raises(ValueError):
        validate.require({"a": 1}, ("a", "b"))


def test_violations_and_plan(spark):
    rows = [("A", "d", True, ["1"], 4, 30.0, 0.0), ("B", "d", True, [], 0, 30.0, 0.0), ("C", "d", True, ["1"], 4, 300.0, 0.0), ("D", "", False, [], 0, 0.0, 0.0)]
    d = spark.createDataFrame(rows, "name string, date string, process boolean, experiments array<string>, planes int, frame_rate double, depth double")
    rules = spark.createDataFrame([(4, 20.0, 40.0, [0])], "planes int, rate_lo double, rate_hi double, flyback_planes array<int>")
    bad = {(r.name, r.problem) for r in validate.violations(d, rules).collect()}
    assert not any(n in ("A", "D") for n, _ in bad) and ("B", "no experiments") in bad and any(n == "C" for n, _ in bad)
    p = validate.plan(d.filter("name = 'A'"), rules, "/out/{name}/{date}").first()
    assert p.output == "/out/A/d" and p.usable_planes == [1, 2, 3] and p.plane_rate == 7.5
