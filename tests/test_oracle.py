"""Every catalogued query against its DuckDB form on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__
from tessera.plans import catalogue


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: None if v is None or v != v else round(float(v), 5) if isinstance(v, float) else v
    return sorted((tuple(clean(r[i]) for i in order) for r in records), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sf, duck, name):
    df = catalogue.queries()[name](spark, sf)
    got = rows(df.columns, df.collect())
    assert len(df.columns) == len(set(df.columns))
    if name in catalogue.oracle_sql():
        want = duck.sql(catalogue.oracle_sql()[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert got == rows(want.columns, want.fetchall())


def test_every_frame_is_registered(spark, sf):
    every = {r.frame for r in catalogue.frames(spark, sf).collect()}
    got = catalogue.queries()["frame_registration"](spark, sf).select("frame", "ref").collect()
    assert max(every) >= 400 and {(r.frame, r.ref) for r in got} == {(f, k) for f in every for k in range(4)}


def test_initial_reference_takes_every_frame(spark, sf):
    planes = {}
    for r in catalogue.frames(spark, sf).orderBy("frame").collect():
        planes.setdefault(r.plane, []).append(np.array([np.float32(v) * 1000 for v in r.px], dtype=float))
    got = {}
    for r in catalogue.queries()["initial_reference"](spark, sf).orderBy("i").collect():
        got.setdefault(r.plane, []).append(r.v)
    for plane, px in planes.items():
        c, n = np.corrcoef(px), min(20, len(px))
        seed = np.argmax(np.sort(c, axis=1)[:, ::-1][:, 1:n].mean(axis=1))
        x = np.array(px) - np.mean(px, axis=1, keepdims=True)
        mean = x[np.argsort(-c[seed], kind="stable")[:n]].mean(axis=0)
        assert len(got[plane]) == len(mean) and np.all(np.abs(got[plane] - mean) < 1.001)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
