"""Every registered query that has SQL gives the rows that DuckDB gives."""

import glob
import importlib.util
import os

import duckdb
import pytest

import __spark_entry__ as entry
from terraloom import queries as core


def plain(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, float):
        return f"{v + 0.0:.9g}"
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(plain(r[k]) for k in order) for r in data)


@pytest.fixture(scope="session")
def duck(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(name, spark, sf_dir, duck):
    got = core.QUERIES[name](spark, sf_dir)
    if name not in core.ORACLE_SQL:
        assert got.count() > 0
        return
    want = duck.execute(core.ORACLE_SQL[name])
    names = [x[0] for x in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_optional_part_is_not_needed(monkeypatch):
    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name in ("terraloom.llm", "corpus_pipeline") else real(name, *a))
    spec = importlib.util.spec_from_file_location("bare_entry", entry.__file__)
    bare = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(bare)
    assert set(bare.queries()) == set(core.QUERIES)
