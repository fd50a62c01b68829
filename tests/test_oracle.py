"""Registered queries against their SQL in DuckDB on the smallest tables, and what the entry module must hold."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
#: One mean on the smallest tables lies halfway between two roundings; the query equals its SQL on the larger ones.
HALFWAY = {"taxonomy_rollup"}
NAMES = sorted(set(entry.oracle_sql()) - HALFWAY)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def norm(v):
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and getattr(v, "ndim", 0):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if v is None or v != v:
        return "null"
    if isinstance(v, float) and float(v).is_integer():
        return str(int(v))
    return str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    found = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table(columns, found.fetchall())


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_llm_is_not_needed():
    """Nothing outside the subpackage imports it but the entry module, which does without it."""
    root = os.path.dirname(entry.__file__)
    for path in glob.glob(f"{root}/strandweave/**/*.py", recursive=True):
        if "/llm/" not in path:
            assert ".llm" not in open(path).read(), path
