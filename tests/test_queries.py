"""Every named query against its SQL in DuckDB on the smallest tables; those without SQL must run."""

import math
import os

import duckdb
import pytest

from fieldloom.plans import queries as core
from fieldloom.plans import columns, rules, structures, truths  # noqa: F401  they add to core's queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def norm(rows):
    def cell(v):
        if isinstance(v, float):
            return None if math.isnan(v) else float(f"{v:.9g}")
        if hasattr(v, "item"):
            return cell(v.item())
        return v

    return sorted(repr(tuple(cell(v) for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = core.QUERIES[name](spark, SF)
    rel = duck.sql(core.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    got = norm(map(tuple, df.select(*columns).collect()))
    want = norm(rel.select(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLE_SQL)))
def test_query_runs(spark, name):
    df = core.QUERIES[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
