"""Every query that SQL can express against DuckDB, row for row."""

import duckdb
import pytest

from kspec.plans.catalog import Q
from kspec.plans.oracle import ORACLES

TABLES = ("documents", "benchmark")


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rounded(row):
    return tuple(float(f"{x:.9g}") if isinstance(x, float) else x for x in row)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(name, spark, sf_dir, duck):
    df = Q[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((rounded(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=str)
    want = duck.execute("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({ORACLES[name]})").fetchall()
    assert got == sorted((rounded(r) for r in want), key=str)
    assert want or name == "matrix_peaks"


def test_all_queries_run(spark, sf_dir):
    for name in sorted(set(Q) - set(ORACLES)):
        assert Q[name](spark, sf_dir).count() >= 1
