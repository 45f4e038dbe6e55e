"""Every query of the library against its DuckDB twin, on the smallest tables."""

import math

import duckdb
import pytest

from threadloom.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cells(rows):
    flat = lambda v: ("", "") if v is None else ("n", round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) else ("s", str(v))
    return sorted(tuple(flat(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_duckdb(spark, name):
    db = duckdb.connect()
    db.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = db.sql(catalog.oracle_sql()[name])
    got = catalog.queries()[name](spark, DIR)
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(want.columns)
    rows = cells(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert cells(got.select(*columns).collect()) == rows


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs_without_a_twin(spark, name):
    """State machines, greedy choices over vectors and nested trees; test_library has them against plain Python."""
    assert catalog.queries()[name](spark, DIR).count() > 0


def test_every_twin_belongs_to_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries()) and len(catalog.queries()) > 130
