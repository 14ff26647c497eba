import datetime
import math

import duckdb
import pytest

import __spark_entry__ as entry
from nearfield import registry, registry_contracts  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    from pathlib import Path

    con = duckdb.connect()
    for t in TABLES:
        path = Path(f"{sf_dir}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda v: round(v, 9) + 0.0 if isinstance(v, float) and math.isfinite(v) else v.isoformat() if isinstance(v, datetime.datetime) else v
    return sorted(columns), sorted((tuple(plain(r[k]) for k in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_its_sql(spark, sf_dir, duck, name):
    if name not in entry.oracle_sql():
        if name in registry.QUERIES:
            assert entry.queries()[name](spark, sf_dir).count() > 0
        return
    got = entry.queries()[name](spark, sf_dir)
    want = duck.sql(entry.oracle_sql()[name])
    assert rows(got.columns, map(tuple, got.collect())) == rows(want.columns, want.fetchall())


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["query_id", "rank", "id", "score"] and out.count() == 50
