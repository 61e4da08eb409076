"""Every query against its DuckDB oracle on the smallest tables."""

import duckdb
import pytest

from citeforge.plans import catalogue, composed, published, records, registry, stored  # noqa: F401 (all but registry register)

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def key(row):
    return tuple((x is not None, str(type(x)), 0 if x is None else x) for x in row)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_oracle(name, spark, con):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(cols).collect()), key=key)
    found = con.execute(registry.ORACLES[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(r[names.index(c)] for c in cols) for r in found.fetchall()), key=key)
    assert got
