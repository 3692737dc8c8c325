"""Every registered query of the library runs, and equals its oracle, on the smallest tables."""

import duckdb
import pytest

from gramloom.plans import catalog, files

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", list(catalog.QUERIES if files else ()))
def test_query(spark, sf, oracle, name):
    got = catalog.QUERIES[name](spark, sf).toPandas()
    columns = sorted(got.columns)
    if name not in catalog.ORACLES:
        assert len(got)
        for flag in ("exact", "revealed"):
            if flag in columns:
                assert got[flag].dropna().mean() > 0.95
        return
    want = oracle.execute(catalog.ORACLES[name]).df()
    assert columns == sorted(want.columns)
    one, two = (sorted(tuple(map(plain, r)) for r in df[columns].itertuples(index=False, name=None)) for df in (got, want))
    assert one == two


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
