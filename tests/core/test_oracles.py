"""Every query of the engine against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tessera.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no generated tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(rows):
    def value(v):
        return None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 7) if isinstance(v, float) else v

    return sorted((tuple(value(v) for v in r) for r in rows), key=lambda r: tuple((v is not None, str(type(v)), v) for v in r))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    found = duck.execute(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({registry.oracle_sql()[name]})").fetchall()
    assert plain(tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()) == plain(found)


def test_flagship(spark):
    df = registry.flagship(spark, DATA)
    assert {"game", "delta", "n_pairs", "tp", "f1"} <= set(df.columns) and df.count() > 0
