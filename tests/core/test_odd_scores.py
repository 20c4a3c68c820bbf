"""Queries over scores outside of (0, 1), where margins are infinite, NaN or null, against their SQL in DuckDB."""

import datetime

import duckdb
import pytest

from tessera.plans import registry

QUERIES = ["confusion_with_subtypes", "group_rows_union", "loss_summary", "pairwise_rank_penalty", "subtype_negative_counts", "tail_ohem"]


@pytest.mark.parametrize("odd", [0.0, 500.0, 560.21, None])
@pytest.mark.parametrize("name", QUERIES)
def test_equals_sql(spark, tmp_path, name, odd):
    kinds, values = ["click", "purchase", "view", "signup"], [odd, odd, 12.5, 480.0, 471.0, 3.0, 250.0, 499.0]
    rows = [(i, datetime.datetime(2024, 1, 1), i % 3, kinds[i % 4], v, "") for i, v in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    found = registry.queries()[name](spark, str(tmp_path))
    columns = sorted(found.columns)
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    wanted = con.execute(f"select {', '.join(columns)} from ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, wanted)) == sorted(repr(tuple(r)) for r in found.select(*columns).collect())
