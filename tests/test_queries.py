"""Every registered query against its SQL on the smallest tables. Streaming and file queries included."""

import duckdb
import pytest

from check import rows
from logquarry.bridge import TABLES
from logquarry.plans import load
from tests.conftest import SMALL

PLANS = load()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    return con


@pytest.mark.parametrize("key", list(PLANS))
def test_query(bridge, sql, key):
    df = PLANS[key].run(bridge)
    got = rows(df.columns, df.collect())
    if PLANS[key].sql is None:
        assert got
        return
    result = sql.sql(PLANS[key].sql)
    assert sorted(result.columns) == sorted(df.columns)
    assert got == rows(result.columns, result.fetchall())


STORES = ("stream", "ingest_rate_stream", "alert_gate", "record_alert_events", "export", "append_events", "index_chunks", "route_per_sender")


@pytest.mark.parametrize("key", [k for k in PLANS if not k.startswith(STORES)])
def test_no_query_pairs_every_row_with_every_row(bridge, key):
    plan = PLANS[key].run(bridge)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
