import datetime
import glob
import math
import os

import duckdb
import pytest

from ductwise.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    rel = duck.sql(catalog.SQL[name])
    assert sorted(got.columns) == sorted(rel.columns)
    cols = sorted(rel.columns)
    mine = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=repr)
    other = sorted((tuple(plain(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    assert mine == other


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_every_order_is_a_tool_call(spark):
    out = catalog.QUERIES["tool_calls"](spark, SF).collect()
    assert len(out) == spark.read.parquet(f"{SF}/orders.parquet").count() == len({r.call_id for r in out})
    answered = {t: [r for r in out if r.tool == t and r["items"]] for t in catalog.tools.AGENT_TOOLS}
    assert {r.tool for r in out} == {*catalog.tools.AGENT_TOOLS, "no_such_tool"}
    assert all(answered[t] for t in ("get_system_overview", "get_node_children", "get_node_sensors", "get_related_systems", "diagnose_node"))
    assert all(len(r["items"]) == 1 for r in answered["diagnose_node"])
    assert {r.status for r in out if r.tool == "no_such_tool"} == {"error"}
