"""Plan properties: column pruning and filter pushdown reach the parquet scans."""

import re

from conftest import SF001

import __spark_entry__ as se


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_needed_columns(spark):
    plan = _plan(se.queries()["impute_mean"](spark, SF001))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas, plan
    for s in schemas:
        cols = {c.split(":")[0] for c in s.split(",")}
        assert cols <= {"o_custkey", "o_totalprice", "o_orderdate", "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"}, s
    orders = [s for s in schemas if "o_custkey" in s]
    assert orders and all("o_orderstatus" not in s and "o_orderpriority" not in s for s in orders)
    assert "IsNotNull(o_custkey)" in plan


def test_key_only_query_prunes_the_orders_join(spark):
    # the hold-out needs only the customer key: Catalyst removes the orders aggregation entirely
    plan = _plan(se.queries()["holdout"](spark, SF001))
    assert "o_custkey" not in plan
