import importlib.util
import re

import __spark_entry__ as entry


def test_registry():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and "p4_found" in queries
    assert (importlib.util.find_spec("passagework.llm") is not None) == ("p1_found" in queries)


def test_plans_push_columns_and_join_without_cartesian(spark):
    df = entry.queries()["file_listing"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    scans = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert scans and all("content" not in s for s in scans)
