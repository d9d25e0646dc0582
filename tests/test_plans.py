"""Plan checks: pushdown / pruning reach the scan; no registered query pairs all rows."""

import pytest

import __spark_entry__ as E

from .conftest import SF_SMALL

QUERIES = E.queries()
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")
SKIP_HEAVY = {"e3_compare_detectors", "m2_random_forest", "m3_linear_svc", "m4_rbf_svm", "m5_poly_svm"}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_pushdown_and_pruning(spark):
    plan = _plan(QUERIES["s6_parquet_scan"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(value), GreaterThanOrEqual(value,0.0)]" in plan
    assert "ReadSchema: struct<event_id:bigint,event_type:string,value:double>" in plan


def test_flow_features_stay_jvm_side(spark):
    plan = _plan(QUERIES["p11_assemble_features"](spark, SF_SMALL))
    assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan and "MapInPandas" not in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint,l_linenumber:int," in plan


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SKIP_HEAVY))
def test_no_all_pairs_join(spark, name):
    plan = _plan(QUERIES[name](spark, SF_SMALL))
    for op in FORBIDDEN:
        assert op not in plan, f"{name} plans a {op}"


def test_broadcast_hint_only_below_the_row_limit(spark):
    from flowsentry.functions.scalars import broadcast_if_small

    big = spark.range(100).withColumnRenamed("id", "k")
    small = spark.range(5).withColumnRenamed("id", "k")
    hinted = big.join(broadcast_if_small(small, 5, limit=10), "k")
    plain = big.join(broadcast_if_small(small, 50, limit=10), "k")
    assert "broadcast" in hinted._jdf.queryExecution().analyzed().toString().lower()
    assert "broadcast" not in plain._jdf.queryExecution().analyzed().toString().lower()
