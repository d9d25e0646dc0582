"""Every value-checked query against its SQL oracle on the smallest tables (sf0.001)."""

import pytest

import __spark_entry__ as E
from tools.check_oracle import compare

from .conftest import SF_SMALL

ORACLE = E.oracle_sql()
QUERIES = E.queries()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    status, n, _, msg = compare(spark, duck, name, QUERIES[name], ORACLE[name], SF_SMALL)
    assert status == "ok", msg


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and set(df.columns) >= {"threshold", "f1", "auc"}


def test_every_query_has_a_callable_and_oracle_keys_subset():
    assert set(ORACLE) <= set(QUERIES)
    assert len(QUERIES) >= 70
