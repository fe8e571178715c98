"""Every registered query against its DuckDB oracle on the sf0.001 tables."""

import pytest

import __spark_entry__ as E
from tests.oracle_check import check

NAMES = sorted(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, sf_small, name):
    rec = check(spark, sf_small, [name])[name]
    assert rec.get("error") is None, rec
    if name in E.oracle_sql():
        assert rec["ok"], rec
    else:
        assert rec["rows"] > 0
