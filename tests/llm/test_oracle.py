"""Queries that SQL can express against their SQL, on whole tables."""

import pytest

from orderlens.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import SF
from tests.oracle_check import compare


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), SF, ORACLE_SQL[name]) is None
