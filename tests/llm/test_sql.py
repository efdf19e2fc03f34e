"""Every operator's query with SQL gives the same rows in both engines."""

from __future__ import annotations

import pytest
from parity import same

from sievelight.llm import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(name, spark, data, duck):
    assert same(QUERIES[name](spark, data), duck, ORACLE_SQL[name])
