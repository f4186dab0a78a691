"""The queries of the subpackage llm run, and those with SQL give its rows."""

from __future__ import annotations

import pytest

import plaza.llm as llm
from plaza.registry import Registry

REG = Registry()
llm.register(REG)


@pytest.mark.parametrize("name", sorted(REG.sql))
def test_query_matches_sql(name, matches_sql):
    matches_sql(REG.queries[name], REG.sql[name])


@pytest.mark.parametrize("name", sorted(set(REG.queries) - set(REG.sql)))
def test_query_runs(name, spark):
    assert REG.queries[name](spark, "/root/testdata/sf0.001").count() > 0
