"""Every query of the core that has SQL gives the rows of its SQL."""

from __future__ import annotations

import importlib

import pytest

import __spark_entry__ as entry
from plaza.registry import Registry

REG = Registry()
for _name in entry.PLANS:
    importlib.import_module(f"plaza.plans.{_name}").register(REG)


@pytest.mark.parametrize("name", sorted(REG.sql))
def test_query_matches_sql(name, matches_sql):
    matches_sql(REG.queries[name], REG.sql[name])


@pytest.mark.parametrize("name", sorted(set(REG.queries) - set(REG.sql)))
def test_query_runs(name, spark):
    df = REG.queries[name](spark, "/root/testdata/sf0.001")
    assert df.columns and df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
