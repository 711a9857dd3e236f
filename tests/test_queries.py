"""Every registered query runs, and those with SQL match it."""

from __future__ import annotations

import importlib.util

import pytest
from oracle import assert_same

import __spark_entry__ as entry
from larkspur.plans import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert_same(QUERIES[name](spark, FOLDER), ORACLES[name], FOLDER)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_names_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_optional_queries_follow_the_subpackage():
    present = importlib.util.find_spec("larkspur.llm") is not None
    assert any(k.startswith("op1_") for k in entry.queries()) == present
