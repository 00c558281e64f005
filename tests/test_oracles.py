"""Every registered query runs; those with SQL equal DuckDB's answer."""

import re

import pytest
from conftest import SMALL

import __spark_entry__ as entry
from tools.check import compare, duck

# Queries on training text have tests of their own.
TEXT = re.compile(r"op\d+_|pipeline$")
QUERIES = {q: f for q, f in entry.queries().items() if not TEXT.match(q)}
ORACLES = {q: s for q, s in entry.oracle_sql().items() if not TEXT.match(q)}


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_names():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    ok, text, _ = compare(spark, con, name, QUERIES[name], ORACLES[name], SMALL)
    assert ok, text


# Fits of whole models; the invariants of the rest are in the other tests.
QUICK = [
    "r2_random_rows", "r6_train_test_split", "r8_folds", "r9_bootstrap", "m7_decision_tree",
    "m25_importances", "a1_isolation_forest", "z1_forecast", "c1_kmeans",
]


@pytest.mark.parametrize("name", QUICK)
def test_runs(spark, con, name):
    ok, text, _ = compare(spark, con, name, QUERIES[name], None, SMALL)
    assert ok and text != "rows only: 0"


def test_entry(spark):
    assert entry.entry(spark).count() > 0
