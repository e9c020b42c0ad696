"""Every registered query against its DuckDB oracle on the smallest tables."""

import pytest

import __spark_entry__ as E
import revlens.plans  # noqa: F401  (fills the registry)
from revlens.plans.registry import REGISTRY
from tests.conftest import SF_SMALL
from tools.oracle_check import compare, duck

SQL_KEYS = sorted(k for k, q in REGISTRY.items() if q.sql is not None)


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("key", SQL_KEYS)
def test_matches_oracle(spark, con, key):
    r = compare(spark, con, REGISTRY[key], SF_SMALL)
    assert r["ok"], r


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["dataset_name", "rating", "n_reviews", "avg_tokens", "n_entities", "max_tokens"]


def test_every_sql_key_is_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
