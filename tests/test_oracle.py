"""Registered queries against SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from checks import compare
from checks.oracle import ORACLE
from checks.queries import QUERIES

# The slower ones run in ``python -m checks.compare``.
SLOW = {
    "replay_lines", "incremental_refine", "backfill_window", "gold_upsert", "serving_snapshot",
    "metrics_mirror", "run_health", "run_metrics", "match_stats", "unmatched_report",
    "medicine_detail", "layer_roundtrip", "silver_upsert",
}


@pytest.fixture(scope="module")
def db(small):
    return compare.connect(small)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE and n not in SLOW])
def test_same_rows_as_sql(spark, small, db, name):
    _, found = compare.differences(spark, db, small, name)
    assert not found


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() == 80
