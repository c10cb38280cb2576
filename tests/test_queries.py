"""Every query against its SQL twin on the smallest tables; streams and other queries without SQL have tests of their own."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.compare import database, difference
from tidemark.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_twin(spark, con, name):
    assert difference(registry.QUERIES[name](spark, SF), con, registry.ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).columns


@pytest.mark.parametrize("name", ["q_resolve_chain_whole", "q_resolve_strict_whole"])
def test_resolvers_ask_all_products(spark, name):
    """Every 100th part asks, products of odd and even numbers answer, none answers itself."""
    got = registry.QUERIES[name](spark, "/root/testdata/sf0.1").collect()
    assert got and all(r["listing_id"] % 100 == 0 and r["product_id"] != r["listing_id"] for r in got)
    assert {r["product_id"] % 2 for r in got} == {0, 1}


def test_blocked_resolver_asks_all_rows(spark):
    got = registry.QUERIES["q_resolve_blocked_whole"](spark, "/root/testdata/sf0.1").collect()
    assert len(got) == 20 and all(r["vec_id"] % 100 == 0 and r["product_id"] != r["vec_id"] for r in got)
    assert {r["product_id"] % 2 for r in got} == {0, 1}


def test_alerts_reach_all_customers(spark):
    got = registry.QUERIES["q_alert_match_whole"](spark, SF).select("user_id").distinct().collect()
    assert {r["user_id"] % 2 for r in got} == {0, 1}


def test_alerts_are_shared_among_tasks(spark):
    """Small tables and few buckets of ROI leave no task with most of the pairs."""
    found = registry.QUERIES["q_alert_match"](spark, "/root/testdata/sf0.01").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in found) < 0.3 * sum(r["count"] for r in found)
