"""The resolvers over parts in many copies: results of the twin, and pairs of what differs only."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.compare import difference
from tidemark.plans import registry, resolve_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def copied(spark, tmp_path_factory):
    """Parts of the smallest table in copies under new numbers, one number twice, and parts without a name, size or number."""
    part, paths = spark.read.parquet(f"{SF}/part.parquet"), {}
    for copies in (3, 6):
        rows = part.crossJoin(spark.range(copies).withColumnRenamed("id", "copy")).withColumn("p_partkey", F.expr("p_partkey + copy * 1100")).drop("copy")
        odd = part.limit(9).selectExpr("CASE WHEN p_partkey % 3 = 0 THEN 0 WHEN p_partkey % 3 = 1 THEN 100 END AS p_partkey", "CASE WHEN p_partkey > 2 THEN p_name END AS p_name", "p_brand", "p_type", "CASE WHEN p_partkey < 6 THEN p_size END AS p_size", "p_retailprice")
        paths[copies] = str(tmp_path_factory.mktemp(f"copies{copies}"))
        rows.unionByName(odd).unionByName(part.limit(1).withColumn("p_partkey", F.lit(200).cast("long"))).write.parquet(f"{paths[copies]}/part.parquet")
    return paths


@pytest.mark.parametrize("name", ["q_resolve_chain", "q_resolve_strict"])
def test_resolvers_over_copies(spark, copied, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{copied[3]}/part.parquet/*.parquet')")
    assert difference(registry.QUERIES[name](spark, copied[3]), con, registry.ORACLES[name]) == ""


def test_copies_add_no_pairs_to_the_resolver(spark, copied):
    """Parts that look the same to the matchers meet once, however many they are."""
    few, many = (resolve_queries.candidates(*resolve_queries.kinds_of(spark, copied[n]), 0.82).select("l_kind", "c_kind").distinct().count() for n in (3, 6))
    assert 0 < many == few
