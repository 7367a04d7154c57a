"""The driver's star schema seen as a property graph: nodes(id, label, entity_type, description, project) and edges(src, dst, relationship, weight)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of sales that a task sums, about.
PAIRS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node_id(kind: str, key: str):
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(name: str, key: str, label: str, detail: str):
        return table(spark, sf_dir, name).select(node_id(name, key).alias("id"), F.col(label).alias("label"), F.lit(name.upper()).alias("entity_type"), F.concat(F.lit(f"{name} "), F.col(label), F.lit(" "), F.col(detail).cast("string")).alias("description"))

    parts = [of("region", "r_regionkey", "r_name", "r_regionkey"), of("nation", "n_nationkey", "n_name", "n_regionkey"), of("supplier", "s_suppkey", "s_name", "s_nationkey"), of("customer", "c_custkey", "c_name", "c_mktsegment"), of("part", "p_partkey", "p_name", "p_brand")]
    return reduce(DataFrame.unionByName, parts)


def geo_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places alone: nation to region, supplier and customer to nation."""

    def of(name: str, key: str, other: str, other_key: str, relationship: str):
        return table(spark, sf_dir, name).select(node_id(name, key).alias("src"), node_id(other, other_key).alias("dst"), F.lit(relationship).alias("relationship"), F.lit(1.0).alias("weight"))

    parts = [of("nation", "n_nationkey", "region", "n_regionkey", "PART_OF"), of("supplier", "s_suppkey", "nation", "s_nationkey", "LOCATED_IN"), of("customer", "c_custkey", "nation", "c_nationkey", "LOCATED_IN")]
    return reduce(DataFrame.unionByName, parts)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places, and which supplier stocks a part (weight: the quantity sold)."""
    rows = table(spark, sf_dir, "lineitem")
    # Nearly all pairs are different, so they are dealt before they are summed, to as many tasks as keep a task's table small, however long the table is.
    parts = rows.count() // PAIRS + 1
    lines = rows.repartition(parts, "l_partkey", "l_suppkey").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("weight"))
    stocked = lines.select(node_id("part", "l_partkey").alias("src"), node_id("supplier", "l_suppkey").alias("dst"), F.lit("STOCKED_BY").alias("relationship"), "weight")
    return geo_edges(spark, sf_dir).unionByName(stocked)


#: The same relations in SQL, to begin a WITH clause.
SQL_GEO = """geo AS (
  SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst, 'PART_OF' AS relationship, CAST(1 AS DOUBLE) AS weight FROM nation
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'LOCATED_IN', CAST(1 AS DOUBLE) FROM supplier
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'LOCATED_IN', CAST(1 AS DOUBLE) FROM customer)"""
SQL_EDGES = (
    SQL_GEO
    + """, edges AS (
  SELECT * FROM geo UNION ALL
  SELECT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'STOCKED_BY', sum(l_quantity) FROM lineitem GROUP BY l_partkey, l_suppkey)"""
)
SQL_NODES = """nodes AS (
  SELECT 'region:' || r_regionkey AS id, r_name AS label, 'REGION' AS entity_type, 'region ' || r_name || ' ' || r_regionkey AS description FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'NATION', 'nation ' || n_name || ' ' || n_regionkey FROM nation
  UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'SUPPLIER', 'supplier ' || s_name || ' ' || s_nationkey FROM supplier
  UNION ALL SELECT 'customer:' || c_custkey, c_name, 'CUSTOMER', 'customer ' || c_name || ' ' || c_mktsegment FROM customer
  UNION ALL SELECT 'part:' || p_partkey, p_name, 'PART', 'part ' || p_name || ' ' || p_brand FROM part)"""
