"""The test tables in the roles the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators.relational import look_up, project
from tablewright.sources.parquet import scan

WAREHOUSE = "local"
TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def sales_orders(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    """``order_id, customer, amount`` and any further columns of the order."""
    orders = scan(spark, folder, "orders").withColumnRenamed("o_custkey", "c_custkey")
    customers = scan(spark, folder, "customer").select("c_custkey", "c_name")
    return project(
        look_up(orders, customers, "c_custkey"),
        ["o_orderkey", "c_name", "o_totalprice", *more],
        {"o_orderkey": "order_id", "c_name": "customer", "o_totalprice": "amount"},
    )


def nation_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Each nation as a table below its region: ``n_nationkey, n_name, namespace, table_path``."""
    region = scan(spark, folder, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    namespace = F.concat_ws(".", F.lit(WAREHOUSE), F.col("r_name"))
    return (
        look_up(scan(spark, folder, "nation"), region, "n_regionkey")
        .withColumn("namespace", namespace)
        .withColumn("table_path", F.concat_ws(".", "namespace", "n_name"))
        .select("n_nationkey", "n_name", "r_name", "namespace", "table_path")
    )


def nation_grants(spark: SparkSession, folder: str) -> DataFrame:
    """A group per nation: every fifth may modify its region, the others read their own table."""
    wide = F.col("n_nationkey") % 5 == 0
    return nation_tables(spark, folder).select(
        F.col("n_name").alias("group_name"),
        F.when(wide, "namespace").otherwise("table").alias("resource_type"),
        F.when(wide, F.col("namespace")).otherwise(F.col("table_path")).alias("resource_path"),
        F.when(wide, "modify").otherwise("select").alias("permission"),
    )


def misplaced_grants(spark: SparkSession, folder: str) -> DataFrame:
    """Grants that name each region as a table, which it is not: they reach nothing."""
    return nation_tables(spark, folder).select(
        F.col("n_name").alias("group_name"),
        F.lit("table").alias("resource_type"),
        F.col("namespace").alias("resource_path"),
        F.lit("modify").alias("permission"),
    )


def customer_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as members of their nation's group: ``group_name, kind, principal``."""
    nation = scan(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return look_up(scan(spark, folder, "customer"), nation, "c_nationkey").select(
        F.col("n_name").alias("group_name"), F.lit("email").alias("kind"), F.col("c_custkey").alias("principal")
    )


def group_declarations(spark: SparkSession, folder: str) -> DataFrame:
    """Group declarations, one per customer, repeated names to be merged.

    Customers in debt stand for service accounts, the others for people.
    """
    nation = scan(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    owing = F.col("c_acctbal") < 0
    listed = F.array(F.concat(F.lower("c_name"), F.lit("@company.com")))
    return look_up(scan(spark, folder, "customer"), nation, "c_nationkey").select(
        F.col("n_name").alias("name"),
        F.lit("Customers of one nation").alias("description"),
        F.when(~owing, listed).otherwise(F.array().cast("array<string>")).alias("members"),
        F.when(owing, F.array("c_name")).alias("service_accounts"),
    )
