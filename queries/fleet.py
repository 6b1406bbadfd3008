"""A fleet seen through the driver's tables.

Customers stand for clusters, orders for role groups, nodes and files, nations for authentication
classes. Each frame has a twin in SQL text, so the oracles do not depend on the Spark code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queries.registry import spread, table


def clusters(spark: SparkSession, sf: str) -> DataFrame:
    balance, nation = F.col("c_acctbal"), F.col("c_nationkey").cast("string")
    segment = F.col("c_mktsegment")
    one = F.concat(F.lit("auth-"), (F.col("c_nationkey") + 3).cast("string"))
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("custkey"),
        F.lower(F.translate("c_name", "#", "-")).alias("cluster"),
        F.concat(F.lit("ns-"), nation).alias("namespace"),
        F.when(segment == "BUILDING", "1.27.0")
        .when(segment == "AUTOMOBILE", "1.28.1")
        .when(segment == "MACHINERY", "2.4.0")
        .when(segment == "FURNITURE", "2.0.0")
        .otherwise("")
        .alias("version"),
        (balance > 0).alias("tls"),
        F.when(balance >= 3000, F.concat(F.lit("zk-"), nation))
        .when(balance >= 0, "")
        .alias("zookeeper"),
        F.when(balance >= 1000, balance < 6000).alias("reporting"),
        F.concat(F.lit("key-"), F.col("c_custkey").cast("string")).alias("key_secret"),
        (F.col("c_nationkey") < 12).alias("auto_generate"),
        F.when(balance < -500, F.array().cast("array<string>"))
        .when(balance < 0, F.array(F.lit("")))
        .when(balance < 500, F.array(F.lit("auth-1"), F.lit("auth-2")))
        .otherwise(F.array(one))
        .alias("auth_classes"),
        one.alias("auth_class"),
        balance.alias("balance"),
    )


CLUSTERS = """clusters AS (
    SELECT c_custkey AS custkey, lower(replace(c_name, '#', '-')) AS cluster,
        'ns-' || c_nationkey AS namespace,
        CASE c_mktsegment WHEN 'BUILDING' THEN '1.27.0' WHEN 'AUTOMOBILE' THEN '1.28.1'
            WHEN 'MACHINERY' THEN '2.4.0' WHEN 'FURNITURE' THEN '2.0.0' ELSE '' END AS version,
        c_acctbal > 0 AS tls,
        CASE WHEN c_acctbal >= 3000 THEN 'zk-' || c_nationkey WHEN c_acctbal >= 0 THEN '' END
            AS zookeeper,
        CASE WHEN c_acctbal >= 1000 THEN c_acctbal < 6000 END AS reporting,
        'key-' || c_custkey AS key_secret, c_nationkey < 12 AS auto_generate,
        CASE WHEN c_acctbal < -500 THEN [] WHEN c_acctbal < 0 THEN ['']
            WHEN c_acctbal < 500 THEN ['auth-1', 'auth-2']
            ELSE ['auth-' || (c_nationkey + 3)] END AS auth_classes,
        'auth-' || (c_nationkey + 3) AS auth_class, c_acctbal AS balance
    FROM customer)"""


def role_groups(spark: SparkSession, sf: str) -> DataFrame:
    status = F.col("o_orderstatus")
    orders = table(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus"
    )
    return spread(orders).select(
        F.col("o_custkey").alias("custkey"),
        F.concat(
            F.lower(F.substring("o_orderpriority", 3, 20)), F.lit("-"), F.col("o_orderkey").cast("string")
        ).alias("role_group"),
        F.when(status == "O", 3).when(status == "F", 0).alias("replicas"),
    )


ROLE_GROUPS = """role_groups AS (
    SELECT o_custkey AS custkey,
        lower(substr(o_orderpriority, 3)) || '-' || o_orderkey AS role_group,
        CASE o_orderstatus WHEN 'O' THEN 3 WHEN 'F' THEN 0 END AS replicas
    FROM orders)"""


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("custkey"),
        F.concat(F.lit("node-"), F.col("o_orderkey").cast("string")).alias("node"),
        F.when(F.col("o_orderstatus") == "P", "DISCONNECTED").otherwise("CONNECTED").alias("status"),
    )


NODES = """nodes AS (
    SELECT o_custkey AS custkey, 'node-' || o_orderkey AS node,
        CASE o_orderstatus WHEN 'P' THEN 'DISCONNECTED' ELSE 'CONNECTED' END AS status
    FROM orders)"""


def expected_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """As many nodes as the cluster has orders, one more where the balance is negative."""
    known = nodes(spark, sf).groupBy("custkey").agg(F.count(F.lit(1)).alias("n"))
    return clusters(spark, sf).join(known, "custkey", "left").select(
        "custkey",
        (F.coalesce("n", F.lit(0)) + F.when(F.col("balance") < 0, 1).otherwise(0)).alias(
            "expected_nodes"
        ),
    )


EXPECTED = """expected AS (
    SELECT c_custkey AS custkey,
        (SELECT count(*) FROM orders WHERE o_custkey = c_custkey)
            + CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS expected_nodes
    FROM customer)"""


def auth_classes(spark: SparkSession, sf: str) -> DataFrame:
    region = F.col("n_regionkey")
    return table(spark, sf, "nation").select(
        F.concat(F.lit("auth-"), F.col("n_nationkey").cast("string")).alias("name"),
        F.when(region.isin(0, 4), F.col("n_name")).alias("oidc"),
        F.when(region.isin(1, 4), F.col("n_name")).alias("ldap"),
        F.when(region.isin(2), F.col("n_name")).alias("static"),
    )


def probes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("user_id").alias("target"), "ts", "event_id", (F.col("event_type") != "error").alias("ok")
    )
