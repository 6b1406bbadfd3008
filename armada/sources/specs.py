"""Cluster specifications as typed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORRUPT = "_corrupt_record"

# Fields that role level and role group share.
LEVEL = """
config: struct<
    gracefulShutdownTimeout: string,
    logging: struct<
        enableVectorAgent: boolean,
        containers: map<string, struct<
            console: struct<level: string>,
            file: struct<level: string>,
            loggers: map<string, struct<level: string>>>>>,
    resources: struct<
        cpu: struct<max: string, min: string>,
        memory: struct<limit: string>,
        storage: struct<capacity: string, storageClass: string>>>,
cliOverrides: array<string>,
configOverrides: map<string, map<string, string>>,
envOverrides: map<string, string>,
jvmArgumentOverrides: struct<
    `add`: array<string>, remove: array<string>, removeRegex: array<string>>
"""

SPEC_DDL = f"""
metadata struct<name: string, namespace: string, labels: map<string, string>>,
spec struct<
    image: struct<custom: string, productVersion: string, pullPolicy: string,
        pullSecretName: string, repo: string>,
    clusterOperation: struct<reconciliationPaused: boolean, stopped: boolean>,
    clusterConfig: struct<
        authentication: array<struct<
            authenticationClass: string,
            oidc: struct<clientCredentialsSecret: string, extraScopes: array<string>>>>,
        createReportingTaskJob: struct<enable: boolean>,
        customComponentsGitSync: array<struct<
            repo: string, branch: string, depth: int, gitFolder: string, wait: string,
            credentialsSecret: string, gitSyncConfig: map<string, string>>>,
        listenerClass: string,
        sensitiveProperties: struct<algorithm: string, autoGenerate: boolean, keySecret: string>,
        tls: struct<serverSecretClass: string>,
        vectorAggregatorConfigMapName: string,
        zookeeperConfigMapName: string>,
    nodes: struct<
        {LEVEL},
        roleGroups: map<string, struct<{LEVEL}, replicas: int>>>>,
status struct<conditions: array<struct<
    type: string, status: string, reason: string, message: string,
    observedGeneration: bigint, lastTransitionTime: timestamp>>>,
{CORRUPT} string
"""


def read_specs(spark: SparkSession, path: str) -> DataFrame:
    """One row per specification document in JSON lines.

    The schema is fixed, so nothing is inferred. A malformed line stays as a row with its text in
    ``_corrupt_record``; a missing required field is null and left to the rules.
    """
    return (
        spark.read.schema(SPEC_DDL)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
    )


def flatten_specs(specs: DataFrame) -> DataFrame:
    """The scalar settings of each readable specification."""
    config = F.col("spec.clusterConfig")
    return specs.select(
        F.col("metadata.name").alias("cluster"),
        F.col("metadata.namespace").alias("namespace"),
        F.col("spec.image.productVersion").alias("version"),
        config["tls"].isNotNull().alias("tls"),
        config["zookeeperConfigMapName"].alias("zookeeper"),
        config["createReportingTaskJob"]["enable"].alias("reporting"),
        config["sensitiveProperties"]["keySecret"].alias("key_secret"),
        config["sensitiveProperties"]["autoGenerate"].alias("auto_generate"),
        F.transform(config["authentication"], lambda a: a["authenticationClass"]).alias(
            "auth_classes"
        ),
        config["customComponentsGitSync"].alias("git"),
        F.col("spec.nodes.roleGroups").alias("role_groups"),
    )


def explode_role_groups(flat: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per (cluster, role group)."""
    keep = keep or ["cluster", "namespace"]
    groups = flat.select(*keep, F.explode("role_groups").alias("role_group", "_g"))
    return groups.select(*keep, "role_group", F.col("_g.replicas").alias("replicas"))


def explode_conditions(specs: DataFrame) -> DataFrame:
    """One row per status condition."""
    rows = specs.select(
        F.col("metadata.name").alias("cluster"), F.posexplode("status.conditions").alias("pos", "_c")
    )
    return rows.select("cluster", "pos", "_c.*")
