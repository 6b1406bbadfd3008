"""Cluster health from node states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armada import values

STATUS_BODY = "cluster struct<nodes array<struct<address string, nodeId string, status string>>>"


def explode_nodes(df: DataFrame, body: str, keep: list[str] | None = None) -> DataFrame:
    """One row per node of a cluster-status JSON body.

    The label is the address, else the node id. A body without nodes, or one that is not JSON,
    gives one row with nulls, so its cluster does not drop out.
    """
    keep = keep if keep is not None else [c for c in df.columns if c != body]
    node = F.explode_outer(F.from_json(body, STATUS_BODY)["cluster"]["nodes"])
    return df.select(*keep, node.alias("_node")).select(
        *keep,
        F.coalesce("_node.address", "_node.nodeId").alias("node"),
        F.col("_node.status").alias("status"),
    )


def _bad(status: str, ok: str) -> Column:
    return ~F.col(status).eqNullSafe(F.lit(ok))


def _reason(seen: str, wanted: str, bad: Column) -> Column:
    return (
        F.when(~F.col(seen).eqNullSafe(F.col(wanted)), "count_mismatch")
        .when(bad > 0, "not_connected")
        .otherwise("healthy")
    )


def cluster_health(
    nodes: DataFrame,
    expected: DataFrame,
    cluster: str = "cluster",
    label: str = "node",
    status: str = "status",
    wanted: str = "expected_nodes",
    ok: str = values.CONNECTED,
) -> DataFrame:
    """A1: one verdict per expected cluster.

    Healthy means that the node count is the expected one and every state equals ``ok``. A count
    mismatch is named before a bad state; no nodes where none are expected is healthy. Rows with a
    null label (a body without nodes) are no nodes. Which nodes are to blame is in
    ``cluster_offenders``.
    """
    seen = (
        nodes.filter(F.col(label).isNotNull())
        .groupBy(cluster)
        .agg(
            F.count(F.lit(1)).alias("nodes"),
            F.count(F.when(_bad(status, ok), 1)).alias("bad_nodes"),
        )
    )
    joined = expected.select(cluster, F.col(wanted).cast("long").alias(wanted)).join(
        seen, cluster, "left"
    )
    counted = joined.select(
        cluster,
        wanted,
        F.coalesce("nodes", F.lit(0)).alias("nodes"),
        F.coalesce("bad_nodes", F.lit(0)).alias("bad_nodes"),
    )
    reason = _reason("nodes", wanted, F.col("bad_nodes"))
    return counted.withColumn("reason", reason).withColumn(
        "healthy", F.col("reason") == "healthy"
    )


def cluster_offenders(
    nodes: DataFrame,
    health: DataFrame,
    cluster: str = "cluster",
    label: str = "node",
    status: str = "status",
    ok: str = values.CONNECTED,
) -> DataFrame:
    """A1: the nodes behind each unhealthy verdict, one row per cluster, node and state.

    With a count mismatch every node is listed, otherwise the nodes in a bad state. The list stays
    in rows because one cluster may have any number of nodes; repeated reports of the same state
    are counted in ``reports`` before the join.
    """
    states = (
        nodes.filter(F.col(label).isNotNull())
        .groupBy(cluster, label, status)
        .agg(F.count(F.lit(1)).alias("reports"))
    )
    unhealthy = health.filter(~F.col("healthy")).select(cluster, "reason")
    listed = states.join(unhealthy, cluster).filter(
        (F.col("reason") == "count_mismatch") | _bad(status, ok)
    )
    return listed.select(
        cluster,
        "reason",
        F.concat_ws("=", label, F.coalesce(status, F.lit("null"))).alias("offender"),
        "reports",
    )


def body_health(
    df: DataFrame,
    body: str,
    wanted: str = "expected_nodes",
    ok: str = values.CONNECTED,
) -> DataFrame:
    """The A1 verdict of one status body per row, without leaving the row.

    Used on streams, where the latest body per cluster is already one row.
    """
    nodes = F.from_json(body, STATUS_BODY)["cluster"]["nodes"]
    none = F.array().cast("array<struct<address: string, nodeId: string, status: string>>")
    known = F.filter(
        F.coalesce(nodes, none),
        lambda n: F.coalesce(n["address"], n["nodeId"]).isNotNull(),
    )
    bad = F.filter(known, lambda n: ~n["status"].eqNullSafe(F.lit(ok)))
    sized = df.withColumn("nodes", F.size(known).cast("long")).withColumn(
        "bad_nodes", F.size(bad).cast("long")
    )
    listed = F.when(
        ~F.col("nodes").eqNullSafe(F.col(wanted)), known
    ).otherwise(bad)
    offenders = F.array_sort(
        F.transform(
            listed,
            lambda n: F.concat_ws(
                "=",
                F.coalesce(n["address"], n["nodeId"]),
                F.coalesce(n["status"], F.lit("null")),
            ),
        )
    )
    judged = sized.withColumn("reason", _reason("nodes", wanted, F.col("bad_nodes")))
    return judged.withColumn("healthy", F.col("reason") == "healthy").withColumn(
        "offenders", offenders
    )


def classify_response(df: DataFrame, call: str, code: str) -> DataFrame:
    """What a response code means, by the kind of call (``token`` or ``cluster``).

    2xx is ``ok``. A token call answered 409 means anonymous mode; a cluster call answered 404 or
    409 means a standalone process, judged by its diagnostics call. Everything else, including no
    answer at all, is tried again.
    """
    c = F.col(code)
    mode = (
        F.when(c.between(200, 299), "ok")
        .when((F.col(call) == "token") & (c == values.ANONYMOUS_CODE), "anonymous")
        .when((F.col(call) == "cluster") & c.isin(*values.STANDALONE_CODES), "standalone")
        .otherwise("retry")
    )
    return df.withColumn("response", mode)


def readiness(
    workloads: DataFrame, group: list[str], replicas: str, ready: str, want: str
) -> DataFrame:
    """A4: a group is ready when replicas and ready replicas of all its rows equal ``want``."""
    fits = F.col(replicas).eqNullSafe(F.col(want)) & F.col(ready).eqNullSafe(F.col(want))
    return workloads.groupBy(*group).agg(
        F.count(F.lit(1)).alias("workloads"),
        F.count(F.when(fits, 1)).alias("ready_workloads"),
        F.bool_and(fits).alias("ready"),
    )
