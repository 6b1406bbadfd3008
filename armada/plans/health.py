"""Jobs about health, readiness and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armada import values
from armada.operators.health import (
    classify_response,
    cluster_health,
    cluster_offenders,
    explode_nodes,
)
from armada.operators.ordered import ROWS_PER_TASK
from armada.operators.rules import match_labels, metrics_endpoint, route_by_version
from armada.operators.scraping import metric_present
from armada.operators.sequences import failure_runs, time_to_success


def fleet_health(
    responses: DataFrame, expected: DataFrame, fresh_after: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Which clusters are unhealthy, and which nodes cause it?

    ``responses`` has (cluster, ts, id, code, body) of cluster calls, ``expected`` has (cluster,
    expected_nodes). The latest call of each cluster decides, whatever its code: one that was not
    answered makes the cluster ``no_response``. A standalone process is healthy when it answers and
    no more than one node is expected. ``fresh_after``: calls before this time do not count. Gives the
    verdicts and the nodes to blame.
    """
    tagged = responses.withColumn("call", F.lit("cluster"))
    if fresh_after is not None:
        tagged = tagged.filter(F.col("ts") >= fresh_after)
    latest = classify_response(tagged, "call", "code").groupBy("cluster").agg(
        F.max_by(F.struct("response", "body"), F.struct("ts", "id")).alias("_r")
    )
    known = latest.select("cluster", "_r.response", "_r.body")
    nodes = explode_nodes(known.filter(F.col("response") == "ok"), "body", ["cluster"])
    judged = cluster_health(nodes, expected)
    mode = known.select("cluster", F.col("response").alias("mode"))
    verdict = judged.join(mode, "cluster", "left")
    alone = F.col("mode").eqNullSafe("standalone")
    reason = (
        F.when(alone & (F.col("expected_nodes") > 1), "count_mismatch")
        .when(alone, "standalone")
        .when(F.col("mode").isNull() | (F.col("mode") == "retry"), "no_response")
        .otherwise(F.col("reason"))
    )
    verdicts = verdict.select(
        "cluster", "expected_nodes", "nodes", "bad_nodes", reason.alias("reason"),
        (reason.isin("healthy", "standalone")).alias("healthy"),
    )
    blamed = cluster_offenders(nodes, verdicts)
    return verdicts, blamed


def readiness_report(
    attempts: DataFrame,
    probes: DataFrame,
    deadline_seconds: int = values.DEADLINE_SECONDS,
    threshold: int = values.LIVENESS_FAILURES,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """How long until ready, and which targets fail repeatedly?

    Both inputs have (target, ts, id, ok). One row per target that was tried.
    """
    tried = time_to_success(attempts, "target", "ts", "id", "ok", deadline_seconds, rows_per_task)
    runs = failure_runs(probes, "target", "ts", "id", "ok", threshold, rows_per_task)
    failing = runs.groupBy("target").agg(
        F.count(F.lit(1)).alias("runs"), F.max("failures").alias("longest")
    )
    none = F.lit(0).cast("long")
    return tried.join(failing, "target", "left").select(
        "target", "verdict", "attempts", "elapsed_ms",
        F.coalesce("runs", none).alias("runs"),
        F.coalesce("longest", none).alias("longest"),
    )


def metric_coverage(
    targets: DataFrame,
    scrapes: DataFrame,
    metric: str,
    native_path: str,
    selector: dict[str, str] | None = None,
    exact: bool = False,
) -> DataFrame:
    """Which targets lack a metric, and where would it be scraped?

    ``targets`` has (target, version, host, tls, labels); ``scrapes`` has (target, body).
    """
    chosen = match_labels(targets, "labels", selector or {})
    routed = route_by_version(chosen, "version")
    job = F.col("metrics_route") == "job"
    port = F.when(job, F.lit(values.PORTS["metrics"])).when(
        F.col("tls"), F.lit(values.PORTS["https"])
    ).otherwise(F.lit(values.PORTS["http"]))
    placed = routed.withColumn("port", port).withColumn("_https", ~job & F.col("tls"))
    addressed = metrics_endpoint(placed, "host", "port", "_https", native_path)
    seen = metric_present(scrapes, "target", "body", metric, exact)
    return (
        addressed.join(seen, "target", "left")
        .filter(~F.coalesce(F.col("present"), F.lit(False)))
        .select(
            "target", "metrics_route", "metrics_url",
            F.coalesce("scrapes", F.lit(0).cast("long")).alias("scrapes"),
        )
    )
