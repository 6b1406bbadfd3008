"""Alerts on consecutive failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from armada import values
from armada.operators.ordered import ROWS_PER_TASK, running
from armada.streaming.closing import ClosedWindows
from armada.streaming.times import DELAY


def threshold_crossings(
    probes: DataFrame,
    open_runs: DataFrame,
    target: str,
    ts: str,
    tie: str,
    ok: str,
    threshold: int,
    rows_per_task: int = ROWS_PER_TASK,
) -> tuple[DataFrame, DataFrame]:
    """Alerts within a stretch of probes, and the runs that are open after it.

    ``open_runs`` has (target, run): failures in a row at the end of everything before. Both steps
    go through ``running``, so neither a busy target nor a very long run ends up in one task.
    """
    rows = probes.select(
        F.col(target).alias("target"), F.col(ts).alias("ts"), F.col(tie).alias("tie"),
        F.coalesce(F.col(ok), F.lit(False)).alias("ok"),
    )
    successes = F.col("ok").cast("long")
    marked = running(rows, ["target"], ["ts", "tie"], successes, "_after", "sum", rows_per_task)
    failed = marked.filter(~F.col("ok"))
    placed = running(
        failed, ["target", "_after"], ["ts", "tie"], F.lit(1), "_place", "sum", rows_per_task
    )
    carried = open_runs.select("target", F.col("run").alias("_run"))
    # Only a run after no success continues one from before.
    added = F.when(F.col("_after") == 0, F.coalesce("_run", F.lit(0))).otherwise(F.lit(0))
    alerts = (
        placed.filter(F.col("_place") <= threshold)
        .join(carried, "target", "left")
        .filter(F.col("_place") + added == threshold)
        .select("target", F.col("ts").alias("alert_at"))
    )
    runs = marked.groupBy("target", "_after").agg(
        F.count(F.when(~F.col("ok"), 1)).alias("_failures")
    )
    last = runs.groupBy("target").agg(
        F.max_by(F.struct("_failures", (F.col("_after") == 0).alias("_same")), "_after").alias("_l")
    )
    still_open = (
        last.join(carried, "target", "full")
        .select(
            "target",
            F.when(F.col("_l").isNull(), F.col("_run"))
            .when(F.col("_l._same"), F.col("_l._failures") + F.coalesce("_run", F.lit(0)))
            .otherwise(F.col("_l._failures"))
            .alias("run"),
        )
        .filter(F.col("run") > 0)
    )
    return alerts, still_open


def failure_alerts(
    probes: DataFrame,
    path: str,
    target: str,
    ts: str,
    tie: str,
    ok: str,
    threshold: int = values.LIVENESS_FAILURES,
    every: str = "1 minute",
    delay: str = DELAY,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataStreamWriter:
    """One alert when a target reaches ``threshold`` consecutive failures; a success resets.

    Probes count in event-time order once their slice of time (``every``) is closed; later ones
    are dropped. Between batches only the length of each open run is kept, one row per failing
    target. Give the writer a trigger and start it; ``read_alerts`` has the result. Each batch
    replaces its own output, so a repeated batch changes nothing.
    """
    windows = ClosedWindows(path, ts, every, delay)
    kind = probes.schema[target].dataType.simpleString()
    run_schema = f"target {kind}, run long"
    kept = list(dict.fromkeys([target, ts, tie, ok]))

    def handle(batch_rows: DataFrame, batch: int) -> None:
        spark = batch_rows.sparkSession
        closed = windows.take(batch_rows, batch)
        if batch:
            open_runs = spark.read.schema(run_schema).parquet(f"{path}/open/{batch - 1}")
        else:
            open_runs = spark.createDataFrame([], run_schema)
        alerts, still_open = threshold_crossings(
            closed, open_runs, target, ts, tie, ok, threshold, rows_per_task
        )
        still_open.write.mode("overwrite").parquet(f"{path}/open/{batch}")
        alerts.write.mode("overwrite").parquet(f"{path}/alerts/batch={batch}")

    return (
        probes.select(*kept)
        .writeStream.option("checkpointLocation", f"{path}/progress")
        .foreachBatch(handle)
    )


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/alerts").select("target", "alert_at")
