"""Last values and health per time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armada import values
from armada.operators.health import body_health
from armada.streaming.times import DELAY, with_event_time


def snapshot_last(
    events: DataFrame,
    component: str,
    value: str,
    ts: str,
    tie: str,
    every: str = values.SNAPSHOT_EVERY,
    delay: str = DELAY,
) -> DataFrame:
    """The last value of each component in each tumbling window.

    Works on a stream (append mode) and on a table. Only the best row so far is kept per key, so
    a busy component costs no more state than a quiet one.
    """
    last = F.max_by(value, F.struct(ts, tie)).alias(value)
    seen = with_event_time(events, ts, delay).groupBy(F.window(ts, every), component).agg(last)
    return seen.select(F.col("window.start").alias("window_start"), component, value)


def wanted_nodes(expected: DataFrame, cluster: str, wanted: str) -> DataFrame:
    """One row per cluster."""
    return expected.groupBy(cluster).agg(F.max(wanted).alias(wanted))


def with_silent(
    judged: DataFrame, expected: DataFrame, cluster: str, wanted: str = "expected_nodes"
) -> DataFrame:
    """Closed windows of ``stream_health`` with a ``no_response`` row for each silent cluster.

    Every window that holds any body is paired with every expected cluster, which is the size of the
    answer; the windows of a batch are few, so each cluster carries their list.
    """
    one = wanted_nodes(expected, cluster, wanted)
    windows = judged.groupBy().agg(F.collect_set("window_start").alias("_windows"))
    every = one.withColumn("_all", F.lit(1)).join(F.broadcast(windows.withColumn("_all", F.lit(1))), "_all")
    pairs = every.select(F.explode("_windows").alias("window_start"), cluster, wanted)
    known = judged.drop(wanted)
    none = F.lit(0).cast("long")
    return pairs.join(known, ["window_start", cluster], "left").select(
        "window_start", cluster, wanted,
        F.coalesce("nodes", none).alias("nodes"),
        F.coalesce("bad_nodes", none).alias("bad_nodes"),
        F.coalesce("reason", F.lit("no_response")).alias("reason"),
        F.coalesce("healthy", F.lit(False)).alias("healthy"),
        F.coalesce("offenders", F.array().cast("array<string>")).alias("offenders"),
    )


def stream_health(
    bodies: DataFrame,
    expected: DataFrame,
    cluster: str,
    body: str,
    ts: str,
    tie: str,
    wanted: str = "expected_nodes",
    every: str = f"{values.POLL_SECONDS} seconds",
    delay: str = DELAY,
    ok: str = values.CONNECTED,
) -> DataFrame:
    """T4: the A1 verdict on the latest status body per cluster and poll window.

    ``expected`` is a table; of several rows of one cluster the greatest number counts. The window
    keeps one body per key; the verdict is then worked out inside the row, so no second aggregate
    follows. Clusters without a body in a window are not in it: ``with_silent`` adds them to closed
    windows. The table is shuffled to the windows: a stream plans without measured sizes, and would broadcast
    a table of any number of clusters whose files are small.
    """
    latest = F.max_by(body, F.struct(ts, tie)).alias(body)
    seen = with_event_time(bodies, ts, delay).groupBy(F.window(ts, every), cluster).agg(latest)
    flat = seen.select(F.col("window.start").alias("window_start"), cluster, body)
    joined = flat.join(wanted_nodes(expected, cluster, wanted).hint("shuffle_merge"), cluster)
    return body_health(joined, body, wanted, ok).drop(body)
