"""Health with silent clusters, in the stream: expected heartbeats joined to the bodies that came."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armada import values
from armada.operators.health import body_health
from armada.streaming.times import DELAY, with_event_time


def heartbeats(expected: DataFrame, cluster: str, start: Column, end: Column, every: str, wanted: str = "expected_nodes") -> DataFrame:
    """(cluster, wanted, due): one row for each expected cluster and poll window from ``start`` to ``end`` (left out).

    This is what a scheduler would send; as a table it can be written ahead and read as a stream.
    """
    one = expected.groupBy(cluster).agg(F.max(wanted).alias(wanted))
    last = end - F.expr("INTERVAL 1 MICROSECOND")
    due = F.when(start < end, F.sequence(start, last, F.expr(f"INTERVAL {every}"))).otherwise(F.array().cast("array<timestamp>"))
    return one.select(cluster, wanted, F.explode(due).alias("due"))


def expected_health(
    beats: DataFrame, bodies: DataFrame, cluster: str, body: str, ts: str, tie: str, due: str = "due",
    wanted: str = "expected_nodes", every: str = f"{values.POLL_SECONDS} seconds", delay: str = DELAY, ok: str = values.CONNECTED,
) -> DataFrame:
    """T4: the A1 verdict for every expected cluster and poll window, also where no body came at all.

    ``beats`` and ``bodies`` are streams, or tables; a body belongs to the window its time falls into, and
    of several the latest by (``ts``, ``tie``) counts; of several beats of a window the greatest number. The
    two meet in a left outer join of windows once the watermark has passed them, so a window without body
    comes out as ``no_response`` and nothing is kept of it afterwards. Bodies of clusters that nobody expects
    are left out, as are rows without cluster or time. Both sides keep one row per cluster and window, however
    many bodies there are. A body that is no status document counts as one without nodes.
    """
    latest = F.max_by(F.struct(F.col(body).alias("body")), F.struct(ts, tie)).alias("_latest")
    seen = with_event_time(bodies.filter(F.col(cluster).isNotNull()), ts, delay)
    seen = seen.groupBy(F.window(ts, every).alias("_w"), F.col(cluster).alias("_cluster")).agg(latest)
    wanted_rows = with_event_time(beats.filter(F.col(cluster).isNotNull()), due, delay)
    wanted_rows = wanted_rows.groupBy(F.window(due, every).alias("_window"), cluster).agg(F.max(F.col(wanted).cast("long")).alias(wanted))
    joined = wanted_rows.join(seen, (F.col("_window") == F.col("_w")) & (F.col(cluster) == F.col("_cluster")), "left_outer")
    flat = joined.select(
        F.col("_window.start").alias("window_start"), cluster, wanted, F.col("_latest.body").alias("_body"),
        F.col("_latest").isNull().alias("_silent"),
    )
    judged = body_health(flat, "_body", wanted, ok)
    silent = F.col("_silent")
    return judged.select(
        "window_start", cluster, wanted, "nodes", "bad_nodes",
        F.when(silent, "no_response").otherwise(F.col("reason")).alias("reason"),
        (F.col("healthy") & ~silent).alias("healthy"), "offenders",
    )
