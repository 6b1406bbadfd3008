"""Outages of a fleet: failures joined to sessions per target, and how many targets are down at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armada.operators.ordered import ROWS_PER_TASK, running


def failure_sessions(probes: DataFrame, target: str, ts: str, ok: str, gap: str) -> DataFrame:
    """(target, down_from, down_until, failures) of failures less than ``gap`` apart.

    A target counts as down from its first failure until ``gap`` after the last. A probe without verdict is
    a failure; rows without time are left out. Spark merges sessions on the map side and by sorted
    streaming, so a target with very many failures needs no memory of its own.
    """
    failed = probes.filter(F.col(ts).isNotNull() & ~F.coalesce(F.col(ok), F.lit(False)))
    sessions = failed.groupBy(F.session_window(ts, gap).alias("_s"), F.col(target).alias("target")).agg(
        F.count(F.lit(1)).alias("failures")
    )
    return sessions.select("target", F.col("_s.start").alias("down_from"), F.col("_s.end").alias("down_until"), "failures")


def down_at_once(sessions: DataFrame, scope: list[str] | None = None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(scope, at, until, down): from ``at`` on ``down`` targets are down at once, until it changes.

    A sweep over the ends of all sessions: +1 where one begins, -1 where it ends. Ends of one moment are
    added up first, on the map side, so a moment when the whole fleet fails is one row; the running sum
    is taken in slices of time, so one fleet-wide history is spread as well. ``scope`` are columns of the
    sessions that are swept apart, such as a region. Moments after which as many are down as before are
    left out; ``until`` is null for the last.
    """
    scope = scope or []
    ends = sessions.select(
        *scope, F.explode(F.array(
            F.struct(F.col("down_from").alias("at"), F.lit(1).alias("step")),
            F.struct(F.col("down_until").alias("at"), F.lit(-1).alias("step")),
        )).alias("_e"),
    ).select(*scope, "_e.*")
    steps = ends.groupBy(*scope, "at").agg(F.sum("step").alias("step")).filter("step <> 0").withColumn("_all", F.lit(0))
    keys = ["_all", *scope]
    swept = running(steps, keys, ["at"], F.col("step"), "down", "sum", rows_per_task)
    # The next moment is the least later one: taken by a running greatest of what is behind, negated.
    after = running(swept, keys, ["-at"], F.lit(1).cast("long"), "_back", "sum", rows_per_task)
    named = after.select(*keys, F.col("at").alias("_next"), (F.col("_back") + 1).alias("_back"))
    match = [*keys, "_back"]
    aliased = named.withColumnsRenamed({c: f"_r{c}" for c in match})
    condition = F.lit(True)
    for c in match:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_r{c}"))
    joined = after.join(aliased, condition, "left")
    return joined.select(*scope, "at", F.col("_next").alias("until"), F.col("down").cast("long").alias("down"))


def worst_by(swept: DataFrame, every: str, scope: list[str] | None = None) -> DataFrame:
    """(scope, window_start, most_down, down_ms): the worst moment of each window in which a change falls,
    and how long the fleet of such stretches had any target down."""
    span = F.when(F.col("down") > 0, F.unix_millis(F.coalesce("until", "at")) - F.unix_millis("at")).otherwise(0)
    return swept.groupBy(*(scope or []), F.window("at", every)["start"].alias("window_start")).agg(
        F.max("down").alias("most_down"), F.sum(span).alias("down_ms")
    )
