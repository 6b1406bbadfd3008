"""Selections and histories that depend on order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from armada import values
from armada.functions.naming import content_path
from armada.operators.ordered import (
    ROWS_PER_TASK,
    running,
    sort_columns,
    split_hot,
    top_per_group,
)


def pick_first_eligible(
    clusters: DataFrame,
    groups: DataFrame,
    cluster: str = "cluster",
    group: str = "role_group",
    replicas: str = "replicas",
    role: str = "node",
) -> DataFrame:
    """The role group a single-target service points at.

    First group by name with replicas above zero; without one, first group by name. A cluster
    without groups gets an error instead of a pod. One combined aggregate, no sort.
    """
    idle = ~F.coalesce(F.col(replicas) > 0, F.lit(False))
    picked = groups.groupBy(cluster).agg(
        F.min_by(group, F.struct(idle, F.col(group))).alias("selected_group")
    )
    pod = F.concat(F.col(cluster), F.lit(f"-{role}-"), F.col("selected_group"), F.lit("-0"))
    return (
        clusters.select(cluster)
        .join(picked, cluster, "left")
        .withColumn("pod", pod)
        .withColumn(
            "error", F.when(F.col("selected_group").isNull(), F.lit("no_role_groups"))
        )
    )


def time_to_success(
    attempts: DataFrame,
    target: str,
    ts: str,
    tie: str,
    ok: str,
    deadline_seconds: int = values.DEADLINE_SECONDS,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """The first success among attempts started strictly before the deadline.

    The clock starts with the first attempt of a target. ``PASS`` carries the number of the
    attempt that succeeded and the time it took; ``FAIL`` the number of attempts made in time.
    ``ok`` is a boolean column; null (an error) counts as an attempt that failed.
    """
    rows = attempts.select(target, ts, tie, F.coalesce(F.col(ok), F.lit(False)).alias("_ok"))
    at = F.struct(F.col(ts), F.col(tie))
    summary = {"_start": F.min(ts), "_hit": F.min(F.when(F.col("_ok"), at))}
    limit = F.col("_start") + F.expr(f"make_dt_interval(0, 0, 0, {int(deadline_seconds)})")

    def counted(marked: DataFrame) -> DataFrame:
        hit_in_time = F.col("_hit")[ts] < limit
        used = (F.col(ts) < limit) & (~F.coalesce(hit_in_time, F.lit(False)) | (at <= F.col("_hit")))
        return marked.filter(used).groupBy(target).agg(
            F.count(F.lit(1)).alias("attempts"),
            F.first("_start").alias("started"),
            F.first(F.when(hit_in_time, F.col("_hit")[ts])).alias("succeeded"),
        )

    split = split_hot(rows, [target], rows_per_task)
    whole = Window.partitionBy(target)
    done = counted(
        split.cold.select("*", *[v.over(whole).alias(k) for k, v in summary.items()])
    )
    if split.hot is not None:
        marks = split.hot.groupBy(F.col(target).alias("_target")).agg(
            *[v.alias(k) for k, v in summary.items()]
        )
        marks = split.per_hot_key(marks)
        joined = split.hot.join(marks, F.col(target).eqNullSafe(F.col("_target")))
        done = done.unionByName(counted(joined.drop("_target")))
    elapsed = F.timestamp_diff("MILLISECOND", F.col("started"), F.col("succeeded"))
    return done.select(
        target,
        F.when(F.col("succeeded").isNull(), "FAIL").otherwise("PASS").alias("verdict"),
        "attempts",
        "started",
        "succeeded",
        elapsed.alias("elapsed_ms"),
    )


def failure_runs(
    probes: DataFrame,
    target: str,
    ts: str,
    tie: str,
    ok: str,
    threshold: int = values.LIVENESS_FAILURES,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Runs of consecutive failures of at least ``threshold``; one success ends a run.

    Failures of one run have the same number of successes before them, so a running count names
    the run and a combined aggregate measures it.
    """
    good = F.coalesce(F.col(ok), F.lit(False))
    rows = probes.select(target, ts, tie, good.alias("_ok"))
    successes = F.col("_ok").cast("long")
    marked = running(rows, [target], [ts, tie], successes, "_run", "sum", rows_per_task)
    return (
        marked.filter(~F.col("_ok"))
        .groupBy(target, "_run")
        .agg(
            F.count(F.lit(1)).alias("failures"),
            F.min(ts).alias("run_start"),
            F.max(ts).alias("run_end"),
        )
        .filter(F.col("failures") >= threshold)
        .drop("_run")
    )


def budget_keep(
    items: DataFrame,
    component: str,
    order: list[str],
    size: str,
    capacity: int | Column,
    ratio: float = values.ARCHIVE_RATIO,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Newest first, keep items while their running size fits into ratio x capacity.

    ``order`` puts the newest first, for example ``["-ts", "-id"]``. ``capacity`` may be a column.
    An item without a size takes no room.
    """
    budget = F.floor(F.lit(capacity) * F.lit(ratio))
    summed = running(items, [component], order, F.col(size), "running_size", "sum", rows_per_task)
    return summed.filter(F.col("running_size") <= budget)


def history_cap(
    df: DataFrame,
    component: str,
    order: list[str],
    n: int = values.HISTORY_POINTS,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """The latest ``n`` points per component."""
    return top_per_group(df, [component], order, n, rows_per_task)


def index_entries(
    df: DataFrame,
    entries: str,
    mount_prefix: str,
    keep: list[str] | None = None,
    folder: str = "gitFolder",
) -> DataFrame:
    """Names and paths that follow from an entry's position in its array.

    ``mount_prefix`` is the path the deployment mounts content under; ``-<position>`` is added.
    """
    keep = keep if keep is not None else [c for c in df.columns if c != entries]
    exploded = df.select(*keep, F.posexplode(entries).alias("pos", "_entry"))
    pos = F.col("pos").cast("string")
    mount = F.concat(F.lit(f"{mount_prefix}-"), pos)
    nested = exploded.schema["_entry"].dataType
    sub = F.col("_entry")[folder] if isinstance(nested, T.StructType) else F.col("_entry")
    return exploded.select(
        *keep,
        "pos",
        F.concat(F.lit(f"{values.SYNC_PREFIX}-"), pos).alias("sidecar"),
        F.concat(F.lit(f"{values.SYNC_PREFIX}-"), pos, F.lit("-init")).alias("init_container"),
        F.concat(F.lit(f"{values.VOLUME_PREFIX}-"), pos).alias("volume"),
        mount.alias("mount_path"),
        content_path(mount, sub).alias("content_folder"),
    )


def stable_order(
    df: DataFrame,
    key: str,
    ties: list[str] | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """L1: ascending bytewise order of ``key``.

    The remaining plain columns break ties, so that repeated runs agree and a key with very many
    rows can be cut across several range partitions. Very many copies of one row, which no column
    can tell apart, travel as counted packs of at most ``rows_per_task`` and unfold after the sort.
    """
    if ties is None:
        nested = (T.MapType, T.ArrayType, T.StructType, T.VariantType)
        ties = [
            f.name for f in df.schema if f.name != key and not isinstance(f.dataType, nested)
        ]
    order = [F.asc(key), *[F.asc(t) for t in ties]]
    comparable = not any(isinstance(f.dataType, (T.MapType, T.VariantType)) for f in df.schema)
    busy = split_hot(df, [key], rows_per_task) if comparable else None
    copies = split_hot(df, df.columns, rows_per_task) if busy and busy.hot is not None else None
    if copies is None or copies.hot is None:
        return df.orderBy(*order)

    size = F.lit(rows_per_task).cast("long")
    pack = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / size)))
    packed = (
        copies.hot.groupBy(*df.columns)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*df.columns, pack.alias("_pack"), "_n")
        .withColumn("_n", F.least(size, F.col("_n") - F.col("_pack") * size))
    )
    single = copies.cold.withColumns({"_pack": F.lit(0).cast("long"), "_n": F.lit(1).cast("long")})
    ordered = single.unionByName(packed).orderBy(*order, "_pack")
    one = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))
    return ordered.withColumn("_one", one).drop("_one", "_pack", "_n")


def first_n(
    df: DataFrame,
    n: int,
    order: list[str],
    group: list[str] | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """L2: the first ``n`` rows in order, of the whole table or of every group.

    Without a group this is a report: ``n`` is as many rows as one task should hold.
    """
    if group:
        return top_per_group(df, group, order, n, rows_per_task)
    return df.orderBy(*sort_columns(order)).limit(n)
