"""Running values and per-group rankings for groups of any size.

A window function sends each group to one task. That is right for most groups and wrong for one
that holds a large share of all rows. The functions here count rows per key first (a combined
aggregate over the key columns only) and then take one of two ways:

* groups up to ``rows_per_task`` rows go through an ordinary window;
* larger groups are range-partitioned by key *and* order, so each one becomes a row of slices of
  even size. Every slice is worked on alone, and what earlier slices contribute is added from a
  table with one row per (slice, group).

Both give the same result. Order columns are written as ``"ts"`` or ``"-ts"`` (descending). Large
groups get a row number of their own as the last order column, so copies of one row, which tie on
everything, are cut as well.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from armada.session import pin

ROWS_PER_TASK = 2_000_000

# A list of hot keys is broadcast only up to this many keys; its size is known before.
BROADCAST_KEYS = 500_000


def sort_columns(order: list[str]) -> list[Column]:
    return [F.desc(o[1:]) if o.startswith("-") else F.asc(o) for o in order]


def same_key(left: list[str], right: list[str]) -> Column:
    """Null-safe equality of two key lists."""
    return reduce(
        lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right)]
    )


@dataclass
class Split:
    cold: DataFrame
    hot: DataFrame | None
    hot_rows: int
    hot_count: int

    def per_hot_key(self, small: DataFrame) -> DataFrame:
        """Broadcast a table with one row per hot key, if the keys are as few as they should be."""
        return F.broadcast(small) if self.hot_count <= BROADCAST_KEYS else small


def split_hot(df: DataFrame, keys: list[str], rows_per_task: int = ROWS_PER_TASK) -> Split:
    """Separate the rows of keys that have more than ``rows_per_task`` rows.

    There are at most total / rows_per_task such keys. When there are none, which the count tells,
    the input comes back untouched.
    """
    counts = (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows_per_task)
    )
    found = counts.agg(F.count(F.lit(1)).alias("keys"), F.sum("_n").alias("rows")).first()
    if not found["keys"]:
        return Split(df, None, 0, 0)
    names = [f"_hot_{i}" for i in range(len(keys))]
    listed = pin(counts.select(*[F.col(k).alias(n) for k, n in zip(keys, names)]))
    if found["keys"] <= BROADCAST_KEYS:
        listed = F.broadcast(listed)
    match = same_key(keys, names)
    return Split(
        df.join(listed, match, "left_anti"),
        df.join(listed, match, "left_semi"),
        found["rows"],
        found["keys"],
    )


def numbered(df: DataFrame) -> DataFrame:
    """Add ``_row``, a unique number that stays with its row."""
    return pin(df.withColumn("_row", F.monotonically_increasing_id()))


def slice_count(rows: int, rows_per_task: int) -> int:
    return max(1, math.ceil(rows / rows_per_task))


def slices(
    df: DataFrame, group: list[str], order: list[str], rows: int, rows_per_task: int
) -> DataFrame:
    """Range-partition by group and order and keep the slice number of each row."""
    parts = slice_count(rows, rows_per_task)
    ranged = df.repartitionByRange(parts, *[F.asc(g) for g in group], *sort_columns(order))
    return pin(ranged.withColumn("_slice", F.spark_partition_id()))


def _carried(sliced: DataFrame, group: list[str], summary: Column, combine) -> DataFrame:
    """Per (slice, group): the combined summary of all earlier slices of the group."""
    earlier = (
        Window.partitionBy(*group)
        .orderBy("_slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    per_slice = sliced.groupBy("_slice", *group).agg(summary.alias("_part"))
    return per_slice.select(
        F.col("_slice").alias("_of"),
        *[F.col(g).alias(f"_key_{i}") for i, g in enumerate(group)],
        combine("_part").over(earlier).alias("_carry"),
    )


def _with_carry(
    sliced: DataFrame, carried: DataFrame, group: list[str], slice_total: int
) -> DataFrame:
    # One row per slice plus one per border between groups inside a slice, and there are no more
    # hot groups than slices.
    if 2 * slice_total <= BROADCAST_KEYS:
        carried = F.broadcast(carried)
    keys = [f"_key_{i}" for i in range(len(group))]
    match = (F.col("_slice") == F.col("_of")) & same_key(group, keys)
    return sliced.join(carried, match, "left").drop("_of", *keys)


def running(
    df: DataFrame,
    group: list[str],
    order: list[str],
    value: Column,
    out: str,
    how: str = "sum",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add the running ``sum`` or ``max`` of ``value`` up to and including each row.

    A null value adds nothing to a sum; without that, a slice that begins with nulls would lose what
    earlier slices contribute.
    """
    combine = {"sum": F.sum, "max": F.max}[how]
    if how == "sum":
        value = F.coalesce(value, F.lit(0))
    columns = df.columns

    def windowed(rows: DataFrame, keys: list[str]) -> DataFrame:
        upto = (
            Window.partitionBy(*keys)
            .orderBy(*sort_columns(order))
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        return rows.withColumn(out, combine(value).over(upto))

    split = split_hot(df, group, rows_per_task)
    plain = windowed(split.cold, group)
    if split.hot is None:
        return plain

    order = [*order, "_row"]
    sliced = slices(numbered(split.hot), group, order, split.hot_rows, rows_per_task)
    carried = _carried(sliced, group, combine(value), combine)
    total_slices = slice_count(split.hot_rows, rows_per_task)
    local = _with_carry(windowed(sliced, ["_slice", *group]), carried, group, total_slices)
    if how == "sum":
        total = F.col(out) + F.coalesce(F.col("_carry"), F.lit(0))
    else:
        total = F.greatest(F.col(out), F.col("_carry"))
    kind = plain.schema[out].dataType
    return plain.unionByName(local.select(*columns, total.cast(kind).alias(out)))


def top_per_group(
    df: DataFrame,
    group: list[str],
    order: list[str],
    n: int,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """First ``n`` rows of every group in the given order."""

    def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*sort_columns(order)))
        return rows.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")

    split = split_hot(df, group, rows_per_task)
    plain = ranked(split.cold, group)
    if split.hot is None:
        return plain
    # First keep n rows per (group, salt); the rest cannot be among the first n of the group.
    # What is left may still be many rows for a large n, so it is counted off in slices.
    salts = math.ceil(split.hot_rows / rows_per_task)
    salted = numbered(split.hot).withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(salts)))
    left = ranked(salted, [*group, "_salt"]).drop("_salt", "_row")
    counted = running(left, group, order, F.lit(1), "_place", "sum", rows_per_task)
    return plain.unionByName(counted.filter(F.col("_place") <= n).drop("_place"))
