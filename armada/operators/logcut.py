"""Logs cut by time or size, whichever comes first, each cut starting the count anew.

Where a segment ends depends on where it began, so rows seem to have to be walked in sequence. But the
row at which the next segment would begin, if one began here, follows from running sums alone: the
first row that is late enough, or the first before which enough bytes have gone by. That gives every
row a successor. The rows that can be reached from the first row of a log are where it is cut. They are
found in blocks of rows first, and between blocks by doubling: round k knows who is reached in less than
2^k steps and where 2^k steps lead.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from armada import values
from armada.operators.ordered import ROWS_PER_TASK, running, same_key
from armada.session import pin

MOST_ROUNDS = 62

# One row of arrays holds a block.
ROWS_PER_BLOCK = 4_096


def first_at_least(
    rows: DataFrame, log: list[str], number: str, value: Column, wanted: Column, out: str, rows_per_task: int
) -> DataFrame:
    """Rows (log, number, out): the least ``number`` of the log whose ``value`` is ``wanted`` or more.

    ``value`` must not fall as ``number`` grows. Values and wishes are put in one falling order, where the
    last value before a wish belongs to the row sought.
    """
    marks = rows.select(*log, F.lit(None).cast("long").alias("_asks"), (-F.col(number)).alias("_row_no"), value.alias("_at"), F.lit(0).alias("_kind"))
    asked = rows.select(*log, F.col(number).alias("_asks"), F.lit(None).cast("long").alias("_row_no"), wanted.alias("_at"), F.lit(1).alias("_kind"))
    # Rows of equal value come by falling number, before the wishes for that value.
    order = ["-_at", "_kind", "_row_no", "_asks"]
    found = running(marks.union(asked), log, order, F.col("_row_no"), "_least", "max", rows_per_task)
    return found.filter("_kind = 1").select(*log, F.col("_asks").alias(number), (-F.col("_least")).alias(out))


def successors(rows: DataFrame, log: list[str], ts: str, size: str, every: str, max_bytes: int, rows_per_task: int) -> DataFrame:
    """Rows (log, _n, _next): where the next segment begins if one begins at row _n; null at the end."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    span = F.unix_micros(F.lit("1970-01-01 00:00:00").cast("timestamp") + F.expr(f"INTERVAL {every}"))
    zone = F.unix_micros(F.lit("1970-01-01 00:00:00").cast("timestamp"))
    before = F.col("_upto") - F.col(size)
    late = first_at_least(rows, log, "_n", at, at + (span - zone), "_late", rows_per_task)
    full = first_at_least(rows, log, "_n", before, before + max_bytes, "_full", rows_per_task)
    named = full.select(*[F.col(k).alias(f"_l{i}") for i, k in enumerate(log)], F.col("_n").alias("_m"), "_full")
    match = (F.col("_n") == F.col("_m")) & same_key(log, [f"_l{i}" for i in range(len(log))])
    return late.join(named, match).select(*log, "_n", F.least("_late", "_full").alias("_next"))


def followed(jumps: DataFrame, log: list[str]) -> DataFrame:
    """Rows (log, _n) that are reached from row 1 of each log, by doubling.

    Only rows that are reached already, or that something leads to, can matter later, so only their jumps are
    kept; they get fewer each round. The number of rounds is the logarithm of the most cuts of a log.
    """
    keys = [f"_l{i}" for i in range(len(log))]

    def landing(left: DataFrame, jumps: DataFrame) -> DataFrame:
        """(log, _n, _next): where the row that ``left`` leads to leads on to."""
        on = jumps.select(*[F.col(k).alias(n) for k, n in zip(log, keys)], F.col("_n").alias("_m"), F.col("_next").alias("_then"))
        match = (F.col("_next") == F.col("_m")) & same_key(log, keys)
        return left.join(on, match).select(*log, "_n", F.col("_then").alias("_next"))

    jumps = pin(jumps.filter("_next IS NOT NULL"))
    found = pin(jumps.filter("_n = 1").select(*log, "_n"))
    total = found.count()
    for _ in range(MOST_ROUNDS):
        leads = jumps.select(*[F.col(k).alias(n) for k, n in zip(log, keys)], F.col("_n").alias("_m"), "_next")
        match = (F.col("_n") == F.col("_m")) & same_key(log, keys)
        new = found.join(leads, match).select(*log, F.col("_next").alias("_n"))
        found = pin(found.union(new))
        before, total = total, found.count()
        if total == before:
            return found
        # Only rows that are reached, or that a jump leads to, will be asked again.
        asked = jumps.select(*log, F.col("_next").alias("_n")).union(found)
        asked = asked.select(*[F.col(k).alias(n) for k, n in zip(log, keys)], F.col("_n").alias("_m")).distinct()
        jumps = pin(landing(jumps.join(asked, match, "left_semi"), jumps))
    raise RuntimeError("a log has more cuts than could be followed")


def _landings(numbers: np.ndarray, jumps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a block: the place in it that its jump leads to, its own where that is outside; and the last on its way."""
    own = np.arange(len(numbers))
    to = np.searchsorted(numbers, jumps)
    inside = np.take(numbers, to, mode="clip") == jumps
    step = np.where(inside, to, own)
    last = step
    while True:
        further = last[last]
        if np.array_equal(further, last):
            return step, last
        last = further


@F.pandas_udf(T.ArrayType(T.LongType()))
def _exits(numbers: pd.Series, jumps: pd.Series) -> pd.Series:
    """Where the ways through a block come out, each row once."""
    return pd.Series([np.unique(j[_landings(n, j)[1]]) for n, j in zip(numbers, jumps)])


@F.pandas_udf(T.ArrayType(T.LongType()))
def _exits_of(numbers: pd.Series, jumps: pd.Series, entries: pd.Series) -> pd.Series:
    """Where the way from each entry comes out."""
    return pd.Series([j[_landings(n, j)[1][np.searchsorted(n, e)]] for n, j, e in zip(numbers, jumps, entries)])


@F.pandas_udf(T.ArrayType(T.LongType()))
def _ways(numbers: pd.Series, jumps: pd.Series, entries: pd.Series) -> pd.Series:
    """The rows on the ways from the entries to where they come out, these included."""
    found = []
    for n, j, e in zip(numbers, jumps, entries):
        step = _landings(n, j)[0].tolist()
        on: set[int] = set()
        for at in np.searchsorted(n, e).tolist():
            while at not in on:
                on.add(at)
                at = step[at]
        found.append(j[sorted(on)])
    return pd.Series(found)


def reached(jumps: DataFrame, log: list[str], rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Rows (log, _n) that are reached from row 1 of each log, row 1 left out.

    A log is cut into blocks of consecutive rows. Jumps lead forward, so within a block they can be followed to
    where they come out, and only rows where another block comes out can be entered: no more than the longest
    segment has, however long the block. The ways between these entries are doubled; then the blocks are
    followed again from the entries that are reached.
    """
    keys = [f"_b{i}" for i in range(len(log))]
    block = F.floor((F.col("_n") - 1) / rows_per_block)
    listed = F.array_sort(F.collect_list(F.struct("_n", "_next")))
    blocks = jumps.filter("_next IS NOT NULL").groupBy(*log, block.alias("_block")).agg(listed.alias("_rows"))
    blocks = pin(blocks.select(*log, "_block", F.col("_rows._n").alias("_numbers"), F.col("_rows._next").alias("_jumps")))
    firsts = blocks.filter("_block = 0").select(*log, F.col("_numbers")[0].alias("_n")).filter("_n = 1")
    exits = blocks.select(*log, F.explode(_exits("_numbers", "_jumps")).alias("_n"))

    def entered(rows: DataFrame) -> DataFrame:
        """Blocks with the rows at which they are entered; rows that lead nowhere are none."""
        entries = rows.groupBy(*[F.col(k).alias(n) for k, n in zip(log, keys)], block.alias("_of")).agg(F.collect_set("_n").alias("_entries"))
        held = blocks.join(entries, (F.col("_block") == F.col("_of")) & same_key(log, keys))
        return held.withColumn("_entries", F.array_sort(F.array_intersect("_entries", "_numbers"))).drop(*keys, "_of")

    inner = entered(exits.union(firsts))
    led = inner.withColumn("_to", _exits_of("_numbers", "_jumps", "_entries"))
    pairs = led.select(*log, F.explode(F.arrays_zip("_entries", "_to")).alias("_pair"))
    ways = pairs.select(*log, F.col("_pair._entries").alias("_n"), F.col("_pair._to").alias("_next"))
    found = followed(ways, log)
    return entered(found).select(*log, F.explode(_ways("_numbers", "_jumps", "_entries")).alias("_n"))


def log_cut(
    events: DataFrame,
    log: list[str],
    ts: str,
    tie: str,
    size: str,
    every: str = values.ROLLOVER_TIME,
    max_bytes: int = values.ROLLOVER_BYTES,
    rows_per_task: int = ROWS_PER_TASK,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Segments of each log as one writer would cut them; adds segment_no and segment_start.

    A row begins a new segment when ``every`` has passed since the segment's first row, or when the rows
    already in it hold ``max_bytes`` or more. Rows are taken in order of (``ts``, ``tie``), which must tell
    the rows of a log apart. Segments are counted from 0. A missing or negative size is 0 bytes; rows without
    a time belong to no segment and are left out. Null log keys are one log.
    """
    columns = events.columns
    sized = events.filter(F.col(ts).isNotNull()).withColumn("_size", F.greatest(F.lit(0), F.coalesce(F.col(size).cast("long"), F.lit(0))))
    counted = running(sized, log, [ts, tie], F.lit(1).cast("long"), "_n", "sum", rows_per_task)
    summed = pin(running(counted, log, [ts, tie], F.col("_size"), "_upto", "sum", rows_per_task))
    slim = summed.select(*log, ts, "_n", "_upto", "_size")
    cuts = reached(successors(slim, log, ts, "_size", every, max_bytes, rows_per_task), log, rows_per_block)
    keys = [f"_l{i}" for i in range(len(log))]
    cuts = cuts.select(*[F.col(k).alias(n) for k, n in zip(log, keys)], F.col("_n").alias("_m"))
    match = (F.col("_n") == F.col("_m")) & same_key(log, keys)
    begins = F.col("_m").isNotNull() | (F.col("_n") == 1)
    marked = summed.join(cuts, match, "left").withColumn("_begins", begins)
    named = running(marked, log, ["_n"], F.col("_begins").cast("long"), "segment_no", "sum", rows_per_task)
    first = F.when(F.col("_begins"), F.col(ts))
    dated = running(named, log, ["_n"], first, "segment_start", "max", rows_per_task)
    return dated.select(*columns, (F.col("segment_no") - 1).alias("segment_no"), "segment_start")
