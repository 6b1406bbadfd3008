"""Event segments by time and size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armada import values
from armada.operators.ordered import ROWS_PER_TASK, running
from armada.streaming.closing import ClosedWindows, replace_partitions
from armada.streaming.times import DELAY


def rollover_segments(
    events: DataFrame,
    ts: str,
    tie: str,
    size: str,
    every: str = values.ROLLOVER_TIME,
    max_bytes: int = values.ROLLOVER_BYTES,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """segment = tumbling window, and within it the bytes before the row over the cap.

    ``size`` is the column with a row's bytes. A row goes into the segment its first byte falls
    into, so the number follows from the data alone and no row waits for another. A row without a
    size has 0 bytes.
    """
    start = F.window(ts, every)["start"]
    placed = events.withColumn("segment_start", start)
    summed = running(
        placed, ["segment_start"], [ts, tie], F.col(size).cast("long"), "_upto", "sum", rows_per_task
    )
    before = F.col("_upto") - F.coalesce(F.col(size).cast("long"), F.lit(0))
    return summed.withColumn("segment_no", F.floor(before / max_bytes).cast("long")).drop("_upto")


def roll_closed_windows(
    path: str,
    ts: str,
    tie: str,
    size: str,
    every: str = values.ROLLOVER_TIME,
    delay: str = DELAY,
    max_bytes: int = values.ROLLOVER_BYTES,
    rows_per_task: int = ROWS_PER_TASK,
) -> Callable[[DataFrame, int], None]:
    """T2 on a stream: a ``foreachBatch`` function that rolls each window once it is closed.

    Closed windows are cut like a table and written to ``<path>/segments``, one folder each. A
    repeated batch writes the same folders again.
    """
    windows = ClosedWindows(path, ts, every, delay)

    def handle(batch_rows: DataFrame, batch: int) -> None:
        closed = windows.take(batch_rows, batch)
        cut = rollover_segments(closed, ts, tie, size, every, max_bytes, rows_per_task)
        replace_partitions(cut, f"{path}/segments", "segment_start")

    return handle
