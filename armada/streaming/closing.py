"""Rows of a stream handed on once their time window is closed.

Rows wait in files by batch, so nothing is held in executor memory however many rows a window or
a key has, and a batch operator that is safe for large groups can take over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ClosedWindows:
    """Collects rows per tumbling window and gives them back when the window closes.

    A window closes when the latest event time so far has passed its end by ``delay``. Rows of a
    window that was closed by an earlier batch are late and dropped. All writes replace what the
    same batch wrote before, so running a batch again gives the same rows.

    ``<path>/waiting/<batch>`` holds the rows of a batch, sorted by time so that a read for closed
    windows skips the rest. ``<path>/marks/<batch>`` holds the latest event time and the batches
    that still have open windows; the folders of all others are not needed any more.
    """

    def __init__(self, path: str, ts: str, every: str, delay: str):
        self.path, self.ts, self.every, self.delay = path, ts, every, delay

    def _marks(self, like: DataFrame, batch: int) -> DataFrame:
        kind = like.schema[self.ts].dataType
        schema = T.StructType(
            [
                T.StructField("latest", kind),
                T.StructField("batch", T.LongType()),
                T.StructField("last_end", kind),
            ]
        )
        spark = like.sparkSession
        if batch < 0:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{self.path}/marks/{batch}")

    def take(self, rows: DataFrame, batch: int) -> DataFrame:
        """Store a batch and return the rows, of any batch, whose window it closes."""
        spark = rows.sparkSession
        end = F.window(self.ts, self.every)["end"]
        wait = F.expr(f"INTERVAL {self.delay}")

        earlier = self._marks(rows, batch - 1)
        previous = earlier.agg((F.max("latest") - wait).alias("w")).first()["w"]
        late = F.lit(False) if previous is None else end <= F.lit(previous)
        waiting = f"{self.path}/waiting"
        rows.filter(~late).sortWithinPartitions(self.ts).write.mode("overwrite").option(
            "compression", "zstd"
        ).parquet(f"{waiting}/{batch}")

        stored = spark.read.schema(rows.schema).parquet(f"{waiting}/{batch}")
        own = stored.agg(
            F.max(self.ts).alias("latest"),
            F.lit(batch).cast("long").alias("batch"),
            F.max(end).alias("last_end"),
        )
        # One row per batch that still has open windows: a handful, read once to the driver.
        known = earlier.unionByName(own).collect()
        times = [r["latest"] for r in known if r["latest"] is not None]
        latest = max(times) if times else None
        if latest is None:
            limit, marked = None, [(None, batch, None)]
        else:
            one = spark.createDataFrame([(latest,)], T.StructType(earlier.schema.fields[:1]))
            limit = one.select((F.col("latest") - wait).alias("w")).first()["w"]
            marked = [
                (latest, r["batch"], r["last_end"])
                for r in known
                if r["batch"] == batch or (r["last_end"] is not None and r["last_end"] > limit)
            ]
        spark.createDataFrame(marked, earlier.schema).coalesce(1).write.mode("overwrite").parquet(
            f"{self.path}/marks/{batch}"
        )
        if limit is None:
            return stored.filter(F.lit(False))

        paths = [f"{waiting}/{r['batch']}" for r in known]
        closed = end <= F.lit(limit)
        if previous is not None:
            closed = closed & (end > F.lit(previous))
        # The bare time column lets the scan skip row groups.
        closed = closed & (F.col(self.ts) < F.lit(limit))
        return spark.read.schema(rows.schema).parquet(*paths).filter(closed)


def replace_partitions(rows: DataFrame, target: str, *by: str) -> None:
    """Write Parquet, replacing exactly the partitions the rows belong to."""
    (
        rows.hint("rebalance", by[0])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy(*by)
        .parquet(target)
    )
