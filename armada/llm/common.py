"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armada.session import new_path

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
WORD = r"[^\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write rows to the shared folder and go on from the files, which any executor can read."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Inside, what a query has shuffled is removed as it ends, not when the driver next collects its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


class Scratch:
    """Intermediate tables of one operator, removed once its result is written; shuffle files go with each write."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def __call__(self, df: DataFrame, label: str) -> DataFrame:
        path = new_path(self.spark, label)
        self.paths.append(path)
        with shuffles_dropped(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def free(self, *labels: str) -> None:
        """Remove the tables of these labels, of which nothing is read any more."""
        configuration = self.spark._jsc.hadoopConfiguration()
        for path in [p for p in self.paths if p.rsplit("/", 1)[1].rsplit("-", 1)[0] in labels]:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(configuration).delete(place, True)
            self.paths.remove(path)

    def result(self, df: DataFrame, label: str) -> DataFrame:
        """Write the result to a table that stays, and remove the others."""
        with shuffles_dropped(self.spark):
            kept = staged(df, label)
        self.free(*(p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in self.paths))
        return kept


def lower_ascii(column):
    return F.translate(column, ASCII_UPPER, ASCII_LOWER)


def share_of(column, salt: str):
    """A number in [0, 1) that depends on the value and the salt alone."""
    return (F.pmod(F.xxhash64(F.lit(salt), column), F.lit(1 << 30)) / F.lit(float(1 << 30)))


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers over all 64 bits."""
    x = values.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def odd_multipliers(count: int, seed: int = 1) -> np.ndarray:
    return mixed(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def gram_hashes(values: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each run of n consecutive values."""
    count = len(values) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    spread = mixed(values)
    total = np.zeros(count, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i, m in enumerate(odd_multipliers(n, seed)):
            total += spread[i : i + count] * m
    return mixed(total)


def tables(batches: Iterator[pa.RecordBatch], at_most: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each slice holds about ``at_most`` bytes, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = max(1, int(batch.num_rows * at_most / max(1, batch.nbytes)))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
