"""Retention, truncation and search over component events."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armada import values


def retain(
    df: DataFrame,
    ts: str,
    kind: str,
    as_of: datetime,
    days_by_class: dict[str, int] | None = None,
) -> DataFrame:
    """Keep rows not older than the days allowed for their class.

    A class without an entry is not kept. The cutoffs are constants, so the widest one reaches the
    scan and whole files drop out by their minimum and maximum.
    """
    days_by_class = days_by_class or values.RETENTION_DAYS
    kind_of_ts = df.schema[ts].dataType

    def cutoff(days: int) -> Column:
        return F.lit((as_of - timedelta(days=days)).isoformat(sep=" ")).cast(kind_of_ts)

    widest = F.col(ts) >= cutoff(max(days_by_class.values()))
    each = F.lit(False)
    for name, days in days_by_class.items():
        each = each | ((F.col(kind) == name) & (F.col(ts) >= cutoff(days)))
    return df.filter(widest & each)


def truncate_attributes(
    df: DataFrame, col: str, limit: int = values.ATTRIBUTE_LENGTH
) -> DataFrame:
    """Cut a text to ``limit`` characters and flag the rows that were cut."""
    return df.withColumn(f"{col}_cut", F.coalesce(F.length(col) > limit, F.lit(False))).withColumn(
        col, F.substring(col, 1, limit)
    )


def event_search(df: DataFrame, **fields) -> DataFrame:
    """Rows equal to every given field; the comparisons reach the Parquet scan."""
    for name, value in fields.items():
        df = df.filter(F.col(name) == F.lit(value))
    return df
