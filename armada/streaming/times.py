"""Event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Late rows are waited for this long unless a call says otherwise.
DELAY = "10 minutes"


def with_event_time(df: DataFrame, ts: str, delay: str = DELAY) -> DataFrame:
    """Set the watermark; a timestamp without time zone is read in the session's zone first."""
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df.withWatermark(ts, delay)
