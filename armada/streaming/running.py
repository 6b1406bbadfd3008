"""Driving a stream to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame

from armada.session import new_path


def drain(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything its source holds and read the result back as a table."""
    spark = stream.sparkSession
    path = new_path(spark, label)
    query = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("checkpointLocation", f"{path}/progress")
        .option("path", f"{path}/rows")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
