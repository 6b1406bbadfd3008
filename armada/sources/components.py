"""Component files from a synced folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

BINARY_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def stream_components(
    spark: SparkSession,
    directory: str,
    kind: str = "text",
    glob: str | None = None,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """The files of a folder as a stream.

    ``text`` gives one row per line (``value``, ``path``), ``binaryFile`` one per file.
    """
    reader = spark.readStream.format(kind).option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if kind == "binaryFile":
        return reader.schema(BINARY_SCHEMA).load(directory)
    return reader.load(directory).select("value", F.col("_metadata.file_path").alias("path"))


def trigger(
    writer: DataStreamWriter, once: bool = False, every: str = "20 seconds"
) -> DataStreamWriter:
    """Run to completion once, or continuously on an interval."""
    if once:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=every)
