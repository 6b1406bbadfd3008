"""Rolled event segments on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame

from armada import values

# Rows per file at most; a guard, since the size of a file follows from the rebalanced partitions.
RECORDS_PER_FILE = 5_000_000


def write_rolled(
    df: DataFrame,
    path: str,
    segment: str = "segment_start",
    mode: str = "append",
    records_per_file: int = RECORDS_PER_FILE,
) -> None:
    """Compressed Parquet with one directory per time segment.

    Rows are rebalanced by segment before writing, which gives few files per segment and cuts a
    very large segment over several tasks.
    """
    (
        df.hint("rebalance", segment)
        .write.mode(mode)
        .option("compression", "zstd")
        .option("maxRecordsPerFile", records_per_file)
        .partitionBy(segment)
        .parquet(path)
    )


def write_searchable(
    df: DataFrame,
    path: str,
    cluster_by: list[str],
    fields: tuple[str, ...] = values.EVENT_FIELDS,
    mode: str = "append",
) -> None:
    """Events laid out for ``event_search``.

    Rows are range-partitioned and sorted by ``cluster_by`` (the most searched field, then a time
    or id that cuts frequent values), so minimum and maximum skip most row groups; the other
    fields get bloom filters.
    """
    writer = df.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by).write.mode(mode)
    for field in fields:
        if field in df.columns and field != cluster_by[0]:
            writer = writer.option(f"parquet.bloom.filter.enabled#{field}", "true")
    writer.option("compression", "zstd").parquet(path)
