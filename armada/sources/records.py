"""Rows as JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_json_records(
    df: DataFrame, names: dict[str, str] | None = None, out: str = "record"
) -> DataFrame:
    """Each row as one JSON object; ``names`` maps columns to field names, in output order."""
    names = names or {c: c for c in df.columns}
    fields = [F.col(c).alias(n) for c, n in names.items()]
    text = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return df.select(text.alias(out))
