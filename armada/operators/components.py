"""User components over tables."""

from __future__ import annotations

import importlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def process_records(df: DataFrame, col: str, name: str, out: str = "processed") -> DataFrame:
    """The built-in record processor."""
    return df.withColumn(out, F.concat(F.lit(f"Processed by {name}: "), F.col(col)))


def ship(spark: SparkSession, *files: str) -> None:
    """Make synced Python files importable on every executor."""
    spark.addArtifacts(*files, pyfile=True)


def apply_component(
    df: DataFrame, col: str, component: type | str, out: str = "processed"
) -> DataFrame:
    """Run a class with a ``process`` method over one column.

    ``component`` is a class, or ``"module:Class"`` naming one in a file sent by ``ship``. Each
    partition makes one instance; rows arrive in Arrow batches. The result column is text, null
    where ``process`` returns nothing.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = component
        if isinstance(found, str):
            module, _, name = found.partition(":")
            found = getattr(importlib.import_module(module), name)
        instance = found()
        for batch in batches:
            results = [instance.process(value) for value in batch[col]]
            texts = [None if r is None else str(r) for r in results]
            yield batch.assign(**{out: pd.Series(texts, index=batch.index, dtype="object")})

    return df.mapInPandas(run, schema)
