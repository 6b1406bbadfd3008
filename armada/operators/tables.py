"""User components that take a table, keep state from row to row, and give any number of rows."""

from __future__ import annotations

import importlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = 10_000


def found(component: type | str) -> type:
    """A class, or the class that ``"module:Class"`` names in a file sent to the executors."""
    if not isinstance(component, str):
        return component
    module, _, name = component.partition(":")
    return getattr(importlib.import_module(module), name)


def register_component(spark: SparkSession, name: str, component: type | str, returns: str) -> None:
    """Make a component callable in SQL as a table function with a partitioned table argument.

    The class has ``process(row)``, called with a dictionary for each row of a partition in order, and may have
    ``finish()``, called after the last; both return rows (tuples in the order of ``returns``) or None. Each
    partition of the argument gets an instance of its own, so state never leaks from one key into another.
    Rows come in Arrow batches and are not gathered, so a partition may be of any length; what an instance
    keeps is its own matter.

        SELECT * FROM <name>(TABLE(t) PARTITION BY key ORDER BY ts)
    """
    import pyarrow as pa
    from pyspark.sql.functions import arrow_udtf
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(returns))

    class Component:
        def __init__(self):
            self.instance = found(component)()

        def _table(self, rows: list[tuple]) -> pa.Table:
            return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        def eval(self, table: pa.RecordBatch) -> Iterator[pa.Table]:
            rows: list[tuple] = []
            for row in table.to_pylist():
                rows.extend(self.instance.process(row) or ())
                if len(rows) >= BATCH_ROWS:
                    yield self._table(rows)
                    rows = []
            if rows:
                yield self._table(rows)

        def terminate(self) -> Iterator[pa.Table]:
            rows = list((self.instance.finish() if hasattr(self.instance, "finish") else None) or ())
            if rows:
                yield self._table(rows)

    spark.udtf.register(name, arrow_udtf(Component, returnType=returns))


def apply_table_component(rows: DataFrame, name: str, partition: list[str], order: list[str], take: list[str] | None = None) -> DataFrame:
    """Call a registered component on a table, one instance per value of ``partition``, rows in ``order``."""
    arg = rows.select(*take) if take else rows
    return arg.sparkSession.sql(
        f"SELECT * FROM {name}(TABLE({{t}}) PARTITION BY ({', '.join(f'`{c}`' for c in partition)}) ORDER BY {', '.join(f'`{c}`' for c in order)})", t=arg
    )
