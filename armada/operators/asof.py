"""As-of joins: each row meets the version that was in force at its time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armada.operators.ordered import ROWS_PER_TASK, running


def in_force(
    rows: DataFrame,
    versions: DataFrame,
    keys: list[str],
    ts: str,
    since: str,
    take: list[str],
    tie: str | None = None,
    until: str | None = None,
    before: bool = False,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """All ``rows``, each with ``since`` and the ``take`` columns of the latest version of its key.

    A version holds from its time ``since`` (that moment included, unless ``before``) until the next one of
    the key; of several of one time the greatest by ``tie``, then by the taken columns. With ``until`` (a
    column of the versions) it may end earlier; then nothing is in force. Rows before the first version,
    and rows without time, keep nulls. Versions without time are never in force. Null keys are a key.

    Rows and versions go in one order of key and time, and the latest version is carried along it. A hot
    key is cut into slices of that order; what a slice carries into the next is one row, so neither its
    rows nor its versions ever meet in one task, and no row is paired with more than one version.
    """
    columns = rows.columns
    kept = [since, *([tie] if tie else []), *[c for c in take if c != since], *([until] if until and until not in take else [])]
    own = rows.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_own"), *_keyed(keys), F.col(ts).alias("_at"))
    other = versions.filter(F.col(since).isNotNull()).select(
        F.struct(*kept).alias("_version"), *_keyed(keys), F.col(since).cast(rows.schema[ts].dataType).alias("_at")
    )
    side = F.lit(0).alias("_side"), F.lit(1).alias("_side")
    late, early = (side[1], side[0]) if before else (side[0], side[1])
    # Of one time, versions come before the rows that they already hold for.
    every = own.select("*", early).unionByName(other.select("*", late), allowMissingColumns=True)
    names = [f"_k{i}" for i in range(len(keys))]
    carried = running(every, names, ["_at", "_side"], F.col("_version"), "_held", "max", rows_per_task)
    held = F.when(F.col("_at").isNotNull(), F.col("_held"))
    if until:
        held = F.when(F.col("_held")[until].isNull() | (F.col("_at") < F.col("_held")[until]), held)
    return carried.filter(F.col("_own").isNotNull()).select(
        *[F.col("_own")[c].alias(c) for c in columns],
        *[held[c].alias(c) for c in dict.fromkeys([since, *take]) if c not in columns],
    )


def _keyed(keys: list[str]) -> list[Column]:
    return [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]


def changes(versions: DataFrame, keys: list[str], since: str, watch: list[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Versions that differ from the one before in a watched column, with the ``previous`` values as a struct."""
    before = in_force(
        versions, versions.select(*keys, since, *watch).withColumnsRenamed({c: f"_was_{c}" for c in [since, *watch]}),
        keys, since, f"_was_{since}", [f"_was_{c}" for c in watch], before=True, rows_per_task=rows_per_task,
    )
    same = F.lit(True)
    for c in watch:
        same = same & F.col(c).eqNullSafe(F.col(f"_was_{c}"))
    first = F.col(f"_was_{since}").isNull()
    return before.filter(first | ~same).select(
        *versions.columns, F.when(~first, F.struct(*[F.col(f"_was_{c}").alias(c) for c in watch])).alias("previous")
    )
