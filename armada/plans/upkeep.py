"""Jobs about events, history and user components."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from armada import values
from armada.operators.components import apply_component
from armada.operators.ordered import ROWS_PER_TASK
from armada.operators.rendering import explode_lines
from armada.operators.sequences import budget_keep, history_cap
from armada.operators.upkeep import retain, truncate_attributes
from armada.sources.records import to_json_records
from armada.sources.segments import write_rolled
from armada.streaming.rollover import rollover_segments


def event_upkeep(
    events: DataFrame,
    as_of: datetime,
    days_by_class: dict[str, int] | None = None,
    points: int = values.HISTORY_POINTS,
    attribute_length: int = values.ATTRIBUTE_LENGTH,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Events left after retention, the history cap and cutting of long attributes.

    ``events`` has (id, ts, component, kind, attributes).
    """
    kept = retain(events, "ts", "kind", as_of, days_by_class)
    capped = history_cap(kept, "component", ["-ts", "-id"], points, rows_per_task)
    return truncate_attributes(capped, "attributes", attribute_length)


def archive(
    events: DataFrame,
    path: str,
    capacity: int,
    ratio: float = values.ARCHIVE_RATIO,
    every: str = values.ROLLOVER_TIME,
    max_bytes: int = values.ROLLOVER_BYTES,
    rows_per_task: int = ROWS_PER_TASK,
) -> None:
    """Write the newest events that fit each component's budget, rolled by time and size.

    ``events`` has (id, ts, component, size).
    """
    kept = budget_keep(events, "component", ["-ts", "-id"], "size", capacity, ratio, rows_per_task)
    rolled = rollover_segments(
        kept.drop("running_size"), "ts", "id", "size", every, max_bytes, rows_per_task
    )
    write_rolled(rolled, path)


def component_run(files: DataFrame, col: str, component: type | str) -> DataFrame:
    """User processors over the lines of synced files, as JSON records."""
    return to_json_records(apply_component(explode_lines(files, col), "line", component))
