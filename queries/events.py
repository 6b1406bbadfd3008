"""Upkeep of component events."""

import os

from pyspark.sql import functions as F

from armada.operators import components, upkeep
from armada.operators.tables import apply_table_component, register_component
from armada.session import new_path
from armada.sources.layout import files_touched, write_curve
from armada.sources.segments import write_rolled
from armada.streaming.rollover import rollover_segments
from armada.streaming.snapshots import snapshot_last
from queries.registry import query, table

# The file a user's component comes in.
COMPONENT = os.path.join(os.path.dirname(os.path.abspath(__file__)), "sent", "measure_component.py")


@query(
    "p13_retain",
    """WITH e AS (SELECT event_id, ts, CASE event_type WHEN 'error' THEN 'node' WHEN 'view' THEN 'component'
        ELSE 'other' END AS kind, (SELECT max(ts) FROM events) AS as_of FROM events)
    SELECT event_id, ts, kind FROM e WHERE (kind = 'node' AND ts >= as_of - INTERVAL 14 DAY)
        OR (kind = 'component' AND ts >= as_of - INTERVAL 3 DAY)""",
)
def retain(spark, sf):
    kind = F.col("event_type")
    events = table(spark, sf, "events")
    as_of = events.agg(F.max("ts")).first()[0]
    named = events.select(
        "event_id", "ts",
        F.when(kind == "error", "node").when(kind == "view", "component").otherwise("other").alias("kind"),
    )
    return upkeep.retain(named, "ts", "kind", as_of)


@query(
    "p14_truncate_attributes",
    "SELECT doc_id, substr(text, 1, 5000) AS text, length(text) > 5000 AS text_cut FROM documents",
)
def truncate_attributes(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return upkeep.truncate_attributes(docs, "text", 5000)


@query(
    "p15_event_search",
    """SELECT * FROM events WHERE event_type = 'error' AND props = '{"k": 7}'""",
)
def event_search(spark, sf):
    return upkeep.event_search(table(spark, sf, "events"), event_type="error", props='{"k": 7}')


@query(
    "t1_snapshot_last",
    """SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS window_start, event_type,
        arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL""",
)
def snapshot(spark, sf):
    last = snapshot_last(table(spark, sf, "events"), "event_type", "value", "ts", "event_id")
    return last.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


SEGMENTS = """SELECT event_id, time_bucket(INTERVAL 10 MINUTE, ts) AS segment_start,
    CAST((sum(strlen(props)) OVER (PARTITION BY time_bucket(INTERVAL 10 MINUTE, ts) ORDER BY ts, event_id)
        - strlen(props)) // 20 AS BIGINT) AS segment_no FROM events"""


def segments(spark, sf):
    sized = table(spark, sf, "events").select(
        "event_id", "ts", F.octet_length("props").cast("long").alias("bytes")
    )
    return rollover_segments(sized, "ts", "event_id", "bytes", max_bytes=20)


@query("t2_rollover_segments", SEGMENTS)
def rollover(spark, sf):
    return segments(spark, sf).select("event_id", "segment_start", "segment_no")


@query(
    "s5_write_rolled",
    """SELECT event_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS segment_start, event_type FROM events""",
)
def rolled(spark, sf):
    """Daily segments written and read back."""
    path = new_path(spark, "rolled")
    events = table(spark, sf, "events").select(
        "event_id", "event_type", F.date_trunc("day", F.col("ts").cast("timestamp")).alias("segment_start")
    )
    write_rolled(events, path)
    read = spark.read.schema("event_id bigint, event_type string, segment_start timestamp").parquet(path)
    return read.withColumn("segment_start", F.col("segment_start").cast("timestamp_ntz"))


@query(
    "u1_process_records",
    "SELECT conv_id, turn, 'Processed by audit: ' || text AS processed FROM conversations",
)
def process_records(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return components.process_records(turns, "text", "audit").drop("text")


@query(
    "u2_apply_component",
    "SELECT conv_id, turn, 'Measure: ' || length(text) AS processed FROM conversations",
)
def apply_component(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    components.ship(spark, COMPONENT)
    done = components.apply_component(turns, "text", "measure_component:Measure")
    return done.select("conv_id", "turn", "processed")


def curve_table(spark, sf):
    """The events laid out over four fields."""
    path = new_path(spark, "curve")
    write_curve(table(spark, sf, "events"), path, ["event_type", "user_id", "ts", "value"], 32)
    return spark.read.parquet(path)


@query("p15_curve_search", "SELECT * FROM events WHERE user_id = 7")
def curve_search(spark, sf):
    return upkeep.event_search(curve_table(spark, sf), user_id=7)


@query(
    "p15_curve_pruning",
    "SELECT * FROM (VALUES ('event_type', TRUE), ('user_id', TRUE), ('value', TRUE)) t(field, skips_a_third)",
)
def curve_pruning(spark, sf):
    """Of a search by each field, whether the files' statistics leave at most two thirds to read."""
    laid = curve_table(spark, sf)
    middle = laid.agg(F.percentile_approx("value", 0.5).alias("v"), F.max("user_id").alias("u")).first()
    asked = {"event_type": F.lit("error"), "user_id": F.lit(middle["u"] // 2), "value": F.lit(middle["v"])}
    found = None
    for field, value in asked.items():
        row = files_touched(laid, field, value).select(
            F.lit(field).alias("field"), (F.col("touched") * 3 <= F.col("files") * 2).alias("skips_a_third")
        )
        found = row if found is None else found.union(row)
    return found


class TurnGaps:
    """Per conversation, in order of turns: length so far, and a closing row with the number of turns."""

    def __init__(self):
        self.turns, self.length, self.key = 0, 0, None

    def process(self, row):
        self.turns, self.length, self.key = self.turns + 1, self.length + len(row["text"] or ""), row["conv_id"]
        return [(self.key, row["turn"], self.length)]

    def finish(self):
        return [(self.key, -self.turns, self.length)] if self.turns else None


@query(
    "u2_table_component",
    """SELECT conv_id, turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS length FROM conversations
    UNION ALL SELECT conv_id, -count(*), CAST(sum(length(text)) AS BIGINT) FROM conversations GROUP BY conv_id""",
)
def table_component(spark, sf):
    """A component that keeps state over an ordered table and gives more rows than it takes."""
    register_component(spark, "turn_lengths", TurnGaps, "conv_id bigint, turn bigint, length bigint")
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return apply_table_component(turns, "turn_lengths", ["conv_id"], ["turn"])
