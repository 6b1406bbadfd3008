"""Streams over the driver's tables, run to their end and read back."""

from pyspark.sql import functions as F

from armada.session import new_path
from armada.sources import synced
from armada.sources.components import stream_components
from armada.streaming.alerts import failure_alerts, read_alerts
from armada.streaming.heartbeats import expected_health, heartbeats
from armada.streaming.running import drain
from armada.streaming.snapshots import snapshot_last, stream_health
from armada.streaming.stateful import state_alerts
from queries.registry import query, table


def event_stream(spark, sf):
    """The events table as a file stream; the glob keeps the other tables of the folder out."""
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@query(
    "s4_stream_components",
    """SELECT line AS value, CAST(count(*) AS BIGINT) AS n FROM (
        SELECT unnest(string_split(text, chr(10))) AS line FROM documents)
    WHERE line <> '' GROUP BY line""",
)
def components(spark, sf):
    """Documents as files of a folder, taken in once to completion."""
    path = new_path(spark, "folder")
    table(spark, sf, "documents").select("text").write.text(path)
    lines = drain(stream_components(spark, path), "components")
    return lines.filter("value <> ''").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query(
    "t1_snapshot_stream",
    """SELECT * FROM (SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS window_start, event_type,
        arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL)
    WHERE window_start + INTERVAL 1 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""",
)
def snapshot_stream(spark, sf):
    last = snapshot_last(event_stream(spark, sf), "event_type", "value", "ts", "event_id")
    done = drain(last, "snapshots")
    return done.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "t3_failure_alerts",
    """WITH closed AS (SELECT *, event_type <> 'error' AS ok FROM events
        WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR
            <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)),
    marked AS (SELECT user_id, ts, event_id, ok, count(*) FILTER (ok)
        OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM closed),
    placed AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS place
        FROM marked WHERE NOT ok)
    SELECT user_id AS target, ts AS alert_at FROM placed WHERE place = 3""",
)
def alerts(spark, sf):
    probes = event_stream(spark, sf).withColumn("ok", F.col("event_type") != "error")
    path = new_path(spark, "alerts")
    writer = failure_alerts(probes, path, "user_id", "ts", "event_id", "ok", 3, every="1 hour")
    writer.trigger(availableNow=True).start().awaitTermination()
    found = read_alerts(spark, path)
    return found.withColumn("alert_at", F.col("alert_at").cast("timestamp_ntz"))


@query(
    "t4_stream_health",
    """WITH last AS (SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS window_start, user_id AS custkey,
        arg_max(event_type, (ts, event_id)) AS kind FROM events GROUP BY ALL)
    SELECT window_start, custkey, CAST(c_nationkey % 3 AS BIGINT) AS expected_nodes,
        CAST(1 AS BIGINT) AS nodes,
        CASE kind WHEN 'error' THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS bad_nodes,
        CASE WHEN c_nationkey % 3 <> 1 THEN 'count_mismatch' WHEN kind = 'error' THEN 'not_connected'
            ELSE 'healthy' END AS reason,
        c_nationkey % 3 = 1 AND kind <> 'error' AS healthy,
        CASE WHEN c_nationkey % 3 = 1 AND kind <> 'error' THEN ''
            ELSE 'n' || custkey || '=' || CASE kind WHEN 'error' THEN 'LOST' ELSE 'CONNECTED' END END
            AS offenders
    FROM last JOIN customer ON c_custkey = custkey
    WHERE window_start + INTERVAL 1 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""",
)
def health_stream(spark, sf):
    node = F.struct(
        F.concat(F.lit("n"), F.col("user_id").cast("string")).alias("address"),
        F.when(F.col("event_type") == "error", "LOST").otherwise("CONNECTED").alias("status"),
    )
    body = F.to_json(F.struct(F.struct(F.array(node).alias("nodes")).alias("cluster")))
    bodies = event_stream(spark, sf).select(
        F.col("user_id").alias("custkey"), "ts", "event_id", body.alias("body")
    )
    expected = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("custkey"),
        (F.col("c_nationkey") % 3).cast("long").alias("expected_nodes"),
    )
    stream = stream_health(bodies, expected, "custkey", "body", "ts", "event_id", every="1 minute")
    done = drain(stream, "health")
    return done.withColumns(
        {
            "window_start": F.col("window_start").cast("timestamp_ntz"),
            "offenders": F.array_join("offenders", ","),
        }
    )


@query(
    "t3_state_alerts",
    """WITH closed AS (SELECT user_id, ts, event_id, event_type <> 'error' AS ok,
            ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap
        FROM events WHERE ts <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM events)),
    marked AS (SELECT *, sum(CASE WHEN ok OR gap > INTERVAL 12 HOUR THEN 1 ELSE 0 END)
        OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM closed),
    placed AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS place FROM marked WHERE NOT ok)
    SELECT user_id AS target, ts AS alert_at FROM placed WHERE place = 2""",
)
def keyed_alerts(spark, sf):
    """Two failures in a row, none of them half a day after the last probe."""
    probes = event_stream(spark, sf).withColumn("ok", F.col("event_type") != "error")
    found = drain(state_alerts(probes, "user_id", "ts", "event_id", "ok", 2, quiet="12 hours"), "state-alerts")
    return found.withColumn("alert_at", F.col("alert_at").cast("timestamp_ntz"))


@query(
    "t4_expected_health",
    """WITH days AS (SELECT DISTINCT time_bucket(INTERVAL 1 DAY, ts) AS window_start FROM events
            WHERE time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)),
    last AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, user_id AS custkey,
        arg_max(event_type, (ts, event_id)) AS kind FROM events GROUP BY ALL)
    SELECT days.window_start, c_custkey AS custkey, CAST(c_nationkey % 3 AS BIGINT) AS expected_nodes,
        CAST(CASE WHEN kind IS NULL THEN 0 ELSE 1 END AS BIGINT) AS nodes,
        CAST(CASE kind WHEN 'error' THEN 1 ELSE 0 END AS BIGINT) AS bad_nodes,
        CASE WHEN kind IS NULL THEN 'no_response' WHEN c_nationkey % 3 <> 1 THEN 'count_mismatch'
            WHEN kind = 'error' THEN 'not_connected' ELSE 'healthy' END AS reason,
        coalesce(c_nationkey % 3 = 1 AND kind <> 'error', FALSE) AS healthy
    FROM days CROSS JOIN customer LEFT JOIN last ON last.window_start = days.window_start AND last.custkey = c_custkey""",
)
def expected_stream(spark, sf):
    """Every cluster in every day, also those that say nothing."""
    events = table(spark, sf, "events")
    expected = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("custkey"), (F.col("c_nationkey") % 3).alias("expected_nodes")
    )
    first, last = events.agg(F.min("ts").cast("timestamp"), F.max("ts").cast("timestamp")).first()
    day = lambda t: F.date_trunc("day", F.lit(t))
    path = new_path(spark, "beats")
    # Sent ahead by two windows: time passes for both streams only as far as the slower one has come.
    beats = heartbeats(expected, "custkey", day(first), day(last) + F.expr("INTERVAL 2 DAYS"), "1 day")
    beats.write.parquet(path)
    node = F.struct(
        F.concat(F.lit("n"), F.col("user_id").cast("string")).alias("address"),
        F.when(F.col("event_type") == "error", "LOST").otherwise("CONNECTED").alias("status"),
    )
    body = F.to_json(F.struct(F.struct(F.array(node).alias("nodes")).alias("cluster")))
    bodies = event_stream(spark, sf).select(F.col("user_id").alias("custkey"), "ts", "event_id", body.alias("body"))
    beat_stream = spark.readStream.schema(beats.schema).parquet(path)
    found = drain(expected_health(beat_stream, bodies, "custkey", "body", "ts", "event_id", every="1 day"), "expected-health")
    return found.drop("offenders").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "s4_changed_files",
    """SELECT s_suppkey AS custkey, CAST(pos AS INTEGER) AS pos, CASE pos WHEN 0 THEN s_name ELSE 'first' END AS value
    FROM supplier CROSS JOIN (VALUES (0), (1)) t(pos)
    UNION ALL SELECT s_suppkey, 0, 'changed to ' || s_nationkey FROM supplier WHERE s_acctbal < 0""",
)
def changed_files(spark, sf):
    """One file per supplier; some are written again under their names, and delivered again."""
    folder, state, out = new_path(spark, "synced"), new_path(spark, "synced-state"), new_path(spark, "synced-rows")
    suppliers = table(spark, sf, "supplier").withColumn("name", F.concat(F.col("s_suppkey").cast("string"), F.lit(".txt")))
    stream = synced.stream_synced(spark, folder, state, ".txt")

    def run():
        writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{out}/progress").option("path", f"{out}/rows")
        writer.trigger(availableNow=True).start().awaitTermination()

    synced.write_files(suppliers.select("name", F.concat("s_name", F.lit("\nfirst\n")).alias("content")), folder)
    run()
    again = F.concat(F.lit("changed to "), F.col("s_nationkey").cast("string"), F.lit("\n")).alias("content")
    synced.write_files(suppliers.filter("s_acctbal < 0").select("name", again), folder)
    run()
    rows = synced.lines(spark.read.schema(stream.schema).parquet(f"{out}/rows"))
    key = F.regexp_extract("path", r"([0-9]+)\.txt$", 1).cast("bigint")
    return rows.select(key.alias("custkey"), "pos", "value")
