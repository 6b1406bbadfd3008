"""Logs, versions in force, outages and distributions over the events table."""

from pyspark.sql import functions as F

from armada.operators import asof, distributions, outages
from armada.operators.logcut import log_cut
from armada.session import new_path
from queries import fleet
from queries.registry import query, table


@query(
    "t2_log_cut",
    """WITH RECURSIVE e AS (SELECT event_type AS log, event_id, ts,
            row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n,
            sum(strlen(props)) OVER (PARTITION BY event_type ORDER BY ts, event_id) - strlen(props) AS before FROM events),
    cut AS (SELECT log, n, ts, before FROM e WHERE n = 1
        UNION ALL SELECT e.log, e.n, e.ts, e.before FROM (
            SELECT c.log, min(f.n) AS n FROM cut c JOIN e f ON f.log = c.log AND f.n > c.n
                AND (f.ts >= c.ts + INTERVAL 2 HOUR OR f.before >= c.before + 40) GROUP BY c.log) m
            JOIN e ON e.log = m.log AND e.n = m.n)
    SELECT e.event_id, CAST(count(*) - 1 AS BIGINT) AS segment_no, max(cut.ts) AS segment_start
    FROM e JOIN cut ON cut.log = e.log AND cut.n <= e.n GROUP BY e.event_id""",
)
def cut_logs(spark, sf):
    sized = table(spark, sf, "events").select("event_id", "event_type", "ts", F.octet_length("props").alias("bytes"))
    cut = log_cut(sized, ["event_type"], "ts", "event_id", "bytes", "2 hours", 40)
    return cut.select("event_id", "segment_no", "segment_start")


@query(
    "w2_specs_in_force",
    """WITH specs AS (SELECT user_id, ts AS since, event_id AS no, value AS allowed FROM events WHERE event_type = 'signup')
    SELECT e.event_id, e.user_id, s.since, s.allowed, e.value > s.allowed AS broken
    FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN specs s ON e.user_id = s.user_id AND e.ts >= s.since""",
)
def specs_in_force(spark, sf):
    """Failures judged by the specification that was in force when they happened."""
    events = table(spark, sf, "events")
    specs = events.filter("event_type = 'signup'").select("user_id", F.col("ts").alias("since"), F.col("event_id").alias("no"), F.col("value").alias("allowed"))
    failures = events.filter("event_type = 'error'").select("event_id", "user_id", "ts", "value")
    held = asof.in_force(failures, specs, ["user_id"], "ts", "since", ["allowed"], tie="no")
    return held.select("event_id", "user_id", "since", "allowed", (F.col("value") > F.col("allowed")).alias("broken"))


SESSIONS = """failed AS (SELECT user_id AS target, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap
        FROM events WHERE event_type = 'error'),
    marked AS (SELECT *, sum(CASE WHEN gap <= INTERVAL 6 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY target ORDER BY ts) AS no FROM failed),
    sessions AS (SELECT target, min(ts) AS down_from, max(ts) + INTERVAL 6 HOUR AS down_until, count(*) AS failures
        FROM marked GROUP BY target, no)"""


@query("w3_failure_sessions", f"WITH {SESSIONS} SELECT target, down_from, down_until, CAST(failures AS BIGINT) AS failures FROM sessions")
def failure_sessions(spark, sf):
    found = outages.failure_sessions(fleet.probes(spark, sf), "target", "ts", "ok", "6 hours")
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("down_from", "down_until")})


@query(
    "w3_fleet_outages",
    f"""WITH {SESSIONS}, steps AS (SELECT "at", sum(step) AS step FROM (SELECT down_from AS "at", 1 AS step FROM sessions
            UNION ALL SELECT down_until, -1 FROM sessions) GROUP BY "at" HAVING sum(step) <> 0)
    SELECT "at", lead("at") OVER (ORDER BY "at") AS until, CAST(sum(step) OVER (ORDER BY "at") AS BIGINT) AS down FROM steps""",
)
def fleet_outages(spark, sf):
    """How many targets are down at once, over the whole history."""
    sessions = outages.failure_sessions(fleet.probes(spark, sf), "target", "ts", "ok", "6 hours")
    swept = outages.down_at_once(sessions)
    return swept.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("at", "until")})


@query(
    "a3_distributions",
    """SELECT event_type, CAST(count(value) AS BIGINT) AS n, TRUE AS median_holds, TRUE AS high_holds, TRUE AS distinct_holds
    FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' GROUP BY event_type""",
)
def distribution(spark, sf):
    """Daily sketches stored, merged over a range, and held against the exact ranks and counts."""
    events = table(spark, sf, "events")
    path = new_path(spark, "sketches")
    distributions.segment_sketches(events, ["event_type"], "ts", "1 day", F.col("value"), F.col("user_id")).write.parquet(path)
    start, end = (F.lit(f"2024-01-{day}").cast("timestamp") for day in ("05", "20"))
    merged = distributions.merged(spark.read.parquet(path), ["event_type"], start, end)
    asked = distributions.quantiles(merged, ["event_type"], [0.5, 0.9]).groupBy("event_type", "n", "n_distinct").pivot("rank", [0.5, 0.9]).agg(F.first("value"))
    named = asked.select("event_type", "n", "n_distinct", F.col("`0.5`").alias("median"), F.col("`0.9`").alias("high"))
    within = events.filter((F.col("ts") >= F.lit("2024-01-05")) & (F.col("ts") < F.lit("2024-01-20"))).join(named, "event_type")
    exact = within.groupBy("event_type", "n", "n_distinct").agg(
        F.avg((F.col("value") <= F.col("median")).cast("int")).alias("_median"), F.avg((F.col("value") <= F.col("high")).cast("int")).alias("_high"),
        F.count_distinct("user_id").alias("_distinct"),
    )
    return exact.select(
        "event_type", "n", (F.abs(F.col("_median") - 0.5) < 0.03).alias("median_holds"), (F.abs(F.col("_high") - 0.9) < 0.03).alias("high_holds"),
        (F.abs(F.col("n_distinct") - F.col("_distinct")) <= 0.08 * F.col("_distinct")).alias("distinct_holds"),
    )
