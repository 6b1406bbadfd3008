"""Health, readiness and membership."""

from pyspark.sql import functions as F

from armada.operators import drift, health, scraping, sequences
from queries import fleet
from queries.registry import query, table

HEALTH = f"""WITH {fleet.NODES}, {fleet.EXPECTED}, seen AS (
    SELECT custkey, count(*) AS nodes, count(*) FILTER (status <> 'CONNECTED') AS bad_nodes
    FROM nodes GROUP BY custkey), health AS (
    SELECT e.custkey, CAST(e.expected_nodes AS BIGINT) AS expected_nodes,
        CAST(coalesce(s.nodes, 0) AS BIGINT) AS nodes,
        CAST(coalesce(s.bad_nodes, 0) AS BIGINT) AS bad_nodes,
        CASE WHEN coalesce(s.nodes, 0) <> e.expected_nodes THEN 'count_mismatch'
            WHEN s.bad_nodes > 0 THEN 'not_connected' ELSE 'healthy' END AS reason
    FROM expected e LEFT JOIN seen s ON s.custkey = e.custkey)"""


@query("a1_cluster_health", HEALTH + " SELECT *, reason = 'healthy' AS healthy FROM health")
def cluster_health(spark, sf):
    return health.cluster_health(
        fleet.nodes(spark, sf), fleet.expected_nodes(spark, sf), "custkey"
    )


@query(
    "a1_cluster_offenders",
    HEALTH
    + """ SELECT n.custkey, h.reason, n.node || '=' || n.status AS offender,
        CAST(count(*) AS BIGINT) AS reports
    FROM nodes n JOIN health h ON h.custkey = n.custkey
    WHERE h.reason = 'count_mismatch' OR (h.reason = 'not_connected' AND n.status <> 'CONNECTED')
    GROUP BY ALL""",
)
def cluster_offenders(spark, sf):
    return health.cluster_offenders(
        fleet.nodes(spark, sf), cluster_health(spark, sf), "custkey"
    )


@query(
    "s2_explode_nodes",
    """SELECT o_orderkey, x.node, x.status FROM (
        SELECT o_orderkey, 'host-' || o_orderkey AS node,
            CASE o_orderstatus WHEN 'P' THEN 'CONNECTING' ELSE 'CONNECTED' END AS status
        FROM orders WHERE o_orderstatus <> 'O'
        UNION ALL SELECT o_orderkey, 'id-' || o_custkey, 'CONNECTED' FROM orders
            WHERE o_orderstatus <> 'O'
        UNION ALL SELECT o_orderkey, NULL, NULL FROM orders WHERE o_orderstatus = 'O') x""",
)
def explode_nodes(spark, sf):
    orders = table(spark, sf, "orders")
    host = F.concat(F.lit("host-"), F.col("o_orderkey").cast("string"))
    ident = F.concat(F.lit("id-"), F.col("o_custkey").cast("string"))
    state = F.when(F.col("o_orderstatus") == "P", "CONNECTING").otherwise("CONNECTED")
    pair = F.array(
        F.struct(host.alias("address"), ident.alias("nodeId"), state.alias("status")),
        F.struct(
            F.lit(None).cast("string").alias("address"),
            ident.alias("nodeId"),
            F.lit("CONNECTED").alias("status"),
        ),
    )
    body = F.to_json(F.struct(F.struct(pair.alias("nodes")).alias("cluster")))
    bodies = orders.select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "O", '{"cluster":{}}').otherwise(body).alias("body"),
    )
    return health.explode_nodes(bodies, "body")


@query(
    "a3_metric_present",
    """SELECT source, CAST(count(*) AS BIGINT) AS scrapes,
        bool_or(contains(text, (SELECT min(text) FROM benchmark))) AS present
    FROM documents GROUP BY source""",
)
def metric_present(spark, sf):
    metric = table(spark, sf, "benchmark").agg(F.min("text")).first()[0]
    return scraping.metric_present(table(spark, sf, "documents"), "source", "text", metric)


@query(
    "a3_metric_exact",
    """SELECT user_id, CAST(count(*) AS BIGINT) AS scrapes, bool_or(event_type = 'click') AS present
    FROM events GROUP BY user_id""",
)
def metric_exact(spark, sf):
    line = F.concat(
        F.lit("# click_total\n"), F.col("event_type"), F.lit('_total{k="1"} '), F.col("value").cast("string")
    )
    scrapes = table(spark, sf, "events").select("user_id", line.alias("body"))
    return scraping.metric_present(scrapes, "user_id", "body", "click_total", exact=True)


@query(
    "a4_readiness",
    """SELECT l_orderkey, CAST(count(*) AS BIGINT) AS workloads,
        CAST(count(*) FILTER (l_linestatus = 'F') AS BIGINT) AS ready_workloads,
        bool_and(l_linestatus = 'F') AS ready
    FROM lineitem GROUP BY l_orderkey""",
)
def readiness(spark, sf):
    workloads = table(spark, sf, "lineitem").select(
        "l_orderkey",
        F.lit(1).alias("replicas"),
        F.when(F.col("l_linestatus") == "F", 1).alias("ready"),
        F.lit(1).alias("want"),
    )
    return health.readiness(workloads, ["l_orderkey"], "replicas", "ready", "want")


@query(
    "a5_required_members",
    """SELECT o_custkey, concat_ws(',',
            CASE WHEN NOT bool_or(o_orderpriority = '1-URGENT') THEN '1-URGENT' END,
            CASE WHEN NOT bool_or(o_orderpriority = '2-HIGH') THEN '2-HIGH' END,
            CASE WHEN NOT bool_or(o_orderpriority = '5-LOW') THEN '5-LOW' END) AS missing,
        bool_or(o_orderpriority = '1-URGENT') AND bool_or(o_orderpriority = '2-HIGH')
            AND bool_or(o_orderpriority = '5-LOW') AS complete
    FROM orders GROUP BY o_custkey""",
)
def required_members(spark, sf):
    found = drift.required_members(
        table(spark, sf, "orders"), ["o_custkey"], "o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW"]
    )
    return found.withColumn("missing", F.array_join("missing", ","))


@query(
    "a5_required_mounts",
    """SELECT o_custkey, CASE WHEN bool_or(contains(o_orderpriority, 'NOT')) THEN '' ELSE 'NOT' END
            AS missing, bool_or(contains(o_orderpriority, 'NOT')) AS complete
    FROM orders GROUP BY o_custkey""",
)
def required_mounts(spark, sf):
    found = drift.required_members(
        table(spark, sf, "orders"), ["o_custkey"], "o_orderpriority", ["NOT"], match="contains"
    )
    return found.withColumn("missing", F.array_join("missing", ","))


@query(
    "w1_pick_first_eligible",
    f"""WITH {fleet.ROLE_GROUPS}, picked AS (
        SELECT custkey, coalesce(min(role_group) FILTER (replicas > 0), min(role_group)) AS g
        FROM role_groups GROUP BY custkey)
    SELECT CAST(c_custkey AS VARCHAR) AS cluster, g AS selected_group,
        c_custkey || '-node-' || g || '-0' AS pod,
        CASE WHEN g IS NULL THEN 'no_role_groups' END AS error
    FROM customer LEFT JOIN picked ON custkey = c_custkey""",
)
def pick_first_eligible(spark, sf):
    named = F.col("custkey").cast("string").alias("cluster")
    return sequences.pick_first_eligible(
        fleet.clusters(spark, sf).select(named),
        fleet.role_groups(spark, sf).select(named, "role_group", "replicas"),
    )


@query(
    "w2_time_to_success",
    """WITH n AS (
        SELECT user_id, ts, event_type = 'purchase' AS ok,
            row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt,
            min(ts) OVER (PARTITION BY user_id) AS started
        FROM events), hit AS (
        SELECT user_id, min(attempt) AS attempt FROM n
        WHERE ok AND ts < started + INTERVAL 24 HOUR GROUP BY user_id)
    SELECT n.user_id, CASE WHEN any_value(h.attempt) IS NULL THEN 'FAIL' ELSE 'PASS' END AS verdict,
        CAST(coalesce(any_value(h.attempt), count(*) FILTER (ts < started + INTERVAL 24 HOUR))
            AS BIGINT) AS attempts,
        min(started) AS started, min(ts) FILTER (n.attempt = h.attempt) AS succeeded,
        CAST(datediff('microsecond', min(started), min(ts) FILTER (n.attempt = h.attempt)) // 1000
            AS BIGINT) AS elapsed_ms
    FROM n LEFT JOIN hit h ON h.user_id = n.user_id GROUP BY n.user_id""",
)
def time_to_success(spark, sf):
    attempts = table(spark, sf, "events").withColumn("ok", F.col("event_type") == "purchase")
    return sequences.time_to_success(attempts, "user_id", "ts", "event_id", "ok", 24 * 3600)


@query(
    "w3_failure_runs",
    """WITH n AS (
        SELECT user_id AS target, ts, event_type <> 'error' AS ok,
            row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)
            - row_number() OVER (PARTITION BY user_id, event_type <> 'error' ORDER BY ts, event_id)
                AS island
        FROM events)
    SELECT target, CAST(count(*) AS BIGINT) AS failures, min(ts) AS run_start, max(ts) AS run_end
    FROM n WHERE NOT ok GROUP BY target, island HAVING count(*) >= 3""",
)
def failure_runs(spark, sf):
    return sequences.failure_runs(fleet.probes(spark, sf), "target", "ts", "event_id", "ok", 3)


@query(
    "w4_budget_keep",
    """SELECT doc_id, source, running_size FROM (
        SELECT doc_id, source, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id DESC)
            AS BIGINT) AS running_size FROM documents)
    WHERE running_size <= 50000""",
)
def budget_keep(spark, sf):
    items = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    kept = sequences.budget_keep(items, "source", ["-doc_id"], "n_chars", 100_000)
    return kept.select("doc_id", "source", "running_size")


@query(
    "w5_history_cap",
    """SELECT user_id, event_id, ts, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20""",
)
def history_cap(spark, sf):
    points = table(spark, sf, "events").select("user_id", "event_id", "ts", "value")
    return sequences.history_cap(points, "user_id", ["-ts", "-event_id"], 20)


@query(
    "l1_stable_order",
    "SELECT o_orderpriority, o_orderkey, o_orderstatus FROM orders ORDER BY o_orderpriority, o_orderkey",
)
def stable_order(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderpriority", "o_orderkey", "o_orderstatus")
    return sequences.stable_order(orders, "o_orderpriority")


@query(
    "l2_first_n",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
    ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice LIMIT 25""",
)
def first_n(spark, sf):
    lines = table(spark, sf, "lineitem")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return sequences.first_n(lines, 25, order).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"
    )


@query(
    "l2_first_n_per_group",
    """SELECT conv_id, turn, role, text FROM conversations
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) <= 2""",
)
def first_n_per_group(spark, sf):
    turns = table(spark, sf, "conversations")
    return sequences.first_n(turns, 2, ["turn", "role", "text"], ["conv_id"])
