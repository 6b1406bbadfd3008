"""Joins against other tables."""

from pyspark.sql import functions as F

from armada.operators import lookups, scraping
from queries import fleet
from queries.registry import query, spread, table


@query(
    "j1_lookup_ports",
    """WITH n AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'http' WHEN 'view' THEN 'https'
        WHEN 'error' THEN 'balance' WHEN 'purchase' THEN 'metrics' ELSE 'other' END AS name FROM events)
    SELECT event_id, name, CASE name WHEN 'http' THEN 8088 WHEN 'https' THEN 9443
        WHEN 'balance' THEN 6243 WHEN 'metrics' THEN 8081 ELSE 0 END AS port FROM n""",
)
def lookup_ports(spark, sf):
    kind = F.col("event_type")
    name = (
        F.when(kind == "click", "http").when(kind == "view", "https").when(kind == "error", "balance")
        .when(kind == "purchase", "metrics").otherwise("other")
    )
    named = table(spark, sf, "events").select("event_id", name.alias("name"))
    return lookups.lookup_ports(named, "name")


@query(
    "j1_lookup_ports_table",
    """SELECT l_orderkey, l_linenumber, l_partkey, coalesce(p_size, 0) AS port
    FROM lineitem LEFT JOIN part ON p_partkey = l_partkey + 100""",
)
def lookup_ports_table(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_partkey") + 100).alias("wanted")
    )
    parts = table(spark, sf, "part").select("p_partkey", "p_size")
    return lookups.lookup_ports(lines, "wanted", parts, "p_partkey", "p_size").drop("wanted")


@query(
    "j3_secret_verdict",
    f"""WITH {fleet.CLUSTERS} SELECT cluster, namespace, key_secret, auto_generate,
        CASE WHEN custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'
                AND o_orderpriority = '1-URGENT') THEN 'ok'
            WHEN auto_generate THEN 'generate' ELSE 'fail' END AS secret_verdict
    FROM clusters""",
)
def secret_verdict(spark, sf):
    urgent = table(spark, sf, "orders").filter("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'")
    owner = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    secrets = urgent.join(owner, F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat(F.lit("ns-"), F.col("c_nationkey").cast("string")).alias("namespace"),
        F.concat(F.lit("key-"), F.col("o_custkey").cast("string")).alias("name"),
    )
    rows = fleet.clusters(spark, sf).select("cluster", "namespace", "key_secret", "auto_generate")
    return lookups.secret_verdict(rows, secrets)


@query(
    "j6_resolve_auth",
    f"""WITH {fleet.CLUSTERS} SELECT cluster, auth_class, CASE
        WHEN n_nationkey IS NULL THEN 'auth_class_missing' WHEN n_regionkey IN (0, 4) THEN 'oidc'
        WHEN n_regionkey = 1 THEN 'ldap' WHEN n_regionkey = 2 THEN 'static' ELSE 'unsupported' END AS auth
    FROM clusters LEFT JOIN nation ON 'auth-' || n_nationkey = auth_class""",
)
def resolve_auth(spark, sf):
    rows = fleet.clusters(spark, sf).select("cluster", "auth_class")
    return lookups.resolve_auth(rows, fleet.auth_classes(spark, sf))


@query(
    "j7_any_contained",
    """SELECT doc_id, source FROM documents d
    WHERE EXISTS (SELECT 1 FROM benchmark b WHERE contains(d.text, b.text))""",
)
def any_contained(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "source", "text"))
    found = scraping.any_contained(docs, "text", table(spark, sf, "benchmark"))
    return found.select("doc_id", "source")


@query(
    "j7_any_of_list",
    """SELECT event_id, event_type FROM events
    WHERE contains(event_type, 'err') OR contains(event_type, 'up')""",
)
def any_of_list(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type")
    return scraping.any_contained(events, "event_type", ["err", "up"])


@query(
    "j8_ignore_deleted",
    """SELECT event_id, user_id FROM events
    WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""",
)
def ignore_deleted(spark, sf):
    live = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    return lookups.ignore_deleted(table(spark, sf, "events").select("event_id", "user_id"), live, ["user_id"])
