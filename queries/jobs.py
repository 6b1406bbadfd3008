"""Whole jobs."""

from pyspark.sql import functions as F

from armada import values
from armada.operators import components, rules
from armada.plans import audit, health, upkeep
from queries import fleet
from queries.events import COMPONENT
from queries.registry import query, spread, table


def calls(spark, sf):
    """One status response per order."""
    status = F.col("o_orderstatus")
    node = F.struct(
        F.concat(F.lit("host-"), F.col("o_orderkey").cast("string")).alias("address"),
        F.when(status == "P", "LOST").otherwise("CONNECTED").alias("status"),
    )
    body = F.to_json(F.struct(F.struct(F.array(node).alias("nodes")).alias("cluster")))
    priority = F.substring("o_orderpriority", 1, 1)
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("cluster"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_orderkey").alias("id"),
        F.when(priority == "1", 404).when(priority == "2", 503).otherwise(200).alias("code"),
        body.alias("body"),
    )


RESPONSES = """WITH last AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
v AS (SELECT c_custkey AS cluster, o_orderkey, o_orderstatus,
        CAST(CASE WHEN c_acctbal < 0 THEN 2 ELSE 1 END AS BIGINT) AS expected_nodes,
        CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1::BIGINT ELSE 0::BIGINT END AS nodes,
        CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'P' THEN 1::BIGINT ELSE 0::BIGINT
            END AS bad_nodes,
        CASE WHEN o_orderkey IS NULL OR o_orderpriority = '2-HIGH' THEN 'no_response'
            WHEN o_orderpriority = '1-URGENT' AND c_acctbal >= 0 THEN 'standalone' WHEN c_acctbal < 0 THEN 'count_mismatch'
            WHEN o_orderstatus = 'P' THEN 'not_connected' ELSE 'healthy' END AS reason
    FROM customer LEFT JOIN last ON o_custkey = c_custkey) """


def expected(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("cluster"),
        F.when(F.col("c_acctbal") < 0, 2).otherwise(1).alias("expected_nodes"),
    )


@query(
    "job_fleet_health",
    RESPONSES
    + """SELECT cluster, expected_nodes, nodes, bad_nodes, reason,
        reason IN ('healthy', 'standalone') AS healthy FROM v""",
)
def fleet_health(spark, sf):
    return health.fleet_health(calls(spark, sf), expected(spark, sf))[0]


@query(
    "job_fleet_offenders",
    RESPONSES
    + """SELECT cluster, reason, 'host-' || o_orderkey || '='
            || CASE o_orderstatus WHEN 'P' THEN 'LOST' ELSE 'CONNECTED' END AS offender,
        1::BIGINT AS reports
    FROM v WHERE reason IN ('count_mismatch', 'not_connected') AND nodes > 0""",
)
def fleet_offenders(spark, sf):
    return health.fleet_health(calls(spark, sf), expected(spark, sf))[1]


@query(
    "job_readiness_report",
    """WITH n AS (
        SELECT user_id, ts, event_id, event_type = 'purchase' AS ok, event_type = 'error' AS bad,
            row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place,
            min(ts) OVER (PARTITION BY user_id) AS started FROM events),
    hit AS (SELECT user_id, min(place) AS attempts, min(ts) AS at FROM n
        WHERE ok AND ts < started + INTERVAL 12 HOUR GROUP BY user_id),
    tried AS (SELECT user_id, min(started) AS started,
            count(*) FILTER (ts < started + INTERVAL 12 HOUR) AS attempts FROM n GROUP BY user_id),
    runs AS (SELECT user_id, count(*) AS failures FROM (
            SELECT user_id, bad, place - row_number() OVER (PARTITION BY user_id, bad ORDER BY ts, event_id)
                AS island FROM n) WHERE bad GROUP BY user_id, island HAVING count(*) >= 3),
    failing AS (SELECT user_id, count(*) AS runs, max(failures) AS longest FROM runs GROUP BY user_id)
    SELECT t.user_id AS target, CASE WHEN h.at IS NULL THEN 'FAIL' ELSE 'PASS' END AS verdict,
        CAST(coalesce(h.attempts, t.attempts) AS BIGINT) AS attempts,
        CAST(datediff('microsecond', started, h.at) // 1000 AS BIGINT) AS elapsed_ms,
        CAST(coalesce(runs, 0) AS BIGINT) AS runs, CAST(coalesce(longest, 0) AS BIGINT) AS longest
    FROM tried t LEFT JOIN hit h ON h.user_id = t.user_id LEFT JOIN failing f ON f.user_id = t.user_id""",
)
def readiness_report(spark, sf):
    events = table(spark, sf, "events").select(
        F.col("user_id").alias("target"), "ts", F.col("event_id").alias("id"), "event_type"
    )
    attempts = events.withColumn("ok", F.col("event_type") == "purchase")
    probes = events.withColumn("ok", F.col("event_type") != "error")
    return health.readiness_report(attempts, probes, 12 * 3600, 3)


@query(
    "job_metric_coverage",
    f"""WITH {fleet.CLUSTERS}, seen AS (SELECT user_id, count(*) AS scrapes,
            bool_or(event_type = 'purchase') AS present FROM events GROUP BY user_id)
    SELECT custkey AS target, CASE WHEN version LIKE '1.%' THEN 'job' ELSE 'native' END AS metrics_route,
        CASE WHEN version LIKE '1.%' THEN 'http://' || cluster || ':8081/metrics/'
            WHEN tls THEN 'https://' || cluster || ':9443/api/metrics'
            ELSE 'http://' || cluster || ':8088/api/metrics' END AS metrics_url,
        CAST(coalesce(scrapes, 0) AS BIGINT) AS scrapes
    FROM clusters LEFT JOIN seen ON user_id = custkey
    WHERE namespace <> 'ns-3' AND NOT coalesce(present, false)""",
)
def metric_coverage(spark, sf):
    labels = F.create_map(
        F.lit("managed"), F.when(F.col("namespace") == "ns-3", "no").otherwise("yes")
    )
    targets = fleet.clusters(spark, sf).select(
        F.col("custkey").alias("target"), "version", F.col("cluster").alias("host"), "tls",
        labels.alias("labels"),
    )
    scrapes = table(spark, sf, "events").select(
        F.col("user_id").alias("target"), F.concat("event_type", F.lit("_total 1")).alias("body")
    )
    return health.metric_coverage(
        targets, scrapes, "purchase_total", "/api/metrics", {"managed": "yes"}, exact=True
    )


@query(
    "job_spec_audit",
    f"""WITH {fleet.CLUSTERS}, stored AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F'),
    one AS (SELECT cluster, auth_classes[1] AS auth_class FROM clusters
        WHERE len(auth_classes) = 1 AND auth_classes[1] <> '')
    SELECT cluster, 'rule_enum' AS finding, 'version' AS detail FROM clusters
        WHERE version NOT IN ('1.27.0', '2.4.0', '2.5.0', '')
    UNION ALL SELECT cluster, 'rule_required', 'reporting' FROM clusters WHERE reporting IS NULL
    UNION ALL SELECT cluster, CASE WHEN auto_generate THEN 'secret_generate' ELSE 'secret_fail' END,
        key_secret FROM clusters WHERE custkey NOT IN (SELECT o_custkey FROM stored)
    UNION ALL SELECT cluster, CASE WHEN len(auth_classes) = 0 THEN 'auth_missing'
            WHEN len(auth_classes) > 1 THEN 'auth_multiple' ELSE 'auth_class_empty' END,
        array_to_string(auth_classes, ',') FROM clusters
        WHERE len(auth_classes) <> 1 OR auth_classes[1] = ''
    UNION ALL SELECT cluster, CASE WHEN n_nationkey IS NULL THEN 'auth_class_missing' ELSE 'unsupported' END,
        auth_class FROM one LEFT JOIN nation ON 'auth-' || n_nationkey = auth_class
        WHERE n_nationkey IS NULL OR n_regionkey = 3""",
)
def spec_audit(spark, sf):
    specs = fleet.clusters(spark, sf)
    stored = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select("o_custkey").distinct()
    secrets = specs.join(stored, F.col("custkey") == F.col("o_custkey")).select(
        "namespace", F.col("key_secret").alias("name")
    )
    checks = [
        rules.one_of("version", ("1.27.0", "2.4.0", "2.5.0")),
        rules.required("reporting"),
    ]
    return audit.spec_audit(
        specs, checks, secrets, fleet.auth_classes(spark, sf), {"version": "2.5.0"}, {"version": ""}
    )


@query(
    "job_inventory_drift",
    f"""WITH {fleet.CLUSTERS}, {fleet.ROLE_GROUPS}, g AS (
        SELECT c.cluster, r.*, c.cluster || '-node-' || role_group AS name
        FROM role_groups r JOIN clusters c ON c.custkey = r.custkey),
    gated AS (SELECT * FROM clusters WHERE reporting AND version LIKE '1.%'),
    pod AS (SELECT cluster, coalesce(min(role_group) FILTER (replicas > 0), min(role_group)) AS p
        FROM g GROUP BY cluster)
    SELECT cluster, 'StatefulSet' AS kind, name, 'mismatch' AS problem, 'replicas' AS field,
        CAST(coalesce(replicas, 1) AS VARCHAR) AS expected, '3' AS observed
        FROM g WHERE role_group NOT LIKE 'low%' AND coalesce(replicas, 1) <> 3
    UNION ALL SELECT cluster, 'StatefulSet', name, 'missing', NULL, NULL, NULL FROM g
        WHERE role_group LIKE 'low%'
    UNION ALL SELECT cluster, 'Secret', key_secret, 'missing', NULL, NULL, NULL FROM clusters
        WHERE NOT auto_generate
    UNION ALL SELECT cluster, 'Job', cluster || '-create-reporting-task-' || replace(version, '.', '-'),
        'missing', NULL, NULL, NULL FROM gated
    UNION ALL SELECT gated.cluster, 'Service', gated.cluster || '-reporting-task', 'mismatch', 'pod',
        CASE WHEN p IS NOT NULL THEN gated.cluster || '-node-' || p || '-0' END, 'none'
        FROM gated LEFT JOIN pod ON pod.cluster = gated.cluster
    UNION ALL SELECT cluster, 'Service', cluster || '-reporting-task', 'mismatch', 'port',
        CASE WHEN tls THEN '9443' ELSE '8088' END, NULL FROM gated
    UNION ALL SELECT cluster, 'ConfigMap', cluster || '-node', 'mismatch', 'state_provider',
        'kubernetes-provider', 'zk-provider' FROM clusters WHERE coalesce(zookeeper, '') = ''
    UNION ALL SELECT cluster, 'Volume', 'content-from-git-0', 'mismatch', 'folder',
        '/app/git-0/current/' || namespace, '/app/git-0/current/other' FROM clusters""",
)
def inventory_drift(spark, sf):
    git = F.array(F.struct(F.concat(F.lit("/"), F.col("namespace")).alias("gitFolder")))
    specs = fleet.clusters(spark, sf).withColumn("git", git)
    groups = fleet.role_groups(spark, sf).join(specs.select("custkey", "cluster"), "custkey")
    wanted = audit.expected_inventory(specs, groups.drop("custkey"), "/app/git")

    def seen(df, kind, name, field, value):
        return df.select(
            "cluster", F.lit(kind).alias("kind"), name.alias("name"), F.lit(field).alias("field"),
            F.lit(value).alias("value"),
        )

    observed = (
        seen(
            groups.filter(~F.col("role_group").startswith("low")), "StatefulSet",
            F.concat("cluster", F.lit("-node-"), "role_group"), "replicas", "3",
        )
        .unionByName(seen(specs.filter("auto_generate"), "Secret", F.col("key_secret"), "type", "Opaque"))
        .unionByName(seen(specs, "Service", F.concat("cluster", F.lit("-reporting-task")), "pod", "none"))
        .unionByName(
            seen(specs, "ConfigMap", F.concat("cluster", F.lit("-node")), "state_provider", "zk-provider")
        )
        .unionByName(seen(specs, "Volume", F.lit("content-from-git-0"), "folder", "/app/git-0/current/other"))
    )
    return audit.inventory_drift(wanted, observed)


@query(
    "job_configuration_audit",
    """SELECT o_custkey AS cluster, o_orderpriority AS file, 'unresolved' AS finding, 'HOST' AS detail
    FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders)
        LEFT JOIN customer ON c_custkey = o_custkey WHERE c_acctbal <= 0
    UNION ALL SELECT o_custkey, o_orderpriority, 'unbalanced', 'k' || o_orderkey || '=${{file:x}'
    FROM orders WHERE o_orderstatus = 'P'""",
)
def configuration_audit(spark, sf):
    order = F.col("o_orderkey").cast("string")
    value = F.when(F.col("o_orderstatus") == "P", "${{file:x}").otherwise("30 sec")
    orders = table(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus"
    )
    lines = spread(orders).select(
        F.col("o_custkey").alias("cluster"), F.col("o_orderpriority").alias("file"),
        F.concat(F.lit("k"), order).alias("key"), value.alias("value"),
    )
    hosts = lines.select("cluster", "file", F.lit("host").alias("key"), F.lit('{{ getenv "HOST" }}').alias("value"))
    env = table(spark, sf, "customer").filter("c_acctbal > 0").select(
        F.col("c_custkey").alias("cluster"), F.lit("HOST").alias("name"), F.col("c_name").alias("value")
    )
    return audit.configuration_audit(lines.unionByName(hosts), env)[1]


@query(
    "job_event_upkeep",
    """WITH e AS (SELECT event_id AS id, ts, user_id AS component, props, event_type,
        CASE event_type WHEN 'error' THEN 'node' WHEN 'view' THEN 'component' ELSE 'other' END AS kind,
        (SELECT max(ts) FROM events) AS as_of FROM events)
    SELECT id, ts, component, kind, substr(props, 1, 8) AS attributes, length(props) > 8 AS attributes_cut
    FROM (SELECT * FROM e WHERE (kind = 'node' AND ts >= as_of - INTERVAL 14 DAY)
        OR (kind = 'component' AND ts >= as_of - INTERVAL 3 DAY))
    QUALIFY row_number() OVER (PARTITION BY component ORDER BY ts DESC, id DESC) <= 5""",
)
def event_upkeep(spark, sf):
    kind = F.col("event_type")
    events = table(spark, sf, "events").select(
        F.col("event_id").alias("id"), "ts", F.col("user_id").alias("component"),
        F.when(kind == "error", "node").when(kind == "view", "component").otherwise("other").alias("kind"),
        F.col("props").alias("attributes"),
    )
    as_of = events.agg(F.max("ts")).first()[0]
    return upkeep.event_upkeep(events, as_of, values.RETENTION_DAYS, 5, 8)


@query(
    "job_component_run",
    r"""SELECT CAST(to_json({page_id: page_id, pos: CAST(i - 1 AS INTEGER), line: s[i],
        processed: 'Measure: ' || length(s[i])}) AS VARCHAR) AS record
    FROM (SELECT page_id, s, unnest(range(1, len(s) + 1)) AS i FROM (
        SELECT page_id, string_split(replace(url, '/', chr(10)), chr(10)) AS s FROM pages))
    WHERE s[i] <> ''""",
)
def component_run(spark, sf):
    components.ship(spark, COMPONENT)
    files = table(spark, sf, "pages").select("page_id", F.translate("url", "/", "\n").alias("body"))
    return upkeep.component_run(files, "body", "measure_component:Measure")


@query(
    "job_login_audit",
    f"""WITH {fleet.CLUSTERS}, r AS (SELECT c.*, n_name, n_regionkey, n_nationkey, CASE
            WHEN n_nationkey IS NULL THEN 'auth_class_missing' WHEN n_regionkey IN (0, 4) THEN 'oidc'
            WHEN n_regionkey = 1 THEN 'ldap' WHEN n_regionkey = 2 THEN 'static' ELSE 'unsupported' END
            AS auth
        FROM clusters c LEFT JOIN nation ON 'auth-' || n_nationkey = auth_class)
    SELECT cluster, auth_class, auth,
        CASE WHEN auth = 'ldap' THEN CASE WHEN n_nationkey > 9 THEN 'LDAPS' ELSE 'ANONYMOUS' END END
            AS strategy,
        CASE WHEN auth = 'ldap' THEN 'ldaps' END AS protocol,
        CASE WHEN auth = 'ldap' THEN 'uid={{0}}' END AS effective_filter,
        CASE WHEN auth = 'oidc' THEN 'http://' || n_name || ':8080/realms/' || n_nationkey END AS issuer,
        CASE WHEN auth = 'oidc' THEN 'openid,' || namespace END AS all_scopes
    FROM r""",
)
def login_audit(spark, sf):
    nation = F.col("n_nationkey")
    region = F.col("n_regionkey")
    oidc = F.struct(
        F.col("n_name").alias("host"), F.lit(8080).alias("port"),
        F.concat(F.lit("/realms/"), nation.cast("string")).alias("root_path"),
        F.array(F.lit("openid")).alias("scopes"),
    )
    ldap = F.struct(
        F.when(nation > 9, F.col("n_name")).alias("secret_class"), F.lit(True).alias("tls_verification"),
        F.lit("").alias("search_filter"), F.lit("uid").alias("uid_field"),
    )
    classes = table(spark, sf, "nation").select(
        F.concat(F.lit("auth-"), nation.cast("string")).alias("name"),
        F.when(region.isin(0, 4), oidc).alias("oidc"),
        F.when(region.isin(1, 4), ldap).alias("ldap"),
        F.when(region == 2, F.struct(F.col("n_name").alias("secret"))).alias("static"),
    )
    rows = fleet.clusters(spark, sf).select(
        "cluster", "auth_class", F.array("namespace").alias("extra_scopes")
    )
    return audit.login_audit(rows, classes)
