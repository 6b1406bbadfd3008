"""Row-level decisions over the cluster table."""

from pyspark.sql import functions as F

from armada.operators import health, rules
from queries import fleet
from queries.registry import query, table


@query(
    "p4_route_by_version",
    f"""WITH {fleet.CLUSTERS} SELECT cluster, version,
        CASE WHEN version LIKE '1.%' THEN 'job' ELSE 'native' END AS metrics_route FROM clusters""",
)
def route_by_version(spark, sf):
    return rules.route_by_version(fleet.clusters(spark, sf).select("cluster", "version"), "version")


@query(
    "p5_coordination_mode",
    f"""WITH {fleet.CLUSTERS}, m AS (SELECT cluster, zookeeper, zookeeper IS NOT NULL AND zookeeper <> ''
        AS zk FROM clusters)
    SELECT cluster, zookeeper, CASE WHEN zk THEN 'zookeeper' ELSE 'kubernetes' END AS mode,
        CASE WHEN zk THEN 'zk-provider' ELSE 'kubernetes-provider' END AS state_provider,
        CASE WHEN zk THEN 'CuratorLeaderElectionManager' ELSE 'KubernetesLeaderElectionManager' END
            AS leader_election,
        CASE WHEN zk THEN '{{{{ getenv "ZOOKEEPER_HOSTS" }}}}' END AS connect_string,
        CASE WHEN zk THEN '{{{{ getenv "ZOOKEEPER_CHROOT" }}}}' END AS root_node,
        CASE WHEN NOT zk THEN '{{{{ getenv "STACKLET_NAME" }}}}' END AS lease_prefix
    FROM m""",
)
def coordination_mode(spark, sf):
    return rules.coordination_mode(fleet.clusters(spark, sf).select("cluster", "zookeeper"), "zookeeper")


@query(
    "p6_service_endpoint",
    f"""WITH {fleet.CLUSTERS} SELECT cluster, namespace, tls,
        CASE WHEN tls THEN 'https' ELSE 'http' END AS scheme,
        CASE WHEN tls THEN 9443 ELSE 8088 END AS port,
        CASE WHEN tls THEN 'https' ELSE 'http' END || '://' || cluster || '-reporting-task.'
            || namespace || '.svc.cluster.local:' || CASE WHEN tls THEN 9443 ELSE 8088 END || '/api'
            AS url,
        NOT tls AS proxy_mismatch
    FROM clusters""",
)
def service_endpoint(spark, sf):
    rows = fleet.clusters(spark, sf).select("cluster", "namespace", "tls")
    return rules.service_endpoint(rows, "cluster", "namespace", "tls", "/api")


@query(
    "p7_metrics_endpoint",
    f"""WITH {fleet.CLUSTERS}, t AS (SELECT cluster, version LIKE '2.%' AND tls AS secure,
        CASE WHEN version LIKE '1.%' THEN 8081 WHEN tls THEN 9443 ELSE 8088 END AS port FROM clusters)
    SELECT cluster, port, secure,
        CASE WHEN secure THEN 'https://' || cluster || ':' || port || '/api/metrics'
            WHEN port <> 8081 THEN 'http://' || cluster || ':' || port || '/api/metrics'
            ELSE 'http://' || cluster || ':' || port || '/metrics/' END AS metrics_url,
        secure AS authenticated
    FROM t""",
)
def metrics_endpoint(spark, sf):
    version = F.col("version")
    targets = fleet.clusters(spark, sf).select(
        "cluster",
        F.when(version.startswith("1."), 8081).when(F.col("tls"), 9443).otherwise(8088).alias("port"),
        (version.startswith("2.") & F.col("tls")).alias("secure"),
    )
    return rules.metrics_endpoint(targets, "cluster", "port", "secure", "/api/metrics")


@query(
    "p8_classify_response",
    """WITH r AS (SELECT event_id, CASE WHEN user_id < 75 THEN 'token' ELSE 'cluster' END AS call,
        CASE event_type WHEN 'click' THEN 200 WHEN 'view' THEN 409 WHEN 'error' THEN 500
            WHEN 'purchase' THEN 404 END AS code FROM events)
    SELECT event_id, call, code, CASE WHEN code = 200 THEN 'ok'
        WHEN call = 'token' AND code = 409 THEN 'anonymous'
        WHEN call = 'cluster' AND code IN (404, 409) THEN 'standalone' ELSE 'retry' END AS response
    FROM r""",
)
def classify_response(spark, sf):
    kind = F.col("event_type")
    calls = table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("user_id") < 75, "token").otherwise("cluster").alias("call"),
        F.when(kind == "click", 200).when(kind == "view", 409).when(kind == "error", 500)
        .when(kind == "purchase", 404).alias("code"),
    )
    return health.classify_response(calls, "call", "code")


@query(
    "p9_reporting_gate",
    f"""WITH {fleet.CLUSTERS} SELECT cluster, namespace, version, reporting,
        cluster || '-reporting-task.' || namespace || '.svc.cluster.local:9443' AS proxy_host
    FROM clusters WHERE reporting AND version LIKE '1.%'""",
)
def reporting_gate(spark, sf):
    rows = fleet.clusters(spark, sf).select("cluster", "namespace", "version", "reporting")
    return rules.reporting_gate(rows, "cluster", "namespace", "reporting", "version")


@query(
    "p10_match_labels",
    """SELECT p_partkey, p_name FROM part WHERE p_type = 'PROMO' AND p_size = 7""",
)
def match_labels(spark, sf):
    labels = F.create_map(
        F.lit("type"), F.col("p_type"), F.lit("brand"), F.col("p_brand"),
        F.lit("size"), F.col("p_size").cast("string"),
    )
    rows = table(spark, sf, "part").select("p_partkey", "p_name", labels.alias("labels"))
    return rules.match_labels(rows, "labels", {"type": "PROMO", "size": "7"}).drop("labels")


@query(
    "p11_ldap_audit",
    """WITH l AS (SELECT s_suppkey, CASE WHEN s_acctbal > 3000 THEN s_name WHEN s_acctbal > 1000 THEN '' END
            AS secret, s_nationkey < 12 AS verified,
        CASE WHEN s_nationkey > 18 THEN '(cn=x)' WHEN s_nationkey > 9 THEN '' END AS search FROM supplier)
    SELECT s_suppkey, secret, verified, search,
        CASE WHEN coalesce(secret, '') = '' THEN 'ANONYMOUS' WHEN verified THEN 'LDAPS' ELSE 'SIMPLE' END
            AS strategy,
        CASE WHEN verified THEN 'ldaps' ELSE 'ldap' END AS protocol,
        CASE WHEN coalesce(search, '') = '' THEN 'uid={0}' ELSE search END AS effective_filter
    FROM l""",
)
def ldap_audit(spark, sf):
    balance, nation = F.col("s_acctbal"), F.col("s_nationkey")
    providers = table(spark, sf, "supplier").select(
        "s_suppkey",
        F.when(balance > 3000, F.col("s_name")).when(balance > 1000, "").alias("secret"),
        (nation < 12).alias("verified"),
        F.when(nation > 18, "(cn=x)").when(nation > 9, "").alias("search"),
        F.lit("uid").alias("uid"),
    )
    return rules.ldap_audit(providers, "secret", "verified", "search", "uid").drop("uid")


@query(
    "p12_oidc_audit",
    """SELECT s_suppkey, 'http://' || s_name || CASE WHEN s_nationkey > 9 THEN ':' || s_nationkey ELSE '' END
            || CASE WHEN s_acctbal > 0 THEN '/realms/x' ELSE '' END AS issuer,
        CASE WHEN s_nationkey > 4 THEN 'openid,' ELSE '' END || 'email,n' || s_nationkey AS all_scopes
    FROM supplier""",
)
def oidc_audit(spark, sf):
    nation = F.col("s_nationkey")
    providers = table(spark, sf, "supplier").select(
        "s_suppkey", F.col("s_name").alias("host"),
        F.when(nation > 9, nation).when(nation > 5, 0).alias("port"),
        F.when(F.col("s_acctbal") > 0, F.when(nation > 12, "/realms/x").otherwise("realms/x")).alias("root"),
        F.when(nation > 4, F.array(F.lit("openid"))).alias("scopes"),
        F.array(F.lit("email"), F.concat(F.lit("n"), nation.cast("string"))).alias("extra"),
    )
    audited = rules.oidc_audit(providers, "host", "port", "root", "scopes", "extra")
    return audited.select("s_suppkey", "issuer", "all_scopes")


@query(
    "a2_auth_cardinality",
    f"""WITH {fleet.CLUSTERS} SELECT cluster, CASE WHEN len(auth_classes) = 0 THEN 'auth_missing'
        WHEN len(auth_classes) > 1 THEN 'auth_multiple' WHEN auth_classes[1] = '' THEN 'auth_class_empty'
        ELSE 'ok' END AS auth_verdict FROM clusters""",
)
def auth_cardinality(spark, sf):
    rows = fleet.clusters(spark, sf).select("cluster", "auth_classes")
    return rules.auth_cardinality(rows, "auth_classes").drop("auth_classes")


@query(
    "g4_check_supported",
    "SELECT p_partkey, p_type FROM part WHERE p_type NOT IN ('ECONOMY', 'PROMO', 'SMALL')",
)
def check_supported(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", "p_type")
    return rules.check_supported(rows, "p_type", ("ECONOMY", "PROMO", "SMALL"))
