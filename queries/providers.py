"""Provider documents, nested bindings and cleaned paths."""

from pyspark.sql import functions as F

from armada.functions.naming import content_path, escapes_mount
from armada.operators import bindings
from armada.session import new_path
from armada.sources import providers
from armada.sources.synced import write_files
from queries import fleet
from queries.registry import dealt, query, table

# Rows of the rule table: needs, place, kind, provider, class, pos, property, value.
RULES = [
    (None, 0, "local-provider", "local", "state.Local", 0, "Directory", "/data/state"),
    (None, 0, "local-provider", "local", "state.Local", 1, "Always Sync", "false"),
    (None, 0, "local-provider", "local", "state.Local", 2, "Partitions", "16"),
    ("zookeeper", 1, "cluster-provider", "zk", "state.Zk", 0, "Connect String", '{{ getenv "HOSTS" }} & more'),
    ("zookeeper", 1, "cluster-provider", "zk", "state.Zk", 1, "Session Timeout", "15 seconds"),
    ("no zookeeper", 1, "cluster-provider", "map", "state.Map", 0, "Name Prefix", '{{ getenv "NAME" }}'),
]


def rules(spark):
    return spark.createDataFrame(
        RULES, "needs string, place int, kind string, provider string, class string, pos int, property string, value string"
    ).withColumns({"file": F.lit("state.xml"), "root": F.lit("stateManagement")})


def provider_property_rows(spark, sf):
    clusters = fleet.clusters(spark, sf)
    with_zookeeper = F.coalesce(F.col("zookeeper"), F.lit("")) != ""
    return providers.applicable(
        rules(spark), clusters, ["cluster"], {"zookeeper": with_zookeeper, "no zookeeper": ~with_zookeeper}
    )


LOCAL = """'    <local-provider>
        <id>local</id>
        <class>state.Local</class>
        <property name="Directory">/data/state</property>
        <property name="Always Sync">false</property>
        <property name="Partitions">16</property>
    </local-provider>
'"""
ZK = """'    <cluster-provider>
        <id>zk</id>
        <class>state.Zk</class>
        <property name="Connect String">{{ getenv "HOSTS" }} &amp; more</property>
        <property name="Session Timeout">15 seconds</property>
    </cluster-provider>
'"""
MAP = """'    <cluster-provider>
        <id>map</id>
        <class>state.Map</class>
        <property name="Name Prefix">{{ getenv "NAME" }}</property>
    </cluster-provider>
'"""
DOCUMENTS = f"""documents_ AS (SELECT cluster, coalesce(zookeeper, '') <> '' AS zk,
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' || chr(10) || '<stateManagement>' || chr(10) || {LOCAL}
        || CASE WHEN coalesce(zookeeper, '') <> '' THEN {ZK} ELSE {MAP} END || '</stateManagement>' || chr(10) AS body
    FROM clusters)"""


@query("s6_provider_documents", f"WITH {fleet.CLUSTERS}, {DOCUMENTS} SELECT cluster, CAST(0 AS BIGINT) AS part, body FROM documents_")
def provider_documents(spark, sf):
    return providers.render_providers(provider_property_rows(spark, sf), ["cluster"])


ROWS = """
SELECT cluster, 'local-provider' AS kind, 'local' AS provider, 0 AS pos, 'Directory' AS property, '/data/state' AS value FROM clusters
UNION ALL SELECT cluster, 'local-provider', 'local', 1, 'Always Sync', 'false' FROM clusters
UNION ALL SELECT cluster, 'local-provider', 'local', 2, 'Partitions', '16' FROM clusters
UNION ALL SELECT cluster, 'cluster-provider', 'zk', 0, 'Connect String', '{{ getenv "HOSTS" }} & more' FROM clusters
    WHERE coalesce(zookeeper, '') <> ''
UNION ALL SELECT cluster, 'cluster-provider', 'zk', 1, 'Session Timeout', '15 seconds' FROM clusters WHERE coalesce(zookeeper, '') <> ''
UNION ALL SELECT cluster, 'cluster-provider', 'map', 0, 'Name Prefix', '{{ getenv "NAME" }}' FROM clusters
    WHERE coalesce(zookeeper, '') = ''"""


@query("s1_provider_rows", f"WITH {fleet.CLUSTERS} {ROWS}")
def provider_rows(spark, sf):
    """Documents rendered for every cluster, parsed back from the column they are in."""
    files = providers.render_providers(provider_property_rows(spark, sf), ["cluster"])
    rows, _ = providers.provider_rows(files, ["cluster"])
    return rows.select("cluster", "kind", "provider", "pos", "property", "value")


@query(
    "s1_read_providers",
    """WITH l AS (SELECT s_suppkey, CASE WHEN s_acctbal > 3000 THEN s_name WHEN s_acctbal > 1000 THEN '' END AS secret,
        s_nationkey < 12 AS verified, CASE WHEN s_nationkey > 18 THEN '(cn=<x>)' WHEN s_nationkey > 9 THEN '' END AS search
        FROM supplier)
    SELECT s_suppkey AS custkey, 'Authentication Strategy' AS property, CASE WHEN coalesce(secret, '') = '' THEN 'ANONYMOUS'
        WHEN verified THEN 'LDAPS' ELSE 'SIMPLE' END AS value FROM l
    UNION ALL SELECT s_suppkey, 'Url', CASE WHEN verified THEN 'ldaps' ELSE 'ldap' END || '://host-' || s_suppkey || ':389' FROM l
    UNION ALL SELECT s_suppkey, 'User Search Base', 'ou=users' FROM l
    UNION ALL SELECT s_suppkey, 'User Search Filter', CASE WHEN coalesce(search, '') = '' THEN 'uid={0}' ELSE search END FROM l""",
)
def read_providers(spark, sf):
    """Directory logins written as XML files and read by the XML source, one element a row."""
    balance, nation = F.col("s_acctbal"), F.col("s_nationkey")
    logins = table(spark, sf, "supplier").select(
        "s_suppkey", F.concat(F.lit("host-"), F.col("s_suppkey").cast("string")).alias("host"), F.lit(389).alias("port"),
        F.when(balance > 3000, F.col("s_name")).when(balance > 1000, "").alias("secret"), (nation < 12).alias("verified"),
        F.lit("ou=users").alias("base"), F.when(nation > 18, "(cn=<x>)").when(nation > 9, "").alias("search"), F.lit("uid").alias("uid"),
    )
    rows = providers.ldap_properties(logins, ["s_suppkey"], "host", "port", "secret", "verified", "base", "search", "uid")
    named = rows.withColumn("provider", F.concat(F.lit("login-"), F.col("s_suppkey").cast("string")))
    path = new_path(spark, "providers")
    name = F.concat(F.col("s_suppkey").cast("string"), F.lit(".xml")).alias("name")
    write_files(providers.render_providers(named, ["s_suppkey"]).select(name, F.col("body").alias("content")), path)
    read = providers.read_providers(spark, path, "provider")
    key = F.substring_index("provider", "-", -1).cast("bigint").alias("custkey")
    return read.select(key, "property", "value")


@query(
    "j2_nested_bindings",
    f"""WITH {fleet.CLUSTERS}, named AS (
        SELECT cluster, 'BASE' AS name, cluster AS value, 0 AS depth, 'resolved' AS state FROM clusters
        UNION ALL SELECT cluster, 'HOME', '/srv/' || cluster, 1, 'resolved' FROM clusters
        UNION ALL SELECT cluster, 'LOGS', '/srv/' || cluster || '/logs:' || cluster, 2, 'resolved' FROM clusters
        UNION ALL SELECT cluster, 'KEY', 'k' || '{{{{ getenv "SECRET" }}}}', 0, 'unbound' FROM clusters WHERE NOT auto_generate
        UNION ALL SELECT cluster, 'KEY', 'k' || key_secret, 1, 'resolved' FROM clusters WHERE auto_generate
        UNION ALL SELECT cluster, 'SECRET', key_secret, 0, 'resolved' FROM clusters WHERE auto_generate
        UNION ALL SELECT cluster, 'ONE', '{{{{ getenv "TWO" }}}}', NULL, 'cycle' FROM clusters WHERE tls
        UNION ALL SELECT cluster, 'TWO', '{{{{ getenv "ONE" }}}}', NULL, 'cycle' FROM clusters WHERE tls
        UNION ALL SELECT cluster, 'THREE', 'x{{{{ getenv "TWO" }}}}', NULL, 'blocked' FROM clusters WHERE tls)
    SELECT cluster, name, value, CAST(depth AS INTEGER) AS depth, state FROM named""",
)
def nested_bindings(spark, sf):
    mark = lambda name: '{{ getenv "%s" }}' % name
    entry = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    listed = F.array(
        entry("BASE", F.col("cluster")), entry("HOME", F.lit("/srv/" + mark("BASE"))),
        entry("LOGS", F.lit(f"{mark('HOME')}/logs:{mark('BASE')}")), entry("KEY", F.lit("k" + mark("SECRET"))),
        entry("SECRET", F.when(F.col("auto_generate"), F.col("key_secret"))), entry("ONE", F.when(F.col("tls"), mark("TWO"))),
        entry("TWO", F.when(F.col("tls"), mark("ONE"))), entry("THREE", F.when(F.col("tls"), "x" + mark("TWO"))),
    )
    rows = dealt(fleet.clusters(spark, sf), "custkey").select("cluster", F.inline(listed))
    return bindings.resolve_bindings(rows, "cluster").drop("unresolved")


@query(
    "f2_cleaned_paths",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '/app/git-' || p_size || '/current/' || p_type
            WHEN 1 THEN '/app/git-' || p_size WHEN 2 THEN '/app/' || p_type ELSE '/' || p_type END AS path,
        p_partkey % 4 > 1 AS escapes FROM part""",
)
def cleaned_paths(spark, sf):
    kind, case = F.col("p_type"), F.col("p_partkey") % 4
    folder = (
        F.when(case == 0, F.concat(F.lit("./x//../"), kind, F.lit("/"))).when(case == 1, "a/../../.")
        .when(case == 2, F.concat(F.lit("../../"), kind)).otherwise(F.concat(F.lit("/../../../../../"), kind))
    )
    mount = F.concat(F.lit("/app/git-"), F.col("p_size").cast("string"))
    return table(spark, sf, "part").select(
        "p_partkey", content_path(mount, folder).alias("path"), escapes_mount(mount, folder).alias("escapes")
    )
