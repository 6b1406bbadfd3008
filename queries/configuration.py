"""Specifications, rendered files, arguments, names and units."""

from pyspark.sql import functions as F

from armada import values
from armada.functions import arguments, naming, units
from armada.operators import drift, lookups, rendering, rules, sequences
from armada.session import new_path
from armada.sources import records, specs
from queries import fleet
from queries.registry import query, spread, table


def text(name):
    return F.col(name).cast("string")


@query(
    "s1_read_specs",
    f"""WITH {fleet.CLUSTERS}
    SELECT CASE WHEN balance >= -900 THEN cluster END AS cluster,
        CASE WHEN balance >= -900 THEN namespace END AS namespace,
        CASE WHEN balance >= -900 THEN version END AS version,
        balance >= -900 AND tls AS tls,
        CASE WHEN balance >= -900 THEN zookeeper END AS zookeeper,
        CASE WHEN balance >= -900 THEN reporting END AS reporting,
        CASE WHEN balance >= -900 THEN key_secret END AS key_secret,
        CASE WHEN balance >= -900 THEN auto_generate END AS auto_generate,
        CASE WHEN balance >= -900 THEN array_to_string(auth_classes, ',') END AS auth_classes,
        CASE WHEN balance >= -900 THEN 1 END AS replicas,
        balance < -900 AS malformed
    FROM clusters""",
)
def read_specs(spark, sf):
    """Specifications are written out as JSON lines, some cut short, and read back typed."""
    path = new_path(spark, "specs")
    spec_documents(spark, sf).write.text(path)
    read = specs.read_specs(spark, path)
    flat = specs.flatten_specs(read)
    return flat.select(
        "cluster", "namespace", "version", "tls", "zookeeper", "reporting", "key_secret",
        "auto_generate",
        F.array_join("auth_classes", ",").alias("auth_classes"),
        F.col("role_groups")["default"]["replicas"].alias("replicas"),
        F.col("cluster").isNull().alias("malformed"),
    )


def spec_documents(spark, sf):
    c = fleet.clusters(spark, sf)
    config = F.struct(
        F.transform("auth_classes", lambda a: F.struct(a.alias("authenticationClass"))).alias("authentication"),
        F.when(F.col("reporting").isNotNull(), F.struct(F.col("reporting").alias("enable"))).alias(
            "createReportingTaskJob"
        ),
        F.struct(
            F.col("key_secret").alias("keySecret"), F.col("auto_generate").alias("autoGenerate")
        ).alias("sensitiveProperties"),
        F.when(F.col("tls"), F.struct(F.lit("tls").alias("serverSecretClass"))).alias("tls"),
        F.col("zookeeper").alias("zookeeperConfigMapName"),
    )
    groups = F.create_map(F.lit("default"), F.struct(F.lit(1).alias("replicas")))
    document = F.to_json(
        F.struct(
            F.struct(F.col("cluster").alias("name"), "namespace").alias("metadata"),
            F.struct(
                F.struct(F.col("version").alias("productVersion")).alias("image"),
                config.alias("clusterConfig"),
                F.struct(groups.alias("roleGroups")).alias("nodes"),
            ).alias("spec"),
        )
    )
    whole = F.col("balance") >= -900
    return c.select(
        F.when(whole, document).otherwise(F.substring(document, 1, 40)).alias("value")
    )


@query(
    "s3_explode_lines",
    r"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, s[i] AS line FROM (
        SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (
            SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))
    WHERE s[i] <> ''""",
)
def explode_lines(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return rendering.explode_lines(docs, "text")


@query(
    "s6_render_files",
    """WITH last AS (
        SELECT o_custkey, o_orderstatus, o_orderpriority, max(o_orderkey) AS v
        FROM orders GROUP BY ALL)
    SELECT o_custkey, o_orderstatus, CAST(0 AS BIGINT) AS part,
        string_agg(o_orderpriority || '=' || v || chr(10), '' ORDER BY o_orderpriority) AS body
    FROM last GROUP BY o_custkey, o_orderstatus""",
)
def render_files(spark, sf):
    props = table(spark, sf, "orders").select(
        "o_custkey", "o_orderstatus", "o_orderpriority", text("o_orderkey").alias("value"),
        F.col("o_orderkey").alias("pos"),
    )
    return rendering.render_files(
        props, ["o_custkey", "o_orderstatus"], "o_orderpriority", "value", "pos"
    )


@query(
    "s7_to_json_records",
    """SELECT CAST(to_json({AppName: c_name, Id: c_custkey, Segment: c_mktsegment,
        Contact: CASE WHEN c_acctbal > 0 THEN c_nationkey END}) AS VARCHAR) AS record FROM customer""",
)
def to_json_records(spark, sf):
    rows = table(spark, sf, "customer").select(
        "c_name", "c_custkey", "c_mktsegment",
        F.when(F.col("c_acctbal") > 0, F.col("c_nationkey")).alias("contact"),
    )
    names = {"c_name": "AppName", "c_custkey": "Id", "c_mktsegment": "Segment", "contact": "Contact"}
    return records.to_json_records(rows, names)


TEMPLATE = (
    'owner={{ getenv "OWNER" }}\nsegment={{ getenv "SEGMENT" }}:{{ getenv "OWNER" }}\n'
    'hosts={{ getenv "ZOOKEEPER_HOSTS" }}\n'
)


@query(
    "j2_expand_templates",
    f"""WITH {fleet.CLUSTERS}, body AS (
        SELECT o_custkey AS custkey, o_orderkey, 'k=' || o_orderkey || chr(10)
            || '{TEMPLATE}' AS body FROM orders)
    SELECT b.custkey, o_orderkey,
        replace(replace(replace(replace(body, chr(92) || 'n', chr(10)),
            '{{{{ getenv "OWNER" }}}}', c_name || '$1'), '{{{{ getenv "SEGMENT" }}}}', c_mktsegment),
            '{{{{ getenv "ZOOKEEPER_HOSTS" }}}}',
            CASE WHEN zookeeper <> '' THEN zookeeper ELSE '{{{{ getenv "ZOOKEEPER_HOSTS" }}}}' END)
            AS body,
        CASE WHEN zookeeper <> '' THEN '' ELSE 'ZOOKEEPER_HOSTS' END AS unresolved
    FROM body b JOIN clusters c ON c.custkey = b.custkey
        JOIN customer ON c_custkey = b.custkey""",
)
def expand_templates(spark, sf):
    files = spread(table(spark, sf, "orders").select("o_custkey", "o_orderkey")).select(
        F.col("o_custkey").alias("custkey"), "o_orderkey",
        F.concat(F.lit("k="), text("o_orderkey"), F.lit("\n" + TEMPLATE)).alias("body"),
    )
    named = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("custkey"),
        F.explode(
            F.array(
                F.struct(F.lit("OWNER").alias("name"), F.concat("c_name", F.lit("$1")).alias("value")),
                F.struct(F.lit("SEGMENT").alias("name"), F.col("c_mktsegment").alias("value")),
            )
        ).alias("e"),
    ).select("custkey", "e.name", "e.value")
    hosts = fleet.clusters(spark, sf).filter(F.col("zookeeper") != "").select(
        "custkey", F.lit("ZOOKEEPER_HOSTS").alias("name"), F.col("zookeeper").alias("value")
    )
    done = rendering.expand_templates(files, named.unionByName(hosts), "custkey", ["o_orderkey"])
    return done.withColumn("unresolved", F.array_join("unresolved", ","))


@query(
    "f3_normalise_units",
    """WITH t AS (SELECT event_id, event_type,
        CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
    SELECT event_id,
        CASE event_type WHEN 'click' THEN k || ' sec' WHEN 'view' THEN k || ' MB'
            WHEN 'error' THEN k || '%' WHEN 'purchase' THEN k || 'm' ELSE k || ' apples' END AS value,
        CASE event_type WHEN 'click' THEN k * 1000 WHEN 'purchase' THEN k * 60000 END AS duration_ms,
        CASE event_type WHEN 'view' THEN k * 1048576 END AS size_bytes,
        CASE event_type WHEN 'error' THEN k / 100.0::DOUBLE END AS ratio
    FROM t""",
)
def normalise_units(spark, sf):
    k = F.get_json_object("props", "$.k")
    kind = F.col("event_type")
    value = (
        F.when(kind == "click", F.concat(k, F.lit(" sec")))
        .when(kind == "view", F.concat(k, F.lit(" MB")))
        .when(kind == "error", F.concat(k, F.lit("%")))
        .when(kind == "purchase", F.concat(k, F.lit("m")))
        .otherwise(F.concat(k, F.lit(" apples")))
    )
    events = spread(table(spark, sf, "events").select("event_id", "event_type", "props"))
    return rendering.normalise_units(events.select("event_id", value.alias("value")))


def quantities(spark, sf):
    size, kind = text("p_size"), F.col("p_type")
    value = (
        F.when(kind == "ECONOMY", F.concat(size, F.lit("Mi")))
        .when(kind == "LARGE", F.concat(size, F.lit("m")))
        .when(kind == "MEDIUM", F.concat(size, F.lit(".5k")))
        .when(kind == "PROMO", F.concat(size, F.lit("e2")))
        .when(kind == "SMALL", size)
        .otherwise(F.concat(size, F.lit(" Gi")))
    )
    return table(spark, sf, "part").select("p_partkey", value.alias("value"))


QUANTITIES = """WITH q AS (SELECT p_partkey, p_type, p_size,
    p_size || CASE p_type WHEN 'ECONOMY' THEN 'Mi' WHEN 'LARGE' THEN 'm' WHEN 'MEDIUM' THEN '.5k'
        WHEN 'PROMO' THEN 'e2' WHEN 'SMALL' THEN '' ELSE ' Gi' END AS value FROM part) """


@query("p3_valid_quantity", QUANTITIES + "SELECT p_partkey, value, p_type <> 'STANDARD' AS valid FROM q")
def valid_quantity(spark, sf):
    return quantities(spark, sf).withColumn("valid", units.valid_quantity(F.col("value")))


@query(
    "f4_parse_quantity",
    QUANTITIES
    + """SELECT p_partkey, value, CAST(CASE p_type WHEN 'ECONOMY' THEN p_size * 1048576
        WHEN 'LARGE' THEN p_size / 1000.0 WHEN 'MEDIUM' THEN p_size * 1000 + 500
        WHEN 'PROMO' THEN p_size * 100 WHEN 'SMALL' THEN p_size END AS DECIMAL(38, 9)) AS amount
    FROM q""",
)
def parse_quantity(spark, sf):
    return quantities(spark, sf).withColumn("amount", units.parse_quantity(F.col("value")))


@query(
    "f5_lint_placeholders",
    r"""SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, line,
        CAST(length(line) - length(replace(line, '{', '')) AS INTEGER) AS opened,
        CAST(length(line) - length(replace(line, '}', '')) AS INTEGER) AS closed
    FROM (SELECT page_id, i, s[i] AS line FROM (
        SELECT page_id, s, unnest(range(1, len(s) + 1)) AS i FROM (
            SELECT page_id, string_split('${{file:' || url || '}' || chr(10) || html, chr(10)) AS s
            FROM pages)))
    WHERE length(replace(line, '{', '')) <> length(replace(line, '}', ''))""",
)
def lint_placeholders(spark, sf):
    body = F.concat(F.lit("${{file:"), F.col("url"), F.lit("}\n"), F.col("html"))
    pages = spread(table(spark, sf, "pages").select("page_id", "url", "html"))
    files = pages.select("page_id", body.alias("body"))
    return rendering.lint_placeholders(files, "body")


@query(
    "g1_gather_env",
    f"""WITH {fleet.CLUSTERS}, v(rank, source, pos, name) AS (VALUES
        (0, 'base', 0, 'POD_NAME'), (0, 'base', 1, 'STACKLET_NAME'),
        (1, 'zookeeper', 0, 'ZOOKEEPER_HOSTS'), (1, 'zookeeper', 1, 'ZOOKEEPER_CHROOT'),
        (2, 'auth', 0, 'OIDC_CLIENT_ID'), (2, 'auth', 1, 'OIDC_CLIENT_SECRET'))
    SELECT cluster, CAST(pos AS INTEGER) AS pos, name, source, CAST(rank AS INTEGER) AS source_rank
    FROM clusters, v
    WHERE rank = 0 OR (rank = 1 AND zookeeper <> '') OR (rank = 2 AND auto_generate)""",
)
def gather_env(spark, sf):
    c = fleet.clusters(spark, sf)

    def bound(rows, *names):
        listed = F.array(*[F.lit(n) for n in names])
        return rows.select("cluster", F.posexplode(listed).alias("pos", "name"))

    return rendering.gather_env(
        {
            "base": bound(c, "POD_NAME", "STACKLET_NAME"),
            "zookeeper": bound(c.filter(F.col("zookeeper") != ""), "ZOOKEEPER_HOSTS", "ZOOKEEPER_CHROOT"),
            "auth": bound(c.filter("auto_generate"), "OIDC_CLIENT_ID", "OIDC_CLIENT_SECRET"),
        },
        ["cluster", "pos", "name"],
    )


@query(
    "g2_merge_args",
    """SELECT o_orderkey, '--repo=r' || o_custkey
        || ' --ref=' || CASE o_orderstatus WHEN 'O' THEN 'release' ELSE 'main' END
        || ' --depth=' || CASE o_orderstatus WHEN 'F' THEN 2 ELSE 1 END
        || ' --period=' || CASE o_orderstatus WHEN 'P' THEN '5s' ELSE '20s' END
        || ' --link=current --root=/tmp/git --one-time=false --git-config=safe.directory:/tmp/git'
        || ' --one-time=x --verbose=' || o_orderpriority AS args
    FROM orders""",
)
def merge_args(spark, sf):
    status = F.col("o_orderstatus")
    base = arguments.sync_args(
        F.concat(F.lit("r"), text("o_custkey")),
        F.when(status == "O", "release").when(status == "F", ""),
        F.when(status == "F", 2).when(status == "P", 0),
        F.when(status == "P", "5s").when(status == "O", ""),
        one_time=False,
    )
    user = F.create_map(
        F.lit("--verbose"), F.col("o_orderpriority"), F.lit("--root"), F.lit("/etc"),
        F.lit("--one-time"), F.lit("x"), F.lit("--one-time=true"), F.lit("y"),
    )
    merged = arguments.merge_args(base, user)
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(merged, " ").alias("args"))


@query(
    "g3_override_args",
    """SELECT p_partkey, concat_ws(' ', '-Da', CASE WHEN p_size >= 10 THEN '-Xmx' || p_size || 'g' END,
        '-Da', CASE WHEN p_type <> 'PROMO' THEN '-D' || p_type END,
        CASE WHEN p_type <> 'SMALL' THEN '-DSMALL' END) AS args FROM part""",
)
def override_args(spark, sf):
    args = F.array(
        F.lit("-Da"), F.concat(F.lit("-Xmx"), text("p_size"), F.lit("g")), F.lit("-Da"),
        F.concat(F.lit("-D"), F.col("p_type")),
    )
    done = arguments.override_args(
        args, F.array(F.lit("-Da"), F.lit("-DSMALL")), F.array(F.lit("-DPROMO")),
        F.array(F.lit("^-Xmx[0-9]g$")),
    )
    return table(spark, sf, "part").select("p_partkey", F.array_join(done, " ").alias("args"))


@query(
    "f1_job_name",
    """SELECT o_orderkey, o_custkey || '-create-reporting-task-'
        || replace('1.' || substr(o_orderpriority, 1, 1) || '.0', '.', '-') AS job FROM orders""",
)
def job_name(spark, sf):
    version = F.concat(F.lit("1."), F.substring("o_orderpriority", 1, 1), F.lit(".0"))
    return table(spark, sf, "orders").select(
        "o_orderkey", naming.job_name(text("o_custkey"), version).alias("job")
    )


@query(
    "f2_content_path",
    """SELECT page_id, rtrim(regexp_replace('/app/git-0/current/' || url || '//', '/+', '/', 'g'), '/')
        AS folder FROM pages""",
)
def content_path(spark, sf):
    folder = F.concat(F.lit("/"), F.col("url"), F.lit("//"))
    return table(spark, sf, "pages").select(
        "page_id", naming.content_path("/app/git-0", folder).alias("folder")
    )


@query(
    "w6_index_entries",
    """WITH e AS (SELECT l_orderkey, l_linenumber, CAST(unnest([0, 1]) AS INTEGER) AS pos, l_returnflag,
        l_linestatus FROM lineitem)
    SELECT l_orderkey, l_linenumber, pos, 'git-sync-' || pos AS sidecar,
        'git-sync-' || pos || '-init' AS init_container, 'content-from-git-' || pos AS volume,
        '/app/git-' || pos AS mount_path,
        '/app/git-' || pos || '/current' || CASE pos WHEN 0 THEN '/' || l_returnflag ELSE '' END
            AS content_folder
    FROM e""",
)
def index_entries(spark, sf):
    entries = F.array(
        F.struct(F.concat(F.lit("/"), F.col("l_returnflag")).alias("gitFolder")),
        F.struct(F.lit("/").alias("gitFolder")),
    )
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"
    )
    rows = spread(lines).select("l_orderkey", "l_linenumber", entries.alias("git"))
    return sequences.index_entries(rows, "git", "/app/git")


@query(
    "p1_apply_defaults",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'release' ELSE 'main' END AS branch,
        CASE o_orderstatus WHEN 'F' THEN 2 ELSE 1 END AS depth,
        CASE o_orderstatus WHEN 'P' THEN '5s' ELSE '20s' END AS wait,
        CASE o_orderstatus WHEN 'P' THEN '' ELSE '/' END AS folder
    FROM orders""",
)
def apply_defaults(spark, sf):
    status = F.col("o_orderstatus")
    entries = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(status == "O", "release").when(status == "F", "").alias("branch"),
        F.when(status == "F", 2).when(status == "P", 0).alias("depth"),
        F.when(status == "P", "5s").when(status == "O", "").alias("wait"),
        F.when(status == "P", "").alias("folder"),
    )
    return rules.apply_defaults(
        entries,
        {**values.GIT_DEFAULTS, "folder": values.GIT_FOLDER_DEFAULT},
        {"branch": "", "depth": 0, "wait": ""},
    )


@query(
    "p2_validate",
    """WITH p AS (SELECT p_partkey, p_name, p_brand, nullif(p_type, 'PROMO') AS p_type, p_size FROM part)
    SELECT p_partkey, 'p_type' AS field, 'required' AS rule, p_type AS value FROM p WHERE p_type IS NULL
    UNION ALL SELECT p_partkey, 'p_type', 'enum', p_type FROM p WHERE p_type NOT IN ('ECONOMY', 'SMALL')
    UNION ALL SELECT p_partkey, 'p_size', 'minimum', CAST(p_size AS VARCHAR) FROM p WHERE p_size < 5
    UNION ALL SELECT p_partkey, 'p_name', 'max_length', p_name FROM p WHERE length(p_name) > 9
    UNION ALL SELECT p_partkey, 'p_brand', 'pattern', p_brand FROM p
        WHERE NOT regexp_matches(p_brand, '^Brand#[0-9]$')""",
)
def validate(spark, sf):
    parts = table(spark, sf, "part").withColumn("p_type", F.nullif("p_type", F.lit("PROMO")))
    checks = [
        rules.required("p_type"),
        rules.one_of("p_type", ("ECONOMY", "SMALL")),
        rules.minimum("p_size", 5),
        rules.max_length("p_name", 9),
        rules.pattern("p_brand", "^Brand#[0-9]$"),
    ]
    return rules.validate(parts, checks, ["p_partkey"])


@query(
    "j4_expected_vs_observed",
    """SELECT d.doc_id, 'missing' AS problem, NULL AS field, NULL AS expected, NULL AS observed
    FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)
    UNION ALL SELECT DISTINCT d.doc_id, 'mismatch', 'quality', '1', '0'
        FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 0
    UNION ALL SELECT DISTINCT d.doc_id, 'mismatch', 'toxic', '0', '1'
        FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.toxic = 1""",
)
def expected_vs_observed(spark, sf):
    pairs = F.array(
        F.struct(F.lit("quality").alias("field"), F.lit("1").alias("value")),
        F.struct(F.lit("toxic").alias("field"), F.lit("0").alias("value")),
    )
    expected = table(spark, sf, "documents").select("doc_id", F.inline(pairs))
    labels = table(spark, sf, "labels")
    observed = labels.select(
        "doc_id",
        F.inline(
            F.array(
                F.struct(F.lit("quality").alias("field"), text("quality").alias("value")),
                F.struct(F.lit("toxic").alias("field"), text("toxic").alias("value")),
            )
        ),
    )
    return drift.expected_vs_observed(expected, observed, ["doc_id"])


@query(
    "j5_layer_config",
    """SELECT o_custkey AS custkey, o_orderkey,
        coalesce(CASE o_orderstatus WHEN 'P' THEN '5s' END, CASE WHEN c_acctbal > 0 THEN '30s' END)
            AS shutdown,
        CASE WHEN o_orderstatus = 'O' THEN 'group' ELSE c_mktsegment END AS a,
        c_name AS b, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END AS c
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey""",
)
def layer_config(spark, sf):
    roles = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("custkey"),
        F.when(F.col("c_acctbal") > 0, "30s").alias("shutdown"),
        F.create_map(F.lit("A"), F.col("c_mktsegment"), F.lit("B"), F.col("c_name")).alias("env"),
    )
    status = F.col("o_orderstatus")
    groups = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("custkey"), "o_orderkey",
        F.when(status == "P", "5s").alias("shutdown"),
        F.when(
            status == "O",
            F.create_map(F.lit("A"), F.lit("group"), F.lit("C"), F.col("o_orderpriority")),
        ).alias("env"),
    )
    layered = lookups.layer_config(roles, groups, "custkey", ["shutdown"], ["env"])
    return layered.select(
        "custkey", "o_orderkey", "shutdown",
        *[F.try_element_at("env", F.lit(k)).alias(k.lower()) for k in "ABC"],
    )
