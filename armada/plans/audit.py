"""Jobs about specifications, inventory and rendered files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armada import values
from armada.functions.naming import job_name, web_port
from armada.operators.drift import expected_vs_observed
from armada.operators.lookups import provider_rank, resolve_auth, secret_verdict
from armada.operators.rendering import (
    expand_templates,
    normalise_units,
    render_files,
    unbalanced_lines,
)
from armada.operators.rules import (
    Rule,
    apply_defaults,
    auth_cardinality,
    coordination_mode,
    ldap_audit,
    oidc_audit,
    reporting_gate,
    validate,
)
from armada.operators.sequences import index_entries, pick_first_eligible


def spec_audit(
    specs: DataFrame,
    rules: list[Rule],
    secrets: DataFrame,
    auth_classes: DataFrame,
    defaults: dict[str, object],
    blank: dict[str, object] | None = None,
) -> DataFrame:
    """Which specifications break a rule, miss a secret or an authentication class?

    ``specs`` has the columns of ``flatten_specs``. One row per finding: (cluster, finding,
    detail). Rules are checked after defaults are filled in.
    """
    filled = apply_defaults(specs, defaults, blank)

    def findings(df: DataFrame, finding: Column, detail: Column) -> DataFrame:
        return df.select("cluster", finding.alias("finding"), detail.alias("detail"))

    broken = findings(
        validate(filled, rules, ["cluster"]), F.concat(F.lit("rule_"), "rule"), F.col("field")
    )
    keyed = filled.select("cluster", "namespace", "key_secret", "auto_generate")
    lacking = secret_verdict(keyed, secrets).filter(F.col("secret_verdict") != "ok")
    missing = findings(lacking, F.concat(F.lit("secret_"), "secret_verdict"), F.col("key_secret"))
    counted = auth_cardinality(filled.select("cluster", "auth_classes"), "auth_classes")
    wrong = findings(
        counted.filter(F.col("auth_verdict") != "ok"),
        F.col("auth_verdict"),
        F.array_join("auth_classes", ","),
    )
    single = counted.filter(F.col("auth_verdict") == "ok").select(
        "cluster", F.element_at("auth_classes", 1).alias("auth_class")
    )
    unresolved = resolve_auth(single, auth_classes).filter(~F.col("auth").isin(*values.AUTH_TYPES))
    unknown = findings(unresolved, F.col("auth"), F.col("auth_class"))
    return broken.unionByName(missing).unionByName(wrong).unionByName(unknown)


def login_audit(clusters: DataFrame, auth_classes: DataFrame) -> DataFrame:
    """How does each cluster log its users in?

    ``clusters`` has (cluster, auth_class, extra_scopes). ``auth_classes`` has name, and as structs
    (null where not set) ``oidc`` (host, port, root_path, scopes), ``ldap`` (secret_class,
    tls_verification, search_filter, uid_field) and ``static``. Directory columns are filled for
    LDAP only, issuer and scopes for OIDC only.
    """
    one = auth_classes.groupBy(F.col("name").alias("auth_class")).agg(
        F.min(F.struct(provider_rank().alias("rank"), "ldap", "oidc")).alias("_class")
    )
    provider = F.element_at(F.array(*map(F.lit, [*values.AUTH_TYPES, "unsupported"])), F.col("_class.rank"))
    one = one.withColumn("_auth", provider)
    joined = clusters.join(one, "auth_class", "left").select(
        "cluster", "auth_class", F.coalesce("_auth", F.lit("auth_class_missing")).alias("auth"),
        "extra_scopes", "_class.ldap.*",
        *[F.col(f"_class.oidc.{c}").alias(c) for c in ("host", "port", "root_path", "scopes")],
    )
    judged = oidc_audit(
        ldap_audit(joined, "secret_class", "tls_verification", "search_filter", "uid_field"),
        "host", "port", "root_path", "scopes", "extra_scopes",
    )
    by_ldap, by_oidc = F.col("auth") == "ldap", F.col("auth") == "oidc"
    return judged.select(
        "cluster", "auth_class", "auth",
        *[F.when(by_ldap, F.col(c)).alias(c) for c in ("strategy", "protocol", "effective_filter")],
        *[F.when(by_oidc, F.col(c)).alias(c) for c in ("issuer", "all_scopes")],
    )


def expected_inventory(
    specs: DataFrame, role_groups: DataFrame, mount_prefix: str
) -> DataFrame:
    """What should exist: (cluster, kind, name, field, value), a null field for mere existence.

    ``specs`` has (cluster, namespace, version, tls, zookeeper, reporting, key_secret, git);
    ``role_groups`` has (cluster, role_group, replicas).
    """
    nothing = F.lit(None).cast("string")

    def objects(df: DataFrame, kind: str, name: Column, field=None, value=None) -> DataFrame:
        return df.select(
            "cluster",
            F.lit(kind).alias("kind"),
            name.alias("name"),
            (nothing if field is None else F.lit(field)).alias("field"),
            (nothing if value is None else value.cast("string")).alias("value"),
        )

    groups = F.concat(F.col("cluster"), F.lit("-node-"), F.col("role_group"))
    replicas = F.coalesce(F.col("replicas"), F.lit(values.SPEC_DEFAULTS["replicas"]))
    workloads = objects(role_groups, "StatefulSet", groups, "replicas", replicas)
    secrets = objects(specs, "Secret", F.col("key_secret"))
    gated = reporting_gate(specs, "cluster", "namespace", "reporting", "version")
    jobs = objects(gated, "Job", job_name(F.col("cluster"), F.col("version")))
    modes = objects(
        coordination_mode(specs, "zookeeper"), "ConfigMap", F.concat("cluster", F.lit("-node")),
        "state_provider", F.col("state_provider"),
    )
    pods = pick_first_eligible(gated, role_groups)
    service = F.concat("cluster", F.lit("-reporting-task"))
    services = objects(pods, "Service", service, "pod", F.col("pod")).unionByName(
        objects(gated, "Service", service, "port", web_port(F.col("tls")))
    )
    entries = index_entries(specs.select("cluster", "git"), "git", mount_prefix)
    volumes = objects(entries, "Volume", F.col("volume"), "folder", F.col("content_folder"))
    everything = workloads
    for part in (secrets, jobs, modes, services, volumes):
        everything = everything.unionByName(part)
    return everything


def inventory_drift(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """What differs from the inventory."""
    return expected_vs_observed(expected, observed, ["cluster", "kind", "name"])


def configuration_audit(
    props: DataFrame, env: DataFrame, pos: str | None = None, env_order: list[str] | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What does each file contain, and what is unresolved or malformed?

    ``props`` has (cluster, file, key, value), ``env`` has (cluster, name, value). Gives the
    expanded files, the findings (cluster, file, finding, detail) and the values with units. A name
    that stays unresolved is one finding of its file, each uneven line one of its own.
    """
    files = render_files(props, ["cluster", "file"], pos=pos)
    expanded = expand_templates(files, env, "cluster", ["file", "part"], env_order=env_order)
    unbound = F.transform(
        "unresolved",
        lambda n: F.struct(
            F.lit("unresolved").alias("finding"), n.alias("detail"),
            F.lit(-1).cast("long").alias("in_part"), F.lit(-1).alias("at"),
        ),
    )
    uneven = F.transform(
        unbalanced_lines("body"),
        lambda l: F.struct(
            F.lit("unbalanced").alias("finding"), l["line"].alias("detail"),
            F.col("part").alias("in_part"), l["pos"].alias("at"),
        ),
    )
    found = expanded.select("cluster", "file", F.inline(F.concat(unbound, uneven)))
    findings = found.distinct().drop("in_part", "at")
    return expanded, findings, normalise_units(props)
