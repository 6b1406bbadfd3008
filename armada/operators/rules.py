"""Defaults, rules and row-level decisions about specifications."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armada import values
from armada.functions import naming


def apply_defaults(
    df: DataFrame,
    defaults: dict[str, object],
    blank: dict[str, object] | None = None,
) -> DataFrame:
    """Fill absent fields.

    ``defaults`` fills nulls only; a field in ``blank`` (field -> the value that also counts as
    absent, such as ``''`` or ``0``) is filled when it holds that value too.
    """
    blank = blank or {}
    kinds = {f.name: f.dataType for f in df.schema}
    filled = {}
    for name, default in defaults.items():
        value = F.col(name)
        if name in blank:
            value = F.nullif(value, F.lit(blank[name]).cast(kinds[name]))
        filled[name] = F.coalesce(value, F.lit(default).cast(kinds[name]))
    return df.withColumns(filled)


@dataclass(frozen=True)
class Rule:
    """One rule on one field: ``name`` is reported, ``broken`` is true where it does not hold."""

    field: str
    name: str
    broken: Column


def required(field: str) -> Rule:
    return Rule(field, "required", F.col(field).isNull())


def one_of(field: str, allowed: tuple) -> Rule:
    return Rule(field, "enum", ~F.col(field).isin(*allowed))


def minimum(field: str, least) -> Rule:
    return Rule(field, "minimum", F.col(field) < F.lit(least))


def max_length(field: str, most: int) -> Rule:
    return Rule(field, "max_length", F.length(field) > most)


def min_length(field: str, least: int) -> Rule:
    return Rule(field, "min_length", F.length(field) < least)


def pattern(field: str, regex: str) -> Rule:
    return Rule(field, "pattern", ~F.col(field).rlike(regex))


def quantity(field: str) -> Rule:
    """P3 as a rule."""
    return Rule(field, "quantity", ~F.col(field).rlike(values.QUANTITY_PATTERN))


def git_rules() -> list[Rule]:
    """Rules of one git-sync entry (columns ``repo``, ``depth``)."""
    return [required("repo"), minimum("depth", 0)]


def key_rules(algorithm_prefix: str = "") -> list[Rule]:
    """Rules of the sensitive-key settings (columns ``key_secret``, ``algorithm``)."""
    allowed = tuple(algorithm_prefix + a for a in values.ALGORITHMS)
    return [required("key_secret"), one_of("algorithm", allowed)]


def condition_rules() -> list[Rule]:
    """Rules of one status condition (the columns of ``explode_conditions``)."""
    return [
        *[required(c) for c in ("type", "status", "reason", "message", "lastTransitionTime")],
        one_of("status", values.CONDITION_STATES),
        pattern("type", values.TYPE_PATTERN),
        max_length("type", values.TYPE_MAX_LENGTH),
        min_length("reason", 1),
        max_length("reason", values.REASON_MAX_LENGTH),
        pattern("reason", values.REASON_PATTERN),
        max_length("message", values.MESSAGE_MAX_LENGTH),
        minimum("observedGeneration", 0),
    ]


def resource_rules() -> list[Rule]:
    """Rules of the resource settings (columns ``cpu_max`` to ``storage_capacity``)."""
    names = ("cpu_max", "cpu_min", "memory_limit", "storage_capacity")
    return [quantity(c) for c in names]


def log_level_rules(*fields: str) -> list[Rule]:
    return [one_of(f, values.LOG_LEVELS) for f in fields]


def validate(df: DataFrame, rules: list[Rule], keys: list[str]) -> DataFrame:
    """One row per broken rule. Only ``required`` looks at absent values."""
    found = F.array(
        *[
            F.when(
                r.broken,
                F.struct(
                    F.lit(r.field).alias("field"),
                    F.lit(r.name).alias("rule"),
                    F.col(r.field).cast("string").alias("value"),
                ),
            )
            for r in rules
        ]
    )
    broken = df.select(*keys, F.explode(F.filter(found, lambda v: v.isNotNull())).alias("_v"))
    return broken.select(*keys, "_v.field", "_v.rule", "_v.value")


def route_by_version(df: DataFrame, version: str) -> DataFrame:
    """Versions that start with ``1.`` need the metrics job, others serve metrics themselves."""
    old = F.coalesce(F.col(version).startswith("1."), F.lit(False))
    return df.withColumn("metrics_route", F.when(old, "job").otherwise("native"))


def coordination_mode(df: DataFrame, name: str) -> DataFrame:
    """P5: coordination through ZooKeeper or Kubernetes, and the settings that follow."""
    zk = F.coalesce(F.col(name), F.lit("")) != ""
    return df.withColumns(
        {
            "mode": F.when(zk, "zookeeper").otherwise("kubernetes"),
            "state_provider": F.when(zk, "zk-provider").otherwise("kubernetes-provider"),
            "leader_election": F.when(zk, "CuratorLeaderElectionManager").otherwise(
                "KubernetesLeaderElectionManager"
            ),
            "connect_string": F.when(zk, '{{ getenv "ZOOKEEPER_HOSTS" }}'),
            "root_node": F.when(zk, '{{ getenv "ZOOKEEPER_CHROOT" }}'),
            "lease_prefix": F.when(~zk, '{{ getenv "STACKLET_NAME" }}'),
        }
    )


def service_endpoint(
    df: DataFrame, cluster: str, namespace: str, tls: str, api_path: str
) -> DataFrame:
    """Scheme, port and URL; ``proxy_mismatch`` marks plain services, whose proxy entry
    still names the https port."""
    return df.withColumns(
        {
            "scheme": naming.scheme(F.col(tls)),
            "port": naming.web_port(F.col(tls)),
            "url": naming.service_url(F.col(cluster), F.col(namespace), F.col(tls), api_path),
            "proxy_mismatch": naming.web_port(F.col(tls)) != values.PORTS["https"],
        }
    )


def metrics_endpoint(
    df: DataFrame, host: str, port: str, use_https: str, native_path: str
) -> DataFrame:
    """Scrape URL and whether the scrape logs in first."""
    url = naming.metrics_url(F.col(host), F.col(port), F.col(use_https), native_path)
    return df.withColumn("metrics_url", url).withColumn(
        "authenticated", F.coalesce(F.col(use_https), F.lit(False))
    )


def reporting_gate(
    df: DataFrame, cluster: str, namespace: str, enabled: str, version: str
) -> DataFrame:
    """Clusters that get the metrics job, with the proxy host it needs.

    Wanted when the setting is present and true and the version is 1.x.
    """
    wanted = F.col(enabled).eqNullSafe(F.lit(True)) & F.col(version).startswith("1.")
    host = naming.service_host(F.col(cluster), F.col(namespace))
    port = F.lit(f":{values.PORTS['https']}")
    return df.filter(wanted).withColumn("proxy_host", F.concat(host, port))


def match_labels(df: DataFrame, labels: str, selector: dict[str, str]) -> DataFrame:
    """P10: rows whose label map holds every selector pair; an empty selector keeps all rows."""
    keep = F.lit(True)
    for key, value in selector.items():
        held = F.try_element_at(F.col(labels), F.lit(key)) == value
        keep = keep & F.coalesce(held, F.lit(False))
    return df.filter(keep)


def ldap_audit(
    df: DataFrame, secret_class: str, tls_verification: str, search_filter: str, uid_field: str
) -> DataFrame:
    """Strategy, protocol and search filter of a directory login.

    Bind credentials make it ``SIMPLE``, with verified TLS ``LDAPS``; without credentials it is
    ``ANONYMOUS`` whatever the protocol.
    """
    bound = F.coalesce(F.col(secret_class), F.lit("")) != ""
    verified = F.coalesce(F.col(tls_verification), F.lit(False))
    default_filter = F.concat(F.coalesce(F.col(uid_field), F.lit("")), F.lit("={0}"))
    return df.withColumns(
        {
            "strategy": F.when(bound & verified, "LDAPS").when(bound, "SIMPLE").otherwise("ANONYMOUS"),
            "protocol": F.when(verified, "ldaps").otherwise("ldap"),
            "effective_filter": F.coalesce(
                F.nullif(F.col(search_filter), F.lit("")), default_filter
            ),
        }
    )


def oidc_audit(
    df: DataFrame, host: str, port: str, root_path: str, scopes: str, extra_scopes: str
) -> DataFrame:
    """Issuer URL (always http, port only when set) and scopes, the provider's first."""
    none = F.array().cast("array<string>")
    path = F.coalesce(F.col(root_path), F.lit(""))
    slashed = F.when((path != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path)
    at_port = F.when(
        F.coalesce(F.col(port), F.lit(0)) != 0, F.concat(F.lit(":"), F.col(port).cast("string"))
    ).otherwise("")
    both = F.concat(F.coalesce(F.col(scopes), none), F.coalesce(F.col(extra_scopes), none))
    return df.withColumns(
        {
            "issuer": F.concat(F.lit("http://"), F.col(host), at_port, slashed),
            "all_scopes": F.array_join(both, ","),
        }
    )


def auth_cardinality(df: DataFrame, classes: str) -> DataFrame:
    """A2: exactly one authentication entry, and its class not empty."""
    size = F.coalesce(F.size(classes), F.lit(0))
    first = F.coalesce(F.try_element_at(F.col(classes), F.lit(1)), F.lit(""))
    return df.withColumn(
        "auth_verdict",
        F.when(size <= 0, "auth_missing")
        .when(size > 1, "auth_multiple")
        .when(first == "", "auth_class_empty")
        .otherwise("ok"),
    )


def check_supported(df: DataFrame, field: str, allowed: tuple) -> DataFrame:
    """Rows whose value is not in the list; an absent value is not in it."""
    return df.filter(~F.coalesce(F.col(field).isin(*allowed), F.lit(False)))
