"""Joins against other fleet tables.

The lookup side is reduced to one row per key first, so copies there multiply nothing and are
combined before the shuffle. No side is broadcast by hand: Spark broadcasts what it measures to be
small, and otherwise splits hot keys of the fact side at run time (``armada.session.tune``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armada import values


def lookup_ports(
    df: DataFrame,
    name: str,
    ports: DataFrame | dict[str, int] | None = None,
    ports_name: str = "name",
    ports_number: str = "port",
) -> DataFrame:
    """Port number by name; an unknown name gives 0.

    ``ports`` is a dictionary, which stays an expression, or a table; where a table names a port
    more than once, the lowest number counts.
    """
    if ports is None or isinstance(ports, dict):
        cells: list[Column] = []
        for key, number in (ports or values.PORTS).items():
            cells += [F.lit(key), F.lit(number)]
        found = F.try_element_at(F.create_map(*cells), F.col(name))
        return df.withColumn("port", F.coalesce(found, F.lit(0)))
    table = ports.groupBy(F.col(ports_name).alias("_name")).agg(F.min(ports_number).alias("_port"))
    joined = df.join(table, F.col(name) == F.col("_name"), "left")
    return joined.withColumn("port", F.coalesce("_port", F.lit(0))).drop("_name", "_port")


def secret_verdict(
    clusters: DataFrame,
    secrets: DataFrame,
    namespace: str = "namespace",
    secret: str = "key_secret",
    auto_generate: str = "auto_generate",
    secret_namespace: str = "namespace",
    secret_name: str = "name",
    keys: str | None = None,
    needed: tuple[str, ...] = (),
) -> DataFrame:
    """``ok`` when the secret exists, else ``generate`` or ``fail``.

    With ``keys`` (array column of ``secrets``) and ``needed``, ``missing_keys`` lists the keys
    that are read but absent.
    """
    lacking = F.lit(None)
    if keys:
        lacking = F.array_except(F.array(*[F.lit(k) for k in needed]), F.col(keys))
    held = (
        secrets.select(
            F.col(secret_namespace).alias("_ns"),
            F.col(secret_name).alias("_secret"),
            lacking.alias("_missing"),
        )
        .groupBy("_ns", "_secret")
        .agg(F.min("_missing").alias("_lacking"))
        .withColumn("_found", F.lit(True))
    )
    match = (F.col(namespace) == F.col("_ns")) & (F.col(secret) == F.col("_secret"))
    joined = clusters.join(held, match, "left")
    verdict = (
        F.when(F.col("_found"), "ok")
        .when(F.coalesce(F.col(auto_generate), F.lit(False)), "generate")
        .otherwise("fail")
    )
    result = joined.withColumn("secret_verdict", verdict)
    if keys:
        result = result.withColumn("missing_keys", F.col("_lacking"))
    return result.drop("_ns", "_secret", "_found", "_lacking")


def layer_config(
    roles: DataFrame, groups: DataFrame, on: str, scalars: list[str], maps: list[str] | None = None
) -> DataFrame:
    """Role-level configuration under each role group.

    A value set on the group wins over the role's; maps merge per key with the group's entries
    winning; arrays (given in ``scalars``) replace as a whole. Of several role rows of one key the
    greatest as a whole counts, scalars first and maps by their sorted entries.
    """
    maps = maps or []
    whole = [
        *[F.col(c) for c in scalars], *[F.array_sort(F.map_entries(c)).alias(c) for c in maps]
    ]
    one = roles.groupBy(F.col(on).alias("_on")).agg(F.max(F.struct(*whole)).alias("_role"))
    parent = one.select(
        "_on",
        *[F.col("_role")[c].alias(f"_role_{c}") for c in scalars],
        *[F.map_from_entries(F.col("_role")[c]).alias(f"_role_{c}") for c in maps],
    )
    joined = groups.join(parent, F.col(on) == F.col("_on"), "left")
    merged = {c: F.coalesce(F.col(c), F.col(f"_role_{c}")) for c in scalars}
    for c in maps:
        none = F.map_filter(F.col(c), lambda k, v: F.lit(False))
        own = F.coalesce(F.col(c), F.map_filter(f"_role_{c}", lambda k, v: F.lit(False)))
        inherited = F.map_filter(
            F.coalesce(F.col(f"_role_{c}"), none), lambda k, v: ~F.map_contains_key(own, k)
        )
        merged[c] = F.map_concat(inherited, own)
    return joined.withColumns(merged).drop("_on", *[f"_role_{c}" for c in scalars + maps])


def provider_rank(providers: dict[str, Column] | None = None) -> Column:
    """Place of the first provider that is set, from 1; one more than all for none."""
    conditions = providers or {p: F.col(p).isNotNull() for p in values.AUTH_TYPES}
    rank = F.lit(len(values.AUTH_TYPES) + 1)
    for place, provider in reversed(list(enumerate(values.AUTH_TYPES, 1))):
        rank = F.when(conditions[provider], F.lit(place)).otherwise(rank)
    return rank


def resolve_auth(
    clusters: DataFrame,
    auth_classes: DataFrame,
    auth_class: str = "auth_class",
    class_name: str = "name",
    providers: dict[str, Column] | None = None,
) -> DataFrame:
    """Provider of the named class, first match of OIDC, LDAP, static.

    ``providers`` maps each provider to a condition on ``auth_classes`` telling that it is set;
    by default columns of the provider's name must be non-null. Of several classes of one name the
    one whose provider comes first counts.
    """
    named = auth_classes.select(
        F.col(class_name).alias("_class"), provider_rank(providers).alias("_rank")
    )
    ranked = named.groupBy("_class").agg(F.min("_rank").alias("_rank"))
    provider = F.element_at(F.array(*map(F.lit, [*values.AUTH_TYPES, "unsupported"])), F.col("_rank"))
    ranked = ranked.select("_class", provider.alias("_auth"))
    joined = clusters.join(ranked, F.col(auth_class) == F.col("_class"), "left")
    return joined.withColumn("auth", F.coalesce("_auth", F.lit("auth_class_missing"))).drop(
        "_class", "_auth"
    )


def ignore_deleted(events: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """Drop change events whose object no longer exists."""
    return events.join(live.select(*keys).distinct(), keys, "left_semi")


def unwritten(wanted: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Rows still to be written: those whose key is not there yet."""
    return wanted.join(present.select(*keys).distinct(), keys, "left_anti")
