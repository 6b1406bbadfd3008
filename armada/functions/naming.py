"""Names, paths and addresses derived from a specification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from armada import values


def _text(value: Column | str) -> Column:
    return F.lit(value) if isinstance(value, str) else value


def job_name(cluster: Column, version: Column) -> Column:
    """name of the metrics job of a cluster and version."""
    return F.concat(
        cluster, F.lit("-create-reporting-task-"), F.replace(version, F.lit("."), F.lit("-"))
    )


def clean_path(path: Column) -> Column:
    """A path without empty and ``.`` segments, each ``..`` taking away the segment before it.

    Segments are folded onto a stack. Above the root of an absolute path ``..`` goes nowhere; of a relative
    one it stays in front. Nothing left is ``/`` or ``.``. A null path is null.
    """
    absolute = path.startswith("/")
    none = F.array().cast("array<string>")

    def push(stack: Column, segment: Column) -> Column:
        top = F.try_element_at(stack, F.lit(-1))
        last = F.coalesce(top, F.lit(".."))
        up = F.when(last != "..", F.slice(stack, F.lit(1), F.size(stack) - 1)).when(absolute, stack)
        return (
            F.when(segment.isin("", "."), stack)
            .when(segment == "..", up.otherwise(F.concat(stack, F.array(segment))))
            .otherwise(F.concat(stack, F.array(segment)))
        )

    joined = F.array_join(F.aggregate(F.split(path, "/", -1), none, push), "/")
    whole = F.when(absolute, F.concat(F.lit("/"), joined)).when(joined == "", ".").otherwise(joined)
    return F.when(path.isNotNull(), whole)


def content_path(mount: Column | str, folder: Column) -> Column:
    """where a synced folder appears below its mount.

    The folder is joined below the link to the current revision and the whole path is cleaned, so ``..`` may
    lead out of the link, and out of the mount: ``escapes_mount`` tells. A null folder is the link itself.
    """
    return clean_path(F.concat_ws("/", _text(mount), F.lit(values.LINK_NAME), folder))


def escapes_mount(mount: Column | str, folder: Column) -> Column:
    """Whether the content path of a folder is no longer below its mount."""
    base = clean_path(_text(mount))
    path = content_path(mount, folder)
    return ~((path == base) | path.startswith(F.concat(F.when(base == "/", "").otherwise(base), F.lit("/"))))


def service_host(cluster: Column, namespace: Column) -> Column:
    return F.concat(
        cluster, F.lit("-reporting-task."), namespace, F.lit(".svc.cluster.local")
    )


def web_port(tls: Column) -> Column:
    return F.when(
        F.coalesce(tls, F.lit(False)), F.lit(values.PORTS["https"])
    ).otherwise(F.lit(values.PORTS["http"]))


def scheme(tls: Column) -> Column:
    return F.when(F.coalesce(tls, F.lit(False)), F.lit("https")).otherwise(F.lit("http"))


def service_url(cluster: Column, namespace: Column, tls: Column, api_path: str) -> Column:
    """Connect URL of the single-target service. ``api_path`` depends on the product."""
    return F.concat(
        scheme(tls),
        F.lit("://"),
        service_host(cluster, namespace),
        F.lit(":"),
        web_port(tls).cast("string"),
        F.lit(f"/{api_path.strip('/')}"),
    )


def metrics_url(host: Column, port: Column, use_https: Column, native_path: str) -> Column:
    """Where metrics are scraped.

    Encrypted: the native path over https. Plain on any port but the metrics port: the native
    path over http. Otherwise the exporter's own ``/metrics/``.
    """
    native = f"/{native_path.strip('/')}"
    address = F.concat(host, F.lit(":"), port.cast("string"))
    return (
        F.when(F.coalesce(use_https, F.lit(False)), F.concat(F.lit("https://"), address, F.lit(native)))
        .when(
            port.cast("int") != values.PORTS["metrics"],
            F.concat(F.lit("http://"), address, F.lit(native)),
        )
        .otherwise(F.concat(F.lit("http://"), address, F.lit("/metrics/")))
    )
