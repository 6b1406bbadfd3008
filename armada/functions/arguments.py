"""Argument lists: merging with reserved names and overriding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from armada import values

ARRAY_OF_TEXT = "array<string>"


def merge_args(
    base: Column,
    user: Column,
    reserved: tuple[str, ...] = values.RESERVED_ARGS,
    strict: bool = False,
) -> Column:
    """Base arguments, then the user's ``key=value`` pairs whose key is not reserved.

    User pairs come in key order. ``strict`` also reserves the bare ``--one-time``, which the
    reserved list names only together with a value.
    """
    names = [*reserved, "--one-time"] if strict else list(reserved)
    kept = F.map_filter(user, lambda k, v: ~k.isin(*names))
    pairs = F.transform(
        F.array_sort(F.map_entries(kept)), lambda e: F.concat_ws("=", e["key"], e["value"])
    )
    return F.concat(base, F.coalesce(pairs, F.array().cast(ARRAY_OF_TEXT)))


def sync_args(
    repo: Column, branch: Column, depth: Column, wait: Column, one_time: bool
) -> Column:
    """Base arguments of a sync container; blank branch or wait and depth 0 take the default."""
    d = values.GIT_DEFAULTS

    def given(value: Column, blank, default) -> Column:
        return F.coalesce(F.nullif(value, F.lit(blank)), F.lit(default)).cast("string")

    return F.array(
        F.concat(F.lit("--repo="), repo),
        F.concat(F.lit("--ref="), given(branch, "", d["branch"])),
        F.concat(F.lit("--depth="), given(depth, 0, d["depth"])),
        F.concat(F.lit("--period="), given(wait, "", d["wait"])),
        F.lit(f"--link={values.LINK_NAME}"),
        F.lit(f"--root={values.SYNC_ROOT}"),
        F.lit(f"--one-time={'true' if one_time else 'false'}"),
        F.lit(f"--git-config=safe.directory:{values.SYNC_ROOT}"),
    )


def override_args(args: Column, add: Column, remove: Column, remove_regex: Column) -> Column:
    """Drop exact matches, drop pattern matches, then append additions not yet present.

    Repeated arguments stay repeated. A null list counts as empty.
    """
    none = F.array().cast(ARRAY_OF_TEXT)
    add, remove, remove_regex = (F.coalesce(x, none) for x in (add, remove, remove_regex))
    left = F.filter(
        F.coalesce(args, none),
        lambda a: ~F.array_contains(remove, a) & ~F.exists(remove_regex, lambda r: F.rlike(a, r)),
    )
    return F.concat(left, F.filter(add, lambda a: ~F.array_contains(left, a)))
