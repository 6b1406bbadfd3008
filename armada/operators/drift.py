"""What should exist against what does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expected_vs_observed(
    expected: DataFrame,
    observed: DataFrame,
    keys: list[str],
    field: str = "field",
    value: str = "value",
    version: str | None = None,
) -> DataFrame:
    """Expected (object, field, value) rows that do not hold.

    An object without any observed row is ``missing``, once; of an object that exists only the
    expected fields are compared, and each that differs is a ``mismatch``. An expected row with a
    null field asks only for existence. Several observed rows of one field count as their latest
    by ``version``, or as their greatest value.
    """
    latest = F.max_by(value, version) if version else F.max(value)
    seen = observed.groupBy(*keys, field).agg(latest.alias("_seen"))
    objects = seen.select(*keys).distinct().withColumn("_there", F.lit(True))
    asked = expected.select(*keys, field, value)

    absent = F.col("_there").isNull()
    differs = F.col(field).isNotNull() & ~F.col(value).eqNullSafe(F.col("_seen"))
    broken = (
        asked.join(objects, keys, "left").join(seen, [*keys, field], "left").filter(absent | differs)
    )
    # Only problems are left here, so folding the repeats of a missing object is cheap.
    return broken.select(
        *keys,
        F.when(absent, "missing").otherwise("mismatch").alias("problem"),
        F.when(~absent, F.col(field)).alias(field),
        F.when(~absent, F.col(value)).alias("expected"),
        F.when(~absent, F.col("_seen")).alias("observed"),
    ).distinct()


def required_members(
    df: DataFrame,
    group: list[str],
    member: str,
    required: list[str],
    match: str = "exact",
) -> DataFrame:
    """A5: which of the required names each workload lacks.

    ``match="contains"`` also accepts a member that contains the name. Each required name is one
    boolean aggregate, so no set of members is ever gathered.
    """
    if match not in ("exact", "contains"):
        raise ValueError("match is 'exact' or 'contains'")

    def held(name: str) -> Column:
        c = F.col(member)
        return F.coalesce(c == name if match == "exact" else c.contains(name), F.lit(False))

    flags = df.groupBy(*group).agg(
        *[F.bool_or(held(n)).alias(f"_has_{i}") for i, n in enumerate(required)]
    )
    lacking = F.filter(
        F.array(*[F.when(~F.col(f"_has_{i}"), F.lit(n)) for i, n in enumerate(required)]),
        lambda x: x.isNotNull(),
    )
    return flags.select(*group, lacking.alias("missing")).withColumn(
        "complete", F.size("missing") == 0
    )
