"""Mixing sources to target weights: capped water-filling and seeded repetitions.

Targets rise together like water: every source gets its weight times a common level, and one that
would be repeated more often than allowed stops at that bound, which lifts the level of the others.
With sources in the order of bound over weight the level is a closed formula over running sums, the
fixed point of clamping and resharing.

A document is taken as often as the target holds the whole source. What is left is filled with
documents in a seeded order, the one that crosses the target in part, so the words taken match the
target. The order is never a sort of a source: sums by the first digits of the draw give where each
digit group starts, and only groups are ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from armada.llm.common import WORD, staged

DIGITS = 3


def words_of(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(by_source: DataFrame, weights=(5, 2, 1), share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """Columns (source, source_size) to the same with target; sources of size 0 get 0.

    Weights repeat over the sources in the order of their names, null last. The windows without a
    key see one row per source.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    filled = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    earlier = filled.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(
        F.array(*map(F.lit, weights)), ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int")
    )
    rows = (
        by_source.withColumn("weight", weight.cast("long"))
        .withColumn("bound", F.col("source_size") * max_epochs)
        .withColumn("ratio", F.col("bound") / F.col("weight"))
        .withColumn("amount", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("place", F.row_number().over(filled))
        .withColumn(
            "level",
            (F.col("amount") - F.coalesce(F.sum("bound").over(earlier), F.lit(0)))
            / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))),
        )
    )
    free = F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))
    rows = rows.withColumn("first", F.min(free).over(everything))
    target = F.when(F.col("place") >= F.col("first.place"), F.col("first.level") * F.col("weight")).otherwise(
        F.col("bound").cast("double")
    )
    return rows.select("source", "source_size", target.alias("target"))


def mix(
    documents: DataFrame,
    weights=(5, 2, 1),
    share: float = 1.5,
    max_epochs: int = 2,
    seed: str = "mix",
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, and the carried columns.

    Null texts and texts without words have size 0 and are taken 0 times. Documents without a source
    form one source of their own, the last. Rows that repeat (same id and text) count each; where
    the crossing document is one of them, any of the equal rows stands for it. An empty table gives
    an empty result. Other columns are ignored whatever their names.
    """
    rows = documents.select(
        F.col(doc_id).alias("_id"),
        F.col(source).alias("_source"),
        words_of(F.col(text)).alias("_size"),
        F.md5(
            F.concat(
                F.lit(seed), F.lit(":"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")),
                F.lit(":"), F.coalesce(F.col(text), F.lit("")),
            ).cast("binary")
        ).alias("_draw"),
        F.struct(*(F.col(c) for c in carry)).alias("_carry") if carry else F.lit(None).alias("_carry"),
    )
    if not carry:
        rows = staged(rows.drop("_carry"), "mix")
    rows = rows.withColumn("_group", F.substring("_draw", 1, DIGITS))
    groups = rows.groupBy("_source", "_group").agg(F.sum("_size").alias("mass"))
    groups = staged(groups, "mix-groups")
    aims = targets(
        groups.groupBy(F.col("_source").alias("source")).agg(F.sum("mass").alias("source_size")),
        weights, share, max_epochs,
    )
    before = Window.partitionBy("_source").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.select(
        F.col("_source").alias("source"), F.col("_group").alias("group"),
        F.coalesce(F.sum("mass").over(before), F.lit(0)).alias("start"),
    )
    starts = (
        starts.join(aims.withColumnRenamed("source", "aim"), F.col("source").eqNullSafe(F.col("aim")))
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("rest", F.floor(F.col("target") - F.col("whole") * F.col("source_size") + 0.5))
        .drop("aim")
    )
    within = (
        Window.partitionBy("source", "group").orderBy("_draw").rowsBetween(Window.unboundedPreceding, -1)
    )
    joined = rows.join(
        starts, F.col("_source").eqNullSafe(F.col("source")) & (F.col("_group") == F.col("group"))
    ).withColumn("begin", F.col("start") + F.coalesce(F.sum("_size").over(within), F.lit(0)))
    extra = F.greatest(F.lit(0), F.least(F.col("_size"), F.col("rest") - F.col("begin")))
    return joined.select(
        *([F.col(f"_carry.{c}").alias(c) for c in carry] or [F.col("_id").alias("doc_id")]),
        F.col("_size").alias("size"),
        F.col("source_size"),
        F.col("target"),
        (F.col("whole") * F.col("_size") + extra).cast("long").alias("taken"),
    )


def repeated(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The rows of a mix (with ``text`` carried), each as often as it is taken.

    The one document of a source that meets the target in part keeps its first words, as many as are
    taken, with single spaces.
    """
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    part = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0).cast("int")
    copies = F.array_repeat(F.col(text), whole)
    first = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), part), " ")
    return mixed.withColumn("_texts", F.when(part > 0, F.concat(copies, F.array(first))).otherwise(copies)).withColumn(
        text, F.explode("_texts")
    ).drop("_texts")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS draw
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS weight FROM s),
r AS (SELECT *, 2 * source_size AS bound, (2 * source_size) / weight AS ratio FROM w),
l AS (
  SELECT *, row_number() OVER f AS place,
         (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE
          - CAST(coalesce(sum(bound) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
         / CAST(sum(weight) OVER ()
          - coalesce(sum(weight) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
  FROM r WINDOW f AS (ORDER BY ratio, source NULLS LAST)),
o AS (SELECT place AS first_place, level AS first_level FROM l WHERE level <= ratio ORDER BY place LIMIT 1),
t AS (
  SELECT source, source_size,
         CASE WHEN place >= first_place THEN first_level * weight ELSE CAST(bound AS DOUBLE) END AS target
  FROM l LEFT JOIN o ON true),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
c AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, e.whole,
         floor(e.target - e.whole * e.source_size + 0.5) AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin_at
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(whole * size + greatest(0, least(size, rest - begin_at)) AS BIGINT) AS taken
FROM c
"""
