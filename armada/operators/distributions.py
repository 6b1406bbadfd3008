"""Distributions kept as mergeable sketches, one per key and segment of time.

A sketch is a few kilobytes whatever it stands for, so a table of segments answers for any range of
time, or any coarser key, by merging rows instead of reading the values again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Parameters of the sketches. A quantile of k items is off by about 1.33 % of all ranks for k = 200; a
# distinct count of 2 ** 12 cells by about 1.6 % (one standard deviation).
QUANTILE_ITEMS = 200
DISTINCT_BITS = 12


def segment_sketches(
    rows: DataFrame, keys: list[str], ts: str, every: str, value: Column | None = None, distinct: Column | None = None,
    items: int = QUANTILE_ITEMS, bits: int = DISTINCT_BITS,
) -> DataFrame:
    """(keys, segment_start, n, values, least, most, distincts) of each key and segment of time.

    ``value`` is a number whose quantiles are wanted, ``distinct`` what is counted once. Nulls (and NaN
    values) are in no sketch; ``n`` counts the values that are. Rows without time are left out. Sketches are
    built on the map side, so a hot key moves one row per task.
    """
    number = value.cast("double") if value is not None else F.lit(None).cast("double")
    number = F.when(~F.isnan(number), number)
    other = distinct.cast("string") if distinct is not None else F.lit(None).cast("string")
    timed = rows.filter(F.col(ts).isNotNull()).select(
        *keys, F.window(ts, every)["start"].alias("segment_start"), number.alias("_v"), other.alias("_d")
    )
    return timed.groupBy(*keys, "segment_start").agg(
        F.count("_v").alias("n"), F.kll_sketch_agg_double("_v", items).alias("values"), F.min("_v").alias("least"),
        F.max("_v").alias("most"), F.hll_sketch_agg("_d", bits).alias("distincts"),
    )


def merged(sketches: DataFrame, keys: list[str], start: Column | None = None, end: Column | None = None, items: int = QUANTILE_ITEMS) -> DataFrame:
    """Sketches of all segments from ``start`` (included) to ``end`` (left out), one per key.

    ``keys`` may be fewer than the sketches were built by. The range reaches the scan of a stored table.
    """
    within = F.lit(True)
    if start is not None:
        within = within & (F.col("segment_start") >= start)
    if end is not None:
        within = within & (F.col("segment_start") < end)
    return sketches.filter(within).groupBy(*keys).agg(
        F.sum("n").alias("n"), F.kll_merge_agg_double("values", items).alias("values"), F.min("least").alias("least"),
        F.max("most").alias("most"), F.hll_union_agg("distincts").alias("distincts"),
    )


def quantiles(sketches: DataFrame, keep: list[str], ranks: list[float]) -> DataFrame:
    """(keep, n, n_distinct, rank, value): the estimated value at each rank, null without any value."""
    some = F.when(F.col("n") > 0, F.col("values"))

    def at(rank: float) -> Column:
        value = F.col("least") if rank <= 0 else F.col("most") if rank >= 1 else F.kll_sketch_get_quantile_double(some, F.lit(float(rank)))
        return F.struct(F.lit(float(rank)).alias("rank"), F.when(some.isNotNull(), value).alias("value"))

    listed = F.inline(F.array(*map(at, ranks)))
    return sketches.select(*keep, "n", F.hll_sketch_estimate("distincts").alias("n_distinct"), listed)
