"""A table layout in which a search by any one of several fields skips most of the files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 5  # of each field that go into the curve: 32 ranges
SAMPLE = 20_000  # rows from which the borders of the ranges are taken; they only decide where rows lie


def borders(df: DataFrame, fields: list[str], bits: int = BITS, sample: int = SAMPLE) -> dict[str, list]:
    """For each field up to 2 ** bits - 2 values that cut its distinct values, as often as they occur, evenly.

    Taken from a bounded sample, by a hash of the row and so the same on every run.
    """
    total = df.count()
    chance = F.pmod(F.xxhash64(*fields), F.lit(1 << 30)) / float(1 << 30)
    rows = df.filter(chance < (sample / total if total else 1)).select(*fields).limit(2 * sample)
    picked = rows.agg(*[F.array_sort(F.collect_list(f)).alias(f) for f in fields]).first()
    found = {}
    for field in fields:
        values, wanted = picked[field], 1 << bits
        # A frequent value is several borders at once, so few values are spread over the whole range as well.
        found[field] = [values[len(values) * i // wanted] for i in range(1, wanted - 1)] if values else []
    return found


def curve_key(borders: dict[str, list], kinds: dict[str, str], bits: int = BITS) -> Column:
    """Place of a row on a curve that runs through all fields at once: the bits of the ranges, interleaved.

    The highest bits of all fields come first, so rows near each other on the curve are near in every field.
    A null lies before all values.
    """
    parts = []
    for i, (field, cuts) in enumerate(borders.items()):
        if cuts:
            limits = F.array(*[F.lit(c).cast(kinds[field]) for c in cuts])
            place = _ranges_below(limits, F.col(field))
        else:
            place = F.lit(0).cast("long")
        for bit in range(bits):
            parts.append(F.shiftleft(F.shiftright(place, bit).bitwiseAND(F.lit(1)), bit * len(borders) + i))
    return reduce(lambda a, b: a + b, parts)


def _ranges_below(limits: Column, value: Column) -> Column:
    return F.when(value.isNotNull(), F.size(F.filter(limits, lambda c: c <= value)) + 1).otherwise(0).cast("long")


def write_curve(df: DataFrame, path: str, fields: list[str], files: int, bits: int = BITS, mode: str = "errorifexists") -> None:
    """Write Parquet in the order of the curve, about ``files`` files of even size.

    Rows go by range of the curve, so a value that fills a third of the table is cut by the other fields.
    Searches (``event_search``) need nothing special: the statistics in the files say which to skip.
    """
    if bits * len(fields) > 62:
        raise ValueError("more bits than a key holds")
    key = curve_key(borders(df, fields, bits), dict(df.select(*fields).dtypes), bits)
    ordered = df.withColumn("_curve", key).repartitionByRange(files, "_curve", *fields).sortWithinPartitions("_curve")
    ordered.drop("_curve").write.mode(mode).option("compression", "zstd").parquet(path)


def files_touched(table: DataFrame, field: str, value: Column) -> DataFrame:
    """One row (files, touched): of how many files the statistics cannot rule out that they hold the value."""
    per_file = table.groupBy(F.input_file_name().alias("file")).agg(F.min(field).alias("low"), F.max(field).alias("high"))
    held = (F.col("low") <= value) & (F.col("high") >= value)
    return per_file.agg(F.count(F.lit(1)).alias("files"), F.count(F.when(held, 1)).alias("touched"))
