"""Durations, sizes, ratios and resource quantities as numbers.

Text that does not match gives null; callers keep the raw text beside it.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from armada import values

# Milliseconds per duration unit.
DURATION_MS = {
    "ns": "0.000001",
    "us": "0.001",
    "µs": "0.001",
    "ms": "1",
    "millis": "1",
    "s": "1000",
    "sec": "1000",
    "secs": "1000",
    "second": "1000",
    "seconds": "1000",
    "m": "60000",
    "min": "60000",
    "mins": "60000",
    "minute": "60000",
    "minutes": "60000",
    "h": "3600000",
    "hr": "3600000",
    "hrs": "3600000",
    "hour": "3600000",
    "hours": "3600000",
    "d": "86400000",
    "day": "86400000",
    "days": "86400000",
}

# Exponents of size units.
SIZE_POWERS = {"B": 0, "KB": 1, "MB": 2, "GB": 3, "TB": 4}

# Multipliers of resource-quantity suffixes.
SMALL_FACTORS = {"n": "0.000000001", "u": "0.000001", "m": "0.001"}
LARGE_FACTORS = {
    "k": "1000",
    "M": "1000000",
    "G": "1000000000",
    "T": "1000000000000",
    "P": "1000000000000000",
    "E": "1000000000000000000",
    "Ki": str(2**10),
    "Mi": str(2**20),
    "Gi": str(2**30),
    "Ti": str(2**40),
    "Pi": str(2**50),
    "Ei": str(2**60),
}

_NUMBER = r"\d+(?:\.\d*)?|\.\d+"


def _lookup(table: dict[str, str], precision: int, scale: int, key: Column) -> Column:
    entries = []
    for name, number in table.items():
        cell = F.lit(Decimal(number)).cast(f"decimal({precision},{scale})")
        entries += [F.lit(name), cell]
    return F.create_map(*entries)[key]


def _number(text: Column, precision: int = 38, scale: int = 9) -> Column:
    return text.try_cast(f"decimal({precision},{scale})")


def duration_ms(text: Column) -> Column:
    """Milliseconds of ``20s``, ``1h30m``, ``30 sec``, ``2 mins`` or ``500 ms``.

    Segments add up; a fraction of a millisecond is cut off.
    """
    units = "|".join(sorted(DURATION_MS, key=len, reverse=True))
    segment = rf"({_NUMBER})\s*({units})"
    clean = F.trim(text)
    numbers = F.regexp_extract_all(clean, F.lit(segment), F.lit(1))
    names = F.regexp_extract_all(clean, F.lit(segment), F.lit(2))
    pieces = F.zip_with(
        numbers,
        names,
        lambda n, u: F.try_multiply(_number(n, 19, 6), _lookup(DURATION_MS, 15, 6, u)).cast(
            "decimal(38,6)"
        ),
    )
    total = F.aggregate(pieces, F.lit(Decimal(0)).cast("decimal(38,6)"), lambda a, b: (a + b).cast("decimal(38,6)"))
    return F.when(clean.rlike(rf"^(?:(?:{_NUMBER})\s*(?:{units})\s*)+$"), F.floor(total).try_cast("bigint"))


def size_bytes(text: Column, step: int = 1024) -> Column:
    """Bytes of ``1 MB`` or ``16 KB``; ``step`` is the factor between two units."""
    pattern = rf"^\s*({_NUMBER})\s*(B|KB|MB|GB|TB)\s*$"
    table = {unit: str(step**power) for unit, power in SIZE_POWERS.items()}
    number = _number(F.regexp_extract(text, pattern, 1), 19, 3)
    unit = F.regexp_extract(text, pattern, 2)
    scaled = F.try_multiply(number, _lookup(table, 16, 0, unit))
    return F.when(text.rlike(pattern), F.floor(scaled).try_cast("bigint"))


def ratio(text: Column) -> Column:
    """``50%`` as 0.5."""
    pattern = rf"^\s*({_NUMBER})\s*%\s*$"
    number = F.regexp_extract(text, pattern, 1).try_cast("double")
    return F.when(text.rlike(pattern), number / F.lit(100.0))


def valid_quantity(text: Column) -> Column:
    """Does the text follow the resource-quantity grammar?"""
    return text.rlike(values.QUANTITY_PATTERN)


def parse_quantity(text: Column) -> Column:
    """a resource quantity as DECIMAL(38,9).

    ``m`` is a thousandth, ``M`` a million, ``Mi`` 2^20; ``1e3`` is an exponent, ``1E`` a suffix.
    Out of range gives null. With a suffix of ``k`` and above, six decimals of the result count.
    """
    parts = rf"^([+-]?(?:{_NUMBER}))([KMGTPE]i|[numkMGTPE])$"
    mantissa = _number(F.regexp_extract(text, parts, 1), 28, 9)
    suffix = F.regexp_extract(text, parts, 2)
    small = F.try_multiply(mantissa, _lookup(SMALL_FACTORS, 10, 9, suffix))
    large = F.try_multiply(mantissa, _lookup(LARGE_FACTORS, 19, 0, suffix))
    scaled = F.when(suffix.isin(*SMALL_FACTORS), small.try_cast("decimal(38,9)")).otherwise(
        large.try_cast("decimal(38,9)")
    )
    # Without a suffix the text is a number as it stands, with or without an exponent.
    value = F.when(suffix == "", _number(text)).otherwise(scaled)
    return F.when(valid_quantity(text), value)
