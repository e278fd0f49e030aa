"""Column expressions shared by the operators. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def indicator(column: Column, value) -> Column:
    """1 where the column equals value, else 0; a null counts as different."""
    return column.eqNullSafe(F.lit(value)).cast("int")


def ordinal(column: Column, codes: dict[str, int]) -> Column:
    """Code of a category; null for a category without one."""
    pairs = [F.lit(part) for item in codes.items() for part in item]
    return F.create_map(*pairs)[column]


def right_closed_band(column: str, edges: list, labels: list[str]) -> Column:
    """Label of the band (low, high] holding the value; null outside all bands."""
    band = None
    for low, high, label in zip(edges, edges[1:], labels):
        inside = (F.col(column) > low) & (F.col(column) <= high)
        band = F.when(inside, label) if band is None else band.when(inside, label)
    return band


def status(label: str) -> Column:
    return F.when(F.col(label) == 1, "Churned").when(F.col(label) == 0, "Retained")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient as double, 0 where the denominator is 0."""
    return F.coalesce(
        F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0)
    )


def correlation(a: Column, b: Column) -> Column:
    """Pearson r as an aggregate; null if one side is constant, which corr() rejects."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def half_even(column: Column, digits: int) -> Column:
    return F.bround(column, digits)


def whole(column: Column) -> Column:
    """Integer part, cut towards zero."""
    return column.cast("long")


def rounded_values(columns: list[str], digits: int = 6) -> list[Column]:
    """The columns as doubles of the given digits."""
    return [F.bround(F.col(f"`{c}`").cast("double"), digits).alias(c) for c in columns]


def fingerprint(columns: list[Column]) -> Column:
    """16 bytes that equal rows share: two hashes over all values and over which of them are missing.

    Different rows may share them too: whoever counts equal rows compares the values of those that do.
    """
    gaps = [c.isNull().cast("tinyint") for c in columns]
    return F.struct(F.xxhash64(*columns, *gaps).alias("a"), F.xxhash64(*gaps, F.lit("second"), *reversed(columns)).alias("b"))
