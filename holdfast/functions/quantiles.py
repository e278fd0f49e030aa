"""Exact quantiles of any number of groups by narrowing the brackets of their ranks.

Every wanted rank of every group has a bracket of values, at first the group's whole range. A round
counts, for all groups at once and merged on the map side, the rows in the cells of each bracket, and
keeps the cells that hold a wanted rank; their smallest and largest values are the next bracket. A
bracket with few rows is cut by value instead. Cells are equal parts of the bracket, every second
round of the logarithms in it, so that values that crowd anywhere are told apart after a few rounds. A bracket whose ends are equal is a solved rank, so a
value that a third of the rows share ends the search.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from holdfast.functions.groups import with_group
from holdfast.sources.tables import drop_table, settle

CELLS = 256
BY_VALUE = 2_048  # rows of a bracket that is cut by value
LEAST_LOG = 745.0  # the logarithm of the smallest double is -744.4
ROUNDS = 100

BRACKETS = "lo double, hi double, before bigint, n bigint, total bigint"


def _ranks(total: int, shares: list[float]) -> list[int]:
    """Ranks, from 0, between which the quantiles lie."""
    return sorted({f((total - 1) * s) for s in shares for f in (math.floor, math.ceil)})


def _magnitude(x: Column) -> Column:
    """Rises with x over all doubles, by the logarithm of its size on either side of 0."""
    return F.when(x == 0, 0.0).otherwise(F.signum(x) * (F.log(F.abs(x)) + LEAST_LOG))


def _cell(x: Column, b: Column, by_magnitude: bool) -> Column:
    """Number of the cell of a value in its bracket: rises with the value, whatever the rounding."""
    low, high = b["lo"] / 2, b["hi"] / 2
    place = (x / 2 - low) / (high - low)
    if by_magnitude:
        place = (_magnitude(x) - _magnitude(b["lo"])) / (_magnitude(b["hi"]) - _magnitude(b["lo"]))
    cell = F.coalesce(F.floor(F.least(F.lit(1.0), place) * (CELLS - 1)).cast("double"), F.lit(0.0))
    return F.when(b["n"] <= BY_VALUE, x).otherwise(cell)


def quantiles(rows: DataFrame, key: str, value: str, shares: list[float]) -> DataFrame:
    """One row per group: key, total, and quantiles (array) by linear interpolation.

    value holds doubles, neither null nor NaN, which may be infinite; key is not null. What a task or a grouped call
    holds is bounded by cells, not rows; brackets are broadcast only as with_group allows.
    """
    kind = rows.schema[key].dataType.simpleString()
    x = F.greatest(F.lit(-1.7976931348623157e308), F.least(F.lit(1.7976931348623157e308), F.col(value)))
    data = rows.select(F.col(key).alias("key"), x.alias("x"))

    def narrowed(cells: pa.Table) -> pa.Table:
        """The cells of a group that hold a wanted rank, as the next brackets."""
        found = sorted(zip(*(cells[c].to_pylist() for c in ("base", "cell", "n", "lo", "hi"))))
        group, total = cells["key"][0], cells["total"][0].as_py()
        out, at, base = [], 0, None
        ranks = _ranks(total, shares)
        for first, _, n, lo, hi in found:
            at, base = (first, first) if first != base else (at, base)
            if any(at <= r < at + n for r in ranks):
                out.append((lo, hi, at, n, total))
            at += n
        columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()))]
        return pa.table([pa.array([group.as_py()] * len(out), cells["key"].type), *columns], ["key", "lo", "hi", "before", "n", "total"])

    ranges = data.groupBy("key").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("x").alias("n"))
    brackets = settle(ranges.select("key", "lo", "hi", F.lit(0).cast("bigint").alias("before"), "n", F.col("n").alias("total")), "brackets")
    solved = []
    for number in range(ROUNDS):
        solved.append(brackets.filter("lo = hi"))
        left = brackets.filter("lo < hi")
        if left.isEmpty():
            break
        b = F.struct("lo", "hi", "before", "n")
        by_group = settle(left.groupBy("key").agg(F.collect_list(b).alias("b"), F.first("total").alias("total")), "brackets-by-group")
        met = with_group(data, by_group, "key", "total").select(
            "key", "total", "x", F.get(F.filter("b", lambda c: (c["lo"] <= F.col("x")) & (F.col("x") <= c["hi"])), F.lit(0)).alias("b")
        )
        cell = _cell(F.col("x"), F.col("b"), number % 2 == 1)
        counts = met.filter("b is not null").groupBy("key", "total", F.col("b.before").alias("base"), cell.alias("cell"))
        cells = counts.agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        brackets = settle(cells.groupBy("key").applyInArrow(narrowed, f"key {kind}, {BRACKETS}"), "brackets")
        drop_table(by_group)
    else:
        raise ArithmeticError("brackets do not narrow")

    def interpolated(found: pa.Table) -> pa.Table:
        total = found["total"][0].as_py()
        spans = list(zip(found["before"].to_pylist(), found["n"].to_pylist(), found["lo"].to_pylist()))
        at = lambda rank: next(v for first, n, v in spans if first <= rank < first + n)
        out = []
        for s in shares:
            place = (total - 1) * s
            low, high = at(math.floor(place)), at(math.ceil(place))
            out.append(low + (high - low) * (place - math.floor(place)))
        names = ["key", "total", "quantiles"]
        return pa.table([pa.array([found["key"][0].as_py()], found["key"].type), pa.array([total], pa.int64()), pa.array([out], pa.list_(pa.float64()))], names)

    ends = solved[0]
    for more in solved[1:]:
        ends = ends.unionByName(more)
    result = ends.groupBy("key").applyInArrow(interpolated, f"key {kind}, total bigint, quantiles array<double>")
    return result.withColumnRenamed("key", key)
