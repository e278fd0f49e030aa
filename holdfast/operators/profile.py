"""Profiles of the customers table: rates, distributions, quantiles, correlations.

Every result is the data behind a chart. The distribution operators group by any
column, a group for each value it has; a list of classes leaves out the others.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from holdfast.functions import expressions as E
from holdfast.functions.fixed import AGE_EDGES, AGE_LABELS, ID, LABEL, SEED, SEGMENTS
from holdfast.functions.groups import with_group
from holdfast.functions.ordering import hash_key
from holdfast.functions.quantiles import quantiles
from holdfast.sources.schema import numeric_columns
from holdfast.sources.tables import settle

MERGED = 64  # sums of more tasks than this are joined by tasks before the driver joins the rest
KERNEL_ROWS = 64  # a block of kernels stays in the processor cache
LOSSLESS, CLOSE = 39.0, 8.5  # bandwidths a kernel reaches
FEW = 64  # classes whose kernels every task sums for its own rows
PIECE_ROWS = 100_000  # distinct values of a class that go to one task
HELD = 4_000_000  # grid points a task holds before it hands them on


def class_balance(df: DataFrame, label: str = LABEL) -> DataFrame:
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).withColumn("share_pct", F.col("n") / total * 100)


def summary(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Headline numbers of the portfolio in one scan."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(F.col(label).cast("long")).alias("churned"),
        F.count_if(F.col(label) == 0).alias("retained"),
        (F.avg(label) * 100).alias("churn_rate"),
        F.avg("Customer_Age").alias("avg_age"),
        F.avg("Credit_Limit").alias("avg_credit_limit"),
        F.avg("Total_Trans_Ct").alias("avg_transactions"),
        F.avg("Avg_Utilization_Ratio").alias("avg_utilisation"),
    ).withColumn("features", F.lit(len(df.columns) - 1))


def _mean_rate(df: DataFrame, label: str) -> Column:
    return df.agg(F.avg(label) * 100).scalar()


def rate_by(df: DataFrame, key: Column, name: str, label: str = LABEL) -> DataFrame:
    """Rows and churn rate per key next to the overall rate; rows without a key are left out."""
    return (
        df.groupBy(key.alias(name))
        .agg(F.count(F.lit(1)).alias("n"), (F.avg(label) * 100).alias("rate"))
        .filter(F.col(name).isNotNull())
        .withColumn("overall", _mean_rate(df, label))
    )


def rate_by_age(df: DataFrame, label: str = LABEL) -> DataFrame:
    return rate_by(df, E.right_closed_band("Customer_Age", AGE_EDGES, AGE_LABELS), "age_group", label)


def rate_by_segment(df: DataFrame, segments: list[str] = SEGMENTS, label: str = LABEL) -> DataFrame:
    """Churn rate of each value of each segment column, one shuffle for all columns."""
    pairs = [F.struct(F.lit(s).alias("segment"), F.col(s).alias("value")) for s in segments]
    return (
        df.select(label, F.inline(F.array(*pairs)))
        .filter(F.col("value").isNotNull())
        .groupBy("segment", "value")
        .agg(F.count(F.lit(1)).alias("n"), (F.avg(label) * 100).alias("rate"))
        .withColumn("overall", _mean_rate(df, label))
        .orderBy("segment", F.col("rate").desc(), "value")
    )


def contacts_by_status(df: DataFrame, label: str = LABEL) -> DataFrame:
    return (
        df.groupBy("Contacts_Count_12_mon", label)
        .agg(F.count(F.lit(1)).alias("n"))
        .select("Contacts_Count_12_mon", E.status(label).alias("Status"), "n")
    )


def _classed(df: DataFrame, by: str | None, classes: tuple | None) -> tuple[DataFrame, Column]:
    """Rows with a class, and the column that holds it. Rows without a class belong to no group."""
    if by is None:
        return df, F.lit(0)
    wanted = F.col(by).isNotNull() if classes is None else F.col(by).isin(*classes)
    return df.filter(wanted), F.col(by)


def histogram(
    df: DataFrame, columns: list[str], bins: int, by: str | None = LABEL, classes: tuple | None = None
) -> DataFrame:
    """Equal-width histograms, the range taken per feature and class.

    Two scans for any number of columns. The last bin is closed; a constant
    column has one bin of width 1; empty bins are kept. Ranges are a row per class
    in a table joined to the rows.
    """
    df, group = _classed(df, by, classes)
    finite = [F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")) for c in columns]
    rows = df.select(group.alias("by"), *[x.alias(f"x{i}") for i, x in enumerate(finite)])
    bounds = [
        F.struct(F.min(f"x{i}").alias("low"), F.max(f"x{i}").alias("high"), F.count(f"x{i}").alias("total"))
        for i in range(len(columns))
    ]
    by_class = settle(rows.groupBy("by").agg(F.array(*bounds).alias("bounds"), F.count("*").alias("n_rows")), "ranges")

    def width(low: Column, high: Column) -> Column:
        return F.when(high > low, (high - low) / bins).otherwise(1.0)

    def place(i: int) -> Column:
        low, high = F.col("bounds")[i]["low"], F.col("bounds")[i]["high"]
        bin_ = F.least(F.floor((F.col(f"x{i}") - low) / width(low, high)), F.lit(bins - 1)).cast("int")
        return F.when(F.col(f"x{i}").isNotNull(), bin_)

    places = F.array(*[F.struct(F.lit(c).alias("feature"), place(i).alias("bin")) for i, c in enumerate(columns)])
    counts = (
        with_group(rows, by_class, "by", "n_rows").select("by", F.inline(places)).filter("bin is not null")
        .groupBy("by", "feature", "bin").agg(F.count(F.lit(1)).alias("n"))
    )
    named = F.arrays_zip(F.array(*[F.lit(c) for c in columns]).alias("feature"), F.col("bounds").alias("bound"))
    ranges = by_class.select("by", F.explode(named).alias("r")).select("by", F.col("r.feature"), "r.bound.*").filter("total > 0")
    ranges = ranges.withColumn("width", width(F.col("low"), F.col("high")))
    last = F.when(F.col("high") > F.col("low"), bins - 1).otherwise(0)
    table = (
        ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), last)))
        .join(counts, ["by", "feature", "bin"], "left")
        .select(
            "feature", "by", "bin",
            (F.col("low") + F.col("bin") * F.col("width")).alias("lo"),
            (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("hi"),
            F.coalesce("n", F.lit(0)).alias("n"),
            (F.coalesce("n", F.lit(0)) / (F.col("total") * F.col("width"))).alias("density"),
        )
    )
    return table.drop("by") if by is None else table


def kde(
    df: DataFrame,
    column: str,
    by: str | None = LABEL,
    classes: tuple | None = None,
    points: int = 1000,
    cut: float | None = None,
    reach: float = LOSSLESS,
) -> DataFrame:
    """Gaussian density per class on an even grid, bandwidth std * n**(-1/5).

    The grid spans the data plus half its range on both sides, or plus cut
    bandwidths. A value only touches the points within `reach` bandwidths, which
    lowers a density by exp(-reach**2 / 2) / (sqrt(2 pi) * bandwidth) at most;
    beyond LOSSLESS a kernel is 0 in double precision, beyond CLOSE below 2.1e-16 of its peak. A
    class without spread has no density. Grids are a row per class in a table
    that is joined to the rows. With few classes each task sums the kernels of
    its own rows and no row is shuffled; with many, equal values are counted
    first and a class goes to one task, a large one in pieces.
    """
    df, group = _classed(df, by, classes)
    data = df.select(group.alias("by"), F.col(f"`{column}`").cast("double").alias("x")).filter(
        "x is not null and not isnan(x) and abs(x) < double('infinity')"
    )
    shape = data.groupBy("by").agg(
        F.min("x").alias("low"), F.max("x").alias("high"), F.stddev_samp("x").alias("sd"), F.count("x").alias("total")
    )
    width = F.col("sd") * F.pow(F.col("total").cast("double"), F.lit(-0.2))
    pad = (F.col("high") - F.col("low")) / 2 if cut is None else F.col("width") * cut
    grids = settle(
        shape.withColumn("width", width).filter("width > 0").withColumn("pad", pad).select(
            "by", F.monotonically_increasing_id().alias("k"), (F.col("low") - F.col("pad")).alias("start"), "width", "total",
            ((F.col("high") + F.col("pad") - (F.col("low") - F.col("pad"))) / (points - 1)).alias("step"),
        ),
        "grids",
    )
    many = grids.count() > FEW
    rows = data.groupBy("by", "x").agg(F.count("*").alias("n")) if many else data.withColumn("n", F.lit(1).cast("bigint"))
    rows = with_group(rows, grids, "by", "total").select("k", "x", "n", "start", "step", "width", "total")
    if many:
        pieces = F.ceil(F.col("total") / PIECE_ROWS)
        rows = rows.repartition("k", F.pmod(F.xxhash64("x"), pieces))
    sums = rows.drop("total").mapInArrow(lambda batches: _kernel_sums(batches, points, reach), "k bigint, point int, mass double")
    sums = sums.groupBy("k", "point").agg(F.sum("mass").alias("mass"))
    scale = F.col("total") * F.col("width") * math.sqrt(2 * math.pi)
    sizes = grids.select("k", "by", "start", "step", "width", "total")
    table = with_group(sums, sizes, "k", "total").select(
        "by", "point", (F.col("start") + F.col("point") * F.col("step")).alias("g"), (F.col("mass") / scale).alias("density")
    )
    return table.drop("by") if by is None else table


def _kernel_sums(batches: Iterator[pa.RecordBatch], points: int, reach: float) -> Iterator[pa.RecordBatch]:
    """Sums of kernels by class k and grid point, of batches with k, x, n and the class's start, step and width."""
    held: dict[int, np.ndarray] = {}

    def flushed() -> pa.RecordBatch:
        k = np.repeat(np.fromiter(held, np.int64, len(held)), points)
        point = np.tile(np.arange(points, dtype=np.int32), len(held))
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(point), pa.array(np.concatenate(list(held.values())))], ["k", "point", "mass"])

    for batch in batches:
        if not batch.num_rows:
            continue
        k, x, n, start, step, width = (batch.column(i).to_numpy() for i in range(6))
        order = np.lexsort((x, k))
        k, x, n, start, step, width = (a[order] for a in (k, x, n, start, step, width))
        ends = np.append(np.flatnonzero(np.diff(k)) + 1, len(k))
        for first, last in zip(np.append(0, ends[:-1]).tolist(), ends.tolist()):
            values, place = np.unique(x[first:last], return_inverse=True)
            copies = np.bincount(place, n[first:last])
            low, gap, wide = float(start[first]), float(step[first]), float(width[first])
            total = held.setdefault(int(k[first]), np.zeros(points))
            for at in range(0, len(values), KERNEL_ROWS):
                some = values[at : at + KERNEL_ROWS]
                a = max(0, math.floor((some[0] - reach * wide - low) / gap))
                b = min(points, math.ceil((some[-1] + reach * wide - low) / gap) + 1)
                z = (low + np.arange(a, b) * gap)[None, :] - some[:, None]
                z /= wide
                z *= z
                z *= -0.5
                total[a:b] += copies[at : at + KERNEL_ROWS] @ np.exp(z, out=z)
            if len(held) * points >= HELD:
                yield flushed()
                held.clear()
    if held:
        yield flushed()


def box(df: DataFrame, column: str, by: str | None = LABEL, classes: tuple | None = None) -> DataFrame:
    """Quartiles by linear interpolation, whiskers within 1.5 IQR, outlier counts.

    Exact for any number of classes, without a sort or a window: see quantiles.
    """
    df, group = _classed(df, by, classes)
    data = df.select(group.alias("by"), F.col(f"`{column}`").cast("double").alias("x")).filter(
        "x is not null and not isnan(x)"
    )
    found = quantiles(data, "by", "x", [0.25, 0.5, 0.75])
    quartiles = settle(found.select("by", "total", *[F.col("quantiles")[k].alias(q) for k, q in enumerate(("q1", "q2", "q3"))]), "quartiles")
    spread = (F.col("q3") - F.col("q1")) * 1.5
    low, high = F.col("q1") - spread, F.col("q3") + spread
    table = (
        with_group(data, quartiles, "by", "total")
        .groupBy("by", "q1", "q2", "q3")
        .agg(
            F.min(F.when(F.col("x") >= low, F.col("x"))).alias("whisker_lo"),
            F.max(F.when(F.col("x") <= high, F.col("x"))).alias("whisker_hi"),
            F.count_if((F.col("x") < low) | (F.col("x") > high)).alias("n_out"),
        )
    )
    return table.drop("by") if by is None else table


#: What a task keeps for each pair of columns (a, b), over the rows that know both: their number, the mean of a, the
#: squares of a about it, and the products of both about theirs.
PAIR_SUMS = 4


def _pair_sums(x: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """PAIR_SUMS matrices of a block of rows; missing values are NaN. Values are moved by `shift` first."""
    known = ~np.isnan(x)
    moved = np.where(known, x - shift, 0.0)
    mask = known.astype(np.float64)
    n, total, squares, products = mask.T @ mask, moved.T @ mask, (moved**2).T @ mask, moved.T @ moved
    size = np.maximum(n, 1)
    return np.stack([n, shift[:, None] + total / size, squares - total**2 / size, products - total * total.T / size])


def _joined_sums(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """PAIR_SUMS of the rows of both."""
    n = one[0] + two[0]
    size, gap = np.maximum(n, 1), np.where((one[0] > 0) & (two[0] > 0), two[1] - one[1], 0.0)
    mean = np.where(one[0] > 0, one[1] + gap * two[0] / size, two[1])
    weight = one[0] * two[0] / size
    return np.stack([n, mean, one[2] + two[2] + gap**2 * weight, one[3] + two[3] + gap * gap.T * weight])


def _added_up(tables: Iterable[bytes], p: int) -> np.ndarray:
    return reduce(_joined_sums, (np.frombuffer(t).reshape(PAIR_SUMS, p, p) for t in tables), np.zeros((PAIR_SUMS, p, p)))


def correlations(df: DataFrame, exclude: tuple[str, ...] = (ID,)) -> DataFrame:
    """Pearson r of every pair of numeric columns (strict lower triangle).

    A pair counts the rows where both are known. One job for any pattern of nulls: each task multiplies its rows'
    values and masks as matrices, and the tasks' sums are joined, in groups first where tasks are many. A
    column that is constant in a pair's rows has no r.
    """
    names = numeric_columns(df, exclude)
    p = len(names)
    x = F.array(*[F.coalesce(F.col(f"`{name}`").cast("double"), F.lit(float("nan"))) for name in names])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, shift = np.zeros((PAIR_SUMS, p, p)), np.full(p, np.nan)
        for batch in batches:
            rows = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, p)
            for at in range(0, len(rows), 4_096):
                some = rows[at : at + 4_096]
                first = some[np.argmin(np.isnan(some), axis=0), np.arange(p)]
                shift = np.where(np.isnan(shift), first, shift)  # a column's first known value: constants stay exact
                total = _joined_sums(total, _pair_sums(some, np.where(np.isnan(shift), 0.0, shift)))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["task", "sums"])

    def merge(table: pa.Table) -> pa.Table:
        parts = sorted(zip(table["task"].to_pylist(), table["sums"].to_pylist()))
        return pa.table({"task": pa.array([parts[0][0]], pa.int32()), "sums": pa.array([_added_up((t for _, t in parts), p).tobytes()], pa.binary())})

    found = df.select(x.alias("x")).mapInArrow(work, "task int, sums binary")
    if df.sparkSession.sparkContext.defaultParallelism > MERGED:
        found = found.groupBy(F.col("task") % MERGED).applyInArrow(merge, "task int, sums binary")
    _, _, squares, products = _added_up((t for _, t in sorted(map(tuple, found.collect()))), p)
    rows = []
    for b, a in combinations(range(p), 2):
        spread = math.sqrt(squares[a, b]) * math.sqrt(squares[b, a]) if squares[a, b] > 0 and squares[b, a] > 0 else 0.0
        r = products[a, b] / spread if spread else None
        rows.append((names[a], names[b], None if r is None or math.isnan(r) else float(r)))
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def sample(df: DataFrame, n: int, key: str = ID, seed: int = SEED) -> DataFrame:
    """n rows chosen by a hash of key and seed, the same ones on every run."""
    return df.orderBy(hash_key(key, seed), key).limit(n)


def preview(df: DataFrame, n: int = 100, churned_only: bool = False, label: str = LABEL) -> DataFrame:
    return (df.filter(F.col(label) == 1) if churned_only else df).orderBy(ID).limit(n)
