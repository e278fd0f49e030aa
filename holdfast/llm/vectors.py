"""Tables of vectors for the search operators."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F


def usable(df: DataFrame, vector: str, nonzero: bool = False) -> DataFrame:
    """vec_id, vec (array<double>) and size of the rows that take part, one for each vec_id.

    Null ids, null or empty vectors and those with null or non-finite components (and zero vectors, with
    nonzero) do not. Of rows with equal vec_id the smallest vector counts.
    """
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    vec = F.col(vector).cast("array<double>")
    rows = df.select(F.col("vec_id").cast("bigint").alias("vec_id"), vec.alias("vec"))
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size("vec") > 0) & ~F.coalesce(F.exists("vec", bad), F.lit(True)))
    if nonzero:
        rows = rows.where(F.exists("vec", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("vec").alias("vec")).withColumn("size", F.size("vec"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def best(found: DataFrame, k: int, score: str = "score", by: str | None = None) -> DataFrame:
    """The k best rows of each query, by the score or the column `by`, ranked from 1; ties go to the smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc(by or score), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", score)


def by_size(rows: DataFrame, search: Callable[[DataFrame, int], DataFrame], empty: str) -> DataFrame:
    """Search among vectors of equal size, for each size there is; rows: stored vectors."""
    out = rows.sparkSession.createDataFrame([], empty)
    for (size,) in sorted(rows.select("size").distinct().collect()):
        out = out.unionByName(search(rows.where(F.col("size") == size), size))
    return out


def is_query(every: int) -> Column:
    return F.col("vec_id") % every == 0
