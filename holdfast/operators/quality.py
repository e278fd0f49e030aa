"""Ingest rules and data-quality audits."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType

from holdfast.functions import expressions as E
from holdfast.functions.fixed import CHURNED_VALUE, ID, LABEL, LEAK_MARKER, RAW_TARGET
from holdfast.functions.groups import with_group
from holdfast.sources.schema import numeric_columns, string_columns
from holdfast.sources.tables import settle


def drop_leak_columns(df: DataFrame) -> DataFrame:
    """Drop every column whose name marks it as another model's output."""
    leaks = [name for name in df.columns if LEAK_MARKER in name]
    if not leaks:
        warnings.warn("no leak columns in the raw table", stacklevel=2)
    return df.drop(*leaks)


def encode_target(df: DataFrame) -> DataFrame:
    """Replace the text target by the 0/1 label, as last column."""
    if RAW_TARGET not in df.columns:
        raise KeyError(f"expected target column {RAW_TARGET!r}")
    return df.withColumn(LABEL, E.indicator(F.col(RAW_TARGET), CHURNED_VALUE)).drop(RAW_TARGET)


def ingest(raw: DataFrame) -> DataFrame:
    return encode_target(drop_leak_columns(raw))


def _empty(df: DataFrame, name: str):
    missing = F.col(f"`{name}`").isNull()
    if isinstance(df.schema[name].dataType, (DoubleType, FloatType)):
        missing = missing | F.isnan(f"`{name}`")
    return missing


def _tidy(row: DataFrame, checks: list[tuple[str, str, str]]) -> DataFrame:
    """Turn one wide row into (check, column, value) rows."""
    parts = [
        F.struct(F.lit(check).alias("check"), F.lit(column).alias("column"), F.col(f"`{source}`").cast("double").alias("value"))
        for check, column, source in checks
    ]
    return row.select(F.inline(F.array(*parts)))


def met_again(df: DataFrame, columns: list[Column], digest: Callable[[list[Column]], Column] = E.fingerprint, among: Column | None = None) -> DataFrame:
    """The rows whose digest over the columns is met more than once, with the digest as __digest.

    among: a group's condition instead of its size, an aggregate. Only digests are shuffled to find them; then
    few rows are left whose values must be compared.
    """
    marked = df.withColumn("__digest", digest(columns))
    per_digest = marked.groupBy("__digest").agg(F.count(F.lit(1)).alias("__n"), (F.count(F.lit(1)) > 1 if among is None else among).alias("__again"))
    again = settle(per_digest.filter("__again").drop("__again"), "digests")
    return with_group(marked, again, "__digest", "__n").drop("__n")


def duplicate_rows(df: DataFrame, digest: Callable[[list[Column]], Column] = E.fingerprint) -> DataFrame:
    """Number of rows that equal an earlier one, nulls being equal.

    Digests are counted first; whole rows are compared only where a digest is met again, copies merged on the map
    side. So the result is exact whatever the digest.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    groups = met_again(df, columns, digest).groupBy("__digest", *columns).agg(F.count(F.lit(1)).alias("__n"))
    return groups.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicates"))


def quality_audit(df: DataFrame) -> DataFrame:
    """Rows, columns, nulls, fully empty columns, duplicates and column kinds.

    One scan counts, another finds duplicates by their digests: no wide row is shuffled but those met again.
    """
    row = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count_if(_empty(df, c)).alias(c) for c in df.columns])
    row = row.withColumn("__duplicates", duplicate_rows(df).scalar())
    total = sum((F.col(f"`{c}`") for c in df.columns), F.lit(0))
    empty = sum(((F.col(f"`{c}`") == F.col("__rows")).cast("int") for c in df.columns), F.lit(0))
    row = row.withColumns(
        {
            "__nulls": total,
            "__empty": F.when(F.col("__rows") > 0, empty).otherwise(0),
            "__columns": F.lit(len(df.columns)),
            "__numeric": F.lit(len(numeric_columns(df))),
            "__text": F.lit(len(string_columns(df))),
        }
    )
    table = [
        ("rows", "__rows"), ("columns", "__columns"), ("duplicate_rows", "__duplicates"),
        ("nulls_total", "__nulls"), ("empty_columns", "__empty"),
        ("numeric_columns", "__numeric"), ("text_columns", "__text"),
    ]
    return _tidy(row, [(check, "*", source) for check, source in table] + [("nulls", c, c) for c in df.columns])


def feature_audit(features: DataFrame, label: str = LABEL) -> DataFrame:
    """Shape, kinds, nulls and class balance of a feature table in one scan."""
    row = features.agg(
        F.count(F.lit(1)).alias("rows"),
        sum((F.count_if(_empty(features, c)) for c in features.columns), F.lit(0)).alias("nulls_total"),
        F.round(F.avg(label) * 100, 6).alias("churn_rate"),
    ).withColumns(
        {
            "columns": F.lit(len(features.columns)),
            "numeric_columns": F.lit(len(numeric_columns(features))),
            "text_columns": F.lit(len(string_columns(features))),
        }
    )
    checks = ["rows", "columns", "numeric_columns", "text_columns", "nulls_total", "churn_rate"]
    return _tidy(row, [(check, "*", check) for check in checks])


def key_uniqueness(df: DataFrame, key: str = ID) -> DataFrame:
    """Rows, distinct keys and whether every row has a key of its own."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(key).alias("n_keys")
    ).withColumn("is_unique", (F.col("n_rows") == F.col("n_keys")).cast("int"))
