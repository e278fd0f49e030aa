"""Row counts, missing values and key uniqueness of a table that grows, from its new files only.

Every run of the stream measures the files that have come since the last one: counts, and a mergeable sketch
of the distinct keys. A report adds the measures up. It is exact but for the number of
distinct keys, whose relative error is `error(lg)` at one standard deviation; quality.key_uniqueness is exact
and reads everything.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

LG = 14  # the sketch has 2**LG registers


def error(lg: int = LG) -> float:
    """Standard error of the estimated number of keys, as a share of it."""
    return 1.04 / math.sqrt(2**lg)


def measured(rows: DataFrame, key: str, lg: int = LG) -> DataFrame:
    """One row: rows, rows without key, missing values by column (map), and the sketch of the keys."""
    gaps = [x for c in rows.columns for x in (F.lit(c), F.count_if(F.col(f"`{c}`").isNull()))]
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(f"`{key}`").isNull()).alias("n_without_key"),
        F.create_map(*gaps).alias("n_missing"), F.hll_sketch_agg(F.col(f"`{key}`").cast("string"), lg).alias("keys"),
    )


def measure_arrivals(spark: SparkSession, source: str, schema: StructType, key: str, store: str, checkpoint: str, lg: int = LG) -> StreamingQuery:
    """Measure all parquet files in source not seen before, then stop. A batch run again replaces its own measures."""

    def write(rows: DataFrame, number: int) -> None:
        measured(rows, key, lg).write.mode("overwrite").parquet(f"{store}/batch={number}")

    arriving = spark.readStream.schema(schema).parquet(source)
    return arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def report(measures: DataFrame, lg: int = LG, deviations: float = 4.0) -> DataFrame:
    """One row over all measures: rows, rows without key, estimated keys, whether the rows may all have keys of their
    own (within so many standard errors), and missing values by column."""
    long = measures.select(F.explode("n_missing").alias("column", "n")).groupBy("column").agg(F.sum("n").alias("n"))
    gaps = long.agg(F.map_from_entries(F.collect_list(F.struct("column", "n"))).alias("n_missing"))
    total = measures.agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("n_without_key"), F.lit(0)).alias("n_without_key"),
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("keys")), F.lit(0)).alias("keys_estimated"),
    )
    away = F.abs(F.col("n_rows") - F.col("keys_estimated"))
    unique = (F.col("n_without_key") == 0) & (away <= deviations * error(lg) * F.col("n_rows"))
    return total.withColumn("may_be_unique", unique.cast("int")).crossJoin(F.broadcast(gaps))
