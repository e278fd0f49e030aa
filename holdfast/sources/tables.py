"""Scans and sinks."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType

from holdfast.sources.schema import RAW
from holdfast.sources.versions import file_system, new_folder, publish, resolve


_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach, named by spark.checkpoint.dir.

    Only a session without that setting (a local test) gets a folder of its own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get(context.applicationId)
    if named is None:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        named = _OWN[context.applicationId] = tempfile.mkdtemp(prefix="holdfast-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def fresh_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def read_csv(spark: SparkSession, path: str, schema: StructType = RAW) -> DataFrame:
    """Raw customers from CSV under the declared schema; header names must agree with it."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(path)
    )


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table; of one that has been replaced the version that is current now."""
    return spark.read.parquet(resolve(spark, path))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Write a table to path, where nothing that matters is, and return it, read back.

    The rows are counted on their way out and again in the written files; a
    difference is an error.
    """
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    sent, found = seen.get["rows"], stored.count()
    if sent != found:
        raise RuntimeError(f"{path}: {sent} rows written, {found} found")
    return stored


def replace_table(df: DataFrame, path: str) -> DataFrame:
    """Replace the table at path, whatever df is computed from, and return it, read back.

    Readers (read_table) find the old table until the new one is written and verified, then the new one.
    """
    folder = new_folder(path)
    stored = write_table(df, folder)
    publish(df.sparkSession, path, folder, {"columns": df.columns})
    return stored


def files_state(spark: SparkSession, paths: list[str]) -> tuple:
    """What tells whether the files below some paths have changed: number, bytes, and a sum over path, size and time.

    Spark lists the files and adds them up; their content is not read, and nothing is asked for per file from here.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    mark = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
    return tuple(files.agg(F.count("*"), F.sum("length"), F.sum(mark)).first())


def drop_table(df: DataFrame) -> None:
    """Delete the folder of a table that settle has written."""
    for folder in {os.path.dirname(file) for file in df.inputFiles()}:
        path, store = file_system(df.sparkSession, folder)
        store.delete(path, True)


def write_report(df: DataFrame, path: str) -> None:
    """A result of a few rows (metrics, comparisons) as one CSV file with header."""
    write_csv(df.coalesce(1), path)


def read_report(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return read_csv(spark, resolve(spark, path), schema)


#: Folders that settle has written, by session, in order.
_STORED: dict[str, list[str]] = {}


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df once into the shared folder so that several jobs can read it.

    The table stays until drop_table, clear_since or the end of the folder.
    """
    path = fresh_path(df.sparkSession, name)
    _STORED.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    return write_table(df, path)


def stored_so_far(spark: SparkSession) -> int:
    """A mark for clear_since."""
    return len(_STORED.get(spark.sparkContext.applicationId, []))


def clear_since(spark: SparkSession, mark: int) -> None:
    """Delete the tables settle has written since the mark, once what was computed from them is itself written.

    Tables of other threads count too: a session that computes several things side by side clears at its end.
    """
    paths = _STORED.get(spark.sparkContext.applicationId, [])
    for path in paths[mark:]:
        place, store = file_system(spark, path)
        store.delete(place, True)
    del paths[mark:]
