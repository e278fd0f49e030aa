"""Folders whose content is replaced as a whole.

A version is written next to the current one under a name of its own. Only when it is complete does the file
_current, which names a version and describes it, get replaced, by a rename that overwrites. So a reader finds
the old content or the new one; a write that fails leaves the old one; and content may be computed from
what it replaces. The version before the current one is kept for those who still read it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

POINTER = "_current"


def file_system(spark: SparkSession, path: str):
    """Hadoop's path and file system of a file, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _read(spark: SparkSession, path: str) -> str | None:
    place, store = file_system(spark, path)
    if not store.exists(place):
        return None
    source = store.open(place)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def current(spark: SparkSession, path: str) -> dict | None:
    """What describes the current version, its folder among it; None if there is none."""
    place, store = file_system(spark, path)
    if not store.exists(place) or not store.getFileStatus(place).isDirectory():
        return None  # a path below a file is an error in some stores
    found = _read(spark, f"{path}/{POINTER}")
    return None if found is None else json.loads(found)


def new_folder(path: str) -> str:
    """Where a version may be written. It counts for nothing until it is published."""
    return f"{path}/version-{uuid.uuid4().hex}"


def publish(spark: SparkSession, path: str, folder: str, about: dict | None = None) -> None:
    """Make a complete version the current one."""
    jvm, before = spark.sparkContext._jvm, current(spark, path)
    draft, store = file_system(spark, f"{path}/.{POINTER}-{uuid.uuid4().hex}")
    out = store.create(draft, True)
    try:
        out.write(bytearray(json.dumps({**(about or {}), "folder": folder}).encode()))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    renames = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    renames[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(store.makeQualified(draft), store.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}")), renames)
    kept = {folder.rsplit("/", 1)[1], (before or {"folder": folder})["folder"].rsplit("/", 1)[1]}
    for status in store.listStatus(jvm.org.apache.hadoop.fs.Path(path)):
        name = status.getPath().getName()
        if name.startswith("version-") and name not in kept:
            store.delete(status.getPath(), True)


def resolve(spark: SparkSession, path: str) -> str:
    """Where the content of a path is: in its current version, in that of the folder it is in, or at the path itself."""
    if found := current(spark, path):
        return found["folder"]
    parent, _, name = path.rstrip("/").rpartition("/")
    found = current(spark, parent) if parent else None
    return f"{found['folder']}/{name}" if found else path
