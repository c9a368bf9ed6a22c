"""Small things about files in whatever store Spark reads: names, markers, deletion."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _store(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it is not there."""
    at, store = _store(spark, path)
    return sorted(x.getPath().getName() for x in store.listStatus(at)) if store.exists(at) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole or not at all: written beside and renamed."""
    at, store = _store(spark, path)
    beside = at.suffix(".part")
    out = store.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    store.delete(at, False)
    if not store.rename(beside, at):
        raise OSError(f"cannot rename {beside} to {at}")


def delete_path(spark: SparkSession, path: str) -> None:
    at, store = _store(spark, path)
    store.delete(at, True)
