"""Intermediate tables in the folder that the driver and all executors share.

Lineage is cut by writing a table and reading it again.  The folder is the one
the cluster names in ``spark.checkpoint.dir``; only where that setting is
missing and Spark is local (tests) a folder of our own is made.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_root: str | None = None
_written: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``, or on a local Spark a temporary one if unset."""
    global _own_root
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _own_root is None:
        _own_root = tempfile.mkdtemp(prefix="colloquy-")
    return _own_root


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses."""
    path = f"{shared_root(spark)}/colloquy/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_drop_all, spark)
    _written.add(path)
    return path


def save(df: DataFrame, name: str, bloom: str | None = None, path: str | None = None, wide: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return it as read back.

    ``bloom`` names a column that gets a Parquet Bloom filter in every file;
    ``path`` is a folder below one of :func:`new_path`, for a table in parts.
    Some rows of a ``wide`` table are megabytes: Parquet looks at a page's size
    after each row, not after a hundred, and compresses it as a stream, without
    buffers of a page's size that an executor keeps.
    """
    spark = df.sparkSession
    path = path or new_path(spark, name)
    writer = df.write
    if bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{bloom}", "true")
    if wide:
        writer = writer.option("parquet.page.size.row.check.min", "1").option("parquet.page.size.row.check.max", "1").option("compression", "zstd")
    writer.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._saved_at = path
    return table


def drop(df: DataFrame) -> None:
    """Delete a table made by :func:`save` that nothing will read again."""
    path = getattr(df, "_saved_at", None)
    if path in _written:
        _delete(df.sparkSession, path)
        _written.discard(path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _drop_all(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    for path in list(_written):
        _delete(spark, path)
