"""State of a build that must outlive a crash: a marker while a build runs, and stored results by input hash."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def has_folder(spark: SparkSession, path: str) -> bool:
    return _exists(spark, path)


def mark_dirty(spark: SparkSession, path: str, reason: str = "build") -> None:
    """Leave a marker in the shared folder before a build changes anything there."""
    spark.createDataFrame([(reason,)], "reason string").coalesce(1).write.mode("overwrite").json(f"{path}/_dirty")


def is_dirty(spark: SparkSession, path: str) -> bool:
    """True after a build that began and didn't end: the next one must be a full one."""
    return _exists(spark, f"{path}/_dirty")


def clear_dirty(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_dirty")
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def latest_folder(spark: SparkSession, root: str, mark: str = "_SUCCESS") -> str | None:
    """The name of the newest folder below root whose mark, which is written last, is there; None if there is none."""
    if not _exists(spark, root):
        return None
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    done = [(system.getFileStatus(path(e.getPath(), mark)).getModificationTime(), e.getPath().getName()) for e in system.listStatus(path(root)) if system.exists(path(e.getPath(), mark))]
    return max(done)[1] if done else None


def finalized(inputs: DataFrame, cache: str, make: Callable[[DataFrame], DataFrame], key: str = "key", value: str = "hash") -> DataFrame:
    """Results of make(inputs) by (key, hash), those of unchanged inputs from the stored folder ``cache``.

    make returns rows that carry key and hash. The whole state is written anew beside the old one under a name of its own,
    so a crash leaves the old and two builds at once don't meet; the newest folder that was completed counts.
    """
    spark = inputs.sparkSession
    version, latest = uuid.uuid4().hex, latest_folder(spark, cache)
    if latest is None:
        out = make(inputs)
    else:
        old = spark.read.parquet(f"{cache}/{latest}")
        same = old.join(inputs.select(key, value).distinct(), [key, value], "left_semi")
        fresh = make(inputs.join(old.select(key, value).distinct(), [key, value], "left_anti"))
        out = same.unionByName(fresh)
    out.write.parquet(f"{cache}/{version}")
    return spark.read.parquet(f"{cache}/{version}")
