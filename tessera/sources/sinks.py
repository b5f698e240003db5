"""Tables that are written and read back: versions of a folder, each written whole before it counts.

A table is a folder of versions ``v=0, v=1, ...``; the last one with Spark's success marker is the table. A change
writes the next version from the last one, so readers see either all of it or none, and a job that dies leaves no trace.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import core


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below the checkpoint folder, which a cluster must name; on one machine else the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/tessera-tables/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new shared folder and read back: computed once, and safe from lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _versions(spark: SparkSession, path: str, whole: bool = True) -> list[int]:
    """Numbers of the versions, of whole ones only or also of those that a job began and left."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(conf)
    if not fs.exists(folder):
        return []
    names = [s.getPath() for s in fs.listStatus(folder)]
    return sorted(int(p.getName()[2:]) for p in names if p.getName().startswith("v=") and (not whole or fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table's last complete version."""
    return spark.read.parquet(f"{path}/v={_versions(spark, path)[-1]}")


def write(df: DataFrame, path: str, by: list[str] | None = None) -> DataFrame:
    """A new version with these rows; partitioned where asked. Returns what a second read finds."""
    spark = df.sparkSession
    version = max(_versions(spark, path, whole=False), default=-1) + 1
    df.write.partitionBy(*(by or [])).parquet(f"{path}/v={version}")
    return read(spark, path)


def create(df: DataFrame, name: str) -> str:
    path = scratch(df.sparkSession, name)
    write(df, path)
    return path


def change(spark: SparkSession, path: str, how: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return write(how(read(spark, path)), path)


def append(rows: DataFrame, path: str) -> DataFrame:
    return change(rows.sparkSession, path, lambda old: old.unionByName(rows))


def upsert(rows: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Rows replace those with the same keys; of several new ones with a key any order must have been settled before."""
    return change(rows.sparkSession, path, lambda old: core.key_merge(old, rows, keys))


def replace_groups(rows: DataFrame, path: str, group: list[str]) -> DataFrame:
    """All rows of the groups that occur in ``rows`` go, then ``rows`` come in, in one version."""
    return change(rows.sparkSession, path, lambda old: old.join(rows.select(*group).distinct(), group, "left_anti").unionByName(rows))


def delete_keys(keys: DataFrame, path: str) -> DataFrame:
    return change(keys.sparkSession, path, lambda old: old.join(keys.distinct(), keys.columns, "left_anti"))


def delete_where(spark: SparkSession, path: str, condition: Column) -> DataFrame:
    """Rows for which the condition is true go; null is not true."""
    return change(spark, path, lambda old: old.where(~F.coalesce(condition, F.lit(False))))
