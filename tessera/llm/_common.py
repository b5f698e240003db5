"""Helpers shared by the corpus operators: staged tables, clash-free columns, graph components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words in every word contract: space and U+0009..U+000D.
WORD_SEPARATORS = " \t\n\x0b\f\r"
#: Java pattern for a run of separators.
SEPARATOR_RUN = "[ \\t\\n\\x0B\\f\\r]+"


#: Lists that take the folder of every table staged while they are open, by thread.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("_OPEN", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. One is made only on a single machine where none is set; a cluster must name it."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    for names in _OPEN.get():
        names.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def listing(folders: list[str]) -> Iterator[None]:
    """Add the folder of every table staged in this block to ``folders``."""
    token = _OPEN.set((*_OPEN.get(), folders))
    try:
        yield
    finally:
        _OPEN.reset(token)


def delete(spark: SparkSession, folders: Iterable[str]) -> None:
    """Delete folders of staged tables that nothing reads any more; missing ones don't matter."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete the files of staged tables at their last read."""
    for df in tables:
        delete(df.sparkSession, {f.rsplit("/", 1)[0] for f in df.inputFiles()})


def released(spark: SparkSession) -> None:
    """Let Spark's context cleaner delete the shuffle files of plans that nothing refers to any more.

    It learns of them from the driver's garbage collector, which a driver with a large heap may not run for half an hour.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop input columns that clash with columns an operator adds (names compare without case)."""
    taken = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def group_key(column: str) -> Column:
    """A string key under which null is a group of its own, apart from the empty string."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("null"))


def flagged(id_col: str) -> list[Column]:
    """An id as ``id_``, 0 where it is null, and ``no_id``: pandas would turn a column of longs with a null into doubles."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long")).alias("id_"), F.isnull(id_col).alias("no_id")]


def unflagged(name: str) -> Column:
    return F.when(~F.col("no_id"), F.col("id_")).alias(name)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a long, b long)`` as ``(id, component_id)``.

    ``a`` and ``b`` are ids of any orderable type. Alternates large-star and small-star steps until the edge set is stable; every
    node of an edge gets the smallest id it can reach. Each round groups on node ids with map-side
    minima and writes its edges to the shared folder, so nothing is gathered anywhere
    and a lost executor costs one round. Empty input gives an empty table.
    """
    current = staged(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    before = None
    for _ in range(max_rounds):
        state = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
        both = current.select("a", "b").union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small_low, "a")
        small = (
            joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(joined.select(F.col("a"), F.col("m").alias("b")))
            .where("a <> b")
            .distinct()
        )
        following = staged(small, "edges")
        discard(current)
        current = following
    else:
        raise RuntimeError("component search did not settle")
    members = current.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    return members.union(current.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct())
