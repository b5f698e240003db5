"""Sharding by a two-pass external shuffle.

Pass one scatters whole rows uniformly into memory-sized buckets with a seeded hash; pass two
puts each bucket in memory, permutes it with Spark's seeded Fisher-Yates ``shuffle`` and
writes it. The written order (bucket, place in bucket) is then dealt to the shards in turn, so
row counts differ by one at most (law ``rows``).

Nulls: a null text has 0 bytes and the CRC of the empty string, a null id is scattered like
any other row. Repeated rows stay separate rows: the scatter hash holds the row's place in the input
files, so copies of one row spread over all buckets. An empty table gives no rows. Input columns
named like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import staged, without

OUTPUT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def shuffled_buckets(df: DataFrame, id_col: str, text_col: str, seed: int, bucket_bytes: int) -> DataFrame:
    """The written result of both passes: the rows with ``size``, ``text_crc32``, ``bucket`` and ``place``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = without(df, (*OUTPUT, "bucket", "place", "scatter"))
    columns = rows.columns
    total = df.agg(F.sum(F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + F.lit(8))).first()[0] or 0
    n = max(1, -(-int(total) // bucket_bytes))
    scattered = (
        rows.withColumn("scatter", F.xxhash64(F.lit(seed), F.col(id_col), F.monotonically_increasing_id()))
        .withColumn("bucket", F.pmod("scatter", F.lit(n)).cast("long"))
        .withColumn("size", (F.octet_length(text) + F.lit(8)).cast("long"))
        .withColumn("text_crc32", F.crc32(text.cast("binary")).cast("long"))
    )
    kept = [*columns, "size", "text_crc32"]
    # sorted by the scatter hash first, so a task that runs again permutes the same list
    gathered = (
        scattered.repartition(n, "bucket")
        .sortWithinPartitions("bucket", "scatter")
        .groupBy("bucket")
        .agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in kept])).alias("rows"))
    )
    permuted = gathered.select("bucket", F.posexplode(F.shuffle("rows", seed)).alias("place", "row"))
    return staged(permuted.select("bucket", "place", *[F.col(f"row.`{c}`") for c in kept]), "buckets")


def shard(
    df: DataFrame,
    n_shards: int = 24,
    seed: int = 20240607,
    bucket_bytes: int = 16 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """All rows of ``df`` with ``size, text_crc32, law, shard, slot, grown_shard``.

    The offset of each bucket comes from one count per bucket; that table has a row for
    every ``bucket_bytes`` of input.
    """
    written = shuffled_buckets(df, id_col, text_col, seed, bucket_bytes)
    counts = written.groupBy("bucket").agg(F.count("*").alias("n"))
    ahead = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset"))
    rank = F.col("offset") + F.col("place")
    return (
        written.join(offsets, "bucket")
        .withColumn("law", F.lit("rows"))
        .withColumn("shard", F.pmod(rank, F.lit(n_shards)).cast("int"))
        .withColumn("slot", F.floor(rank / F.lit(n_shards)).cast("long"))
        .withColumn("grown_shard", F.lit(None).cast("int"))
        .drop("bucket", "place", "offset")
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write the shards as folders ``shard=N``, each file ordered by slot."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard(docs).select("doc_id", *OUTPUT)
