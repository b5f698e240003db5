"""Relational operators shared by the queries: ranked selection, packing, islands and key merges.

Each takes and returns DataFrames; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, by: list, order: list, name: str = "rank") -> DataFrame:
    """Row number within ``by``, as long; the order must be total."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def top_k(df: DataFrame, by: list, order: list, k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark limits the groups before the shuffle."""
    return ranked(df, by, order, name).where(F.col(name) <= k)


def prefix_pack(df: DataFrame, by: list, order: list, size: str, budget: int, first_exempt: bool = False) -> DataFrame:
    """The longest prefix whose summed sizes fit the budget, with the running sum as ``cum``."""
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("cum", F.sum(size).over(window)).withColumn("pos_", F.count("*").over(window))
    fits = F.col("cum") <= budget
    return out.where(fits | (F.col("pos_") == 1) if first_exempt else fits).drop("pos_")


def floor_pack(df: DataFrame, by: list, order: list, size: Column, budget: int, least: int) -> DataFrame:
    """Like a prefix pack, but the first ``least`` rows always stay."""
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("cum", F.sum(size).over(window)).withColumn("pos", F.count("*").over(window))
    return out.where((F.col("cum") <= budget) | (F.col("pos") <= least))


def islands(df: DataFrame, by: list, order: list, same: list, name: str = "island") -> DataFrame:
    """Number runs of neighbouring rows that agree in ``same``."""
    window = Window.partitionBy(*by).orderBy(*order)
    change = F.lit(False)
    for c in same:
        change = change | ~F.col(c).eqNullSafe(F.lag(c).over(window))
    first = F.row_number().over(window) == 1
    flagged = df.withColumn("turn_", (first | change).cast("long"))
    return flagged.withColumn(name, F.sum("turn_").over(window.rowsBetween(Window.unboundedPreceding, 0))).drop("turn_")


def u_curve(df: DataFrame, by: list, order: list, name: str = "place") -> DataFrame:
    """Odd ranks ascending at the front, even ranks descending at the back."""
    group = Window.partitionBy(*by)
    rank, n = F.row_number().over(group.orderBy(*order)), F.count("*").over(group)
    key = F.when(n <= 2, rank).when(rank % 2 == 1, rank).otherwise(2 * n + 2 - rank)
    keyed = df.withColumn("key_", key)
    return keyed.withColumn(name, F.row_number().over(group.orderBy("key_")).cast("long")).drop("key_")


def latest_wins(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return top_k(df, keys, order, 1, "pos_").drop("pos_")


def key_merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert: rows of ``new`` replace rows of ``old`` with the same keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def orphans(state: DataFrame, active: DataFrame, keys: list[str]) -> DataFrame:
    return state.join(active.select(*keys).distinct(), keys, "left_anti")


def as_of_latest(calls: DataFrame, steps: DataFrame, keys: list[str], seq: str, step_seq: str, columns: list[str]) -> DataFrame:
    """For each call the latest step with the same keys and a smaller sequence number.

    One union and one window: the sort is per key, and no pair of call and step is built.
    """
    left = calls.withColumns({"seq_": F.col(seq), "kind_": F.lit(1), "hit_": F.lit(None).cast(steps.select(F.struct(*columns)).schema[0].dataType)})
    right = steps.select(*keys, F.col(step_seq).alias("seq_"), F.lit(0).alias("kind_"), F.struct(*columns).alias("hit_"))
    window = Window.partitionBy(*keys).orderBy("seq_", F.desc("kind_")).rowsBetween(Window.unboundedPreceding, 0)
    joined = left.unionByName(right, allowMissingColumns=True).withColumn("hit_", F.last("hit_", ignorenulls=True).over(window))
    return joined.where("kind_ = 1").select(*calls.columns, *[F.col(f"hit_.{c}").alias(c) for c in columns])


def mention_join(texts: DataFrame, text: str, aliases: DataFrame, alias: str) -> DataFrame:
    """Rows joined to the aliases among their words, by one equi-join on the word (no contains join)."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0)))
    exploded = texts.withColumn("word_", F.explode(found))
    return exploded.join(aliases.withColumn("word_", F.lower(alias)), "word_").drop("word_")


def greedy_pack(texts: Column, sizes: Column, target: int, most: int, least: int = 1, ceiling: int | None = None) -> Column:
    """Greedy chunks of an array: flush before ``most`` would be passed and once ``target`` is reached by at least ``least`` elements,
    unless the chunk is larger than ``ceiling``, which then grows on.

    Returns an array of structs (first, last, size) of element positions.
    """
    item = "struct<first:int,last:int,size:bigint>"
    start = F.struct(F.array().cast(f"array<{item}>").alias("done"), F.lit(0).alias("first"), F.lit(0).cast("long").alias("size"), F.lit(0).alias("i"))

    def emit(done: Column, first: Column, last: Column, size: Column) -> Column:
        return F.concat(done, F.array(F.struct(first.cast("int").alias("first"), last.cast("int").alias("last"), size.cast("long").alias("size"))))

    def step(acc: Column, size: Column) -> Column:
        over = (acc["size"] > 0) & (acc["size"] + size > most)
        done = F.when(over, emit(acc["done"], acc["first"], acc["i"] - 1, acc["size"])).otherwise(acc["done"])
        first, now = F.when(over, acc["i"]).otherwise(acc["first"]), F.when(over, size).otherwise(acc["size"] + size)
        full = (now >= target) & (acc["i"] - first + 1 >= least)
        if ceiling is not None:
            full = full & (now <= ceiling)
        return F.struct(
            F.when(full, emit(done, first, acc["i"], now)).otherwise(done).alias("done"), F.when(full, acc["i"] + 1).otherwise(first).cast("int").alias("first"),
            F.when(full, F.lit(0)).otherwise(now).cast("long").alias("size"), (acc["i"] + 1).cast("int").alias("i"),
        )

    return F.aggregate(sizes, start, step, lambda acc: F.when(acc["size"] > 0, emit(acc["done"], acc["first"], acc["i"] - 1, acc["size"])).otherwise(acc["done"]))
