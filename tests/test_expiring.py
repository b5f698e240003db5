"""Expiring state: streams in any order against tables, and state that goes away."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tessera.streaming import expiring

HOUR = 3600 * expiring.SECOND
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture(scope="module")
def messages(spark):
    r = random.Random(4)
    rows, at = [], 1_700_000_000_000_000
    for k in range(420):
        at += r.choice([1, 60, 600]) * expiring.SECOND if k % 90 else 30 * HOUR
        user = r.choice([1, 1, 1, 2, 3]) if k < 300 else r.choice([2, 3])
        rows.append((k, at, user, r.choice(["a", "b"]), r.choice(["hi", "hi", "  ", None, "there"])))
    rows += [(1000 + k, rows[k][1], *rows[k][2:]) for k in range(0, 400, 9)]  # the same message under another id
    df = spark.createDataFrame(rows, "id long, us long, user long, speaker string, content string")
    return df.withColumn("ts", F.timestamp_micros("us")).cache()


def streamed(spark, messages, fold, files, late):
    """What the stream gives over files in the given order, and the state rows after each batch. A far later row of user 99 ends it."""
    path = tempfile.mkdtemp() + "/in"
    end = messages.limit(1).withColumns({"id": F.lit(-1).cast("long"), "user": F.lit(99).cast("long"), "ts": F.expr("timestamp'2100-01-01'")})
    for part in [*files, end, end.withColumn("ts", F.expr("timestamp'2100-01-02'"))]:
        part.drop("us").coalesce(1).write.mode("append").parquet(path)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        source = spark.readStream.schema(messages.drop("us").schema).option("maxFilesPerTrigger", 1).parquet(path)
        name = f"folded_{random.randrange(10**9)}"
        query = expiring.fold_stream(source, fold, "user", "ts", "id", late).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(300)
        held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        return sorted(tuple(r) for r in spark.table(name).collect() if r.key != "99"), held
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


@pytest.mark.parametrize("fold", [expiring.TopicBuffer(every=7, overlap=3, cap=9, ttl=20 * HOUR), expiring.TtlCache(ttl=HOUR // 3), expiring.History(cap=5, ttl=20 * HOUR)])
def test_shuffled_batches_equal_the_table(spark, messages, fold):
    want = sorted(tuple(r) for r in expiring.fold_table(messages, fold, "user", "ts", "id").collect())
    assert len(want) > 20
    files = messages.withColumn("f", F.pmod(F.xxhash64("id"), F.lit(3)))
    got, _ = streamed(spark, messages, fold, [files.where(f"f = {k}").drop("f") for k in range(3)], "3650 days")
    assert got == want


def test_idle_keys_leave_the_state(spark, messages):
    """User 1 writes nothing in the last third: its rows are gone at the end, while results stay those of the table."""
    fold = expiring.TopicBuffer(every=7, overlap=3, cap=9, ttl=20 * HOUR)
    low, high = messages.agg(F.min("us"), F.max("us")).first()
    step = (high - low) // 4 + 1
    files = [messages.where(F.floor((F.col("us") - low) / step) == k) for k in range(4)]
    got, held = streamed(spark, messages, fold, files, "0 seconds")
    assert got == sorted(tuple(r) for r in expiring.fold_table(messages, fold, "user", "ts", "id").collect())
    assert max(held) > 0 and held[-1] < max(held)
    assert held[-1] <= 3  # what is left is the row that ends the stream


def test_buffer_rules_by_hand():
    fold = expiring.TopicBuffer(every=4, overlap=1, cap=3)
    rows = [(1, 1, "a", "x"), (2, 2, "a", " "), (1, 3, "a", "x"), (4, 4, "b", "x"), (5, 5, "b", "y"), (6, 6, "b", "z"), (7, 7, "b", "v"), (8, 8, "b", "w")]
    value, items, last, out = expiring.taken(fold, fold.start(), [], None, iter(rows))
    assert out == [(4, 4, 2, 1, 4), (8, 8, 3, 6, 8)] and [x[0] for x in items] == [8] and value == (8,) and last == 8
    value, items, _, _ = expiring.taken(fold, value, items, last, iter([(8 + fold.ttl, 9, "b", "w")]))
    assert value == (1,) and [x[0] for x in items] == [9]
