"""Repeated strings by the difference-cover algorithm over all suffixes.

Two of three suffixes of every text, those at positions 1 and 2 modulo 3, are the sample. Their triples of bytes are
sorted and named; triples of names, three apart, then nine and so on, are sorted and named again, until a name stands for the 243
bytes that follow. The remaining suffixes are merged with the sampled ones: every window of ``length`` bytes gets one key for each
distance (0, 1 or 2) at which a sampled suffix follows, made of the bytes before it, two overlapping names and the bytes after them. Any two windows
have a distance in common, so they are equal if and only if they share a key; after sorting by key, equal ones are neighbours.

Names are numbers in the order of what they stand for: the distinct triples are sorted by ranges and numbered, so no task sees
them all. The work is DataFrame operations on rows of a suffix each.

This is exact, but it makes 2/3 of a row of 24 bytes for each byte of text on every level and two keys for every window; see README for what that
costs against ``suffix_dedup``, which is used for corpora. Nulls count as empty texts; texts under ``length`` bytes have no windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import discard, staged

LENGTH = 400
#: Bytes that a name of the last level stands for.
REACH = 243


def named(rows: DataFrame, step: int) -> DataFrame:
    """``rid, pos, name`` with names of the triples of names ``step`` apart; 0 stands for what lies beyond the text."""
    ahead = Window.partitionBy("rid", F.pmod("pos", F.lit(step))).orderBy("pos")
    follows = lambda k: F.coalesce(F.lead("name", k).over(ahead), F.lit(0).cast("long"))
    triples = staged(rows.select("rid", "pos", F.col("name").alias("a"), follows(1).alias("b"), follows(2).alias("c")), "triples")
    # the distinct triples in order, numbered from 1
    ordered = triples.select("a", "b", "c").distinct().repartitionByRange("a", "b", "c").sortWithinPartitions("a", "b", "c")
    ranks = staged(ordered.withColumn("name", F.monotonically_increasing_id() + 1), "ranks")
    out = staged(triples.join(ranks, ["a", "b", "c"]).select("rid", "pos", "name"), "names")
    discard(triples, ranks)
    return out


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``doc_id, row, pos``: the starts of all strings of ``length`` bytes that start anywhere else too. ``length`` is REACH + 2 at least."""
    data = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    texts = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), data.alias("data"), F.length(data).alias("n")).where(F.col("n") >= length)
    texts = staged(texts, "texts")
    code = lambda at: F.conv(F.hex(F.substring("data", at + 1, 1)), 16, 10).cast("long") + 1
    byte = lambda at: F.when(at < F.col("n"), code(at)).otherwise(F.lit(0).cast("long"))
    suffixes = texts.select("rid", "data", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos"))
    first = byte(F.col("pos")) * (1 << 18) + byte(F.col("pos") + 1) * (1 << 9) + byte(F.col("pos") + 2)
    level = staged(suffixes.where("pos % 3 <> 0").select("rid", "pos", first.alias("name")), "names")
    reach = 3
    while reach < REACH:
        following = named(level, reach)
        discard(level)
        level, reach = following, 3 * reach
    # two names that overlap, and what of the window they leave over at the end
    later = level.select("rid", F.col("name").alias("second"), "pos")
    keys = None
    for gap in (0, 1, 2):
        between = (length - gap - REACH) // 3 * 3
        rest = length - gap - REACH - between
        pairs = level.join(later.withColumn("pos", F.col("pos") - between), ["rid", "pos"])
        part = pairs.select("rid", (F.col("pos") - gap).alias("pos"), F.lit(gap).alias("gap"), "name", "second", F.lit(rest).alias("rest"))
        keys = part if keys is None else keys.unionByName(part)
    starts = keys.join(texts.select("rid", "data", "n"), "rid").where((F.col("pos") >= 0) & (F.col("pos") + length <= F.col("n")))
    head = F.hex(F.substring("data", F.col("pos") + 1, F.col("gap")))
    tail = F.hex(F.substring("data", F.col("pos") + length - F.col("rest") + 1, F.col("rest")))
    keyed = staged(starts.select("rid", "pos", "gap", "name", "second", head.alias("head"), tail.alias("tail")), "keys")
    discard(level)
    key = ["gap", "name", "second", "head", "tail"]
    again = keyed.groupBy(*key).agg(F.count("*").alias("k")).where("k > 1").drop("k")
    found = keyed.join(again, key, "left_semi").select("rid", "pos").distinct()
    return found.join(texts.select("rid", "doc_id"), "rid").select("doc_id", F.col("rid").alias("row"), "pos")
