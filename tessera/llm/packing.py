"""Conflict-constrained best-fit packing.

Texts are cut between characters into pieces of at most ``capacity`` UTF-8 bytes (or, if a size column is named, whatever that
counts, such as tokens); pieces go, largest first, into the
tightest bin that has room and no conflict. Bins are ordered by residual and carry a bitmap
of their sources and one of their duplicate clusters; the successor search walks up from the smallest
sufficient residual until the first compatible bin. No bin holds two documents of one
source or two of one cluster (texts equal but for letter case and white space, or rows equal in the cluster column that is named).

The pieces are dealt by a hash of their place in the input to blocks of about ``block_items`` pieces, each packed
by itself: only sizes and keys are moved, a hot source spreads over all blocks, and the
bins that stay open at the end of a block cost a fraction of a percent.

Nulls: a null text is one empty piece; null sources never conflict, null ids are packed like
others. Repeated rows are separate pieces of one cluster, so they go to separate bins. Equal sizes are
taken in order of the hash. An empty table gives no rows. Extra columns are left out.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SEPARATOR_RUN, flagged, staged, unflagged

CAPACITY, BLOCK_ITEMS, SEED = 8192, 4096, 11
OUTPUT = "id_ long, no_id boolean, piece int, start long, size long, source string, cluster long, bin_id long, bin_slot int"


def best_fit(items: Iterable[tuple[int, int, int]], capacity: int) -> list[tuple[int, int]]:
    """Bin and place in it for each (size, source, cluster); negative keys never conflict.

    Items are taken in the given order.
    """
    bins: list[tuple[int, int]] = []  # (residual, bin), in order
    sources: list[int] = []
    clusters: list[int] = []
    held: list[int] = []
    out = []
    for size, source, cluster in items:
        s = 1 << source if source >= 0 else 0
        c = 1 << cluster if cluster >= 0 else 0
        k = bisect_left(bins, (size, -1))
        while k < len(bins) and (sources[bins[k][1]] & s or clusters[bins[k][1]] & c):
            k += 1
        if k < len(bins):
            residual, b = bins.pop(k)
        else:
            residual, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
            held.append(0)
        sources[b] |= s
        clusters[b] |= c
        out.append((b, held[b]))
        held[b] += 1
        insort(bins, (residual - size, b))
    return out


def cuts(text: Column, n: Column, capacity: int) -> Column:
    """Starts of the pieces of a text of n bytes, each at the first byte of a character."""
    data, step = text.cast("binary"), capacity - 3
    follows = lambda at: F.hex(F.substring(data, at + 1, 1)).between("80", "BF")

    def start(k: Column) -> Column:
        at = (k * step).cast("int")
        return at - F.when(~follows(at), 0).when(~follows(at - 1), 1).when(~follows(at - 2), 2).otherwise(3)

    later = F.transform(F.sequence(F.lit(1), F.ceil(n / step).cast("int") - 1), start)
    return F.when(n <= capacity, F.array(F.lit(0))).otherwise(F.concat(F.array(F.lit(0)), later))


def pieces(docs: DataFrame, id_col: str, text_col: str, source_col: str, capacity: int, size_col: str | None = None, cluster_col: str | None = None) -> DataFrame:
    """``doc_id, piece, start, size, source, cluster, at``: one row a piece, without the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    n = F.coalesce(F.col(size_col), F.lit(0)).cast("long") if size_col else F.octet_length(text).cast("long")
    same = F.col(cluster_col) if cluster_col else F.btrim(F.regexp_replace(F.lower(text), SEPARATOR_RUN, " "))
    at = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(n / capacity)).cast("int") - 1), lambda k: k * capacity) if size_col else cuts(text, n, capacity)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), n.alias("n"), F.col(source_col).cast("string").alias("source"), F.xxhash64(same).alias("cluster"), at.alias("starts"), F.monotonically_increasing_id().alias("at"))
    cut = rows.select("*", F.posexplode("starts").alias("piece", "first"))
    end = F.coalesce(F.get("starts", F.col("piece") + 1).cast("long"), F.col("n"))
    return cut.select("doc_id", "piece", F.col("first").cast("long").alias("start"), (end - F.col("first")).alias("size"), "source", "cluster", "at")


def pack(
    docs: DataFrame, capacity: int = CAPACITY, block_items: int = BLOCK_ITEMS, seed: int = SEED,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size_col: str | None = None, cluster_col: str | None = None,
) -> DataFrame:
    """Every piece with its bin: ``doc_id, piece, start, size, source, cluster, bin_id, bin_slot``. A capacity in bytes is 7 at least."""
    items = staged(pieces(docs, id_col, text_col, source_col, capacity, size_col, cluster_col), "pieces")
    n_blocks = max(1, -(-items.count() // block_items))
    deal = F.xxhash64(F.lit(seed), "at", "piece")
    dealt = items.withColumn("deal", deal).withColumn("block", F.pmod("deal", F.lit(n_blocks)).cast("long"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "deal"], ascending=[False, True], kind="stable")
        source = pd.factorize(pdf["source"])[0]
        cluster = pd.factorize(pdf["cluster"])[0]
        placed = best_fit(zip(pdf["size"].tolist(), source.tolist(), cluster.tolist()), capacity)
        block = int(pdf["block"].iloc[0])
        out = pdf[["id_", "no_id", "piece", "start", "size", "source", "cluster"]].copy()
        out["bin_id"] = [(block << 24) + b for b, _ in placed]
        out["bin_slot"] = [slot for _, slot in placed]
        return out.astype({"piece": "int32", "bin_slot": "int32"})

    dealt = dealt.select(*flagged("doc_id"), "piece", "start", "size", "source", "cluster", "deal", "block")
    return dealt.groupBy("block").applyInPandas(run, OUTPUT).withColumn("id_", unflagged("doc_id")).withColumnRenamed("id_", "doc_id").drop("no_id")


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
