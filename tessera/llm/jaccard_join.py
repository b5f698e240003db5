"""N-gram Jaccard join by a token-group matrix.

A document's tokens are the hashes of its distinct word shingles; two documents link when
``100 * intersection >= threshold * union``. Documents with equal token sets form one class and only
classes are compared.

1. Order: all tokens whose hash lies in the lowest ``zone`` of the hash range are counted exactly.
   The global token order is: zone tokens by (count, hash), then the others by hash. A class
   must share one of its first ``n - ceil(threshold * n / 100) + 1`` tokens with anything it
   links to, and tokens counted once can't be shared; a class whose first tokens are all of that
   kind is settled without a comparison.
2. Groups: the rest are compared with the pivots (the smallest class of a token) that share most of
   their first tokens. Each joins the group of its best pivot. What links so
   is connected already and needs no more comparing.
3. Matrix: a group keeps its members in blocks, each with the union of its tokens. A document that
   shares a first token with a block that also holds another component, early enough in both orders that enough tokens
   follow for a link, looks its tokens up in the union; at least
   ``threshold`` percent of them must be there for any member to link, and only then the block is
   opened and all overlaps counted at once. A block isn't asked again at a token before which document and all of
   the block's members with that token share another of the last ``LOOK_BACK`` ones.
4. Links found in 2 and 3 give the components.

Every step loses no link that matters to the components. Pivots, blocks and queries are row streams: a popular token costs rows in
proportion to its documents, and a block with many queries is dealt out in chunks.

Nulls: a null or wordless text has no tokens, ``n_shingles`` 0, and links with nothing; a document
without id takes part, is nobody's smallest id, and has a null component where it reaches no id. Ids may be any long.
Repeated rows are one node with the same result each. An empty table gives no rows. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import components, discard, flagged, released, staged, unflagged
from .hashing import Hashes, mixed

SHINGLE, THRESHOLD = 4, 85
ZONE = 0.25
BLOCK, QUERIES = 256, 1024
#: Pivots that each class is compared with before the groups are known.
PIVOTS = 2
#: Earlier tokens by which a repeated question is known.
LOOK_BACK = 4


def tokens(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    words = text.lower().split()  # bytes: A-Z only, separators are space and U+0009..U+000D
    if not words:
        return np.empty(0, dtype=np.uint64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    hashes = Hashes(b" ".join(words))
    if len(words) < size:
        return hashes.of(starts[:1], ends[-1:])
    return np.unique(hashes.of(starts[: len(words) - size + 1], ends[size - 1 :]))


def signature(t: np.ndarray) -> tuple[int, int]:
    """A 128-bit name of a token set."""
    return tuple(int(mixed(t ^ np.uint64(k)).sum(dtype=np.uint64).view(np.int64)) if len(t) else 0 for k in (0x51, 0xA7C3))


def first_needed(n: int, threshold: int) -> int:
    """How many of its first tokens must hold one of any partner's."""
    return n - -(-threshold * n // 100) + 1


def sketch(docs: DataFrame, size: int, threshold: int, zone: float) -> DataFrame:
    """``id, n, s1, s2, first``: first holds the zone's tokens, and more where they are too few."""
    limit = np.uint64(int(zone * 2.0**64))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for id_, no_id, text in zip(pdf["id_"], pdf["no_id"], pdf["data"]):
                t = tokens(text, size)
                s1, s2 = signature(t)
                k = max(int(np.searchsorted(t, limit)), first_needed(len(t), threshold)) if len(t) else 0
                rows.append((id_, no_id, len(t), s1, s2, t[:k].view(np.int64)))
            yield pd.DataFrame(rows, columns=["id_", "no_id", "n", "s1", "s2", "first"])

    rows = docs.select(*flagged("id"), "data").mapInPandas(run, "id_ long, no_id boolean, n int, s1 long, s2 long, first array<long>")
    return rows.select(unflagged("id"), "n", "s1", "s2", "first")


def full_tokens(docs: DataFrame, active: DataFrame, size: int) -> DataFrame:
    """``cid, tokens`` of the active classes; a class without id is found by its token set."""
    named = docs.join(active.where("not nameless").withColumnRenamed("cid", "id").hint("merge"), "id").withColumnRenamed("id", "cid")
    lost = active.where("nameless").select("cid")
    without_id = docs.where("id is null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for cid, s1, s2, text in zip(pdf["cid"], pdf["s1"], pdf["s2"], pdf["data"]):
                t = tokens(text, size)
                if signature(t) == (s1, s2):
                    rows.append((cid, t.view(np.int64)))
            yield pd.DataFrame(rows, columns=["cid", "tokens"])

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["data"]:
                t = tokens(text, size)
                rows.append((signature(t)[0], t.view(np.int64)))
            yield pd.DataFrame(rows, columns=["cid", "tokens"])

    schema = "cid long, tokens array<long>"
    named = named.select("cid", "s1", "s2", "data").mapInPandas(run, schema)
    return named.union(without_id.select("data").mapInPandas(name, schema).join(lost, "cid", "left_semi")).dropDuplicates(["cid"])


def open_groups(queries: DataFrame, members: DataFrame, full: DataFrame, threshold: int) -> DataFrame:
    """Edges ``a, b`` between each query and one linked member of each component in each of its blocks.

    ``queries(q, grp)`` and ``members(cid, grp, comp)``; blocks with many queries are repeated
    for every ``QUERIES`` of them.
    """
    load = queries.groupBy("grp").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))
    asked = queries.join(load, "grp").select("grp", F.pmod(F.xxhash64("q"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), F.col("q").alias("cid"), F.lit(0).cast("long").alias("comp"))
    held = members.join(load, "grp").select("grp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "cid", "comp")
    rows = asked.union(held).join(full, "cid").repartition("grp", "part").sortWithinPartitions("grp", "part", "kind")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, ids, comps, sets, matrix = None, [], [], [], None
        for pdf in batches:
            out = []
            for grp, part, kind, cid, comp, t in zip(pdf["grp"], pdf["part"], pdf["kind"], pdf["cid"], pdf["comp"], pdf["tokens"]):
                if at != (grp, part):
                    at, ids, comps, sets, matrix = (grp, part), [], [], [], None
                t = np.asarray(t).view(np.uint64)
                if not kind:
                    ids.append(cid)
                    comps.append(comp)
                    sets.append(t)
                    continue
                if matrix is None:
                    every = np.concatenate(sets)
                    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
                    order = np.argsort(every, kind="stable")
                    every, owner = every[order], owner[order]
                    union, begin = np.unique(every, return_index=True)
                    matrix = union, np.append(begin, len(every)), owner, np.array([len(s) for s in sets])
                union, begin, owner, sizes = matrix
                place = np.minimum(np.searchsorted(union, t), len(union) - 1)
                hit = place[union[place] == t]
                if 100 * len(hit) < threshold * len(t):
                    continue
                if len(sizes) == 1:
                    common = np.array([len(hit)])
                else:
                    counts = begin[hit + 1] - begin[hit]
                    where = np.repeat(begin[hit] - np.append(0, np.cumsum(counts)[:-1]), counts) + np.arange(counts.sum())
                    common = np.bincount(owner[where], minlength=len(sizes))
                linked = np.flatnonzero(100 * common >= threshold * (sizes + len(t) - common))
                if len(linked):
                    first = np.unique(np.array(comps)[linked], return_index=True)[1]
                    out += [(cid, ids[k]) for k in linked[first] if ids[k] != cid]
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])

    return rows.select("grp", "part", "kind", "cid", "comp", "tokens").mapInPandas(run, "a long, b long")


def near_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, threshold: int = THRESHOLD, zone: float = ZONE
) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))
    whole = staged(sketch(docs, size, threshold, zone), "sketch")
    # pass 1: classes, and exact counts of the zone's tokens over them
    classes = staged(whole.where("n > 0").groupBy("s1", "s2").agg(F.min("id").alias("least"), F.min("n").alias("n"), F.first("first").alias("first")), "classes")
    # a class that no id belongs to goes by the hash of its tokens
    classes = classes.select("s1", "s2", F.coalesce("least", "s1").alias("cid"), F.isnull("least").alias("nameless"), "n", "first")
    every = staged(whole.select("id", "n", "s1", "s2"), "nodes")
    discard(whole)
    del whole
    released(spark)
    split = classes.select("cid", F.explode("first").alias("token"))
    often = staged(split.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "often")
    released(spark)
    shared = staged(split.join(often, "token").groupBy("cid").agg(F.collect_list(F.struct("df", "token")).alias("shared")), "shared")
    del split
    released(spark)
    limit = np.uint64(int(zone * 2.0**64))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cids, toks, sizes, rests = [], [], [], []
            for cid, n, first, rows in zip(pdf["cid"], pdf["n"], pdf["first"], pdf["shared"]):
                need = first_needed(n, threshold)
                known = {r["token"]: r["df"] for r in rows}
                order = np.asarray(first)
                outside = order.view(np.uint64) >= limit
                df = np.array([known.get(t, 1) for t in order.tolist()])
                # first is in hash order; what lies outside the zone comes last, whatever its count
                place = np.lexsort((np.arange(len(order)), np.where(outside, 0, df), outside))[:need]
                at = np.flatnonzero(df[place] > 1)
                keep = order[place][at]
                cids.append(np.full(len(keep), cid, dtype=np.int64))
                toks.append(keep)
                sizes.append(np.full(len(keep), n, dtype=np.int32))
                rests.append((n - at).astype(np.int32))
            if cids:
                yield pd.DataFrame({"cid": np.concatenate(cids), "token": np.concatenate(toks), "n": np.concatenate(sizes), "rest": np.concatenate(rests)})

    first = staged(classes.select("cid", "n", "first").join(shared, "cid").mapInPandas(choose, "cid long, token long, n int, rest int"), "first")
    discard(shared, often)
    every_class, classes = classes, staged(classes.drop("first"), "names")
    discard(every_class)
    del shared, every_class
    released(spark)
    pivots = staged(first.groupBy("token").agg(F.min("cid").alias("pivot"), F.count("*").alias("k")).where("k > 1").drop("k"), "pivots")
    pivoted = staged(first.join(pivots, "token"), "first")
    discard(first, pivots)
    first = pivoted
    active = classes.join(first.select("cid").distinct(), "cid", "left_semi").select("cid", "s1", "s2", "nameless")
    active = staged(active, "active")
    full = staged(full_tokens(docs, active, size), "tokens")
    released(spark)
    # pass 2: each class against the pivots it shares most with; pass 3 covers whatever this leaves apart
    ranked = first.where("cid <> pivot").groupBy("cid", "pivot").agg(F.count("*").alias("k")).groupBy("cid")
    best = F.slice(F.sort_array(F.collect_list(F.struct("k", F.bitwise_not("pivot").alias("p"))), False), 1, PIVOTS)
    best = staged(ranked.agg(F.transform(best, lambda x: F.bitwise_not(x["p"])).alias("best")), "best")
    pairs = best.select(F.col("cid").alias("q"), F.explode("best").alias("grp"))
    alone = pairs.select("grp").distinct().select(F.col("grp").alias("cid"), "grp", F.col("grp").alias("comp"))
    links = staged(open_groups(pairs, alone, full, threshold), "links")
    linked = staged(components(links), "linked")
    released(spark)
    # pass 3: classes against the blocks of similar classes, whether or not these link among themselves
    placed = (
        active.select("cid")
        .join(linked.withColumnRenamed("id", "cid"), "cid", "left")
        .join(best.select("cid", F.get("best", F.lit(0)).alias("home")), "cid", "left")
        .select("cid", F.coalesce("component_id", "cid").alias("comp"), F.coalesce("home", "cid").alias("home"))
    )
    homes = placed = staged(placed, "placed")
    discard(active, best, linked)
    sizes = placed.groupBy("home").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = staged(placed.join(sizes, "home").select("cid", "comp", F.xxhash64("home", F.pmod(F.xxhash64("cid"), F.col("blocks"))).alias("grp")), "placed")
    rows = staged(first.select("token", "cid", "n", "rest").join(placed, "cid"), "rows")
    discard(homes, first)
    released(spark)
    several = staged(rows.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("token"), "several")
    order = Window.partitionBy("cid").orderBy(F.desc("rest"))
    before = [F.lag("token", k + 1).over(order).alias(f"b{k}") for k in range(LOOK_BACK)]
    every_row = rows
    rows = staged(rows.join(several, "token", "left_semi").select("*", *before), "rows")
    discard(every_row, several)
    # tokens that come shortly before this one in the order of every member of the block that has it
    common = F.array(*[F.when((F.count(f"b{k}") == F.count("*")) & (F.min(f"b{k}") == F.max(f"b{k}")), F.min(f"b{k}")) for k in range(LOOK_BACK)]).alias("common")
    matrix = rows.groupBy("token", "grp").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("comp").alias("least"), F.max((100 + threshold) * F.col("rest") - threshold * F.col("n")).alias("slack"), common)
    matrix = staged(matrix, "matrix")
    asks = rows.select("token", F.col("cid").alias("q"), "n", "rest", "comp", F.array(*[f"b{k}" for k in range(LOOK_BACK)]).alias("before"))
    # of two components the one with the larger id asks
    fits = (F.col("least") < F.col("comp")) & (100 * F.col("high") >= threshold * F.col("n")) & (100 * F.col("n") >= threshold * F.col("low"))
    # at a pair's first shared token, all it shares is among the rest of either set
    fits = fits & ((100 + threshold) * F.col("rest") >= threshold * (F.col("n") + F.col("low"))) & (F.col("slack") >= threshold * F.col("n"))
    # whoever shares an earlier token with all of them asks there, where all bounds are wider
    fits = fits & ~F.coalesce(F.arrays_overlap("before", "common"), F.lit(False))
    queries = staged(asks.join(matrix, "token").where(fits).select("q", "grp").distinct(), "queries")
    discard(rows, matrix)
    released(spark)
    members = placed.join(queries.select("grp").distinct(), "grp", "left_semi").select("cid", "grp", "comp")
    more = staged(open_groups(queries, members, full, threshold), "links")
    joined = staged(components(links.union(more)), "components")
    discard(full, queries, placed, links, more)
    # the smallest id of a component is that of a class with ids
    real = joined.join(classes.where("nameless").select(F.col("cid").alias("id")), "id", "left_anti")
    least = real.groupBy("component_id").agg(F.min("id").alias("least"))
    reached = joined.join(least, "component_id", "left").select(F.col("id").alias("cid"), "least", F.lit(True).alias("linked"))
    own = F.when(~F.col("nameless"), F.col("cid"))
    names = classes.join(reached, "cid", "left").select("s1", "s2", F.when(F.col("linked"), F.col("least")).otherwise(own).alias("component_id"))
    out = every.join(staged(names, "names"), ["s1", "s2"], "left")
    discard(classes, joined)
    return out.select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE_SQL = {
    "op9_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [md5(array_to_string(w, ' '))]
  ELSE list_distinct([md5(array_to_string(w[i:i + {SHINGLE - 1}], ' ')) FOR i IN range(1, len(w) - {SHINGLE - 2})]) END AS t FROM d),
n AS (SELECT rid, doc_id, len(t) AS n, md5(array_to_string(list_sort(t), '')) AS c, t FROM s),
c AS (SELECT c, min(doc_id) AS cid, any_value(t) AS t, any_value(n) AS n FROM n WHERE n > 0 GROUP BY c),
u AS (SELECT cid, n, unnest(t) AS t FROM c),
p AS (SELECT a.cid AS a, b.cid AS b, any_value(a.n) + any_value(b.n) AS total, count(*) AS k FROM u a JOIN u b ON a.t = b.t AND a.cid <> b.cid GROUP BY a.cid, b.cid),
l AS (SELECT a, b FROM p WHERE 100 * k >= {THRESHOLD} * (total - k)),
r AS (SELECT cid AS a, cid AS b FROM c UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a AS cid, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, n.n::BIGINT AS n_shingles, coalesce(m.component_id, doc_id) AS component_id FROM n LEFT JOIN c USING (c) LEFT JOIN m USING (cid)"""
}
