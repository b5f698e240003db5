"""Embedding near-duplicates by an inverted multi-index.

Two independent codebooks, one for each half of the normalised vector, form a grid of
cells, finer the more vectors there are. Each distinct vector is stored in its cell and asks other cells by multi-sequence traversal: cells come in
order of the summed squared distances to the two bisecting hyperplanes that part them from the vector's own, until that
sum exceeds the reach at which ``recall`` of all links are found. Candidates are
verified in double precision, so no pair below the threshold links. Equal vectors form
one class first, so copies are never compared.

The reach is measured on the sample that the codebooks are fitted on: every sampled vector gets partners at exactly the threshold's
distance, the farthest that link, in random directions and in directions in which the data itself varies; the reach is
the quantile of what their cells would take, the larger of both. ``recall=1`` takes the distance itself, which no link exceeds.

A cell's vectors are dealt to blocks of ``BLOCK``; queries stream past the block, in chunks where there are many.
A block emits one count a vector and the edges of a spanning forest, not its pairs.

Nulls: vectors that are null, empty, zero or hold a null or non-finite component, and those with a null
label, link with nothing and are their own component; a row without id takes part but
is nobody's smallest id, and its component is null where it reaches no id. Ids may be any long, labels of any type that casts to a string. Repeated rows count as separate vectors. Vectors of different
length don't link. An empty table gives no rows. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import components, discard, staged

COSINE, RECALL, FIT_ROWS, FIT_FLOATS = 0.98, 0.995, 20_000, 4_000_000
BLOCK, QUERIES = 512, 4096
#: Vectors of a label that a cell is meant to hold, and the least codewords of a half. They grow with the input; only the fit
#: sample bounds them, at one codeword for every ``PER_CODEWORD`` of its vectors.
CELL, CODEWORDS, PER_CODEWORD = 16, 4, 2
#: Distances to codewords that a task holds at once.
DISTANCES = 1 << 22


def units(vectors: list) -> np.ndarray:
    """Rows of length 1. Each is first scaled by a power of two, which is exact, so that squares of large or tiny components don't overflow or vanish."""
    x = np.array(vectors, dtype=np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.sqrt((x**2).sum(1))[:, None]


def codebook(x: np.ndarray, k: int, seed: int = 5, rounds: int = 12) -> np.ndarray:
    """Plain k-means centres of the rows of ``x``."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        step = max(1, DISTANCES // len(centres))
        near = np.concatenate([((centres**2).sum(1) - 2 * x[s : s + step] @ centres.T).argmin(1) for s in range(0, len(x), step)])
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = x[near == c].mean(0)
    return centres


def bounds(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's own codeword, and the squared distance to the hyperplane towards every other one."""
    d = (x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)
    own = d.argmin(1)
    c = centres[own]
    gap = np.sqrt(np.maximum((c**2).sum(1)[:, None] - 2 * c @ centres.T + (centres**2).sum(1), 0))
    far = np.maximum(d - d.min(1)[:, None], 0) / np.maximum(2 * gap, 1e-12)
    far[np.arange(len(x)), own] = 0
    return own, far**2


def traverse(first: np.ndarray, second: np.ndarray, reach: float) -> list[tuple[int, int]]:
    """Cells in order of ``first[i] + second[j]``, as long as the sum is within reach."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen, out = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}, []
    while heap:
        total, i, j = heappop(heap)
        if total > reach:
            break
        out.append((int(a[i]), int(b[j])))
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in seen:
                seen.add((p, q))
                heappush(heap, (first[a[p]] + second[b[q]], p, q))
    return out


def reach_of(x: np.ndarray, one: np.ndarray, two: np.ndarray, cosine: float, recall: float, seed: int = 3) -> float:
    """The summed squared hyperplane distances within which ``recall`` of the partners at the threshold lie."""
    r2 = 2 - 2 * cosine + 1e-9
    if recall >= 1 or len(x) < 2:
        return r2
    rng, half = np.random.default_rng(seed), x.shape[1] // 2
    other = x[rng.permutation(len(x))]
    reach = 0.0
    for step in (rng.normal(size=x.shape), other - x[rng.permutation(len(x))]):
        step -= (step * x).sum(1, keepdims=True) * x
        size = np.sqrt((step**2).sum(1, keepdims=True))
        near = (1 - r2 / 2) * x + np.sqrt(r2 - r2 * r2 / 4) * np.divide(step, size, out=np.zeros_like(step), where=size > 0)
        need, rows = np.zeros(len(x)), max(1, DISTANCES // len(one))
        for centres, a, b in ((one, x[:, :half], near[:, :half]), (two, x[:, half:], near[:, half:])):
            for at in range(0, len(x), rows):
                some = slice(at, at + rows)
                far, own = bounds(a[some], centres)[1], bounds(b[some], centres)[0]
                need[some] += far[np.arange(len(own)), own]
        reach = max(reach, float(np.quantile(need, recall)))
    return min(r2, reach)


def cells(classes: DataFrame, books: dict[int, tuple[np.ndarray, np.ndarray, float]]) -> DataFrame:
    """``home, asked``: the own cell and the later cells to ask."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in pdf.groupby(pdf["embedding"].map(len)):
                one, two, reach = books[dim]
                step = max(1, DISTANCES // len(one))
                for some in (part.iloc[k : k + step] for k in range(0, len(part), step)):
                    x = units(some["embedding"].tolist())
                    (i, near1), (j, near2) = bounds(x[:, : dim // 2], one), bounds(x[:, dim // 2 :], two)
                    home = i * len(two) + j
                    asked = [[c for p, q in traverse(f, s, reach) if (c := p * len(two) + q) > h] for f, s, h in zip(near1, near2, home)]
                    yield some.assign(home=home.astype(np.int32), asked=asked)

    kind = classes.schema["embedding"].dataType.simpleString()
    return classes.mapInPandas(run, f"cid long, m long, label string, embedding {kind}, home int, asked array<int>")


class Block:
    """The stored vectors of one block with their link counts and the forest of their links so far."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.ready = False

    def add(self, ids: np.ndarray, weights: np.ndarray, x: np.ndarray) -> None:
        self.parts.append((ids, weights, x))

    def close(self, cosine: float, within: bool, out: list) -> None:
        """All stored vectors are here: link them among themselves if asked."""
        self.ready = True
        self.ids, self.weights, self.x = (np.concatenate(p) for p in zip(*self.parts))
        self.counts = np.zeros(len(self.ids), dtype=np.int64)
        self.label = np.arange(len(self.ids))
        if within:
            hit = self.x @ self.x.T >= cosine
            np.fill_diagonal(hit, False)
            self.counts += hit @ self.weights
            for k in np.flatnonzero(hit.any(1)):
                self.merge(np.append(np.flatnonzero(hit[k]), k), out)

    def merge(self, places: np.ndarray, out: list) -> None:
        """Join the trees that hold these vectors."""
        labels, first = np.unique(self.label[places], return_index=True)
        for other, at in zip(labels[1:], first[1:]):
            out.append((int(self.ids[places[first[0]]]), int(self.ids[places[at]]), 0))
            self.label[self.label == other] = labels[0]

    def ask(self, ids: np.ndarray, weights: np.ndarray, x: np.ndarray, cosine: float, out: list) -> None:
        for s in range(0, len(ids), 512):
            hit = x[s : s + 512] @ self.x.T >= cosine
            self.counts += weights[s : s + 512] @ hit
            found = hit @ self.weights
            for k in np.flatnonzero(found):
                places = np.flatnonzero(hit[k])
                self.merge(places, out)
                out.append((int(ids[s + k]), int(self.ids[places[0]]), int(found[k])))

    def end(self, out: list) -> None:
        out += [(int(i), int(i), int(n)) for i, n in zip(self.ids, self.counts) if n]


def compare(rows: DataFrame, cosine: float) -> DataFrame:
    """``a, b, links``: an edge of the forest, and how many more links a has.

    ``rows(grp, part, kind, cid, m, embedding)`` are sorted so that stored vectors (kind 0)
    come before the queries (kind 1) of their block; part 0 also links the stored ones.
    """

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, block = None, Block()
        frame = lambda out: pd.DataFrame(out, columns=["a", "b", "links"])
        for pdf in batches:
            out: list = []
            for (grp, part, kind), rows_ in pdf.groupby(["grp", "part", "kind"], sort=False):
                if at != (grp, part):
                    if at is not None:
                        if not block.ready:
                            block.close(cosine, at[1] == 0, out)
                        block.end(out)
                    at, block = (grp, part), Block()
                x = units(rows_["embedding"].tolist())
                ids, weights = rows_["cid"].to_numpy(), rows_["m"].to_numpy()
                if not kind:
                    block.add(ids, weights, x)
                    continue
                if not block.ready:
                    block.close(cosine, part == 0, out)
                block.ask(ids, weights, x, cosine, out)
            if out:
                yield frame(out)
        out = []
        if at is not None:
            if not block.ready:
                block.close(cosine, at[1] == 0, out)
            block.end(out)
        if out:
            yield frame(out)

    return rows.mapInPandas(stream, "a long, b long, links long")


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    cosine: float = COSINE, recall: float = RECALL, codewords: int | None = None, fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    The codebooks and the reach are fitted on at most about ``fit_rows`` classes, chosen by hash, and fewer where
    vectors are so long that these would pass ``FIT_FLOATS`` numbers. Doubles are compared as doubles.
    """
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("embedding"), F.col(label_col).cast("string").alias("label"))
    valid = F.col("label").isNotNull() & F.forall("embedding", good) & F.exists("embedding", lambda x: x != 0)
    base = base.withColumn("ok", F.coalesce(valid, F.lit(False)))
    base = staged(base.withColumns({"s1": F.when(F.col("ok"), F.xxhash64("label", "embedding")), "s2": F.when(F.col("ok"), F.xxhash64("embedding", "label", F.lit(1)))}), "vectors")
    classes = base.where("ok").groupBy("s1", "s2").agg(F.min("vec_id").alias("least"), F.count("*").alias("m"), F.first("embedding").alias("embedding"), F.min("label").alias("label"))
    # a class that no id belongs to goes by its hash
    classes = staged(classes.select("s1", "s2", F.coalesce("least", "s1").alias("cid"), F.isnull("least").alias("nameless"), "m", "embedding", "label"), "classes")
    lengths = {r["dim"]: r for r in classes.groupBy(F.size("embedding").alias("dim"), "label").count().groupBy("dim").agg(F.sum("count").alias("n"), F.max("count").alias("most")).collect()}
    n = sum(r["n"] for r in lengths.values())
    share = int(min(1.0, min(fit_rows, FIT_FLOATS // max(lengths, default=1)) / max(1, n)) * (1 << 30))
    sample = [r[0] for r in classes.where(F.pmod(F.xxhash64(F.lit(3), "cid"), F.lit(1 << 30)) < share).select("embedding").collect()]
    books = {}
    for dim, r in lengths.items():
        x = units([v for v in sample if len(v) == dim] or [[1.0] * dim])
        k = codewords or int(max(CODEWORDS, min(len(x) // PER_CODEWORD, round((r["most"] / CELL) ** 0.5))))
        one, two = codebook(x[:, : dim // 2], k), codebook(x[:, dim // 2 :], k)
        books[dim] = one, two, reach_of(x, one, two, cosine, recall)
    placed = staged(cells(classes.select("cid", "m", "label", "embedding"), books), "cells")
    place = ["label", "dim", "cell"]
    stored = placed.select("cid", "m", "embedding", "label", F.size("embedding").alias("dim"), F.col("home").alias("cell"), "asked")
    sizes = staged(stored.groupBy(*place).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "sizes")
    stored = stored.join(sizes, place).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    key = [*place, "block"]
    # each vector asks the earlier blocks of its own cell and all blocks of the later cells in reach
    earlier = stored.where("block > 0").select("cid", "m", "embedding", *place, F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("block"))
    later = stored.select("cid", "m", "embedding", "label", "dim", F.explode("asked").alias("cell")).join(sizes, place)
    later = later.select("cid", "m", "embedding", *place, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    queries = earlier.unionByName(later)
    load = staged(queries.groupBy(*key).agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts")), "load")
    asking = queries.join(load, key).withColumns({"part": F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"), "kind": F.lit(1)})
    parts = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
    held = stored.select("cid", "m", "embedding", *key).join(load, key, "left").withColumn("part", F.explode(parts)).withColumn("kind", F.lit(0))
    columns = [F.xxhash64(*key).alias("grp"), "part", "kind", "cid", "m", "embedding"]
    rows = held.select(*columns).union(asking.select(*columns)).repartition("grp", "part").sortWithinPartitions("grp", "part", "kind")
    links = staged(compare(rows, cosine), "links")
    discard(placed, sizes, load)
    counts = links.groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("more"))
    joined = staged(components(links.select("a", "b")), "components")
    # the smallest id of a component is that of a class with ids
    real = joined.join(classes.where("nameless").select(F.col("cid").alias("id")), "id", "left_anti")
    least = real.groupBy("component_id").agg(F.min("id").alias("least"))
    reached = joined.join(least, "component_id", "left").select(F.col("id").alias("cid"), "least", F.lit(True).alias("linked"))
    named = classes.select("s1", "s2", "cid", "nameless", "m").join(counts, "cid", "left").join(reached, "cid", "left")
    component = F.when(F.col("linked"), F.col("least")).otherwise(F.when(~F.col("nameless"), F.col("cid")))
    named = staged(named.select("s1", "s2", (F.col("m") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), component.alias("component_id")), "named")
    discard(classes, links, joined)
    out = base.select("vec_id", "ok", "s1", "s2").join(named, ["s1", "s2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.when(F.col("ok"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op8_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


_UNIT = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
ORACLE_SQL = {
    "op8_embedding_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding, label, label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AS ok FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.embedding) = len(b.embedding) WHERE a.ok AND b.ok AND {_UNIT} >= {COSINE}),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id"""
}
