"""The multi-index against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import embedding_dedup

SF = "/root/testdata/sf0.01"


def brute(rows, cosine=0.98):
    """Links in double precision, and components by smallest id, as (id, links, component)."""
    ok = [v is not None and len(v) and label is not None and all(c is not None and np.isfinite(c) for c in v) and any(v) for _, v, label in rows]
    n = len(rows)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * n
    unit = [np.array(v, dtype=float) / np.linalg.norm(np.array(v, dtype=float)) if k else None for (_, v, _), k in zip(rows, ok)]
    for x in range(n):
        for y in range(x):
            if ok[x] and ok[y] and rows[x][2] == rows[y][2] and len(unit[x]) == len(unit[y]) and unit[x] @ unit[y] >= cosine:
                links[x] += 1
                links[y] += 1
                root[find(x)] = find(y)
    low = {}
    for x in range(n):
        if rows[x][0] is not None:
            low[find(x)] = min(low.get(find(x), rows[x][0]), rows[x][0])
    return sorted(((rows[x][0], links[x], low.get(find(x))) for x in range(n)), key=str)


def got(df):
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in df.collect()), key=str)


def test_recall_on_embeddings(spark):
    """Every stored vector gets partners in random directions at cosines around the threshold."""
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    rng = np.random.default_rng(9)
    for i, v, label in rows[:400]:
        step = rng.normal(size=64)
        step *= np.linalg.norm(v) * rng.choice([0.1, 0.17, 0.19, 0.2, 0.22]) / np.linalg.norm(step)
        rows.append((10_000 + i, (np.array(v) + step).astype(np.float32).tolist(), label))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = brute(rows)
    have = got(embedding_dedup.near_duplicates(df))
    assert sum(x[1] for x in want) > 0
    assert sum(x[1] for x in have) >= 0.95 * sum(x[1] for x in want)
    assert all(h[1] <= w[1] for h, w in zip(have, want))


@pytest.mark.parametrize("seed", [1, 2])
def test_dense_groups_in_small_blocks(spark, seed, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 7)
    monkeypatch.setattr(embedding_dedup, "QUERIES", 5)
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(12):
        centre = rng.normal(size=16)
        for k in range(rng.integers(1, 25)):
            rows.append((len(rows), (centre + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.12, 0.2])).astype(np.float32).tolist(), int(c % 3)))
    rows += [(500, None, 1), (501, [], 1), (502, [0.0] * 16, 1), (503, [1.0, None] + [0.0] * 14, 1), (504, [float("nan")] * 16, 1), (505, [float("inf")] * 16, 1), (506, rows[0][1], None), (507, rows[0][1][:8], 0), (None, rows[0][1], 0), rows[3], rows[3]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("kept", F.lit(1)).repartition(3)
    assert got(embedding_dedup.near_duplicates(df, codewords=4, recall=1)) == brute(rows)


@pytest.mark.parametrize("directions", ["few", "along"])
def test_recall_where_the_data_is_not_isotropic(spark, directions):
    """Long vectors whose differences lie in few components, and partners along the data's own differences."""
    rng = np.random.default_rng(4)
    scale = np.where(np.arange(256) < 6, 6.0, 0.3)
    base = rng.normal(size=(300, 256)) * scale
    rows = [(i, x.tolist(), "a" if i % 2 else "b") for i, x in enumerate(base)]
    for i, x in enumerate(base):
        step = rng.normal(size=256) * (np.arange(256) < 6) if directions == "few" else base[rng.integers(300)] - base[rng.integers(300)]
        step = step - (step @ x) / (x @ x) * x
        size = np.linalg.norm(step)
        if size > 0:
            rows.append((1000 + i, (x + step * np.linalg.norm(x) * 0.2 / size).tolist(), "a" if i % 2 else "b"))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    want, have = brute(rows), got(embedding_dedup.near_duplicates(df, codewords=12))
    assert sum(x[1] for x in want) > 300
    assert sum(x[1] for x in have) >= 0.95 * sum(x[1] for x in want)


def test_large_ids_and_rows_without_id(spark):
    v, w = [1.0] * 8, [1.0] * 4 + [-1.0] * 4
    rows = [(2**62 + 6, v, "x"), (2**62 + 5, v, "x"), (-(2**63), w, "x"), (2**63 - 1, w, "x"), (None, v, "x"), (None, [0.5] * 3, "x"), (None, [0.5] * 3, "x")]
    out = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"))
    assert got(out) == brute(rows)
    assert {r.vec_id for r in out.collect() if r.kept} >= {2**62 + 5, -(2**63)}


def test_doubles_are_compared_as_doubles(spark):
    """A pair whose cosine passes the threshold only after rounding to floats doesn't link."""
    c = 0.98 - 1e-9
    rows = [(1, [1.0, 0.0], 0), (2, [c, (1 - c * c) ** 0.5], 0)]
    assert got(embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))) == [(1, 0, 1), (2, 0, 2)]


def test_huge_and_tiny_components_keep_their_direction(spark):
    """Squares of these overflow or vanish; the cosine is what it is after scaling."""
    rows = [(1, [1e200, 2e200], 0), (2, [1e200, 2.0001e200], 0), (3, [1e-200, 2e-200], 0), (4, [5e-324, 1e-323], 0), (5, [1.7e308, -1.7e308], 0), (6, [1.0, 2.0], 0), (7, [-1e200, -2e200], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert got(embedding_dedup.near_duplicates(df)) == [(1, 4, 1), (2, 4, 1), (3, 4, 1), (4, 4, 1), (5, 0, 5), (6, 4, 1), (7, 0, 7)]


def test_codewords_follow_the_input_without_a_ceiling(spark, monkeypatch):
    """A cell is meant to hold few vectors at any size: with cells of one vector the grid has more than 256 codewords a half, and the links stay."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1500, 8))
    x[750:] = x[:750] + rng.normal(size=(750, 8)) * 0.02
    seen = []
    fit = embedding_dedup.codebook
    monkeypatch.setattr(embedding_dedup, "CELL", 0.01)
    monkeypatch.setattr(embedding_dedup, "codebook", lambda x, k, **o: (seen.append(k), fit(x, k, **o))[1])
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)]
    have = got(embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), recall=1))
    assert min(seen) > 256 and have == brute(rows)


def test_traversal_visits_nearest_first():
    a, b = np.array([0.0, 0.3, 0.1]), np.array([0.2, 0.0])
    seen = embedding_dedup.traverse(a, b, 0.35)
    sums = [a[i] + b[j] for i, j in seen]
    assert sums == sorted(sums) and set(seen) == {(i, j) for i in range(3) for j in range(2) if a[i] + b[j] <= 0.35}


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_duplicates(df).count() == 0
