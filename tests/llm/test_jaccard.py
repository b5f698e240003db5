"""The Jaccard join against all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import jaccard_join

from .conftest import EDGE

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, size=4):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute(rows, threshold=85):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= threshold * len(a | b):
                parent[root(x)] = root(y)
            if sets[x][0] is not None and sets[x][0] == sets[y][0] and a and b:
                parent[root(x)] = root(y)
    low = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            low[root(x)] = min(low.get(root(x), i), i)
    return sorted(((i, len(s), low.get(root(x))) for x, (i, s) in enumerate(sets)), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def family(seed):
    """Chains of edits, short texts, texts that only share a passage, exact copies."""
    r = random.Random(seed)
    word = lambda: r.choice(["Red", "blue"]) + str(r.randint(0, 400))
    rows, passage = [], [word() for _ in range(30)]
    for _ in range(6):
        words = [word() for _ in range(r.choice([3, 5, 8, 30, 120, 300]))]
        for _ in range(r.randint(1, 9)):
            rows.append(" ".join(words))
            for _ in range(r.randint(0, max(1, len(words) // 60))):
                words[r.randrange(len(words))] = word()
    for _ in range(25):
        rows.append(" ".join([word() for _ in range(r.randint(1, 60))] + passage + [word() for _ in range(r.randint(1, 60))]))
    for _ in range(6):
        rows.append(" ".join(passage + [word() for _ in range(r.randint(0, 3))]))
    r.shuffle(rows)
    return [*enumerate(rows), (1000, rows[0].upper()), (1001, rows[0] + " "), (1002, None), (1003, " \n"), (1004, "one"), (1005, "ONE"), (1006, "one ")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    monkeypatch.setattr(jaccard_join, "QUERIES", 2)
    rows = [*family(seed), (None, "one"), (None, "nobody has this text here"), (None, "nobody has this text here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).repartition(3)
    assert got(jaccard_join.near_components(df)) == brute(rows)


def test_large_ids_and_texts_that_share_nothing(spark):
    """Complementary Thue-Morse words collide under any polynomial modulo a power of two."""
    word = "a"
    while len(word) < 4096:
        word += word.translate({97: 98, 98: 97})
    rows = [(k, w) for k, n in enumerate((512, 1024, 2048, 4096)) for w in (word[:n], word[:n].translate({97: 98, 98: 97}))]
    rows = [(10 * k + i, w) for i, (k, w) in enumerate(rows)]
    rows += [(2**62 + 6, "same text"), (2**62 + 5, "same text"), (-(2**63), "other text"), (2**63 - 1, "other text"), (None, "same text")]
    assert got(jaccard_join.near_components(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert got(jaccard_join.near_components(documents)) == brute(rows)


def test_edges(edge, empty):
    assert got(jaccard_join.near_components(edge)) == brute([x[:2] for x in EDGE])
    assert jaccard_join.near_components(empty).count() == 0
