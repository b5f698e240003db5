"""The inverted index against a full join."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import text_index
from tessera.sources import sinks


def zipf(seed=1, n=1500, words=3000):
    """A few very common words, many rare ones, and copies."""
    r = random.Random(seed)
    weights = [1 / (k + 1) for k in range(words)]
    docs = [(k, [f"w{x}" for x in r.choices(range(words), weights, k=r.randint(0, 60))]) for k in range(n)]
    docs += [(n + k, docs[k][1]) for k in range(20)]
    return docs


def full(docs, queries, k):
    by = {}
    for i, terms in docs:
        if i is not None:
            by.setdefault(i, Counter()).update(t for t in terms or [] if t is not None)
    df = Counter(t for c in by.values() for t in c)
    out, pairs = {}, 0
    for q, terms in queries:
        scores = Counter()
        for t in set(terms or []):
            for i, c in by.items():
                if c[t]:
                    pairs += 1
                    scores[i] += (len(by) // df[t]).bit_length() * (10 * c[t] // (c[t] + 1))
        if scores:
            out[q] = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out, pairs


@pytest.fixture(scope="module")
def index(spark):
    docs = zipf()
    path = sinks.scratch(spark, "words")
    odd = [(None, ["w1"]), (5000, None), (5001, []), (5002, [None, "w2"])]
    df = spark.createDataFrame(docs + odd, "doc_id long, terms array<string>").withColumn("df", F.lit(1)).repartition(4)
    text_index.build(df, path, "doc_id", F.col("terms"))
    return docs + odd, text_index.TextIndex(spark, path)


def test_equals_the_full_join_with_under_a_fifth_of_its_pairs(spark, index):
    docs, found = index
    r = random.Random(2)
    # texts of some document with common words, as questions are
    queries = [(k, list(dict.fromkeys(docs[r.randrange(1500)][1][:12] + ["w0", "w1", "w2", "w3"]))) for k in range(30)]
    queries += [(100, ["absent"]), (101, []), (102, None), (103, ["w0"]), (104, ["w0", "w0", "w2999"])]
    asked = spark.createDataFrame(queries, "q_id long, terms array<string>")
    for k in (3, 10):
        got = {}
        for x in found.search(asked, k).orderBy("q_id", "rank").collect():
            got.setdefault(x.q_id, []).append((x.id, x.score))
        want, pairs = full(docs, queries, k)
        assert got == want
    assert found.pairs_of_all(asked) == pairs
    few = asked.where("q_id < 100")
    _, first, second = found.steps(few, 3)
    assert first.count() + second.count() < found.pairs_of_all(few) / 5


def test_empty(spark, index):
    _, found = index
    assert found.search(spark.createDataFrame([], "q_id long, terms array<string>"), 5).count() == 0
    path = sinks.scratch(spark, "words")
    text_index.build(spark.createDataFrame([], "doc_id long, terms array<string>"), path, "doc_id", F.col("terms"))


def test_build_writes_each_count_in_two_tables_only(spark, monkeypatch):
    """The forward table and the postings; no other copy of all counts is staged."""
    copies, kept = [], sinks.kept
    monkeypatch.setattr(sinks, "kept", lambda df, name: copies.append(name) or kept(df, name))
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"]), (2, ["c"])], "doc_id long, w array<string>")
    path = sinks.scratch(spark, "words")
    text_index.build(docs, path, "doc_id", F.col("w"))
    assert copies == [] and text_index.TextIndex(spark, path).read("forward").count() == 2
