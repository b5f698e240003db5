"""Suffix dedup and packing against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import difference_cover, packing, suffix_dedup

from .conftest import EDGE


def brute(rows, length):
    """(doc_id, n_bytes, n_removed, n_spans, sha) by counting every window."""
    seen = Counter()
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        seen.update(b[s : s + length] for s in range(len(b) - length + 1))
    out = Counter()
    for i, b in data:
        gone = [False] * len(b)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()] += 1
    return out


def got(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def texts(seed, n):
    """Texts that share passages cut at random places, overlaps and periodic runs among them."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    passages = [" ".join(word() for _ in range(60)) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(r.randint(1, 5)):
            kind = r.random()
            if kind < 0.45:
                p = r.choice(passages)
                a = r.randint(0, len(p) // 2)
                parts.append(p[a : a + r.randint(10, len(p))])
            elif kind < 0.55:
                parts.append(word() * r.randint(1, 80))
            else:
                parts.append(" ".join(word() for _ in range(r.randint(1, 50))))
        out.append("".join(parts))
    return [*out, out[0], out[1]]


@pytest.mark.parametrize(("seed", "length", "gram", "block"), [(1, 40, 20, 4), (2, 40, 20, 16), (3, 64, 30, 8), (4, 33, 16, 4)])
def test_equals_brute_force(spark, seed, length, gram, block):
    rows = list(enumerate(texts(seed, 60))) + [(3, "x"), (None, None), (900, "a" * 500), (901, "a" * 39)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("data", F.lit(1)).repartition(3)
    assert got(suffix_dedup.remove_repeats(df, length=length, gram=gram, block=block)) == brute(rows, length)


def test_production_length_on_documents(documents):
    """All of them, the longest too; the remaining text is what the spans leave, less the halves of characters."""
    rows = suffix_dedup.remove_repeats(documents).collect()
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == brute(list(texts.items()), 400)
    for r in rows:
        data, at, rest = texts[r.doc_id].encode(), 0, ""
        for span in [*r.spans, None]:
            end = span["start"] if span else len(data)
            rest += data[at:end].decode(errors="ignore")
            at = span["end"] if span else end
        assert r.text == rest


def test_edges(edge, empty):
    assert got(suffix_dedup.remove_repeats(edge)) == brute([x[:2] for x in EDGE], 400)
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert packing.pack(empty).count() == 0


def slow_best_fit(items, capacity):
    bins, out = [], []
    for size, s, c in items:
        fits = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= size and not (s >= 0 and s in b["s"]) and not (c >= 0 and c in b["c"])]
        if fits:
            k = min(fits)[1]
        else:
            bins.append({"left": capacity, "s": set(), "c": set(), "n": 0})
            k = len(bins) - 1
        b = bins[k]
        out.append((k, b["n"]))
        b["left"] -= size
        b["s"].add(s)
        b["c"].add(c)
        b["n"] += 1
    return out


def test_best_fit_takes_the_tightest_compatible_bin():
    for seed in range(30):
        r = random.Random(seed)
        items = sorted(((r.randint(0, 50), r.randint(-1, 6), r.randint(-1, 20)) for _ in range(150)), reverse=True)
        assert packing.best_fit(items, 60) == slow_best_fit(items, 60)


def test_clusters_ignore_case_and_white_space(spark, edge):
    rows = [(1, "\nabc def", "a"), (2, " ABC  def ", "b"), (3, "abc\tDEF", "c"), (4, "abcdef", "d")]
    out = {r.doc_id: r for r in packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert len({out[k].cluster for k in (1, 2, 3)}) == 1 and out[4].cluster != out[1].cluster
    assert len({out[k].bin_id for k in (1, 2, 3)}) == 3


def test_one_block_is_plain_best_fit(documents):
    """Bins by residual of the whole input, and how full they are where nothing conflicts."""
    docs = documents.withColumn("source", F.lit(None).cast("string"))
    rows = packing.pack(docs, capacity=4096, block_items=10**6).collect()
    items = packing.pieces(docs, "doc_id", "text", "source", 4096).collect()
    bins = Counter(r.bin_id for r in rows)
    order = sorted(items, key=lambda r: -r["size"])
    groups = {c: k for k, c in enumerate({r.cluster for r in items})}
    slow = slow_best_fit([(r["size"], -1, groups[r.cluster]) for r in order], 4096)
    assert abs(len(bins) - len({b for b, _ in slow})) <= 0.01 * len(bins)  # ties may fall otherwise
    full = sum(r["size"] for r in rows) / (len(bins) * 4096)
    assert full > 0.97
    blocks = packing.pack(docs, capacity=4096, block_items=len(items) // 4).select("bin_id").distinct().count()
    assert blocks <= 1.05 * len(bins)


def test_pieces_end_between_characters(spark):
    texts = ["é" * 50, "a€" * 40, "\U0001f600" * 30, "x" * 64, "", None, "y" * 65]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("s"))
    parts = defaultdict(list)
    for r in packing.pack(df, capacity=64).collect():
        assert 0 <= r["size"] <= 64
        parts[r.doc_id].append((r.piece, (texts[r.doc_id] or "").encode()[r.start : r.start + r["size"]].decode()))
    assert {k: "".join(t for _, t in sorted(v)) for k, v in parts.items()} == {k: t or "" for k, t in enumerate(texts)}
    assert len(parts[3]) == 1


def test_token_counts_and_given_clusters(spark):
    rows = [(1, 150, 7, "a"), (2, 40, 7, "b"), (3, 30, 8, "c"), (4, None, None, "d")]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, component_id long, source string").withColumn("text", F.lit("x"))
    out = packing.pack(df, capacity=100, size_col="n_tokens", cluster_col="component_id").collect()
    assert sorted((r.doc_id, r.piece, r.start, r["size"]) for r in out) == [(1, 0, 0, 100), (1, 1, 100, 50), (2, 0, 0, 40), (3, 0, 0, 30), (4, 0, 0, 0)]
    assert not {r.bin_id for r in out if r.doc_id == 1} & {r.bin_id for r in out if r.doc_id == 2}


@pytest.mark.parametrize("name", ["edge", "documents"])
def test_packing_constraints(request, name):
    docs = request.getfixturevalue(name)
    rows = packing.pack(docs.withColumn("bin_id", F.lit(0)), capacity=2048).collect()
    total = docs.select(F.sum(F.octet_length(F.coalesce("text", F.lit(""))))).first()[0]
    assert sum(r["size"] for r in rows) == total
    bins = defaultdict(list)
    for r in rows:
        bins[r.bin_id].append(r)
    for held in bins.values():
        assert sum(r["size"] for r in held) <= 2048
        named = [r.source for r in held if r.source is not None]
        assert len(set(named)) == len(named) and len({r.cluster for r in held}) == len(held)
        assert sorted(r.bin_slot for r in held) == list(range(len(held)))
    assert len({(r.doc_id, r.cluster, r.piece) for r in rows}) <= len(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_difference_cover_equals_brute_force(spark, seed):
    """The full algorithm on short texts, with strings that repeat within a text and across texts."""
    rng = random.Random(seed)
    shared = "".join(rng.choice("abé") for _ in range(300))
    rows = [(i, "".join(rng.choice("abé") for _ in range(rng.randint(0, 40))) + shared[rng.randint(0, 20) :] + "x" * rng.randint(0, 3)) for i in range(6)]
    rows += [(10, "ab" * 200), (11, None), (12, "short"), (None, shared)]
    length = 260
    counts = Counter(b[s : s + length] for b in ((t or "").encode() for _, t in rows) for s in range(len(b) - length + 1))
    want = Counter((i, s) for i, t in rows for s in range(len((t or "").encode()) - length + 1) if counts[(t or "").encode()[s : s + length]] > 1)
    out = difference_cover.repeated_windows(spark.createDataFrame(rows, "doc_id long, text string"), length=length).collect()
    assert Counter((r.doc_id, r.pos) for r in out) == want and len(want) > 300
