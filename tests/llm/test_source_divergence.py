"""Source divergence against a dense count of every term in every source."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import source_divergence

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def dense(rows, min_docs, top):
    by, found, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, _ in rows:
        text, lang, source = text or "", lang or "", source or ""
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lowered)
        by[lang, source].update(terms)
        found[lang].update(set(terms))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in found[lang].items() if n >= min_docs]
        total = Counter()
        for s in sources:
            total.update({t: by[lang, s][t] for t in kept})
        shares = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[u] for u in kept) + 2 * len(kept)) for t in kept}
        q, p = shares(total), {s: shares(by[lang, s]) for s in sources}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            pair = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(f(p[s][t], q[t]), t) for t in kept if by[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pair, None), ("term", term, top)):
                ordered = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ordered, 1)]
    return sorted(out)


def rows(seed):
    r = random.Random(seed)
    words = ["the", "The", "É", "é", "straße", "a1b", "日本", "x_y", "K", "\U0001f600", "ſ", "ab", "zz", "q", "İ"]
    out = []
    for k in range(120):
        text = "".join(r.choice(words) + r.choice([" ", "\n", "7", "-", "\x7f", " "]) for _ in range(r.choice([0, 1, 5, 40])))
        out.append((k, text if k % 17 else None, r.choice(["en", "fr", None, ""]), "hot" if k % 3 == 0 else r.choice(["a", "b", "é", "\U0001f600", "ｚ", None, ""]), 0))
    out += out[:9]
    out += [(500, "x " * 3000, "en", "long", 0), (501, "", "en", "silent", 0), (502, "rare words only", "xx", "one", 0), (503, None, "xx", "two", 0), (504, "alone", "yy", "one", 0)]
    return out


@pytest.mark.parametrize("min_docs,top", [(3, 10), (1, 2), (10**6, 10), (10, 10)])
def test_equals_dense_count(spark, min_docs, top):
    data = rows(min_docs)
    docs = spark.createDataFrame(data, SCHEMA).select("*", *[F.lit(1).alias(c) for c in ("term", "VALUE", "rank", "zero")]).repartition(5)
    have = source_divergence.source_divergence(docs, min_docs=min_docs, top=top)
    assert have.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, have.collect())) == dense(data, min_docs, top)


def test_blocks_of_sources(spark, monkeypatch):
    monkeypatch.setattr(source_divergence, "BLOCK", 2)
    data = rows(1)
    assert sorted(map(tuple, source_divergence.source_divergence(spark.createDataFrame(data, SCHEMA), min_docs=2).collect())) == dense(data, 2, 10)


def test_a_task_hands_on_what_it_can_not_hold(monkeypatch):
    batches = [pa.record_batch([pa.array(["en", "fr"]), pa.array(["a", "a"]), pa.array([f"x y{chr(98 + k)} x", "z"])], names=["lang", "source", "text"]) for k in range(9)]
    sums = lambda out: (len(out), pa.Table.from_batches(out).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")]).sort_by([("lang", "ascending"), ("term", "ascending")]))
    n, whole = sums(list(source_divergence.counted(iter(batches))))
    monkeypatch.setattr(source_divergence, "HELD", 5)
    m, cut = sums(list(source_divergence.counted(iter(batches))))
    assert m > n and cut == whole


def test_empty(spark):
    assert source_divergence.source_divergence(spark.createDataFrame([], SCHEMA)).collect() == []
