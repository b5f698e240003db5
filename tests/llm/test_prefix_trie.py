"""The conversation trie against a plain dictionary of prefixes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn int, role string, text string"
COLUMNS = [x.split(" ")[0] for x in pt.NODE.split(", ")]


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    whole = {}
    for c, turns in own.items():
        h, donor = zlib.crc32(str(c).encode()) % 4, (c // 20 if c >= 0 else -(-c // 20)) * 20  # as SQL's % has it
        whole[c] = own.get(donor, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    below = defaultdict(list)
    for p in members:
        for d in range(len(p) + 1):
            below[p[:d]].append(p)
    out = []
    for p, convs in members.items():
        ends = ",".join(map(str, sorted(c for c in convs if len(whole[c]) == len(p))))
        saved = sum((len(members[q]) - 1) * len(re.findall(rb"[^\x20\x09-\x0d]+", q[-1][1])) for q in below[p] if q)
        leaves = sum(all(len(whole[c]) == len(q) for c in members[q]) for q in below[p])
        kids = sum(len(q) == len(p) + 1 for q in below[p])
        out.append((min(convs), len(p), min(members[p[:-1]]) if p else None, len(convs), kids, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def some(seed, n=130):
    r = random.Random(seed)
    say = ["", None, "a b", "a  b ", "\x1cé \x0bx\ty", "hello there", "b", "ok", "long " * 300]
    rows = []
    for c in r.sample(range(0, 400), n):
        for k in range(r.choice([1, 1, 2, 3, 5, 8])):
            rows.append((c, r.choice([k, k, k, None, 3]), r.choice(["user", "assistant", None, ""]), say[min(8, int(r.expovariate(0.6)))]))
    hot = [(k, "user" if k % 2 else "assistant", f"same turn {k}") for k in range(6)]
    rows += [(1000 + k, *t) for k in range(60) for t in hot]  # copies
    rows += [(2000 + k, *t) for k in range(12) for t in hot[: k % 6 + 1]]  # ends along the copies' chain
    rows += [(3000, k, "user", f"turn {k}") for k in range(300)] + [(3001, k, "user", f"turn {k}") for k in range(290)]  # long ones
    return rows + rows[:7] + [(None, 0, "user", "nobody's")] + [(-7, 1, "user", "x"), (2**53 + 1, 0, "user", "x"), (2**53 + 2, 0, "user", "x")]


@pytest.mark.parametrize("limit", [1, 6, 128, 10**6])
def test_equals_plain_prefixes(spark, limit, monkeypatch):
    monkeypatch.setattr(pt, "DEPTHS", 16)
    rows = some(limit)
    docs = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(1).alias(c) for c in ("c", "D", "left", "pos", "tid")]).repartition(6)
    have = pt.conversation_trie(docs, limit=limit)
    assert have.columns == COLUMNS
    assert sorted(map(tuple, have.collect())) == plain(rows)


def test_quicksort_of_a_bucket():
    r = random.Random(1)
    members = [(c, tids, [t % 7 for t in tids]) for c in range(80) if (tids := [r.randint(0, 2) for _ in range(r.randint(1, 9))])]
    nodes, (children, leaves, saved) = pt.finished(-1, 0, members)
    assert len({(n[0], n[1]) for n in nodes}) == len(nodes) == len({tuple(t[:d]) for _, t, _ in members for d in range(1, len(t) + 1)})
    assert children == len({t[0] for _, t, _ in members}) and leaves == sum(n[4] == 0 for n in nodes)
    assert saved == sum((n[3] - 1) * w for n in nodes for c, t, ws in members if c == n[0] for w in ws[n[1] - 1 : n[1]])


def test_ends_of_one_node_may_lie_in_many_ranges(spark, monkeypatch):
    ids = [3 * k + 1 for k in range(5000)]
    ends = spark.createDataFrame([(1, 2, c) for c in ids] + [(7, 1, 7)], "conv long, depth long, c long")
    have = {(r.conv, r.depth): r.ends for r in pt.end_hashes(ends).collect()}
    sha = lambda x: hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()
    assert have == {(1, 2): sha(ids), (7, 1): sha([7])}


def test_empty(spark):
    assert pt.conversation_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    one = spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)
    assert pt.conversation_trie(one).collect() == []


def test_turnless_conversations_belong_to_the_root(spark):
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(c, 0, "user", "x")]
    assert [tuple(r) for r in pt.conversation_trie(spark.createDataFrame(rows, SCHEMA)).collect()] == plain(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
